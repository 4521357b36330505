import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from .helpers import words
from .test_decontam import brute as brute_items
from .test_line_dedup import brute as brute_lines
from .test_simhash import brute as brute_groups
from .test_tokens import check_packing


def tables(spark, folder):
    r = random.Random(11)
    english = "the of and to in is was that for with this which from have not are".split()
    french = "le la les des une dans pour que qui sur avec est pas plus ce il".split()

    def prose(vocab, n):
        return "\n".join(" ".join(r.choice(vocab) + str(r.randrange(300)) for _ in range(12)) for _ in range(n))

    docs = [(i, prose(english, 8), "en") for i in range(30)] + [(100 + i, prose(french, 8), "fr") for i in range(20)]
    docs += [(200, docs[0][1], "en"), (201, docs[0][1] + "\nplus a line of its own", "en")]     # copies
    items = [(k, words(30, 900 + k)) for k in range(4)]
    docs += [(300 + k, prose(english, 3) + "\n" + t + "\n" + prose(english, 2), "en") for k, t in items]
    docs += [(400, "%%% 123 ---", "en"), (401, None, "en"), (402, "", None), (403, prose(english, 400), None)]
    docs += [(500 + i, "a line that every one of these has\n" + prose(french, 2), "fr") for i in range(10)]
    rows = [(*d, "src", len(d[1] or "")) for d in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [d[:2] for d in docs], items


def test_stages_and_run_match_brute_force(spark, tmp_path):
    folder = str(tmp_path / "sf")
    docs, items = tables(spark, folder)
    table = spark.read.parquet(f"{folder}/documents.parquet")

    want = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    stage = dict(corpus_pipeline.STAGES)
    got = stage["language_id"](spark, table, folder)
    assert got.columns == table.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, _ in want)

    want = [(d, text) for d, text, *_ in brute_lines(want)]
    got = stage["line_dedup"](spark, got, folder).persist()
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in got.collect())

    names = {name for *_, name in brute_groups(want)}
    want = [d for d in want if d[0] in names]
    got = stage["simhash_dedup"](spark, got, folder).persist()
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, _ in want)

    hit = {d for d, *_ in brute_items(want, items)}
    assert hit == {300, 301, 302, 303}
    want = [d for d in want if d[0] not in hit]
    got = stage["decontamination"](spark, got, folder)
    assert got.columns == table.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, _ in want)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, folder)
    check_packing(want, out.collect(), lambda t: tokenizer.encode(t, add_special_tokens=False).ids, 2048)


def test_stage_names_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]
