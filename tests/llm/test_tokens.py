import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import AddedToken, Tokenizer

from repograph.llm.packing import pack_documents
from repograph.llm.token_files import (BLOCK, ShardReader, ShardWriter, pack_ids, read_token_shards, unpack_ids,
                                       write_token_shards)
from repograph.llm.tokens import ChunkEncoder, chunk_encoder
from .helpers import edge_docs, empty_docs, words

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(VOCAB)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(reference):
    texts = ["", None, " ", "\n", " a", "a ", "a  b", "a\n\nb", "\n\n x \t y\n", "it's 's 'll\n's. 's", "x\r\ny z\r\n",
             "<|endoftext|> x<|endoftext|>", "a.b,c. d., e", "ß. ŋ. 日. x", "...\n... , .", "\x1c a \x1c", "y" * 300,
             words(3000, 1), "1.5,2 3.\n4"]
    r = random.Random(1)
    texts += ["".join(r.choice(" \n\tab'1.,é日") for _ in range(r.randrange(30))) for _ in range(3000)]
    encoder = ChunkEncoder(VOCAB)
    for _ in range(2):                                    # cold and warm cache
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        want = [reference(t) for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]


SPECIAL = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b", "a  <|endoftext|>\n\n b", "w <|endoftext|>. <|endoftext|>., z",
           "<|endoftext|><|endoftext|> <|endof text|> <|endoftext| >", "plain words", None, "it <|endoftext|>'s \n<|endoftext|>\n"]


@pytest.mark.parametrize("extra", [None, "<|two words|>", "<|strips|>"])
def test_special_tokens_by_the_plain_library_call(tmp_path, extra):
    plain, path = Tokenizer.from_file(VOCAB), VOCAB
    if extra:
        plain.add_special_tokens([AddedToken(extra, special=True, rstrip="strips" in extra)])
        path = str(tmp_path / "v.json")
        plain.save(path)
    r = random.Random(3)
    texts = SPECIAL + ["".join(r.choice([" ", "\n", "a", "b.", "<|endoftext|>", extra or ","]) for _ in range(12)) for _ in range(500)]
    encoder = chunk_encoder(path)
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]


def test_operators_keep_special_tokens(spark):
    plain = Tokenizer.from_file(VOCAB)
    rows = list(enumerate(SPECIAL))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda t: plain.encode(t or "", add_special_tokens=False).ids
    check_files(rows, [tuple(r) for r in read_token_shards(write_token_shards(df, VOCAB)).collect()], ids)
    check_packing(rows, pack_documents(df, VOCAB, window=256).collect(), ids, 256)


def test_long_texts_are_cut_between_chunks(reference, monkeypatch):
    import repograph.llm.tokens as T
    monkeypatch.setattr(T, "LONG_BYTES", 300)
    encoder = ChunkEncoder(VOCAB)
    r = random.Random(2)
    for t in (words(500, 1), "".join(r.choice(" \n\tab'1.,é日") for _ in range(3000)), "x" * 5000, " " * 900, "a \n b" * 300):
        ids, counts = encoder.encode(pa.array([t]))
        assert ids.tolist() == reference(t) and counts.tolist() == [len(ids)]


def test_cache_starts_anew(reference, monkeypatch):
    import repograph.llm.tokens as T
    monkeypatch.setattr(T, "CACHE_STEMS", 20)
    encoder = ChunkEncoder(VOCAB)
    for k in range(5):
        t = words(100, k)
        assert encoder.encode(pa.array([t]))[0].tolist() == reference(t)
    assert len(encoder.stems) <= 200


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.RandomState(bits).randint(0, 1 << bits, 1000, dtype=np.int64).astype(np.uint32)
    data = pack_ids(ids, bits)
    assert len(data) == 1024 * bits // 8
    assert (unpack_ids(data, bits)[:1000] == ids).all()


def test_random_access(tmp_path):
    class Kept(io.BytesIO):
        def close(self):
            (tmp_path / "x.ids").write_bytes(self.getvalue())
    r = np.random.RandomState(0)
    parts = [r.randint(0, 50257, n).astype(np.uint32) for n in (0, 5, BLOCK * 300, 1, BLOCK, 77)]
    w = ShardWriter(Kept(), 16)
    for i, p in enumerate(parts):
        w.add(p, [i if i else None], np.array([len(p)]))
    w.close()
    reader, all_ids = ShardReader(str(tmp_path / "x.ids")), np.concatenate(parts)
    for a, n in ((0, 3), (BLOCK - 1, 2), (BLOCK * 299, BLOCK), (len(all_ids) - 1, 1), (10, 0)):
        assert (reader.ids(a, n) == all_ids[a:a + n]).all()
    for (doc, _, ids), (i, p) in zip(reader.documents(), enumerate(parts), strict=True):
        assert doc == (i or None) and (ids == p).all()


def check_files(rows, got, reference):
    """Documents in ascending id order (none first), equal ids ordered by text."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, want = 0, []
    for d, t in order:
        ids = np.array(reference(t) + [2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_token_files(spark, reference):
    df, rows, _ = edge_docs(spark)
    out = read_token_shards(write_token_shards(df, VOCAB))
    check_files([r[:2] for r in rows], [tuple(r) for r in out.collect()], reference)
    assert read_token_shards(write_token_shards(empty_docs(spark), VOCAB)).count() == 0


def check_packing(rows, out, reference, window):
    docs, sequences = {}, {}
    for r in out:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    want = sorted((d, tuple(reference(t) + [1])) for d, t in rows)
    got = []
    for d, parts in docs.items():
        ids = b"".join(p.ids for p in sorted(parts, key=lambda p: p.start))
        got.append((d, tuple(np.frombuffer(ids, "<u4").tolist())))
    assert sorted(got) == want
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4
            at += p.length
        assert at <= window and at & (at - 1) == 0


def test_packing_is_a_partition(spark, reference):
    rows = [(i, words(5 + 37 * i % 400, i % 7, 300)) for i in range(120)] + [(500, None), (501, ""), (502, words(9000, 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for shard in (1 << 21, 5000):
        out = pack_documents(df, VOCAB, window=256, shard_tokens=shard).collect()
        check_packing(rows, out, reference, 256)
        lengths = [sum(r.length for r in out if r.sequence_id == s) for s in {r.sequence_id for r in out}]
        assert sum(n < 256 for n in lengths) <= 3 * 8          # a tail for each task only


def test_neighbours_share_a_window(spark):
    r = random.Random(0)
    topics = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(30)] for _ in range(8)]
    rows = [(i, " ".join(r.choice(topics[i % 8]) for _ in range(40))) for i in range(160)]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), VOCAB, window=1024).collect()
    by = {}
    for x in out:
        by.setdefault(x.sequence_id, set()).add(x.doc_id % 8)
    assert sum(len(v) for v in by.values()) / len(by) < 3      # by chance nearly all 8


def topic_docs(per_topic=20, topics=32):
    r = random.Random(0)
    words_of = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(30)] for _ in range(topics)]
    return [(i, " ".join(r.choice(words_of[i % topics]) for _ in range(40))) for i in range(per_topic * topics)]


def test_neighbours_stored_in_other_shards_share_a_window(spark):
    df = spark.createDataFrame(topic_docs(), "doc_id long, text string").repartition(4)
    out = pack_documents(df, VOCAB, window=1024, shard_tokens=6000).collect()
    assert sum(r.length for r in out) > 6 * 6000                # many shards
    by = {}
    for x in out:
        by.setdefault(x.sequence_id, set()).add(x.doc_id % 32)
    assert sum(len(v) for v in by.values()) / len(by) < 3


def test_scores_are_bm25_over_all_terms():
    r = np.random.RandomState(0)
    docs = [r.randint(0, 300, r.randint(0, 400)).astype(np.uint16) for _ in range(60)]
    docs += [np.r_[np.repeat(np.arange(400, 430), 3), 500], np.array([500]), np.array([450])]     # 500 is far below the 24 heaviest
    df = np.array([sum(t in d for d in docs) for t in range(501)])
    idf, mean = np.log1p((len(docs) - df + 0.5) / (df + 0.5)), sum(map(len, docs)) / len(docs)
    for cells in (0, 1 << 20):                                   # lists only; the frequent terms dense
        import repograph.llm.packing as P
        held, P.DENSE_CELLS = P.DENSE_CELLS, cells
        try:
            index = P.Bm25Shard(docs, idf, mean)
        finally:
            P.DENSE_CELLS = held
        for seed in (0, 5, 60, 61):
            want = [sum(idf[t] * (d == t).sum() * 2.2 / ((d == t).sum() + 1.2 * (0.25 + 0.75 * len(d) / mean))
                        for t in set(docs[seed].tolist())) for d in docs]
            assert np.allclose(index.scores(seed), want, rtol=1e-4, atol=1e-4)
            got = list(index.neighbours(seed, np.ones(len(docs), bool)))
            assert got == sorted(got, key=lambda d: -index.scores(seed)[d])
            assert sorted(got) == [d for d, w in enumerate(want) if w > 0]
    free = np.ones(len(docs), bool)
    free[60] = False
    assert list(index.neighbours(60, free)) == [61]


def test_packing_edge_rows(spark):
    df, rows, _ = edge_docs(spark)
    out = pack_documents(df, VOCAB)
    assert out.columns[0] == "doc_id"
    assert out.selectExpr("sum(length) n").first().n == sum(
        r.doc_tokens for r in out.where("start = 0").collect())
    assert out.where("start = 0").count() == len(rows)
    assert pack_documents(empty_docs(spark), VOCAB).count() == 0


def test_shards_are_read_back_by_as_many_tasks(spark):
    docs = spark.createDataFrame([(i, words(50, i)) for i in range(400)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        manifest = write_token_shards(docs.repartition(8), VOCAB)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert manifest.count() > 1 and read_token_shards(manifest).rdd.getNumPartitions() == manifest.count()
