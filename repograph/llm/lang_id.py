"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (byte strings of
up to 8 bytes of a byte-level BPE rank file). A word's likelihood in a language is the sum,
over all ways to cut it into pieces, of the product of the pieces' probabilities: a forward
pass over its bytes, in numpy for all new words and all languages at once. Words of any length
are summed whole: the last forward values are carried and scaled, so that nothing underflows. A
text scores the sum of its words' log-likelihoods plus the language's prior.

Piece probabilities are learned by expectation maximisation: forward-backward gives the
expected piece counts over all segmentations. The rows learned from are a bounded sample
(``sample_rows`` labelled documents of each language, the smallest hashes of id and text); priors
count all labelled rows. Scoring reads every text whole.
"""
from __future__ import annotations

import base64
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograph.llm.common import arrow_batches, stored

PIECE_BYTES = 8               # longest piece
SHORT_BYTES = 16              # words up to this are summed without scaling
BLOCK_BYTES = 1 << 16         # bytes of a long word whose pieces are looked up at once
CACHED_BYTES = 64             # longest word whose scores are kept
BUCKETS = 64                  # parts of a language's rows that choose their sample on their own
CACHE_WORDS = 500_000         # words whose scores a process keeps
SAMPLE_FILES = 24             # files of the sample's word counts
UNKNOWN = "und"


class Pieces:
    """The vocabulary's pieces of up to PIECE_BYTES bytes, by length, with ids."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
        pieces |= {bytes([b]) for b in range(256)}
        self.keys, self.base, n = [], [], 0
        for length in range(1, PIECE_BYTES + 1):
            of = sorted(p for p in pieces if len(p) == length)
            self.keys.append(np.array([int.from_bytes(p.ljust(8, b"\0"), "big") for p in of], np.uint64))
            self.base.append(n)
            n += len(of)
        self.n = n

    def lookup(self, words: np.ndarray) -> list[np.ndarray]:
        """Ids of the pieces at each start: for each length l an array (words, starts), -1 if
        the bytes there are no piece. ``words`` is a byte matrix of words of one length."""
        n, size = words.shape
        padded = np.zeros((n, size + 8), np.uint8)
        padded[:, :size] = words
        eight = np.zeros((n, size), np.uint64)
        for k in range(8):
            eight = (eight << np.uint64(8)) | padded[:, k:k + size]
        out = []
        for length in range(1, min(PIECE_BYTES, size) + 1):
            keys, part = self.keys[length - 1], eight[:, :size - length + 1]
            part = part & np.uint64(~((1 << (8 * (8 - length))) - 1) & (2 ** 64 - 1))
            if not len(keys):
                out.append(np.full(part.shape, -1, np.int32))
                continue
            at = np.minimum(np.searchsorted(keys, part.ravel()), len(keys) - 1)
            hit = keys[at] == part.ravel()
            out.append(np.where(hit, at + self.base[length - 1], -1).astype(np.int32).reshape(part.shape))
        return out


def _raw(word: str) -> bytes:
    """A word's bytes, with a space in front."""
    return b" " + word.encode("utf-8", "surrogatepass")


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, byte matrix) for each length, in pieces of bounded size or a single word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for s in np.unique(size).tolist():
        at, step = np.flatnonzero(size == s), max(1, min(20_000, 640_000 // s))
        for i in range(0, len(at), step):
            part = at[i:i + step]
            yield part, np.frombuffer(b"".join([words[k] for k in part.tolist()]), np.uint8).reshape(-1, s)


def forward(pieces: Pieces, words: np.ndarray, prob: np.ndarray) -> tuple[list[np.ndarray], list]:
    """Forward sums: alpha[t] (words, languages) over all segmentations of the first t bytes,
    unscaled, for short words.
    ``prob`` is (pieces + 1, languages); its last row is zero, for bytes that are no piece."""
    ids = pieces.lookup(words)
    n, size = words.shape
    alpha = [np.ones((n, prob.shape[1]))]
    for t in range(1, size + 1):
        total = np.zeros((n, prob.shape[1]))
        for length in range(1, min(t, PIECE_BYTES) + 1):
            total += alpha[t - length] * prob[ids[length - 1][:, t - length]]
        alpha.append(total)
    return alpha, ids


def _rescaled(last: list[np.ndarray], scale: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Divide the carried values by their largest, whose logarithm goes to ``scale``."""
    top = np.max(last, axis=0)
    return [x / top for x in last], scale + np.log(top)


def log_forward(pieces: Pieces, words: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Logarithm of the forward sum of whole words of any length (words, languages). Only the
    last PIECE_BYTES values are carried; they are scaled together every PIECE_BYTES bytes."""
    n, size = words.shape
    last, scale = [np.ones((n, prob.shape[1]))], np.zeros((n, prob.shape[1]))     # the latest first
    for at in range(0, size, BLOCK_BYTES):
        lo, hi = max(0, at - PIECE_BYTES + 1), min(size, at + BLOCK_BYTES)
        ids = pieces.lookup(words[:, lo:hi])
        for t in range(at + 1, hi + 1):
            total = sum(last[k - 1] * prob[ids[k - 1][:, t - k - lo]]
                        for k in range(1, min(t - lo, PIECE_BYTES) + 1))
            last = [total, *last[:PIECE_BYTES - 1]]
            if t % PIECE_BYTES == 0:
                last, scale = _rescaled(last, scale)
    return scale + np.log(last[0])


def word_scores(pieces: Pieces, words: list[str], prob: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language, all segmentations summed."""
    out = np.zeros((len(words), prob.shape[1]))
    for at, m in _by_length([_raw(w) for w in words]):
        short = m.shape[1] <= SHORT_BYTES
        out[at] = np.log(forward(pieces, m, prob)[0][-1]) if short else log_forward(pieces, m, prob)
    return out


def expected_counts(pieces: Pieces, words: list[str], n: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected count of every piece in words of one language (``prob``: one column), by a scaled
    forward and backward pass. Words above BLOCK_BYTES are learned from in parts of that size."""
    prob, parts, of = prob[:, 0], [], []
    for i, w in enumerate(words):
        raw = _raw(w)
        cut = [raw[j:j + BLOCK_BYTES] for j in range(0, len(raw), BLOCK_BYTES)]
        parts += cut
        of += [i] * len(cut)
    of, out = np.array(of, np.int64), np.zeros(pieces.n + 1)
    for at, m in _by_length(parts):
        ids, size = pieces.lookup(m), m.shape[1]
        last, scale = [np.ones(len(m))], np.zeros(len(m))
        alpha = [scale]                                     # logarithms
        for t in range(1, size + 1):
            total = sum(last[k - 1] * prob[ids[k - 1][:, t - k]] for k in range(1, min(t, PIECE_BYTES) + 1))
            last = [total, *last[:PIECE_BYTES - 1]]
            if t % PIECE_BYTES == 0:
                last, scale = _rescaled(last, scale)
            alpha.append(np.log(last[0]) + scale)
        whole = alpha[-1]
        last, scale = [np.ones(len(m))], np.zeros(len(m))
        piece, value = [], []
        for t in range(size - 1, -1, -1):
            before = np.exp(alpha[t] + scale - whole) * n[of[at]]
            total = np.zeros(len(m))
            for k in range(1, min(size - t, PIECE_BYTES) + 1):
                i = ids[k - 1][:, t]
                after = prob[i] * last[k - 1]
                total += after
                piece.append(i)
                value.append(before * after)
            last = [total, *last[:PIECE_BYTES - 1]]
            if t % PIECE_BYTES == 0:
                last, scale = _rescaled(last, scale)
            if t == 0 or len(piece) * len(m) > 1 << 20:
                i = np.concatenate(piece)
                out += np.bincount(np.where(i < 0, pieces.n, i), np.concatenate(value), pieces.n + 1)
                piece, value = [], []
    out[pieces.n] = 0
    return out


def split_words(texts: pa.Array) -> pa.ListArray:
    """Lower-cased runs of letters of each text (a list array; null gives no words)."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return pc.split_pattern_regex(low, r"[^\pL\pM]+")


@lru_cache(maxsize=1)
def _pieces(ranks_path: str) -> Pieces:
    return Pieces(ranks_path)


class _WordCache:
    """Scores of words met by this process under a model, in Arrow and numpy arrays."""

    def __init__(self, languages: int):
        self.words, self.scores = pa.array([], pa.large_string()), np.zeros((0, languages))


@lru_cache(maxsize=1)
def _word_cache(model: str, languages: int) -> _WordCache:
    """The process's cache: its tasks share it."""
    return _WordCache(languages)


class LanguageModel:
    """Languages, log priors and piece probabilities (pieces + 1, languages)."""

    def __init__(self, ranks_path: str, languages: list[str], prior: np.ndarray, prob: np.ndarray):
        self.ranks_path, self.languages, self.prior, self.prob = ranks_path, languages, prior, prob
        self.name = uuid.uuid4().hex

    def scorer(self):
        pieces, cache = _pieces(self.ranks_path), _word_cache(self.name, len(self.languages))

        def known(words: pa.Array) -> np.ndarray:
            """Scores of distinct words; new ones are computed, and kept if they are short."""
            if len(cache.words) > CACHE_WORDS:
                cache.__init__(len(self.languages))
            rows = pc.fill_null(pc.index_in(words, value_set=cache.words), -1).to_numpy().astype(np.int64)
            new = np.flatnonzero(rows < 0)
            if not len(new):
                return cache.scores[rows]
            sub = words.take(pa.array(new))
            got = word_scores(pieces, sub.to_numpy(zero_copy_only=False).tolist(), self.prob)
            rows[new] = len(cache.words) + np.arange(len(new))
            out = np.concatenate([cache.scores, got])[rows]
            short = pc.less_equal(pc.binary_length(sub), CACHED_BYTES).to_numpy(zero_copy_only=False)
            cache.words = pa.concat_arrays([cache.words, sub.filter(pa.array(short))])
            cache.scores = np.concatenate([cache.scores, got[short]])
            return out

        def score(texts: pa.Array) -> np.ndarray:
            """Log score (texts, languages); NaN where a text has no letter."""
            lists = split_words(texts)
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary
            table = known(words)
            code, offsets = coded.indices.to_numpy(), lists.offsets.to_numpy()
            real = (pc.binary_length(words).to_numpy() > 0)[code]
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            row, code = row[real], code[real]
            out = np.stack([np.bincount(row, weights=table[code, k], minlength=len(offsets) - 1)
                            for k in range(len(self.languages))], axis=1) + self.prior
            out[np.bincount(row, minlength=len(offsets) - 1) == 0] = np.nan
            pa.default_memory_pool().release_unused()
            return out
        return score


def train(rows: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", sample_rows: int = 1500, rounds: int = 3,
          smoothing: float = 0.05) -> LanguageModel | None:
    """A model of the languages of labelled ``rows``; None if no row has a text and a label.

    ``sample_rows`` bounds the documents of each language that piece probabilities are learned
    from, repeated rows counted once and rows without id like any other. The word counts of the sample are a stored table; each round of expectation
    maximisation is one pass over it, and its result is at most languages x pieces numbers.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return None
    languages = sorted(share)
    # each part of a language keeps its smallest hashes, then the language does among those
    rows = rows.select("lang", "text", F.xxhash64("id", "text").alias("key"))
    chosen = rows.select("lang", "key").distinct().withColumn("part", F.pmod("key", F.lit(BUCKETS)))
    for by in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*by).orderBy("key")
        chosen = chosen.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample_rows)
    chosen = F.broadcast(chosen.select("lang", "key"))            # bounded: sample_rows x languages
    sample = rows.join(chosen, ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text"))

    def count(batches: Iterator) -> Iterator:
        for b in arrow_batches(batches):
            lists, langs = split_words(b.column(1)).to_pylist(), b.column(0).to_pylist()
            found: dict = {}
            for lang, words in zip(langs, lists):
                found.setdefault(lang, Counter()).update(words)
            for lang, c in found.items():
                c.pop("", None)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "word": list(c),
                                                  "n": list(c.values())})

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stored(counts.coalesce(SAMPLE_FILES), "word-counts")      # as bounded as the sample

    pieces = _pieces(ranks_path)
    prob = np.full((pieces.n + 1, len(languages)), 1.0 / pieces.n)
    prob[pieces.n] = 0
    for _ in range(rounds):
        now = prob

        def expect(batches: Iterator, now=now) -> Iterator:
            mine, total = _pieces(ranks_path), {}
            for b in arrow_batches(batches, 2 << 20):
                lang = np.array(b.column(0).to_pylist(), object)
                words, n = np.array(b.column(1).to_pylist(), object), b.column(2).to_numpy()
                for x in set(lang):
                    at, k = lang == x, languages.index(x)
                    got = expected_counts(mine, list(words[at]), n[at], now[:, k:k + 1])
                    total[x] = total.get(x, 0) + got
            for x, t in total.items():
                i = np.flatnonzero(t)
                yield pa.RecordBatch.from_pydict({"lang": [x] * len(i), "piece": i, "n": t[i]})

        got = counts.select("lang", "word", "n").mapInArrow(expect, "lang string, piece long, n double")
        got = got.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        new = np.full((pieces.n, len(languages)), smoothing)
        new[got["piece"].to_numpy(np.int64), [languages.index(x) for x in got["lang"]]] += got["n"]
        prob = np.vstack([new / new.sum(axis=0), np.zeros((1, len(languages)))])
    prior = np.log(np.array([share[x] for x in languages], float) / sum(share.values()))
    return LanguageModel(ranks_path, languages, prior, prob)


def _best(model: LanguageModel | None, score, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    lang, value = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model:
        logs = score(texts)
        ok = np.flatnonzero(~np.isnan(logs[:, 0]))
        best = logs[ok].argmax(axis=1)
        value[ok] = 1.0 / np.exp(logs[ok] - logs[ok].max(axis=1, keepdims=True)).sum(axis=1)
        for i, k in zip(ok.tolist(), best.tolist()):
            lang[i] = model.languages[k]
    return lang, value


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred`` and ``score`` (posterior, 0 to 1).

    Only the text is read. Null texts, texts without a letter, and all texts if there is no
    model are ``und`` with score 0. Repeated rows keep their own rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        score = model.scorer() if model else None
        for b in arrow_batches(batches, 4 << 20):
            lang, value = _best(model, score, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(value)],
                                             names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identified_documents(docs: DataFrame, model: LanguageModel | None, text_col: str = "text",
                         min_score: float = 0.5) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` whose text is in a learned language with at least
    ``min_score``; all columns pass through. Without a model no row is identified."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        score = model.scorer() if model else None
        for b in arrow_batches(batches, 4 << 20):
            lang, value = _best(model, score, b.column(at))
            yield b.filter(pa.array((np.array(lang, object) != UNKNOWN) & (value >= min_score)))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by ``folds`` (a null id is not held out)."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    return F.coalesce(rest == 0, F.lit(False))
