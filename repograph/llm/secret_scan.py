"""Secret scans: fixed patterns plus a sliding-window entropy test per character class.

DataFrame functions only. Matches come from ``regexp_extract_all``; their positions from the
lengths of the text between them (``split`` by the same pattern), summed by a window over the
matches of one document, so nothing is appended inside a fold and the text is never shuffled.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograph.functions.scan import bind

#: The three base kinds in report order, with the pattern and the shortest
#: length (of group 2 for ``assign``, else of the match).
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ASSIGN_MIN = 8
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_MIN = 16
HEX = r"[0-9a-f]{32,}"

#: Candidates of the entropy test: whole runs of token characters with a digit or a capital.
_RUN = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{_RUN}])(?=[a-z+/_=-]*[A-Z0-9])[{_RUN}]{{20,}}"
TOKEN_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits per character that always suffice, for hexadecimal and for other runs.
ENTROPY_BITS = {"hex": 3.1, "token": 4.0}
WINDOW = 24
#: Bits that 99 % of uniformly random strings of 20, 21, .. 24 characters reach (200,000
#: simulated strings each), by the class of the string: pattern and bits.
RECALL_BITS = (
    (r"^[A-Z0-9]+$", (3.341, 3.403, 3.442, 3.497, 3.538)),          # base32
    (r"^[a-z0-9]+$", (3.408, 3.463, 3.516, 3.555, 3.605)),          # lower case and digits
    (r"^[A-Za-z0-9]+$", (3.646, 3.689, 3.754, 3.816, 3.855)),       # base62
    (r"", (3.646, 3.725, 3.788, 3.827, 3.886)),                     # base64
)
#: Candidates that are no secrets: UUIDs, documentation samples, alphabets, plain numbers.
ALLOW_LIST = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|x{8}|0{8}",
    r"(?i)abcdefghij|0123456789",
    r"^[0-9+/_=-]+$",
)


def max_window_entropy(candidate: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits per character) over all windows of ``candidate``.

    The counts are a string with a character for each slot, whose code is the count. As a
    character enters the window and one leaves, one character of it is replaced each and the
    sum of c*log2(c) is updated: a step costs the same at any length and any position.
    Characters outside ``alphabet`` share one extra slot. Strings shorter than ``window`` are
    one window.
    """
    w = F.least(F.lit(window), F.length(candidate))
    clog = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    slots = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""),
                        lambda c: F.instr(F.lit(alphabet), c) + 1)
    zero = 48
    start = F.struct(F.lit(chr(zero) * (len(alphabet) + 1)).alias("n"),
                     F.lit(0.0).alias("s"), F.lit(float("inf")).alias("least"))

    def put(counts: Column, slot: Column, n: Column) -> Column:
        return F.overlay(counts, F.char(n + zero), slot, 1)

    def step(st, x):
        into, out = x["into"], x["out"]
        same, leaves = into == out, out >= 0
        n_in = F.ascii(F.substr(st["n"], into, F.lit(1))) - zero
        n_out = F.ascii(F.substr(st["n"], out, F.lit(1))) - zero
        s = F.when(same, st["s"]).otherwise(
            st["s"] + clog[n_in + 1] - clog[n_in]
            + F.when(leaves, clog[n_out - 1] - clog[n_out]).otherwise(0.0))
        entered = put(st["n"], into, n_in + 1)
        counts = F.when(same, st["n"]).when(leaves, put(entered, out, n_out - 1)).otherwise(entered)
        return F.struct(counts.alias("n"), s.alias("s"),
                        F.when(x["full"], F.least(st["least"], s)).otherwise(st["least"]).alias("least"))

    steps = bind(F.struct(slots.alias("at"), w.alias("w")), lambda b: F.transform(b["at"], lambda c, i: F.struct(
        c.alias("into"), F.when(i >= b["w"], b["at"][i - b["w"]]).otherwise(-1).alias("out"),
        (i + 1 >= b["w"]).alias("full"))))
    total = F.aggregate(steps, start, step, lambda st: st["least"])
    return F.log2(w.cast("double")) - total / w


def _needed_bits(piece: Column, window: int, bits: dict) -> Column:
    """Bits a window of ``piece`` must reach, by its class and the window's length."""
    w = F.least(F.lit(window), F.length(piece))
    at = F.least(F.greatest(w - 19, F.lit(1)), F.lit(5))
    needed = F.when(piece.rlike("^[0-9a-fA-F]+$"), F.lit(bits["hex"]))
    # an access key is a base span of the same place already
    needed = needed.when(piece.rlike(f"^{ACCESS}$"), F.lit(bits["token"]))
    for pattern, by_length in RECALL_BITS:
        of_class = F.array(*[F.lit(min(b, bits["token"])) for b in by_length])
        needed = needed.when(piece.rlike(pattern), F.element_at(of_class, at))
    return needed


def _secret(hit: Column, window: int, bits: dict, allow: tuple) -> Column:
    """Whether the run, or a part of it between ``=`` and ``/``, passes the entropy test and
    is not on the allow-list."""
    def passes(piece: Column) -> Column:
        allowed = F.lit(False)
        for p in allow:
            allowed = allowed | piece.rlike(p)
        text = F.when(piece.rlike("^[0-9a-fA-F]+$"), F.lower(piece)).otherwise(piece)
        return F.when(allowed, False).otherwise(
            max_window_entropy(text, TOKEN_ALPHABET, window) >= _needed_bits(piece, window, bits) - 1e-9)

    parts = F.filter(F.split(hit, "[=/]+"), lambda p: (F.length(p) >= 20) & p.rlike("[A-Z0-9]") & (p != hit))
    return F.exists(F.concat(F.array(hit), parts), passes)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, nth, gap before in code points, match) of one pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<kind:string,nth:int,gap:int,hit:string>>")
    return F.when(F.size(found) == 0, empty).otherwise(bind(gaps, lambda g: F.transform(found, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("nth"), F.length(g[i]).alias("gap"), m.alias("hit")))))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 window: int = WINDOW, bits: dict | None = None,
                 allow: tuple = ALLOW_LIST) -> DataFrame:
    """One row per row of ``docs``: its id, ``base`` and ``spans``.

    Both are arrays of (start, rank, kind, end), sorted; positions in code points, end
    exclusive; ``spans`` holds the base spans and the entropy spans. A base span is the whole
    match (leftmost, not overlapping per kind) that passes its length test. An ``entropy``
    span is a candidate run that, as a whole or in a part of 20 or more characters between
    ``=`` and ``/``, has a window with the bits of its class (hexadecimal, base32, lower case
    and digits, base62, base64) and length, and that no allow-list pattern matches; the
    allow-list never removes base spans. A run of lower-case letters alone is no candidate.

    Defined results: null or empty text has no spans; repeated rows and null ids keep their
    own rows; an empty table gives an empty table; other columns are ignored.
    """
    bits = bits or ENTROPY_BITS
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
                       F.concat(*[_matches(text, k, p) for k, p in patterns]).alias("hits"))
    hits = rows.select("rid", "id", F.explode_outer("hits").alias("m")).select(
        "rid", "id", "m.*")
    before = Window.partitionBy("rid", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.length("hit")).over(before)
    hits = hits.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))
    hit = F.col("hit")
    good = (F.when(F.col("kind") == "assign",
                   F.length(F.regexp_extract(hit, ASSIGN, 1)) >= ASSIGN_MIN)
            .when(F.col("kind") == "access", F.length(hit) >= ACCESS_MIN)
            .when(F.col("kind") == "hex", F.lit(True))
            .when(F.col("kind") == "entropy", _secret(hit, window, bits, allow)))
    rank = F.array_position(F.array(*[F.lit(k) for k, _ in patterns]), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    spans = F.array_sort(F.collect_list(F.when(good, span)))
    return hits.groupBy("rid", "id").agg(spans.alias("spans")).select(
        F.col("id").alias(id_col),
        F.filter("spans", lambda s: s["kind"] != "entropy").alias("base"), "spans")


def span_string(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
