"""Line dedup: drop lines whose normalised form occurs in several documents.

DataFrame functions only. Lines are exploded with their position, normalised and hashed
(two seeded 64-bit hashes, so 128 bits); distinct documents per hash come from a partial
aggregate of the smallest and largest document, never from a gathered group. Dropped
positions are joined back to each document, which is re-assembled in position order.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import ascii_lower, ascii_strip, stored

_NO_ID = 9223372036854775807


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = 10) -> DataFrame:
    """``docs`` plus ``kept_text``, ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. A key of
    at least ``min_chars`` code points found in two or more documents stays only in the
    document with the smallest id; there all its occurrences stay.

    Defined results: a null or empty text is one empty line; rows that share an id count as
    one document (each row is cut on its own); rows without id count as one document after
    all others; an empty table gives an empty table; columns of ``docs`` named like an
    output are replaced, all others pass through. Very long texts stay within their row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.drop("kept_text", "n_lines", "n_dropped").withColumns({
        "__did": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), "__rk": F.xxhash64(text)})
    lines = src.select("__did", "__rk", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = lines.select("__did", "__rk", "pos", ascii_lower(ascii_strip(F.col("line"))).alias("key"))
    keyed = keyed.where(F.length("key") >= min_chars).select(
        "__did", "__rk", "pos", F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))
    shared = keyed.groupBy("h1", "h2").agg(
        F.min("__did").alias("first"), F.max("__did").alias("last")).where(
        F.col("first") < F.col("last")).select("h1", "h2", "first")
    # stored: a join of two plain exchanges, which AQE can split at a very common line
    shared = stored(shared, "shared-lines")
    dropped = keyed.join(shared, ["h1", "h2"]).where(F.col("__did") != F.col("first"))
    per_doc = dropped.groupBy("__did", "__rk").agg(F.collect_set("pos").alias("__drop"))
    cut = src.join(per_doc, ["__did", "__rk"], "left").withColumn("__lines", F.split(text, "\n", -1))
    keep = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.when(F.col("__drop").isNull(), text).otherwise(
        F.array_join(F.transform(keep, lambda i: F.col("__lines")[i]), "\n"))
    return cut.withColumns({
        "kept_text": kept, "n_lines": F.size("__lines").cast("long"),
        "n_dropped": F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop")).cast("long"),
    }).drop("__did", "__rk", "__drop", "__lines")


def deduped_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the columns of ``docs``, ``text`` (and ``n_chars``) after the cut.

    A null text stays null; nothing else changes and no document goes.
    """
    cut = line_dedup(docs)
    new = {"text": F.when(F.col("text").isNotNull(), F.col("kept_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
