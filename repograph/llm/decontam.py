"""Benchmark decontamination: which documents contain which short test items.

DataFrame functions only. A containment search by size-partitioned MinHash: items are put
in classes of doubling shingle counts; a class fixes how many of an item's smallest shingle
hashes form its sketch. An item of which a share ``threshold`` must be present can miss at
most ``q - ceil(threshold * q)`` of its q shingles, so a sketch longer than that meets every
true document; a document is a candidate when it holds at least the sketch's remaining
hashes. Documents are probed shingle by shingle (they are never sketched, so their length
does not weaken the search), and candidates are verified on the shingles themselves.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograph.llm.common import ascii_lower, ascii_strip, stored

_NO_ID = 9223372036854775807


def words(text: Column) -> Column:
    """A-Z lower-cased words between ASCII white space; no words gives an array of one ''."""
    return F.split(ascii_lower(ascii_strip(F.coalesce(text, F.lit("")))), r"[\x20\x09-\x0D]+")


def _shingles(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``df(keys, w)`` to (keys, h, gram): a row for each shingle, repeats included.

    Fewer words than ``size``: the whole sequence is the only shingle; no word: none.
    ``gram`` is built only where a later step reads it.
    """
    n = F.size("w")
    at = df.where(F.col("w")[0] != "").select(*keys, "w", F.posexplode("w").alias("pos", "word"))
    at = at.where((F.col("pos") <= n - size) | ((F.col("pos") == 0) & (n < size)))
    part = [F.get("w", F.col("pos") + i) for i in range(size)]
    return at.select(*keys, F.xxhash64(*part).alias("h"), F.concat_ws(" ", *part).alias("gram"))


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str,
           item_text: str, size: int, threshold: float) -> DataFrame:
    """(did, dk, item, ik, q, n, share): the pairs at ``threshold`` by id and hash of the text."""
    item = items.select(F.col(item_id).alias("item"), F.xxhash64(F.col(item_text)).alias("ik"),
                        words(F.col(item_text)).alias("w")).distinct()
    grams = _shingles(item, ["item", "ik"], size).distinct()
    of_item = Window.partitionBy("item", "ik")
    grams = stored(grams.withColumn("q", F.count(F.lit(1)).over(of_item)), "item-shingles")

    q = F.col("q")
    need = F.ceil(q * threshold - 1e-9)
    top = F.pow(F.lit(2), F.ceil(F.log2(q.cast("double"))))           # size class: (top/2, top]
    spare = top - F.ceil(top * threshold - 1e-9)                       # shingles it may miss
    length = F.least(q, (2 * spare + 2).cast("long"))                  # its sketch's length
    nth = F.row_number().over(of_item.orderBy("h", "gram"))
    sketch = grams.withColumn("nth", nth).where(F.col("nth") <= length).select(
        "item", "ik", "h", F.greatest(F.lit(1).cast("long"), length - (q - need)).alias("least"))
    sketch = stored(sketch, "item-sketches")

    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("did"),
                      F.xxhash64(F.col(text_col)).alias("dk"), words(F.col(text_col)).alias("w"))
    probe = _shingles(src, ["did", "dk"], size).drop("gram").join(sketch, "h")
    pairs = probe.groupBy("did", "dk", "item", "ik", "least").agg(
        F.count_distinct("h").alias("met")).where(F.col("met") >= F.col("least"))
    pairs = stored(pairs.select("did", "dk", "item", "ik"), "item-candidates")

    which = pairs.select("did", "dk").distinct()
    again = _shingles(src.join(which, ["did", "dk"], "left_semi"), ["did", "dk"], size)
    held = again.join(grams.select("item", "ik", "q", "h", F.col("gram").alias("other")), "h").where(
        F.col("gram") == F.col("other")).groupBy("did", "dk", "item", "ik", "q").agg(
        F.count_distinct("gram").alias("n"))
    same = [F.col(f"held.{c}").eqNullSafe(F.col(f"pairs.{c}")) for c in ("did", "dk", "item", "ik")]
    held = held.alias("held").join(pairs.alias("pairs"), same, "left_semi")
    share = F.col("n") / F.col("q")
    return held.where(share >= threshold).withColumn("share", share)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                    size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs (``id_col``, ``item_id``, ``n_shingles``, ``n_found``, ``containment``).

    ``containment`` is the share of an item's distinct ``size``-word shingles that the
    document holds; all pairs at ``threshold`` or above, and no others, are returned.

    Defined results: null or empty texts (of either side) match nothing; a text with fewer
    than ``size`` words has one shingle, its whole word sequence, so a very short item only
    matches a document that is that sequence; repeated rows give one pair; rows that share an
    id are compared one by one and the best containment is returned; a null id stays null.
    """
    held = _found(docs, items, id_col, text_col, item_id, item_text, size, threshold)
    best = held.groupBy("did", "item").agg(
        F.max(F.struct("share", "q", "n")).alias("best"))
    return best.select(
        F.when(F.col("did") != _NO_ID, F.col("did")).cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("item").alias(item_id), F.col("best.q").alias("n_shingles"),
        F.col("best.n").alias("n_found"), F.col("best.share").alias("containment"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline stage: ``docs`` without the documents that contain a test item.

    Rows are told apart by id and text: a clean row stays, whatever rows share its id or lack
    one like it.
    """
    found = _found(docs, items, "doc_id", "text", "item_id", "text", 5, 0.8)
    hit = stored(found.select("did", "dk").distinct(), "contaminated")
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)) == F.col("did")) & (
        F.xxhash64("text") == F.col("dk"))
    return docs.join(hit, same, "left_anti")
