"""Judgments from verbatim containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx

#: Characters by which items of less than three tokens are looked up.
GRAM = 3


def containing(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``(topic_id, doc_id, rel)`` of documents whose text contains an item's.

    ``items`` is ``(topic_id, text)``. Only documents that hold the item's
    longest inner token are compared, so this is an equi-join, not a nested
    loop. (The first and last token may run on in the document.) Items of
    fewer than three tokens have no inner one: they are looked up by their
    first characters, ``GRAM`` at most, among those that documents hold. An
    empty item is contained in every text, a null one in none.
    """
    inner = F.transform(
        F.slice(F.col("words"), F.lit(2), F.greatest(F.size("words") - 2, F.lit(0))),
        lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")),
    )
    anchored = items.withColumn("words", fx.tokenize(F.col("text"))).select(
        "topic_id", F.col("text").alias("item"), F.array_min(inner)["w"].alias("term")
    )
    found = (
        docs.select("doc_id", "text", F.explode(F.array_distinct(fx.tokenize(F.col("text")))).alias("term"))
        .join(anchored, "term")
        .where(F.col("text").contains(F.col("item")))
    )
    found = found.select("topic_id", "doc_id")
    short = anchored.where(F.col("term").isNull() & F.col("item").isNotNull())
    short = short.withColumn("size", F.least(F.length("item"), F.lit(GRAM)))
    for size in [r[0] for r in short.select("size").distinct().collect()]:  # of 0 to GRAM
        grams = F.array(F.lit("")) if not size else F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
        keyed = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.explode(grams).alias("gram"))
        asked = short.where(F.col("size") == size).select("topic_id", "item", F.substring("item", 1, size).alias("gram"))
        near = keyed.join(asked, "gram").where(F.col("text").contains(F.col("item")))
        found = found.unionByName(near.select("topic_id", "doc_id"))
    return found.distinct().select("topic_id", "doc_id", F.lit(1).alias("rel"))
