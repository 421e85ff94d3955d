"""Streaming: a static topic set against a stream of documents.

The scoring needs collection statistics, which a stream doesn't have; they are
given as a static snapshot (``stats``: n_docs, avgdl; ``df``: term, df). Each
micro-batch is then scored without state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.scores import place
from ..operators import scoring


def score_stream(
    docs: DataFrame, topics: DataFrame, df: DataFrame, stats: DataFrame, k1: float = 0.9, b: float = 0.4
) -> DataFrame:
    """``(topic_id, doc_id, score)`` for every arriving document that holds a
    query term. One row per (document, topic): terms are summed inside the row,
    so no watermark or state is needed."""
    scoring.check_bm25(k1, b)
    one = stats.first()  # a single row of the snapshot
    terms = topics.select("topic_id", F.explode(fx.tokenize(F.col("text"))).alias("term"))
    weighted = terms.join(df, "term").select(
        "topic_id",
        F.struct("term", scoring.idf(F.lit(float(one["n_docs"])), F.col("df")).alias("idf")).alias("t"),
    )
    queries = weighted.groupBy("topic_id").agg(F.collect_list("t").alias("terms"))
    words = docs.select("doc_id", fx.tokenize(F.col("text")).alias("words"))
    pairs = words.crossJoin(F.broadcast(queries))  # topics are a small, fixed query set
    dl = F.size("words").cast("double")

    def part(t):
        tf = F.size(F.filter("words", lambda w: w == t["term"])).cast("double")
        return t["idf"] * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / F.lit(float(one["avgdl"] or 1.0))))

    score = F.aggregate(F.transform("terms", part), F.lit(0.0), lambda acc, x: acc + x)
    return pairs.select("topic_id", "doc_id", place(score).alias("score")).where("score > 0")
