"""Evaluation of ranked lists and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import place
from . import scoring
from .index import Index, query_terms
from .tables import ranked, settle


def average_precision(
    run: DataFrame, qrels: DataFrame, k: int = 1000, extra: list[str] | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """``(*extra, topic_id, ap)`` for every topic of ``qrels``.

    The divisor counts all relevant documents, also those beyond ``k``; a
    topic without relevant documents, or absent from the run, has 0. ``extra``
    columns of the run (a parameter setting) are evaluated side by side.
    Where judgments are too many to list, ``qrels`` may hold those of the run
    alone, and ``totals`` ``(topic_id, relevant)`` all topics with the divisor.
    """
    extra = extra or []
    if extra:
        # Read twice: for its settings and for its hits.
        run = settle(run.where(F.col("rank") <= k).select(*extra, "topic_id", "doc_id", "rank"))
    good = qrels.where(F.col("rel") > 0).select("topic_id", "doc_id").distinct()
    total = good.groupBy("topic_id").agg(F.count("*").alias("relevant"))
    hits = run.where(F.col("rank") <= k).join(good, ["topic_id", "doc_id"], "left_semi")
    so_far = F.row_number().over(Window.partitionBy(*extra, "topic_id").orderBy("rank"))
    found = hits.withColumn("precision", so_far / F.col("rank")).groupBy(*extra, "topic_id").agg(
        F.sum("precision").alias("total")
    )
    topics = qrels.select("topic_id").distinct().join(total, "topic_id", "left") if totals is None else totals
    if extra:
        # A handful of settings times the topics.
        topics = topics.crossJoin(F.broadcast(run.select(*extra).distinct()))
    ap = F.coalesce(F.col("total") / F.col("relevant"), F.lit(0.0))
    return topics.join(found, [*extra, "topic_id"], "left").select(*extra, "topic_id", place(ap).alias("ap"))


def mean_average_precision(
    run: DataFrame, qrels: DataFrame, k: int = 1000, extra: list[str] | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """``(*extra, map)`` over the topics of ``qrels``, or of ``totals``."""
    per = average_precision(run, qrels, k, extra, totals)
    mean = place(F.coalesce(F.avg("ap"), F.lit(0.0))).alias("map")
    return per.groupBy(*extra).agg(mean) if extra else per.agg(mean)


def bm25_sweep(topics: DataFrame, index: Index, k1s: list[float], bs: list[float], topk: int) -> DataFrame:
    """Runs of all (k1, b) settings in one plan: matches are computed once, each
    document's sums for all settings where its row is, and only the best
    ``topk`` of a task are shuffled."""
    settings = [(k1, b) for k1 in k1s for b in bs]
    found = scoring.best_bm25(settle(query_terms(topics)), index, settings, topk)
    of = F.array(*(F.struct(F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b")) for k1, b in settings))
    placed = found.withColumn("s", F.element_at(of, F.col("setting") + 1))
    return placed.select("s.k1", "s.b", "topic_id", "doc_id", "score", "rank")


def best_settings(maps: DataFrame, params: list[str]) -> DataFrame:
    """Highest MAP first, ties by the parameters."""
    return maps.orderBy(F.desc("map"), *params)


def topic_folds(topics: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``(topic_id, fold)``: seeded shuffle by hash, dealt round-robin."""
    if k <= 1:
        raise ValueError("need at least two folds")
    shuffled = ranked(
        topics.select("topic_id", F.lit(0).alias("g")), ["g"], [F.xxhash64("topic_id", F.lit(seed)), F.col("topic_id")], "n"
    )
    return shuffled.select("topic_id", ((F.col("n") - 1) % k).alias("fold"))


def training_pairs(hits: DataFrame, qrels: DataFrame, negatives: int = 2, seed: int = 42, threshold: int = 1) -> DataFrame:
    """``(topic_id, doc_id, label)``: every relevant document, and for each
    ``negatives`` draws with replacement from the topic's other candidates."""
    good = qrels.where(F.col("rel") >= threshold).select("topic_id", "doc_id").distinct()
    pool = ranked(
        hits.join(good, ["topic_id", "doc_id"], "left_anti").select("topic_id", "doc_id"), ["topic_id"], [F.col("doc_id")], "n"
    )
    size = pool.groupBy("topic_id").agg(F.count("*").alias("size"))
    positive = good.join(size, "topic_id")

    def draw(i: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "topic_id", "doc_id", i), F.col("size")) + 1

    drawn = positive.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(negatives)))).select("topic_id", draw(F.col("i")).alias("n"))
    negative = drawn.join(pool, ["topic_id", "n"]).select("topic_id", "doc_id", F.lit(0).alias("label"))
    return positive.select("topic_id", "doc_id", F.lit(1).alias("label")).unionByName(negative)
