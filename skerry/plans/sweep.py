"""Sweep of the dense plan's settings, and cross-validated learning to rank."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clamp01, place, place_again
from ..operators import dense, evaluate, ltr, retrieve
from ..operators.tables import by_score, ranked, settle

SETTINGS = ("depth", "metric", "rerank", "rerank_topn", "alpha")


def dense_runs(
    queries: DataFrame,
    vectors: DataFrame,
    docs: DataFrame,
    *,
    depths: Iterable[int] = (2000,),
    metrics: Iterable[str] = ("cosine",),
    reranks: Iterable[bool] = (False,),
    topns: Iterable[int] = (100,),
    alphas: Iterable[float] = (1.0,),
    topk: int = 1000,
    scorer=None,
) -> DataFrame:
    """Runs ``(*SETTINGS, topic_id, doc_id, score, rank)`` of all combinations.

    The vectors are searched once per metric, at the greatest depth, and the
    second scores are computed once per candidate; depths, cut-offs and
    weights only reweigh those rows. A depth below ``topk`` counts as ``topk``.
    """
    depths, topns = list(depths), list(topns)
    deepest, most = max(max(depths), topk), max(topns)
    settings = list(product(depths, reranks, topns, alphas))
    rows = []
    for metric in metrics:
        found = dense.exact_topk(vectors, queries, deepest, metric)
        found = settle(found.select(F.col("query_id").alias("topic_id"), F.col("vec_id").alias("doc_id"), "score", "rank"))
        second = _second_scores(found, queries, docs, most, scorer)
        rows.append(found.join(second, ["topic_id", "doc_id"], "left").withColumn("metric", F.lit(metric)))
    each = F.array(
        *(
            F.struct(
                F.lit(d).alias("depth"), F.lit(r).alias("rerank"), F.lit(n).alias("rerank_topn"), F.lit(float(a)).alias("alpha"),
                F.lit(max(d, topk)).alias("seen"), F.lit(clamp01(a)).alias("share"),
            )
            for d, r, n, a in settings
        )
    )
    every = reduce(DataFrame.unionByName, rows).withColumn("s", F.explode(each)).where(F.col("rank") <= F.col("s.seen"))
    mixed = F.col("ce") * F.col("s.share") + F.col("score") * (1.0 - F.col("s.share"))
    lifted = F.col("s.rerank") & (F.col("rank") <= F.col("s.rerank_topn")) & F.col("ce").isNotNull()
    scored = every.select(
        "s.depth", "metric", "s.rerank", "s.rerank_topn", "s.alpha", "topic_id", "doc_id",
        place_again(F.when(lifted, mixed).otherwise(F.col("score"))).alias("score"),
    )
    return ranked(scored, [*SETTINGS, "topic_id"], by_score("doc_id"), top=topk)


def _second_scores(found: DataFrame, queries: DataFrame, docs: DataFrame, topn: int, scorer) -> DataFrame:
    """``(topic_id, doc_id, ce)`` of the first ``topn`` candidates."""
    head = retrieve.with_text(found, docs, topn)
    asked = head.join(queries.select(F.col("id").alias("topic_id"), F.col("text").alias("query")), "topic_id", "left")
    if scorer is None:
        return asked.select("topic_id", "doc_id", retrieve.overlap_score().alias("ce"))
    return dense.rerank_scores(asked, scorer).select("topic_id", "doc_id", "ce")


def dense_sweep(
    queries: DataFrame, vectors: DataFrame, docs: DataFrame, qrels: DataFrame, *, topk: int = 1000, **grid
) -> DataFrame:
    """``(*SETTINGS, map)`` of all combinations; order with ``best_settings``."""
    runs = dense_runs(queries, vectors, docs, topk=topk, **grid)
    return evaluate.mean_average_precision(settle(runs), qrels, topk, list(SETTINGS))


def cross_validate(
    instances: DataFrame, names: list[str], folds: int = 5, seed: int = 42, backend: str = "svm_rank", **options
) -> DataFrame:
    """``(fold, topics, pairs, swapped, fraction)``: each fold's topics are
    scored by a model of the other topics, and swapped preferences counted."""
    parts = settle(instances.join(evaluate.topic_folds(instances.select("topic_id").distinct(), folds, seed), "topic_id"))
    tested = []
    for fold in range(folds):
        model = ltr.train(parts.where(F.col("fold") != fold), names, backend, **options)
        scored = model.score(parts.where(F.col("fold") == fold)).select("topic_id", "label", "score")
        tested.append(ltr.swapped_pairs(scored).withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, tested).groupBy("fold").agg(
        F.count("*").alias("topics"),
        F.sum("pairs").alias("pairs"),
        F.sum("swapped").alias("swapped"),
        place(F.coalesce(F.sum("swapped") / F.nullif(F.sum("pairs"), F.lit(0)), F.lit(0.0))).alias("fraction"),
    )
