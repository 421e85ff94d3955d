"""Fusion of cluster, passage and document evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import adaptive_lambda, clamp01, normalize, place
from .tables import by_score, ranked


def blend_clusters(scores: DataFrame, alpha: float, mode: str) -> DataFrame:
    """``alpha * norm(svm) + (1 - alpha) * norm(seed)`` per topic; a cluster
    without a learned score counts 0 there, its seed score is 1 / cluster_id."""
    alpha = clamp01(alpha)
    seeded = scores.withColumns({"svm": F.coalesce("svm", F.lit(0.0)), "seed": 1.0 / F.col("cluster_id")})
    svm, seed = normalize(F.col("svm"), mode, ["topic_id"]), normalize(F.col("seed"), mode, ["topic_id"])
    return seeded.select("topic_id", "cluster_id", place(svm * alpha + seed * (1.0 - alpha)).alias("score"))


def rerank_passages(members: DataFrame, cluster_scores: DataFrame) -> DataFrame:
    """``(topic_id, doc_id, p_idx, score, p_rank, new_rank)``: the best score of
    a passage's clusters; ties keep the original rank."""
    best = (
        members.join(cluster_scores, ["topic_id", "cluster_id"])
        .groupBy("topic_id", "doc_id", "p_idx")
        .agg(F.max("score").alias("score"), F.min("p_rank").alias("p_rank"))
    )
    return ranked(best, ["topic_id"], by_score("p_rank"), "new_rank")


def rrf_documents(passages: DataFrame, k: int = 60, depth: int | None = None, rank: str = "new_rank") -> DataFrame:
    """Sum of ``1 / (k + rank)`` over a document's passages up to ``depth``."""
    kept = passages if depth is None else passages.where(F.col(rank) <= depth)
    total = F.sum(1.0 / (F.lit(k) + F.col(rank)))
    return kept.groupBy("topic_id", "doc_id").agg(place(total).alias("score"))


def capped_documents(passages: DataFrame, most: int, rr_k: int = 100, rank: str = "new_rank") -> DataFrame:
    """As above over the first ``most`` passages per document, with their number."""
    first = ranked(passages, ["topic_id", "doc_id"], [F.col(rank)], "n", most)
    total = F.sum(1.0 / (F.lit(rr_k) + F.col(rank)))
    return first.groupBy("topic_id", "doc_id").agg(total.alias("passage_score"), F.count("*").alias("used"))


def adaptive_fusion(candidates: DataFrame, capped: DataFrame, most: int, low: float, high: float) -> DataFrame:
    """``lambda * passage score + (1 - lambda) / rank`` for every candidate;
    lambda grows with the share of passages used."""
    joined = candidates.join(capped, ["topic_id", "doc_id"], "left")
    used = F.coalesce("used", F.lit(0))
    lam = adaptive_lambda(used, most, low, high)
    fused = lam * F.coalesce("passage_score", F.lit(0.0)) + (1.0 - lam) / F.col("rank")
    return joined.select("topic_id", "doc_id", "rank", place(fused).alias("score"))


def head_tail(fused: DataFrame, topn: int, topk: int) -> DataFrame:
    """The first ``topn`` by base rank are reordered by fused score, the rest
    keep their order and score 1 / rank; cut at ``topk``."""
    tail = F.col("rank") > topn
    scored = fused.select(
        "topic_id", "doc_id", "rank", F.when(tail, place(1.0 / F.col("rank"))).otherwise(F.col("score")).alias("score"),
        tail.cast("int").alias("tail"),
    )
    order = [F.col("tail"), F.when(F.col("tail") == 0, -F.col("score")), F.col("rank")]
    return ranked(scored, ["topic_id"], order, "new_rank", topk).drop("tail")
