"""Training labels of clusters and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import place, place_again
from .features import CLUSTER

METHODS = {
    "any_relevant_doc": "any",
    "any": "any",
    "binary": "any",
    "top_weighted_density": "density",
    "weighted_density": "density",
    "top_weighted": "density",
    "best_evidence": "best",
    "best": "best",
    "max_evidence": "best",
    "pseudo_passage_overlap": "pseudo",
    "pseudo_overlap": "pseudo",
    "pseudo": "pseudo",
}


def _judged(members: DataFrame, qrels: DataFrame, threshold: int) -> DataFrame:
    good = qrels.where(F.col("rel") >= threshold).select("topic_id", "doc_id").distinct()
    return members.join(good.withColumn("hit", F.lit(True)), ["topic_id", "doc_id"], "left").withColumn(
        "hit", F.coalesce("hit", F.lit(False))
    )


def _grade(value, high, low):
    return F.when(value >= high, 2).when(value >= low, 1).otherwise(0)


def cluster_labels(
    members: DataFrame,
    qrels: DataFrame,
    method: str,
    *,
    threshold: int = 1,
    high: float | None = None,
    low: float | None = None,
    rr_k: int = 100,
    pseudo: DataFrame | None = None,
) -> DataFrame:
    """``(topic_id, cluster_id, label)`` by the named method.

    ``any``: a member's document is relevant. ``density``: relevant share of
    the weights 1 / (rr_k + rank). ``best``: smallest rank of a relevant
    member. ``pseudo``: members in the pseudo-relevant set ``(topic_id,
    p_rank)``. Clusters of topics without judgments are 0.
    """
    kind = METHODS.get(method)
    if kind is None:
        raise ValueError(f"unknown label method {method!r}")
    if kind == "pseudo":
        high, low = 2 if high is None else high, 1 if low is None else low
        marked = members.join(pseudo.withColumn("hit", F.lit(1)), ["topic_id", "p_rank"], "left")
        return marked.groupBy(*CLUSTER).agg(_grade(F.count("hit"), max(high, low), low).alias("label"))
    judged = _judged(members, qrels, threshold)
    if kind == "any":
        return judged.groupBy(*CLUSTER).agg(F.max(F.col("hit").cast("int")).alias("label"))
    if kind == "density":
        low = max(0.0, 0.2 if low is None else low)
        high = max(low, 0.5 if high is None else high)
        weight = 1.0 / (F.lit(rr_k) + F.col("p_rank"))
        density = place(F.sum(F.when(F.col("hit"), weight).otherwise(0.0)) / F.sum(weight))
        graded = judged.groupBy(*CLUSTER).agg(density.alias("d"), F.max("hit").alias("hit"))
        return graded.select(*CLUSTER, F.when(F.col("hit"), _grade(F.col("d"), high, low)).otherwise(0).alias("label"))
    high, low = 20 if high is None else high, 100 if low is None else low
    high = min(high, low)
    rank = F.min(F.when(F.col("hit"), F.col("p_rank")))
    return judged.groupBy(*CLUSTER).agg(F.when(rank <= high, 2).when(rank <= low, 1).otherwise(0).alias("label"))


def pseudo_relevant(ranked_by_doc: DataFrame, qrels: DataFrame, per_doc: int, threshold: int = 1) -> DataFrame:
    """Best ``per_doc`` passages (by ``p_rank`` inside the document) of every relevant document."""
    good = qrels.where(F.col("rel") >= threshold).select("topic_id", "doc_id").distinct()
    return ranked_by_doc.where(F.col("p_rank") <= max(1, per_doc)).join(good, ["topic_id", "doc_id"], "left_semi")


def document_instances(
    candidates: DataFrame, members: DataFrame, features: DataFrame, qrels: DataFrame, how: str = "max", threshold: int = 1
) -> DataFrame:
    """Candidate documents with the features of their clusters aggregated
    (max, sum or mean) and a label; documents without a cluster have zeros."""
    if how not in ("max", "sum", "mean"):
        raise ValueError(f"unknown aggregation {how!r}")
    names = [c for c in features.columns if c not in CLUSTER]
    of = {"max": F.max, "sum": F.sum, "mean": F.avg}[how]
    pairs = members.select(*CLUSTER, "doc_id").distinct().join(features, CLUSTER)
    summed = pairs.groupBy("topic_id", "doc_id").agg(*(place_again(of(n)).alias(n) for n in names))
    out = candidates.select("topic_id", "doc_id").join(summed, ["topic_id", "doc_id"], "left").fillna(0.0, names)
    return _judged(out, qrels, threshold).withColumn("label", F.col("hit").cast("int")).drop("hit")
