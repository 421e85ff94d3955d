"""Cluster features, by name.

Inputs are ``members(topic_id, cluster_id, pos, p_rank, doc_id, doc_rank,
content)``; every feature is a function from members to ``(topic_id,
cluster_id, value)``. Features are computed for all clusters in one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.scores import place, reciprocal
from . import vectorize

CLUSTER = ["topic_id", "cluster_id"]

# The stop words that two features leave out or count.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they "
    "this to was will with"
).split()

Feature = Callable[[DataFrame], DataFrame]
def _value(members: DataFrame, value) -> DataFrame:
    return members.groupBy(*CLUSTER).agg(value.alias("value"))


def passage_rank(members: DataFrame) -> DataFrame:
    return _value(members, F.max(reciprocal(F.col("p_rank"))))


def document_rank(members: DataFrame) -> DataFrame:
    return _value(members, F.max(reciprocal(F.col("doc_rank"))))


def term_entropy(members: DataFrame) -> DataFrame:
    """Natural-log entropy of the tokens that aren't stop words."""
    terms = members.select(*CLUSTER, F.explode(fx.tokenize(F.col("content"))).alias("term"))
    counted = terms.where(~F.col("term").isin(STOPWORDS)).groupBy(*CLUSTER, "term").agg(F.count("*").alias("c"))
    total = counted.groupBy(*CLUSTER).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.ln(F.col("c"))).alias("clogc")
    )
    entropy = total.select(*CLUSTER, (F.ln("n") - F.col("clogc") / F.col("n")).alias("value"))
    return members.select(*CLUSTER).distinct().join(entropy, CLUSTER, "left").fillna(0.0, ["value"])


def stopword_ratio(members: DataFrame) -> DataFrame:
    words = members.select(*CLUSTER, fx.tokenize(F.col("content")).alias("words"))
    stop = F.size(F.filter("words", lambda w: w.isin(STOPWORDS)))
    return _value(words, F.coalesce(F.sum(stop) / F.nullif(F.sum(F.size("words")), F.lit(0)), F.lit(0.0)))


def intra_similarity(members: DataFrame, max_pairs: int = 2000) -> DataFrame:
    """Mean cosine of the first ``max_pairs`` pairs in member order; vectors
    are fitted on the cluster alone."""
    items = members.select(*CLUSTER, F.col("pos").alias("i"), "content")
    found = vectorize.raw_cosine_pairs(vectorize.tfidf(items, CLUSTER), CLUSTER)
    size = members.groupBy(*CLUSTER).agg(F.count("*").alias("n"))
    # Pair (a, b) has this number in the order of a nested loop over members.
    number = F.col("a") * (F.col("n") - 1) - F.col("a") * (F.col("a") - 1) / 2 + (F.col("b") - F.col("a") - 1)
    used = found.join(size, CLUSTER).where(number < max_pairs).groupBy(*CLUSTER).agg(F.sum("sim").alias("total"))
    pairs = F.least(F.col("n") * (F.col("n") - 1) / 2, F.lit(float(max_pairs)))
    mean = F.coalesce(F.col("total") / F.nullif(pairs, F.lit(0.0)), F.lit(0.0))
    return size.join(used, CLUSTER, "left").select(*CLUSTER, mean.alias("value"))


def unique_docs(members: DataFrame) -> DataFrame:
    return _value(members, F.count_distinct("doc_id").cast("double"))


#: Name in learning files and models -> feature.
FEATURES: dict[str, Feature] = {
    "prior_intra_similarity_mean": intra_similarity,
    "prior_stopword_ratio": stopword_ratio,
    "prior_term_entropy": term_entropy,
    "prior_unique_docs": unique_docs,
    "qdep_rr_cluster_docs_max": document_rank,
    "qdep_rr_cluster_passages_max": passage_rank,
}


def compute(members: DataFrame, names: Iterable[str] | None = None, max_pairs: int = 2000) -> DataFrame:
    """One column per feature, to six places; unknown names are errors.
    ``max_pairs`` goes to :func:`intra_similarity`."""
    names = sorted(FEATURES) if names is None else list(names)
    unknown = [n for n in names if n not in FEATURES]
    if unknown:
        raise ValueError(f"unknown features {unknown}")
    out = members.select(*CLUSTER).distinct()
    for name in names:
        options = {"max_pairs": max_pairs} if FEATURES[name] is intra_similarity else {}
        values = FEATURES[name](members, **options).select(*CLUSTER, place(F.col("value")).alias(name))
        out = out.join(values, CLUSTER, "left")
    return out.fillna(0.0, list(names))
