"""Sparse passage vectors, pair similarities and overlapping clusters.

Rows are keyed by ``group`` columns (a topic, or a topic and a cluster) and an
item ``i``; vectors are long: ``(*group, i, term, w)``. Pairs come from a join
on (group, term), so only items that share a term meet, and the number of
items per group is bounded by the passage depth. Groups that are rows (a
document's passages) have :func:`row_similarities`, without such a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.scores import place
from ..functions.vectors import jaccard
from . import pairs as in_rows
from .tables import ranked

VECTORIZERS = {
    "tfidf": "tfidf",
    "lm": "lm",
    "unigram_lm": "lm",
    "unigram": "lm",
    "jaccard": "set",
    "token_set": "set",
}
SIMILARITIES = {
    "cosine": "cosine",
    "dot": "dot",
    "jaccard": "jaccard",
    "kl": "kl",
    "kl_divergence": "kl",
    "kld": "kl",
}


def tfidf(
    items: DataFrame,
    group: list[str],
    *,
    low: int = 1,
    high: int = 1,
    min_df: int = 1,
    max_df: float = 1.0,
    max_features: int | None = None,
) -> DataFrame:
    """Counts times ``ln((N + 1) / (df + 1)) + 1`` of n-grams, fitted per group,
    without length normalisation. ``items`` is ``(*group, i, content)``."""
    if min_df < 1 or not 0 < max_df <= 1 or (max_features is not None and max_features <= 0):
        raise ValueError("need min_df >= 1, 0 < max_df <= 1 and a positive max_features")
    n = items.groupBy(*group).agg(F.count("*").alias("n"))
    grams = items.select(*group, "i", fx.ngrams(fx.tokenize(F.col("content")), low, high).alias("grams"))
    tf = grams.select(*group, "i", F.inline(fx.term_counts(F.col("grams"))))
    # A group has a bounded number of items, and so has the window of a term.
    df = F.count("*").over(Window.partitionBy(*group, "term"))
    counted = tf.withColumn("df", df).join(n, group)
    counted = counted.where((F.col("df") >= min_df) & (F.col("df") <= F.floor(F.lit(max_df) * F.col("n"))))
    if max_features is not None:
        kept = counted.select(*group, "term", "df").distinct()
        kept = ranked(kept, group, [F.desc("df"), F.col("term")], "r", max_features)
        counted = counted.join(kept.select(*group, "term"), [*group, "term"], "left_semi")
    weight = F.col("tf") * (F.ln((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0)
    return counted.select(*group, "i", "term", weight.alias("w"))


def unigram_lm(items: DataFrame, group: list[str]) -> DataFrame:
    """Share of an item's tokens per term."""
    words = items.select(*group, "i", fx.tokenize(F.col("content")).alias("words"))
    counted = words.select(*group, "i", F.size("words").alias("dl"), F.inline(fx.term_counts(F.col("words"))))
    return counted.select(*group, "i", "term", (F.col("tf") / F.col("dl")).alias("w"))


def _joined(vectors: DataFrame, group: list[str]) -> DataFrame:
    """Sums of products of pairs a < b. Both sides are the same shuffle, reused."""
    a = vectors.select(*group, "term", F.col("i").alias("a"), F.col("w").alias("wa"))
    b = vectors.select(*group, "term", F.col("i").alias("b"), F.col("w").alias("wb"))
    return a.join(b, [*group, "term"]).where("a < b").groupBy(*group, "a", "b").agg(
        F.sum(F.col("wa") * F.col("wb")).alias("sim")
    )


def dot_pairs(vectors: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, a, b, sim)`` of pairs a < b that share a term."""
    return _joined(vectors, group).withColumn("sim", place(F.col("sim")))


def cosine_pairs(vectors: DataFrame, group: list[str]) -> DataFrame:
    """Pairs a < b that share a term, with their cosine; others have cosine 0."""
    return raw_cosine_pairs(vectors, group).withColumn("sim", place(F.col("sim")))


def raw_cosine_pairs(vectors: DataFrame, group: list[str]) -> DataFrame:
    """As :func:`cosine_pairs`, before rounding."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*group, "i")))
    return _joined(vectors.withColumn("w", F.coalesce(F.col("w") / F.nullif(norm, F.lit(0.0)), F.lit(0.0))), group)


def array_pairs(items: DataFrame, group: list[str], value: Column, similarity) -> DataFrame:
    """All pairs a < b of a group, for similarities that pairs without a common
    term need too. A group has at most the passage depth of items."""
    valued = items.select(*group, "i", value.alias("v"))
    a = valued.select(*group, F.col("i").alias("a"), F.col("v").alias("va"))
    b = valued.select(*group, F.col("i").alias("b"), F.col("v").alias("vb"))
    pairs = a.join(b, group).where("a < b")
    return pairs.select(*group, "a", "b", place(similarity(F.col("va"), F.col("vb"))).alias("sim"))


def jaccard_pairs(items: DataFrame, group: list[str]) -> DataFrame:
    return array_pairs(items, group, F.array_distinct(fx.tokenize(F.col("content"))), jaccard)


def kl_pairs(items: DataFrame, group: list[str], smooth: float = 1e-9) -> DataFrame:
    """Smoothed Kullback-Leibler similarity of unigram models, for all pairs
    a < b of a group: exp of minus half the symmetric divergence.

    With ``l(w) = ln(w + smooth) - ln(smooth)`` the symmetric divergence of two
    models is a sum over the terms of each, less a correction over the terms
    that they share. So only shared terms are joined, and the rest is one
    number per item; no model is built as a map.
    """
    lm = unigram_lm(items, group).withColumn("l", F.log(F.col("w") + smooth) - F.log(F.lit(smooth)))
    own = lm.groupBy(*group, "i").agg(
        F.count("*").alias("n"),
        F.sum(F.col("w") * F.col("l")).alias("wl"),
        F.sum("l").alias("ls"),
    )
    full = items.select(*group, "i").join(own, [*group, "i"], "left").na.fill(0, ["n", "wl", "ls"])

    def side(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.select(*group, F.col("i").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    keys = [*group, "a", "b"]
    left, right = (side(lm, name, "term", "w", "l").withColumnRenamed(f"term_{name}", "term") for name in "ab")
    # (p - q)(l(p) - l(q)) - p l(p) - q l(q)
    crossed = -(F.col("w_a") * F.col("l_b") + F.col("w_b") * F.col("l_a"))
    shared = left.join(right, [*group, "term"]).where("a < b").groupBy(*keys).agg(
        F.sum(crossed).alias("crossed"), F.count("*").alias("both")
    )
    pairs = side(full, "a", "n", "wl", "ls").join(side(full, "b", "n", "wl", "ls"), group).where("a < b")
    pairs = pairs.join(shared, keys, "left").na.fill(0, ["crossed", "both"])
    terms = F.col("n_a") + F.col("n_b") - F.col("both")
    scale = 1.0 + terms * smooth
    usual = (F.col("wl_a") + F.col("wl_b") + F.col("crossed")) / scale
    # One model empty: it is uniform over the other's terms.
    wl, ls = F.col("wl_a") + F.col("wl_b"), F.col("ls_a") + F.col("ls_b")
    lone = (wl + ls * smooth) / scale - ls / terms
    divergence = F.when(terms == 0, F.lit(None)).when((F.col("n_a") == 0) | (F.col("n_b") == 0), lone).otherwise(usual)
    similarity = F.when(divergence.isNull(), 0.0).otherwise(F.exp(-0.5 * F.greatest(divergence, F.lit(0.0))))
    return pairs.select(*keys, place(similarity).alias("sim"))


def pair_similarities(items: DataFrame, group: list[str], vectorizer: str, similarity: str, **options) -> DataFrame:
    """Dispatch by name; combinations that make no sense are errors."""
    kind, measure = VECTORIZERS.get(vectorizer), SIMILARITIES.get(similarity)
    if kind is None:
        if vectorizer in ("embeddings", "custom"):
            raise NotImplementedError(f"vectorizer {vectorizer!r}")
        raise ValueError(f"unknown vectorizer {vectorizer!r}")
    if measure is None:
        raise ValueError(f"unknown similarity {similarity!r}")
    if (kind == "set") != (measure == "jaccard"):
        raise TypeError(f"{similarity!r} doesn't fit {vectorizer!r} vectors")
    if measure == "jaccard":
        return jaccard_pairs(items, group)
    if measure == "kl":
        if kind != "lm":
            raise TypeError("kl needs unigram models")
        return kl_pairs(items, group)
    vectors = tfidf(items, group, **options) if kind == "tfidf" else unigram_lm(items, group)
    return cosine_pairs(vectors, group) if measure == "cosine" else dot_pairs(vectors, group)


def row_similarities(rows: DataFrame, key: str, vectorizer: str, similarity: str) -> DataFrame:
    """As :func:`pair_similarities` for groups that are rows ``(key, items)``,
    see :mod:`.pairs`: no shuffle, and no limit on the number of items."""
    kind, measure = VECTORIZERS.get(vectorizer), SIMILARITIES.get(similarity)
    if kind is None or measure is None:
        raise ValueError(f"unknown vectorizer {vectorizer!r} or similarity {similarity!r}")
    if (kind == "set") != (measure == "jaccard") or measure == "kl":
        raise TypeError(f"{similarity!r} doesn't fit {vectorizer!r} vectors of rows")
    return in_rows.pair_similarities(rows, key, kind, measure)


def edges(pairs: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Pairs from ``threshold`` on, with their order in the group."""
    if not -1 <= threshold <= 1:
        raise ValueError("the threshold must lie in [-1, 1]")
    kept = pairs.where(F.col("sim") >= threshold)
    return ranked(kept, group, [F.desc("sim"), F.col("a"), F.col("b")], "n")


def zero_pairs(items: DataFrame, pairs: DataFrame, group: list[str]) -> DataFrame:
    """``pairs`` with the pairs of similarity 0 that share no term."""
    a = items.select(*group, F.col("i").alias("a"))
    b = items.select(*group, F.col("i").alias("b"))
    every = a.join(b, group).where("a < b").join(pairs, [*group, "a", "b"], "left")
    return every.select(*group, "a", "b", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def clusters(
    items: DataFrame, pairs: DataFrame, group: list[str], threshold: float, size: int, algorithm: str = "graph_threshold"
) -> DataFrame:
    """``(*group, cluster_id, pos, i)``: one cluster per item, the item first
    (pos 0), then up to ``size - 1`` neighbours by similarity, then by number."""
    if algorithm in ("kmeans", "agglomerative", "dbscan"):
        raise NotImplementedError(algorithm)
    if algorithm != "graph_threshold":
        raise ValueError(f"unknown clustering {algorithm!r}")
    if size <= 0:
        raise ValueError("a cluster has at least one member")
    if threshold <= 0:
        pairs = zero_pairs(items, pairs, group)
    kept = pairs.where(F.col("sim") >= threshold)
    both = kept.select(*group, F.col("a").alias("cluster_id"), F.col("b").alias("i"), "sim").unionByName(
        kept.select(*group, F.col("b").alias("cluster_id"), F.col("a").alias("i"), "sim")
    )
    near = ranked(both, [*group, "cluster_id"], [F.desc("sim"), F.col("i")], "pos", size - 1)
    seeds = items.select(*group, F.col("i").alias("cluster_id"), F.lit(0).alias("pos"), "i")
    return seeds.unionByName(near.select(*group, "cluster_id", "pos", "i"))
