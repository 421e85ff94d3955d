"""Document retrieval: model dispatch, top-k, candidate sets and text look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from . import scoring
from .index import Index, query_terms
from .tables import by_score, ranked, settle

MODELS = {
    "bm25": "bm25",
    "bm25+rm3": "bm25+rm3",
    "bm25_rm3": "bm25+rm3",
    "rm3": "bm25+rm3",
    "qld": "qld",
    "ql": "qld",
    "dirichlet": "qld",
    "qld+rm3": "qld+rm3",
    "qld_rm3": "qld+rm3",
    "rm3+qld": "qld+rm3",
    "bm25+qld": "bm25+qld",
}


def search(
    topics: DataFrame,
    index: Index,
    *,
    model: str = "bm25",
    topk: int = 1000,
    k1: float = 0.9,
    b: float = 0.4,
    mu: float = 1000.0,
    alpha: float = 0.5,
    rm3: dict | None = None,
) -> DataFrame:
    """``(topic_id, doc_id, score, rank)`` of the best ``topk`` documents per topic.

    Every call is stateless: feedback applies only if the model names it. A
    blank query has no terms and so no results.
    """
    if topk <= 0:
        raise ValueError("topk must be positive")
    kind = MODELS.get(model.lower())
    if kind is None:
        raise ValueError(f"unknown document model {model!r}")
    terms = settle(query_terms(topics))
    feedback = rm3 or {}
    fb_docs = feedback.get("fb_docs", 10)
    if kind == "bm25+rm3":
        # The first pass has the normalised query, so feedback weights don't depend on its length.
        unit = settle(scoring.unit_terms(terms))
        first = scoring.best_bm25(unit, index, [(k1, b)], max(1, fb_docs))
        terms = settle(scoring.rm3_terms(unit, index, first, **feedback))
    elif kind == "qld+rm3":
        # Log likelihoods are negative: feedback documents are weighted by
        # their likelihood relative to the best one.
        first = scoring.best_qld(terms, index, max(1, fb_docs), mu)
        best = F.max("score").over(Window.partitionBy("topic_id"))
        shifted = first.select("topic_id", "doc_id", F.exp(F.col("score") - best).alias("score"))
        terms = settle(scoring.rm3_terms(terms, index, shifted, **feedback))
    if kind.startswith("bm25") and kind != "bm25+qld":
        found = scoring.best_bm25(terms, index, [(k1, b)], topk)
    else:
        found = scoring.best_qld(terms, index, topk, mu, (alpha, k1, b) if kind == "bm25+qld" else None)
    return found.select("topic_id", "doc_id", "score", "rank")


def split_topics(topics: DataFrame, split: str, train: int = 50) -> DataFrame:
    """First ``train`` topics by id, the others, or all."""
    if split == "all":
        return topics
    if split not in ("train", "test"):
        raise ValueError(f"unknown split {split!r}")
    order = ranked(topics.withColumn("__all", F.lit(0)), ["__all"], [F.col("topic_id")], "__row")
    kept = order.where(F.col("__row") <= train) if split == "train" else order.where(F.col("__row") > train)
    return kept.drop("__all", "__row")


def with_text(hits: DataFrame, docs: DataFrame, topk: int | None = None) -> DataFrame:
    """Hits up to rank ``topk`` with their text; a missing document has ``""``.

    Ranks first, texts last: only the ids of the hits are joined to the corpus.
    """
    kept = hits if topk is None else hits.where(F.col("rank") <= topk)
    kept = settle(kept)
    texts = docs.select("doc_id", "text").join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    return kept.join(texts, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def augment(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Hits plus the judged documents they lack, behind them by document id,
    with a null score."""
    missing = qrels.select("topic_id", "doc_id").distinct().join(hits, ["topic_id", "doc_id"], "left_anti")
    last = hits.groupBy("topic_id").agg(F.max("rank").alias("last"))
    added = ranked(missing, ["topic_id"], [F.col("doc_id")], "at").join(last, "topic_id", "left")
    added = added.select(
        "topic_id",
        "doc_id",
        F.lit(None).cast("double").alias("score"),
        (F.coalesce("last", F.lit(0)) + F.col("at")).alias("rank"),
    )
    return hits.select("topic_id", "doc_id", "score", "rank").unionByName(added)


def judged_docs(qrels: DataFrame, docs: DataFrame, topk: int | None = None) -> DataFrame:
    """Judged documents per topic by id, at most ``topk``, with their text."""
    rows = ranked(qrels.select("topic_id", "doc_id").distinct(), ["topic_id"], [F.col("doc_id")], top=topk)
    return with_text(rows, docs)


def negative_pool(hits: DataFrame, qrels: DataFrame, threshold: int = 1) -> DataFrame:
    """Hits that aren't judged relevant."""
    good = qrels.where(F.col("rel") >= threshold).select("topic_id", "doc_id")
    return hits.join(good, ["topic_id", "doc_id"], "left_anti")


def overlap_score(query: str = "query", text: str = "text"):
    """Deterministic stand-in for a cross-encoder: share of distinct query
    tokens that occur in the text; a blank query scores 0."""
    q = F.array_distinct(fx.tokenize(F.col(query)))
    t = F.array_distinct(fx.tokenize(F.col(text)))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))
