"""The three end-to-end plans: lexical, clustered passages, dense."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense, features, fuse, ltr, passages, retrieve, vectorize
from ..operators.index import build_index
from ..operators.tables import ranked, settle
from .config import Bm25Config, ClusterConfig, DenseConfig


def lexical(topics: DataFrame, docs: DataFrame, config: Bm25Config | None = None) -> DataFrame:
    c = config or Bm25Config()
    return retrieve.search(topics, build_index(docs), model="bm25", topk=c.topk, k1=c.k1, b=c.b)


@dataclass(frozen=True)
class Clustered:
    """Intermediate tables of the clustered plan."""

    candidates: DataFrame
    ranked: DataFrame
    members: DataFrame


def clustered_tables(topics: DataFrame, docs: DataFrame, config: ClusterConfig | None = None) -> Clustered:
    """Candidates, ranked passages and cluster members.

    Documents are ranked before any text is joined; passages are extracted
    once per candidate document, not per topic. The three tables are bounded
    by topics times a depth and settled, as later steps read them often.
    """
    c = config or ClusterConfig()
    candidates = settle(
        retrieve.search(topics, build_index(docs), model=c.doc_model, topk=c.candidates, k1=c.k1, b=c.b, rm3=c.rm3)
    )
    wanted = candidates.where(F.col("rank") <= c.content_topk)
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    found = passages.extract(texts, c.window, c.least, c.overlap)
    options = {"model": c.passage_model, "topk": c.passages, "k1": c.passage_k1, "b": c.passage_b, "rm3": c.passage_rm3}
    if c.per_doc is None:
        best = settle(passages.rank_candidates(wanted, found, topics, **options))
    else:
        found = passages.best_overlap(passages.of_candidates(wanted, found), topics, c.per_doc)
        best = settle(passages.rank_passages(found, topics, **options))
    return Clustered(candidates, best, settle(cluster_members(best, c.threshold, c.cluster_size)))


def cluster_members(best: DataFrame, threshold: float, size: int) -> DataFrame:
    """``(topic_id, cluster_id, pos, p_rank, doc_id, p_idx, doc_rank, content)``."""
    items = best.select("topic_id", F.col("p_rank").alias("i"), "content")
    pairs = settle(vectorize.cosine_pairs(vectorize.tfidf(items, ["topic_id"]), ["topic_id"]))
    grouped = vectorize.clusters(items, pairs, ["topic_id"], threshold, size).withColumnRenamed("i", "p_rank")
    return grouped.join(
        best.select("topic_id", "p_rank", "doc_id", "p_idx", "doc_rank", "content"), ["topic_id", "p_rank"]
    )


def clustered(
    topics: DataFrame, docs: DataFrame, config: ClusterConfig | None = None, model: ltr.LinearModel | None = None
) -> DataFrame:
    """Documents by cluster evidence: cluster scores lift passages, passages
    lift documents. Without a model the clusters keep their seed scores."""
    c = config or ClusterConfig()
    t = clustered_tables(topics, docs, c)
    if model is None:
        seeds = t.members.select("topic_id", "cluster_id").distinct()
        scores = seeds.select("topic_id", "cluster_id", (1.0 / F.col("cluster_id")).alias("score"))
    else:
        values = features.compute(t.members, model.names)
        scored = model.score(values).withColumnRenamed("score", "svm")
        scores = fuse.blend_clusters(scored, c.alpha, c.normalization)
    lifted = fuse.rerank_passages(t.members, scores)
    capped = fuse.capped_documents(lifted, c.passages_per_doc, c.rr_k)
    fused = fuse.adaptive_fusion(t.candidates, capped, c.passages_per_doc, c.lambda_min, c.lambda_max)
    return fuse.head_tail(fused, c.rerank_topn, c.topk)


def two_stage(
    queries: DataFrame, vectors: DataFrame, docs: DataFrame, config: DenseConfig | None = None, scorer=None
) -> DataFrame:
    """``queries(id, embedding, text)`` against ``vectors(id, embedding)``; the
    best ``rerank_topn`` get a second score, from ``scorer`` or, without one,
    from the token overlap."""
    c = config or DenseConfig()
    depth = max(c.depth, c.topk)
    found = dense.exact_topk(vectors, queries, depth, c.metric)
    found = found.select(F.col("query_id").alias("topic_id"), F.col("vec_id").alias("doc_id"), "score", "rank")
    if not c.rerank or c.rerank_topn <= 0:
        return ranked(found.drop("rank"), ["topic_id"], [F.desc("score"), F.col("doc_id")], top=c.topk)
    head = retrieve.with_text(found, docs, c.rerank_topn)
    asked = head.join(queries.select(F.col("id").alias("topic_id"), F.col("text").alias("query")), "topic_id", "left")
    if scorer is None:
        second = asked.select("topic_id", "doc_id", retrieve.overlap_score().alias("ce"))
    else:
        second = dense.rerank_scores(asked, scorer).select("topic_id", "doc_id", "ce")
    return dense.blend(found, second, c.alpha, c.topk)
