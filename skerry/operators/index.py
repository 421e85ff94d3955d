"""Collection statistics: postings, document lengths, frequencies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from .tables import settle


@dataclass(frozen=True)
class Index:
    """``rows(doc_id, dl, counts)`` one row per document (also empty ones) with
    its ``counts`` as ``array<struct<term, tf>>``, ``stats(n_docs, n_tokens,
    avgdl)``."""

    rows: DataFrame
    stats: DataFrame

    @property
    def lengths(self) -> DataFrame:
        """``(doc_id, dl)`` of every document."""
        return self.rows.select("doc_id", "dl")

    def postings(self, terms: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
        """``(doc_id, term, tf, dl)``, of the given terms and documents only if
        there are any. Needs no shuffle: documents come counted."""
        rows = self.rows if docs is None else self.rows.join(docs, "doc_id", "left_semi")
        found = rows.select("doc_id", "dl", F.inline("counts")).select("doc_id", "term", "tf", "dl")
        return found if terms is None else found.join(terms, "term", "left_semi")


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Tokenise and count ``docs`` once into a forward index in the shared folder.

    Lengths and statistics then read one narrow column of it, and queries its
    counts; without it every branch of a plan would tokenise the corpus again.
    """
    words = docs.select(F.col(doc_id).alias("doc_id"), fx.tokenize(F.col(text)).alias("words"))
    counted = words.select("doc_id", F.size("words").alias("dl"), fx.term_counts(F.col("words")).alias("counts"))
    rows = settle(counted)
    stats = rows.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avgdl"),
    )
    return Index(rows, stats)


def term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, term, tf)``."""
    return build_index(docs, doc_id, text).postings().select("doc_id", "term", "tf")


def document_frequency(index: Index, terms: DataFrame | None = None) -> DataFrame:
    """``(term, df)``: documents that hold a term."""
    return index.postings(terms).groupBy("term").agg(F.count("*").alias("df"))


def background(index: Index, terms: DataFrame | None = None) -> DataFrame:
    """``(term, cf, p)``: share of all tokens, of the given terms only if there
    are any. The total is one row, so it is broadcast."""
    counted = index.postings(terms).groupBy("term").agg(F.sum("tf").alias("cf"))
    total = index.stats.select("n_tokens")
    return counted.crossJoin(F.broadcast(total)).select("term", "cf", (F.col("cf") / F.col("n_tokens")).alias("p"))


def query_terms(topics: DataFrame) -> DataFrame:
    """``(topic_id, term, weight)`` with a weight per occurrence."""
    terms = topics.select("topic_id", F.explode(fx.tokenize(F.col("text"))).alias("term"))
    return terms.groupBy("topic_id", "term").agg(F.count("*").cast("double").alias("weight"))


def vocabulary(postings: DataFrame, n_docs: int, min_df: int, max_df: float, top: int | None) -> DataFrame:
    """Terms with min_df <= df <= floor(max_df * n_docs), the ``top`` by (df desc, term)."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    kept = df.where((F.col("df") >= min_df) & (F.col("df") <= F.floor(F.lit(max_df * n_docs))))
    return kept if top is None else kept.orderBy(F.desc("df"), "term").limit(top)


