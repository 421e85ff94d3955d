"""Passages: extraction, per-document prefilters and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.scores import place
from . import best, scoring
from .index import query_terms
from .tables import by_score, ranked, settle


def extract(docs: DataFrame, size: int = 10, least: int = 3, overlap: int = 2) -> DataFrame:
    """``(doc_id, p_idx, content)``; a document shorter than ``least`` sentences has none."""
    found = F.posexplode(F.col("contents")).alias("p_idx", "content")
    return contents(docs, size, least, overlap).select("doc_id", found)


def contents(docs: DataFrame, size: int = 10, least: int = 3, overlap: int = 2) -> DataFrame:
    """``(doc_id, contents)``: all passages of a document in its row."""
    sents = docs.where(F.length("text") > 0).select("doc_id", fx.sentences(F.col("text")).alias("s"))
    found = fx.bound(F.col("s"), lambda s: fx.passage_windows(s, size, least, overlap))
    return sents.where(F.size("s") > 0).select("doc_id", found.alias("contents"))


def items(contents: DataFrame) -> DataFrame:
    """``(doc_id, items)``: the tokens of each passage, ``array<struct<i, words>>``."""
    each = F.transform("contents", lambda c, i: F.struct(i.alias("i"), fx.tokenize(c).alias("words")))
    return contents.select("doc_id", each.alias("items"))


def of_candidates(candidates: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages of each topic's candidate documents: extracted once per
    document, then joined to the topics that retrieved it."""
    hits = candidates.select("topic_id", "doc_id", F.col("rank").alias("doc_rank"))
    return passages.join(hits, "doc_id")


def first_k(passages: DataFrame, k: int) -> DataFrame:
    """The first ``k`` passages of every (topic, document)."""
    return ranked(passages, ["topic_id", "doc_id"], [F.col("p_idx")], "n", k).drop("n")


def best_overlap(passages: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """The ``k`` passages of every (topic, document) with most occurrences of
    query terms (``overlap``); ties go to the earlier passage."""
    wanted = topics.select("topic_id", F.array_distinct(fx.tokenize(F.col("text"))).alias("wanted"))
    counted = passages.join(wanted, "topic_id").withColumn(
        "overlap", fx.overlap_count(fx.tokenize(F.col("content")), F.col("wanted"))
    )
    return ranked(counted, ["topic_id", "doc_id"], [F.desc("overlap"), F.col("p_idx")], "n", k).drop("n", "wanted")


MODELS = {
    "bm25": "bm25",
    "qld": "qld",
    "ql": "qld",
    "dirichlet": "qld",
    "bm25+qld": "bm25+qld",
    "bm25+rm3": "bm25+rm3",
    "bm25_rm3": "bm25+rm3",
    "rm3": "bm25+rm3",
}

#: Feedback of the passage model: terms, passages, weight of the original query.
RM3 = {"fb_terms": 50, "fb_docs": 10, "original_weight": 0.2}


def unit_terms(topics: DataFrame) -> DataFrame:
    """``(topic_id, term, weight)`` with weights that sum to one per topic."""
    terms = settle(query_terms(topics))
    length = terms.groupBy("topic_id").agg(F.sum("weight").alias("length"))
    unit = terms.join(length, "topic_id").select("topic_id", "term", (F.col("weight") / F.col("length")).alias("weight"))
    return settle(unit)


def feedback_terms(
    first: DataFrame, original: DataFrame, by: list[str], fb_terms: int, fb_docs: int, original_weight: float
) -> DataFrame:
    """Expanded query ``(*by, term, weight)`` of every group of ``first``, a
    ranking with ``content``, ``score`` and ``p_rank``.

    The terms of the best ``fb_docs`` passages are weighted by
    ``score * tf / length``; the best ``fb_terms`` are normalised and mixed
    with ``original``, whose weights sum to one.
    """
    scoring.check_rm3(fb_terms, fb_docs, original_weight)
    words = first.where(F.col("p_rank") <= fb_docs).select(*by, "score", fx.tokenize(F.col("content")).alias("words"))
    counted = words.select(*by, "score", F.size("words").alias("dl"), F.inline(fx.term_counts(F.col("words"))))
    share = F.sum(F.col("score") * F.col("tf") / F.col("dl"))
    model = counted.groupBy(*by, "term").agg(place(share).alias("score"))
    best = settle(ranked(model, by, by_score("term"), top=fb_terms))
    total = best.groupBy(*by).agg(F.sum("score").alias("total")).where("total > 0")
    extra = best.join(total, by).select(*by, "term", (F.col("score") / F.col("total")).alias("e"))
    asked = first.select(*by).distinct().join(original.withColumnRenamed("weight", "o"), "topic_id")
    mixed = F.coalesce("o", F.lit(0.0)) * original_weight + F.coalesce("e", F.lit(0.0)) * (1.0 - original_weight)
    both = asked.join(extra, [*by, "term"], "full_outer")
    return both.select(*by, "term", mixed.alias("weight")).where("weight > 0")


def rank_passages(
    passages: DataFrame,
    topics: DataFrame,
    *,
    model: str = "bm25",
    topk: int = 200,
    stats_by: list[str] | None = None,
    matching_only: bool = True,
    k1: float = 0.9,
    b: float = 0.4,
    mu: float = 1000.0,
    alpha: float = 0.5,
    rm3: dict | None = None,
    terms: DataFrame | None = None,
) -> DataFrame:
    """Best passages per statistics group, with ``score`` and ``p_rank``.

    All statistics (df, background model, mean length) are those of the group
    ``stats_by`` (the topic; or topic and document, to rank a document's own
    passages), taken over its scored passages only. ``matching_only`` leaves
    out passages without a query term, as an index engine does.

    ``bm25+rm3`` ranks twice: the best passages of each group expand its query
    (options ``rm3``, see :func:`feedback_terms`). ``terms`` are weighted query
    terms per group, in place of the topics' own.
    """
    kind = MODELS.get(model.lower())
    if kind is None:
        raise ValueError(f"unknown passage model {model!r}")
    scoring.check_bm25(k1, b)
    scoring.check_mu(mu)
    by = stats_by or ["topic_id"]
    key = ["topic_id", "doc_id", "p_idx"]
    if kind == "bm25+rm3":
        feedback = {**RM3, **(rm3 or {})}
        original = unit_terms(topics)
        again = {"stats_by": by, "matching_only": matching_only, "k1": k1, "b": b}
        first = rank_passages(passages, topics, topk=feedback["fb_docs"], terms=original, **again)
        expanded = settle(feedback_terms(first, original, by, **feedback))
        return rank_passages(passages, topics, topk=topk, terms=expanded, **again)
    words = passages.withColumn("words", fx.tokenize(F.col("content"))).withColumn("dl", F.size("words"))
    terms = settle(query_terms(topics)) if terms is None else terms
    on = [c for c in terms.columns if c in key]
    stats = words.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("total")
    )
    hits = (
        words.select(*key, "dl", F.explode("words").alias("term"))
        .join(terms, [*on, "term"])
        .groupBy(*key, "term", "weight", "dl")
        .agg(F.count("*").alias("tf"))
    )
    frequency = hits.groupBy(*by, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    parts = hits.join(frequency, [*by, "term"]).join(stats, by)
    p = F.col("cf") / F.col("total")
    lexical = F.sum(
        F.col("weight")
        * scoring.bm25_part(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"), F.lit(k1), F.lit(b))
    )
    gain = F.sum(F.col("weight") * F.ln(1.0 + F.col("tf") / (mu * p)))
    summed = parts.groupBy(*key).agg(lexical.alias("bm25"), gain.alias("gain"))
    # Terms that no passage of the group holds still lower the likelihood.
    groups = stats.select(*by, "total").join(terms, on)
    seen = groups.join(frequency.select(*by, "term", "cf"), [*by, "term"], "left")
    floor = F.when(F.coalesce("cf", F.lit(0)) > 0, p).otherwise(F.lit(scoring.UNSEEN))
    rest = seen.groupBy(*by).agg(
        F.sum(F.col("weight") * F.ln(mu * floor)).alias("rest"), F.sum("weight").alias("weights")
    )
    scored = words.drop("words").join(summed, key, "inner" if matching_only else "left").join(rest, by, "left")
    bm25 = F.coalesce("bm25", F.lit(0.0))
    qld = F.when(F.col("dl") <= 0, 0.0).otherwise(
        F.coalesce("gain", F.lit(0.0)) + F.col("rest") - F.col("weights") * F.ln(F.col("dl") + mu)
    )
    score = {"bm25": bm25, "qld": qld, "bm25+qld": bm25 * alpha + qld * (1.0 - alpha)}[kind]
    out = scored.withColumn("score", place(F.coalesce(score, F.lit(0.0)))).drop(
        "bm25", "gain", "rest", "weights", "dl"
    )
    return ranked(out, by, by_score("doc_id", "p_idx"), "p_rank", topk)


def rank_candidates(
    candidates: DataFrame,
    passages: DataFrame,
    topics: DataFrame,
    *,
    model: str = "bm25",
    topk: int = 200,
    k1: float = 0.9,
    b: float = 0.4,
    rm3: dict | None = None,
) -> DataFrame:
    """:func:`rank_passages` over the passages ``(doc_id, p_idx, content)`` of
    each topic's ``candidates``.

    BM25, with or without feedback, tokenises a passage once instead of once
    per topic that retrieved its document, and ranks it where its row is (see
    :mod:`.best`); contents join the ranked passages alone. Other models rank all contents of a topic.
    """
    kind = MODELS.get(model.lower())
    if kind not in ("bm25", "bm25+rm3"):
        return rank_passages(of_candidates(candidates, passages), topics, model=model, topk=topk, k1=k1, b=b)
    scoring.check_bm25(k1, b)
    by, key = ["topic_id"], ["doc_id", "p_idx"]
    asked = candidates.select("topic_id", "doc_id", F.col("rank").alias("doc_rank"))
    asking = asked.groupBy("doc_id").agg(F.collect_list("topic_id").alias("asking"))
    words = passages.join(asking, "doc_id").withColumn("words", fx.tokenize(F.col("content")))
    counted = words.withColumn("dl", F.size("words")).withColumn("counts", fx.term_counts(F.col("words")))
    counted = settle(counted.drop("words"))
    sizes = counted.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("dl").alias("total"))
    stats = asked.join(sizes, "doc_id").groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    stats = {r["topic_id"]: (r["n"], r["total"] / r["n"]) for r in stats.collect()}  # a row per topic

    def ranking(terms: DataFrame, top: int) -> DataFrame:
        import numpy as np

        rows = [r for r in terms.collect() if r["topic_id"] in stats]  # topics x terms
        frequency = best.hit_counts(counted, best.Terms(rows)) if rows else {}
        df = np.array([frequency.get((r["topic_id"], r["term"]), 0) for r in rows], float)
        n, avgdl = (np.array([stats[r["topic_id"]][k] for r in rows], float) for k in (0, 1))
        gain = np.array([r["weight"] for r in rows], float) * np.log((n - df + 0.5) / (df + 0.5) + 1.0)
        query = best.Terms(rows, gain=gain, avgdl=avgdl)
        found = best.best_rows(counted, key, terms, query, best.bm25_parts([(k1, b)]), best.sums_only, top)
        found = settle(found.select("topic_id", *key, "score", F.col("rank").alias("p_rank")))
        return found.join(counted.select("doc_id", "p_idx", "content"), key).join(asked, ["topic_id", "doc_id"])

    if kind == "bm25":
        return ranking(settle(query_terms(topics)), topk)
    feedback = {**RM3, **(rm3 or {})}
    original = unit_terms(topics)
    first = settle(ranking(original, feedback["fb_docs"]))
    return ranking(settle(feedback_terms(first, original, by, **feedback)), topk)
