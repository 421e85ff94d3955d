"""BM25, Dirichlet query likelihood and relevance feedback.

``terms`` is ``(topic_id, term, weight)``, ``postings`` is ``(*keys, term, tf,
dl)``; a score is a sum over query-term occurrences, so duplicates in a query
count by their weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import place
from . import best
from .index import Index, background, document_frequency
from .tables import by_score, ranked, settle

UNSEEN = 1e-12


def check_bm25(k1: float, b: float) -> None:
    if not (k1 > 0 and 0 <= b <= 1):
        raise ValueError("need k1 > 0 and 0 <= b <= 1")


def check_mu(mu: float) -> None:
    if not mu > 0:
        raise ValueError("need mu > 0")


def check_rm3(fb_terms: int, fb_docs: int, original_weight: float) -> None:
    if fb_terms <= 0 or fb_docs <= 0 or not 0 <= original_weight <= 1:
        raise ValueError("need positive fb_terms and fb_docs and 0 <= original_weight <= 1")


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25_part(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, k1: Column, b: Column) -> Column:
    return idf(n, df) * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))


def matches(terms: DataFrame, index: Index) -> DataFrame:
    """Query terms joined to their postings, with df and collection statistics.

    ``terms`` should be a settled table. Their document frequencies are settled
    with them, so Spark broadcasts both by their exact size and the postings
    are filtered in the scan's stage; nothing larger than the sums per topic
    and document is shuffled.
    """
    wanted = terms.select("term").distinct()
    known = settle(terms.join(document_frequency(index, wanted), "term"))
    return index.postings().join(known, "term").crossJoin(F.broadcast(index.stats))  # stats: one row


def bm25_scores(terms: DataFrame, index: Index, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """``(topic_id, doc_id, score)`` of every document that holds a query term."""
    return _placed(_bm25(terms, index, k1, b))


def _placed(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", place(F.col("score")))


def _bm25(terms: DataFrame, index: Index, k1: float, b: float) -> DataFrame:
    check_bm25(k1, b)
    part = F.col("weight") * bm25_part(
        F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avgdl"), F.lit(k1), F.lit(b)
    )
    return matches(terms, index).groupBy("topic_id", "doc_id").agg(F.sum(part).alias("score"))


def qld_scores(terms: DataFrame, index: Index, mu: float = 1000.0) -> DataFrame:
    """Dirichlet-smoothed log likelihood of every document that holds a query term.

    ``sum(ln((tf + mu p) / (dl + mu)))`` over all query terms is split into a
    part of the whole query and one of the matching terms, so terms that a
    document lacks need no rows.
    """
    return _placed(_qld(terms, index, mu))


def _qld(terms: DataFrame, index: Index, mu: float) -> DataFrame:
    check_mu(mu)
    wanted = terms.select("term").distinct()
    seen = background(index, wanted).select("term", "p")
    smoothed = settle(terms.join(seen, "term", "left").withColumn("p", F.coalesce("p", F.lit(UNSEEN))))
    whole = smoothed.groupBy("topic_id").agg(
        F.sum(F.col("weight") * F.ln(mu * F.col("p"))).alias("rest"), F.sum("weight").alias("weights")
    )
    hit = F.sum(F.col("weight") * F.ln(1.0 + F.col("tf") / (mu * F.col("p"))))
    found = (
        index.postings(wanted)
        .join(smoothed, "term")
        .groupBy("topic_id", "doc_id")
        .agg(hit.alias("hit"), F.first("dl").alias("dl"))
        .join(whole, "topic_id")
    )
    score = F.col("hit") + F.col("rest") - F.col("weights") * F.ln(F.col("dl") + mu)
    return found.select("topic_id", "doc_id", score.alias("score"))


def mixed_scores(
    terms: DataFrame, index: Index, alpha: float = 0.5, k1: float = 0.9, b: float = 0.4, mu: float = 1000.0
) -> DataFrame:
    """``alpha * BM25 + (1 - alpha) * QLD`` of raw scores."""
    lexical = _bm25(terms, index, k1, b).withColumnRenamed("score", "bm25")
    language = _qld(terms, index, mu).withColumnRenamed("score", "qld")
    both = lexical.join(language, ["topic_id", "doc_id"])
    return both.select(
        "topic_id", "doc_id", place(F.col("bm25") * alpha + F.col("qld") * (1.0 - alpha)).alias("score")
    )


def _bm25_query(terms: DataFrame, index: Index) -> best.Terms:
    import numpy as np

    rows = terms.join(document_frequency(index, terms.select("term").distinct()), "term").collect()  # topics x terms
    stats = index.stats.first()
    weight, df = (np.array([r[c] for r in rows], float) for c in ("weight", "df"))
    gain = weight * np.log((stats["n_docs"] - df + 0.5) / (df + 0.5) + 1.0)
    return best.Terms(rows, gain=gain, avgdl=np.full(len(rows), stats["avgdl"]))


def best_bm25(terms: DataFrame, index: Index, settings: list[tuple[float, float]], topk: int) -> DataFrame:
    """``(setting, topic_id, doc_id, score, rank)`` of the best ``topk``
    documents for each ``(k1, b)``; see :mod:`.best`."""
    for k1, b in settings:
        check_bm25(k1, b)
    query = _bm25_query(terms, index)
    return best.best_rows(index.rows, ["doc_id"], terms, query, best.bm25_parts(settings), best.sums_only, topk, len(settings))


def best_qld(terms: DataFrame, index: Index, topk: int, mu: float = 1000.0, mix: tuple | None = None) -> DataFrame:
    """The same by query likelihood; ``mix`` is ``(alpha, k1, b)`` for
    ``alpha * BM25 + (1 - alpha) * QLD`` of raw scores."""
    import numpy as np

    check_mu(mu)
    seen = background(index, terms.select("term").distinct()).select("term", "cf", "p")
    rows = terms.join(seen, "term", "left").collect()  # topics x terms
    weight = np.array([r["weight"] for r in rows], float)
    p = np.array([UNSEEN if r["p"] is None else r["p"] for r in rows], float)
    rest: dict = {}
    weights: dict = {}
    for r, w, x in zip(rows, weight, p):
        rest[r["topic_id"]] = rest.get(r["topic_id"], 0.0) + w * np.log(mu * x)
        weights[r["topic_id"]] = weights.get(r["topic_id"], 0.0) + w
    values = {"weight": weight, "p": p}
    values |= {n: [of[r["topic_id"]] for r in rows] for n, of in (("rest", rest), ("weights", weights))}
    lexical = None
    if mix is not None:
        alpha, k1, b = mix
        check_bm25(k1, b)
        bm25 = _bm25_query(terms, index)
        own = {(r["topic_id"], r["term"]): k for k, r in enumerate(bm25.rows)}
        at = [own.get((r["topic_id"], r["term"])) for r in rows]
        values["gain"] = [0.0 if k is None else bm25.values["gain"][k] for k in at]
        values["avgdl"] = [bm25.values["avgdl"][0] if len(bm25.rows) else 1.0] * len(rows)
        lexical = best.bm25_parts([(k1, b)])

    def parts(query, tf, dl, pos):
        yield query.values["weight"][pos] * np.log(1.0 + tf / (mu * query.values["p"][pos]))
        if lexical is not None:
            yield from lexical(query, tf, dl, pos)

    def finish(query, sums, dl, topic):
        one = np.zeros((2, len(query.topics)))
        one[:, query.topic] = query.values["rest"], query.values["weights"]
        qld = sums[0] + one[0][topic] - one[1][topic] * np.log(dl + mu)
        return [qld if lexical is None else sums[1] * alpha + qld * (1.0 - alpha)]

    return best.best_rows(index.rows, ["doc_id"], terms, best.Terms(rows, **values), parts, finish, topk)


def unit_terms(terms: DataFrame) -> DataFrame:
    """``terms`` with weights that sum to one per topic."""
    length = terms.groupBy("topic_id").agg(F.sum("weight").alias("length"))
    return terms.join(length, "topic_id").select("topic_id", "term", (F.col("weight") / F.col("length")).alias("weight"))


def rm3_terms(
    terms: DataFrame,
    index: Index,
    first_pass: DataFrame,
    fb_terms: int = 10,
    fb_docs: int = 10,
    original_weight: float = 0.5,
) -> DataFrame:
    """Expanded query ``(topic_id, term, weight)``.

    The terms of the best ``fb_docs`` documents are weighted by
    ``score * tf / dl``, the best ``fb_terms`` are normalised and mixed with
    the normalised original query.
    """
    check_rm3(fb_terms, fb_docs, original_weight)
    feedback = ranked(first_pass, ["topic_id"], by_score("doc_id"), top=fb_docs)
    feedback = settle(feedback.select("topic_id", "doc_id", "score"))
    docs = feedback.select("doc_id").distinct()
    model = (
        index.postings(docs=docs).join(feedback, "doc_id")
        .groupBy("topic_id", "term")
        .agg(place(F.sum(F.col("score") * F.col("tf") / F.col("dl"))).alias("score"))
    )
    best = settle(ranked(model, ["topic_id"], by_score("term"), top=fb_terms))
    total = best.groupBy("topic_id").agg(F.sum("score").alias("total"))
    expansion = best.join(total, "topic_id").select("topic_id", "term", (F.col("score") / F.col("total")).alias("e"))
    length = terms.groupBy("topic_id").agg(F.sum("weight").alias("length"))
    original = terms.join(length, "topic_id").select("topic_id", "term", (F.col("weight") / F.col("length")).alias("o"))
    mixed = F.coalesce("o", F.lit(0.0)) * original_weight + F.coalesce("e", F.lit(0.0)) * (1.0 - original_weight)
    return (
        original.join(expansion, ["topic_id", "term"], "full_outer")
        .select("topic_id", "term", mixed.alias("weight"))
        .where("weight > 0")
    )


def bm25_rm3_scores(
    terms: DataFrame, index: Index, k1: float = 0.9, b: float = 0.4, **feedback
) -> DataFrame:
    """Second pass over the expanded query; the first one is BM25 with the
    normalised query, so feedback weights don't depend on the query's length."""
    length = terms.groupBy("topic_id").agg(F.sum("weight").alias("length"))
    unit = terms.join(length, "topic_id").select("topic_id", "term", (F.col("weight") / F.col("length")).alias("weight"))
    first = bm25_scores(unit, index, k1, b)
    return bm25_scores(settle(rm3_terms(unit, index, first, **feedback)), index, k1, b)
