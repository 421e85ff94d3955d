"""Oracle SQL (DuckDB) of the catalog's queries, built from shared CTEs."""

from __future__ import annotations

from ..operators.features import STOPWORDS
from .config import ClusterConfig, DenseConfig

PLAN, DENSE = ClusterConfig(), DenseConfig(rerank=True, alpha=0.3)

W = r"'[\p{L}\p{N}_]+'"
STOP = ",".join(f"'{w}'" for w in STOPWORDS)

CTES = {
    "topics": f"SELECT item_id AS topic_id, array_to_string(list_slice(regexp_extract_all(lower(text), {W}), 1, 4), ' ') AS text FROM benchmark",
    "qt": f"SELECT topic_id, term, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT topic_id, unnest(regexp_extract_all(lower(text), {W})) AS term FROM topics) GROUP BY ALL",
    "tok": f"SELECT doc_id, unnest(regexp_extract_all(lower(text), {W})) AS term FROM documents",
    "tf": "SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL",
    "dl": f"SELECT doc_id, len(regexp_extract_all(lower(text), {W})) AS dl FROM documents",
    "st": "SELECT count(*) AS n, sum(dl) AS total, sum(dl) / count(*) AS avgdl FROM dl",
    "df": "SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term",
    "bm": "SELECT topic_id, doc_id, round(sum(weight * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 1.9e0 / (tf + 0.9e0 * (0.6e0 + 0.4e0 * dl / avgdl))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL",
    "qlr": "SELECT topic_id, sum(weight * ln(1000e0 * coalesce(cf / total, 1e-12))) AS rest, sum(weight) AS ws FROM qt LEFT JOIN df USING (term), st GROUP BY ALL",
    "ql": "SELECT topic_id, doc_id, round(sum(weight * ln(1e0 + tf / (1000e0 * cf / total))) + any_value(rest) - any_value(ws) * ln(any_value(dl) + 1000e0), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) JOIN qlr USING (topic_id), st GROUP BY topic_id, doc_id",
    "cand": f"SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= {PLAN.candidates}",
    "qrels": "SELECT item_id AS topic_id, doc_id, 1 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "sent": r"SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM documents",
    "psg": "SELECT doc_id, CAST(w AS INTEGER) AS p_idx, array_to_string(list_slice(s, w * 8 + 1, w * 8 + 10), ' ') AS content FROM sent, unnest(range(0, 1 + greatest(0, CAST(ceil((len(s) - 10) / 8e0) AS BIGINT)))) AS x(w) WHERE len(list_slice(s, w * 8 + 1, w * 8 + 10)) >= 3",
    "tp": f"SELECT topic_id, doc_id, p_idx, content, rank AS doc_rank FROM cand JOIN psg USING (doc_id) WHERE rank <= {PLAN.content_topk}",
    "pw": f"SELECT topic_id, doc_id, p_idx, regexp_extract_all(lower(content), {W}) AS words FROM tp",
    "ps": "SELECT topic_id, count(*) AS n, avg(len(words)) AS avgdl, sum(len(words)) AS total FROM pw GROUP BY ALL",
    "ph": "SELECT topic_id, doc_id, p_idx, term, weight, dl, count(*) AS tf FROM (SELECT topic_id, doc_id, p_idx, len(words) AS dl, unnest(words) AS term FROM pw) JOIN qt USING (topic_id, term) GROUP BY ALL",
    "pdf": "SELECT topic_id, term, count(*) AS df, sum(tf) AS cf FROM ph GROUP BY ALL",
    "pb": "SELECT topic_id, doc_id, p_idx, round(sum(weight * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 1.9e0 / (tf + 0.9e0 * (0.6e0 + 0.4e0 * dl / avgdl))), 6) AS score FROM ph JOIN pdf USING (topic_id, term) JOIN ps USING (topic_id) GROUP BY topic_id, doc_id, p_idx",
    "best": f"SELECT topic_id, doc_id, p_idx, content, doc_rank, score, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id, p_idx) AS p_rank FROM pb JOIN tp USING (topic_id, doc_id, p_idx) QUALIFY p_rank <= {PLAN.passages}",
    # TF-IDF cosine clusters of the ranked passages.
    "btf": f"SELECT topic_id, p_rank AS i, term, count(*) AS tf FROM (SELECT topic_id, p_rank, unnest(regexp_extract_all(lower(content), {W})) AS term FROM best) GROUP BY ALL",
    "bn": "SELECT topic_id, count(*) AS n FROM best GROUP BY ALL",
    "bv": "SELECT topic_id, i, term, tf * (ln((n + 1e0) / (count(*) OVER (PARTITION BY topic_id, term) + 1e0)) + 1e0) AS w FROM btf JOIN bn USING (topic_id)",
    "bnorm": "SELECT topic_id, i, sqrt(sum(w * w)) AS norm FROM bv GROUP BY ALL",
    "bcos": "SELECT topic_id, a.i AS a, b.i AS b, round(sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)), 6) AS sim FROM bv a JOIN bv b USING (topic_id, term) JOIN bnorm x ON x.topic_id = topic_id AND x.i = a.i JOIN bnorm y ON y.topic_id = topic_id AND y.i = b.i WHERE a.i < b.i GROUP BY topic_id, a.i, b.i",
    "near": "SELECT topic_id, cluster_id, i, row_number() OVER (PARTITION BY topic_id, cluster_id ORDER BY sim DESC, i) AS pos FROM (SELECT topic_id, a AS cluster_id, b AS i, sim FROM bcos WHERE sim >= 0.2 UNION ALL SELECT topic_id, b, a, sim FROM bcos WHERE sim >= 0.2) QUALIFY pos <= 4",
    "mem": "SELECT m.topic_id, cluster_id, pos, m.i AS p_rank, doc_id, p_idx, doc_rank, content FROM (SELECT topic_id, p_rank AS cluster_id, 0 AS pos, p_rank AS i FROM best UNION ALL SELECT topic_id, cluster_id, pos, i FROM near) m JOIN best b ON b.topic_id = m.topic_id AND b.p_rank = m.i",
    "mtok": f"SELECT topic_id, cluster_id, pos, unnest(regexp_extract_all(lower(content), {W})) AS term FROM mem",
    "f_rrp": "SELECT topic_id, cluster_id, round(max(1e0 / p_rank), 6) AS value FROM mem GROUP BY ALL",
    "f_rrd": "SELECT topic_id, cluster_id, round(max(1e0 / doc_rank), 6) AS value FROM mem GROUP BY ALL",
    "f_ent": f"SELECT topic_id, cluster_id, round(coalesce(ln(sum(c)) - sum(c * ln(c)) / sum(c), 0), 6) AS value FROM (SELECT DISTINCT topic_id, cluster_id FROM mem) LEFT JOIN (SELECT topic_id, cluster_id, term, CAST(count(*) AS DOUBLE) AS c FROM mtok WHERE term NOT IN ({STOP}) GROUP BY ALL) USING (topic_id, cluster_id) GROUP BY ALL",
    "f_stop": f"SELECT topic_id, cluster_id, round(avg(CASE WHEN term IN ({STOP}) THEN 1e0 ELSE 0e0 END), 6) AS value FROM mtok GROUP BY ALL",
    "mtf": "SELECT topic_id, cluster_id, pos, term, count(*) AS tf FROM mtok GROUP BY ALL",
    "mn": "SELECT topic_id, cluster_id, count(*) AS n FROM mem GROUP BY ALL",
    "mv": "SELECT topic_id, cluster_id, pos, term, tf * (ln((n + 1e0) / (count(*) OVER (PARTITION BY topic_id, cluster_id, term) + 1e0)) + 1e0) AS w FROM mtf JOIN mn USING (topic_id, cluster_id)",
    "mnorm": "SELECT topic_id, cluster_id, pos, sqrt(sum(w * w)) AS norm FROM mv GROUP BY ALL",
    "mcos": "SELECT a.topic_id, a.cluster_id, a.pos AS a, b.pos AS b, sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)) AS sim FROM mv a JOIN mv b ON a.topic_id = b.topic_id AND a.cluster_id = b.cluster_id AND a.term = b.term AND a.pos < b.pos JOIN mnorm x ON x.topic_id = a.topic_id AND x.cluster_id = a.cluster_id AND x.pos = a.pos JOIN mnorm y ON y.topic_id = b.topic_id AND y.cluster_id = b.cluster_id AND y.pos = b.pos GROUP BY ALL",
    "f_sim": "SELECT topic_id, cluster_id, round(CASE WHEN any_value(n) < 2 THEN 0e0 ELSE coalesce(sum(sim), 0) / (any_value(n) * (any_value(n) - 1) / 2e0) END, 6) AS value FROM mn LEFT JOIN mcos USING (topic_id, cluster_id) GROUP BY ALL",
    "f_docs": "SELECT topic_id, cluster_id, CAST(count(DISTINCT doc_id) AS DOUBLE) AS value FROM mem GROUP BY ALL",
    "feat": "SELECT topic_id, cluster_id, s.value AS prior_intra_similarity_mean, t.value AS prior_stopword_ratio, e.value AS prior_term_entropy, u.value AS prior_unique_docs, d.value AS qdep_rr_cluster_docs_max, p.value AS qdep_rr_cluster_passages_max FROM f_sim s JOIN f_stop t USING (topic_id, cluster_id) JOIN f_ent e USING (topic_id, cluster_id) JOIN f_docs u USING (topic_id, cluster_id) JOIN f_rrd d USING (topic_id, cluster_id) JOIN f_rrp p USING (topic_id, cluster_id)",
    "jm": "SELECT mem.*, q.rel IS NOT NULL AS hit FROM mem LEFT JOIN qrels q USING (topic_id, doc_id)",
    "lab": "SELECT topic_id, cluster_id, CAST(max(CAST(hit AS INTEGER)) AS INTEGER) AS label FROM jm GROUP BY ALL",
    "pub": "SELECT topic_id, cluster_id, round(0.006048895e0 * prior_intra_similarity_mean - 3.2712941e0 * prior_stopword_ratio + 4.1410227e0 * prior_term_entropy - 0.19549844e0 * prior_unique_docs + 2.1483274e0 * qdep_rr_cluster_docs_max + 1.4449468e0 * qdep_rr_cluster_passages_max, 6) AS score FROM feat",
    "lift": "SELECT topic_id, doc_id, p_idx, max(1e0 / cluster_id) AS score, min(p_rank) AS p_rank FROM mem GROUP BY topic_id, doc_id, p_idx",
    "lifted": "SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, p_rank) AS new_rank FROM lift",
    "cap": "SELECT topic_id, doc_id, sum(1e0 / (100 + new_rank)) AS passage_score, count(*) AS used FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, doc_id ORDER BY new_rank) AS n FROM lifted) WHERE n <= 3 GROUP BY ALL",
    "lam": "SELECT topic_id, doc_id, rank, coalesce(passage_score, 0e0) AS ps, 0.5e0 + 0.5e0 * least(1e0, coalesce(used, 0) / 3e0) AS l FROM cand LEFT JOIN cap USING (topic_id, doc_id)",
    "fused": "SELECT topic_id, doc_id, rank, round(l * ps + (1e0 - l) / rank, 6) AS score FROM lam",
    # Statistics of each candidate's own passages.
    "os": "SELECT topic_id, doc_id, count(*) AS n, avg(len(words)) AS avgdl FROM pw GROUP BY ALL",
    "odf": "SELECT topic_id, doc_id, term, count(*) AS df FROM ph GROUP BY ALL",
    "own": "SELECT topic_id, doc_id, p_idx, round(sum(weight * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 1.9e0 / (tf + 0.9e0 * (0.6e0 + 0.4e0 * dl / avgdl))), 6) AS score FROM ph JOIN odf USING (topic_id, doc_id, term) JOIN os USING (topic_id, doc_id) GROUP BY topic_id, doc_id, p_idx",
    "pseudo": "SELECT topic_id, doc_id, p_idx, score, row_number() OVER (PARTITION BY topic_id, doc_id ORDER BY score DESC, p_idx) AS p_rank FROM own SEMI JOIN qrels USING (topic_id, doc_id) QUALIFY p_rank <= 2",
    # Passages of each document.
    "ptf": f"SELECT doc_id, p_idx AS i, term, count(*) AS tf FROM (SELECT doc_id, p_idx, unnest(regexp_extract_all(lower(content), {W})) AS term FROM psg) GROUP BY ALL",
    "pn": "SELECT doc_id, count(*) AS n FROM psg GROUP BY ALL",
    "pv": "SELECT doc_id, i, term, tf * (ln((n + 1e0) / (count(*) OVER (PARTITION BY doc_id, term) + 1e0)) + 1e0) AS w FROM ptf JOIN pn USING (doc_id)",
    "pnorm": "SELECT doc_id, i, sqrt(sum(w * w)) AS norm FROM pv GROUP BY ALL",
    "pcos": "SELECT a.doc_id, a.i AS a, b.i AS b, round(sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)), 6) AS sim FROM pv a JOIN pv b ON a.doc_id = b.doc_id AND a.term = b.term AND a.i < b.i JOIN pnorm x ON x.doc_id = a.doc_id AND x.i = a.i JOIN pnorm y ON y.doc_id = b.doc_id AND y.i = b.i GROUP BY ALL",
    "plm": "SELECT doc_id, i, term, tf / sum(tf) OVER (PARTITION BY doc_id, i) AS w FROM ptf",
    # Feedback.
    "q1": "SELECT topic_id, term, weight / sum(weight) OVER (PARTITION BY topic_id) AS weight FROM qt",
    "b1": "SELECT topic_id, doc_id, round(sum(weight * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 1.9e0 / (tf + 0.9e0 * (0.6e0 + 0.4e0 * dl / avgdl))), 6) AS score FROM q1 JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL",
    "fb": "SELECT topic_id, doc_id, score FROM b1 QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) <= 10",
    "rm": "SELECT topic_id, term, p FROM (SELECT topic_id, term, round(sum(score * tf / dl), 6) AS p FROM fb JOIN tf USING (doc_id) JOIN dl USING (doc_id) GROUP BY topic_id, term) QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY p DESC, term) <= 20",
    "rmn": "SELECT topic_id, term, p / sum(p) OVER (PARTITION BY topic_id) AS e FROM rm",
    "q2": "SELECT coalesce(o.topic_id, e.topic_id) AS topic_id, coalesce(o.term, e.term) AS term, 0.5e0 * coalesce(o.weight, 0) + 0.5e0 * coalesce(e.e, 0) AS weight FROM q1 o FULL JOIN rmn e ON o.topic_id = e.topic_id AND o.term = e.term",
    "b2": "SELECT topic_id, doc_id, round(sum(weight * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 1.9e0 / (tf + 0.9e0 * (0.6e0 + 0.4e0 * dl / avgdl))), 6) AS score FROM q2 JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL",
    # Feedback of passages, with statistics per topic.
    "pbm1": "SELECT topic_id, doc_id, p_idx, round(sum(q1.weight * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 1.9e0 / (tf + 0.9e0 * (0.6e0 + 0.4e0 * dl / avgdl))), 6) AS score FROM ph JOIN q1 USING (topic_id, term) JOIN pdf USING (topic_id, term) JOIN ps USING (topic_id) GROUP BY topic_id, doc_id, p_idx",
    "pfb": "SELECT topic_id, doc_id, p_idx, score FROM pbm1 QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id, p_idx) <= 10",
    "ptok": "SELECT topic_id, doc_id, p_idx, term, dl, count(*) AS tf FROM (SELECT topic_id, doc_id, p_idx, len(words) AS dl, unnest(words) AS term FROM pw) GROUP BY ALL",
    "prm": "SELECT topic_id, term, p FROM (SELECT topic_id, term, round(sum(score * tf / dl), 6) AS p FROM pfb JOIN ptok USING (topic_id, doc_id, p_idx) GROUP BY topic_id, term) QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY p DESC, term) <= 50",
    "prmn": "SELECT topic_id, term, p / sum(p) OVER (PARTITION BY topic_id) AS e FROM prm",
    "pq2": "SELECT coalesce(o.topic_id, e.topic_id) AS topic_id, coalesce(o.term, e.term) AS term, 0.2e0 * coalesce(o.weight, 0) + 0.8e0 * coalesce(e.e, 0) AS weight FROM q1 o FULL JOIN prmn e ON o.topic_id = e.topic_id AND o.term = e.term",
    "pdf2": "SELECT topic_id, term, count(*) AS df FROM ptok GROUP BY ALL",
    "pb2": "SELECT topic_id, doc_id, p_idx, round(sum(weight * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 1.9e0 / (tf + 0.9e0 * (0.6e0 + 0.4e0 * dl / avgdl))), 6) AS score FROM ptok JOIN pq2 USING (topic_id, term) JOIN pdf2 USING (topic_id, term) JOIN ps USING (topic_id) GROUP BY topic_id, doc_id, p_idx",
    # Dense.
    "dq": f"SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q, array_to_string(list_slice(regexp_extract_all(lower(coalesce(text, '')), {W}), 1, 4), ' ') AS qtext FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0",
    "dv": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
}


#: Scores before rounding.
_RAW = {k: CTES[k].replace("round(", "(", 1).replace(", 6) AS score", ") AS score", 1) for k in ("bm", "ql")}


def _needs(sql: str) -> set[str]:
    import re

    return {name for name in CTES if re.search(rf"\b{name}\b", sql)}


def with_ctes(sql: str) -> str:
    """``sql`` after the CTEs that it uses, directly or through others."""
    used: set[str] = set()
    todo = _needs(sql)
    while todo:
        name = todo.pop()
        used.add(name)
        todo |= _needs(CTES[name]) - used - {name}
    order = [name for name in CTES if name in used]
    head = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in order)
    return f"WITH {head}\n{sql}" if head else sql


def _top(source: str, k: int) -> str:
    return (
        f"SELECT topic_id, doc_id, score, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank "
        f"FROM {source} QUALIFY rank <= {k}"
    )


def _precision(run: str, extra: str = "") -> str:
    """Average precision of a ranked CTE-like select, per topic of the judgments."""
    return f"""
per AS (SELECT {extra} r.topic_id, rank, row_number() OVER (PARTITION BY {extra} r.topic_id ORDER BY rank) AS seen
  FROM ({run}) r SEMI JOIN qrels USING (topic_id, doc_id)),
prec AS (SELECT {extra} topic_id, sum(seen / rank) AS total FROM per GROUP BY ALL),
rels AS (SELECT topic_id, count(*) AS relevant FROM qrels GROUP BY ALL)"""


def _joined(head: str, ctes: str, sql: str) -> str:
    """``head`` is a WITH list made by :func:`with_ctes`; more CTEs follow it."""
    return f"{head},{ctes}\n{sql}"


FEATURE_SHORT = {
    "rr_passages": "qdep_rr_cluster_passages_max",
    "rr_docs": "qdep_rr_cluster_docs_max",
    "entropy": "prior_term_entropy",
    "stopwords": "prior_stopword_ratio",
    "intra_similarity": "prior_intra_similarity_mean",
    "unique_docs": "prior_unique_docs",
}
_FEATURE_CTE = {
    "rr_passages": "f_rrp", "rr_docs": "f_rrd", "entropy": "f_ent", "stopwords": "f_stop",
    "intra_similarity": "f_sim", "unique_docs": "f_docs",
}
FEATURES = sorted(FEATURE_SHORT.values())


def _doc_level(how: str) -> str:
    of = {"max": "max", "sum": "sum", "mean": "avg"}[how]
    names = ", ".join(f"coalesce(round(any_value({n}) + 1e-9, 6), 0e0) AS {n}" for n in FEATURES)
    inner = ", ".join(f"{of}({n}) AS {n}" for n in FEATURES)
    return (
        f"SELECT c.topic_id, c.doc_id, {names}, CAST(any_value(q.rel) IS NOT NULL AS INTEGER) AS label FROM cand c "
        f"LEFT JOIN (SELECT topic_id, doc_id, {inner} FROM (SELECT DISTINCT topic_id, cluster_id, doc_id FROM mem) JOIN feat USING (topic_id, cluster_id) GROUP BY topic_id, doc_id) a USING (topic_id, doc_id) "
        f"LEFT JOIN qrels q USING (topic_id, doc_id) GROUP BY c.topic_id, c.doc_id"
    )


def _scale(mode: str) -> str:
    def one(n: str) -> str:
        if mode == "minmax":
            offset, width = f"min({n}) OVER ()", f"(max({n}) OVER () - min({n}) OVER ())"
        else:
            offset, width = f"avg({n}) OVER ()", f"stddev_pop({n}) OVER ()"
        return f"round(CASE WHEN {width} <= 1e-12 THEN 0e0 ELSE ({n} - {offset}) / {width} END + 1e-9, 6) AS {n}"

    return f"SELECT topic_id, cluster_id, {', '.join(map(one, FEATURES))} FROM feat"


def _norm(x: str, mode: str) -> str:
    over = "OVER (PARTITION BY topic_id)"
    if mode == "minmax":
        offset, width = f"min({x}) {over}", f"(max({x}) {over} - min({x}) {over})"
    else:
        offset, width = f"avg({x}) {over}", f"stddev_pop({x}) {over}"
    return f"(CASE WHEN {width} <= 1e-12 THEN 0e0 ELSE ({x} - {offset}) / {width} END)"


def _dense(score: str) -> str:
    return (
        f"SELECT query_id, vec_id, round({score}, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 6) DESC, vec_id) AS INTEGER) AS rank "
        f"FROM dq, dv QUALIFY rank <= 20"
    )


def _pairs_sql(sim: str, source: str) -> str:
    return f"SELECT doc_id, a, b, sim FROM (SELECT x.doc_id, x.i AS a, y.i AS b, {sim} AS sim FROM {source})"


_LINE = " || ".join(
    [
        "CAST(label AS VARCHAR) || ' qid:' || topic_id",
        *(
            f"CASE WHEN round({n}, 6) <> 0 THEN printf(' {k}:%.6f', round({n}, 6)) ELSE '' END"
            for k, n in enumerate(FEATURES, 1)
        ),
        "' # ' || cluster_id",
    ]
)

_PLAIN = {
    "tokenize_tf": "SELECT doc_id, term, tf FROM tf",
    "df_stats": "SELECT term, df, n AS n_docs, round(avgdl, 6) AS avgdl FROM df, st",
    "bg_model": "SELECT term, CAST(cf AS BIGINT) AS cf, round(cf / total, 9) AS p FROM df, st",
    "vocabulary": "SELECT term, df FROM df, st WHERE df >= 2 AND df <= floor(0.5e0 * n) ORDER BY df DESC, term LIMIT 500",
    "bm25_topk": _top("bm", 10),
    "qld_topk": _top("ql", 10),
    "bm25_qld_mix": _top("(SELECT topic_id, doc_id, round(b.score * 0.5e0 + q.score * 0.5e0, 6) AS score FROM (" + _RAW["bm"] + ") b JOIN (" + _RAW["ql"] + ") q USING (topic_id, doc_id))", 10),
    "rm3_terms": "SELECT topic_id, term, round(weight, 6) AS weight FROM q2 WHERE weight > 0",
    "rm3_topk": _top("b2", 20),
    "split_topics": "SELECT topic_id, text FROM topics QUALIFY row_number() OVER (ORDER BY topic_id) > 10",
    "augment_candidates": "SELECT topic_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM cand UNION ALL SELECT topic_id, doc_id, NULL, CAST(coalesce((SELECT max(rank) FROM cand c WHERE c.topic_id = m.topic_id), 0) + row_number() OVER (PARTITION BY topic_id ORDER BY doc_id) AS INTEGER) FROM (SELECT topic_id, doc_id FROM qrels ANTI JOIN cand USING (topic_id, doc_id)) m",
    "judged_docs": "SELECT topic_id, doc_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY doc_id) AS INTEGER) AS rank, CAST(length(text) AS INTEGER) AS n_chars FROM qrels JOIN documents USING (doc_id) QUALIFY rank <= 2",
    "content_attach": "SELECT topic_id, doc_id, CAST(rank AS INTEGER) AS rank, CAST(length(text) AS INTEGER) AS n_chars FROM cand JOIN documents USING (doc_id) WHERE rank <= 5",
    "neg_pool": "SELECT topic_id, doc_id, CAST(rank AS INTEGER) AS rank FROM cand ANTI JOIN qrels USING (topic_id, doc_id)",
    "doc_text_fetch": """SELECT event_id, coalesce(
  CASE WHEN event_id % 4 = 0 THEN nullif(event_type, '') END,
  CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN nullif(event_type, '') ELSE coalesce(nullif(json_extract_string(props, '$.contents'), ''), nullif(json_extract_string(props, '$.raw'), ''), nullif(props, '')) END END,
  '') AS text FROM events""",
    "qrels_max": "SELECT CAST(l_orderkey % 50 AS INTEGER) AS topic_id, CAST(l_partkey % 200 AS VARCHAR) AS doc_id, CAST(max(l_linenumber % 3) AS INTEGER) AS rel FROM lineitem GROUP BY ALL",
    "run_load_dedup": "SELECT CAST(topic_id AS INTEGER) AS topic_id, doc_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY pos, doc_id) AS INTEGER) AS rank FROM (SELECT l_orderkey % 20 AS topic_id, CAST(l_partkey % 300 AS VARCHAR) AS doc_id, min(l_suppkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY ALL) QUALIFY rank <= 100",
    "trec_lines": "SELECT topic_id, CAST(rank AS INTEGER) AS rank, topic_id || ' Q0 ' || doc_id || ' ' || rank || ' ' || printf('%.6f', score) || ' base' AS line FROM cand WHERE rank <= 10",
    "sentences": "SELECT doc_id, CAST(k - 1 AS INTEGER) AS s_idx, s[k] AS sentence FROM sent, unnest(range(1, len(s) + 1)) AS x(k)",
    "passage_rows": "SELECT doc_id, p_idx, content FROM psg",
    "per_doc_first_k": "SELECT topic_id, doc_id, p_idx FROM tp QUALIFY row_number() OVER (PARTITION BY topic_id, doc_id ORDER BY p_idx) <= 2",
    "per_doc_overlap": "SELECT topic_id, doc_id, p_idx, CAST(len(list_filter(words, lambda w: list_contains(qs, w))) AS INTEGER) AS overlap FROM pw JOIN (SELECT topic_id, list(term) AS qs FROM qt GROUP BY ALL) USING (topic_id) QUALIFY row_number() OVER (PARTITION BY topic_id, doc_id ORDER BY overlap DESC, p_idx) <= 2",
    "passage_bm25": "SELECT topic_id, doc_id, p_idx, score, CAST(p_rank AS INTEGER) AS p_rank FROM best",
    "passage_rm3": f"SELECT topic_id, doc_id, p_idx, score, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id, p_idx) AS INTEGER) AS p_rank FROM pb2 QUALIFY p_rank <= {PLAN.passages}",
    "passage_qld": f"""SELECT topic_id, doc_id, p_idx, score, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id, p_idx) AS INTEGER) AS p_rank FROM (
  SELECT pw.topic_id, pw.doc_id, pw.p_idx, round(CASE WHEN len(any_value(words)) = 0 THEN 0e0 ELSE sum(qt.weight * ln((coalesce(tf, 0) + 1000e0 * CASE WHEN coalesce(cf, 0) > 0 THEN cf / total ELSE 1e-12 END) / (len(words) + 1000e0))) END, 6) AS score
  FROM pw JOIN qt USING (topic_id) JOIN ps USING (topic_id) LEFT JOIN pdf ON pdf.topic_id = pw.topic_id AND pdf.term = qt.term
  LEFT JOIN ph ON ph.topic_id = pw.topic_id AND ph.doc_id = pw.doc_id AND ph.p_idx = pw.p_idx AND ph.term = qt.term
  GROUP BY pw.topic_id, pw.doc_id, pw.p_idx) QUALIFY p_rank <= {PLAN.passages}""",
    "passage_pseudo_topk": "SELECT topic_id, doc_id, p_idx, score, CAST(p_rank AS INTEGER) AS p_rank FROM pseudo",
    "ngrams": f"SELECT topic_id, gram, count(*) AS n FROM (SELECT topic_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS gram FROM (SELECT topic_id, regexp_extract_all(lower(text), {W}) AS w FROM topics)) GROUP BY ALL",
    "tfidf_vectors": f"""SELECT topic_id, i, term, round(tf * (ln((n + 1e0) / (df + 1e0)) + 1e0), 6) AS w FROM (
  SELECT *, count(*) OVER (PARTITION BY topic_id, term) AS df FROM (
    SELECT topic_id, CAST(p_rank AS INTEGER) AS i, term, count(*) AS tf FROM (SELECT topic_id, p_rank, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS term FROM (SELECT topic_id, p_rank, regexp_extract_all(lower(content), {W}) AS w FROM best)) GROUP BY ALL)
  ) JOIN bn USING (topic_id) WHERE df >= 2 AND df <= floor(0.9e0 * n)""",
    "lm_vectors": "SELECT doc_id, i, term, round(w, 6) AS w FROM plm",
    "cosine_pairs": "SELECT doc_id, a, b, sim FROM pcos",
    "dot_pairs": "SELECT doc_id, x.i AS a, y.i AS b, round(sum(x.w * y.w), 6) AS sim FROM pv x JOIN pv y USING (doc_id, term) WHERE x.i < y.i GROUP BY ALL",
    "jaccard_pairs": f"""SELECT doc_id, x.i AS a, y.i AS b, round(CASE WHEN len(x.s) = 0 OR len(y.s) = 0 THEN 0e0 ELSE len(list_intersect(x.s, y.s)) / CAST(len(list_distinct(list_concat(x.s, y.s))) AS DOUBLE) END, 6) AS sim
FROM (SELECT doc_id, p_idx AS i, list_distinct(regexp_extract_all(lower(content), {W})) AS s FROM psg) x JOIN (SELECT doc_id, p_idx AS i, list_distinct(regexp_extract_all(lower(content), {W})) AS s FROM psg) y USING (doc_id) WHERE x.i < y.i""",
    "kl_pairs": """SELECT topic_id, a, b, round(exp(-0.5e0 * sum((p - q) * ln(p / q))), 6) AS sim FROM (
  SELECT topic_id, a, b, p / sum(p) OVER (PARTITION BY topic_id, a, b) AS p, q / sum(q) OVER (PARTITION BY topic_id, a, b) AS q FROM (
    SELECT u.topic_id, u.a, u.b, coalesce(x.w, 0) + 1e-9 AS p, coalesce(y.w, 0) + 1e-9 AS q FROM (
      SELECT DISTINCT x.topic_id, x.i AS a, y.i AS b, z.term FROM (SELECT DISTINCT topic_id, CAST(p_rank AS INTEGER) AS i FROM best) x
      JOIN (SELECT DISTINCT topic_id, CAST(p_rank AS INTEGER) AS i FROM best) y ON x.topic_id = y.topic_id AND x.i < y.i
      JOIN btf z ON z.topic_id = x.topic_id AND (z.i = x.i OR z.i = y.i)) u
    LEFT JOIN (SELECT topic_id, i, term, tf / sum(tf) OVER (PARTITION BY topic_id, i) AS w FROM btf) x ON x.topic_id = u.topic_id AND x.i = u.a AND x.term = u.term
    LEFT JOIN (SELECT topic_id, i, term, tf / sum(tf) OVER (PARTITION BY topic_id, i) AS w FROM btf) y ON y.topic_id = u.topic_id AND y.i = u.b AND y.term = u.term)) GROUP BY ALL""",
    "similarity_edges": "SELECT doc_id, a, b, sim, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, a, b) AS INTEGER) AS n FROM pcos WHERE sim >= 0.1",
    "clusters": "SELECT topic_id, CAST(cluster_id AS INTEGER) AS cluster_id, CAST(pos AS INTEGER) AS pos, CAST(p_rank AS INTEGER) AS p_rank FROM mem",
    **{f"feat_{k}": f"SELECT topic_id, CAST(cluster_id AS INTEGER) AS cluster_id, value FROM {c}" for k, c in _FEATURE_CTE.items()},
    "cluster_features": f"SELECT topic_id, CAST(cluster_id AS INTEGER) AS cluster_id, {', '.join(FEATURES)} FROM feat",
    "cluster_labels_any": "SELECT topic_id, CAST(cluster_id AS INTEGER) AS cluster_id, label FROM lab",
    "cluster_labels_density": "SELECT topic_id, CAST(cluster_id AS INTEGER) AS cluster_id, CAST(CASE WHEN NOT bool_or(hit) THEN 0 WHEN round(sum(CASE WHEN hit THEN 1e0 / (100 + p_rank) ELSE 0 END) / sum(1e0 / (100 + p_rank)), 6) >= 0.5 THEN 2 WHEN round(sum(CASE WHEN hit THEN 1e0 / (100 + p_rank) ELSE 0 END) / sum(1e0 / (100 + p_rank)), 6) >= 0.2 THEN 1 ELSE 0 END AS INTEGER) AS label FROM jm GROUP BY topic_id, jm.cluster_id",
    "cluster_labels_best": "SELECT topic_id, CAST(cluster_id AS INTEGER) AS cluster_id, CAST(CASE WHEN min(CASE WHEN hit THEN p_rank END) <= 3 THEN 2 WHEN min(CASE WHEN hit THEN p_rank END) <= 15 THEN 1 ELSE 0 END AS INTEGER) AS label FROM jm GROUP BY topic_id, jm.cluster_id",
    "cluster_labels_pseudo": "SELECT mem.topic_id, CAST(mem.cluster_id AS INTEGER) AS cluster_id, CAST(CASE WHEN count(p.p_idx) >= 2 THEN 2 WHEN count(p.p_idx) >= 1 THEN 1 ELSE 0 END AS INTEGER) AS label FROM mem LEFT JOIN pseudo p ON p.topic_id = mem.topic_id AND p.doc_id = mem.doc_id AND p.p_idx = mem.p_idx GROUP BY mem.topic_id, mem.cluster_id",
    **{f"doc_level_features_{h}": _doc_level(h) for h in ("max", "sum", "mean")},
    "scale_minmax": _scale("minmax").replace("topic_id, cluster_id", "topic_id, CAST(cluster_id AS INTEGER) AS cluster_id", 1),
    "scale_zscore": _scale("zscore").replace("topic_id, cluster_id", "topic_id, CAST(cluster_id AS INTEGER) AS cluster_id", 1),
    "svm_score_published": "SELECT topic_id, CAST(cluster_id AS INTEGER) AS cluster_id, score FROM pub",
    "norm_scores": f"SELECT topic_id, CAST(cluster_id AS INTEGER) AS cluster_id, round({_norm('score', 'minmax')}, 5) AS minmax, round({_norm('score', 'zscore')}, 5) AS zscore FROM pub",
    "cluster_blend": f"SELECT topic_id, CAST(cluster_id AS INTEGER) AS cluster_id, round({_norm('score', 'minmax')} * 0.5e0 + {_norm('(1e0 / cluster_id)', 'minmax')} * 0.5e0, 6) AS score FROM pub",
    "swapped_pairs": "SELECT t.topic_id, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs, CAST(coalesce(swapped, 0) AS BIGINT) AS swapped, round(coalesce(swapped / pairs, 0), 6) AS fraction FROM (SELECT DISTINCT topic_id FROM pub) t LEFT JOIN (SELECT x.topic_id, count(*) AS pairs, sum(CASE WHEN x.score <= y.score THEN 1 ELSE 0 END) AS swapped FROM (SELECT * FROM pub JOIN lab USING (topic_id, cluster_id)) x JOIN (SELECT * FROM pub JOIN lab USING (topic_id, cluster_id)) y ON x.topic_id = y.topic_id AND x.label > y.label GROUP BY x.topic_id) s USING (topic_id)",
    "svmrank_lines": f"SELECT topic_id, CAST(cluster_id AS INTEGER) AS item, {_LINE} AS line FROM feat JOIN lab USING (topic_id, cluster_id)",
    "passage_rerank": "SELECT topic_id, doc_id, p_idx, round(score, 6) AS score, CAST(p_rank AS INTEGER) AS p_rank, CAST(new_rank AS INTEGER) AS new_rank FROM lifted",
    "rrf_docs": "SELECT topic_id, doc_id, round(sum(1e0 / (60 + new_rank)), 6) AS score FROM lifted WHERE new_rank <= 20 GROUP BY ALL",
    "rr_capped_docs": "SELECT topic_id, doc_id, round(passage_score, 6) AS passage_score, used FROM cap",
    "adaptive_fusion": "SELECT topic_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM fused",
    "head_tail": f"SELECT topic_id, doc_id, CAST(rank AS INTEGER) AS rank, CASE WHEN rank > {PLAN.rerank_topn} THEN round(1e0 / rank, 6) ELSE score END AS score, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY (rank > {PLAN.rerank_topn}), CASE WHEN rank <= {PLAN.rerank_topn} THEN -score END, rank) AS INTEGER) AS new_rank FROM fused QUALIFY new_rank <= {PLAN.topk}",
    "dense_cosine": _dense("list_cosine_similarity(q, v)"),
    "dense_ip": _dense("list_inner_product(q, v)"),
    "dense_l2": _dense("-list_distance(q, v)"),
    "two_stage_blend": f"""SELECT topic_id, doc_id, score, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (
  SELECT topic_id, doc_id, round(CASE WHEN rank <= {DENSE.rerank_topn} THEN {DENSE.alpha}e0 * ce + {1 - DENSE.alpha}e0 * dense ELSE dense END + 1e-9, 6) AS score FROM (
    SELECT query_id AS topic_id, vec_id AS doc_id, dense, rank, CASE WHEN len(qs) = 0 THEN 0e0 ELSE len(list_intersect(qs, ts)) / CAST(len(qs) AS DOUBLE) END AS ce FROM (
      SELECT d.*, list_distinct(regexp_extract_all(lower(qtext), {W})) AS qs, list_distinct(regexp_extract_all(lower(coalesce(text, '')), {W})) AS ts FROM (
        SELECT query_id, vec_id, qtext, round(list_cosine_similarity(q, v), 6) AS dense, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, v), 6) DESC, vec_id) AS rank FROM dq, dv QUALIFY rank <= {DENSE.depth}) d
      LEFT JOIN documents ON doc_id = vec_id))) QUALIFY rank <= {DENSE.topk}""",
    "dense_grid_map": f"""SELECT depth, metric, rerank, rerank_topn, alpha, round(avg(ap), 6) AS map FROM (
  SELECT depth, metric, rerank, rerank_topn, alpha, query_id, round(coalesce(sum(CASE WHEN hit THEN so_far / CAST(r AS DOUBLE) END), 0) / any_value(relevant), 6) AS ap FROM (
    SELECT *, sum(CAST(hit AS INTEGER)) OVER (PARTITION BY depth, metric, rerank, rerank_topn, alpha, query_id ORDER BY r) AS so_far FROM (
      SELECT x.*, d.label = q.label AS hit, (SELECT count(*) FROM embeddings e WHERE e.label = q.label) AS relevant FROM (
        SELECT *, row_number() OVER (PARTITION BY depth, metric, rerank, rerank_topn, alpha, query_id ORDER BY score DESC, vec_id) AS r FROM (
          SELECT *, round(CASE WHEN rerank AND rank <= rerank_topn THEN alpha * ce + (1e0 - alpha) * dense ELSE dense END + 1e-9, 6) AS score FROM (
            SELECT b.metric, b.query_id, b.vec_id, dense, rank, CASE WHEN len(qs) = 0 THEN 0e0 ELSE len(list_intersect(qs, ts)) / CAST(len(qs) AS DOUBLE) END AS ce FROM (
              SELECT d.*, list_distinct(regexp_extract_all(lower(qtext), {W})) AS qs, list_distinct(regexp_extract_all(lower(coalesce(text, '')), {W})) AS ts FROM (
                SELECT *, row_number() OVER (PARTITION BY metric, query_id ORDER BY dense DESC, vec_id) AS rank FROM (
                  SELECT metric, query_id, vec_id, qtext, round(CASE metric WHEN 'cosine' THEN list_cosine_similarity(q, v) ELSE -list_distance(q, v) END, 6) AS dense FROM dq, dv, (SELECT unnest(['cosine', 'l2']) AS metric)) QUALIFY rank <= 60) d
              LEFT JOIN documents ON doc_id = vec_id) b),
            (SELECT unnest([20, 60]) AS depth), (SELECT unnest([false, true]) AS rerank), (SELECT 10 AS rerank_topn), (SELECT CAST(unnest([0.3, 1.0]) AS DOUBLE) AS alpha)
          WHERE rank <= depth) QUALIFY r <= 20) x
      JOIN embeddings d USING (vec_id) JOIN embeddings q ON q.vec_id = query_id))
  GROUP BY ALL) GROUP BY ALL""",
    "corpus_jsonl": r"""SELECT doc_id, sha256('{"docid":"' || doc_id || '","text":' || to_json(coalesce(text, '')) || '}') AS sha256 FROM documents""",
    "config_hash": "SELECT doc_id, p_idx, substr(sha256(doc_id || '|' || p_idx || '|' || content), 1, 20) AS key FROM psg",
    "passage_fingerprint": "SELECT doc_id, substr(sha256(string_agg(doc_id || chr(0) || p_idx || chr(0) || content, chr(10) ORDER BY p_idx)), 1, 20) AS fingerprint FROM psg GROUP BY doc_id",
    "expand_static": """SELECT topic_id, array_to_string(list_concat(words, coalesce(more, [])), ' ') AS text FROM (SELECT topic_id, list_distinct_ordered AS words FROM (
  SELECT topic_id, (SELECT list(w ORDER BY k) FROM (SELECT w, min(k) AS k FROM (SELECT unnest(string_split(lower(text), ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k) GROUP BY w)) AS list_distinct_ordered FROM topics)) b
LEFT JOIN (SELECT topic_id, list(synonym ORDER BY k0, pos) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY k0, pos) AS r FROM (
    SELECT topic_id, synonym, k0, pos FROM (
      SELECT t.topic_id, k0, s.pos, s.synonym, row_number() OVER (PARTITION BY t.topic_id, s.synonym ORDER BY k0, s.pos) AS n FROM (
        SELECT topic_id, w, min(k) AS k0 FROM (SELECT topic_id, unnest(string_split(lower(text), ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM topics) GROUP BY ALL) t
      JOIN (VALUES ('the', 0, 'that'), ('the', 1, 'this'), ('the', 2, 'those'), ('and', 0, 'with'), ('de', 0, 'des'), ('de', 1, 'du'), ('la', 0, 'le'), ('la', 1, 'les')) s(term, pos, synonym) ON s.term = t.w
      WHERE NOT EXISTS (SELECT 1 FROM topics x WHERE x.topic_id = t.topic_id AND list_contains(string_split(lower(x.text), ' '), s.synonym)))
    WHERE n = 1)) WHERE r <= 3 GROUP BY topic_id) USING (topic_id)""",
}

ORACLES = {name: with_ctes(sql) for name, sql in _PLAIN.items()}

_RUN = "SELECT topic_id, doc_id, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 1000"
_AP_HEAD = with_ctes("SELECT * FROM bm, qrels").rsplit("\n", 1)[0]
_AP_ROWS = "SELECT topic_id, round(coalesce(total / relevant, 0), 6) AS ap FROM rels LEFT JOIN prec USING (topic_id)"
ORACLES["ap_per_topic"] = _joined(_AP_HEAD, _precision(_RUN), _AP_ROWS)
ORACLES["map_at_k"] = _joined(_AP_HEAD, _precision(_RUN), f"SELECT round(coalesce(avg(ap), 0), 6) AS map FROM ({_AP_ROWS})")

_GRID = """SELECT k1, b, topic_id, doc_id, row_number() OVER (PARTITION BY k1, b, topic_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT k1, b, topic_id, doc_id, round(sum(weight * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * (k1 + 1e0) / (tf + k1 * (1e0 - b + b * dl / avgdl))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st,
    (SELECT CAST(unnest([0.6, 0.9, 1.2, 1.5, 1.8]) AS DOUBLE) AS k1), (SELECT CAST(unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS DOUBLE) AS b)
  GROUP BY k1, b, topic_id, doc_id) QUALIFY rank <= 1000"""
_GRID_ROWS = """SELECT k1, b, round(avg(ap), 6) AS map FROM (
  SELECT g.k1, g.b, g.topic_id, round(coalesce(total / relevant, 0), 6) AS ap FROM (
    SELECT k1, b, rels.* FROM rels, (SELECT CAST(unnest([0.6, 0.9, 1.2, 1.5, 1.8]) AS DOUBLE) AS k1), (SELECT CAST(unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS DOUBLE) AS b)) g
  LEFT JOIN prec ON prec.k1 = g.k1 AND prec.b = g.b AND prec.topic_id = g.topic_id) GROUP BY ALL"""
ORACLES["bm25_grid_map"] = _joined(
    with_ctes("SELECT * FROM qt, tf, df, dl, st, qrels").rsplit("\n", 1)[0], _precision(_GRID, "k1, b,"), _GRID_ROWS
)
