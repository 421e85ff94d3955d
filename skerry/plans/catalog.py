"""Named queries over the test tables, one per operator, with oracle SQL.

Roles: ``documents`` is the corpus, the first four tokens of ``benchmark.text``
are topics, a document that contains a benchmark text is relevant to it, and
``embeddings`` is the dense index.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.scores import normalize, place, place_again
from ..operators import (
    dense,
    evaluate,
    expand,
    features,
    fuse,
    judge,
    labels,
    ltr,
    passages,
    retrieve,
    scoring,
    vectorize,
)
from ..operators import index as ix

from ..operators.tables import settle, spread
from ..sources import files
from . import oracles, retrieval, sweep

#: The documented depths: the clustered plan's and the dense plan's defaults.
PLAN, DENSE = oracles.PLAN, oracles.DENSE

QUERIES: dict = {}
ORACLES: dict[str, str] = oracles.ORACLES


class Tables:
    """Shared, lazily built inputs of the queries over one directory.

    What several branches of a plan read (all bounded by topics times a depth)
    is settled in a table, so it is computed once; two queries over the same
    directory share it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        return spread(self.read("documents").select("doc_id", "text"))

    @cached_property
    def topics(self) -> DataFrame:
        words = F.slice(fx.tokenize(F.col("text")), 1, 4)
        return self.read("benchmark").select(F.col("item_id").alias("topic_id"), F.array_join(words, " ").alias("text"))

    @cached_property
    def terms(self) -> DataFrame:
        return settle(ix.query_terms(self.topics))

    @cached_property
    def index(self) -> ix.Index:
        return ix.build_index(self.docs)

    @cached_property
    def qrels(self) -> DataFrame:
        items = self.read("benchmark").select(F.col("item_id").alias("topic_id"), "text")
        return settle(judge.containing(items, self.docs))

    def run(self, topk: int, **options) -> DataFrame:
        return retrieve.search(self.topics, self.index, topk=topk, **options)

    @cached_property
    def candidates(self) -> DataFrame:
        return settle(self.run(PLAN.candidates))

    @cached_property
    def passages(self) -> DataFrame:
        return passages.extract(self.docs)

    @cached_property
    def wanted(self) -> DataFrame:
        return self.candidates.where(F.col("rank") <= PLAN.content_topk)

    @cached_property
    def wanted_passages(self) -> DataFrame:
        texts = self.docs.join(self.wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        return passages.extract(texts)

    @cached_property
    def topic_passages(self) -> DataFrame:
        return settle(passages.of_candidates(self.wanted, self.wanted_passages))

    @cached_property
    def judged_passages(self) -> DataFrame:
        """Passages of each topic's relevant candidates, ranked within their document."""
        judged = settle(self.wanted.join(self.qrels.where("rel >= 1"), ["topic_id", "doc_id"], "left_semi"))
        texts = self.docs.join(judged.select("doc_id").distinct(), "doc_id", "left_semi")
        found = passages.of_candidates(judged, passages.extract(texts))
        return settle(passages.rank_passages(found, self.topics, topk=10, stats_by=["topic_id", "doc_id"]))

    @cached_property
    def best(self) -> DataFrame:
        return settle(passages.rank_candidates(self.wanted, self.wanted_passages, self.topics, topk=PLAN.passages))

    @cached_property
    def members(self) -> DataFrame:
        return settle(retrieval.cluster_members(self.best, PLAN.threshold, PLAN.cluster_size))

    @cached_property
    def features(self) -> DataFrame:
        return settle(features.compute(self.members))

    @cached_property
    def instances(self) -> DataFrame:
        labelled = labels.cluster_labels(self.members, self.qrels, "any")
        return self.features.join(labelled, ["topic_id", "cluster_id"])

    @cached_property
    def lifted(self) -> DataFrame:
        seeds = self.members.select("topic_id", "cluster_id").distinct()
        scores = seeds.select("topic_id", "cluster_id", (1.0 / F.col("cluster_id")).alias("score"))
        return settle(fuse.rerank_passages(self.members, scores))

    @cached_property
    def fused(self) -> DataFrame:
        capped = fuse.capped_documents(self.lifted, 3, 100)
        return fuse.adaptive_fusion(self.candidates, capped, 3, 0.5, 1.0)

    @cached_property
    def items(self) -> DataFrame:
        """Passages of every document, grouped by document."""
        return self.passages.select("doc_id", F.col("p_idx").alias("i"), "content")

    @cached_property
    def item_rows(self) -> DataFrame:
        """The same in one row per document, as tokens."""
        return passages.items(passages.contents(self.docs))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"), "embedding")

    @cached_property
    def dense_queries(self) -> DataFrame:
        words = F.slice(fx.tokenize(F.col("text")), 1, 4)
        texts = self.docs.select(F.col("doc_id").alias("id"), F.array_join(words, " ").alias("text"))
        return self.vectors.where("id % 100 = 0").join(texts, "id", "left")


FEATURE_NAMES = sorted(features.FEATURES)


_LAST: dict = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Inputs over ``sf_dir``; those of the directory last used are kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Tables(spark, sf_dir)
    return _LAST[key]


def forget() -> None:
    """Build the inputs anew for the next query."""
    _LAST.clear()


def query(function):
    """Register ``function(tables)`` under its name."""
    QUERIES[function.__name__] = lambda spark, sf_dir: function(tables(spark, sf_dir))
    return function


# Collection statistics --------------------------------------------------------


@query
def tokenize_tf(t):
    return ix.term_counts(t.docs)


@query
def df_stats(t):
    df = ix.document_frequency(t.index)
    return df.crossJoin(F.broadcast(t.index.stats)).select("term", "df", "n_docs", place(F.col("avgdl")).alias("avgdl"))


@query
def bg_model(t):
    return ix.background(t.index).select("term", "cf", F.round("p", 9).alias("p"))


@query
def vocabulary(t):
    return ix.vocabulary(t.index.postings(), t.docs.count(), 2, 0.5, 500)


# Lexical retrieval ----------------------------------------------------------------


@query
def bm25_topk(t):
    return t.run(10)


@query
def qld_topk(t):
    return t.run(10, model="qld")


@query
def bm25_qld_mix(t):
    return t.run(10, model="bm25+qld")


@query
def rm3_terms(t):
    unit = settle(scoring.unit_terms(t.terms))
    first = scoring.best_bm25(unit, t.index, [(0.9, 0.4)], 10)
    found = scoring.rm3_terms(unit, t.index, first, fb_terms=20, fb_docs=10)
    return found.select("topic_id", "term", place(F.col("weight")).alias("weight"))


@query
def rm3_topk(t):
    return t.run(20, model="bm25+rm3", rm3={"fb_terms": 20, "fb_docs": 10})


@query
def qld_rm3_topk(t):
    return t.run(10, model="qld+rm3", rm3={"fb_terms": 10, "fb_docs": 10})


#: Synonyms of words of the test corpus.
TEST_SYNONYMS = {"the": ["that", "this", "those"], "and": "with", "de": ["des", "du"], "la": ["le", "les"]}


@query
def expand_static(t):
    table = expand.synonym_table(t.spark, TEST_SYNONYMS)
    return expand.expand_text(t.topics, table, max_terms=3)


@query
def split_topics(t):
    return retrieve.split_topics(t.topics, "test", 10)


@query
def augment_candidates(t):
    return retrieve.augment(t.candidates, t.qrels).select("topic_id", "doc_id", "score", "rank")


@query
def judged_docs(t):
    found = retrieve.judged_docs(t.qrels, t.docs, 2)
    return found.select("topic_id", "doc_id", "rank", F.length("text").alias("n_chars"))


@query
def content_attach(t):
    found = retrieve.with_text(t.candidates, t.docs, 5)
    return found.select("topic_id", "doc_id", "rank", F.length("text").alias("n_chars"))


@query
def neg_pool(t):
    return retrieve.negative_pool(t.candidates, t.qrels).select("topic_id", "doc_id", "rank")


@query
def doc_text_fetch(t):
    """Stored text with its fall-backs, from JSON properties and raw strings."""
    events = t.read("events").select("event_id", "event_type", "props")
    contents = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).when(F.col("event_id") % 4 == 1, "")
    wrapped = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("raw"))))
    raw = F.when(F.col("event_id") % 5 != 0, F.coalesce(wrapped, F.col("props")))
    return events.select("event_id", fx.stored_text(contents, raw).alias("text"))


# Evaluation -------------------------------------------------------------------------


@query
def qrels_max(t):
    line = F.concat_ws(" ", F.col("l_orderkey") % 50, F.lit(0), F.col("l_partkey") % 200, F.col("l_linenumber") % 3)
    return files.parse_qrels(t.read("lineitem").select(line.alias("value")), check=False)


@query
def run_load_dedup(t):
    line = F.concat_ws(
        "\t", F.col("l_orderkey") % 20, F.lit("Q0"), F.col("l_partkey") % 300,
        F.col("l_suppkey") * 10 + F.col("l_linenumber"), F.col("l_quantity"), F.lit("x"),
    )
    return files.parse_run(t.read("lineitem").select(line.alias("value")), k=100, check=False)


@query
def trec_lines(t):
    return files.run_lines(t.candidates, "base", 10)


@query
def ap_per_topic(t):
    return evaluate.average_precision(t.run(1000), t.qrels, 1000)


@query
def map_at_k(t):
    return evaluate.mean_average_precision(t.run(1000), t.qrels, 1000)


@query
def bm25_grid_map(t):
    run = evaluate.bm25_sweep(t.topics, t.index, [0.6, 0.9, 1.2, 1.5, 1.8], [0.1, 0.3, 0.5, 0.7, 0.9], 1000)
    return evaluate.mean_average_precision(run, t.qrels, 1000, ["k1", "b"])


@query
def kfold(t):
    return evaluate.topic_folds(t.topics, 5)


@query
def neg_sample(t):
    return evaluate.training_pairs(t.candidates, t.qrels)


# Passages -----------------------------------------------------------------------------


@query
def sentences(t):
    return t.docs.select("doc_id", F.posexplode(fx.sentences(F.col("text"))).alias("s_idx", "sentence"))


@query
def passage_rows(t):
    return t.passages


@query
def per_doc_first_k(t):
    return passages.first_k(t.topic_passages, 2).select("topic_id", "doc_id", "p_idx")


@query
def per_doc_overlap(t):
    return passages.best_overlap(t.topic_passages, t.topics, 2).select("topic_id", "doc_id", "p_idx", "overlap")


@query
def passage_bm25(t):
    return t.best.select("topic_id", "doc_id", "p_idx", "score", "p_rank")


@query
def passage_rm3(t):
    found = passages.rank_candidates(t.wanted, t.wanted_passages, t.topics, model="bm25+rm3", topk=PLAN.passages)
    return found.select("topic_id", "doc_id", "p_idx", "score", "p_rank")


@query
def passage_qld(t):
    found = passages.rank_passages(t.topic_passages, t.topics, model="qld", topk=PLAN.passages, matching_only=False)
    return found.select("topic_id", "doc_id", "p_idx", "score", "p_rank")


@query
def passage_pseudo_topk(t):
    return labels.pseudo_relevant(t.judged_passages, t.qrels, 2).select("topic_id", "doc_id", "p_idx", "score", "p_rank")


# Vectors, pairs and clusters ------------------------------------------------------------


@query
def ngrams(t):
    grams = F.explode(fx.ngrams(fx.tokenize(F.col("text")), 1, 2)).alias("gram")
    return t.topics.select("topic_id", grams).groupBy("topic_id", "gram").agg(F.count("*").alias("n"))


@query
def tfidf_vectors(t):
    items = t.best.select("topic_id", F.col("p_rank").alias("i"), "content")
    found = vectorize.tfidf(items, ["topic_id"], low=1, high=2, min_df=2, max_df=0.9)
    return found.select("topic_id", "i", "term", place(F.col("w")).alias("w"))


@query
def lm_vectors(t):
    return vectorize.unigram_lm(t.items, ["doc_id"]).select("doc_id", "i", "term", place(F.col("w")).alias("w"))


@query
def cosine_pairs(t):
    return vectorize.row_similarities(t.item_rows, "doc_id", "tfidf", "cosine")


@query
def dot_pairs(t):
    return vectorize.row_similarities(t.item_rows, "doc_id", "tfidf", "dot")


@query
def jaccard_pairs(t):
    return vectorize.row_similarities(t.item_rows, "doc_id", "token_set", "jaccard")


@query
def kl_pairs(t):
    items = t.best.select("topic_id", F.col("p_rank").alias("i"), "content")
    return vectorize.pair_similarities(items, ["topic_id"], "lm", "kl")


@query
def similarity_edges(t):
    pairs = vectorize.row_similarities(t.item_rows, "doc_id", "tfidf", "cosine")
    return vectorize.edges(pairs, ["doc_id"], 0.1)


@query
def clusters(t):
    return t.members.select("topic_id", "cluster_id", "pos", "p_rank")


def _feature_query(short: str, name: str) -> None:
    def run(t):
        values = features.FEATURES[name](t.members)
        return values.select("topic_id", "cluster_id", place(F.col("value")).alias("value"))

    run.__name__ = f"feat_{short}"
    query(run)


for _short, _name in oracles.FEATURE_SHORT.items():
    _feature_query(_short, _name)


@query
def cluster_features(t):
    return t.features


@query
def cluster_labels_any(t):
    return labels.cluster_labels(t.members, t.qrels, "any")


@query
def cluster_labels_density(t):
    return labels.cluster_labels(t.members, t.qrels, "top_weighted_density", high=0.5, low=0.2)


@query
def cluster_labels_best(t):
    return labels.cluster_labels(t.members, t.qrels, "best_evidence", high=3, low=15)


@query
def cluster_labels_pseudo(t):
    chosen = labels.pseudo_relevant(t.judged_passages, t.qrels, 2).select("topic_id", "doc_id", "p_idx")
    marked = t.best.join(chosen, ["topic_id", "doc_id", "p_idx"], "left_semi").select("topic_id", "p_rank")
    return labels.cluster_labels(t.members, t.qrels, "pseudo", high=2, low=1, pseudo=marked)


def _document_query(how: str) -> None:
    def run(t):
        return labels.document_instances(t.candidates, t.members, t.features, t.qrels, how)

    run.__name__ = f"doc_level_features_{how}"
    query(run)


for _how in ("max", "sum", "mean"):
    _document_query(_how)


# Learning to rank ---------------------------------------------------------------------------


def _scaled(t: Tables, mode: str) -> DataFrame:
    scaler = ltr.fit_scaler(t.features, FEATURE_NAMES, mode)
    scaled = ltr.apply_scaler(t.features, scaler, FEATURE_NAMES)
    return scaled.select("topic_id", "cluster_id", *(place_again(F.col(n)).alias(n) for n in FEATURE_NAMES))


@query
def scale_minmax(t):
    return _scaled(t, "minmax")


@query
def scale_zscore(t):
    return _scaled(t, "zscore")


def _published(t: Tables) -> DataFrame:
    score = ltr.linear_score(list(ltr.PUBLISHED), FEATURE_NAMES)
    return t.features.select("topic_id", "cluster_id", score.alias("score"))


@query
def svm_score_published(t):
    return _published(t)


@query
def norm_scores(t):
    both = _published(t).withColumns(
        {
            "minmax": F.round(normalize(F.col("score"), "minmax", ["topic_id"]), 5),
            "zscore": F.round(normalize(F.col("score"), "zscore", ["topic_id"]), 5),
        }
    )
    return both.select("topic_id", "cluster_id", "minmax", "zscore")


@query
def cluster_blend(t):
    scored = _published(t).withColumnRenamed("score", "svm")
    return fuse.blend_clusters(scored, 0.5, "minmax")


@query
def swapped_pairs(t):
    labelled = labels.cluster_labels(t.members, t.qrels, "any")
    return ltr.swapped_pairs(_published(t).join(labelled, ["topic_id", "cluster_id"]))


@query
def svmrank_lines(t):
    return ltr.learning_lines(t.instances, FEATURE_NAMES, "cluster_id")


@query
def ranksvm_train(t):
    model = ltr.train_ranksvm(settle(t.instances), FEATURE_NAMES)
    rows = list(zip(model.names, model.weights))
    return t.spark.createDataFrame(rows, "feature string, weight double")


@query
def linear_svc(t):
    rows = t.read("documents").join(t.read("labels"), "doc_id").select(
        F.col("doc_id").alias("topic_id"), F.col("quality").alias("label"),
        F.log1p("n_chars").alias("length"), F.size(fx.sentences(F.col("text"))).cast("double").alias("sentences"),
        (F.size(F.array_distinct(fx.tokenize(F.col("text")))) / (F.size(fx.tokenize(F.col("text"))) + 1)).alias("distinct"),
    )
    model = ltr.train_linear_svc(settle(rows), ["distinct", "length", "sentences"])
    return t.spark.createDataFrame([*zip(model.names, model.weights), ("bias", model.bias)], "feature string, weight double")


# Fusion -------------------------------------------------------------------------------------


@query
def passage_rerank(t):
    return t.lifted.withColumn("score", place(F.col("score")))


@query
def rrf_docs(t):
    return fuse.rrf_documents(t.lifted, 60, 20)


@query
def rr_capped_docs(t):
    capped = fuse.capped_documents(t.lifted, 3, 100)
    return capped.select("topic_id", "doc_id", place(F.col("passage_score")).alias("passage_score"), "used")


@query
def adaptive_fusion(t):
    return t.fused


@query
def head_tail(t):
    return fuse.head_tail(t.fused, PLAN.rerank_topn, PLAN.topk)


@query
def clustered_run(t):
    """The whole clustered plan with feedback and seed scores."""
    return retrieval.clustered(t.topics, t.docs, PLAN)


# Dense --------------------------------------------------------------------------------------


@query
def dense_cosine(t):
    return dense.exact_topk(t.vectors, t.dense_queries, 20, "cosine")


@query
def dense_ip(t):
    return dense.exact_topk(t.vectors, t.dense_queries, 20, "ip")


@query
def dense_l2(t):
    return dense.exact_topk(t.vectors, t.dense_queries, 20, "l2")


@query
def two_stage_blend(t):
    return retrieval.two_stage(t.dense_queries, t.vectors, t.docs, DENSE)


@query
def dense_grid_map(t):
    """Sweep of the dense plan; vectors of a query's label are relevant to it.

    Judgments are looked up for the candidates only: a label may hold a large
    share of all vectors, so its pairs are counted, not listed.
    """
    runs = settle(
        sweep.dense_runs(
            t.dense_queries, t.vectors, t.docs, metrics=["cosine", "l2"], depths=[20, 60], reranks=[False, True],
            topns=[10], alphas=[0.3, 1.0], topk=20,
        )
    )
    label = t.read("embeddings").select("vec_id", "label")
    asked = t.dense_queries.select(F.col("id").alias("vec_id")).join(label, "vec_id")
    counts = label.groupBy("label").agg(F.count("*").alias("relevant"))
    totals = asked.join(counts, "label").select(F.col("vec_id").alias("topic_id"), "relevant")
    own = asked.select(F.col("vec_id").alias("topic_id"), F.col("label").alias("wanted"))
    found = runs.select("topic_id", "doc_id").distinct().join(own, "topic_id")
    found = found.join(label.withColumnRenamed("vec_id", "doc_id"), "doc_id").where("label = wanted")
    qrels = found.select("topic_id", "doc_id", F.lit(1).alias("rel"))
    return evaluate.mean_average_precision(runs, qrels, 20, list(sweep.SETTINGS), totals)


@query
def ltr_cross_validation(t):
    """Swapped preferences of cluster models on topics they haven't seen."""
    return sweep.cross_validate(settle(t.instances), FEATURE_NAMES, 2)


@query
def dense_lsh(t):
    return dense.lsh_topk(t.vectors, t.dense_queries.select("id", "embedding"), 10)


# Files --------------------------------------------------------------------------------------


@query
def corpus_jsonl(t):
    """Compact JSON lines, compared by their hash."""
    lines = files.corpus_lines(t.docs)
    return lines.select("doc_id", F.sha2("line", 256).alias("sha256"))


@query
def config_hash(t):
    """Content keys of the passages of each document."""
    key = F.substring(F.sha2(F.concat_ws("|", "doc_id", "p_idx", "content"), 256), 1, 20)
    return t.passages.select("doc_id", "p_idx", key.alias("key"))


@query
def passage_fingerprint(t):
    return files.fingerprint(t.passages, ["doc_id"])


