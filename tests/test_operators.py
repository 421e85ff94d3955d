"""Operators on small hand-computed frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skerry.functions import scores, vectors
from skerry.functions import text as fx
from skerry.operators import evaluate, expand, fuse, ltr, passages, retrieve, scoring, vectorize
from skerry.operators import index as ix
from skerry.sources import files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize("bad", ["no tab", "\ttext", "1\t ", "x\ttext"])
def test_topics_rejected(spark, bad):
    with pytest.raises(ValueError):
        files.parse_topics(lines(spark, bad))


def test_topics(spark):
    found = files.parse_topics(lines(spark, "2\tb c\td", "1\ta", "")).orderBy("topic_id").collect()
    assert [tuple(r) for r in found] == [(1, "a"), (2, "b c\td")]
    with pytest.raises(ValueError):
        files.parse_topics(lines(spark, "1\ta", "1\tb"))


def test_qrels_and_run(spark):
    q = files.parse_qrels(lines(spark, "1 0 d1 0", "1 0 d1 2", "1 0 d2 1")).orderBy("doc_id").collect()
    assert [tuple(r) for r in q] == [(1, "d1", 2), (1, "d2", 1)]
    run = files.parse_run(lines(spark, "1 Q0 d1 2 .5 t", "1 Q0 d2 1 .1 t", "1 Q0 d1 3 .4 t")).orderBy("rank").collect()
    assert [r.doc_id for r in run] == ["d2", "d1"]
    with pytest.raises(ValueError):
        files.parse_qrels(lines(spark, "1 0 d1"))
    with pytest.raises(ValueError):
        files.parse_run(lines(spark, "1 Q0 d1 x .5 t"))


def test_average_precision(spark):
    run = frame(spark, [(1, "a", 1), (1, "x", 2), (1, "b", 3)], "topic_id int, doc_id string, rank int")
    qrels = frame(spark, [(1, "a", 1), (1, "b", 1), (1, "c", 1), (2, "z", 0)], "topic_id int, doc_id string, rel int")
    ap = {r.topic_id: r.ap for r in evaluate.average_precision(run, qrels).collect()}
    assert ap == {1: 0.555556, 2: 0.0}
    assert evaluate.mean_average_precision(run, qrels).first()[0] == pytest.approx(0.277778)


def test_sentences_and_windows(spark):
    df = frame(spark, [("A b. C d! E? F",), ("",), ("  ",), (None,)], "text string")
    assert [len(r[0]) for r in df.select(fx.sentences(F.col("text"))).collect()] == [4, 0, 0, 0]

    def loop(n, size, least, overlap):
        """One sentence at a time, keeping the overlap of every full window."""
        held, out = [], []
        keep = min(overlap, size)
        for s in range(n):
            held.append(s)
            if len(held) == size:
                out.append(list(held))
                held = held[size - keep :] if keep < size else []
                fresh = 0
            else:
                fresh = 1
        if n and (fresh or not out) and len(held) >= least:
            out.append(held)
        return out

    ns = frame(spark, [(n,) for n in range(1, 31)], "n int")
    sents = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i.cast("string"))
    got = {r[0]: r[1] for r in ns.select("n", fx.passage_windows(sents, 10, 3, 2)).collect()}
    for n, windows in got.items():
        want = [" ".join(map(str, w)) for w in loop(n, 10, 3, 2)]
        assert windows == want, n


def test_bm25_and_qld(spark):
    docs = frame(spark, [(1, "cat dog"), (2, "bird fish"), (3, None)], "doc_id long, text string")
    index = ix.build_index(docs.where("doc_id < 3"))
    terms = frame(spark, [(7, "cat", 1.0)], "topic_id int, term string, weight double")
    row = scoring.bm25_scores(terms, index).first()
    assert (row.doc_id, row.score) == (1, pytest.approx(math.log(2), abs=1e-6))
    assert scoring.qld_scores(terms, index).first().score == pytest.approx(math.log((1 + 1000 * 0.25) / 1002), abs=1e-6)
    with pytest.raises(ValueError):
        scoring.bm25_scores(terms, index, k1=0)
    with pytest.raises(ValueError):
        scoring.qld_scores(terms, index, mu=0)


def test_search_ties_blank_and_models(spark):
    docs = frame(spark, [(3, "x y"), (1, "x y"), (2, "z")], "doc_id long, text string")
    topics = frame(spark, [(1, "x"), (2, "  ")], "topic_id int, text string")
    found = retrieve.search(topics, ix.build_index(docs), topk=5).orderBy("rank").collect()
    assert [(r.topic_id, r.doc_id, r.rank) for r in found] == [(1, 1, 1), (1, 3, 2)]
    with pytest.raises(ValueError):
        retrieve.search(topics, ix.build_index(docs), model="nope")


def test_normalisation(spark):
    df = frame(spark, [(1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0)], "topic_id int, s double")
    for mode in ("minmax", "zscore"):
        got = [tuple(r) for r in df.select("topic_id", scores.normalize(F.col("s"), mode, ["topic_id"])).collect()]
        assert [v for t, v in got if t == 1] == [0.0, 0.0]
        assert [v for t, v in got if t == 2] == ([0.0, 1.0] if mode == "minmax" else [-1.0, 1.0])


def test_vectors(spark):
    df = spark.range(1)
    empty, some = F.array().cast("array<string>"), F.array(F.lit("a"))
    row = df.select(
        vectors.jaccard(empty, some),
        vectors.kl_similarity(F.create_map().cast("map<string,double>"), F.create_map().cast("map<string,double>")),
        scores.adaptive_lambda(F.lit(2), 4, 0.5, 1.0),
        fx.six_places(F.lit(0.0078125)),
        fx.overlap_count(F.array(*map(F.lit, "aab")), F.array(F.lit("a"))),
    ).first()
    assert tuple(row) == (0.0, 0.0, 0.75, "0.007812", 2)


def test_clusters(spark):
    items = frame(spark, [(1, 1, "a b"), (1, 2, "a b"), (1, 3, "c")], "topic_id int, i int, content string")
    pairs = vectorize.pair_similarities(items, ["topic_id"], "tfidf", "cosine")
    got = vectorize.clusters(items, pairs, ["topic_id"], 0.5, 5).orderBy("cluster_id", "pos").collect()
    assert [(r.cluster_id, r.i) for r in got] == [(1, 1), (1, 2), (2, 2), (2, 1), (3, 3)]
    with pytest.raises(TypeError):
        vectorize.pair_similarities(items, ["topic_id"], "token_set", "cosine")
    with pytest.raises(NotImplementedError):
        vectorize.clusters(items, pairs, ["topic_id"], 0.5, 5, "kmeans")


def test_fusion(spark):
    rows = [(1, "d", 0, 1), (1, "d", 1, 2), (1, "d", 2, 3)]
    df = frame(spark, rows, "topic_id int, doc_id string, p_idx int, new_rank int")
    row = fuse.capped_documents(df, 2, 100).first()
    assert (row.used, row.passage_score) == (2, pytest.approx(1 / 101 + 1 / 102))


def test_swapped_and_scaler(spark):
    df = frame(spark, [(1, 2, 1.0), (1, 1, 1.0), (1, 0, 0.0), (2, 1, 0.0)], "topic_id int, label int, score double")
    got = {r.topic_id: (r.pairs, r.swapped, r.fraction) for r in ltr.swapped_pairs(df).collect()}
    assert got == {1: (3, 1, 0.333333), 2: (0, 0, 0.0)}
    scaler = ltr.fit_scaler(df.withColumn("c", F.lit(3.0)), ["c"], "minmax")
    assert ltr.apply_scaler(df.withColumn("c", F.lit(3.0)), scaler, ["c"]).first()["c"] == 0.0


def test_ranksvm_objective(spark):
    import numpy as np

    rng = random.Random(5)
    rows = [(t, rng.choice([0, 1, 2]), rng.random(), rng.random()) for t in range(4) for _ in range(12)]
    df = frame(spark, rows, "topic_id int, label int, a double, b double")
    model = ltr.train_ranksvm(df, ["a", "b"], scaling="none", rounds=40)
    d = np.array([[x[2] - y[2], x[3] - y[3]] for x in rows for y in rows if x[0] == y[0] and x[1] > y[1]])

    def objective(w):
        return w @ w / 2 + np.maximum(0, 1 - d @ w).sum() / 4

    w = np.zeros(2)
    best = objective(w)
    for k in range(20000):
        g = w - d[d @ w < 1].sum(axis=0) / 4
        w = w - g / (k + 10)
        best = min(best, objective(w))
    assert objective(np.array(model.weights)) <= best * 1.01
    flat = ltr.train_ranksvm(df.withColumn("label", F.lit(1)), ["a", "b"])
    assert flat.weights == (0.0, 0.0)


def test_expand(spark):
    topics = frame(spark, [(1, "Ship ship aircraft")], "topic_id int, text string")
    table = expand.synonym_table(spark, {"ship": "boat"})
    assert expand.expand_text(topics, table, max_terms=2).first().text == "ship aircraft boat plane"
    assert expand.expand_text(topics, table, enabled=False).first().text == "Ship ship aircraft"


def test_augment_and_passage_filters(spark):
    hits = frame(spark, [(1, 5, 0.5, 1)], "topic_id int, doc_id long, score double, rank int")
    qrels = frame(spark, [(1, 9, 1), (1, 5, 1), (1, 7, 0)], "topic_id int, doc_id long, rel int")
    got = retrieve.augment(hits, qrels).orderBy("rank").collect()
    assert [(r.doc_id, r.score, r.rank) for r in got] == [(5, 0.5, 1), (7, None, 2), (9, None, 3)]
    p = frame(spark, [(1, 5, 0, "a"), (1, 5, 1, "b b"), (1, 5, 2, "b")], "topic_id int, doc_id long, p_idx int, content string")
    topics = frame(spark, [(1, "b")], "topic_id int, text string")
    assert [r.p_idx for r in passages.best_overlap(p, topics, 2).orderBy("p_idx").collect()] == [1, 2]
    assert [r.p_idx for r in passages.first_k(p, 1).collect()] == [0]


def test_file_round_trips(spark, tmp_path):
    docs = frame(spark, [("d1", 'a "b"'), ("d2", None)], "doc_id string, text string")
    files.write_corpus(docs, str(tmp_path / "corpus"))
    got = sorted(map(tuple, files.read_corpus(spark, str(tmp_path / "corpus")).collect()))
    assert got == [("d1", 'a "b"'), ("d2", "")]
    run = frame(spark, [(1, "d2", 0.5), (1, "d1", 0.5)], "topic_id int, doc_id string, score double")
    files.write_run(run, str(tmp_path / "run"), "tag")
    assert [r.doc_id for r in files.read_run(spark, str(tmp_path / "run")).orderBy("rank").collect()] == ["d1", "d2"]
    with pytest.raises(ValueError):
        files.write_run(run.withColumn("doc_id", F.lit("a b")), str(tmp_path / "bad"), "tag")
    row = files.parse_learning_lines(lines(spark, "2 qid:3 1:0.5 4:1.25 # x")).first()
    assert (row.label, row.qid, row.features, row["item"]) == (2.0, 3, {1: 0.5, 4: 1.25}, "x")
    assert files.parse_linear_model("head\n" + files.model_text([1.5, -2.0])) == {1: 1.5, 2: -2.0}


def test_stream(spark, tmp_path):
    from skerry.streaming.search import score_stream

    docs = frame(spark, [(1, "cat dog"), (2, "bird fish")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    index = ix.build_index(docs)
    topics = frame(spark, [(7, "cat")], "topic_id int, text string")
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    scored = score_stream(stream, topics, ix.document_frequency(index), index.stats)
    q = scored.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.topic_id, r.doc_id) for r in spark.sql("SELECT * FROM scored").collect()] == [(7, 1)]
