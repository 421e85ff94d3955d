"""Dense search in blocks, sweeps, lexicon expansion and the command line."""

import math
import random
import zipfile

import pytest

from skerry import cli
from skerry.operators import dense, evaluate, expand, passages, vectorize
from skerry.plans import sweep


def table(spark, n, dim=8, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(10)]
    rows = [(k, [c + rng.gauss(0, 0.3) for c in centres[k % 10]]) for k in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


@pytest.mark.parametrize("metric", dense.METRICS)
def test_blocks_agree_with_brute_force(spark, metric):
    v = table(spark, 300)
    q = v.where("id % 10 = 0")
    rows = {r.id: r.embedding for r in v.collect()}

    def score(a, b):
        if metric == "l2":
            return -math.dist(a, b)
        dot = sum(x * y for x, y in zip(a, b))
        return dot if metric == "ip" else dot / math.hypot(*a) / math.hypot(*b)

    want = set()
    for i in range(0, 300, 10):
        best = sorted((-round(score(rows[i], w), 6), j) for j, w in rows.items() if j != i)[:4]
        want |= {(i, j, k) for k, (_, j) in enumerate(best, 1)}
    for options in ({}, {"block_rows": 7, "shard_rows": 64}):
        got = dense.exact_topk(v, q, 4, metric, True, **options).collect()
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want


def test_dense_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [])], "id long, embedding array<float>")
    assert [r.vec_id for r in dense.exact_topk(v, v, 5).collect()] == [1]
    assert dense.exact_topk(v.where("id > 1"), v, 5).collect() == []
    assert dense.exact_topk(v, v, 0).collect() == []
    with pytest.raises(ValueError):
        dense.exact_topk(v, v, 5, "nope")


def test_lsh_recall(spark):
    v = table(spark, 600)
    q = v.where("id % 20 = 0")
    want = {(r.query_id, r.vec_id) for r in dense.exact_topk(v, q, 10).collect()}
    got = {(r.query_id, r.vec_id) for r in dense.lsh_topk(v, q, 10).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_kl_pairs(spark):
    texts = {1: "a b b c", 2: "a b d", 3: "", 4: "z z y", 5: "b b a c", 6: ".."}
    items = spark.createDataFrame([(1, i, t) for i, t in texts.items()], "topic_id int, i int, content string")

    def similarity(x, y, eps=1e-9):
        keys = sorted({*x, *y})
        if not keys:
            return 0.0
        p, q = ([(s.count(k) / len(s) if s else 0) + eps for k in keys] for s in (x, y))
        p, q = [v / sum(p) for v in p], [v / sum(q) for v in q]
        return math.exp(-sum((a - b) * math.log(a / b) for a, b in zip(p, q)) / 2)

    words = {i: t.replace(".", "").split() for i, t in texts.items()}
    got = vectorize.kl_pairs(items, ["topic_id"]).collect()
    assert len(got) == 15
    for r in got:
        assert r.sim == pytest.approx(similarity(words[r.a], words[r.b]), abs=2e-6)


def test_lexicon(spark):
    nouns = spark.createDataFrame([("Ship",), ("tax",)], "term string")
    rows = [
        ("ship", 1, 0, "ship"), ("ship", 1, 1, "vessel"), ("ship", 2, 0, "Boat"), ("ship", 2, 1, "vessel"),
        ("ship", 3, 0, "sea_craft"), ("ship", 3, 1, "craft"), ("ship", 4, 0, "hull"), ("law", 1, 0, "rule"),
    ]
    lexicon = spark.createDataFrame(rows, "term string, sense int, lemma_no int, lemma string")
    got = sorted(map(tuple, expand.lexicon_synonyms(nouns, lexicon, lemmas=5).collect()))
    assert got == [("ship", 0, "vessel"), ("ship", 1, "boat"), ("ship", 2, "craft")]
    assert expand.lexicon_synonyms(nouns, lexicon, senses=1).count() == 1


def test_sweep_and_cross_validation(spark):
    v = table(spark, 60)
    q = v.where("id < 3").selectExpr("id", "embedding", "'a b' AS text")
    docs = v.selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'a b' END AS text")
    qrels = v.selectExpr("0L AS topic_id", "id AS doc_id", "1 AS rel").where("doc_id % 10 = 0")
    maps = sweep.dense_sweep(
        q, v, docs, qrels, depths=[5, 20], reranks=[False, True], topns=[4], alphas=[0.5], topk=10
    )
    rows = evaluate.best_settings(maps, list(sweep.SETTINGS)).collect()
    assert len(rows) == 4 and all(rows[k].map >= rows[k + 1].map for k in range(3))
    plain = dense.exact_topk(v, q, 10).selectExpr("query_id AS topic_id", "vec_id AS doc_id", "score", "rank")
    assert {r.map for r in rows if not r.rerank} == {evaluate.mean_average_precision(plain, qrels, 10).first()[0]}

    data = spark.createDataFrame([(t, i % 2, float(i % 2)) for t in range(6) for i in range(4)], "topic_id int, label int, a double")
    folds = sweep.cross_validate(data, ["a"], 3).collect()
    assert sum(r.topics for r in folds) == 6 and all(r.swapped == 0 and r.pairs == 4 * r.topics for r in folds)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "topics").write_text("1\tcat\n2\tdog\n")
    (tmp_path / "qrels").write_text("1 0 d1 1\n2 0 d2 1\n")
    sentence = "A cat sat. It ran. The cat slept. "
    lines = [f'{{"docid":"d1","text":"{sentence * 3}"}}', f'{{"docid":"d2","text":"{sentence.replace("cat", "dog") * 3}"}}']
    (tmp_path / "corpus").write_text("\n".join(lines))

    def at(name):
        return str(tmp_path / name)

    common = ["--topics", at("topics"), "--corpus", at("corpus")]
    for plan in ("bm25", "clustered"):
        assert cli.main(["run", "--plan", plan, "--split", "all", "--output", at(plan), *common], spark) == 0
    assert cli.main(["eval", "--run", at("bm25"), "--qrels", at("qrels"), "--per-topic"], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["MAP@1000: 1.000000", "1\t1.000000", "2\t1.000000"]
    assert cli.main(["grid", "--k1", "0.9", "--b", "0.4", "0.7", "--qrels", at("qrels"), "--output", at("grid"), *common], spark) == 0
    found = spark.read.option("header", True).csv(at("grid"))
    assert found.columns == ["k1", "b", "map@1000"] and found.count() == 2
    assert cli.main(["pack", "--output", at("runs.zip"), at("bm25"), at("clustered")]) == 0
    with zipfile.ZipFile(at("runs.zip")) as z:
        assert sorted(z.namelist()) == ["bm25", "clustered"]
        assert z.read("bm25").decode().splitlines()[0].split()[:4] == ["1", "Q0", "d1", "1"]
    for bad in (["run", "--output", "x"], ["run", "--train-model", "--output", "x", *common, "--qrels", "q"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    assert cli.flag("Yes") and not cli.flag("off")


def test_passage_feedback(spark):
    texts = {("d1", 0): "cat purr purr", ("d1", 1): "cat purr", ("d2", 0): "purr milk", ("d3", 0): "dog bark"}
    rows = spark.createDataFrame([(1, d, p, 1, c) for (d, p), c in texts.items()], "topic_id int, doc_id string, p_idx int, doc_rank int, content string")
    topics = spark.createDataFrame([(1, "cat"), (2, "")], "topic_id int, text string")
    plain = passages.rank_passages(rows, topics, topk=10).collect()
    assert {(r.doc_id, r.p_idx) for r in plain} == {("d1", 0), ("d1", 1)}
    options = {"fb_terms": 2, "fb_docs": 2, "original_weight": 0.5}
    found = passages.rank_passages(rows, topics, model="bm25_rm3", rm3=options, topk=10).collect()
    assert {(r.doc_id, r.p_idx) for r in found} == {("d1", 0), ("d1", 1), ("d2", 0)}
    own = passages.rank_passages(rows, topics, model="rm3", rm3=options, stats_by=["topic_id", "doc_id"], topk=1).collect()
    assert [(r.doc_id, r.p_rank) for r in own] == [("d1", 1)]
    for bad in ({"fb_terms": 0}, {"original_weight": 1.5}):
        with pytest.raises(ValueError):
            passages.rank_passages(rows, topics, model="rm3", rm3=bad)
    assert passages.rank_passages(rows.where("false"), topics, model="rm3").count() == 0


def test_short_items_are_judged(spark):
    from skerry.operators import judge

    texts = ["say hello world now", "hello", "", None, "a é b", "worlds apart; hello worlds"]
    items = ["hello world", "hello", "", None, "é", "lo", "say hello world now", "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "topic_id long, text string")
    got = {(r.topic_id, r.doc_id) for r in judge.containing(asked, docs).collect()}
    assert got == {(t, d) for t, i in enumerate(items) for d, x in enumerate(texts) if i is not None and x is not None and i in x}


def test_folds_and_negatives(spark):
    from skerry.operators import evaluate

    topics = spark.createDataFrame([(k,) for k in range(11)], "topic_id long")
    folds = {r.topic_id: r.fold for r in evaluate.topic_folds(topics, 3).collect()}
    sizes = [list(folds.values()).count(k) for k in range(3)]
    assert set(folds) == set(range(11)) and sorted(sizes) == [3, 4, 4]
    assert folds == {r.topic_id: r.fold for r in evaluate.topic_folds(topics, 3).collect()}
    hits = spark.createDataFrame([(t, d, d) for t in (1, 2) for d in range(5)], "topic_id long, doc_id long, rank long")
    qrels = spark.createDataFrame([(1, 0, 1), (1, 9, 1), (2, 1, 0), (2, 2, 2)], "topic_id long, doc_id long, rel int")
    rows = [tuple(r) for r in evaluate.training_pairs(hits, qrels, negatives=3).collect()]
    assert sorted(r[:2] for r in rows if r[2] == 1) == [(1, 0), (1, 9), (2, 2)]
    negative = [r[:2] for r in rows if r[2] == 0]
    assert len(negative) == 9 and {d for t, d in negative if t == 1} <= {1, 2, 3, 4} and {d for t, d in negative if t == 2} <= {0, 1, 3, 4}


def test_linear_svc_separates(spark):
    from skerry.operators import ltr

    rows = [(k, int(k % 3 == 0), float(k % 3 == 0) * 2 + (k % 7) / 10, float(k % 5)) for k in range(120)]
    data = spark.createDataFrame(rows, "topic_id long, label int, near double, far double")
    model = ltr.train_linear_svc(data, ["far", "near"])
    scored = model.score(data).join(data.select("topic_id", "label"), "topic_id").collect()
    assert all((r.score > 0) == (r.label == 1) for r in scored)


def test_files_of_ids_and_vectors(spark, tmp_path):
    from skerry.sources import files

    path = tmp_path / "ids.txt"
    path.write_text("a\n\n b \n")
    assert sorted(r.doc_id for r in files.read_ids(spark, str(path)).collect()) == ["a", "b"]
    assert files.count_lines(spark, str(path)) in (2, 3)
    assert len(files.file_hashes(spark, str(path)).first().sha256) == 64
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.cached(spark, str(tmp_path), "three", make).count() == 3
    assert made == [1]
    good = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "doc_id string, embedding array<double>")
    assert files.check_embeddings(good).count() == 2
    with pytest.raises(ValueError):
        files.check_embeddings(good.unionByName(good))


def test_lsh_hands_on_only_the_best(spark):
    """Crowded buckets: no pair of a bucket leaves a task but a query's best."""
    import math as m

    v = table(spark, 900).repartition(3)
    q = v.where("id % 30 = 0")
    found = dense.lsh_topk(v, q, 5)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.id: r.embedding for r in v.collect()}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / m.hypot(*a) / m.hypot(*b)

    got = {(r.query_id, r.vec_id): r.score for r in found.collect()}
    assert len(got) == 5 * 30 and all(abs(s - cosine(rows[a], rows[b])) < 2e-6 for (a, b), s in got.items())
    dealt = dense.lsh_topk(v, q, 5, block_rows=7, shard_rows=128).collect()
    assert {(r.query_id, r.vec_id): r.score for r in dealt} == got
    assert dense.lsh_topk(v.where("id < 0"), q, 5).count() == 0


def test_deep_search_deals_out_queries(spark, monkeypatch):
    """Queries times depth bound what a worker holds."""
    v = table(spark, 200)
    want = dense.exact_topk(v, v.where("id % 10 = 0"), 50).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(dense, "RESULT_CELLS", 200)
    blocks = []
    shards = dense._search_shards
    monkeypatch.setattr(dense, "_search_shards", lambda *a: blocks.append(a[3]) or shards(*a))
    assert dense.exact_topk(v, v.where("id % 10 = 0"), 50).orderBy("query_id", "rank").collect() == want
    assert blocks == [4]


def test_pairs_inside_rows(spark, monkeypatch):
    """Pairs of a row's items, in small blocks, agree with the joined ones and need no shuffle."""
    from pyspark.sql import functions as F

    from skerry.functions import text as fx
    from skerry.operators import pairs

    rng = random.Random(5)
    rows = [(d, i, " ".join(rng.choices("abcdefghijk", k=rng.randint(0, 7)))) for d in range(6) for i in range(1 + 4 * d)]
    items = spark.createDataFrame(rows, "doc_id string, i int, content string")
    each = F.struct("i", fx.tokenize(F.col("content")).alias("words"))
    grouped = items.groupBy("doc_id").agg(F.sort_array(F.collect_list(each)).alias("items")).localCheckpoint()
    for cells, many in ((2_000_000, 512), (20, 3)):
        monkeypatch.setattr(pairs, "BLOCK_CELLS", cells)
        monkeypatch.setattr(pairs, "BLOCK_ITEMS", many)
        for kind, measure in (("tfidf", "cosine"), ("tfidf", "dot"), ("lm", "dot"), ("token_set", "jaccard")):
            found = vectorize.row_similarities(grouped, "doc_id", kind, measure)
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
            want = {tuple(r)[:3]: r.sim for r in vectorize.pair_similarities(items, ["doc_id"], kind, measure).collect()}
            got = {tuple(r)[:3]: r.sim for r in found.collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
            assert measure != "jaccard" or got == want
    assert "Exchange" not in vectorize.unigram_lm(items, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    halfway = spark.createDataFrame([("h", [(0, ["a"]), (1, ["a", *map(str, range(127))])])], "doc_id string, items array<struct<i int, words array<string>>>")
    assert vectorize.row_similarities(halfway, "doc_id", "token_set", "jaccard").first().sim == 0.007813  # 1 / 128
    with pytest.raises(TypeError):
        vectorize.row_similarities(grouped, "doc_id", "lm", "kl")


def test_best_rows_in_tasks(spark, monkeypatch):
    """Ranks of all models agree with all scores, ranked afterwards, also if
    tasks forget rows early and topics go in blocks; tasks hand on only the best."""
    from skerry.operators import best, retrieve, scoring
    from skerry.operators import index as ix
    from skerry.operators.tables import by_score, ranked

    rng = random.Random(3)
    rows = [(f"d{k}", " ".join(rng.choices("abcdefgh", k=rng.randint(0, 9)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    topics = spark.createDataFrame([(9, "a b"), (2, "c c zz"), (5, ""), (7, "h")], "topic_id long, text string")
    index, terms = ix.build_index(docs), ix.query_terms(topics)

    def plain(scores, k):
        return sorted(map(tuple, ranked(scores, ["topic_id"], by_score("doc_id"), top=k).collect()))

    want = {
        "bm25": plain(scoring.bm25_scores(terms, index), 20),
        "qld": plain(scoring.qld_scores(terms, index), 20),
        "bm25+qld": plain(scoring.mixed_scores(terms, index), 20),
        "rm3": plain(scoring.bm25_rm3_scores(terms, index), 20),
    }
    assert len(want["bm25"]) == 60
    grid = evaluate.bm25_sweep(topics, index, [0.6, 0.9], [0.4], 20)
    handed = []
    real = best.ranked
    monkeypatch.setattr(best, "ranked", lambda df, *a, **o: handed.append(df.count()) or real(df, *a, **o))
    for kept, cells in ((8_000_000, 2_000_000), (40, 7)):
        monkeypatch.setattr(best, "KEPT_CELLS", kept)
        monkeypatch.setattr(best, "SCORE_CELLS", cells)
        for model, rows in want.items():
            handed.clear()
            assert sorted(map(tuple, retrieve.search(topics, index, model=model, topk=20).collect())) == rows
            assert all(n <= 4 * 20 * 3 for n in handed)  # cores, depth, topics
    assert sorted(tuple(r)[2:] for r in grid.where("k1 = 0.9").collect()) == want["bm25"]

    import pyarrow as pa

    import numpy as np

    held = best._Held(2, 1, 3)
    held.most = 8
    scores = [rng.randint(0, 5) / 2 for _ in range(200)]
    for k, score in enumerate(scores):
        held.add(pa.RecordBatch.from_arrays([pa.array([k])], names=["doc_id"]), np.array([0]), np.array([k % 2]), [np.array([score])])
    got = [tuple(r.values()) for b in held.batches(pa.array([10, 11])) for r in b.to_pylist()]
    for topic in (0, 1):
        best_of = sorted((-s, k) for k, s in enumerate(scores) if k % 2 == topic)[:3]
        assert [(r[1], r[3]) for r in got if r[0] == 10 + topic] == [(k, -s) for s, k in best_of]


def test_ngrams_tokenise_once(spark):
    from pyspark.sql import functions as F

    from skerry.functions import text as fx

    df = spark.createDataFrame([(1, "A b, a b c"), (2, "x"), (3, None)], "i int, text string")
    found = df.select("i", fx.ngrams(fx.tokenize(F.col("text")), 1, 2).alias("g"))
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert {r.i: r.g for r in found.collect()} == {1: ["a", "b", "a", "b", "c", "a b", "b a", "a b", "b c"], 2: ["x"], 3: []}


def test_margins_are_compiled(spark):
    from skerry.operators import ltr

    pairs = spark.createDataFrame([(1, [1.0, -2.0]), (1, [0.5, 3.0])], "topic_id int, d array<double>")
    found = pairs.select(ltr.margin([2.0, 0.5]).alias("m"))
    assert "lambda" not in found._jdf.queryExecution().analyzed().toString()
    assert [r.m for r in found.collect()] == [1.0, 2.5]


def test_passages_are_ranked_in_tasks(spark):
    """As passages joined to their topics are, with and without feedback."""
    rng = random.Random(8)
    rows = [(f"d{d}", p, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 9)))) for d in range(30) for p in range(d % 4)]
    texts = spark.createDataFrame(rows, "doc_id string, p_idx int, content string")
    asked = [(t, f"d{d}", d + 1) for t in (1, 2, 3) for d in range(30) if (d * t) % 3]
    candidates = spark.createDataFrame(asked, "topic_id int, doc_id string, rank int")
    topics = spark.createDataFrame([(1, "a b"), (2, "c c zz"), (3, ""), (4, "a")], "topic_id int, text string")
    joined = passages.of_candidates(candidates, texts)
    columns = ["topic_id", "doc_id", "p_idx", "content", "doc_rank", "score", "p_rank"]
    for model in ("bm25", "rm3"):
        want = sorted(map(tuple, passages.rank_passages(joined, topics, model=model, topk=9).select(columns).collect()))
        found = passages.rank_candidates(candidates, texts, topics, model=model, topk=9)
        assert want and sorted(map(tuple, found.select(columns).collect())) == want
