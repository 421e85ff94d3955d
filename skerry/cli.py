"""Command line: ``python -m skerry.cli COMMAND``.

``run`` writes a ranked run (lexical, clustered or dense), ``eval`` prints its
mean average precision, ``grid`` and ``dense-grid`` sweep settings, ``pack``
puts runs into one zip file. Corpora are JSON lines, vectors Parquet tables
``(id, embedding)``, query vectors ``(id, embedding, text)``.
"""

from __future__ import annotations

import argparse
import logging
import zipfile
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators import evaluate, features, labels, ltr, retrieve
from .operators.index import build_index
from .plans import retrieval, sweep
from .plans.config import Bm25Config, ClusterConfig, DenseConfig, load_config
from .sources import files

log = logging.getLogger("skerry")

#: Feature order of linear model files.
FEATURE_ORDER = sorted(features.FEATURES)


# Spellings of booleans, and the settings of a BM25 sweep.
BOOLEANS = {"0": False, "1": True, "f": False, "false": False, "n": False, "no": False, "off": False}
BOOLEANS |= {"on": True, "t": True, "true": True, "y": True, "yes": True}
K1_VALUES = [0.6, 0.9, 1.2, 1.5, 1.8]
B_VALUES = [0.1, 0.3, 0.5, 0.7, 0.9]


def flag(text: str) -> bool:
    """The boolean that ``text`` spells."""
    try:
        return BOOLEANS[text.strip().lower()]
    except KeyError:
        raise argparse.ArgumentTypeError(f"not a boolean: {text!r}") from None


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skerry", description=__doc__)
    top.add_argument("--log-level", default="INFO")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *needed: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        return p

    run = command("run", "output")
    run.add_argument("--plan", choices=["bm25", "clustered", "dense"], default="bm25")
    for name in ("topics", "corpus", "qrels", "config", "model", "vectors", "query-vectors"):
        run.add_argument(f"--{name}")
    run.add_argument("--split", choices=["train", "test", "all"], default="test")
    run.add_argument("--tag", default="run1")
    run.add_argument("--topk", type=int, default=1000)
    run.add_argument("--k1", type=float, default=0.9)
    run.add_argument("--b", type=float, default=0.4)
    run.add_argument("--train-model", action="store_true", help="fit the cluster model on --qrels and save it to --model")
    judged = command("eval", "run", "qrels")
    grid = command("grid", "topics", "corpus", "qrels", "output")
    grid.add_argument("--k1", nargs="+", type=float, default=K1_VALUES)
    grid.add_argument("--b", nargs="+", type=float, default=B_VALUES)
    dense = command("dense-grid", "corpus", "vectors", "query-vectors", "qrels", "output")
    dense.add_argument("--depth", nargs="+", type=int, default=[2000])
    dense.add_argument("--metric", nargs="+", default=["cosine"])
    dense.add_argument("--rerank", nargs="+", type=flag, default=[False])
    dense.add_argument("--topn", nargs="+", type=int, default=[100])
    dense.add_argument("--alpha", nargs="+", type=float, default=[1.0])
    for p in (judged, grid, dense):
        p.add_argument("--topk", type=int, default=1000)
    judged.add_argument("--per-topic", action="store_true")
    pack = command("pack", "output")
    pack.add_argument("runs", nargs="+")
    return top


def settings(kind, path: str | None, **values):
    """A settings object from its defaults, a configuration file and ``values``."""
    known = {f.name for f in fields(kind)}
    given = {}
    if path:
        loaded = load_config(path)
        given = {k: v for k, v in loaded.params.items() if k in known and v is not None}
        if loaded.candidates_depth is not None:
            given["depth" if kind is DenseConfig else "candidates"] = loaded.candidates_depth
    return kind(**{k: v for k, v in {**given, **values}.items() if k in known})


def cluster_model(args, topics: DataFrame, docs: DataFrame, config: ClusterConfig) -> ltr.LinearModel | None:
    """The model to train, or to read from a file, if any."""
    if args.train_model:
        qrels = files.read_qrels(topics.sparkSession, args.qrels)
        members = retrieval.clustered_tables(topics, docs, config).members
        rows = features.compute(members).join(labels.cluster_labels(members, qrels, "any"), ["topic_id", "cluster_id"])
        model = ltr.train(rows, FEATURE_ORDER, scaling="none")
        if args.model:
            files.write_text(args.model, files.model_text(list(model.weights)))
        return model
    if not args.model:
        return None
    weights = files.parse_linear_model(Path(args.model).read_text(encoding="utf-8"))
    ordered = tuple(weights.get(k, 0.0) for k in range(1, len(FEATURE_ORDER) + 1))
    return ltr.LinearModel(tuple(FEATURE_ORDER), ordered, ltr.Scaler("none"))


def ranked_run(spark: SparkSession, args) -> DataFrame:
    docs = files.read_corpus(spark, args.corpus)
    if args.plan == "dense":
        vectors, asked = spark.read.parquet(args.vectors), spark.read.parquet(args.query_vectors)
        return retrieval.two_stage(asked, vectors, docs, settings(DenseConfig, args.config, topk=args.topk))
    topics = retrieve.split_topics(files.read_topics(spark, args.topics), args.split)
    if args.plan == "bm25":
        return retrieval.lexical(topics, docs, settings(Bm25Config, args.config, k1=args.k1, b=args.b, topk=args.topk))
    config = settings(ClusterConfig, args.config, topk=args.topk)
    return retrieval.clustered(topics, docs, config, cluster_model(args, topics, docs, config))


def pack(output: str, runs: list[str]) -> None:
    """A new zip file of local run files or of the part files of run folders."""
    Path(output).unlink(missing_ok=True)
    with zipfile.ZipFile(output, "w", zipfile.ZIP_DEFLATED) as out:
        for path in map(Path, runs):
            parts = [path] if path.is_file() else sorted(path.glob("part-*"))
            with out.open(path.name, "w") as entry:
                for part in parts:
                    entry.write(part.read_bytes())


def check(args) -> None:
    """Reject options that don't fit together before a session starts."""
    if args.command != "run":
        return
    needed = ["corpus", *(["vectors", "query_vectors"] if args.plan == "dense" else ["topics"])]
    if args.train_model:
        needed.append("qrels")
        if args.plan != "clustered" or args.split != "train":
            raise SystemExit("--train-model needs --plan clustered and --split train")
    missing = [n for n in needed if getattr(args, n) is None]
    if missing:
        raise SystemExit("missing: " + ", ".join(f"--{n.replace('_', '-')}" for n in missing))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level.upper())
    check(args)
    if args.command == "pack":
        pack(args.output, args.runs)
        return 0
    spark = spark or SparkSession.builder.appName("skerry").getOrCreate()
    if args.command == "run":
        files.write_run(ranked_run(spark, args), args.output, args.tag, args.topk)
        log.info("wrote %s", args.output)
        return 0
    qrels = files.read_qrels(spark, args.qrels)
    if args.command == "eval":
        found = files.read_run(spark, args.run, args.topk)
        mean = evaluate.mean_average_precision(found, qrels, args.topk).first()[0]
        print(f"MAP@{args.topk}: {mean:.6f}")
        if args.per_topic:
            for row in evaluate.average_precision(found, qrels, args.topk).orderBy("topic_id").toLocalIterator():
                print(f"{row.topic_id}\t{row.ap:.6f}")
        return 0
    docs = files.read_corpus(spark, args.corpus)
    if args.command == "grid":
        names = ["k1", "b"]
        runs = evaluate.bm25_sweep(files.read_topics(spark, args.topics), build_index(docs), args.k1, args.b, args.topk)
        found = evaluate.mean_average_precision(runs, qrels, args.topk, names)
    else:
        names = list(sweep.SETTINGS)
        found = sweep.dense_sweep(
            spark.read.parquet(args.query_vectors), spark.read.parquet(args.vectors), docs, qrels, topk=args.topk,
            depths=args.depth, metrics=args.metric, reranks=args.rerank, topns=args.topn, alphas=args.alpha,
        )
    best = evaluate.best_settings(found, names).withColumnRenamed("map", f"map@{args.topk}")
    files.write_csv(best.coalesce(1), args.output)  # one row per setting
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
