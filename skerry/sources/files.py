"""Readers and writers of the plain file formats.

Readers parse DataFrames of lines, so the same parsers serve files, tables and
tests. Validation is one aggregation that fetches the first bad line.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import six_places
from ..operators.tables import by_score, ranked


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped, non-blank lines as ``value``."""
    return clean_lines(spark.read.text(path))


def clean_lines(lines: DataFrame) -> DataFrame:
    value = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return lines.select(value.alias("value")).where("value <> ''")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def _reject(df: DataFrame, bad: Column, what: str) -> None:
    row = df.where(bad).select("value").first()
    if row is not None:
        raise ValueError(f"{what}: {row[0]!r}")


# Topics ---------------------------------------------------------------------


def parse_topics(lines: DataFrame, check: bool = True) -> DataFrame:
    """``(topic_id int, text)`` from ``id<TAB>text`` lines, split at the first tab."""
    rows = lines.where(F.trim("value") != "")
    at = F.locate("\t", F.col("value"))
    parts = rows.select(
        "value",
        F.when(at > 0, F.trim(F.col("value").substr(F.lit(1), at - 1))).alias("id"),
        F.when(at > 0, F.trim(F.col("value").substr(at + 1, F.length("value")))).alias("text"),
    ).withColumn("topic_id", F.col("id").try_cast("int"))
    if check:
        _reject(parts, F.col("id").isNull(), "no tab")
        _reject(parts, F.col("id") == "", "empty topic id")
        _reject(parts, F.col("text") == "", "empty topic text")
        _reject(parts, F.col("topic_id").isNull(), "topic id isn't a number")
        twice = parts.groupBy("topic_id").count().where("count > 1").first()
        if twice is not None:
            raise ValueError(f"topic {twice[0]} occurs twice")
    return parts.select("topic_id", "text")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return parse_topics(spark.read.text(path))


# Judgments ------------------------------------------------------------------


def parse_qrels(lines: DataFrame, check: bool = True) -> DataFrame:
    """``(topic_id, doc_id, rel)`` from four columns; repeated pairs keep the largest."""
    rows = clean_lines(lines).withColumn("p", F.split("value", r"\s+"))
    rows = rows.select(
        "value",
        F.size("p").alias("n"),
        F.get("p", F.lit(0)).try_cast("int").alias("topic_id"),
        F.get("p", F.lit(2)).alias("doc_id"),
        F.get("p", F.lit(3)).try_cast("int").alias("rel"),
    )
    if check:
        _reject(rows, F.col("n") != 4, "need four columns")
        _reject(rows, F.col("topic_id").isNull() | F.col("rel").isNull(), "topic and relevance must be numbers")
    return rows.groupBy("topic_id", "doc_id").agg(F.max("rel").alias("rel"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return parse_qrels(spark.read.text(path))


# Runs -----------------------------------------------------------------------


def parse_run(lines: DataFrame, k: int = 1000, check: bool = True) -> DataFrame:
    """``(topic_id, doc_id, rank)`` of a run file in the order of its ranks.

    Six columns at least; the score is checked but not used. A repeated
    document keeps its first rank; ranks are then counted from 1 up to ``k``.
    """
    rows = clean_lines(lines).withColumn("p", F.split("value", r"\s+"))
    rows = rows.select(
        "value",
        F.size("p").alias("n"),
        F.get("p", F.lit(0)).try_cast("int").alias("topic_id"),
        F.get("p", F.lit(2)).alias("doc_id"),
        F.get("p", F.lit(3)).try_cast("int").alias("at"),
        F.get("p", F.lit(4)).try_cast("double").alias("score"),
    )
    if check:
        _reject(rows, F.col("n") < 6, "need six columns")
        bad = F.col("topic_id").isNull() | F.col("at").isNull() | F.col("score").isNull()
        _reject(rows, bad, "topic, rank and score must be numbers")
    first = rows.groupBy("topic_id", "doc_id").agg(F.min("at").alias("at"))
    return ranked(first, ["topic_id"], [F.col("at"), F.col("doc_id")], top=k).drop("at")


def read_run(spark: SparkSession, path: str, k: int = 1000) -> DataFrame:
    return parse_run(spark.read.text(path), k)


def run_lines(run: DataFrame, tag: str, topk: int = 1000) -> DataFrame:
    """``(topic_id, rank, line)`` of a run, sorted again by score and id."""
    if not tag.strip() or topk <= 0:
        raise ValueError("need a tag and a positive topk")
    rows = ranked(run.select("topic_id", "doc_id", "score"), ["topic_id"], by_score("doc_id"), top=topk)
    line = F.concat_ws(
        " ",
        F.col("topic_id").cast("string"),
        F.lit("Q0"),
        F.col("doc_id").cast("string"),
        F.col("rank").cast("string"),
        six_places(F.col("score")),
        F.lit(tag),
    )
    return rows.select("topic_id", "rank", line.alias("line"))


def write_run(run: DataFrame, path: str, tag: str, topk: int = 1000) -> None:
    """Text files in topic and rank order; ids with blanks are rejected."""
    bad = run.where(F.col("doc_id").cast("string").rlike(r"\s") | (F.trim(F.col("doc_id").cast("string")) == "")).first()
    if bad is not None:
        raise ValueError(f"document id {bad['doc_id']!r}")
    rows = run_lines(run, tag, topk).repartitionByRange("topic_id").sortWithinPartitions("topic_id", "rank")
    rows.select("line").write.mode("overwrite").text(path)


# Corpora, embeddings, models --------------------------------------------------


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{docid, text}``; malformed lines and missing ids are errors."""
    rows = spark.read.schema("docid string, text string").option("mode", "FAILFAST").json(path)
    named = F.when(F.col("docid").isNull(), F.raise_error(F.lit("a corpus line has no docid"))).otherwise(F.col("docid"))
    return rows.select(named.cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def corpus_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line)``: compact JSON with keys in sorted order."""
    fields = F.struct(F.col("doc_id").cast("string").alias("docid"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.to_json(fields).alias("line"))


def write_corpus(docs: DataFrame, path: str) -> None:
    corpus_lines(docs).select("line").write.mode("overwrite").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).withColumnRenamed("value", "doc_id")


def check_embeddings(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table, after a check that ids are unique and dimensions agree."""
    row = vectors.agg(
        F.count("*"), F.count_distinct(key), F.min(F.size("embedding")), F.max(F.size("embedding"))
    ).first()
    if row[0] != row[1] or row[2] != row[3]:
        raise ValueError(f"{row[0]} rows, {row[1]} ids, dimensions {row[2]} to {row[3]}")
    return vectors


def parse_learning_lines(lines: DataFrame) -> DataFrame:
    """``(label, qid, features map<int,double>, item)`` from learning files."""
    rows = clean_lines(lines).withColumn("body", F.trim(F.regexp_extract("value", "^[^#]*", 0)))
    item = F.trim(F.regexp_extract("value", "#(.*)$", 1))
    parts = F.split("body", r"\s+")
    pairs = F.filter(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: p != "")
    features = F.map_from_entries(
        F.transform(
            pairs,
            lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("key"), F.split(p, ":")[1].cast("double").alias("value")),
        )
    )
    return rows.select(
        F.get(parts, F.lit(0)).cast("double").alias("label"),
        F.regexp_extract("body", r"qid:(\d+)", 1).cast("int").alias("qid"),
        features.alias("features"),
        item.alias("item"),
    )


def parse_linear_model(text: str) -> dict[int, float]:
    """Weights by feature number of a linear model file (its last data line)."""
    body = [x for x in text.splitlines() if x.split("#")[0].strip()]
    return {int(k): float(v) for k, v in (p.split(":") for p in body[-1].split("#")[0].split()[1:])}


def model_text(weights: list[float]) -> str:
    return "1 " + " ".join(f"{k}:{w:.8g}" for k, w in enumerate(weights, 1)) + " #\n"


def write_csv(df: DataFrame, path: str, tab: bool = False) -> None:
    """Small results (sweeps, debug tables) with a header."""
    df.write.mode("overwrite").option("header", True).option("sep", "\t" if tab else ",").csv(path)


# Driver-side helpers ------------------------------------------------------------


def cached(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """A table kept as Parquet below ``folder``; ``make()`` is called on a miss."""
    path = f"{folder.rstrip('/')}/{key}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(passages: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 (20 digits) of each group's passages in order."""
    part = F.concat_ws("\x00", F.col("doc_id").cast("string"), F.col("p_idx").cast("string"), F.col("content"))
    ordered = F.sort_array(F.collect_list(F.struct("doc_id", "p_idx", part.alias("part"))))
    text = F.array_join(F.transform(ordered, lambda x: x["part"]), "\n")
    return passages.groupBy(*by).agg(F.substring(F.sha2(text, 256), 1, 20).alias("fingerprint"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_text(path: str, text: str) -> None:
    """Write a small driver-side file and move it into place."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(text, encoding="utf-8")
    part.replace(target)
