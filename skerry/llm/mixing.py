"""Mixing sources to target weights by Poisson replication, natively.

A source with weight ``w`` of the output and ``b`` of ``B`` bytes in the input
has the mean repetition rate ``w * B * epochs / b``. Each document draws its
own number of copies from a Poisson distribution of that mean: a hash of the
seed and the document gives a number ``u`` in [0, 1), and the count is the
smallest ``k`` with ``P(X <= k) > u``. A rate above ``PART`` is drawn as the
sum of that many independent Poisson numbers of equal means, which has the
same distribution, so tables stay short at any rate. The draw needs no state:
a lost task draws the same copies again. Documents are exploded by their count
and dealt out by a hash of the copy, then sorted by it: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MADE = ("rate", "copies", "copy", "shuffle_key")

#: Sources up to this number are broadcast with their tables (about 1.5 kB
#: each), beyond it joined.
BROADCAST_SOURCES = 4096
#: Largest mean that is drawn at once.
PART = 64
#: Tasks among which a source's documents are dealt out where sources are joined.
SALTS = 16


def _cdf(rate: Column) -> Column:
    """``P(X <= k)`` for k = 0.. of a Poisson distribution of a mean of at most
    ``PART``, as an array.

    Sums run in log space; the array ends 12 standard deviations above the
    mean, where the tail is below 2**-52.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(
        F.lit(0.0).alias("log_p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf")
    )

    def step(acc: Column, k: Column) -> Column:
        log_p = F.when(k == 0, -rate).otherwise(acc["log_p"] + F.ln(rate) - F.ln(k.cast("double")))
        total = acc["sum"] + F.exp(log_p)
        return F.struct(
            log_p.alias("log_p"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf")
        )

    return F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["cdf"])


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits from the MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None, *, source: str, text: str, epochs: float) -> DataFrame:
    """``(source, rate, parts, cdf)``: the mean number of copies per source, in
    how many parts it is drawn, and the cumulative distribution of a part.

    ``weights`` has a source column (named as in ``docs``) and ``weight``;
    without it all sources weigh the same. Weights are scaled to sum to one
    over the sources that occur; a source without a weight gets no copies.
    """
    size = (F.coalesce(F.octet_length(common.named(text)), F.lit(0)) + 1).cast("long")
    found = docs.select(common.named(source).alias("source"), size.alias("size"))
    found = found.groupBy("source").agg(F.sum("size").alias("bytes"))
    if weights is None:
        found = found.withColumn("weight", F.lit(1.0))
    else:
        per = weights.groupBy(common.named(source).alias("of")).agg(F.sum("weight").cast("double").alias("weight"))
        found = found.join(per, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        found = found.withColumn("weight", F.coalesce(F.greatest("weight", F.lit(0.0)), F.lit(0.0)))
    total = found.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("weights"))
    rate = F.col("weight") / F.nullif(F.col("weights"), F.lit(0.0)) * F.col("all_bytes") * F.lit(float(epochs)) / F.col("bytes")
    rated = found.crossJoin(F.broadcast(total)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))  # total: one row
    rated = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("long"))
    return rated.withColumn(
        "cdf", F.when(F.col("rate") > 0, _cdf(F.col("rate") / F.col("parts"))).otherwise(F.array(F.lit(1.0)))
    )


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    epochs: float = 1.0,
    seed: int = 7,
    carry: list[str] | None = None,
    max_rate: float = 100_000.0,
) -> DataFrame:
    """Replicate documents so that sources reach their target weights.

    Returns the columns ``carry`` (all, if None) plus ``rate`` (the source's
    mean), ``copies`` (the document's count), ``copy`` (from 0) and
    ``shuffle_key`` in globally shuffled order. Documents whose count is zero
    don't appear: that is the method's sampling. A source that would be
    repeated more than ``max_rate`` times is an error (a few bytes that are to
    fill a large share of the output), nothing is capped.

    Defined cases: a null source is a source of its own; a null text has no
    bytes; every document counts one byte more than its text, so a source of
    empty texts has a rate too; long texts count as a whole; repeated rows of
    one id draw the same count; an empty table gives no rows; input columns
    named like an output column are left out, other names are free.
    """
    spark = docs.sparkSession
    own = common.Own(docs, carry, MADE)
    table = common.cut(rates(docs, weights, source=source, text=text, epochs=epochs))
    sources, highest = table.agg(F.count("*"), F.max("rate")).first()
    if (highest or 0) > max_rate:
        raise ValueError(f"a source would be repeated {highest:.0f} times, more than max_rate = {max_rate:.0f}")
    rows = docs.select(*own.staged, common.named(source).alias("src"), common.named(doc_id).alias("id"))
    same = F.col("src").eqNullSafe(F.col("source"))
    if sources <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(table), same)
    else:
        # A hot source is dealt out to several tasks.
        table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("salted", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)).cast("int"))
        joined = salted.join(table, same & (F.col("salted") == F.col("salt")))

    def drawn(part: Column) -> Column:
        first = unit_hash(F.lit(seed), F.col("id"))
        u = F.when(part == 0, first).otherwise(unit_hash(F.lit(seed), F.col("id"), part))
        return F.size(F.filter("cdf", lambda c: c <= u)).cast("long")

    counts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), drawn)
    copies = F.aggregate(counts, F.lit(0).cast("long"), lambda n, k: n + k)
    # Drawn apart from the explosion, so that the numbers are drawn once.
    counted = joined.select(*own.names, "rate", "id", copies.alias("copies")).where("copies > 0")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    key = F.xxhash64(F.lit(seed), F.lit("shuffle"), "id", "copy").alias("shuffle_key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    exploded = counted.select(*own.names, "rate", "copies", "id", each)
    mixed = exploded.select(*own.names, "rate", "copies", "copy", key)
    mixed = mixed.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")
    return mixed.select(*own.restored, "rate", "copies", "copy", "shuffle_key")


def op7_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, every source to the same share of the bytes."""
    docs = common.table(spark, sf_dir, "documents")
    return mix(docs, carry=["doc_id", "source"]).select("doc_id", "source", "rate", "copies", "copy")


ORACLE = """
WITH per AS (SELECT source, sum(coalesce(strlen(text), 0) + 1) AS b FROM documents GROUP BY source),
whole AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM per) * (SELECT sum(b) FROM per)::DOUBLE / b::DOUBLE AS rate FROM per),
rated AS (SELECT source, rate, greatest(CAST(ceil(rate / 64) AS BIGINT), 1) AS parts FROM whole),
steps AS (SELECT source, rate / parts AS r, unnest(range(0, CAST(ceil(rate / parts + 12 * sqrt(rate / parts) + 24) AS BIGINT) + 1)) AS k FROM rated),
p AS (SELECT source, k, exp(-r + k * ln(r) - lgamma(k + 1)) AS p FROM steps),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
draws AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, rate, unnest(range(0, parts)) AS part
  FROM documents JOIN rated USING (source)),
u AS (
  SELECT *, CAST(('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '-') || CASE WHEN part = 0 THEN '' ELSE ':' || part END), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM draws),
drawn AS (SELECT u.*, (SELECT count(*) FROM cdf WHERE cdf.source = u.source AND c <= u) AS n FROM u),
counts AS (SELECT row_id, doc_id, source, rate, CAST(sum(n) AS BIGINT) AS copies FROM drawn GROUP BY ALL)
SELECT doc_id, source, rate, copies, unnest(range(0, copies)) AS copy FROM counts WHERE copies > 0
"""
