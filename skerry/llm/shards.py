"""Sharding by sampled splitters, with DataFrame operations only.

Records are laid out along a 64-bit hash key, so every shard is an unbiased
slice of the corpus:

1. a key table (own columns, key, size) is written once; later steps read its
   narrow columns only;
2. a size-weighted sample of its keys is drawn by hash, and its quantiles are
   the splitters of ``fine`` ranges per shard;
3. records are partitioned into these ranges and the ranges are measured. The
   shards are runs of whole ranges: each shard ends at the splitter that is
   nearest to its share of the bytes;
4. a range that is overfull at a shard's end (its bytes would make the shards
   uneven) is subdivided by key and measured again, until a piece is below
   ``tolerance`` of a shard or cannot be cut;
5. slots are numbered range by range; ranges of more than ``rows_per_task``
   records are subdivided by key for that, so no task sorts more than a
   bounded piece.

The splitters alone decide the shard, as ``number of splitters <= key``.
Another sample gives other ranges and so other splitters; sizes of two shards
differ by about ``tolerance`` and one record.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")

_SEED = 0x5EED
_TWO64 = float(1 << 64)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters <= key, found in blocks of a constant sorted array."""
    if not splitters:
        return F.lit(0)

    def longs(values: list[int]) -> str:
        return "array(" + ", ".join(f"bigint('{v}')" for v in values) + ")"

    def at_most(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda n, s: n + (s <= key).cast("int"))

    width = max(1, round(len(splitters) ** 0.5))
    blocks = [splitters[at : at + width] for at in range(0, len(splitters), width)]
    block = F.greatest(at_most(F.expr(longs([b[0] for b in blocks]))) - 1, F.lit(0))
    chosen = F.get(F.expr("array(" + ", ".join(map(longs, blocks)) + ")"), block)
    return block * width + at_most(chosen)


def splitters_of(keys: DataFrame, n_ranges: int, sample_rows: int, total: int) -> list[int]:
    """Quantiles of a size-weighted key sample of about ``sample_rows`` keys.

    A key is drawn if its hash falls below its share of the bytes; a record
    larger than the sampling step stands in the sample with its weight. The
    expected size of the sample is bounded by ``sample_rows``; it is reduced
    to the splitters on the executors with a weighted percentile.
    """
    if n_ranges < 2 or not total:
        return []
    step = max(1.0, total / sample_rows)
    share = F.col("size") / F.lit(step)
    drawn = keys.where(F.xxhash64("key", F.lit(_SEED)) / F.lit(_TWO64) + 0.5 < share)
    weight = F.greatest(F.lit(1), F.round(share)).cast("long")
    points = F.array(*(F.lit(k / n_ranges) for k in range(1, n_ranges)))
    row = drawn.agg(F.percentile("key", points, weight)).first()
    return sorted({int(q) for q in row[0] or []})


def measured(keys: DataFrame, splitters: list[int]) -> dict[int, tuple[int, int]]:
    """``{range: (bytes, rows)}``; as many rows as there are ranges, at most."""
    at = _range_of(F.col("key"), splitters).alias("range")
    found = keys.select(at, "size").groupBy("range").agg(F.sum("size"), F.count("*")).collect()
    return {r[0]: (int(r[1]), int(r[2])) for r in found}


def shard_ends(
    keys: DataFrame, splitters: list[int], sizes: dict[int, tuple[int, int]], n_shards: int, total: int, tolerance: float
) -> list[int]:
    """The ``n_shards - 1`` keys at which the next shard begins."""
    limit = max(1.0, tolerance * total / n_shards)
    ends = []
    # Per open end: target byte, key range (low inclusive, high exclusive), bytes before it, bytes and rows in it.
    open_: list[tuple[float, int, int, int, int, int]] = []
    bounds = [_LEAST, *splitters, _MOST]
    starts, before = [], 0
    for r in range(len(bounds) - 1):
        starts.append(before)
        before += sizes.get(r, (0, 0))[0]
    for k in range(1, n_shards):
        target = total * k / n_shards
        r = max(0, bisect_right(starts, target) - 1)
        open_.append((target, bounds[r], bounds[r + 1], starts[r], *sizes.get(r, (0, 0))))
    while open_:
        ends += [
            (target, low if target - start <= (start + held) - target else high)
            for target, low, high, start, held, rows in open_
            if held <= limit or rows <= 1 or high - low <= 1
        ]
        open_ = [o for o in open_ if not (o[4] <= limit or o[5] <= 1 or o[2] - o[1] <= 1)]
        if not open_:
            break
        # Subdivide the overfull ranges and measure the pieces.
        cuts = set()
        for _, low, high, *_ in open_:
            cuts.update(low + (high - low) * k // 64 for k in range(1, 64))
            cuts.update((low, high))
        cuts = sorted(c for c in cuts if _LEAST < c)
        spans = sorted({(low, high) for _, low, high, *_ in open_})
        inside = F.expr(" OR ".join(f"(key >= bigint('{low}') AND key < bigint('{high}'))" for low, high in spans))
        parts = measured(keys.where(inside), cuts)
        edges = [_LEAST, *cuts, _MOST]
        deeper = []
        for target, low, high, start, _, _ in open_:
            at = bisect_right(cuts, low) if low > _LEAST else 0
            while True:
                held, rows = parts.get(at, (0, 0))
                if start + held > target or edges[at + 1] >= high:
                    break
                start += held
                at += 1
            deeper.append((target, edges[at], min(edges[at + 1], high), start, held, rows))
        open_ = deeper
    return [key for _, key in sorted(ends)]


def shard(
    docs: DataFrame,
    *,
    n_shards: int = 24,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: list[str] | None = None,
    sample_rows: int = 100_000,
    fine: int = 16,
    tolerance: float = 0.001,
    rows_per_task: int = 250_000,
) -> DataFrame:
    """Deal ``docs`` out to ``n_shards`` shards of near equal bytes.

    Returns the columns ``carry`` (the id, if None) plus ``size`` (UTF-8 bytes
    of the text plus 8), ``text_crc32``, ``law`` (``bytes``), ``shard``,
    ``slot`` (gapless from 0 in each shard, in key order) and ``grown_shard``
    (null: only a ``key`` law fixes where one more shard takes rows from).

    Defined cases: a null text counts as empty (size 8, crc32 0); null ids are
    hashed like any value; repeated rows are each kept, and spread over the
    shards by their position in the input; a long text is a record like any
    other; an empty table gives no rows; a record larger than a shard takes a
    shard of its own, so some shards may stay empty; input columns named like
    an output column are left out, other names are free.
    """
    own = common.Own(docs, [doc_id] if carry is None else carry, MADE)
    body = F.coalesce(common.named(text), F.lit(""))
    staged = docs.select(
        *own.staged,
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        common.named(doc_id).alias("id"),
        F.monotonically_increasing_id().alias("at"),
    )
    keyed = common.cut(staged.withColumn("key", F.xxhash64("id", "text_crc32", "size", "at")).drop("id"))
    keys = keyed.select("key", "size")
    total = int(keys.agg(F.sum("size")).first()[0] or 0)
    cuts = splitters_of(keys, n_shards * fine, sample_rows, total)
    sizes = measured(keys, cuts)
    ends = shard_ends(keys, cuts, sizes, n_shards, total, tolerance) if total else []

    # Pieces to sort: the ranges, the large ones cut into equal parts by key.
    bounds = [_LEAST, *cuts, _MOST]
    pieces = {r: -(-rows // rows_per_task) for r, (_, rows) in sizes.items()}
    key, piece = F.col("key"), F.lit(0)
    over = {r: p for r, p in pieces.items() if p > 1}
    if over:
        low = F.expr("map(" + ", ".join(f"{r}, double({float(bounds[r])!r})" for r in over) + ")")
        width = F.expr("map(" + ", ".join(f"{r}, double({(bounds[r + 1] - bounds[r]) / p!r})" for r, p in over.items()) + ")")
        at = F.floor((key.cast("double") - F.try_element_at(low, F.col("range"))) / F.try_element_at(width, F.col("range")))
        piece = F.coalesce(at, F.lit(0))
    placed = keyed.withColumns({"shard": _range_of(key, ends), "range": _range_of(key, cuts)}).withColumn("piece", piece.cast("int"))
    group = ["shard", "range", "piece"]
    # One window per shard over its pieces (rows / rows_per_task of them): 24 short tasks.
    earlier = Window.partitionBy("shard").orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.groupBy(*group).agg(F.count("*").alias("rows"))
    starts = common.cut(counted.select(*group, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first")))
    within = F.row_number().over(Window.partitionBy(*group).orderBy("key", "at")).cast("long") - 1
    return placed.withColumn("row", within).join(starts, group).select(
        *own.restored,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") + F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_shard(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return shard(common.table(spark, sf_dir, "documents"), n_shards=24)
