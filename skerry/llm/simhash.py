"""SimHash near-duplicates by generalised pigeonhole search.

Two fingerprints within ``max_bits`` bits must agree within ``t_i`` bits on at
least one partition ``i`` of their bits, as soon as the thresholds satisfy
``sum(t_i + 1) = max_bits + 1`` (a threshold of -1 leaves a partition out).

* Bits that are correlated in a bounded sample share a partition, so that the
  others stay selective.
* The thresholds are allocated by dynamic programming over the estimated cost
  of each partition and threshold: signatures to write plus candidates to
  verify at the full number of fingerprints. The number of partitions is
  chosen the same way.
* Distinct fingerprints are indexed by the partition's bits, probed with all
  values within its threshold, and candidates are verified by bit count.
* A bucket of more than ``BUCKET`` fingerprints isn't paired off. Its members
  are linked through midpoints instead: two fingerprints differ in at most two
  bits exactly if they share a value within one bit of both. That takes one
  row per fingerprint and bit, however large the bucket, and loses no link.

Equal fingerprints are one node. Links become components by alternating large
and small stars, with every round written to the shared folder.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MADE = ("fingerprint", "component_id")

BITS = 64
#: Buckets up to this size are paired off, larger ones linked by midpoints:
#: about where n * n / 2 pairs cost as much as n rows of 44 midpoints.
BUCKET = 64
SAMPLE = 20_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of a UTF-8 text: a bit is set if it is set in over half
    of the XXH64 values of its word shingles (repeats count)."""
    import numpy as np
    import xxhash

    found = raw.translate(_LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(found))
    starts, ends = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 65536):
        part = zip(starts[at : at + 65536], ends[at : at + 65536])
        values = np.array([digest(line[a:b], seed) for a, b in part], np.uint64)
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, *, text: str, keep: list[str], shingle: int) -> DataFrame:
    """``keep`` columns plus ``fp``, the fingerprint as a signed long."""
    common.bound_batches(docs.sparkSession)
    source = docs.select(*keep, text)
    schema = T.StructType([*common.fields(source, keep), T.StructField("fp", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            prints = [fingerprint(raw, shingle) for raw in common.as_bytes(batch.column(text))]
            signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(signed, pa.int64())], names=[*keep, "fp"]
            )

    return source.mapInArrow(run, schema)


# Partitions and thresholds ------------------------------------------------


def group_bits(sample, m: int) -> list[list[int]]:
    """``m`` partitions of the bits, correlated ones together (greedy)."""
    import numpy as np

    values = sample.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(values, axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits * bits).sum(axis=0))
    tie = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-12)
    np.fill_diagonal(tie, 0)
    free = list(range(BITS))
    groups = []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        group = [max(free, key=lambda b: (tie[b][free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            nearest = max(free, key=lambda b: (tie[b][group].sum(), -b))
            group.append(nearest)
            free.remove(nearest)
        groups.append(sorted(group))
    return groups


def signatures(width: int, t: int) -> int:
    return sum(comb(width, d) for d in range(t + 1)) if t >= 0 else 0


def candidates(sample, group: list[int], t: int, n: int) -> float:
    """Estimated pairs of ``n`` fingerprints within ``t`` bits on a partition."""
    import numpy as np

    if t < 0:
        return 0.0
    mask = np.uint64(sum(1 << b for b in group))
    values, counts = np.unique(sample & mask, return_counts=True)
    pairs = float((counts * (counts - 1.0)).sum() / 2)
    for d in range(1, t + 1):
        for flip in combinations(group, d):
            other = values ^ np.uint64(sum(1 << b for b in flip))
            at = np.minimum(np.searchsorted(values, other), max(len(values) - 1, 0))
            pairs += float((counts * counts[at])[values[at] == other].sum() / 2)
    even = n * n / 2 * signatures(len(group), t) / 2.0 ** len(group)
    return max(pairs * (n / max(len(sample), 1)) ** 2, even)


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with ``sum(t + 1) == total`` of least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (paid, chosen) in best.items():
            for t, c in cost.items():
                now = used + t + 1
                if now <= total and (now not in step or paid + c < step[now][0]):
                    step[now] = (paid + c, [*chosen, t])
        best = step
    return best[total]


def plan(sample, n: int, max_bits: int) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of least estimated cost for ``n`` fingerprints."""
    options = []
    for m in range(1, max_bits + 3):
        groups = group_bits(sample, m)
        costs = []
        for group in groups:
            cost = {-1: 0.0}
            for t in range(max_bits + 1):
                rows = n * signatures(len(group), t)
                # Wide probes are only estimated where they could pay off.
                if t and rows > 64 * n:
                    continue
                cost[t] = 4.0 * rows + candidates(sample, group, t, n)
            costs.append(cost)
        try:
            paid, chosen = allocate(costs, max_bits + 1)
        except KeyError:
            continue
        options.append((paid, m, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


# Links ---------------------------------------------------------------------


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _keys(parts: list[tuple[list[int], int]]) -> Column:
    """Signatures of ``fp``: structs (part, key, probe)."""
    found = []
    for k, (group, t) in enumerate(parts):
        mask = F.lit(_signed(sum(1 << b for b in group)))
        for d in range(t + 1):
            for flip in combinations(group, d):
                bits = F.lit(_signed(sum(1 << b for b in flip)))
                key = F.col("fp").bitwiseAND(mask).bitwiseXOR(bits)
                found.append(F.struct(F.lit(k).alias("part"), key.alias("key"), F.lit(d > 0).alias("probe")))
    return F.array(*found)


def links(nodes: DataFrame, max_bits: int = 2, sample_rows: int = SAMPLE) -> DataFrame:
    """Pairs ``(u, v)``, u < v, of the distinct column ``fp`` that connect all
    fingerprints within ``max_bits`` (at most 2) bits of each other.

    Inside small buckets all links are returned, inside large ones enough of
    them to connect the same fingerprints.
    """
    import numpy as np

    if not 0 <= max_bits <= 2:
        raise ValueError("midpoints link at most two bits")
    n = nodes.count()
    share = min(1.0, sample_rows / max(n, 1))
    drawn = nodes.where(F.xxhash64("fp", F.lit(3)) / F.lit(float(1 << 64)) + 0.5 < share).select("fp")
    sample = np.array([r[0] for r in drawn.collect()], np.int64).view(np.uint64)  # about sample_rows rows
    parts = plan(sample, n, max_bits)

    signed = nodes.select("fp", F.explode(_keys(parts)).alias("s")).select("fp", "s.part", "s.key", "s.probe")
    signed = common.cut(signed)
    filled = signed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    filled = common.cut(filled)
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits

    small = signed.join(filled.where(F.col("n") <= BUCKET).select("part", "key"), ["part", "key"])
    left = small.where(~F.col("probe")).select("part", "key", F.col("fp").alias("u"))
    right = small.select("part", "key", F.col("fp").alias("v"))
    pairs = left.join(right, ["part", "key"]).where((F.col("u") < F.col("v")) & near).select("u", "v")

    crowded = filled.where(F.col("n") > BUCKET).select("part", "key")
    members = signed.join(crowded, ["part", "key"], "left_semi").select("fp").distinct()
    members = members.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << b)).cast("long") for b in range(BITS)))
    middles = members.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")
    )
    # At most 65 fingerprints lie within one bit of a middle.
    shared = middles.groupBy("middle").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = shared.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where((F.col("u") < F.col("v")) & near)
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` of all nodes of ``edges (u, v)`` but the roots;
    a root is the smallest node of its component."""
    spark = edges.sparkSession
    path = common.shared_dir(spark)
    now = common.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v"), path)

    def stars(df) -> bool:
        """Whether every node has one smaller neighbour, which has none itself."""
        low = df.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high"))
        high = df.select(F.col("v").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high"))
        marks = low.unionByName(high).groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
        return not marks.where("low + high > 1 AND low > 0").limit(1).count()

    while not stars(now):
        # Large star: larger neighbours of a node move to its smallest neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.cut(large.where("u > v").distinct())
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        old, path = path, common.shared_dir(spark)
        now = common.cut(small, path)
        common.drop_folder(spark, old)
        common.drop_tables(large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = 3,
    max_bits: int = 2,
    carry: list[str] | None = None,
) -> DataFrame:
    """Fingerprint and component of every document.

    Adds ``fingerprint`` (16 hexadecimal digits) and ``component_id`` (the
    smallest id reachable over links of at most ``max_bits`` bits, the
    document itself included) to the columns ``carry`` (the id, if None).

    Defined cases: a null text has no words; texts without words have the
    fingerprint zero and link like any other; fewer than ``shingle`` words are
    one shingle; repeated rows each get their own row; a component whose ids
    are all null has a null id, else null ids don't count; long texts are
    hashed as a whole; an empty table gives no rows; input columns named like
    an output column are left out.
    """
    own = common.Own(docs, [doc_id] if carry is None else carry, MADE)
    staged = docs.select(*own.staged, common.named(doc_id).alias("id"), common.named(text).alias("text"))
    prints = common.cut(with_fingerprints(staged, text="text", keep=[*own.names, "id"], shingle=shingle))
    return _resolved(prints, max_bits).select(
        *own.restored,
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first").alias("component_id"),
    )


def _resolved(prints: DataFrame, max_bits: int) -> DataFrame:
    """``prints`` with ``first``: the smallest ``id`` of each row's component."""
    nodes = common.cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    return resolve(prints, nodes, links(nodes, max_bits))


def resolve(prints: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``prints`` with ``first``, by the ``edges`` between ``nodes (fp, first)``."""
    roots = components(edges)
    rooted = common.cut(
        nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        )
    )
    firsts = common.cut(rooted.groupBy("root").agg(F.min("first").alias("first")))
    # A hot fingerprint is split by the adaptive skew join: both sides come
    # from tables and are shuffled for the join alone.
    named = common.cut(rooted.drop("first").join(firsts, "root").select("fp", "first"))
    return prints.join(named, "fp", "left")


def keep_first(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """One row of ``docs`` per component, with all its columns.

    The row with the smallest id stays (a null id only without any other);
    among rows of that id the one whose text has the smallest hash; of
    repeated rows one. Columns of any name are handed on.
    """
    keys = ranked(docs, text=text, doc_id=doc_id)
    prints = common.cut(with_fingerprints(keys, text="text", keep=["id"], shingle=shingle))
    return first_rows(docs, _resolved(prints, max_bits), text=text, doc_id=doc_id)


def rank_of(text: str, doc_id: str) -> Column:
    """What ``keep_first`` chooses by: nulls last, then id, then hash of the text."""
    key = common.named(doc_id)
    return F.struct(key.isNull().alias("none"), key.alias("id"), F.xxhash64(common.named(text)).alias("hash"))


def ranked(docs: DataFrame, *, text: str, doc_id: str) -> DataFrame:
    """``(text, id)`` of ``docs``, ``id`` being :func:`rank_of`."""
    return docs.select(common.named(text).alias("text"), rank_of(text, doc_id).alias("id"))


def first_rows(docs: DataFrame, resolved: DataFrame, *, text: str, doc_id: str) -> DataFrame:
    """The rows of ``docs`` whose rank is the ``first`` of its component."""
    found = resolved.where(F.col("id") == F.col("first")).groupBy("id").agg(F.count("*").alias("n"))
    found = common.cut(found)
    own = common.Own(docs, None, ())
    rows = docs.select(*own.staged, rank_of(text, doc_id).alias("id"))
    kept = rows.join(found.select("id"), "id", "left_semi")
    if found.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["id"])
    return kept.select(*own.restored)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, 2 bits."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


# XXH64 has no counterpart in the oracle's SQL; tests compare with brute force.
