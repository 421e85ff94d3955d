"""Exact top-k search by inner product with KD-trees, one per shard.

Vectors are dealt out to shards of bounded size by a hash of their id; in each
a KD-tree is built by median splits, and every node keeps the tight bounding
box of its vectors. The largest inner product that a query can reach inside a
box is the sum over the dimensions of ``max(q * low, q * high)``. A query
visits the nodes best first and stops at the first whose bound can't beat its
k-th score.

The k-th score is propagated: all queries search one shard first, and what
they find there bounds the search of all other shards.

Queries come in blocks of bounded size. A task holds one shard and one block.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

RESULT = "query_id bigint, vec_id bigint, score bigint"

LEAF = 256


class KDTree:
    """Nodes of a tree over the integer rows of ``vectors``."""

    def __init__(self, ids, vectors, leaf: int = LEAF):
        import numpy as np

        self.leaves: list = []  # node -> (ids, vectors) or None
        self.children: list = []
        self.low, self.high, self.least = [], [], []
        exact = vectors.size == 0 or float(np.abs(vectors).max()) ** 2 * vectors.shape[1] < 2**53
        self.kind = np.float64 if exact else object  # float64 sums are exact below 2**53

        def grow(rows) -> int:
            own = vectors[rows]
            node = len(self.leaves)
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.least.append(int(ids[rows].min()))
            self.leaves.append(None)
            self.children.append(())
            spread = self.high[node] - self.low[node]
            if len(rows) <= leaf or not spread.any():
                self.leaves[node] = (ids[rows], own.astype(self.kind))
                return node
            half = len(rows) // 2
            order = np.argpartition(own[:, int(np.argmax(spread))], half)
            self.children[node] = (grow(rows[order[:half]]), grow(rows[order[half:]]))
            return node

        if len(ids):
            grow(np.arange(len(ids)))

    def bounds(self, queries):
        """Largest inner product of every query (row) with every node's box (column)."""
        import numpy as np

        low, high = np.array(self.low).astype(self.kind), np.array(self.high).astype(self.kind)
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T

    def search(self, own: int, query, bounds, k: int, cutoff=None) -> list[tuple[int, int]]:
        """Up to ``k`` best ``(score, id)`` that beat ``cutoff = (score, id)``,
        without rows of the id ``own``; ties go to the smaller id."""
        worst = cutoff  # of the k-th, once there are k
        best: list[tuple[int, int]] = []  # heap of (score, -id): the weakest first
        queue = [(-bounds[0], self.least[0], 0)] if self.leaves else []
        while queue:
            bound, least, node = heapq.heappop(queue)
            if worst is not None and (-bound < worst[0] or (-bound == worst[0] and least > worst[1])):
                if -bound < worst[0]:
                    break
                continue
            if self.leaves[node] is None:
                for child in self.children[node]:
                    heapq.heappush(queue, (-bounds[child], self.least[child], child))
                continue
            ids, vectors = self.leaves[node]
            scores = vectors @ query
            wanted = ids != own
            if worst is not None:
                wanted &= (scores > worst[0]) | ((scores == worst[0]) & (ids < worst[1]))
            for at in self._top(scores, ids, wanted, k):
                item = (int(scores[at]), -int(ids[at]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    kth = (best[0][0], -best[0][1])
                    if worst is None or kth[0] > worst[0] or (kth[0] == worst[0] and kth[1] < worst[1]):
                        worst = kth
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))

    @staticmethod
    def _top(scores, ids, wanted, k: int):
        import numpy as np

        at = np.flatnonzero(wanted)
        return at[np.lexsort((ids[at], -scores[at]))[:k]] if len(at) > k else at


def _search_group(k: int):
    def run(shard, queries):
        import numpy as np
        import pyarrow as pa

        def matrix(column):
            values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return values.reshape(len(column), -1)

        found: list[tuple[int, int, int]] = []
        if shard.num_rows and queries.num_rows:
            tree = KDTree(shard.column("vec_id").to_numpy(), matrix(shard.column("v")))
            wanted = matrix(queries.column("v")).astype(tree.kind)
            own = queries.column("query_id").to_pylist()
            kth = list(zip(queries.column("kth_score").to_pylist(), queries.column("kth_id").to_pylist()))
            for at in range(0, len(own), 1024):
                bounds = tree.bounds(wanted[at : at + 1024])
                for i, row in enumerate(bounds, at):
                    cutoff = kth[i] if kth[i][0] is not None else None
                    found += [(own[i], v, s) for s, v in tree.search(own[i], wanted[i], row, k, cutoff)]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    return run


def quantised(embedding: Column) -> Column:
    """Components as ``floor(256 * x)``."""
    return F.transform(embedding, lambda x: F.floor(F.lit(256) * x.cast("double")).cast("long"))


def usable(embedding: Column) -> Column:
    """No null, no null or non-finite component."""

    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))

    return embedding.isNotNull() & ~F.coalesce(F.exists(embedding, odd), F.lit(False))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 5,
    shards: int = 48,
    shard_rows: tuple[int, int] = (2048, 131072),
    block_rows: int = 16384,
) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query row.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``. The
    table is dealt out to about ``shards`` shards within the limits
    ``shard_rows``, the queries to blocks of about ``block_rows``.

    Defined cases: vectors that are null or hold a null, infinite or NaN
    component take no part, nor do rows with a null id; only vectors of the
    query's length are candidates; candidate rows that repeat both id and
    vector each count, queries that do are asked once; rows of the query's id
    are no candidates; ties go to the smaller id; a query with fewer than
    ``k`` candidates gets all of them; an empty table gives no rows; columns of
    other names play no part.
    """
    rows = vectors.select(
        common.named(vec_id).cast("long").alias("vec_id"), common.named(embedding).alias("e"), is_query.alias("asks")
    )
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    rows = rows.select("vec_id", quantised(F.col("e")).alias("v"), "asks")
    rows = rows.withColumn("dim", F.size("v"))
    path = common.shared_dir(vectors.sparkSession)
    rows = common.cut(rows, path)
    # Read apart, so that the two sides of a search don't share columns.
    asking = vectors.sparkSession.read.schema(rows.schema).parquet(path)
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    per = min(max(-(-n // shards), shard_rows[0]), shard_rows[1])
    n_shards = max(1, -(-n // per))
    n_blocks = max(1, -(-asked // block_rows))

    def all_of(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    index = rows.select("dim", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int").alias("shard"))
    index = index.select("*", all_of(n_blocks).alias("block"))
    queries = asking.where("asks").dropDuplicates(["vec_id", "v"]).select(
        "dim", F.col("vec_id").alias("query_id"), "v",
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int").alias("block"),
    )
    key = ["dim", "shard", "block"]

    def search(some_index: DataFrame, some_queries: DataFrame) -> DataFrame:
        left = some_index.select(*key, "vec_id", "v").groupBy(*key)
        right = some_queries.select(*key, "query_id", "v", "kth_score", "kth_id").groupBy(*key)
        return left.cogroup(right).applyInArrow(_search_group(k), RESULT)

    none = F.lit(None).cast("long")
    seeds = queries.select("*", F.lit(0).alias("shard"), none.alias("kth_score"), none.alias("kth_id"))
    first = common.cut(search(index.where("shard = 0"), seeds))
    found = first
    if n_shards > 1:
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = first.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k)
        kth = kth.select(
            F.col("query_id").alias("of"), F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id")
        )
        bounded = queries.join(kth, F.col("query_id") == F.col("of"), "left").drop("of")
        others = F.explode(F.sequence(F.lit(1), F.lit(n_shards - 1))).alias("shard")
        found = found.unionByName(search(index.where("shard > 0"), bounded.select("*", others)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op5_topk(spark, sf_dir: str) -> DataFrame:
    """Top 5 of all embeddings for every row whose id is divisible by 50."""
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 50 = 0) q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
