"""Similarities of the items that one row holds: nothing is shuffled.

A row carries the tokens of all its items, so their pairs are computed where
the row is. Tokens become numbers per Arrow batch, and items meet in blocks of
bounded size, however many a row has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import place
from .tables import bound_batches

#: Numbers of a block's dense matrix at most, unless a single item has more terms.
BLOCK_CELLS = 2_000_000
#: Items of a block, and rows of a result batch.
BLOCK_ITEMS, RESULT_ROWS = 512, 65_536


def _weights(item, term, n_items: int, kind: str):
    """Distinct (item, term) and their weights, by item and term."""
    import numpy as np

    key, tf = np.unique(item.astype(np.int64) << 32 | term, return_counts=True)
    item, term = key >> 32, key & 0xFFFFFFFF
    if kind == "set":
        return item, term, np.ones(len(key))
    if kind == "lm":
        return item, term, tf / np.bincount(item, tf, n_items)[item]
    _, at, df = np.unique(term, return_inverse=True, return_counts=True)
    return item, term, tf * (np.log((n_items + 1.0) / (df[at] + 1.0)) + 1.0)


def _blocks(sizes):
    """Ranges of items of at most BLOCK_ITEMS and about BLOCK_CELLS matrix cells."""
    found, at = [], 0
    while at < len(sizes):
        end, terms = at + 1, int(sizes[at])
        while end < len(sizes) and end - at < BLOCK_ITEMS and (end + 1 - at) * (terms + int(sizes[end])) <= BLOCK_CELLS:
            terms += int(sizes[end])
            end += 1
        found.append((at, end))
        at = end
    return found


def similar(item, term, n_items: int, kind: str, measure: str):
    """Yields arrays ``(a, b, sim)`` of pairs a < b of one row's items, by
    position. ``dot`` and ``cosine`` of pairs that share a term, ``jaccard`` of
    all pairs; before rounding."""
    import numpy as np

    item, term, w = _weights(item, term, n_items, kind)
    if measure == "cosine":
        norm = np.sqrt(np.bincount(item, w * w, n_items))[item]
        w = np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0)
    sizes = np.bincount(item, minlength=n_items)
    start = np.concatenate([[0], np.cumsum(sizes)])
    blocks = _blocks(sizes)

    def matrix(at: int, end: int, wanted):
        some = slice(start[at], start[end])
        place = np.searchsorted(wanted, term[some])
        place[place == len(wanted)] = 0
        kept = wanted[place] == term[some] if len(wanted) else np.zeros(len(place), bool)
        out = np.zeros((end - at, len(wanted)))
        out[item[some][kept] - at, place[kept]] = w[some][kept]
        return out

    for k, (at, end) in enumerate(blocks):
        own = np.unique(term[start[at] : start[end]])
        left = matrix(at, end, own)
        marked = (left != 0).astype(np.float32) if measure != "jaccard" else None
        step = max(1, BLOCK_CELLS // max(1, len(own)))
        for at_b, end_b in [(x, min(x + step, z)) for y, z in blocks[k:] for x in range(y, z, step)]:
            right = left if (at_b, end_b) == (at, end) else matrix(at_b, end_b, own)
            sim = left @ right.T
            if measure == "jaccard":
                union = sizes[at:end, None] + sizes[None, at_b:end_b] - sim
                sim = np.divide(sim, union, out=np.zeros(sim.shape), where=union > 0)
                shared = np.ones(sim.shape, bool)
            else:
                shared = marked @ (marked if right is left else (right != 0).astype(np.float32)).T > 0
            if at_b < end:
                shared &= np.arange(at, end)[:, None] < np.arange(at_b, end_b)[None, :]
            a, b = np.nonzero(shared)
            yield a + at, b + at_b, sim[a, b]


def pair_similarities(rows: DataFrame, key: str, kind: str, measure: str) -> DataFrame:
    """``(key, a, b, sim)`` of the items of each row of ``rows(key, items)``;
    ``items`` is ``array<struct<i, words>>`` with the tokens of an item."""
    kept = rows.where(F.size("items") > 1).select(
        key, F.col("items.i").alias("i"), F.col("items.words").alias("words")
    )
    of = {f.name: f.dataType for f in kept.schema.fields}
    schema = f"{key} {of[key].simpleString()}, a {of['i'].elementType.simpleString()}, b {of['i'].elementType.simpleString()}, sim double"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            numbers, lists = batch.column("i"), batch.column("words")
            flat = lists.flatten()
            codes = flat.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
            lengths = flat.value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(lengths)])
            counts = lists.value_lengths().to_numpy()
            first = np.concatenate([[0], np.cumsum(counts)])
            flat_numbers = numbers.flatten()
            held, size = [], 0

            def flushed():
                columns = [np.concatenate(c) for c in zip(*held)]
                return pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(columns[0])), *(flat_numbers.take(pa.array(c)) for c in columns[1:3]), pa.array(columns[3])],
                    names=[key, "a", "b", "sim"],
                )

            for r in range(batch.num_rows):
                at, end = first[r], first[r + 1]
                item = np.repeat(np.arange(end - at), lengths[at:end])
                for a, b, sim in similar(item, codes[ends[at] : ends[end]], int(end - at), kind, measure):
                    if len(a):
                        held.append((np.full(len(a), r), a + at, b + at, sim))
                        size += len(a)
                    if size >= RESULT_ROWS:
                        yield flushed()
                        held, size = [], 0
            if size:
                yield flushed()

    bound_batches(rows.sparkSession)
    # Spark rounds: quotients of small numbers often lie exactly between two results.
    return kept.mapInArrow(run, schema).withColumn("sim", place(F.col("sim")))
