"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A *window* is a run of ``window`` consecutive words of a benchmark item (the
whole item, if it is shorter). All windows are searched in every document at
once:

* the search alphabet is the word, so a match never starts inside a word;
* a *block* is two adjacent words. The shift table maps each block that occurs
  in some window to the smallest distance between its last position there and
  the window's end; any other block lets the search skip ``m - 1`` words;
* where the shift is zero, the block is the suffix of some windows: these lie
  in a bucket under the suffix, split again by the first block (the prefix);
* the few windows left are compared with the text word by word.

Windows shorter than ``window`` words get tables of their own per length, so
that one short item doesn't shorten every skip.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MADE = ("n_words", "n_hit", "n_items", "item_ids", "hit_spans", "contaminated")


class WuManber:
    """Search tables for patterns of one length, each a tuple of words."""

    def __init__(self, patterns: dict[tuple, tuple]):
        """``patterns``: words of a pattern -> ids of the items that hold it."""
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.skip = m - b + 1
        self.shift: dict = {}
        buckets: dict = defaultdict(lambda: defaultdict(list))
        for pattern, items in patterns.items():
            for end in range(b, m + 1):
                key = pattern[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.skip), m - end)
            buckets[pattern[m - b :]][pattern[:b]].append((pattern, items))
        self.buckets = {k: dict(v) for k, v in buckets.items()}

    def find(self, words: list):
        """Yield ``(start, items)`` of each occurrence, by start."""
        m, b, skip = self.length, self.block, self.skip
        shift, buckets, n = self.shift.get, self.buckets, len(words)
        i = m
        while i <= n:
            key = (words[i - 2], words[i - 1]) if b == 2 else (words[i - 1],)
            step = shift(key, skip)
            if step:
                i += step
                continue
            start = i - m
            for pattern, items in buckets[key].get(tuple(words[start : start + b]), ()):
                if tuple(words[start:i]) == pattern:
                    yield start, items
            i += 1


def build(items: list[tuple[str, bytes]], window: int) -> list[WuManber]:
    """Tables for ``(item id, text)`` rows, one per pattern length."""
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        found = common.words(text)
        m = min(window, len(found))
        for at in range(len(found) - m + 1 if m else 0):
            by_length[m][tuple(found[at : at + m])].add(item)
    return [
        WuManber({p: tuple(sorted(ids)) for p, ids in patterns.items()})
        for _, patterns in sorted(by_length.items())
    ]


def search(tables: list[WuManber], words: list) -> tuple[set, list[tuple[int, int]]]:
    """Items found and the disjoint, sorted word intervals that are hit."""
    items: set = set()
    seen: set = set()
    spans: list[tuple[int, int]] = []
    for t in tables:
        for start, ids in t.find(words):
            if id(ids) not in seen:
                seen.add(id(ids))
                items.update(ids)
            spans.append((start, start + t.length))
    return items, merged(spans)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals as sorted, disjoint ones."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, limit: int, window: int):
    """Benchmark rows in blocks of about ``limit`` text bytes; the driver holds
    one of them. A longer item is cut into pieces that share ``window - 1``
    words, so that every window lies in one of them."""
    rows = benchmark.select(common.named(item_id).cast("string"), common.named(item_text).cast("binary"))
    block: list[tuple[str, bytes]] = []
    size = 0
    for item, text in rows.toLocalIterator():
        for piece in _pieces(bytes(text or b""), limit, window):
            if block and size + len(piece) > limit:
                yield block
                block, size = [], 0
            block.append((item or "", piece))
            size += len(piece)
    yield block


def _pieces(text: bytes, limit: int, window: int):
    if len(text) <= limit:
        yield text
        return
    found = common.words(text)
    start = 0
    while True:
        end, size = start, 0
        while end < len(found) and (size <= limit or end - start < 2 * window):
            size += len(found[end]) + 1
            end += 1
        yield b" ".join(found[start:end])
        if end == len(found):
            return
        start = end - window + 1


#: Tables of the block that this worker process searched last.
_TABLES: dict = {}


def tables_of(name: str, block, window: int) -> list[WuManber]:
    """Tables of the broadcast block ``name``, built once per worker process."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = build(block.value, window)
    return _TABLES[name]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    carry: list[str] | None = None,
    block_bytes: int = 2 << 20,
) -> DataFrame:
    """Mark the words of ``docs`` that lie in windows of ``benchmark`` items.

    Adds ``n_words``, ``n_hit`` (words inside any occurrence), ``n_items``,
    ``item_ids`` (strings, sorted), ``hit_spans`` (disjoint word intervals,
    end exclusive) and ``contaminated`` to the columns ``carry`` (all, if
    None). The benchmark is read in blocks of about ``block_bytes``; each is
    broadcast and searched in a pass of its own over the documents, without a
    shuffle. A task runs one Python worker with the tables of one block (about
    200 times its bytes), however many blocks there are: between passes the
    rows are written to the shared folder. Benchmarks of one block, which is
    the rule, are searched in one pass that writes nothing.

    Defined cases: a null text has no words; long texts are searched as a
    whole; an item without words has no windows; a null item id counts as the
    empty string; an item id that occurs in several rows counts once; repeated
    documents each get their own row; an empty benchmark marks nothing, an
    empty table gives no rows; a document column named like an output column
    is left out, other names are free.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    own = common.Own(docs, carry, MADE)
    out = docs.select(*own.staged, common.named(text).alias("body"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    made = [
        T.StructField("n_words", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", span),
    ]
    schema = T.StructType([*common.fields(out, [*own.names, "body"]), *made])
    last = T.StructType([f for f in schema.fields if f.name != "body"])
    blocks = _blocks(benchmark, item_id, item_text, block_bytes, window)
    block, old = next(blocks), None
    for following in blocks:
        sent = spark.sparkContext.broadcast(block)
        out = common.cut(out.mapInArrow(_pass(sent, window, own.names, False), schema))
        sent.unpersist()
        if old is not None:
            common.drop_tables(old)
        block, old = following, out
    sent = spark.sparkContext.broadcast(block)
    out = out.mapInArrow(_pass(sent, window, own.names, True), last)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select(
        *own.restored,
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        "item_ids",
        "hit_spans",
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def _pass(block, window: int, keep: list[str], final: bool):
    name = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        from skerry.llm.decontaminate import tables_of  # the module of the worker, not a pickled copy

        tables = tables_of(name, block, window)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            names = batch.schema.names
            before = (
                zip(batch.column("item_ids").to_pylist(), batch.column("hit_spans").to_pylist())
                if "item_ids" in names
                else None
            )
            n_words, ids, hits = [], [], []
            for raw in common.as_bytes(batch.column("body")):
                found = common.words(raw)
                items, spans = search(tables, found)
                if before is not None:
                    old_items, old_spans = next(before)
                    items.update(old_items)
                    spans = merged([*spans, *((s["start"], s["end"]) for s in old_spans)])
                n_words.append(len(found))
                ids.append(sorted(items))
                hits.append([{"start": s, "end": e} for s, e in spans])
            kept = [*keep, *([] if final else ["body"])]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array(n_words, pa.int64()),
                    pa.array(ids, pa.list_(pa.string())),
                    pa.array(hits, span),
                ],
                names=[*kept, "n_words", "item_ids", "hit_spans"],
            )

    return run


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark, windows of 10 words."""
    docs = common.table(spark, sf_dir, "documents")
    found = decontaminate(docs, common.table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m,
         array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS gram
  FROM item_words, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(p) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT doc_id, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS gram
  FROM doc_words, lengths, unnest(range(1, len(w) - m + 2)) AS t(p)),
found AS (SELECT doc_id, item_id, p, places.m AS m FROM places JOIN windows USING (m, gram)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + m)) AS t(q) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS sha
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
