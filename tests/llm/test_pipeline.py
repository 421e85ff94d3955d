"""The corpus pipeline against a brute-force version, stage by stage."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skerry.llm import neardup, quality

WORDS = "the of and ver dan la il to a be sun sea".split()


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(260):
        good = rng.random() < 0.75
        words = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randint(30, 80))]
        rows.append((k, " ".join(words if good else [w.upper() + "##" for w in words]), "en", f"s{k % 2}", 1))
        labels.append((k, int(good), 0))
    good = [k for k, q, _ in labels if q]
    rows += [(500 + k, rows[good[0]][1], "en", "s0", 1) for k in range(5)]
    item = " ".join(rows[good[1]][1].split()[5:20])
    folder = str(tmp_path)
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{len(kept)}")
        docs = spark.read.parquet(f"{folder}/{len(kept)}")
        kept[name] = sorted(r.doc_id for r in docs.collect())
    assert kept["quality classifier"] == sorted([*good, *range(500, 505)])
    assert kept["SimHash near-dedup"] == good
    assert kept["benchmark decontamination"] == [k for k in good if k != good[1]]
    # Mixing by hand: sources of the documents left weigh the same.
    left = [r for r in rows if r[0] in set(kept["benchmark decontamination"])]
    size = {}
    for _, text, _, source, _ in left:
        size[source] = size.get(source, 0) + len(text.encode()) + 1
    copies = {}
    for k, _, _, source, _ in left:
        rate = sum(size.values()) / len(size) / size[source]
        u = int(hashlib.md5(f"7:{k}".encode()).hexdigest()[:13], 16) / 2**52
        n, c = 0, math.exp(-rate)
        while c <= u:
            n += 1
            c += math.exp(-rate + n * math.log(rate) - math.lgamma(n + 1))
        copies[k] = n
    texts, sources = {k: t for k, t, *_ in rows}, {k: s for k, _, _, s, _ in rows}
    final = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in final) == Counter({k: n for k, n in copies.items() if n})
    # Shards: gapless slots, whole rows, near equal bytes, copies apart.
    shards = {}
    for r in final:
        assert (r.text, r.source, r.lang) == (texts[r.doc_id], sources[r.doc_id], "en")
        assert (r["size"], r.text_crc32) == (len(r.text.encode()) + 8, zlib.crc32(r.text.encode()))
        shards.setdefault(r.shard, []).append(r)
    for rows_ in shards.values():
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
    mean = sum(r["size"] for r in final) / 24
    assert set(shards) <= set(range(24)) and max(sum(r["size"] for r in x) for x in shards.values()) < 2 * mean
    pairs = [(r.doc_id, r.shard) for r in final if copies[r.doc_id] > 1]
    assert len(set(pairs)) > 0.8 * len(pairs)
    assert len(quality.FEATURES) == len(quality.features(b""))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables in every stage."""
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, copies string, row int, slot string"
    extra = ("own", "mine", 3, "old")
    rows = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(30)), "en", f"s{k % 2}", 1, *extra) for k in range(30)]
    rows += [(None, "null id the of and", None, None, None, *extra), (40, None, "en", "s0", 0, *extra), (41, "", "en", "s0", 0, *extra)]
    rows += [(42, "long " * 200_000, "en", "s1", 1, *extra), rows[3], rows[3]]
    folder = str(tmp_path)
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    whole = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, whole, folder)
        got = out.collect()
        if name == "sharding":
            assert set(whole.columns) - {"slot"} < set(out.columns) and len(got) == len(rows)
        else:
            assert out.columns == whole.columns
            assert {(r.score, r.copies, r.row, r.slot) for r in got} == {extra}
            assert {r.doc_id for r in got} <= {r[0] for r in rows}
        if name == "SimHash near-dedup":
            ids = [r.doc_id for r in got]
            assert ids.count(3) == 1 and 42 in ids and (40 in ids) and 41 not in ids and None in ids
        if name == "benchmark decontamination":
            assert 5 not in [r.doc_id for r in got] and len(got) < len(rows)
        assert stage(spark, whole.where(F.lit(False)), folder).count() == 0


@pytest.mark.parametrize("bucket", [neardup.BUCKET, 3])
def test_near_copies(spark, bucket, monkeypatch):
    """Planted near copies against all pairs, also through crowded buckets."""
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    rng = random.Random(2)
    bases = [[rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n)] for n in (40, 60, 100, 200, 300)]
    rows = [" ".join(b) for b in bases] + ["", " ", None, "one two", "ONE two"]
    for _ in range(150):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append(" ".join(words[rng.randrange(4) :]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}

    sets, first = [shingles(t) for t in rows], list(range(len(rows)))
    pairs = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                pairs += a != sets[j]
                x, y = first[i], first[j]
                first = [min(x, y) if f in (x, y) else f for f in first]
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted(set(first)) and pairs > 400 and len(got) < 120
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where(F.lit(False)), "").count() == 0


def test_parities_differ_in_no_more_bits_than_the_sets():
    """Digests and sketches never exclude a pair that is similar enough."""
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (0, 1, 60, 130, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for share in (0.0, 0.1, 0.5, 1.0):
            new = rng.integers(0, 1 << 63, int(size * share), dtype=np.uint64)
            b = np.unique(np.concatenate([a[len(new) :], new]))
            apart = len(np.setxor1d(a, b))
            assert sum(int(x).bit_count() for x in neardup.digest(a) ^ neardup.digest(b)) <= apart
            if len(neardup.sketch(a)) == len(neardup.sketch(b)):
                assert sum(int(x).bit_count() for x in neardup.sketch(a) ^ neardup.sketch(b)) <= apart


def near_copies(spark, seed, n, words, changes):
    rng = random.Random(seed)
    base = [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(words)]
    rows = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(1, changes)):
            copy[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    others = [" ".join(f"o{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(rows + others)), "doc_id long, text string")


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    """The search of SimHash fingerprints alone, without any prefix."""
    monkeypatch.setattr(neardup, "prefix", lambda values, frequent, s: values[:0])
    for n in (20, 120):  # paired off, and a crowded bucket
        docs = near_copies(spark, n, n, 300, 2)
        got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
        assert got == [0, *range(n, 2 * n)]


def test_fingerprint_pairs(spark):
    """All pairs within the radius that pigeonhole covers, none beyond the other."""
    rng = random.Random(4)
    prints = [rng.getrandbits(128) for _ in range(200)]
    for k in range(100):
        prints.append(prints[k] ^ sum(1 << b for b in rng.sample(range(128), k % 45)))
    rows = [(k, [int.from_bytes((p >> 64 * j & 2**64 - 1).to_bytes(8), signed=True) for j in range(2)]) for k, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "fp long, print array<long>")
    s = Fraction("0.8")
    covered = sum(3 * len(groups) for groups in neardup.partitions(len(rows), nodes)) - 1
    found = {tuple(r) for pairs in neardup.simhash_pairs(nodes, s, 32) for r in pairs.collect()}
    apart = {(i, j): (prints[i] ^ prints[j]).bit_count() for j in range(len(prints)) for i in range(j)}
    assert {p for p, bits in apart.items() if bits <= min(covered, neardup.radius(s))} <= found
    assert max(apart[p] for p in found) <= neardup.radius(s) < 45 and covered >= 17 and len(found) > 60


def test_crowded_buckets_emit_a_pair_once(spark, monkeypatch):
    """However many shingles two texts of a crowded bucket share."""
    emitted = []
    likely = neardup._likely

    def counted(pairs, nodes, s):
        emitted.append((pairs.count(), pairs.distinct().count()))
        return likely(pairs, nodes, s)

    none = spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(neardup, "by_simhash", lambda *args, **kwargs: none, raising=False)
    monkeypatch.setattr(neardup, "_likely", counted)
    monkeypatch.setattr(neardup, "BUCKET", 3)
    docs = near_copies(spark, 5, 60, 100, 5)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").count()
    assert 60 < left < 120 and len(emitted) > 1
    assert all(rows == pairs for rows, pairs in emitted[1:]) and emitted[1][0] > 0
