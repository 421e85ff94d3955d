"""Training-data operators against brute force, with the corner cases of each:
nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from skerry.llm import decontaminate, kdtree, licenses, mixing, pii, quality, shards, simhash, urlfilter, warc

DOCS = "doc_id long, text string, source string"
WORDS = "the of and ver dan la il to a be".split()


def texts(seed, n, lo=0, hi=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + rng.choice(["", ".", ", X"]) for _ in range(rng.randint(lo, hi))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(texts(1, 60))]
    rows += [(100, None, None), (101, "", "s1"), (None, "la of the", "s0"), (5, rows[5][1], "s2"), (5, rows[5][1], "s2")]
    rows += [(102, "word " * 5000, "s0"), (103, rows[3][1] + " end", "s0")]
    return spark.createDataFrame(rows, DOCS)


def clash(df, *names):
    return df.withColumns({n: F.lit(-1) for n in names})


# 1 ---------------------------------------------------------------------------


def brute_words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_hits(text, items):
    w, hit, found = brute_words(text), set(), set()
    for item, t in items:
        p = brute_words(t)
        m = min(10, len(p))
        for s in range(len(p) - m + 1 if m else 0):
            for at in range(len(w) - m + 1):
                if w[at : at + m] == p[s : s + m]:
                    hit.update(range(at, at + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontaminate(spark, docs, block):
    rows = [r.text for r in docs.collect() if r.text]
    items = [(1, rows[0]), (2, "the of"), (12, " ".join(rows[3].split()[2:14])), (3, None), (4, ""), (2, "the of"), (5, "LA")]
    items += [(6, texts(9, 1, 30, 40)[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(clash(docs, "N_Hit"), bench, carry=["doc_id", "text", "N_Hit"], block_bytes=block)
    assert got.columns[:2] == ["doc_id", "text"] and "N_Hit" not in got.columns
    out = got.collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_words, r.n_hit, r.item_ids) == brute_hits(r.text, items)
        assert r.contaminated == (r.n_hit > 0) and r.n_items == len(r.item_ids)
    none = decontaminate.decontaminate(docs, bench.limit(0), carry=["doc_id"])
    assert {r.n_hit for r in none.collect()} == {0}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


# 2 ---------------------------------------------------------------------------


@pytest.mark.parametrize("rows_per_task", [250_000, 4])
def test_shards(spark, docs, rows_per_task):
    out = shards.shard(clash(docs, "slot"), n_shards=5, rows_per_task=rows_per_task, carry=["doc_id", "text", "slot"]).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        data = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "bytes")
        by.setdefault(r.shard, []).append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert set(by) <= set(range(5))
    assert shards.shard(docs.limit(0)).count() == 0


def test_shards_even(spark):
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("abc def").alias("text"))
    copies = spark.range(1500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("abc def").alias("text"))
    out = shards.shard(same.unionByName(copies), n_shards=24, rows_per_task=50).groupBy("shard").agg(F.sum("size").alias("b"))
    sizes = [r.b for r in out.collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * 15


# 3 ---------------------------------------------------------------------------


def test_licenses(spark):
    cases = [
        "Licensed under the Apache License, Version 2.0.",
        "GNU General\nPublic License, version 3; GNU general public license",
        "CC BY-NC 4.0 cc by cc by",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "mit haus", "", None, "Released under the MIT License.",
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(clash(df, "score"), carry=["doc_id"]).collect()}
    for k, text in enumerate(cases):
        w = brute_words(text)
        places = sorted(
            (s, label) for p, label in licenses.PHRASES.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()
        )
        r = got[k]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert [got[k].labels for k in (0, 3, 4)] == ["apache,apache-2.0", "gpl-2.0-or-later", ""]
    assert got[1].labels == "gpl,gpl-3.0" and got[2].labels == "cc-by,cc-by-nc-4.0"
    assert len(licenses.rules()) > 200
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_scan_matches_brute_force():
    """All rules without the keyword gate, and suppression by comparing all pairs."""
    rng = random.Random(5)
    pieces = [
        "licensed under the gpl 2 0 license", "GNU General Public License version 2 or any later version", "apache license version 2 0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "redistribution and use in source and binary forms, with or without modification, are permitted", "gcc runtime library exception",
        "Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "copyright (c) 2019", "all rights reserved", "spdx license identifier mit", "cc by sa 4 0", "creativecommons org licenses by nc sa 4 0",
        "the mit license", "GPL-3.0-or-later", "SPDX-License-Identifier: LGPL-2.1-or-later", "free documentation", "public domain", "zlib license",
    ]
    seen = set()
    for _ in range(120):
        text = " ".join(rng.choice(pieces) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(rng.randint(1, 9)))
        w = [x.encode() for x in brute_words(text)]
        line, starts = b" " + b" ".join(w) + b" ", []
        for x in w:
            starts.append(starts[-1] + len(w[len(starts) - 1]) + 1 if starts else 1)
        hits = []
        for rule in licenses.rules():
            for m in rule.pattern.finditer(line):
                hits.append((starts.index(m.start()), sum(s < m.end() for s in starts), rule))
        kept = []
        for d in sorted(hits, key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].name)):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        n, _, found = licenses.scan(text.encode())
        assert n == len(w) and found == sorted(kept, key=lambda d: (d[0], d[1], d[2].name)), text
        seen |= {r.label for _, _, r in found}
    assert len(seen) > 12 and len({r.name for r in licenses.rules()}) == len(licenses.rules()) > 450


def test_suppression():
    a, b, *_ = licenses.rules()
    kept = licenses.suppressed([(0, 5, b), (1, 4, b), (0, 5, a), (4, 9, b)])
    strong, weak = sorted([a, b], key=lambda r: (r.priority, r.name))
    assert (0, 5, strong) in kept and (1, 4, b) not in kept and (4, 9, b) in kept


# 4 ---------------------------------------------------------------------------


def brute_host(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def test_url_filter(spark):
    urls = ["http://A.net/x?q=1", "https://m.example.net/en/2", "http://example.com/de/1", "http://x.org/fr/", "http://a.net", None, "nope"]
    urls += [f"http://h{k}.example.com/en/{k}" for k in range(30)] + [f"http://spam{k}.net/de/{k}" for k in range(30)]
    urls += ["http://z.org/de/3#x", "http://notnet/1", "http://a.net/x", "http://a.net/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = urlfilter.filter_urls(clash(df, "host"), carry=["page_id", "url", "host"]).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = brute_host(r.url)
        fits = [
            (len(h + p), h + p, v) for v, h, p in urlfilter.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        want = max(fits)[1:] if fits else (None, None)
        assert (r.host, r.path, r.rule) == (host, path, want[0])
        assert r.verdict == want[1] if fits else r.verdict in ("allow", "block")
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


def test_mining_matches_brute_force(spark, monkeypatch):
    """All token sets counted by hand; a mined rule decides; long URLs keep their last tokens."""
    from itertools import combinations

    rng = random.Random(7)
    rows = []
    for k in range(120):
        tokens = sorted({*rng.sample("abcdef", rng.randint(1, 4)), "z"})
        rows.append((k, tokens, "block" if "a" in tokens and "b" in tokens else rng.choice(["allow", "allow", "block"])))
    rows += [(500, ["a"], None)]
    df = spark.createDataFrame(rows, "key long, tokens array<string>, verdict string")
    rules, prior, _ = urlfilter.mine(df, min_support=0.05, min_confidence=0.6)
    labelled = [(set(t), v) for _, t, v in rows if v]
    want = {}
    for size in range(1, 8):
        for need in combinations("abcdefz", size):
            held = [v for t, v in labelled if t.issuperset(need)]
            for v in ("allow", "block"):
                k = held.count(v)
                if held and k / len(held) >= 0.6 and k / len(labelled) >= 0.05:
                    want[frozenset(need), v] = k / len(held)
    best = {
        (n, v) for (n, v), c in want.items()
        if not any(m < n and u == v and d >= c for (m, u), d in want.items())
    }
    assert {(r.needs, r.verdict) for r in rules} == best and len(best) > 5
    assert {r.confidence for r in rules} <= set(want.values())
    assert prior == max(("allow", "block"), key=[v for _, v in labelled].count)

    urls = [f"http://a{k}.net/{'/'.join('abcdefghijklmnopqrst')}?bad=1" for k in range(40)] + [f"http://c{k}.org/fr/x" for k in range(60)]
    urls += ["http://unlisted.com/?bad=2", "http://plain.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.url: r for r in urlfilter.filter_urls(pages).collect()}
    deep = got["http://unlisted.com/?bad=2"]
    assert (deep.verdict, deep.mined_rule is not None, deep.rule) == ("block", True, None)
    assert got["http://plain.com/"].verdict == "allow"  # the prior: 60 of 100
    monkeypatch.setattr(urlfilter, "BASKET", 3)
    few, raised, _ = urlfilter.baskets_of(df.where("verdict IS NOT NULL"), 0.05)
    assert raised > 0.05 and few.agg(F.max(F.size("items"))).first()[0] <= 4


def test_mined_rules_match_brute_force():
    rng = random.Random(3)
    rules = [urlfilter.MinedRule(frozenset(rng.sample("abcdef", rng.randint(1, 3))), rng.choice(["allow", "block"]), rng.random(), 0.1) for _ in range(40)]
    index = urlfilter.inverted(rules)
    for _ in range(200):
        found = rng.sample("abcdef", 3)
        hits = [r for r in rules if r.needs <= set(found)]
        best = min(hits, key=lambda r: (-r.confidence, -r.support, r.name, r.verdict), default=None)
        assert urlfilter.decide(found, index) is best


# 5 ---------------------------------------------------------------------------


def test_topk(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, 0.7]) for _ in range(6)]) for k in range(300)]
    rows += [(400 + k, [0.5] * 6) for k in range(100)]  # one common vector
    rows += [(50, rows[50][1]), (501, None), (502, [float("nan")] * 6), (503, [None] * 6), (504, [1.0, 2.0]), (None, [1.0] * 6), (505, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, kdtree.top_k(df, F.col("vec_id") % 50 == 0, k=5, shard_rows=(64, 64), block_rows=4).collect()))
    import numpy as np

    vecs = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows[:400]}
    want = []
    for q in (i for i in vecs if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(vecs[q], v)), i) for i, v in vecs.items() if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert kdtree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_kdtree_prunes_exactly():
    import numpy as np

    rng = np.random.default_rng(1)
    v, ids = rng.integers(-3, 4, (500, 3)), rng.permutation(500)
    tree = kdtree.KDTree(ids, v, leaf=8)
    for q in rng.integers(-3, 4, (50, 3)).astype(float):
        want = sorted(((int(x @ q), int(i)) for x, i in zip(v, ids)), key=lambda x: (-x[0], x[1]))[:7]
        assert tree.search(-1, q, tree.bounds(q[None])[0], 7) == want
        assert tree.search(-1, q, tree.bounds(q[None])[0], 7, want[3]) == want[:3]


# 6 ---------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/ b\n", big), (2, "u", big), (3, None, big), (4, "u", "x" * 10), (5, "u", "x" * 10), (6, "u", None), (7, "u", ""), (3, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(df, path)
    got = sorted((tuple(r) for r in warc.read_archives(spark, path).collect()), key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and i != 3
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=str)
    warc.write_archives(df.limit(0), path + "0")
    assert warc.read_archives(spark, path + "0").count() == 0


# 7 ---------------------------------------------------------------------------


def test_mix(spark, docs):
    import math

    out = mixing.mix(clash(docs, "copies"), carry=["doc_id", "source", "copies"]).collect()
    rows = docs.collect()
    size, total = {}, 0
    for r in rows:
        b = len((r.text or "").encode()) + 1
        size[r.source] = size.get(r.source, 0) + b
        total += b
    want = 0
    for r in rows:
        rate = total / len(size) / size[r.source]
        parts, k = max(1, math.ceil(rate / 64)), 0
        for part in range(parts):  # a high rate is the sum of draws of equal means
            name = f"7:{'-' if r.doc_id is None else r.doc_id}" + (f":{part}" if part else "")
            u = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2**52
            n, c, mean = 0, math.exp(-rate / parts), rate / parts
            while c <= u:
                n += 1
                c += math.exp(-mean + n * math.log(mean) - math.lgamma(n + 1))
            k += n
        want += k
        assert sum(x.doc_id == r.doc_id and x.source == r.source for x in out) == k * sum(
            y.doc_id == r.doc_id and y.source == r.source for y in rows
        )
    assert len(out) == want
    assert mixing.mix(docs.limit(0)).count() == 0
    none = mixing.mix(docs, spark.createDataFrame([("s0", 1.0)], "source string, weight double")).collect()
    assert {r.source for r in none} <= {"s0"}
    with pytest.raises(ValueError):
        mixing.mix(docs, max_rate=10.0)


def test_mix_high_rate(spark, monkeypatch):
    """A rate of a million in linear time, with the mean and spread of Poisson; sources joined, not broadcast."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = [(0, "", "rare"), (1, "x" * 1_999_998, "usual"), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, max_rate=1e7).groupBy("source").agg(F.count("*").alias("n"), F.max("rate").alias("rate"))
    found = {r.source: (r.n, r.rate) for r in out.collect()}
    for source in ("rare", None):
        n, rate = found[source]
        assert rate > 600_000 and abs(n - rate) < 6 * rate**0.5


def test_mix_names(spark):
    rows = [(1, "a b", "s", "kept", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, own_0 string, src int")
    assert {(r.own_0, r.src) for r in mixing.mix(df).collect()} <= {("kept", 5)}


# 8 ---------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for k in range(500):
        good = rng.random() < 0.8
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 60))]
        rows.append((k, " ".join(words if good else [w.upper() + "##" for w in words])))
        marks.append((k, int(good)))
    rows += [(900, None), (901, ""), (None, "the of"), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (901, None), (1, marks[1][1])], "doc_id long, quality int")
    model = quality.train(df, labels)
    out = quality.score(clash(df, "score"), model, carry=["doc_id", "score"]).collect()
    truth = dict(marks)
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]
    blank = quality.train(df, labels.limit(0))
    assert {r.score for r in quality.score(df, blank).collect()} == {0.5}
    assert quality.score(df.limit(0), model).count() == 0


# 9 ---------------------------------------------------------------------------


def test_simhash_links(spark):
    import numpy as np

    rng = random.Random(6)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)}  # one crowded bucket
    prints |= {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:100]:
        q = p
        for _ in range(rng.randint(1, 4)):
            q ^= 1 << rng.randrange(64)
        prints.add(q)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = find(signed[i]), find(signed[j])
                parent[max(x, y)] = min(x, y)
    assert {s: roots.get(s, s) for s in signed} == {s: find(s) for s in signed}
    sample = np.array(prints, np.uint64)
    for n in (10, 10**6, 10**9):
        parts = simhash.plan(sample, n, 2)
        assert sum(t + 1 for _, t in parts) == 3
        assert len({b for g, _ in parts for b in g}) == sum(len(g) for g, _ in parts)


def test_near_duplicates(spark, docs):
    import xxhash

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    out = simhash.near_duplicates(clash(docs, "Fingerprint"), carry=["doc_id", "text", "Fingerprint"]).collect()
    assert len(out) == docs.count()
    prints = [(r.doc_id, brute(r.text)) for r in out]
    for r in out:
        assert r.fingerprint == format(brute(r.text), "016x")
        seen, todo = set(), [brute(r.text)]
        while todo:
            f = todo.pop()
            if f not in seen:
                seen.add(f)
                todo += [g for _, g in prints if (f ^ g).bit_count() <= 2]
        assert r.component_id == min((i for i, f in prints if f in seen and i is not None), default=None)
    kept = simhash.keep_first(docs).collect()
    ids = [r.component_id for r in out]
    assert len(kept) == len({*ids}) and all(k.asDict().keys() == {"doc_id", "text", "source"} for k in kept)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# 10 --------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def luhn(d):
    return sum(v if not i % 2 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(t):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 13 <= len(d) <= 19 and luhn(d))
                or (kind == "phone" and 9 <= len(d) <= 15)
            ):
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark):
    rng = random.Random(8)
    rows = [
        "a@b.c_d@e.f é😀 x@y.z.w..v", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1..2.3.4.5", "4111 1111 1111 1111, 4111-1111-1111-1112",
        "+1 (771) 555-1655 On. ++12 3456789 +123", "4111111111111111 4111111111111111", "5 4111 1111 1111 1111 5", None, "",
        "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", "ssn 123-45-6789", "no 123-45-6789", "a" * 20000 + "@b", "1" * 20000,
    ]
    pool = list("0123456789") * 3 + list("..@ +-()aZ_%é")
    rows += ["".join(rng.choice(pool) for _ in range(200)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(clash(df, "found"), carry=["doc_id"]).collect()}
    for k, text in enumerate(rows):
        base = [(s.kind, s.start, s.end) for s in got[k].found if s.kind in pii.BASE]
        assert base == brute_pii(text), text
        assert got[k].n_email == sum(s[0] == "email" for s in base)
    many = spark.createDataFrame([(1, "ip 1.2.3.4, " * 100_000)], "doc_id long, text string")
    spans = pii.find_pii(many, carry=[]).collect()[0].found
    assert [(x.start, x.end) for x in spans] == [(3 + 12 * k, 10 + 12 * k) for k in range(100_000)]
    assert {x.score for x in spans} == {0.8}
    after = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00 BIC 12")], "doc_id long, text string")
    assert [tuple(x)[:3] for x in pii.find_pii(after).collect()[0].found] == [("iban", 5, 32)]
    added = {k: [s.kind for s in got[k].found if s.kind not in pii.BASE] for k in (8, 9, 10)}
    assert added == {8: ["iban", "iban"], 9: ["ssn"], 10: []}
    assert pii.find_pii(df.limit(0)).count() == 0
