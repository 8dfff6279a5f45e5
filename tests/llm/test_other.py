import datetime
import hashlib
import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import media, mixing, quality, sharding, topk, urls


# Media -----------------------------------------------------------------------------------------------------------


def test_media_round_trip(docs, rows, empty):
    out = media.media_features(media.to_media(docs)).collect()
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert len(out) == len(rows)
    for r in out:
        raw = texts[r.row.doc_id]
        assert r.row.n_bytes == len(raw)
        assert bytes(r.payload) == raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.codec, r.timescale, r.duration, r.error) == ("raw ", media.RATE, len(r.payload), None)
        assert all(bytes(r.media[k.offset : k.offset + k.size]) == bytes(r.payload[i * 8 * 4096 : i * 8 * 4096 + k.size]) for i, k in enumerate(r.keyframes))
    assert media.media_features(media.to_media(empty)).count() == 0


def test_damaged_media(spark):
    good = media.encode(b"x" * 5000)
    df = spark.createDataFrame([(1, good), (2, good[:-1]), (3, b""), (4, None), (5, b"\0\0\0\4free"), (6, good[:40])], "doc_id long, media binary")
    out = {r.row.doc_id: r for r in media.media_features(df.withColumn("codec", F.lit("clash"))).collect()}
    assert out[1].row.codec == "clash" and out[1].codec == "raw "
    assert out[1].error is None and out[1].n_samples == 2
    assert all(out[i].error and out[i].payload is None for i in range(2, 7))


def test_media_fuzz():
    """Flipped bytes, cuts, deep nesting and wrong tables are told, never anything but a ValueError, and never a sample outside the file."""
    rng = np.random.default_rng(6)
    good = media.encode(rng.bytes(40_000))
    cases = [good[:n] for n in range(0, len(good), 997)]
    for _ in range(3000):
        raw = bytearray(good[:1200] + good[-300:] if rng.random() < 0.2 else good)
        for at in rng.integers(0, 900, int(rng.integers(1, 4))):
            raw[at] = int(rng.integers(0, 256))
        cases.append(bytes(raw))
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    cases += [deep, good + media.box(b"moof", b"")]
    at = good.index(b"stss") + 12
    cases += [good[:at] + x + good[at + 4 :] for x in (b"\0\0\0\0", b"\xff\xff\xff\xff")]
    at = good.index(b"stsz") + 8
    cases.append(good[:at] + b"\0\0\0\1\xff\xff\xff\xff" + good[at + 8 :])
    told = 0
    for raw in cases:
        try:
            tracks = media.parse(raw)
        except ValueError:
            told += 1
            continue
        assert all(0 <= x and x + n <= len(raw) for t in tracks for x, n in t["samples"])
        assert all(0 <= k < len(t["samples"]) for t in tracks for k in t["keys"])
    assert told > 500
    for raw in cases[-5:]:
        with pytest.raises(ValueError):
            media.parse(raw)


def test_media_query(spark, tables):
    """The registered query over its whole table: the payload is read back, its digests are those of the padded text."""
    out = {r.doc_id: r for r in media.op8_media_columns(spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    assert len(out) == len(docs)
    for r in docs:
        raw = (r.text or "").encode()
        padded, x = raw + bytes(-len(raw) % 64 or (0 if raw else 64)), out[r.doc_id]
        file = media.encode(padded)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (x.media_bytes, x.media_sha256) == (len(file), hashlib.sha256(file).hexdigest()) and padded in file


# Sharding --------------------------------------------------------------------------------------------------------


def test_schedule_is_longest_processing_time():
    rng = np.random.default_rng(0)
    for _ in range(20):
        weights = {int(w): int(n) for w, n in zip(rng.integers(1, 60, 9), rng.integers(1, 300, 9), strict=True)}
        heap, expected = [(0, i) for i in range(5)], []
        for w, n in sorted(weights.items(), reverse=True):
            got = Counter()
            for _ in range(n):
                load, i = heapq.heappop(heap)
                got[i] += 1
                heapq.heappush(heap, (load + w, i))
            expected.append((w, dict(got)))
        assert [(w, {i: b - a for i, a, b in zip(s, [0, *e], e, strict=False)}) for w, s, e in sharding.schedule(list(weights.items()), 5)] == expected


def test_shards(docs, rows, empty):
    out = sharding.shard(docs, 4).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    of = {r.doc_id: r.shard for r in out}
    same = {}
    for r in rows:
        same.setdefault(r[1], set()).add(of[r[0]])
    assert all(len(s) == 1 for s in same.values())
    for k in range(4):
        slots = sorted((r.slot, r.doc_id) for r in out if r.shard == k)
        assert [s for s, _ in slots] == list(range(len(slots))) and [d for _, d in slots] == sorted(d for _, d in slots)
    loads = Counter()
    for r in out:
        loads[r.shard] += r.size
    light = sorted(loads.values())[:-1]  # one text is larger than a fair shard
    assert light[-1] - light[0] <= 16
    assert sharding.shard(empty, 4).count() == 0


# Top k -----------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(300)]
    bad = [(1000, None), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1200, [float("nan")] * 6), (1300, [float("inf")] * 6), (1400, []), (1500, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").repartition(4)
    out = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 7).collect())
    m = np.floor(np.array([v for _, v in vectors]) * 1024).astype(int)
    expected = []
    for q in (0, 100, 200):
        s = m @ m[q]
        order = [j for j in np.lexsort((np.arange(300), -s)) if j != q][:7]
        expected += [(q, k + 1, j, s[j]) for k, j in enumerate(order)]
    assert out == expected
    few = df.where("vec_id < 4")
    assert topk.top_k(few, F.col("vec_id") == 0, 7).count() == 3
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0, 7).count() == 0


def test_products_stay_exact():
    big = np.array([[2.0**40, 3.0, -1.0]])
    assert topk.products(big, big)[0, 0] == 2**63 - 1
    mid = np.array([[2.0**29 + 1, 3.0]])
    assert topk.products(mid, mid)[0, 0] == (2**29 + 1) ** 2 + 9


# Mixing ----------------------------------------------------------------------------------------------------------


def chosen(rows, random, word, weights=(3, 1, 2), share=1.5, most=2.0, pull=0.25):
    """{doc_id: (size, source_size, target, taken)} by the method, one document after the other. rows: (doc_id, text, source)."""
    size = {d: len(word.findall(t or "")) for d, t, _ in rows}
    sums = Counter()
    for d, _, s in rows:
        sums[s] += size[d]
    weight = {s: weights[i % 3] for i, s in enumerate(sorted(sums, key=lambda s: (s is None, s or "")))}
    budget, capped, rate = share * sum(sums.values()), {}, 0.0
    while True:
        left = {s: w for s, w in weight.items() if s not in capped}
        if not left:
            break
        rate = (budget - sum(capped.values())) / sum(left.values())
        over = {s: most * sums[s] for s, w in left.items() if w * rate > most * sums[s]}
        if not over:
            break
        capped |= over
    out = {}
    for s in sums:
        target = capped[s] if s in capped else weight[s] * rate
        own = [d for d, _, x in rows if x == s]
        low, high = 0.0, 1e9  # the scale, by halving
        for _ in range(300):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(size[d] * min(most, mid * size[d] ** pull) for d in own if size[d]) < target else (low, mid)
        copies = {d: min(most, high * size[d] ** pull) if size[d] else 0.0 for d in own}
        taken = {d: math.floor(copies[d] + 1e-9) for d in own}
        rest = target - sum(taken[d] * size[d] for d in own)
        p = {d: copies[d] - taken[d] for d in own}
        for d in sorted((d for d in own if p[d] > 1e-9), key=lambda d: (random[d] / (1 - random[d])) / (p[d] / (1 - p[d]))):
            if size[d] / 2 > rest:
                break
            taken[d] += 1
            rest -= size[d]
        out |= {d: (size[d], sums[s], target, taken[d] * size[d]) for d in own}
    return out


def check_mix(docs, out, word):
    random = {r.doc_id: r.u for r in docs.select("doc_id", mixing.random(F.col("doc_id"), F.col("source"), F.col("text")).alias("u")).collect()}
    expected = chosen([(r.doc_id, r.text, r.source) for r in docs.collect()], random, word)
    found = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in out.collect()}
    assert found.keys() == expected.keys()
    for d, (size, total, target, taken) in expected.items():
        assert found[d][:2] == (size, total) and math.isclose(found[d][2], target, rel_tol=1e-9, abs_tol=1e-9) and found[d][3] == taken <= 2 * size, d
    return expected


def test_mix_equals_the_method(spark, docs, word):
    out = mixing.mix(docs)
    expected = check_mix(docs, out.select("row.doc_id", "size", "source_size", "target", "taken"), word)
    taken, target, longest = Counter(), {}, Counter()
    for r in docs.collect():
        size, _, target[r.source], words = expected[r.doc_id]
        taken[r.source] += words
        longest[r.source] = max(longest[r.source], size)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    assert {r.row.key for r in out.collect()} == {"k"}  # columns of any name come along
    again = mixing.mix(docs.repartition(3)).select("row.doc_id", "taken").collect()
    assert {tuple(r) for r in again} == {(d, x[3]) for d, x in expected.items()}


def test_mix_edges(spark, docs, empty):
    assert mixing.mix(empty).count() == 0
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, None, "s"), (None, "c d e", None), (3, "", "t")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 5 and len({r.copies for r in out if r.row.doc_id == 1}) == 1
    assert all(r.copies == 0 for r in out if r.size == 0) and all(0 <= r.copies <= 2 for r in out)


def test_mix_query_equals_the_method(spark, tables, word):
    """The registered query over its whole table."""
    out = mixing.op9_pareto_mix(spark, tables)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    check_mix(spark.read.parquet(f"{tables}/documents.parquet"), out, word)


# Quality ---------------------------------------------------------------------------------------------------------


def labelled(spark, n=300):
    rng = np.random.default_rng(8)
    words = [f"v{i}" for i in range(300)]
    good = lambda: " ".join(rng.choice(words, 60))
    junk = lambda: " ".join(f"{w.upper()}!!" for w in rng.choice(words, 60))
    rows = [(i, junk() if i % 4 == 0 else good(), int(i % 4 > 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: q for i, _, q in rows}


def test_quality_on_held_out_rows(spark, empty):
    docs, labels, truth = labelled(spark)
    model = quality.train(docs, labels)
    out = quality.score(docs.withColumn("score", F.lit(1)).withColumn("c0", F.lit("x")), model)
    assert out.columns == ["score", "row"] and out.first().row.c0 == "x"
    got = {r.row.doc_id: r.score for r in out.collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values())
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 30
    assert all((got[d] >= 0.3) == bool(truth[d]) for d in held)
    assert quality.score(empty, model).count() == 0


def test_quality_without_labels(spark):
    docs, labels, _ = labelled(spark, 20)
    assert all(r.score > 0.9 for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect())


def test_ratios_and_descent():
    rows, y = [np.array([0, 1]), np.array([0, 2]), np.array([0, 1])], np.array([1, 0, 1])
    r = quality.log_count_ratios(rows, y)
    assert r[1] > 0 > r[2]
    w, b = quality.descend(rows, [quality.scaled(r[f]) for f in rows], y, np.full(3, 10.0))
    margins = [b + w[f] @ quality.scaled(r[f]) for f in rows]
    assert [m > 0 for m in margins] == [True, False, True]


def test_descent_reaches_the_optimum():
    """The objective comes out as an independent solver (projected gradient ascent on the dual) has it."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6)) * (rng.random((40, 6)) < 0.6)
    y = (x[:, 0] + rng.normal(size=40) > 0).astype(int)
    rows, cost = [np.flatnonzero(r) for r in x], np.full(40, 2.0)
    w, b = quality.descend(rows, [x[i, f] for i, f in enumerate(rows)], y, cost, rounds=3000)
    own = np.hstack([x, np.ones((40, 1))]) * np.where(y > 0, 1, -1)[:, None]
    objective = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - own @ v)).sum()
    alpha, gram = np.zeros(40), own @ own.T
    for _ in range(40_000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, cost)
    dual = alpha.sum() - alpha @ gram @ alpha / 2
    assert dual - 1e-6 <= objective(np.append(w[:6], b)) <= dual * 1.01


def test_quality_query(spark, tables):
    """The registered query: every row, its fold, and held-out labels found."""
    out = {r.doc_id: r for r in quality.op2_naive_bayes_support_vectors(spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    assert out.keys() == {r.doc_id for r in docs}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in out.items())
    labels = [r for r in spark.read.parquet(f"{tables}/labels.parquet").collect() if r.doc_id in out and out[r.doc_id].held_out and r.quality is not None]
    assert sum(out[r.doc_id].predicted == r.quality for r in labels) >= 0.8 * len(labels)


def test_features_are_indicators():
    own, f = quality.features(pa.array(["a a a a", None, "", "a b"]))
    assert set(own.tolist()) == {0, 3}
    assert len(set(zip(own.tolist(), f.tolist(), strict=True))) == len(own)


# URLs ------------------------------------------------------------------------------------------------------------


def test_temporal_join(spark):
    day = lambda n: datetime.date(2024, 1, n)
    entries = spark.createDataFrame(
        [("block", "bad.org", "add", day(5)), ("block", "bad.org", "remove", day(10)), ("block", "BAD.org", "add", day(20)), ("allow", "ok.bad.org", "add", day(1)), ("block", "site.com/ads", "add", day(1)), ("block", None, "add", day(1)), ("block", "x.org", "hold", day(1)), ("block", "tie.org", "add", day(3)), ("block", "tie.org", "remove", day(3))],
        "list string, key string, action string, day date",
    )
    captures = [(1, "http://bad.org/", 4), (2, "https://u:p@WWW.bad.org:8080/x?y", 5), (3, "http://bad.org", 10), (4, "http://a.b.bad.org/q", 25), (5, "http://ok.bad.org/", 7), (6, "http://site.com/ads/1?z", 2), (7, "http://site.com/adsx", 2), (8, None, 2), (9, "no url", 2), (10, "http://tie.org/", 4), (11, "http://bad.org/", None)]
    df = spark.createDataFrame([(i, u, None if d is None else day(d), "clash") for i, u, d in captures], "page_id long, url string, fetched date, key string")
    out = {r.page_id: (r.verdict, r.matched, r.n_active) for r in urls.judge(df.drop("key"), entries).collect()}
    assert out[1] == ("none", None, 0) and out[2] == ("block", "bad.org", 1) and out[3][0] == "none" and out[4][0] == "block"
    assert out[5] == ("allow", "ok.bad.org", 2) and out[6][0] == "block" and out[7][0] == "none"
    assert all(out[i][0] == "none" for i in (8, 9, 10, 11)) and len(out) == 11
    assert urls.judge(df.limit(0), entries).count() == 0 and urls.judge(df, entries.limit(0)).count() == 11


@pytest.mark.parametrize("url,keys", [("http://a.b.c/x/y", ["a.b.c", "b.c", "c", "a.b.c/x", "a.b.c/x/y"]), ("http://h", ["h"]), ("", []), (None, [])])
def test_url_keys(spark, url, keys):
    assert spark.createDataFrame([(url,)], "u string").select(urls.url_keys(F.col("u")).alias("k")).first().k == keys
