"""Sparse and dense search against brute force: features by name, bounds, blocks of queries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import beside, dense, products, sparse


def texts():
    rnd = random.Random(6)
    words = ["prescripción", "El", "de", "código", "straße", "a1b2c3", "xyz", "ñandú", "plazo", "plazos", "12345", "zz", "é"] + [f"w{i}palabra" for i in range(60)]
    made = [" ".join(rnd.choice(words) + rnd.choice(["", ",", "-x", "_", "\n"]) for _ in range(rnd.choice([0, 1, 3, 20, 80]))) for _ in range(150)]
    return made + ["", None, "de", "de de", made[5], made[5], "plazos " * 4000, "!!", "한국어 中"]


def counted(text):
    """dim: sum of 1 + ln tf, by features' names."""
    import unicodedata
    import re

    folded = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    tf = Counter()
    for w in re.findall("[a-z0-9]+", folded):
        tf["w:" + w] += 1
        if len(w) >= 5:
            tf.update("c:" + f"#{w}#"[i : i + 4] for i in range(len(w) - 1))
    out = defaultdict(float)
    for f, n in tf.items():
        out[zlib.crc32(f.encode()) % sparse.DIMENSIONS] += 1 + math.log(n)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts())], "rid long, text string").repartition(4)


def brute(made, queries, k):
    """The cosine's definition, document by document."""
    raw = {i + 1: counted(t) for i, t in enumerate(made)}
    df = Counter(d for x in raw.values() for d in x)
    idf = {d: math.log(len(raw) / n) for d, n in df.items() if n < len(raw)}

    def unit(x, idf):
        x = {d: v * idf[d] for d, v in x.items() if idf.get(d, 0) > 0}
        n = math.sqrt(sum(v * v for v in x.values())) or 1
        return {d: v / n for d, v in x.items()}

    vectors = {i: {d: round(v, 5) for d, v in unit(x, idf).items()} for i, x in raw.items()}
    out = set()
    for q, text in queries:
        asked = unit(counted(text), {d: round(v, 5) for d, v in idf.items()})
        scores = [(-round(sum(v * x[d] for d, v in asked.items() if d in x), 9), i) for i, x in vectors.items() if any(d in x for d in asked)]
        out |= {(q, r + 1, i, round(-s, 6)) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def test_features_equal_those_by_name(spark, rows):
    found = {r.rid: dict(zip(r.dims, r.ws, strict=True)) for r in sparse.featured(rows, "rid", F.col("text")).collect()}
    assert all(found[i + 1].keys() == (c := counted(t)).keys() and all(abs(found[i + 1][d] - v) < 1e-9 for d, v in c.items()) for i, t in enumerate(texts()))
    by_name = sparse.counted(rows, "rid", F.col("text")).groupBy("rid", "dim").agg(F.sum(1 + F.log("tf")).alias("w")).collect()
    assert {(r.rid, r.dim, round(r.w, 9)) for r in by_name} == {(i, d, round(w, 9)) for i, x in found.items() for d, w in x.items()}


@pytest.mark.parametrize(("common", "most"), [(2048, 32 << 20), (3, 32 << 20), (0, 3000)])
def test_cosine_equals_brute_force(spark, rows, monkeypatch, common, most):
    """With all dimensions as matrices, few, or none; queries broadcast, or dealt in blocks."""
    monkeypatch.setattr(products, "COMMON", common)
    monkeypatch.setattr(products, "STEP_ENTRIES", 500)
    original = beside.beside
    monkeypatch.setattr(sparse, "best_beside", lambda *a: original(*a, most_bytes=most))
    made = texts()
    queries = [(100 + i, t) for i, t in enumerate(made[:40] + ["plazo de prescripcion", "", "zz w3palabra", None, "unknownword"])]
    asked = spark.createDataFrame(queries, "qid long, query string").repartition(3)
    out = sparse.cosine(sparse.index(rows), asked, 7).collect()
    assert {(r.qid, r.rank, r.rid, round(r.score, 6)) for r in out} == brute(made, queries, 7)


def test_stored_postings_give_the_same(spark, rows):
    asked = spark.createDataFrame([(0, "plazo de prescripcion"), (1, "zz w3palabra")], "qid long, query string")
    made = sparse.index(rows)
    key = lambda df: {(r.qid, r.rank, r.rid, round(r.score, 7)) for r in df.collect()}
    assert key(sparse.cosine(made, asked, 9)) == key(sparse.cosine(sparse.Sparse(made.idf, made.vectors, made.postings), asked, 9))


@pytest.mark.parametrize("most", [32 << 20, 5000])
def test_nearest_equals_brute_force(spark, monkeypatch, most):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 5
    made = np.vstack([centres[i % 12] + rng.normal(size=16) * 0.05 for i in range(900)])
    made[7] = made[8]
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(2000, None), (2001, []), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0] * 3), (2005, [0.0] * 16)]
    schema = "{} long, embedding array<double>"
    vectors = spark.createDataFrame(rows, schema.format("rid")).repartition(3)
    queries = spark.createDataFrame([r for r in rows if r[0] % 25 == 0 or r[0] >= 2000], schema.format("qid"))
    original = beside.beside
    monkeypatch.setattr(dense, "beside", lambda *a: original(*a, most_bytes=most))
    out = {(r.qid, r.rank, r.rid, round(r.score, 4)) for r in dense.nearest(vectors, queries, 9).collect()}
    expected = set()
    whole = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    for q, a in ((i, v) for i, v in whole if i % 25 == 0 or i >= 2000):
        scores = sorted((-round(float(np.dot(a, v)), 9), i) for i, v in whole if len(v) == len(a))
        expected |= {(q, r + 1, i, round(-s, 4)) for r, (s, i) in enumerate(scores[:9])}
    assert out == expected
    with pytest.raises(ValueError):
        dense.nearest(vectors, queries, 3, most_queries=5)


def test_groups_are_ruled_out():
    """Of clustered vectors most groups are never multiplied."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    made = np.vstack([centres[i % 40] + rng.normal(size=24) * 0.002 for i in range(4000)])
    best = dense.Best(np.arange(40), centres, 10)
    for at in range(0, 4000, 1000):
        best.add(np.arange(at, at + 1000), made[at : at + 1000])
    exact = np.argsort(-(centres @ made.T), axis=1)[:, :10]
    assert all(set(best.held[i][0].tolist()) == set(exact[i].tolist()) for i in range(40))
    assert best.multiplied < 0.4 * best.met  # 28 % here: the first step has no scores to rule out by
