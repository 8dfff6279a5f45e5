"""Neighbours as class rows and word differences by fingerprints, against pairs and counts."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from folioscope.operators import audit, graph


def test_neighbors_equal_pairs(spark):
    rnd = random.Random(5)
    rows = [(i + 1, f"s{rnd.randint(0, 2)}", rnd.choice([str(rnd.randint(1, 30)), f"{rnd.randint(1, 9)} bis", "único", None])) for i in range(300)]
    rows = [(rid, slug, article, f"{slug}#{rnd.randint(0, 8)}") for rid, slug, article in rows] + [(1001, "alone", "1", "alone#0"), (1002, "twice", "1", "twice#0"), (1003, "twice", "1", "twice#0")]
    df = spark.createDataFrame(rows, "rid long, slug string, article string, section string").repartition(3)
    refs = spark.createDataFrame([], "slug string, src string, dst string")
    pairs = graph.related(df, refs, df).where("relation = 'neighbors'").collect()
    key = lambda a: (int(re.match(r"\d+", a)[0]) if re.match(r"\d+", a) else 9999, a)
    expected = {}
    for r in pairs:
        expected.setdefault((r.slug, r.article), []).append(r.other)
    found = {(r.slug, r.article): (r.n, r["first"]) for r in graph.neighbors(df, df).collect()}
    assert found == {k: (len(v), min(v, key=key)) for k, v in expected.items()} and found


def test_one_section_makes_no_pairs(spark):
    """20,000 articles of one section: a row each, by a plan whose joins are on a row for each section."""
    rows = spark.range(1, 20_001).select(F.col("id").alias("rid"), F.lit("s").alias("slug"), F.col("id").cast("string").alias("article"), F.lit("s#0").alias("section"))
    out = graph.neighbors(rows, rows)
    r = out.agg(F.count("*").alias("rows"), F.min("n").alias("a"), F.max("n").alias("b"), F.count(F.when(F.col("first") != "1", 1)).alias("other")).first()
    assert tuple(r) == (20_000, 19_999, 19_999, 1)


def test_word_differences_equal_counts(spark):
    rnd = random.Random(9)
    words = ["uno", "Dos", "tres,", "artículo", "Artículo", "straße", "x_y", "(fin)", "ﬁn"]
    rows = []
    for i in range(200):
        a = rnd.choices(words, k=rnd.randint(0, 30))
        b = list(a)
        if i % 3 == 0:
            rnd.shuffle(b)
        if i % 4 == 0 and b:
            b[rnd.randrange(len(b))] = rnd.choice(words)
        rows.append((i, " ".join(a), " ".join(b)))
    rows += [(900, None, "uno"), (901, "uno", None), (902, None, None), (903, "a a b", "a b b"), (904, "w " * 50_000, "w " * 50_001)]
    df = spark.createDataFrame(rows, "doc long, source string, made string").repartition(4)

    def listed(x):
        return Counter("articulo" if w == "artículo" else w for w in re.findall(r"\w+", (x or "").replace("ﬁ", "fi").lower().replace("ß", "ss")))

    expected = set()
    for doc, a, b in rows:
        x, y = listed(a), listed(b)
        expected |= {(doc, w, max(x[w] - y[w], 0), max(y[w] - x[w], 0)) for w in x.keys() | y.keys() if x[w] != y[w]}
    assert {tuple(r) for r in audit.word_differences(df).collect()} == expected
    assert {r.doc for r in audit.differing(df).where("a IS NOT NULL AND b IS NOT NULL").collect()} == {d for d, a, b in rows if a is not None and b is not None and listed(a) != listed(b)}
