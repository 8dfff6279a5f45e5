"""Steps whose work must grow no faster than their input: each is done once, where its rows are."""

import re
from collections import Counter
from functools import partial

from folioscope.operators import audit, beside, lexical, postings, sparse
from folioscope.plans import catalog

TEXTS = ["Él subió él", "zorro zorros ZORRO", "", None, "a1b2c 12345 ﬁnca", "la parte puede pedir la parte", "ß café caféteria"]


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_feature_totals(spark, tables, monkeypatch):
    monkeypatch.setattr(sparse, "STEP_BYTES", 8)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "rid long, text string")
    df, tf = Counter(), Counter()
    for text in ["el subio el", "zorro zorros zorro", "a1b2c 12345 finca", "la parte puede pedir la parte", "ß cafe cafeteria"]:
        own = Counter()
        for w in re.findall("[a-z0-9]+", text):
            own["w:" + w] += 1
            own.update("c:" + f"#{w}#"[i : i + 4] for i in range(len(w) - 1 if len(w) >= 5 else 0))
        tf += own
        df.update(own.keys())
    found = sparse.feature_totals(rows, sparse.document_text(rows)).collect()
    assert {r.feature: (r.tf, r.df) for r in found} == {f: (n, df[f]) for f, n in tf.items()} and len(found) == len(tf)
    dealt = sparse.feature_totals(rows, sparse.document_text(rows))
    assert "Repartition" not in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in catalog.QUERIES["sparse_features"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()


def test_audits_look_at_texts_once(spark):
    rows = [(1, "a, b. c", "a, b. c"), (2, None, None), (3, None, "x;"), (4, "uno (dos) 1,5", "dos uno 1.5"), (5, "w;w", "w:w"), (6, "ﬁn ª ¿qué?", "fin  ¿qué?"), (7, "", "()"), (8, "a a b", "a b b"), (None, "z", "y"), (9, "s t", "s"), (9, "s", "s t")]
    pairs = spark.createDataFrame(rows, "doc long, source string, made string")
    found = sorted((str(r.doc), r.words_ok, r.commas_ok, r.signs_ok) for r in audit.verdict(pairs).collect())
    assert found == sorted([("1", True, True, True), ("2", True, None, True), ("3", False, None, False), ("4", True, False, False), ("5", True, True, False), ("6", True, True, True), ("7", True, True, False), ("8", False, True, True), ("None", False, True, True), ("9", False, True, True), ("9", False, True, True)])
    assert {tuple(r) for r in audit.word_differences(pairs).collect()} == {(3, "x", 0, 1), (8, "a", 1, 0), (8, "b", 0, 1), (None, "z", 1, 0), (None, "y", 0, 1)}
    signs = {(r.doc, r.sign): (r.in_source, r.in_made) for r in audit.sign_census(pairs).collect()}
    assert signs == {(1, ","): (1, 1), (3, ";"): (0, 1), (4, "("): (1, 0), (4, ")"): (1, 0), (4, ","): (1, 0), (5, ";"): (1, 0), (5, ":"): (0, 1), (6, "¿"): (1, 1), (6, "?"): (1, 1), (7, "("): (0, 1), (7, ")"): (0, 1)}
    assert "Exchange" not in plan(audit.verdict(pairs))  # no pair is shuffled
    assert plan(audit.verdict(pairs)).count("ficha") <= 2  # each side is cleaned once


def test_texts_are_read_once_for_phrases(spark, monkeypatch):
    texts = ["of the of the", None, "", "The end of", "of", "a of the b", "the the the", "x", "Él of THE el"]
    rows = spark.createDataFrame([(i + 1, "of" if i == 4 else "", t) for i, t in enumerate(texts)], "rid long, heading string, text string")
    asked = spark.createDataFrame([(0, "of_the"), (1, "the of the"), (2, "el_of_the x the_the"), (3, "of_of zzzz"), (4, "")], "qid long, query string")
    lexicon = lexical.index(rows)
    expected = {(r.qid, r.rid): r.score for r in lexical.scores(lexicon, asked).collect()}  # by joins of all places
    got = lambda **a: {(r.qid, r.rid): r.score for r in lexical.bm25(lexical.index(rows), asked, 20, **a).collect()}
    found = got()
    assert found.keys() == expected.keys() and len(found) == 12 and all(abs(found[x] - y) < 1e-12 for x, y in expected.items())
    assert got(allowed=rows.where("rid > 4")).keys() == {x for x in expected if x[1] > 4}
    narrow = lexical.narrowed(lexicon, lexical.asked_for(asked))
    assert tuple(narrow.totals.first()) == tuple(lexicon.totals.first())
    assert "Exchange" not in plan(narrow.counts)  # a table: texts are not read again
    monkeypatch.setattr(lexical, "STEP_WORDS", 3)
    monkeypatch.setattr(lexical, "beside", partial(beside.beside, most_bytes=40))  # the phrases dealt into blocks
    dealt = got()
    assert dealt.keys() == expected.keys() and all(abs(dealt[x] - y) < 1e-12 for x, y in expected.items())


def test_a_task_s_blocks_are_bounded(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("id AS rid", "concat('uno dos ', id) AS text")
    made = lambda: postings.blocks_of(rows, ["text"])
    whole = {tuple(map(str, r)) for r in made().collect()}
    monkeypatch.setattr(postings, "PART_BYTES", 4096)
    assert made().rdd.getNumPartitions() == -(-sum(len(f"uno dos {i}") for i in range(4000)) // 4096) > 4
    assert {tuple(map(str, r)) for r in made().collect()} == whole


def test_vectors_are_made_where_they_are_multiplied(spark, monkeypatch):
    """A core runs one Python worker for its rows, not one for the weights and one for the products."""
    rows = spark.createDataFrame([(i + 1, t) for i, t in enumerate(TEXTS)], "rid long, text string")
    asked = spark.createDataFrame([(0, "zorro"), (1, "la parte")], "qid long, query string")
    monkeypatch.setattr(sparse, "best_beside", beside.beside)
    made = sparse.index(rows)
    found = sparse.cosine(made, asked, 3)
    assert plan(found).count("MapInArrow") == 1
    as_made = sparse.cosine(sparse.Sparse(made.idf, made.vectors), asked, 3)  # from vectors, as before
    assert found.count() == 2 and sorted(map(tuple, found.collect())) == sorted(map(tuple, as_made.collect()))
