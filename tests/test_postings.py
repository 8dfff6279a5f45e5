"""Blocks of postings: searches by bounds and phrases by rarest terms equal those over all places, and read less."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope import shared
from folioscope.operators import lexical, postings


@pytest.fixture(scope="module")
def both(spark):
    """An index worked out of all places, and the same in stored blocks of few rows."""
    rnd = random.Random(4)
    common = ["de", "la", "el", "que", "en"]
    rows = []
    for i in range(1500):
        ws = [rnd.choice(common) for _ in range(rnd.choice([0, 3, 8, 40]))] + [f"w{int(rnd.paretovariate(0.6))}" for _ in range(rnd.randint(0, 6))]
        rnd.shuffle(ws)
        rows.append((i * 3 + 1, rnd.choice(["", "de la ley", "art"]), rnd.choice(["a", "b"]), " ".join(ws) if i % 50 else None))
    chunks = spark.createDataFrame(rows, "rid long, heading string, slug string, text string").repartition(4)
    whole = lexical.index(chunks)
    made = postings.store(postings.blocks(whole.places, list(lexical.FIELDS)), shared.fresh(spark, "blocks"))
    blocked = lexical.Lexicon(whole.terms, whole.lengths, whole.frequencies, whole.totals, whole.places, stored=True, blocks=made)
    return chunks, whole, blocked


ASKED = ["de", "la w3", "w17 de la el que en", "w1 w2 w3", "de de de w5", "zzzz", "", "w40 w41 w42 la", "de_la", "la_de w2", "de_la_ley w3 w3", "que_zzzz", "el_el_el"]


def rows(df):
    return sorted((r.qid, r.rank, r.rid, round(r.score, 7)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 4000])
def test_equal_to_all_places(spark, both, k):
    chunks, whole, blocked = both
    asked = spark.createDataFrame(list(enumerate(ASKED)), "qid long, query string")
    assert rows(lexical.bm25(blocked, asked, k)) == rows(lexical.bm25(whole, asked, k))
    allowed = chunks.where("slug = 'a'")
    assert rows(lexical.bm25(blocked, asked, k, allowed)) == rows(lexical.bm25(whole, asked, k, allowed))


def test_blocks_of_texts(spark, both):
    """Made where the texts are, they equal blocks of all places; each span also lists all its rows, wordless and null ones too."""
    chunks, whole, blocked = both
    made = postings.blocks_of(chunks, list(lexical.FIELDS))
    assert made.dtypes == blocked.blocks.dtypes
    named = lambda df: sorted(map(tuple, df.collect()))
    assert named(made.where(F.col("term") != postings.EVERY)) == named(blocked.blocks)
    every = made.where(F.col("term") == postings.EVERY)
    listed = every.select(F.explode(F.arrays_zip("rids", "dls")).alias("r")).select("r.rids", "r.dls")
    assert named(listed) == named(whole.lengths)
    assert every.count() == every.select("span").distinct().count()


def test_blocks_of_no_text(spark):
    schema = "rid long, text string"
    assert postings.blocks_of(spark.createDataFrame([], schema), list(lexical.FIELDS)).count() == 0
    r = postings.blocks_of(spark.createDataFrame([(5, None), (7, " .,; ")], schema), list(lexical.FIELDS)).collect()
    assert [tuple(x) for x in r] == [(postings.EVERY, 0, 2, 0, 0, [5, 7], [0, 0], [0, 0], [[], []])]


def test_rows_that_are_gone(spark, both):
    """Blocks that still hold removed rows, with the statistics of what is left, search as an index of what is left."""
    chunks, whole, blocked = both
    left = lexical.index(chunks.where("rid % 5 <> 1"))
    gone = chunks.where("rid % 5 = 1").select("rid")
    kept = lexical.Lexicon(left.terms, left.lengths, left.frequencies, left.totals, left.places, stored=True, blocks=blocked.blocks, gone=gone)
    asked = spark.createDataFrame(list(enumerate(ASKED)), "qid long, query string")
    assert rows(lexical.bm25(kept, asked, 10)) == rows(lexical.bm25(left, asked, 10))


def test_reads_fewer_rows(spark, both):
    """Spans without a query's rare terms aren't read for its common ones."""
    _, _, blocked = both
    asked = spark.createDataFrame([(0, "w60 de la el que en"), (1, "w25 la")], "qid long, query string")
    _, spans = lexical.bounded(blocked, asked, 3)
    terms = lexical.phrases(asked).select("qid", F.col("terms")[0].alias("term"))
    size = lambda df: df.agg(F.sum("n").alias("n")).first().n
    every = blocked.blocks.select("term", "span", "n").join(terms, "term")
    assert size(every.join(spans, ["qid", "span"], "left_semi")) < 0.5 * size(every)


def test_phrases_read_other_terms_where_the_rarest_stands(spark, both):
    _, whole, blocked = both
    parts = spark.createDataFrame([(0, 0, 2, 0, "de"), (0, 0, 2, 1, "w12")], "qid long, phrase int, n int, i int, term string")
    found = {(r.rid, r["at"] % postings.FIELD) for r in postings.runs(blocked.blocks, blocked.frequencies, parts).collect()}
    places = {(r.rid, r.field, r.pos): r.term for r in whole.places.collect()}
    assert found == {(rid, pos) for (rid, field, pos), t in places.items() if t == "de" and places.get((rid, field, pos + 1)) == "w12"}
