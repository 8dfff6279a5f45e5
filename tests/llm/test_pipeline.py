"""The pipeline's stages and its whole run against brute force."""

from collections import Counter

import pytest
from test_jaccard import brute as components
from test_recompress import brute as without_repeats

import corpus_pipeline as p
from folioscope.llm import mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NO_ID = (None, "a text without an id", "en", "s1", 20)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def near(rows, word):
    found = components(rows, word)
    return [r for r in rows if found[r[0]][1] == r[0]]


def cut_repeats(rows, word):
    out = []
    for r in rows:
        n, gone, kept = without_repeats(rows, word)[r[0]] if r[1] else (0, 0, "")
        if not gone:
            out.append(r)
        elif gone < n:
            out.append((r[0], kept, *r[2:4], len(kept)))
    return out


def mixed(spark, rows):
    copies = {r.row.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [r for r in rows for _ in range(copies[r[0]])]


@pytest.fixture(scope="module")
def five(rows):
    return [r[:5] for r in rows]


def test_classify(spark, five, tmp_path):
    labels = [(r[0], int(i % 3 > 0), 0) for i, r in enumerate(five)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(five, SCHEMA)
    scored = quality.score(docs, quality.train(docs.select("doc_id", "text"), spark.read.parquet(str(tmp_path / "labels.parquet")))).collect()
    expected = {r.row.doc_id for r in scored if r.score >= quality.THRESHOLD}
    assert bag(p.classify(spark, docs, str(tmp_path))) == Counter(r for r in five if r[0] in expected)


def test_drop_near_copies(spark, five, word):
    expected = near(five, word)
    assert len(expected) < len(five)
    assert bag(p.drop_near_copies(spark, spark.createDataFrame([*five, NO_ID], SCHEMA), "")) == Counter([*expected, NO_ID])


def test_drop_repeats(spark, five, word):
    expected = cut_repeats(five, word)
    assert len(expected) < len(five) and set(expected) - set(five)
    assert bag(p.drop_repeats(spark, spark.createDataFrame([*five, NO_ID], SCHEMA), "")) == Counter([*expected, NO_ID])


def test_mix_sources(spark, five):
    expected = mixed(spark, [*five, NO_ID])
    assert bag(p.mix_sources(spark, spark.createDataFrame([*five, NO_ID], SCHEMA), "")) == Counter(expected)


def test_run(spark, five, word, tmp_path):
    """Without labels all documents pass the first stage."""
    spark.createDataFrame(five, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    expected = mixed(spark, cut_repeats(near(five, word), word))
    pieces = lambda df: Counter((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in df.collect())
    assert pieces(p.run(spark, str(tmp_path))) == pieces(p.pack(spark, spark.createDataFrame(expected, SCHEMA), "")) and expected


CLASHING = ["score", "row", "_score", "kept", "n_words", "n_removed", "copies", "copy", "_digest", "_source", "_size", "component_id", "places", "a b"]


def test_stages_with_clashing_columns_ties_and_no_rows(spark, five, tmp_path):
    """Columns named like the stages' own pass through; equal rows go one way; an empty table gives an empty one."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    some = [*five[:25], five[0], (None, None, None, None, None), (9000, "", "en", None, 0)]
    schema = f"{SCHEMA}, {', '.join(f'`{c}` string' for c in CLASHING)}"
    docs = spark.createDataFrame([(*r, *(f"{c} {r[0]}" for c in CLASHING)) for r in some], schema)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[c] == f"{c} {r.doc_id}" for r in found for c in CLASHING)
        assert sum(r.doc_id == five[0][0] for r in found) != 1
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert {r.doc_id for r in p.pack(spark, docs, str(tmp_path)).collect()} == {r[0] for r in some}
    assert p.pack(spark, docs.limit(0), str(tmp_path)).count() == 0
