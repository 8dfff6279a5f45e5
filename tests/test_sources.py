"""The Markdown sink and the scan over stretches, against brute force."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from folioscope import shared
from folioscope.operators import chunking, scan
from folioscope.plans import catalog
from folioscope.sources import markdown, sink


def plain(path):
    return path.removeprefix("file://")


def files_in(path):
    return sorted(x for x in glob.glob(f"{plain(path)}/**", recursive=True, include_hidden=True) if os.path.isfile(x))


def test_sink_writes_what_the_source_reads(spark):
    rows = [("a", "---\nx: 1\n---\n\n# A\r\ntext  "), ("b c", ""), ("ñ-1", None), ("d", "1"), ("d", "2"), ("d", "2"), ("e", "é\n" * 100_000)]
    path = shared.fresh(spark, "markdown")
    markdown.write(spark.createDataFrame(rows, "slug string, text string").repartition(4), path)
    got = {r.slug: (r.file_name, r.raw) for r in markdown.read(spark, path).collect()}
    assert {k: v[1] for k, v in got.items() if v[1]} == {"a": rows[0][1], "d": "2", "e": rows[6][1]}
    assert files_in(path) == sorted(f"{plain(path)}/{k}.md" for k in ("a", "b c", "ñ-1", "d", "e"))
    markdown.write(spark.createDataFrame([("d", "new"), ("z", "z")], "slug string, text string"), path)  # takes the place of all
    assert files_in(path) == [f"{plain(path)}/d.md", f"{plain(path)}/z.md"] and open(f"{plain(path)}/d.md").read() == "new"
    markdown.write(spark.createDataFrame([], "slug string, text string"), path)
    assert files_in(path) == []


def test_failed_job_leaves_nothing(spark):
    path = shared.fresh(spark, "markdown")
    markdown.write(spark.createDataFrame([("old", "1")], "slug string, text string"), path)
    rows = spark.range(40).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("slug"), F.when(F.col("id") == 37, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("text"))
    for broken in (rows, spark.createDataFrame([("a/b", "x"), ("c", "y")], "slug string, text string")):
        with pytest.raises(Exception):
            markdown.write(broken, path)
        assert files_in(path) == [f"{plain(path)}/old.md"]
    assert {r.slug for r in markdown.read(spark, path).collect()} == {"old"}


def test_sink_gets_few_texts_at_a_time(spark, monkeypatch):
    """A task holds a batch of a few MB, however large its part of the files is."""

    class Watched(sink.MarkdownWriter):
        def write(self, iterator):
            def small():
                for batch in iterator:
                    if batch.nbytes > 8 << 20:
                        raise ValueError(f"{batch.nbytes} bytes at once")
                    yield batch

            return super().write(small())

    class WatchedSink(sink.MarkdownSink):
        def writer(self, schema, overwrite):
            return Watched(self.options["path"], overwrite)

    monkeypatch.setattr(sink, "MarkdownSink", WatchedSink)
    path = shared.fresh(spark, "markdown")
    rows = spark.range(30).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("slug"), F.when(F.col("id") != 7, F.repeat(F.lit("é"), 1 << 19)).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        markdown.write(rows, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert {os.path.basename(f): os.path.getsize(f) for f in files_in(path)} == {f"f{i}.md": 0 if i == 7 else 1 << 20 for i in range(30)}


def test_round_trip_query(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    expected = {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        slug = f"{'none' if d.source is None else d.source}-{d.doc_id // 200}"
        expected[slug] = expected.get(slug, f'---\nsource: "{slug}"\n---\n\n') + f"## Artículo {d.doc_id}\n\n{d.text or ''}\n\n"
    out = {r.slug: r for r in catalog.QUERIES["markdown_round_trip"](spark, tables).collect()}
    assert out.keys() == expected.keys() and all(r.same and r.n_chars == len(expected[s]) and (r.file_name, r.from_source) == (f"{s}.md", s) for s, r in out.items())


def test_scan_over_stretches(spark):
    rnd = random.Random(3)
    rows = [(g, p, rnd.choice([None, 1, 2, 5]), rnd.choice([None, None, "x", "y"])) for g in ("a", "b", "", None) for p in rnd.sample(range(-60, 900), rnd.choice([1, 40, 300]))]
    df = spark.createDataFrame(rows, "g string, p long, n int, s string").repartition(5)
    for stretch in (1, 7, 10_000):
        out = scan.scan(df, "g", "p", {"total": F.col("n")}, {"last": F.col("s")}, stretch)
        expected = []
        for g in ("a", "b", "", None):
            total, last = 0, None
            for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
                total, last = total + (r[2] or 0), r[3] if r[3] is not None else last
                expected.append((*r, total, last))
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)


def test_one_file_is_many_tasks_work(spark, monkeypatch):
    """Sections and numbers of a file of many stretches are those of one window, and its rows lie in many tasks."""
    kinds = ["text", "", "## Artículo {}", "## Título {}", "### Cap {}"]
    rnd = random.Random(8)
    rows = [("one", i, rnd.choice(kinds[:2] * 4 + kinds).format(i)) for i in range(3000)]
    lines = spark.createDataFrame(rows, "slug string, pos long, line string").repartition(6)
    whole = [tuple(r) for r in chunking.articles(chunking.sections(lines)).orderBy("unit").collect()]
    original = scan.scan
    monkeypatch.setattr(chunking, "scan", lambda *a, **k: original(*a, **k, stretch=64))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = chunking.sections(lines)
        assert found.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert [tuple(r) for r in chunking.articles(found).orderBy("unit").collect()] == whole
        numbered = chunking.numbered(lines, "slug", "pos").select("rid", "pos").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all(r.rid == r.pos + 1 for r in numbered) and len(numbered) == 3000
    sec, unit, structure, kept, at = 0, 0, "", {}, None
    for _, pos, line in rows:
        if line.startswith("### "):
            sec, unit, structure, at = sec + 1, unit + 1, line[4:], None
        elif line.startswith("## "):
            unit, at = unit + 1, unit + 1
            kept[at] = [pos, sec, structure, line[3:], []]
        elif at is not None:
            kept[at][4].append(line)
    assert whole == [("one", u, p, s, st, h, "\n".join(b).strip()) for u, (p, s, st, h, b) in kept.items() if "\n".join(b).strip()]
