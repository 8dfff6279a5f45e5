"""Markdown files with frontmatter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import shared
from folioscope.functions.text import LINE_END, strip
from folioscope.sources import sink


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(slug, file_name, raw) of the Markdown files in a folder that Spark can read, or of some files; file_name orders them."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    name = F.col("_metadata.file_name")
    return files.select(F.regexp_replace(name, r"\.md$", "").alias("slug"), name.alias("file_name"), F.col("value").alias("raw"))


def _end(raw: Column) -> Column:
    return F.when(raw.startswith("---"), F.locate("\n---", raw, 4)).otherwise(0)


def frontmatter(raw: Column) -> Column:
    """The keys and values between the leading --- and the next line that begins with it, quotes off; of a repeated key the last. Empty where there is none."""
    end = _end(raw)
    lines = F.filter(F.split(F.substring(raw, F.lit(4), end - 4), LINE_END), lambda x: x.contains(":"))
    key = lambda x: strip(F.regexp_extract(x, r"(?s)^([^:]*):", 1))
    value = lambda x: F.regexp_replace(strip(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)), '^"+|"+$', "")
    pairs = F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    # the last pair of each key, whatever spark.sql.mapKeyDedupPolicy says
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    empty = F.create_map().cast("map<string,string>")
    return F.when(end > 0, F.map_from_entries(last)).otherwise(empty)


def body(raw: Column) -> Column:
    """What follows the frontmatter; everything where there is none."""
    end = _end(raw)
    return F.when(end > 0, F.substring(raw, end + 4, F.length(raw))).otherwise(raw)


def strict_body(raw: Column) -> Column:
    """The body as audits read it: the frontmatter's last line stands alone."""
    return F.regexp_replace(raw, r"^---\n(?s:.*?)\n---\n", "")


def write(files: DataFrame, path: str) -> None:
    """Write (slug, text) as one file <slug>.md for each slug, in place of the Markdown files that the folder has; read() finds them again.

    text already holds frontmatter and body. Rows of one slug are one document: of several texts the greatest counts. A null
    text is empty; a slug must be a file name. Nothing is to be seen before the commit: tasks write into folders of their own
    attempts, and a lost task's or a failed job's folder is left out and removed. Tasks get few texts at a time.
    """
    spark = files.sparkSession
    spark.dataSource.register(sink.MarkdownSink)
    rows = files.groupBy(F.col("slug").cast("string").alias("slug")).agg(F.coalesce(F.max(F.col("text").cast("string")), F.lit("")).alias("text"))
    with shared.writing(spark):
        rows.write.format(sink.MarkdownSink.name()).mode("overwrite").option("path", path).save()
