"""From Markdown files to chunks: one row for each article, or for each paragraph of files without articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.functions.text import BLANK_LINES, LINE_END, collapse, strip
from folioscope.operators.scan import scan
from folioscope.sources import markdown

COLUMNS = ["rid", "slug", "name", "doc_type", "heading", "article", "structure", "citation", "text", "section", "rama", "source", "vigente", "reformas"]
LEAST = 15


def lines(files: DataFrame, body: str = "body") -> DataFrame:
    """files (with slug) with pos and line instead of the body."""
    kept = [c for c in files.columns if c != body]
    return files.select(*kept, F.posexplode(F.split(F.col(body), LINE_END)).alias("pos", "line"))


def sections(rows: DataFrame) -> DataFrame:
    """lines with sec (dividers so far), unit (dividers and headings so far), structure (the last divider's text) and kind.

    A scan over stretches of lines: one file, however long, is the work of many tasks.
    """
    divider, heading = F.col("line").startswith("### "), F.col("line").startswith("## ")
    kinds = rows.withColumn("kind", F.when(divider, "divider").when(heading, "heading").otherwise("text"))
    sums = {"sec": divider.cast("int"), "unit": (divider | heading).cast("int")}
    found = scan(kinds, "slug", "pos", sums, {"structure": F.when(divider, strip(F.substr("line", F.lit(5))))})
    return found.withColumn("structure", F.coalesce("structure", F.lit("")))


def articles(rows: DataFrame) -> DataFrame:
    """(slug, unit, pos, sec, structure, heading, body) of the units that a heading opens and that have a body; what follows a divider belongs to none."""
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "line"))))
    units = rows.where("unit > 0").groupBy("slug", "unit").agg(
        F.min("pos").alias("pos"),
        F.min_by("kind", "pos").alias("kind"),
        F.min_by("line", "pos").alias("line"),
        F.min("sec").alias("sec"),
        F.min_by("structure", "pos").alias("structure"),
        strip(F.array_join(F.transform(parts, lambda p: p["line"]), "\n")).alias("body"),
    )
    return units.where("kind = 'heading' AND body <> ''").select("slug", "unit", "pos", "sec", "structure", strip(F.substr("line", F.lit(4))).alias("heading"), "body")


def article_of(heading: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(heading, rules.ARTICLE_HEADING, 1)), F.lit(""))


def split_notes(body: Column) -> tuple[Column, Column]:
    """(operative text, notes): paragraphs that begin like an editor's note are notes; each in one line, joined by spaces. Operative text is never left empty."""
    parts = F.filter(F.transform(F.split(body, BLANK_LINES), collapse), lambda p: p != "")
    notes = F.filter(parts, rules.is_note)
    kept = strip(F.array_join(F.filter(parts, lambda p: ~rules.is_note(p)), " "))
    return F.when(kept == "", body).otherwise(kept), F.array_join(notes, " ")


def paragraphs(body: Column) -> Column:
    """Paragraphs of 15 characters or more, without leading # and spaces."""
    clean = F.transform(F.split(body, BLANK_LINES), lambda p: strip(F.regexp_replace(strip(p), "^[# ]+", "")))
    return F.filter(clean, lambda p: F.length(p) >= LEAST)


def chunk(files: DataFrame) -> DataFrame:
    """Chunks of (slug, file_name, raw) in the order of file names and places.

    Numbering all rows in one order is a build step: a scan over stretches of places numbers the rows of each file, and a
    sum over the files' counts (a row for each file) tells where each file begins.
    """
    known = rules.classify(files.withColumn("body", markdown.body(F.col("raw"))).withColumn("source", F.coalesce(markdown.frontmatter(F.col("raw"))["source"], F.col("slug"))))
    base = known.withColumnRenamed("label", "name").select("slug", "file_name", "name", "doc_type", "rama", "source", "body")
    about = base.drop("body")
    found = articles(sections(lines(base.select("slug", "body"))))
    law = F.col("doc_type") == "ley"
    operative, notes = split_notes(F.col("body"))
    rows = found.join(about, "slug").withColumn("article", article_of(F.col("heading")))
    rows = rows.withColumn("vigente", F.when(~law | rules.in_force(F.col("body")), 1).otherwise(0))
    plain = law & (F.col("vigente") == 1)
    made = rows.select(
        "file_name", "pos", "slug", "name", "doc_type", "heading", "article", "structure",
        F.when(F.col("article").isNotNull(), F.concat("name", F.lit(", art. "), "article")).otherwise(F.concat("name", F.lit(" — "), "heading")).alias("citation"),
        F.when(plain, operative).otherwise(F.col("body")).alias("text"),
        F.concat("slug", F.lit("#"), F.col("sec").cast("string")).alias("section"), "rama", "source", "vigente",
        F.when(plain, notes).otherwise("").alias("reformas"),
    )
    bare = base.join(found.select("slug").distinct(), "slug", "left_anti")
    para = bare.select("*", F.posexplode(paragraphs(F.col("body"))).alias("pos", "text")).select(
        "file_name", "pos", "slug", "name", "doc_type", F.col("name").alias("heading"), F.lit(None).cast("string").alias("article"), F.lit("").alias("structure"),
        F.col("name").alias("citation"), "text", F.concat("slug", F.lit("#0")).alias("section"), "rama", "source", F.lit(1).alias("vigente"), F.lit("").alias("reformas"),
    )
    return numbered(made.unionByName(para), "file_name", "pos").select(*COLUMNS)


def numbered(rows: DataFrame, file: str, place: str) -> DataFrame:
    """rows with rid from 1 on, by (file, place): each row's number in its file by a scan over stretches of places, and each file's start by a sum over the files before (a row for each file)."""
    counts = rows.groupBy(file).agg(F.count("*").alias("_n"))
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(file, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    found = scan(rows, file, place, {"_k": F.lit(1)})
    return found.join(starts, file).withColumn("rid", (F.col("_start") + F.col("_k")).cast("long")).drop("_k", "_start")
