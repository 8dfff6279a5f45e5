"""Page texts of scanned or printed documents, and their conversion to Markdown.

pages: (doc, page_no, text), as an extractor left them. Extraction itself is pluggable: `extract` applies a function
from bytes to page texts to binary files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.functions.text import BLANK_LINES, LINE_END, article_label, collapse, deligature, slug, strip, token_count


def extract(spark: SparkSession, path: str, reader: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """(doc, page_no, text) of binary files by a reader that returns each page's text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("_metadata.file_name").alias("doc"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["doc"], batch["content"], strict=True):
                texts = reader(bytes(content))
                yield pd.DataFrame({"doc": doc, "page_no": range(len(texts)), "text": texts})

    return files.mapInPandas(run, "doc string, page_no long, text string")


def joined(pages: DataFrame) -> DataFrame:
    """(doc, raw, n_pages): the pages' texts in order, without ligatures, one line end between them."""
    parts = F.array_sort(F.collect_list(F.struct("page_no", deligature(F.coalesce("text", F.lit(""))).alias("text"))))
    return pages.groupBy("doc").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("raw"), F.count("*").alias("n_pages"))


def without_footers(raw: Column) -> Column:
    """Print footers, URLs and record marks as a space each."""
    for pattern in (rules.PRINT_FOOTER, rules.URL, rules.RECORD_MARK):
        raw = F.regexp_replace(raw, pattern, " ")
    return raw


def is_noise(block: Column) -> Column:
    return (block == "") | block.rlike(rules.PAGE_NUMBER)


def blocks(raw: Column) -> Column:
    """Paragraphs, each in one line, without page numbers."""
    return F.filter(F.transform(F.split(raw, BLANK_LINES), collapse), lambda b: ~is_noise(b))


def article_blocks(raw: Column) -> Column:
    """The paragraphs of a code, (kind, text): articles that were glued together stand apart."""
    x = F.regexp_replace(without_footers(raw), rules.CARD_MARK, "\n\n")
    x = F.regexp_replace(x, f"(?iuU)(?:Ficha\\s+articulo\\s+)?({rules.ARTICLE_HEAD})", "\n\n$1")
    head = f"(?iuU)^{rules.ARTICLE_HEAD}"

    def kind(b: Column) -> Column:
        return F.when(b.rlike(head), "article").when(b.rlike(rules.STRUCTURE) & (F.length(b) < 90), "structure").otherwise("text")

    def line(b: Column) -> Column:
        title = F.concat(F.lit("\n## Artículo "), article_label(F.regexp_extract(b, head, 1), F.regexp_extract(b, head, 2)), F.lit("\n"))
        rest = strip(F.regexp_replace(b, head, ""))
        return F.when(b.rlike(head), F.when(rest == "", title).otherwise(F.concat(title, F.lit("\n\n"), rest))).when(b.rlike(rules.STRUCTURE) & (F.length(b) < 90), F.concat(F.lit("\n### "), b, F.lit("\n"))).otherwise(b)

    return F.transform(blocks(x), lambda b: F.struct(kind(b).alias("kind"), line(b).alias("text")))


def outline(raw: Column) -> Column:
    """A study guide: every line that isn't blank or a page number, the first that names it as title."""
    lines = F.filter(F.transform(F.split(deligature(raw), LINE_END), strip), lambda s: (s != "") & ~s.rlike(r"(?U)^\d{1,4}\s+de\s+\d{1,4}$"))
    first = F.array_position(F.transform(lines, lambda s: F.lower(s).contains("temario")), True).cast("int")
    titled = F.concat(F.slice(lines, 1, first - 1), F.array(F.concat(F.lit("# "), F.get(lines, first - 1))), F.slice(lines, first + 1, F.size(lines)))
    return F.array_join(F.when(first > 0, titled).otherwise(lines), "\n\n")


def convert(pages: DataFrame, converted: Column) -> DataFrame:
    """(doc, slug, kind, n_pages, n_articles, body, text): documents as Markdown, text with frontmatter; converted is the day to state."""
    rows = joined(pages).withColumn("kind", rules.doc_kind(F.col("doc")))
    found = article_blocks(F.col("raw"))
    code = strip(F.array_join(F.transform(found, lambda b: b["text"]), "\n\n"))
    plain = strip(F.array_join(blocks(without_footers(F.col("raw"))), "\n\n"))
    rows = rows.withColumn("body", F.when(F.col("kind") == "codigo", code).when(F.col("kind") == "temario", outline(F.col("raw"))).otherwise(plain))
    n = F.when(F.col("kind") == "codigo", F.size(F.filter(found, lambda b: b["kind"] == "article"))).otherwise(0)
    rows = rows.withColumn("n_articles", n.cast("long")).withColumn("slug", slug(F.regexp_replace("doc", r"\.[^.]*$", "")))
    head = F.format_string('---\ntype: reference\ndoc_kind: %s\nsource: "%s"\njurisdiction: Costa Rica\nconverted: %s\npages: %d\narticles: %d\n---\n\n', "kind", "doc", converted, "n_pages", "n_articles")
    return rows.select("doc", "slug", "kind", "n_pages", "n_articles", "body", F.concat(head, F.col("body"), F.lit("\n")).alias("text"))


def report(converted: DataFrame) -> DataFrame:
    """(doc, n_pages, n_articles, chars, tokens) of each document; the row with a null doc sums the characters and tokens. converted has body, or its length as chars."""
    chars = F.col("chars") if "chars" in converted.columns else F.length("body").cast("long")
    rows = converted.select("doc", "n_pages", "n_articles", chars.alias("chars")).withColumn("tokens", token_count(F.col("chars")))
    each = lambda c: F.when(F.grouping("doc") == 0, F.sum(c)).alias(c)
    return rows.rollup("doc").agg(each("n_pages"), each("n_articles"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))


def density(pages: DataFrame, sample: int = 5, least: int = 200) -> DataFrame:
    """(doc, n_pages, per_page, kind): mean characters of the first pages; digital above 200."""
    order = Window.partitionBy("doc").orderBy("page_no")
    first = pages.withColumn("_k", F.row_number().over(order))
    rows = first.groupBy("doc").agg(F.count("*").alias("n_pages"), F.sum(F.when(F.col("_k") <= sample, F.coalesce(F.length("text"), F.lit(0))).otherwise(0)).alias("_chars"))
    per_page = F.col("_chars") / F.least("n_pages", F.lit(sample))
    return rows.select("doc", "n_pages", per_page.alias("per_page"), F.when(per_page > least, "DIGITAL (texto)").otherwise("ESCANEADO? (OCR)").alias("kind"))
