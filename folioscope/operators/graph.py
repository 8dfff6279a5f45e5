"""The graph of references between articles of a body of law."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.functions.text import article_key

TAIL = 20
WIDEST = 50


def references(text: Column) -> Column:
    """The numbers of the articles that a text refers to in its own body of law, ranges spelled out; distinct, unordered.

    A mention and what follows it are taken by lookaheads, so that mentions within another's tail are seen as well.
    """
    head = f"(?iuU){rules.REFERENCE}(?=((?s:.{{0,{TAIL}}})))"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(head), F.lit(1)).alias("region"), F.regexp_extract_all(text, F.lit(head), F.lit(2)).alias("tail"))
    own = F.transform(F.filter(found, lambda m: ~m["tail"].rlike(rules.EXTERNAL)), lambda m: m["region"])
    numbers = F.flatten(F.transform(own, lambda r: F.regexp_extract_all(r, F.lit(r"\d{1,4}"), F.lit(0))))
    ranges = F.flatten(F.transform(own, lambda r: F.regexp_extract_all(r, F.lit(r"(?U)\d{1,4}\s+a\s+\d{1,4}"), F.lit(0))))
    ends = F.transform(ranges, lambda r: F.struct(F.regexp_extract(r, r"^\d+", 0).cast("int").alias("a"), F.regexp_extract(r, r"\d+$", 0).cast("int").alias("b")))
    fair = F.filter(ends, lambda e: (e["b"] > e["a"]) & (e["b"] - e["a"] <= WIDEST))
    spelled = F.flatten(F.transform(fair, lambda e: F.transform(F.sequence(e["a"], e["b"]), lambda x: x.cast("string"))))
    return F.array_distinct(F.concat(numbers, spelled))


def edges(chunks: DataFrame) -> DataFrame:
    """(slug, src, dst): from each law article to the articles of its own slug that it refers to, but itself; one for each chunk that does."""
    found = chunks.where("doc_type = 'ley' AND article IS NOT NULL").select("slug", F.col("article").alias("src"), F.explode(references(F.col("text"))).alias("dst"))
    valid = chunks.where("article IS NOT NULL").select("slug", F.col("article").alias("dst")).distinct()
    return found.where("src <> dst").join(valid, ["slug", "dst"], "left_semi").select("slug", "src", "dst")


def related(chunks: DataFrame, refs: DataFrame, seeds: DataFrame, neighbors: bool = True) -> DataFrame:
    """(slug, article, relation, other) for seeds (slug, article): cites, cited_by and neighbors (of the section of the seed's first chunk).

    Neighbours are pairs, for seeds that are few; neighbors() has them as counts for all articles.
    """
    seeds = seeds.select("slug", "article").distinct()
    cites = refs.join(seeds.withColumnRenamed("article", "src"), ["slug", "src"]).select("slug", F.col("src").alias("article"), F.lit("cites").alias("relation"), F.col("dst").alias("other"))
    cited = refs.join(seeds.withColumnRenamed("article", "dst"), ["slug", "dst"]).select("slug", F.col("dst").alias("article"), F.lit("cited_by").alias("relation"), F.col("src").alias("other"))
    out = cites.unionByName(cited)
    if neighbors:
        first = chunks.join(seeds, ["slug", "article"]).groupBy("slug", "article").agg(F.min_by("section", "rid").alias("section"))
        mates = chunks.where("article IS NOT NULL").select("section", F.col("article").alias("other"))
        near = first.join(mates, "section").where("other <> article").select("slug", "article", F.lit("neighbors").alias("relation"), "other")
        out = out.unionByName(near)
    return out.distinct()


def classes(chunks: DataFrame) -> DataFrame:
    """(section, n, first, second): of each section how many articles it has, and the first two in their order; a row for each section.

    A section's articles are neighbours of each other: n rows and a count say so, instead of n times n - 1 pairs. Counts and
    minima are combined before they are shuffled, so that a section with most rows is no task's work.
    """
    members = chunks.where("article IS NOT NULL").select("section", "article").distinct()
    keyed = members.select("section", article_key(F.col("article")).alias("k"))
    least = keyed.groupBy("section").agg(F.count("*").alias("n"), F.min("k").alias("a"))
    after = keyed.join(least.select("section", "a"), "section").where("k > a").groupBy("section").agg(F.min("k").alias("b"))
    return least.join(after, "section", "left").select("section", "n", F.col("a")["a"].alias("first"), F.col("b")["a"].alias("second"))


def neighbors(chunks: DataFrame, seeds: DataFrame) -> DataFrame:
    """(slug, article, section, n, first) of seeds (slug, article) that have neighbours: the section of the seed's first chunk, how many other articles it has, and the first of them."""
    own = chunks.join(seeds.select("slug", "article").distinct(), ["slug", "article"]).groupBy("slug", "article").agg(F.min_by("section", "rid").alias("section"))
    found = own.join(classes(chunks), "section")
    other = F.when(F.col("first") == F.col("article"), F.col("second")).otherwise(F.col("first"))
    return found.where("n > 1").select("slug", "article", "section", (F.col("n") - 1).alias("n"), other.alias("first"))


def listed(relations: DataFrame) -> DataFrame:
    """(slug, article, cites, cited_by, neighbors): sorted lists, for a bounded set of seeds."""
    made = [F.transform(F.array_sort(F.collect_list(F.when(F.col("relation") == r, article_key(F.col("other"))))), lambda k: k["a"]).alias(r) for r in ("cites", "cited_by", "neighbors")]
    return relations.groupBy("slug", "article").agg(*made)


def citations(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (slug, article) with citation, made up from both where the article isn't known."""
    asked = wanted.select("slug", "article").distinct()
    first = chunks.where("article IS NOT NULL").join(asked, ["slug", "article"], "left_semi").groupBy("slug", "article").agg(F.min_by("citation", "rid").alias("_c"))
    return wanted.join(first, ["slug", "article"], "left").withColumn("citation", F.coalesce("_c", F.concat("slug", F.lit(" art. "), "article"))).drop("_c")
