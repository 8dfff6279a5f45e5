"""Advisory bundles: the articles found, what the graph ties to them, and study topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import article_key, excerpt
from folioscope.operators import graph, lexical

#: How far a bundle reaches, and its words for relations.
EXPAND, NEIGHBORS, RELATED, TOPICS = 6, 2, 40, 6
RELATIONS = {"cites": "cita", "cited_by": "citado_por", "neighbors": "misma_materia"}


def expand(core: DataFrame, chunks: DataFrame, refs: DataFrame, expand_top: int = EXPAND, neighbor_top: int = NEIGHBORS, most: int = RELATED) -> DataFrame:
    """(qid, place, slug, article, relation, citation, structure, vigente, excerpt) from core hits (qid, rank, slug, article, doc_type).

    The first expand_top law articles are followed, in order, through what they cite, what cites them and, for the first
    neighbor_top, what stands beside them. An article's first relation counts; articles of the core are left out. The first
    `most` are then looked up, those without a chunk dropped.
    """
    keys = core.where("article IS NOT NULL").select("qid", "slug", "article").distinct()
    order = Window.partitionBy("qid").orderBy("rank")
    seeds = core.where("doc_type = 'ley' AND article IS NOT NULL").withColumn("seed", F.row_number().over(order)).where(F.col("seed") <= expand_top).select("qid", "seed", "slug", "article")
    found = seeds.join(graph.related(chunks, refs, seeds), ["slug", "article"])
    step = F.when(F.col("relation") == "cites", 0).when(F.col("relation") == "cited_by", 1).otherwise(2)
    found = found.where((F.col("relation") != "neighbors") | (F.col("seed") <= neighbor_top)).select("qid", "slug", F.col("other").alias("article"), "relation", F.struct("seed", step.alias("step"), article_key(F.col("other")).alias("key")).alias("place"))
    found = found.join(keys, ["qid", "slug", "article"], "left_anti")
    first = found.groupBy("qid", "slug", "article").agg(F.min_by("relation", "place").alias("relation"), F.min("place").alias("place"))
    numbered = first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("place", "slug"))).where(F.col("place") <= most)
    rows = chunks.where("article IS NOT NULL").join(numbered.select("slug", "article").distinct(), ["slug", "article"], "left_semi").groupBy("slug", "article").agg(F.min_by(F.struct("citation", "structure", "text", "vigente"), "rid").alias("c"))
    named = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    return numbered.join(rows, ["slug", "article"]).select("qid", "place", "slug", "article", named[F.col("relation")].alias("relation"), "c.citation", "c.structure", (F.col("c.vigente") == 1).alias("vigente"), excerpt(F.col("c.text"), 220).alias("excerpt"))


def topics(chunks: DataFrame, lexicon: lexical.Lexicon, queries: DataFrame, k: int = TOPICS, kind: str = "temario") -> DataFrame:
    """(qid, rank, citation, rama, topic): the best chunks of study guides, whatever slug was asked for."""
    guides = chunks.where(F.col("doc_type") == kind)
    best = lexical.bm25(lexicon, queries, k, guides)
    return best.join(guides, "rid").select("qid", "rank", "citation", "rama", excerpt(F.col("text"), 100).alias("topic"))


def bundle(queries: DataFrame, core: DataFrame, related: DataFrame, found_topics: DataFrame) -> DataFrame:
    """(qid, bundle): for each query a JSON text of question, core, related and topics; lists of a few dozen entries."""

    def gathered(rows: DataFrame, order: str, fields: list[str], name: str) -> DataFrame:
        entry = F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("v"))
        return rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias(name))

    law = core.where("doc_type = 'ley'")
    lists = [
        gathered(law, "rank", ["doc_type", "rama", "name", "citation", "structure", "slug", "article", "score", "text"], "core"),
        gathered(related, "place", ["slug", "article", "relation", "citation", "structure", "vigente", "excerpt"], "related"),
        gathered(found_topics, "rank", ["citation", "rama", "topic"], "topics"),
    ]
    out = queries.select("qid", F.col("query").alias("question"))
    for x in lists:
        out = out.join(x, "qid", "left")
    return out.select("qid", F.to_json(F.struct("question", *[F.coalesce(c, F.array()).alias(c) for c in ("core", "related", "topics")]), {"ignoreNullFields": "false"}).alias("bundle"))


def groups(core: DataFrame) -> DataFrame:
    """Law hits with group_place: bodies of law by their best score, ties by the better rank."""
    own = Window.partitionBy("qid", "name")
    scored = core.where("doc_type = 'ley'").withColumn("best", F.max("score").over(own)).withColumn("_first", F.min("rank").over(own))
    return scored.withColumn("group_place", F.dense_rank().over(Window.partitionBy("qid").orderBy(F.desc("best"), "_first"))).drop("_first")


# What a printed sheet says -------------------------------------------------------------------------
QUESTION = "PREGUNTA: "
LAWS = "════ FUENTES DE LEY · %d artículo(s) en %d cuerpo(s) legal(es) ════"
BODY = "── %s  ·  %s ──"
RELATED_HEAD = "════ ARTÍCULOS RELACIONADOS · %d por concordancia ════"
RELATION_TITLES = {"cita": "cita a", "citado_por": "citado por", "misma_materia": "misma materia"}
REPEALED_MARK = " ⚠DEROG"
TOPICS_HEAD = "════ TEMARIO · guía de estudio (NO es la ley) ════"
# -----------------------------------------------------------------------------------------------------------------


def sheets(queries: DataFrame, core: DataFrame, related: DataFrame, found_topics: DataFrame) -> DataFrame:
    """(qid, sheet): for each query a page to read. Every entry becomes a row with its section and place, and a page is its rows in order."""
    law = groups(core)
    first = lambda *order: F.row_number().over(Window.partitionBy("qid", *order[:1]).orderBy(*order[1:])) == 1
    title = F.when(first("name", "rank"), F.concat(F.lit("\n"), F.format_string(BODY, "name", "rama"), F.lit("\n"))).otherwise("")
    named = F.coalesce(F.concat(F.lit("art. "), F.nullif("article", F.lit(""))), "citation")
    where = F.when(F.col("structure") != "", F.concat(F.lit("  ·  "), "structure")).otherwise("")
    counts = law.groupBy("qid").agg(F.count("*").alias("n"), F.countDistinct("name").alias("bodies"))
    head = queries.join(counts, "qid", "left").select("qid", F.lit(0).alias("part"), F.lit(0).alias("i"), F.lit(0).alias("k"), F.concat(F.lit(QUESTION), "query", F.lit("\n\n"), F.format_string(LAWS, F.coalesce("n", F.lit(0)), F.coalesce("bodies", F.lit(0)))).alias("text"))
    laws = law.select("qid", F.lit(1), F.col("group_place"), "rank", F.concat(title, F.lit("  • "), named, where, F.lit("\n      "), excerpt(F.col("text"), 240)))
    cited = F.concat("citation", F.when(F.coalesce("vigente", F.lit(True)), "").otherwise(REPEALED_MARK))
    entries = F.array_sort(F.collect_list(F.struct("place", cited.alias("c"))))
    titles = F.create_map(*[F.lit(x) for pair in RELATION_TITLES.items() for x in pair])
    order = F.array_position(F.array(*[F.lit(x) for x in RELATION_TITLES]), F.col("relation")).cast("int")
    ties = related.groupBy("qid", "relation").agg(entries.alias("e")).select("qid", F.lit(2), order, F.lit(1), F.concat(F.lit("  ["), titles[F.col("relation")], F.lit("] "), F.array_join(F.transform("e", lambda x: x["c"]), " · ")))
    ties_head = related.groupBy("qid").agg(F.count("*").alias("n")).select("qid", F.lit(2), F.lit(0), F.lit(0), F.concat(F.lit("\n"), F.format_string(RELATED_HEAD, "n")))
    branch = F.min("rank").over(Window.partitionBy("qid", "rama"))
    topic = F.concat(F.when(first("rama", "rank"), F.concat(F.lit("  ── "), "rama", F.lit(" ──\n"))).otherwise(""), F.lit("    • "), "topic")
    guides = found_topics.select("qid", F.lit(3), branch, "rank", topic)
    guides_head = found_topics.select("qid", F.lit(3), F.lit(0), F.lit(0), F.lit(f"\n{TOPICS_HEAD}")).distinct()
    rows = head
    for x in (laws, ties_head, ties, guides_head, guides):
        rows = rows.union(x)
    lines = F.array_sort(F.collect_list(F.struct("part", "i", "k", "text")))  # some dozens for each query
    return rows.groupBy("qid").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("sheet"))
