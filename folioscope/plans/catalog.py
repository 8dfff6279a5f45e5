"""The engine's operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope import shared
from folioscope.functions import rules
from folioscope.functions import text as T
from folioscope.operators import advisory, audit, chunking, dense, fusion, graph, lexical, sparse
from folioscope.plans import adapters, index
from folioscope.plans.adapters import view
from folioscope.sources import markdown, pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KINDS = ("en", "fr")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, adapters.CHUNKS)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, adapters.QUERIES).withColumn("qid", F.col("qid").cast("long"))



def ranked_lists(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int, slug: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = chunks(spark, sf_dir)
    allowed = rows.where(F.col("slug") == slug) if slug else None
    return rows, lexical.bm25(lexical.index(rows), asked, k, allowed), sparse.cosine(sparse.index(rows), asked, k)


# Lexical ---------------------------------------------------------------------------------------------------------


@query
def fold_tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms and how many documents have them."""
    return lexical.index(chunks(spark, sf_dir)).frequencies


@query
def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings and lengths by document: how many terms, tokens, and the highest count of a term."""
    found = lexical.index(chunks(spark, sf_dir))
    per = found.terms.groupBy("rid").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf"))
    return found.lengths.join(per, "rid", "left").select("rid", "dl", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("max_tf", F.lit(0)).alias("max_tf"))


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lexical.bm25(lexical.index(chunks(spark, sf_dir)), questions(spark, sf_dir), 10)
    return best.select("qid", "rank", "rid", F.round("score", 4).alias("score"))


@query
def bm25_topk_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one source; the statistics are those of all."""
    rows = chunks(spark, sf_dir)
    best = lexical.bm25(lexical.index(rows), questions(spark, sf_dir), 10, rows.where("slug = 'src3'"))
    return best.select("qid", "rank", "rid", F.round("score", 4).alias("score"))


@query
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word with an underscore is a phrase of adjacent terms."""
    asked = spark.createDataFrame([(0, "of_the"), (1, "and_the of")], "qid long, query string")
    best = lexical.bm25(lexical.index(chunks(spark, sf_dir)), asked, 10)
    return best.select("qid", "rank", "rid", F.round("score", 4).alias("score"))


@query
def lexical_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return lexical.lexical(rows, lexical.index(rows), questions(spark, sf_dir), 5).select("qid", "rank", "rid", "citation", "doc_type", "snippet")


# Sparse and dense ------------------------------------------------------------------------------------------------


@query
def sparse_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features with their dimension and how often they occur."""
    rows = chunks(spark, sf_dir)
    return sparse.feature_totals(rows, sparse.document_text(rows))


@query
def sparse_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.index(chunks(spark, sf_dir)).idf.select("dim", F.round("v", 4).alias("v"))


@query
def sparse_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = sparse.cosine(sparse.index(chunks(spark, sf_dir)), questions(spark, sf_dir), 10)
    return best.select("qid", "rank", "rid", F.round("score", 3).alias("score"))


@query
def dense_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("rid"), dense.unit(F.col("embedding")).alias("embedding"))
    asked = vectors.where("rid % 50 = 0").withColumnRenamed("rid", "qid")
    return dense.nearest(vectors, asked, 10).select("qid", "rank", "rid", F.round("score", 4).alias("score"))


# Fusion ----------------------------------------------------------------------------------------------------------


@query
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, words, vectors = ranked_lists(spark, sf_dir, questions(spark, sf_dir), 50)
    return fusion.fuse([words, vectors]).select("qid", "rid", F.round("rrf", 6).alias("rrf"))


@query
def hybrid_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    rows, words, vectors = ranked_lists(spark, sf_dir, asked, fusion.POOL)
    return fusion.hybrid(rows, words, vectors, types=None).select("qid", "rank", "rid", "score", "citation", "vigente")


@query
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, source and force count after pooling; only the lexical list is ranked within the source."""
    asked = questions(spark, sf_dir)
    rows, words, vectors = ranked_lists(spark, sf_dir, asked, fusion.POOL, "src3")
    return fusion.hybrid(rows, words, vectors, slug="src3", types=KINDS, with_repealed=False).select("qid", "rank", "rid", "score", "doc_type")


@query
def hybrid_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark passages as queries in one plan, by the lexical and the semantic list."""
    rows, words, vectors = ranked_lists(spark, sf_dir, view(spark, sf_dir, adapters.PASSAGES), fusion.POOL)
    return fusion.hybrid(rows, words, vectors, types=None, with_repealed=True).select("qid", "rank", "rid", "score")


def words_held(hits: DataFrame) -> DataFrame:
    """A stand-in scorer: how many of the query's words the whole text holds."""
    terms = lambda c: F.array_distinct(T.tokens(F.col(c)))
    return hits.withColumn("score", F.size(F.array_intersect(terms("query"), terms("text"))).cast("double"))


@query
def rerank_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The margin cut over both lists, scored by whole texts."""
    asked = questions(spark, sf_dir)
    rows, words, vectors = ranked_lists(spark, sf_dir, asked, fusion.POOL)
    out = fusion.hybrid(rows, words, vectors, types=None, with_repealed=True, margin=0.5, reranker=words_held, queries=asked)
    return out.select("qid", "rank", "rid", "score")


@query
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).where((F.col("article") == "45") | ((F.col("article") == "103") & (F.col("slug") == "src3")))
    return rows.select("rid", "citation", (F.col("vigente") == 1).alias("vigente"), (F.col("vigente") != 1).alias("derogado"), "text")


# Stored index ----------------------------------------------------------------------------------------------------


def stored(spark: SparkSession, rows: DataFrame, only_words: bool = True) -> index.Index:
    return index.build(spark, rows, shared.fresh(spark, "index"), only_words=only_words)


@query
def stored_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk, from a stored index, reading the spans of rows that can reach the tenth score."""
    best = lexical.bm25(stored(spark, chunks(spark, sf_dir)).lexicon, questions(spark, sf_dir), 10)
    return best.select("qid", "rank", "rid", F.round("score", 4).alias("score"))


@query
def stored_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_phrase, from a stored index: the places of each phrase's rarest term name the rows to look at."""
    asked = spark.createDataFrame([(0, "of_the"), (1, "and_the of")], "qid long, query string")
    best = lexical.bm25(stored(spark, chunks(spark, sf_dir)).lexicon, asked, 10)
    return best.select("qid", "rank", "rid", F.round("score", 4).alias("score"))


@query
def stored_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As hybrid_adaptive, from a stored index."""
    asked, ix = questions(spark, sf_dir), stored(spark, chunks(spark, sf_dir), only_words=False)
    words, vectors = lexical.bm25(ix.lexicon, asked, fusion.POOL), sparse.cosine(ix.sparse, asked, fusion.POOL)
    return fusion.hybrid(ix.chunks, words, vectors, types=None).select("qid", "rank", "rid", "score", "citation", "vigente")


@query
def refreshed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best scores of both lists from an index of earlier texts, to which the changed sources' rows were added: those of an index of all rows as they are now."""
    rows = chunks(spark, sf_dir)
    changed = F.crc32(F.col("slug").cast("binary")) % 2 == 0
    earlier = rows.withColumn("text", F.when(changed, F.concat(F.lit("the former "), F.upper("text"), F.lit(" of the"))).otherwise(F.col("text")))
    path = shared.fresh(spark, "index")
    index.build(spark, earlier, path)
    ix, asked = index.add(spark, rows.where(changed), path), questions(spark, sf_dir)
    lists = [("words", lexical.bm25(ix.lexicon, asked, 10)), ("vectors", sparse.cosine(ix.sparse, asked, 10))]
    out = [x.select(F.lit(name).alias("list"), "qid", "rank", F.round("score", 3).alias("score")) for name, x in lists]
    return out[0].unionByName(out[1])


# Chunking --------------------------------------------------------------------------------------------------------


@query
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs of 15 characters or more."""
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    rows = chunks(spark, sf_dir).select("rid", F.posexplode(chunking.paragraphs(spaced)).alias("k", "text"))
    return rows.groupBy("rid").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min(F.length("text")).cast("long").alias("shortest"))


@query
def sectionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, adapters.LINES)
    found = chunking.articles(chunking.sections(lines))
    return found.select("slug", "heading", chunking.article_of(F.col("heading")).alias("article"), F.col("sec").cast("long").alias("sec"), "structure", "body")


@query
def numbered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.articles(chunking.sections(view(spark, sf_dir, adapters.LINES)))
    return chunking.numbered(found, "slug", "pos").select("rid", "slug", "heading")


@query
def frontmatter_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.concat(F.lit('---\ntype: reference\nsource: "'), F.col("source"), F.lit('"\nnote: a: b\nlang: x\nlang: '), F.col("lang"), F.lit("\n---\n"), F.col("text"))
    raw = F.when(F.col("doc_id") % 10 == 0, F.col("text")).otherwise(raw)
    keys = markdown.frontmatter(raw)
    return docs.select("doc_id", keys["type"].alias("type"), keys["source"].alias("from_source"), keys["note"].alias("note"), keys["lang"].alias("from_lang"), F.length(markdown.body(raw)).cast("long").alias("body_chars"), F.length(markdown.strict_body(raw)).cast("long").alias("strict_chars"))


@query
def markdown_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all documents, written by the sink and read by the source: what came back, and whether it is what was written."""
    parts = view(spark, sf_dir, adapters.MARKDOWN).groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "part"))), lambda p: p["part"]), "").alias("body"))
    files = parts.select("slug", F.concat(F.lit('---\nsource: "'), "slug", F.lit('"\n---\n\n'), "body").alias("text"))
    path = shared.fresh(spark, "markdown")
    markdown.write(files, path)
    back = markdown.read(spark, path).select("slug", "file_name", "raw")
    same = back.join(files, "slug", "full")
    return same.select("slug", "file_name", F.length("raw").cast("long").alias("n_chars"), F.md5("raw").alias("digest"), markdown.frontmatter(F.col("raw"))["source"].alias("from_source"), F.col("raw").eqNullSafe(F.col("text")).alias("same"))


@query
def inforce_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, adapters.STATUTES)
    return rows.select("slug", "article", rules.in_force(F.col("text")).alias("in_force"))


@query
def split_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, adapters.STATUTES)
    operative, notes = chunking.split_notes(F.col("text"))
    return rows.select("slug", "article", operative.alias("operative"), notes.alias("notes"))


# Names -----------------------------------------------------------------------------------------------------------


@query
def classify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(view(spark, sf_dir, adapters.SLUGS))


@query
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, adapters.FILES)
    return rows.select("id", "file", T.slug(F.regexp_replace("file", r"\.[^.]*$", "")).alias("slug"), rules.doc_kind(F.col("file")).alias("kind"))


# Graph -----------------------------------------------------------------------------------------------------------


@query
def refs_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, adapters.STATUTES)
    return rows.select("article", F.explode(graph.references(F.col("text"))).alias("dst"))


@query
def ref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(view(spark, sf_dir, adapters.STATUTES))


def _related(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    rows = view(spark, sf_dir, adapters.STATUTES)
    return graph.related(rows, graph.edges(rows), rows, False).where(F.col("relation") == relation)


def _placed(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("slug", "article").orderBy(T.article_key(F.col("other")))
    return found.select("slug", "article", "other", F.row_number().over(order).alias("place"))


@query
def related_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every article cites."""
    return _placed(_related(spark, sf_dir, "cites"))


@query
def related_cited_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cites every article."""
    return _placed(_related(spark, sf_dir, "cited_by"))


@query
def related_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every article, how many neighbours it has, and the first of them."""
    rows = view(spark, sf_dir, adapters.STATUTES)
    return graph.neighbors(rows, rows).select("slug", "article", "n", "first")


@query
def citation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("code-0", "10"), ("code-1", "11"), ("code-1", "10"), ("none", "1")], "slug string, article string")
    return graph.citations(view(spark, sf_dir, adapters.STATUTES), wanted)


# Advisory --------------------------------------------------------------------------------------------------------


def found_core(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Core hits (qid, rank, rid, slug, article, doc_type): the best of all rows for each question."""
    return lexical.bm25(lexical.index(rows), asked, fusion.CAP).join(rows.select("rid", "slug", "article", "doc_type"), "rid")


@query
def consult_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph ties to hits that a search over all statutes finds."""
    rows = view(spark, sf_dir, adapters.STATUTES).withColumn("vigente", rules.in_force(F.col("text")).cast("int"))
    asked = view(spark, sf_dir, adapters.STATUTE_QUERIES).withColumn("qid", F.col("qid").cast("long"))
    core = shared.kept(found_core(rows, asked), shared.fresh(spark, "core"))  # a few rows for each question, read several times
    out = advisory.expand(core, rows, shared.kept(graph.edges(rows), shared.fresh(spark, "edges")))
    return out.select("qid", "place", "slug", "article", "relation", "citation", "vigente", "excerpt")


@query
def consult_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits grouped by source, the best source first."""
    best = lexical.bm25(lexical.index(chunks(spark, sf_dir)), questions(spark, sf_dir), 25)
    core = best.join(chunks(spark, sf_dir).withColumn("doc_type", F.lit("ley")), "rid").withColumn("score", F.round("score", 4))
    return advisory.groups(core).select("qid", "name", "group_place", F.col("best").alias("best_score")).distinct()


@query
def topic_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return advisory.topics(rows, lexical.index(rows), questions(spark, sf_dir), kind="en")


@query
def consult_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of the sample questions as JSON, cut down to how many entries they hold."""
    rows, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    words = lexical.narrowed(lexical.index(rows), lexical.asked_for(asked))  # for both searches below
    law = rows.withColumn("doc_type", F.when(F.col("doc_type") == "fr", "ley").otherwise(F.col("doc_type")))
    core = fusion.hybrid(law, lexical.bm25(words, asked, fusion.POOL), sparse.cosine(sparse.index(rows), asked, fusion.POOL), with_repealed=True)
    core = shared.kept(core, shared.fresh(spark, "core"))  # a few rows for each question, read several times below
    refs = shared.kept(graph.edges(law), shared.fresh(spark, "edges"))  # for each relation
    made = advisory.bundle(asked, core, advisory.expand(core, law, refs), advisory.topics(rows, words, asked, kind="en"))
    size = lambda part: F.size(F.from_json(F.get_json_object("bundle", f"$.{part}"), "array<string>")).cast("long")
    return made.select("qid", F.get_json_object("bundle", "$.question").alias("question"), size("core").alias("n_core"), size("related").alias("n_related"), size("topics").alias("n_topics"))


# Text ------------------------------------------------------------------------------------------------------------


@query
def focus_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents cut to head and best window for a query."""
    rows = chunks(spark, sf_dir)
    cut = T.focus(F.lit("estion ndtion ément heit"), F.col("text"))
    return rows.where(F.length("text") > 1800).select("rid", F.length(cut).cast("long").alias("n"), F.md5(cut).alias("digest"))


@query
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("rid", T.excerpt(F.col("text"), 100).alias("excerpt"))


# Audit -----------------------------------------------------------------------------------------------------------


@query
def fidelity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.word_differences(view(spark, sf_dir, adapters.PAIRS)).groupBy("doc").agg(F.sum("lost").alias("lost"), F.sum("added").alias("added"), F.count("*").alias("words"))


@query
def fidelity_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.comma_census(view(spark, sf_dir, adapters.PAIRS))


@query
def fidelity_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sign_census(view(spark, sf_dir, adapters.PAIRS))


@query
def fidelity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.result(audit.verdict(view(spark, sf_dir, adapters.PAIRS)))


# Pages -----------------------------------------------------------------------------------------------------------


def _page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a printed code, made of conversations: footers, card marks, glued articles, page numbers."""
    rows = view(spark, sf_dir, adapters.PAGES)
    head = F.concat(F.lit("1/2/24, 10:30 Texto Completo norma.html 1/9\n\nTÍTULO "), F.col("page_no").cast("string"), F.lit("\n\nFicha articulo Artículo "), (F.col("page_no") + 1).cast("string"), F.lit("º.- "))
    tail = F.concat(F.lit(" Artículo "), (F.col("page_no") + 100).cast("string"), F.lit(" BIS.- fin http://x.y/z\n\n12 de 30\n\n"))
    return rows.withColumn("text", F.concat(head, F.col("text"), tail))


@query
def article_resegment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.joined(_page_text(spark, sf_dir)).select("doc", F.posexplode(pages.article_blocks(F.col("raw"))).alias("k", "b"))
    return found.groupBy("doc").agg(*[F.count(F.when(F.col("b.kind") == kind, 1)).alias(f"n_{kind}") for kind in ("article", "structure", "text")])


@query
def outline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.joined(view(spark, sf_dir, adapters.PAGES))
    made = pages.outline(F.concat(F.lit("Intro\n\n3 de 9\n Temario de prueba \nel temario\n"), F.col("raw")))
    return rows.select("doc", F.md5(made).alias("digest"))


@query
def page_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.joined(_page_text(spark, sf_dir))
    return rows.select("doc", "n_pages", F.size(pages.blocks(pages.without_footers(F.col("raw")))).cast("long").alias("n_blocks"))


@query
def page_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.density(view(spark, sf_dir, adapters.PAGES)).select("doc", "n_pages", F.round("per_page", 4).alias("per_page"), "kind")


@query
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by source and in total."""
    rows = chunks(spark, sf_dir).groupBy("slug").agg(F.count("*").alias("n_pages"), F.sum(F.col("vigente")).alias("n_articles"), F.sum(F.length("text")).alias("chars"))
    return pages.report(rows.withColumnRenamed("slug", "doc"))


@query
def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, adapters.STATUTES).withColumn("vigente", rules.in_force(F.col("text")).cast("int"))
    c = rows.agg(F.count("*").alias("chunks"), F.countDistinct("slug").alias("documents"), F.count(F.when(F.col("vigente") == 0, 1)).alias("repealed"))
    return c.crossJoin(graph.edges(rows).agg(F.count("*").alias("edges")))
