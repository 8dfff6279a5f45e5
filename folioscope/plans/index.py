"""The index as a folder of segments: a build or an addition writes one, searches read those that count."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import shared
from folioscope.operators import dense, graph, lexical, postings, sparse
from folioscope.operators.chunking import chunk
from folioscope.sources import markdown

HOME = "FOLIOSCOPE_HOME"
EMBEDDER = "FOLIOSCOPE_EMBEDDER"
SPARSE = "hashed-tf-idf"
#: Of an index for searches by words alone: it has neither vectors nor references.
WORDS = "words"
#: What a state of the index is made of: segments and removals (folders below the index), the rows and tokens that count, the highest row id, the chunks' columns as JSON.
STATE = "version long, segments array<string>, removals array<string>, n long, tokens long, top long, embedder string, columns string"


def home() -> str:
    """The engine's folder: $FOLIOSCOPE_HOME, else the working folder."""
    return os.environ.get(HOME) or str(Path.cwd())


def backend(encoder_at_hand: bool) -> str:
    """dense or sparse: as $FOLIOSCOPE_EMBEDDER says, else dense where an encoder is at hand."""
    asked = os.environ.get(EMBEDDER, "").strip().lower()
    return asked if asked in ("sparse", "dense") else "dense" if encoder_at_hand else "sparse"


@dataclass(frozen=True)
class Index:
    chunks: DataFrame
    lexicon: lexical.Lexicon
    refs: DataFrame | None
    weighed: Callable[[], sparse.Sparse | None]
    vectors: DataFrame | None
    meta: dict[str, str]

    @cached_property
    def sparse(self) -> sparse.Sparse | None:
        """Made when it is asked for, as the idf of all dimensions is gathered then."""
        return self.weighed()


@dataclass(frozen=True)
class State:
    version: int
    segments: tuple[str, ...]
    removals: tuple[str, ...]
    n: int
    tokens: int
    top: int
    embedder: str
    columns: str


EMPTY = State(0, (), (), 0, 0, 0, "", "")


def state(spark: SparkSession, path: str) -> State:
    """The newest state of the index; of two with one version the greater by its segments."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not any(x.getPath().getName().startswith("state-") for x in fs.listStatus(at)):
        return EMPTY
    states = spark.read.schema(STATE).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{path}/state-*")
    r = states.orderBy(F.desc("version"), F.desc("segments")).first()
    return State(r.version, tuple(r.segments), tuple(r.removals), r.n, r.tokens, r.top, r.embedder, r.columns)


def publish(spark: SparkSession, path: str, new: State) -> None:
    """Write a state under a name of its own, committed at once: readers see the old state or the new one."""
    row = (new.version, list(new.segments), list(new.removals), new.n, new.tokens, new.top, new.embedder, new.columns)
    spark.createDataFrame([row], STATE).coalesce(1).write.parquet(f"{path}/state-{new.version:06d}-{uuid.uuid4().hex}")


def _segment(spark: SparkSession, path: str, chunks: DataFrame, encoder, embedder: str) -> tuple[str, int, int, int]:
    """Write a segment of chunks that have their final rids; returns its folder, rows, tokens and highest rid."""
    name = f"segment-{uuid.uuid4().hex}"
    at = f"{path}/{name}"
    chunks.write.partitionBy("slug").parquet(f"{at}/chunks")
    chunks = spark.read.schema(chunks.schema).parquet(f"{at}/chunks")
    made = postings.store(postings.blocks_of(chunks, list(lexical.FIELDS)), f"{at}/blocks", move=False)
    made.where(F.col("term") != postings.EVERY).groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{at}/frequencies")
    every = made.where(F.col("term") == postings.EVERY).select(F.explode(F.arrays_zip("rids", "dls")).alias("r"))
    every.select(F.col("r.rids").alias("rid"), F.col("r.dls").alias("dl")).write.parquet(f"{at}/lengths")
    if embedder != WORDS:
        graph.edges(chunks).sortWithinPartitions("slug", "src").write.parquet(f"{at}/refs")
    if embedder == SPARSE:
        sparse.featured(chunks, "rid", sparse.document_text(chunks)).write.parquet(f"{at}/features")
        features = spark.read.schema(sparse.VECTORS.format("rid", "long")).parquet(f"{at}/features")
        features.select(F.explode("dims").alias("dim")).groupBy("dim").agg(F.count("*").alias("df")).write.parquet(f"{at}/dims")
    elif embedder != WORDS:
        dense.encode(chunks.select("rid", sparse.document_text(chunks).alias("t")), "rid", "t", encoder).write.parquet(f"{at}/vectors")
    r = spark.read.schema("rid long, dl long").parquet(f"{at}/lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"), F.coalesce(F.max("rid"), F.lit(0)).alias("top")).first()
    return name, r.n, r.tokens, r.top


def _chunked(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Chunks of a folder of Markdown files, a table of files, or a table of chunks."""
    if isinstance(source, str):
        source = markdown.read(spark, source)
    return chunk(source) if "raw" in source.columns else source


def build(spark: SparkSession, source: str | DataFrame, path: str, encoder=None, encoder_name: str = "", only_words: bool = False) -> Index:
    """Build the index of a folder of Markdown files (or of a table of files, or of chunks) under path, in place of what it held. only_words: for searches by words, without vectors and references."""
    embedder = WORDS if only_words else f"dense:{encoder_name}" if backend(encoder is not None) == "dense" else SPARSE
    chunks = _chunked(spark, source)
    with shared.writing(spark):
        name, n, tokens, top = _segment(spark, path, chunks, encoder, embedder)
    publish(spark, path, State(state(spark, path).version + 1, (name,), (), n, tokens, top, embedder, chunks.schema.json()))
    return load(spark, path)


def add(spark: SparkSession, source: str | DataFrame, path: str, removed: DataFrame | None = None, encoder=None) -> Index:
    """Add files (or chunks) to the index as a segment; they take the place of rows with their slugs, and rows of removed (slug) go.

    Only the new files are read. What goes is written as a removal: its row ids, and what its rows add to the statistics, so
    that searches of all segments are those of an index built anew. Adding the same files again changes nothing but names.
    """
    old = state(spark, path)
    if not old.version:
        return build(spark, source, path, encoder)
    base = -(-old.top // postings.SPAN) * postings.SPAN  # no span has rows of two segments
    new, schema = _chunked(spark, source), T.StructType.fromJson(json.loads(old.columns))
    new = new.select(*[F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    with shared.writing(spark):
        name, n, tokens, top = _segment(spark, path, new.withColumn("rid", F.col("rid") + base), encoder, old.embedder)
    slugs = spark.read.schema(new.schema).parquet(f"{path}/{name}/chunks").select("slug")
    slugs = (slugs.unionByName(removed.select("slug")) if removed is not None else slugs).distinct()
    index = load(spark, path)
    removal = f"removal-{uuid.uuid4().hex}"
    at = f"{path}/{removal}"
    slugs.withColumn("upto", F.lit(old.top).cast("long")).write.parquet(f"{at}/slugs")
    index.chunks.select("rid", "slug").join(slugs, "slug", "left_semi").join(index.lexicon.lengths, "rid").select("rid", "dl").write.parquet(f"{at}/rows")
    gone = spark.read.schema("rid long, dl long").parquet(f"{at}/rows")
    index.lexicon.terms.join(gone, "rid", "left_semi").groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{at}/frequencies")
    if old.embedder == SPARSE:
        features = _union(spark, path, old.segments, "features", sparse.VECTORS.format("rid", "long"))
        features.join(gone, "rid", "left_semi").select(F.explode("dims").alias("dim")).groupBy("dim").agg(F.count("*").alias("df")).write.parquet(f"{at}/dims")
    r = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
    publish(spark, path, State(old.version + 1, (*old.segments, name), (*old.removals, removal), old.n + n - r.n, old.tokens + tokens - r.tokens, max(old.top, top), old.embedder, old.columns))
    return load(spark, path)


def merge(spark: SparkSession, path: str) -> Index:
    """Write what counts of all segments as one segment, from their tables alone."""
    old, index = state(spark, path), load(spark, path)
    name = f"segment-{uuid.uuid4().hex}"
    at = f"{path}/{name}"
    index.chunks.write.partitionBy("slug").parquet(f"{at}/chunks")
    made = postings.store(postings.blocks(index.lexicon.places, list(lexical.FIELDS)), f"{at}/blocks")
    made.groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{at}/frequencies")
    index.lexicon.lengths.write.parquet(f"{at}/lengths")
    if index.refs is not None:
        index.refs.sortWithinPartitions("slug", "src").write.parquet(f"{at}/refs")
    if old.embedder == SPARSE:
        _features(spark, path, old).write.parquet(f"{at}/features")
        spark.read.schema(sparse.VECTORS.format("rid", "long")).parquet(f"{at}/features").select(F.explode("dims").alias("dim")).groupBy("dim").agg(F.count("*").alias("df")).write.parquet(f"{at}/dims")
    elif index.vectors is not None:
        index.vectors.write.parquet(f"{at}/vectors")
    publish(spark, path, State(old.version + 1, (name,), (), old.n, old.tokens, old.top, old.embedder, old.columns))
    return load(spark, path)


def sweep(spark: SparkSession, path: str) -> None:
    """Delete states but the newest, and folders that it doesn't name. To be run when nothing reads older states."""
    new = state(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    states = sorted(x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().startswith(f"state-{new.version:06d}-"))
    named = {*new.segments, *new.removals, *states}
    for x in fs.listStatus(at):
        name = x.getPath().getName()
        if name.startswith(("segment-", "removal-", "state-", "files-")) and name not in named and name != f"files-{new.version:06d}":
            fs.delete(x.getPath(), True)


def _union(spark: SparkSession, path: str, folders: tuple[str, ...], name: str, schema: str | T.StructType) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{path}/{f}/{name}") for f in folders])


def _less(spark: SparkSession, path: str, now: State, name: str, key: str, schema: str) -> DataFrame:
    """(key, df): what the segments have, less what the removals take."""
    found = _union(spark, path, now.segments, name, schema)
    if now.removals:
        found = found.unionByName(_union(spark, path, now.removals, name, schema).withColumn("df", -F.col("df")))
    elif len(now.segments) == 1:
        return found
    return found.groupBy(key).agg(F.sum("df").alias("df")).where("df > 0")


def _gone(spark: SparkSession, path: str, now: State) -> DataFrame | None:
    return _union(spark, path, now.removals, "rows", "rid long, dl long").select("rid") if now.removals else None


def _features(spark: SparkSession, path: str, now: State) -> DataFrame:
    return lexical.without(_union(spark, path, now.segments, "features", sparse.VECTORS.format("rid", "long")), _gone(spark, path, now))


def load(spark: SparkSession, path: str) -> Index:
    now = state(spark, path)
    if not now.version:
        raise ValueError(f"no index under {path}")
    gone = _gone(spark, path, now)
    live = lambda name, schema: lexical.without(_union(spark, path, now.segments, name, schema), gone)
    blocks = _union(spark, path, now.segments, "blocks", postings.BLOCKS).where(F.col("term") != postings.EVERY)
    rows = lexical.without(postings.rows_of(blocks, with_places=True), gone)
    fields = F.array(*map(F.lit, lexical.FIELDS))
    place = F.explode("at").alias("p")
    places = rows.select("rid", "dl", "term", place).select("rid", "dl", F.element_at(fields, F.floor(F.col("p") / postings.FIELD).cast("int")).alias("field"), (F.col("p") % postings.FIELD).cast("int").alias("pos"), "term")
    totals = spark.createDataFrame([(now.n, now.tokens / now.n if now.n else 0.0)], "n long, avgdl double")
    words = lexical.Lexicon(rows.select("rid", "term", "tf"), live("lengths", "rid long, dl long"), _less(spark, path, now, "frequencies", "term", "term string, df long"), totals, places, stored=True, blocks=blocks, gone=gone)
    refs = None if now.embedder == WORDS else reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{s}/refs").withColumn("_segment", F.lit(i)) for i, s in enumerate(now.segments)])
    if refs is not None and now.removals:  # the i-th removal came with segment i + 1 and takes the slugs of those before
        taken = reduce(DataFrame.unionByName, [spark.read.schema("slug string").parquet(f"{path}/{r}/slugs").select(F.col("slug").alias("_slug"), F.lit(i).alias("_upto")) for i, r in enumerate(now.removals)])
        refs = refs.join(taken, (F.col("slug") == F.col("_slug")) & (F.col("_segment") <= F.col("_upto")), "left_anti")
    is_dense = now.embedder.startswith("dense")

    def weighed() -> sparse.Sparse | None:
        if now.embedder != SPARSE:
            return None
        df = _less(spark, path, now, "dims", "dim", "dim int, df long")
        idf = df.where(F.col("df") < now.n).select("dim", F.log(F.lit(now.n) / F.col("df")).alias("v"))
        counts, sent = _features(spark, path, now), sparse.spread(idf)
        return sparse.Sparse(idf.select("dim", F.round("v", sparse.DIGITS).alias("v")), sparse.weighed(counts, "rid", sent, sparse.DIGITS), counts=counts, sent=sent)

    meta = {"N": str(now.n), "embedder": now.embedder}
    chunks = live("chunks", T.StructType.fromJson(json.loads(now.columns)))
    return Index(chunks, words, refs.drop("_segment") if refs is not None else None, weighed, live("vectors", "rid long, embedding array<float>") if is_dense else None, meta)


def report(index: Index) -> DataFrame:
    """One row: (chunks, documents, articles, repealed, edges)."""
    c = index.chunks.agg(F.count("*").alias("chunks"), F.countDistinct("slug").alias("documents"), F.count("article").alias("articles"), F.count(F.when(F.col("vigente") == 0, 1)).alias("repealed"))
    return c.crossJoin(index.refs.agg(F.count("*").alias("edges")))
