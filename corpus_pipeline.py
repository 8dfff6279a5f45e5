"""From raw documents to packed token windows: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import jaccard, mixing, packing, quality, recompress
from folioscope.llm.common import cut, quoted
from folioscope.llm.tokens import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    It learns from the labels of the given documents; without any, all stay. Null and empty texts are scored like any text,
    equal texts alike; repeated rows stay or go together; an empty table gives an empty one; columns of any name come along.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.train(docs.select("doc_id", "text"), labels))
    return scored.where(F.col("score") >= quality.THRESHOLD).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id.

    Null, empty and wordless texts are like nothing and stay, as do rows without an id; rows that repeat an id stay or go
    together; an empty table gives an empty one; columns of any name come along.
    """
    found = jaccard.join(docs)
    kept = found.where("component_id = doc_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*[quoted(c) for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents of smaller ids have, n_chars counted anew.

    Texts that lose nothing, null and empty ones among them, stay as they are; those that lose everything go. Rows without
    an id, and rows that repeat an id among each other, lose nothing; an empty table gives an empty one; columns of any
    name come along.
    """
    out = recompress.deduplicate(docs, keep=[c for c in docs.columns if c not in ("doc_id", "text")])
    out = out.where("n_removed = 0 OR n_removed < n_words")
    less = F.col("n_removed") > 0
    new = {"doc_id": F.col("doc_id"), "text": F.when(less, F.col("kept")).otherwise(F.col("row")["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(less, F.length("kept").cast("long")).otherwise(F.col("row")["n_chars"])
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, twice at most.

    Null and empty texts have no words and are not taken; equal rows are taken alike; a null source is a source; an empty
    table gives an empty one; columns of any name come along.
    """
    taken = mixing.mix(docs).where("copies > 0")
    return taken.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "row").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in windows of 4096 tokens.

    Null and empty texts are their end id alone; repeated rows are packed each; an empty table gives an empty one; columns
    but doc_id and text are not looked at.
    """
    return packing.pack(cut(packing.pieces(docs, vocabulary()), "pieces"))


#: Each takes (spark, docs, sf_dir).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing to target weights", mix_sources),
    ("packing", pack),
]

#: SQL can't express the classifier or the packing; tests/llm/test_pipeline.py holds each stage and a whole run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each one's result written as a table and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
