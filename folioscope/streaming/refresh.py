"""Add files to an index as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.plans import index
from folioscope.sources import markdown


def refresh(spark: SparkSession, corpus: str, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that reads new Markdown files under corpus and adds each batch to the index under path as a segment.

    A batch that is run again takes the place of itself, so each file counts once; row ids are given by the index. A stream
    sees each name once: sync() finds files that were changed or deleted.
    """
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").schema("value string").load(corpus)
    name = F.col("_metadata.file_name")
    rows = files.select(F.regexp_replace(name, r"\.md$", "").alias("slug"), name.alias("file_name"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("at"))

    def write(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("slug").agg(F.max_by(F.struct("file_name", "raw"), "at").alias("f")).select("slug", "f.file_name", "f.raw")
        index.add(batch.sparkSession, last, path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Changed files that are read by their names; where there are more, the folder is read.
NAMED = 10_000


def sync(spark: SparkSession, corpus: str, path: str) -> index.Index:
    """Bring the index under path to what the folder of Markdown files holds: new and changed files are added, rows of deleted ones removed.

    A stream sees a file once; here files are told by name, time of change and length, which a table beside the index keeps.
    Only changed files are read.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(corpus).select("path", F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("slug"), F.col("modificationTime").alias("changed"), "length")
    known = f"{path}/files-{index.state(spark, path).version:06d}"
    at = spark._jvm.org.apache.hadoop.fs.Path(known)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    before = spark.read.parquet(known) if there else listed.drop("path").where("false")
    new = listed.join(before, ["slug", "changed", "length"], "left_anti")
    gone = before.join(listed, "slug", "left_anti").select("slug")
    names = [r.path for r in new.select("path").limit(NAMED + 1).collect()]
    files = markdown.read(spark, names if names and len(names) <= NAMED else corpus).join(new.select("slug"), "slug", "left_semi")
    if not there and index.state(spark, path).version:
        gone = index.load(spark, path).chunks.select("slug").distinct().join(listed, "slug", "left_anti")
    made = index.add(spark, files, path, removed=gone)
    listed.drop("path").write.mode("overwrite").parquet(f"{path}/files-{index.state(spark, path).version:06d}")
    return made
