"""Two tables rewritten as a co-bucketed pair: one sorted Parquet file for each table and bucket, so that a join reads each pair of files alone.

A Bloom filter of the first table's keys, built by treeAggregate, marks rows of the second that certainly have no partner
where they are read; all others are verified by an exact join within their buckets. Then a shuffle that sends bucket b to
partition b mod n, a sort in each partition, and a writer that closes each bucket's file before the next. Files that
hold a bucket already are left where they are.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import cut, drop, mix, new_path, quoted, table
from folioscope.llm.tokens import filesystem

BUCKETS = 600
#: Buckets of rows without partner and without key.
ORPHAN, NO_KEY = BUCKETS, BUCKETS + 1
#: The filter's size is fixed: with more keys it rules out fewer rows, and the join verifies more.
FILTER_BITS = 1 << 24
HASHES = 3
#: Rows of a file that are digested at once.
STEP_ROWS = 1 << 16
#: Columns and folders that rows pass through; a table that has such a column gets other names.
SOURCE, TARGET, TIMES = "from_file", "to_bucket", "partners"


def bucket_of(key: Column) -> Column:
    """The bucket of a key; null keys have their own."""
    return F.when(key.isNull(), NO_KEY).otherwise(F.crc32(F.concat(F.lit("s"), key.cast("string")).cast("binary")) % BUCKETS).cast("int")


def keyed_file(key: Column) -> Column:
    """Where rows of the first table start: with their bucket, but every fourth bucket shares the file before it."""
    b = bucket_of(key)
    return (b - F.when(b % 4 == 1, 1).otherwise(0)).cast("int")


def other_file(other: Column) -> Column:
    """Where rows of the second table start: by another column."""
    return F.coalesce(F.crc32(other.cast("string").cast("binary")) % BUCKETS, F.lit(0)).cast("int")


def places(keys: np.ndarray) -> np.ndarray:
    """The HASHES bits of each key in the filter."""
    a = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    b = mix(a) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(k) * b) % np.uint64(FILTER_BITS) for k in range(HASHES)]).astype(np.int64)


def bloom(rows: DataFrame, key: str) -> np.ndarray:
    """The Bloom filter of a table's keys as bytes of bits: a filter for each partition, ORed level by level by treeAggregate, so that the driver gets no more than four."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = places(np.asarray(batch.column("key").drop_null(), dtype=np.int64)).ravel()
            np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], ["bits"])

    def joined(a: bytes | None, b: bytes | None) -> bytes | None:
        if a is None or b is None:
            return a or b
        x, y = (np.frombuffer(zlib.decompress(c), np.uint8) for c in (a, b))
        return zlib.compress((x | y).tobytes(), 1)

    made = rows.select(quoted(key).cast("long").alias("key")).mapInArrow(partial, "bits binary").rdd
    levels = max(2, math.ceil(math.log2(max(made.getNumPartitions(), 2))))
    found = made.treeAggregate(None, lambda a, row: joined(a, bytes(row["bits"])), joined, depth=levels)
    return np.frombuffer(zlib.decompress(found), np.uint8) if found else np.zeros(FILTER_BITS // 8, np.uint8)


def may_hold(spark: SparkSession, bits: np.ndarray):
    """A function of a key column: whether the filter may hold the key; null isn't held."""
    known = spark.sparkContext.broadcast(bits.tobytes())

    @F.pandas_udf("boolean")
    def held(keys: pd.Series) -> pd.Series:
        there = keys.notna().to_numpy()
        at = places(keys.fillna(0).to_numpy().astype(np.int64))
        bits = np.frombuffer(known.value, np.uint8)
        return pd.Series((np.right_shift(bits[at >> 3], (at & 7).astype(np.uint8)) & 1).all(axis=0) & there)

    return held


def free(name: str, df: DataFrame) -> str:
    """The name, with underscores until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def write_files(rows: DataFrame, number: str, path: str, key: str, columns: list[str]) -> None:
    """One Parquet file path/<number>=<n>/part-*.parquet for each value of the column number, sorted by key descending, then the other columns ascending, nulls first.

    Each file is written by one task as its rows come out of the sort; a task writes its files one after the other. A lost
    or repeated task leaves no file.
    """
    spark = rows.sparkSession
    n = max(1, min(BUCKETS + 2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = [quoted(number).asc(), quoted(key).desc_nulls_first(), *[quoted(c).asc_nulls_first() for c in columns if c != key]]
    dealt = rows.select(*[quoted(c) for c in columns], quoted(number)).repartitionById(n, quoted(number) % n)
    dealt.sortWithinPartitions(*order).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(number).parquet(path)


def read_files(spark: SparkSession, path: str, number: str, schema: T.StructType) -> DataFrame:
    """Rows of the files that write_files wrote, with their numbers."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(number, T.IntegerType())])).parquet(path)


def data_files(spark: SparkSession, path: str, number: str) -> dict[int, str]:
    """The file of each number under the path; there are as many as buckets at most."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, found = at.getFileSystem(spark._jsc.hadoopConfiguration()), {}
    if fs.exists(at):
        files = fs.listFiles(at, True)
        while files.hasNext():
            name = files.next().getPath().toString()
            if m := re.search(rf"/{number}=(\d+)/[^/]*\.parquet$", name):
                if int(m[1]) in found:
                    raise ValueError(f"two files of one number: {name}")
                found[int(m[1])] = name
    return found


def remove(spark: SparkSession, paths: list[str]) -> None:
    for x in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(x)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def staying(moves: DataFrame) -> dict[int, int]:
    """Of moves (source, target, n): the targets of files whose rows are all the rows of one target."""
    once = lambda c: F.count("*").over(Window.partitionBy(c)) == 1
    return {r.source: r.target for r in moves.withColumn("a", once("source")).withColumn("b", once("target")).where("a AND b").select("source", "target").collect()}


def digests(files: DataFrame, key: str) -> DataFrame:
    """files (path, ...) with columns, n_rows and ids_sha256: each file is read in its order, some rows at a time, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for path in batch.column("path").to_pylist():
                fs, root = filesystem(path)
                digest, n = hashlib.sha256(), 0
                with fs.open_input_file(root) as f:
                    file = pq.ParquetFile(f)
                    for part in file.iter_batches(STEP_ROWS, columns=[key]):
                        ids = pc.fill_null(part.column(0).cast(pa.string()), "").to_pylist()
                        digest.update((("," if n else "") + ",".join(ids)).encode())
                        n += len(ids)
                    made.append((",".join(file.schema_arrow.names), n, digest.hexdigest()))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "columns", "n_rows", "ids_sha256"])

    schema = T.StructType([*files.schema.fields, T.StructField("columns", T.StringType()), T.StructField("n_rows", T.LongType()), T.StructField("ids_sha256", T.StringType())])
    return files.mapInArrow(run, schema)


def co_bucket(first: DataFrame, second: DataFrame, path: str, key: str, other: str, names: tuple[str, str]) -> DataFrame:
    """Write both tables under path, rewrite them there bucket by bucket, and return a row for each final file.

    (table_name, path, bucket, columns, n_rows, ids_sha256, lineage_sha256, n_joined, rewritten). Rows of the second table
    whose key the first doesn't have are in bucket ORPHAN, rows of either without a key in NO_KEY. Repeated rows and keys
    stay, n_joined counts each pair; a table without rows has no files; columns of any name come along, but must have types
    that can be sorted. Keys are whole numbers. What the driver sees is a row for each file, BUCKETS + 2 at most a table.
    """
    spark = first.sparkSession
    held = may_hold(spark, bloom(first, key))
    source, target, times = (free(free(x, first), second) for x in (SOURCE, TARGET, TIMES))
    start, final = {n: f"{path}/{n}/start" for n in names}, {n: f"{path}/{n}/final" for n in names}
    tables = dict(zip(names, (first, second), strict=True))
    write_files(first.withColumn(source, keyed_file(quoted(key))), source, start[names[0]], key, first.columns)
    write_files(second.withColumn(source, other_file(quoted(other))), source, start[names[1]], key, second.columns)
    a, b = (read_files(spark, start[n], source, tables[n].schema) for n in names)
    a, b = a.withColumn(target, bucket_of(quoted(key))), b.withColumn(target, bucket_of(quoted(key)))
    # a filter's no is certain; a yes is held against the keys, bucket by bucket
    known = a.where(quoted(key).isNotNull()).groupBy(target, key).agg(F.count("*").alias(times))
    verified = b.where(held(quoted(key))).join(known, [target, key], "left").withColumn(target, F.when(quoted(times).isNull(), ORPHAN).otherwise(quoted(target)))
    certain = b.where(~held(quoted(key))).withColumn(target, F.when(quoted(key).isNull(), NO_KEY).otherwise(ORPHAN)).withColumn(times, F.lit(None).cast("long"))
    b = cut(verified.unionByName(certain), "tagged")
    moved = {}
    for name, rows, partners in ((names[0], a, F.lit(None).cast("long")), (names[1], b, F.sum(times))):
        made = rows.groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.count("*").alias("n"), partners.cast("long").alias("joined"))
        moved[name] = cut(made, "moves")
        stay = staying(moved[name])
        write_files(rows.where(~F.col(source).isin(list(stay))) if stay else rows, target, final[name], key, tables[name].columns)
        old = data_files(spark, start[name], source)
        remove(spark, [x.rsplit("/", 1)[0] for s, x in old.items() if s not in stay])
        kept = [(name, x, stay[s], False) for s, x in old.items() if s in stay] + [(name, x, k, True) for k, x in data_files(spark, final[name], target).items()]
        moved[name] = moved[name], kept
    drop(b)
    listed = [x for _, kept in moved.values() for x in kept]
    files = spark.createDataFrame(listed, "table_name string, path string, bucket long, rewritten boolean").repartition(4 * max(1, spark.sparkContext.defaultParallelism))
    lineage = None
    for name, (moves, _) in moved.items():
        parts = F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda x: F.concat_ws(":", x["source"].cast("string"), x["n"].cast("string")))
        one = moves.groupBy(F.col("target").cast("long").alias("bucket")).agg(F.sha2(F.array_join(parts, ","), 256).alias("lineage_sha256")).withColumn("table_name", F.lit(name))
        lineage = one if lineage is None else lineage.unionByName(one)
    pairs = moved[names[1]][0].groupBy(F.col("target").cast("long").alias("bucket")).agg(F.sum("joined").alias("pairs"))
    out = digests(files, key).join(lineage, ["table_name", "bucket"]).join(pairs, "bucket", "left")
    return out.select("table_name", "path", "columns", "ids_sha256", "lineage_sha256", "bucket", "n_rows", F.coalesce("pairs", F.lit(0)).cast("long").alias("n_joined"), "rewritten")


def op11_co_bucketed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales and their lines as a co-bucketed pair of tables in a new folder."""
    return co_bucket(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), new_path(spark, "pair"), "sale_id", "item_id", ("sales", "sale_lines"))
