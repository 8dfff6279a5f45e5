"""Exact top-k search by inner product: tiles of candidates times blocks of queries, best lists merged upward."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import quoted, table

K = 10
SCALE = 1024
#: Rows of a tile of candidates and of a block of queries.
TILE, BLOCK = 4096, 512
#: Blocks of queries that a task holds, about.
HELD = 16
#: Stands for no score; its negative is a number, too.
NONE = -(2**63) + 1
SIDE = "dim int, n int, ids binary, data binary"


def matrices(vectors: DataFrame, rows: int, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(dim, n, ids, data): vectors as floor(scale * x), in packed rows by their length. Null vectors and those with a null or non-finite component take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            values = lists.flatten()
            x = np.floor(np.asarray(pc.fill_null(values, float("nan")), dtype=np.float64) * scale)
            ends = np.cumsum(lengths)
            good = (lengths > 0) & np.asarray(pc.and_(lists.is_valid(), batch.column("id").is_valid()))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good &= bad[ends] == bad[ends - lengths]
            ids = np.asarray(pc.fill_null(batch.column("id"), 0), dtype=np.int64)
            for d in np.unique(lengths[good]):
                own = np.flatnonzero(good & (lengths == d))
                for a in range(0, len(own), rows):
                    some = own[a : a + rows]
                    some = some[np.argsort(ids[some], kind="stable")]
                    at = (ends[some] - d)[:, None] + np.arange(d)
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(some)], pa.int32()), pa.array([ids[some].tobytes()], pa.binary()), pa.array([x[at].tobytes()], pa.binary())], ["dim", "n", "ids", "data"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, SIDE)


def products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where each sum is exact there, else by 64-bit or unbounded integers; beyond 64 bits the nearest such number."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(tile).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries @ tile.T).astype(np.int64)
    if most < 2**62:
        return queries.astype(np.int64) @ tile.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip((whole(queries) @ whole(tile).T), NONE + 1, 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k highest scores and their ids, equal scores by smaller id; ids has the shape of scores."""
    if scores.shape[1] > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        if int((scores >= least).sum(axis=1).max()) == k:  # no tie at the edge
            some = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        else:
            some = np.lexsort((ids, -scores), axis=1)[:, :k]
        scores, ids = np.take_along_axis(scores, some, 1), np.take_along_axis(ids, some, 1)
    order = np.lexsort((ids, -scores), axis=1)
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of each query's k highest inner products with all rows but those of its own id.

    Vectors of different lengths are not compared. Null vectors, and those with a null or non-finite component, take no
    part. Queries of equal id are one query, by the smallest vector; repeated candidates count each. Equal scores go to the
    smaller id. Scores are exact within 64 bits; beyond, they count as the nearest 64-bit number. Fewer than k candidates
    are all returned; no rows give no rows; other columns are not looked at.

    Blocks of queries are dealt into sets of bounded size. A task holds one set and streams its group of tiles past it:
    a tile is copied for each set, never for each block or query. It keeps k candidates for each query; the tasks' lists
    are merged by a ranking that stops at k.
    """
    spark = vectors.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = vectors.where(is_query & quoted(id_col).isNotNull()).groupBy(id_col).agg(F.min(vec_col).alias(vec_col))
    sets = max(1, -(-asked.count() // (HELD * BLOCK)))
    blocks = matrices(asked, BLOCK, id_col, vec_col, scale).withColumn("s", F.pmod(F.xxhash64("ids"), F.lit(sets)).cast("int"))
    blocks = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("is_tile", F.lit(False))
    tiles = matrices(vectors, TILE, id_col, vec_col, scale).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    tiles = tiles.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).withColumn("is_tile", F.lit(True))
    both = blocks.unionByName(tiles).repartition("g", "s").sortWithinPartitions("g", "s", "is_tile").select("g", "s", "is_tile", "dim", "ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for q_ids, _, scores, ids in held:
                real = scores > NONE
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, real.sum(axis=1))), pa.array(ids[real]), pa.array(scores[real])], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                g, s, is_tile, dim, ids, data = (batch.column(c)[i].as_py() for c in range(6))
                if key != (g, s):
                    yield from done()
                    key, held = (g, s), []
                own, data = np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dim)
                if not is_tile:
                    none = np.empty((len(own), 0), np.int64)
                    held.append((own, data, none, none))
                    continue
                for n, (q_ids, queries, scores, best_ids) in enumerate(held):
                    if queries.shape[1] != dim:
                        continue
                    new = products(queries, data)
                    new[q_ids[:, None] == own[None, :]] = NONE
                    new, who = best(new, np.broadcast_to(own, new.shape), k)
                    held[n] = (q_ids, queries, *best(np.hstack([scores, new]), np.hstack([best_ids, who]), k))
        yield from done()

    lists = both.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = lists.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def op6_tiled_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for every vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
