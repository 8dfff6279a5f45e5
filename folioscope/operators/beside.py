"""A set of queries beside all rows of a table: each task holds the queries and streams its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import shared

#: Bytes of queries that are broadcast; more are dealt into blocks of about this size, each of which meets all rows.
MOST_BYTES = 32 << 20

Run = Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def best_beside(rows: DataFrame, queries: DataFrame, size: Column, run: Run, schema: str) -> DataFrame:
    """beside(), its result written as a table: some rows for each query and task, made from few rows at a time."""
    return shared.kept(beside(rows, queries, size, run, schema), shared.fresh(rows.sparkSession, "best"))


def beside(rows: DataFrame, queries: DataFrame, size: Column, run: Run, schema: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """What run makes of (all queries, some rows), for all rows. size: bytes of a query; the sum decides how queries travel.

    Queries up to most_bytes are broadcast. Larger sets are dealt into blocks; a block goes to every part of the rows, ahead
    of them in the same sorted partition, so that a task reads its block and then streams rows. Results must not depend on
    how queries are blocked.
    """
    total = queries.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    if total <= most_bytes:
        sent = queries.sparkSession.sparkContext.broadcast(_packed(queries.toArrow()))
        return rows.mapInArrow(lambda batches: run(pa.ipc.open_stream(sent.value).read_all(), batches), schema)
    blocks, parts = -(-int(total) // most_bytes), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    whole = lambda df: F.struct(*[F.col(c) for c in df.columns])
    asked = queries.select(whole(queries).alias("q"), F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)).alias("block")).select("block", each(parts).alias("part"), "q")
    given = rows.select(whole(rows).alias("r"), F.pmod(F.xxhash64(rows.columns[0]), F.lit(parts)).alias("part")).select(each(blocks).alias("block"), "part", "r")
    both = asked.withColumn("kind", F.lit(0)).unionByName(given.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("block", "part", "kind")), strict=True))
                at = 0
                for end in range(1, len(keys) + 1):
                    if end == len(keys) or keys[end] != keys[at]:
                        kind = keys[at][2]
                        yield keys[at][:2], kind, pa.RecordBatch.from_struct_array(batch.column("r" if kind else "q").slice(at, end - at))
                        at = end

        stream = pieces()
        piece = next(stream, None)
        while piece is not None:
            group, asked = piece[0], []
            while piece is not None and piece[0] == group and not piece[1]:
                asked.append(piece[2])
                piece = next(stream, None)

            def own(first):
                nonlocal piece
                piece = first
                while piece is not None and piece[0] == group:
                    yield piece[2]
                    piece = next(stream, None)

            if asked:
                yield from run(pa.Table.from_batches(asked), own(piece))
            while piece is not None and piece[0] == group:  # rows that meet no query, or that run left
                piece = next(stream, None)

    return both.repartition("block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(dealt, schema)


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()

