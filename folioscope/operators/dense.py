"""Dense vectors: pluggable encoders and exact nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.beside import beside
from folioscope.operators.lexical import top

#: From texts and a kind ("query" or "passage") to a matrix of a row for each.
Encoder = Callable[[list[str], str], np.ndarray]
#: Numbers of vectors that are grouped and multiplied at once. A bound on memory only.
STEP_CELLS = 1 << 20


def unit(vector: Column) -> Column:
    """The vector at length 1; one of length 0 stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def encode(rows: DataFrame, key: str, text: str, encoder: Callable[[], Encoder], kind: str = "passage") -> DataFrame:
    """(key, embedding): vectors of length 1 of a column of texts. encoder makes the model, once in each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for batch in batches:
            made = np.asarray(model(batch[text].fillna("").tolist(), kind), dtype=np.float32)
            length = np.linalg.norm(made, axis=1, keepdims=True)
            length[length == 0] = 1
            yield pd.DataFrame({key: batch[key], "embedding": list(made / length)})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold width finite numbers, those rows as a matrix)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    whole = np.flatnonzero(n == width)
    flat = column.take(pa.array(whole)).flatten()
    made = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(whole), width)
    finite = np.isfinite(made).all(axis=1)
    return whole[finite], made[finite]


class Best:
    """The k best rows of some queries of one width, as rows stream by.

    The rows of a step are grouped by pivots, each row with the pivot nearest to it. A row's product with a query is at most
    the pivot's product plus the query's length times the row's distance from the pivot, at most the group's radius: groups
    for which that is less than a query's k-th score so far aren't multiplied with it.
    """

    def __init__(self, qids: np.ndarray, asked: np.ndarray, k: int) -> None:
        self.qids, self.asked, self.k = qids, asked, k
        self.lengths = np.linalg.norm(asked, axis=1)
        self.held = [(np.zeros(0, np.int64), np.zeros(0)) for _ in qids]
        self.least = np.full(len(qids), -np.inf)
        self.met = self.multiplied = 0  # pairs of rows and queries, and those that were worked out

    def add(self, rids: np.ndarray, rows: np.ndarray) -> None:
        pivots = rows[:: max(1, int(np.sqrt(len(rows))))]
        squares = (rows**2).sum(axis=1)[:, None] - 2 * rows @ pivots.T + (pivots**2).sum(axis=1)
        group = squares.argmin(axis=1)
        away = np.linalg.norm(rows - pivots[group], axis=1)
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(len(pivots) + 1))
        full = np.flatnonzero(np.diff(ends))
        radius = np.maximum.reduceat(away[order], ends[full])
        bound = self.asked @ pivots[full].T + self.lengths[:, None] * radius
        for g in np.argsort(-bound.max(axis=0), kind="stable").tolist():
            some = order[ends[full[g]] : ends[full[g] + 1]]
            able = np.flatnonzero(bound[:, g] + 1e-8 >= self.least)
            self.met += len(some) * len(self.qids)
            self.multiplied += len(some) * len(able)
            scores = self.asked[able] @ rows[some].T
            for i, s in zip(able.tolist(), scores, strict=True):
                kept = np.flatnonzero(s + 1e-8 >= self.least[i])
                if len(kept):
                    ids, found = np.concatenate([self.held[i][0], rids[some[kept]]]), np.concatenate([self.held[i][1], s[kept]])
                    first = np.lexsort((ids, -np.round(found, 9)))[: self.k]
                    self.held[i] = ids[first], found[first]
                    if len(first) == self.k:
                        self.least[i] = found[first].min()

    def batch(self) -> pa.RecordBatch:
        n = [len(ids) for ids, _ in self.held]
        columns = [np.repeat(self.qids, n), np.concatenate([ids for ids, _ in self.held] or [np.zeros(0, np.int64)]), np.concatenate([s for _, s in self.held] or [np.zeros(0)])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["qid", "rid", "score"])


def near(queries: pa.Table, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(qid, rid, score) of the k best of these rows for each query; queries and rows of one width meet."""
    widths = sorted({int(n) for n in pc.list_value_length(queries.column("embedding")).drop_null().to_pylist() if n})
    qids, best = np.asarray(queries.column("qid"), dtype=np.int64), {}
    for width in widths:
        rows, asked = matrix(queries.column("embedding"), width)
        best[width] = Best(qids[rows], asked, k)
    for batch in batches:
        for width, held in best.items():
            step = max(1, STEP_CELLS // width)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows, made = matrix(part.column("embedding"), width)
                if len(rows):
                    held.add(np.asarray(part.column("rid"), dtype=np.int64)[rows], made)
    for held in best.values():
        yield held.batch()


def nearest(vectors: DataFrame, queries: DataFrame, k: int, most_queries: int | None = None) -> DataFrame:
    """(qid, rid, score, rank) of the k rows of (rid, embedding) with the largest products with each query (qid, embedding).

    Vectors stream past the queries, which beside() broadcasts or deals into blocks by their checked size; a query is ranked
    for itself, so results don't depend on blocks. Vectors that are null, empty or hold a null or a number that isn't finite
    take no part. With most_queries, a larger set is an error.
    """
    if most_queries is not None and queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    rows = vectors.select(F.col("rid").cast("long").alias("rid"), "embedding")
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "embedding").where("embedding IS NOT NULL")
    return top(beside(rows, asked, 8 * F.size("embedding") + 16, lambda q, batches: near(q, batches, k), "qid long, rid long, score double"), k)
