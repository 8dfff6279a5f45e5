"""Packing token sequences into windows by minimum bin slack.

A document longer than a window is cut into full windows and a rest. What is left to pack is a multiset of lengths
below the window. Its counts (one for each length, however many documents there are) go to the driver, which fills one
window after another: the longest length left goes in, then a bitset subset-sum picks the multiset of lengths that
comes closest to the window, and the pattern found is repeated as often as the counts last. Documents take their places
in the patterns by their rank in their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import zlib

from folioscope.llm.common import cut, ranked, table
from folioscope.llm.tokens import END_ID, token_batches, vocabulary

WINDOW = 4096


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the available lengths (length: count) whose sum is closest to room and not above it.

    Bit s of `reach` says that some choice of the lengths seen so far sums to s; the states between lengths serve to walk
    back from the best sum. Long lengths come first, so that few pieces fill a window. Copies of a length are added in
    doubling bundles, which gives every count up to the number of copies.
    """
    mask, reach, states = (1 << room + 1) - 1, 1, []
    for n in sorted((n for n in counts if n <= room), reverse=True):
        left, bundle = min(counts[n], room // n), 1
        while left > 0:
            k = min(bundle, left)
            grown = reach | reach << n * k & mask
            if grown != reach:
                states.append((n, k, reach))
                reach = grown
            left, bundle = left - k, bundle * 2
        if reach >> room & 1:
            break
    at, picked = reach.bit_length() - 1, {}
    for n, k, before in reversed(states):
        if not before >> at & 1:
            picked[n] = picked.get(n, 0) + k
            at -= n * k
    return picked


def patterns(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(lengths in a window, windows filled like it) until no length is left."""
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = best_fill({n: c for n, c in left.items() if c > 0}, window - longest)
        left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[n] // k for n, k in fill.items())
        for n, k in fill.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((fill, times))
    return out


def places(counts: dict[int, int], window: int = WINDOW) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces in a window, offset of the first): ranks from there on belong to these windows."""
    out: dict[int, list] = {n: [] for n in counts}
    used, first = dict.fromkeys(counts, 0), 0
    for fill, times in patterns(counts, window):
        at = 0
        for n in sorted(fill, reverse=True):
            out[n].append((used[n], first, fill[n], at))
            used[n] += fill[n] * times
            at += n * fill[n]
        first += times
    return {n: np.array(rows, dtype=np.int64).reshape(-1, 4) for n, rows in out.items()}


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids (null text: only the end id) cut into full windows and a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = [x.split()[0] for x in PIECES.split(", ")], []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
            rows.clear()
            return batch

        for doc, ids in token_batches(batches, tokenizer_path, end_id):
            for a in range(0, len(ids), window):
                some = ids[a : a + window]
                rows.append((doc, a, len(some), zlib.crc32(some.tobytes()), len(ids)))
            if len(rows) >= 10_000:
                yield made()
        if rows:
            yield made()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def pack(cuts: DataFrame, window: int = WINDOW) -> DataFrame:
    """cuts (a table with length from 1 to window) with sequence_id and offset.

    The driver sees a count for each length, at most `window` numbers, and sends back the patterns, whose number depends
    on the lengths and not on the documents.
    """
    counts = {int(n): int(c) for n, c in cuts.groupBy("length").count().collect()}
    plan = cuts.sparkSession.sparkContext.broadcast(places(counts, window))
    ranks = ranked(cuts, ["length"], ["doc_id", "start", "ids_crc32"], "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for n in np.unique(lengths):
                own = lengths == n
                rows = plan.value[int(n)]
                row = rows[np.searchsorted(rows[:, 0], ranks[own], side="right") - 1]
                k = ranks[own] - row[:, 0]
                sequence[own] = row[:, 1] + k // row[:, 2]
                offset[own] = row[:, 3] + k % row[:, 2] * n
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return ranks.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def op5_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens. An empty table gives an empty result; repeated rows are packed each."""
    return pack(cut(pieces(table(spark, sf_dir, "documents"), vocabulary()), "pieces"))
