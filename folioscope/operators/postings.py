"""Postings in blocks: a row for each term and span of row ids, with the most that the term can add to a row there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope import shared
from folioscope.functions.text import tokens_each

#: Row ids of a span.
SPAN = 128
#: Places of a field; a row's places are numbered field by field.
FIELD = 1 << 32
BLOCKS = "term string, span long, n long, max_tf long, min_dl long, rids array<long>, tfs array<long>, dls array<long>, ats array<array<long>>"
#: Bytes of texts that a task makes blocks of and sorts. A bound on its memory: blocks are some twenty times as large there.
PART_BYTES = 16 << 20
#: In what blocks_of() makes: the term that lists all rows of a span with their lengths. No text has it.
EVERY = ""
#: Row groups are small, so that a term's blocks are few of them; whole numbers are stored as differences.
STORED = {"parquet.block.size": str(8 << 20), "parquet.writer.version": "v2"}


def blocks(places: DataFrame, fields: list[str]) -> DataFrame:
    """(term, span, n, max_tf, min_dl, rids, tfs, dls, ats) of places (rid, dl, field, pos, term): a block's rows in order, ats the term's places in each.

    max_tf and min_dl bound what the term adds to a row of the block, whatever the statistics are.
    """
    number = F.array_position(F.array(*map(F.lit, fields)), F.col("field")) * FIELD + F.col("pos")
    dealt = places.select("term", F.floor(F.col("rid") / SPAN).alias("span"), "rid", "dl", number.alias("place")).repartition("term", "span")
    rows = dealt.groupBy("term", "span", "rid", "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("place")).alias("at"))
    made = rows.groupBy("term", "span").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.array_sort(F.collect_list(F.struct("rid", "tf", "dl", "at"))).alias("r"))
    return made.select("term", "span", "n", "max_tf", "min_dl", F.col("r.rid").alias("rids"), F.col("r.tf").alias("tfs"), F.col("r.dl").alias("dls"), F.col("r.at").alias("ats"))


def blocks_of(rows: DataFrame, fields: list[str]) -> DataFrame:
    """blocks() of the texts of rows (rid, fields), and a block EVERY for each span: all its rows and their lengths, also of rows without a word.

    Rows are dealt by span before their words are split, and a span has no more than SPAN rows, as rids are unique. So a task
    holds one span's words at a time, and neither a word nor a place is shuffled. How many tasks there are follows from the
    texts' bytes, so that a task's blocks, which are sorted, are no more at any size. Null and missing fields have no words.
    """
    text = lambda f: F.coalesce(F.col(f), F.lit("")) if f in rows.columns else F.lit("")
    dealt = rows.select(F.floor(F.col("rid") / SPAN).alias("span"), F.col("rid").cast("long").alias("rid"), *[f for f in fields if f in rows.columns]).repartition(parts(rows, fields), "span").sortWithinPartitions("span", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            spans = np.asarray(batch.column("span"))
            starts = [0, *(np.flatnonzero(np.diff(spans)) + 1).tolist(), len(spans)]
            for at, to in zip(starts, starts[1:], strict=False):
                if held and to > at and spans[at] != held[0].column("span")[0].as_py():
                    yield of_span(pa.Table.from_batches(held), len(fields))
                    held = []
                if to > at:
                    held.append(batch.slice(at, to - at))
        if held:
            yield of_span(pa.Table.from_batches(held), len(fields))
        shared.let_go()

    return dealt.select("span", "rid", tokens_each(*map(text, fields)).alias("found")).mapInArrow(run, BLOCKS)


def parts(rows: DataFrame, fields: list[str]) -> int:
    """Tasks for the rows' texts: one for each PART_BYTES, but for as many as run at once."""
    size = sum((F.coalesce(F.octet_length(F.col(f).cast("string")).cast("long"), F.lit(0)) for f in fields if f in rows.columns), F.lit(0))
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return max(-(-int(total) // PART_BYTES), rows.sparkSession.sparkContext.defaultParallelism)


def of_span(rows: pa.Table, fields: int) -> pa.RecordBatch:
    """The blocks of one span's rows (span, rid, found: the words of each field), which are in order."""
    rids = np.asarray(rows.column("rid"), dtype=np.int64)
    lists = rows.column("found").combine_chunks().flatten()
    sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    words = lists.flatten().dictionary_encode()
    code = np.asarray(words.indices, dtype=np.int64)
    slot = np.repeat(np.arange(len(sizes)), sizes)
    place = (slot % fields + 1) * FIELD + np.arange(len(slot)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    dl = sizes.reshape(-1, fields).sum(axis=1)
    order = np.argsort(code, kind="stable")  # rows and places stay in order within a term
    code, row, place = code[order], slot[order] // fields, place[order]
    changes = lambda *keys: np.flatnonzero(np.concatenate([np.ones(min(len(keys[0]), 1), bool), np.any([np.diff(k) != 0 for k in keys], axis=0)]))
    pair = changes(code, row)
    tf = np.diff(np.append(pair, len(code)))
    term = changes(code[pair])
    of_row, n = row[pair], np.diff(np.append(term, len(pair)))
    ints = lambda first, rest: pa.array(np.concatenate([first, rest]).astype(np.int64))
    count, none = len(rids), np.zeros(len(rids), np.int64)
    ends = pa.array(np.concatenate([[0], count + np.append(term, len(pair))]).astype(np.int32))
    ats = pa.ListArray.from_arrays(pa.array(np.concatenate([none, np.append(pair, len(code))]).astype(np.int32)), pa.array(place.astype(np.int64)))
    columns = {
        "term": pa.concat_arrays([pa.array([EVERY]), words.dictionary.take(pa.array(code[pair][term])).cast(pa.string())]), "span": pa.array(np.full(len(n) + 1, rows.column("span")[0].as_py(), np.int64)), "n": ints([count], n),
        "max_tf": ints([0], np.maximum.reduceat(tf, term) if len(term) else []), "min_dl": ints([dl.min()], np.minimum.reduceat(dl[of_row], term) if len(term) else []),
        "rids": pa.ListArray.from_arrays(ends, ints(rids, rids[of_row])), "tfs": pa.ListArray.from_arrays(ends, ints(none, tf)), "dls": pa.ListArray.from_arrays(ends, ints(dl, dl[of_row])), "ats": pa.ListArray.from_arrays(ends, ats),
    }
    return pa.RecordBatch.from_pydict(columns)


def store(made: DataFrame, path: str, move: bool = True) -> DataFrame:
    """The blocks as a table sorted by term, over all its files or, without moving them, within each: named terms read few row groups of a file."""
    (made.repartitionByRange("term", "span") if move else made).sortWithinPartitions("term", "span").write.options(**STORED).parquet(path)
    return made.sparkSession.read.schema(made.schema).parquet(path)


def rows_of(made: DataFrame, with_places: bool = False) -> DataFrame:
    """(term, span, rid, tf, dl[, at]) of blocks."""
    columns = ["rids", "tfs", "dls", *(["ats"] if with_places else [])]
    out = made.select("term", "span", F.explode(F.arrays_zip(*columns)).alias("r"))
    return out.select("term", "span", *[F.col(f"r.{c}").alias(c[:-1]) for c in columns])


def runs(made: DataFrame, frequencies: DataFrame, parts: DataFrame) -> DataFrame:
    """(qid, phrase, n, rid, dl, at): where the phrases' terms stand one after the other; parts (qid, phrase, n, i, term).

    Each phrase's rarest term names the rows and places to look at. The other terms' blocks are read for the spans it stands
    in, and their places are looked up in its rows only.
    """
    known = parts.join(frequencies, "term")
    order = Window.partitionBy("qid", "phrase").orderBy("df", "i")
    ranked = known.withColumn("place", F.row_number().over(order)).withColumn("found", F.count("*").over(Window.partitionBy("qid", "phrase"))).where("found = n")  # a term that no row has ends its phrase
    rare = rows_of(made.join(ranked.select("term").where("place = 1").distinct(), "term", "left_semi"), with_places=True)
    starts = rare.join(ranked.where("place = 1").drop("df", "place", "found"), "term").select("qid", "phrase", "n", "span", "rid", "dl", F.explode("at").alias("p"), "i").withColumn("at", F.col("p") - F.col("i")).drop("p", "i")
    others = ranked.where("place > 1").select("qid", "phrase", "i", "term")
    looked = starts.join(others, ["qid", "phrase"])
    near = rows_of(made.join(looked.select("term", "span").distinct(), ["term", "span"], "left_semi"), with_places=True).select("term", "span", "rid", F.col("at").alias("places"))
    there = near.join(looked, ["term", "span", "rid"]).where(F.array_contains("places", F.col("at") + F.col("i"))).groupBy("qid", "phrase", "n", "rid", "dl", "at").agg(F.count("*").alias("got"))
    alone = starts.where("n = 1").select("qid", "phrase", "n", "rid", "dl", "at")
    return there.where("got = n - 1").select("qid", "phrase", "n", "rid", "dl", "at").unionByName(alone)
