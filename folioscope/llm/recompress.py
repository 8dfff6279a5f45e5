"""Substring deduplication by recompression.

Rounds of recompression give equal passages equal names: runs of one symbol become a symbol, then each symbol is thrown to
the left or right by its name, and a left symbol followed by a right one becomes a pair. A name is a fingerprint of what it
stands for, so it is global at once: all tasks name equal things equally, and equal substrings get the same symbols inside.

- Symbols of the higher rounds stand for LONG words or more. Dealt by name, one that several documents share reveals a long
  repeat: the words under it are equal (a second fingerprint of other word names must agree), so all windows under it are
  settled in every document but the smallest, however long the passage is.
- What such symbols leave, the edges of repeats and short ones, is found through symbols of the first rounds. Of each it is
  known which words decide it (its own and those of the neighbours that were looked at): wherever these words stand, the
  symbol stands. A window of 13 words is filed under one symbol that is decided within it, so windows with equal words are
  under the same symbol; symbols that occur in one document rule out their windows, and those under shared ones are compared
  by two independent fingerprints of their words, 96 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import BASES, Dealer, Sequences, cut, drop, mix, owners, quoted, slices, table, targets_of, undealt, word_lists, word_names

WINDOW = 13
#: Rounds whose symbols' deciding words are known, and all rounds.
ROUNDS, MOST_ROUNDS = 3, 20
#: Symbols decided by so many words are anchors; a window without one is its own.
ANCHOR = (6, 10)
#: Words under a symbol that settles windows, at least.
LONG = 24
K1, K2, K3 = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def joined_runs(name: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first, count): each run of equal symbols of one text as a symbol."""
    first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (own[1:] != own[:-1])]))
    count = np.diff(np.append(first, len(name)))
    with np.errstate(over="ignore"):
        return np.where(count > 1, mix(name[first] * K1 + count.astype(np.uint64)), name[first]), first, count


def joined_pairs(name: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, heads, coin, near) of round k: heads are left symbols before a right one and bear the pair's name, coin says left, near that a symbol of the text follows."""
    with np.errstate(over="ignore"):
        coin = mix(name + K2 * np.uint64(k + 1)) >> np.uint64(63) > 0
        near = np.append(own[1:] == own[:-1], False)
        heads = np.append(coin[:-1] & ~coin[1:], False) & near
        nxt = np.minimum(np.arange(len(name)) + 1, len(name) - 1)
        return np.where(heads, mix(mix(name * K1) + name[nxt] * K3), name), heads, coin, near


def recompress(h: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """After each round (round, name, lo, hi, start, new) of its symbols.

    Words lo to hi (exclusive) decide the symbol; beyond a text's ends, lo and hi lie far outside, and after ROUNDS rounds
    they aren't followed any more. The symbol stands for the words from start to the next one's start; new: it was made in
    this round.
    """
    n = len(h)
    far = 1 << 40
    name, start = h, np.arange(n)
    lo, hi = np.arange(n), np.arange(1, n + 1)
    for k in range(MOST_ROUNDS):
        if not len(name):
            return
        runs, at, count = joined_runs(name, own)
        if k < ROUNDS:
            # a symbol's end is known once its neighbours are
            last = at + count - 1
            left = np.where((at > 0) & (own[at] == own[at - 1]), lo[at - 1], lo[at] - far)
            after = np.minimum(last + 1, len(name) - 1)
            right = np.where((last + 1 < len(name)) & (own[after] == own[at]), hi[after], hi[last] + far)
            lo, hi = left, right
        name, own, start = runs, own[at], start[at]
        paired, heads, coin, near = joined_pairs(name, own, k)
        tails = np.concatenate([[False], heads[:-1]])
        if k < ROUNDS:
            before = np.concatenate([[False], near[:-1]])
            nxt, prv = np.minimum(np.arange(len(name)) + 1, len(name) - 1), np.maximum(np.arange(len(name)) - 1, 0)
            # an unpaired left symbol has looked at the next one, an unpaired right symbol at the one before
            new_hi = np.where(heads, hi[nxt], np.where(coin, np.where(near, hi[nxt], hi + far), hi))
            new_lo = np.where(heads | coin, lo, np.where(before, lo[prv], lo - far))
            lo, hi = new_lo[~tails], new_hi[~tails]
        new = (heads | (count > 1))[~tails]
        name, own, start = paired[~tails], own[~tails], start[~tails]
        yield k, name, lo, hi, start, new


def slide(x: np.ndarray, width: int) -> np.ndarray:
    """The largest of the width values from each place on."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.maximum(x[:-step], x[step:])
        done += step
    return x


def filed(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, key) of each window that lies in one text, key naming the symbol it is filed under, and (name, start, words) of the long symbols."""
    n = len(h) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    inside = np.flatnonzero(own[:n] == own[WINDOW - 1 :])
    best, long, line_names = np.zeros(n, np.uint64), [], Sequences(h)
    for k, name, lo, hi, start, new in recompress(h, own):
        words = np.diff(np.append(start, len(h)))
        some = np.flatnonzero(new & (words >= LONG))
        long.append((name[some], start[some], words[some]))
        if k >= ROUNDS:
            continue
        for d in range(ANCHOR[0], ANCHOR[1] + 1):
            some = (hi - lo == d) & (lo >= 0)
            if some.any():
                line = np.zeros(len(h), np.uint64)
                a = lo[some]
                # a symbol with the words that decide it
                np.maximum.at(line, a, mix(line_names.names(a, d) ^ name[some]))
                best = np.maximum(best, slide(line, WINDOW - d + 1)[:n])
    best = best[inside]
    lone = np.flatnonzero(best == 0)
    best[lone] = line_names.names(inside[lone], WINDOW)
    return inside, best, *(np.concatenate(x) for x in zip(*long, strict=True))


SYMBOLS = [("key", "<u8"), ("more", "<u4"), ("doc", "<i8"), ("at", "<i4"), ("n", "<i4")]
WINDOWS = [("key", "<u8"), ("more", "<u4"), ("owner", "<i8"), ("at", "<i4")]
SPANS = [("owner", "<i8"), ("at", "<i4"), ("n", "<i4")]
#: Documents, about, that show which symbols and windows are hot: those that so many of them have. The sample only decides
#: on which way hot ones take; every row takes part either way.
SAMPLE, HOT = 8000, 20
#: Groups of copies with more than this share of all documents are known to every task.
HEAVY = 1e-4


def upper(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32)


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, second key, first window, windows) of each stretch of windows that are filed under one symbol, and, with negative numbers of windows, of each long symbol. Windows are counted within their text."""
    bounds, h, second = word_names(texts, two=True)
    own = owners(bounds)
    at, key, long, start, n = filed(h, own)
    if not len(at):
        return at, key, upper(key), at, at
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    more = upper(Sequences(second, BASES[1]).names(start, n))
    at, counts = np.concatenate([at[first], start]), np.concatenate([np.diff(np.append(first, len(key))), WINDOW - 1 - n])
    who = own[at]
    return who, np.concatenate([key[first], long]), np.concatenate([np.zeros(len(first), np.uint32), more]), at - bounds[who], counts


def windows(texts: pa.Array, wanted: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, name, second name, place) of each text's windows: of all, or of wanted ones by text (pairs of first window and number, less those of pairs with a negative number)."""
    bounds, h, second = word_names(texts, two=True)
    n = np.diff(bounds)
    if wanted is None:
        wanted = [np.array([[0, max(0, x - WINDOW + 1)]]) for x in n]
    pairs = np.concatenate([*wanted, np.zeros((0, 2), np.int64)]).astype(np.int64)
    first = pairs[:, 0] + np.repeat(bounds[:-1], [len(w) for w in wanted])
    depth = np.zeros((2, len(h) + 1), np.int64)
    for row, some in enumerate((pairs[:, 1] > 0, pairs[:, 1] < 0)):
        np.add.at(depth[row], first[some], 1)
        np.add.at(depth[row], first[some] + np.abs(pairs[some, 1]), -1)
    depth = np.cumsum(depth, axis=1)[:, :-1]
    places = np.flatnonzero((depth[0] > 0) & (depth[1] == 0))
    who = np.searchsorted(bounds, places, side="right") - 1
    return who, Sequences(h).names(places, WINDOW), upper(Sequences(second, BASES[1]).names(places, WINDOW)), places - bounds[who]


def hot_names(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names of the symbols and of the windows that HOT documents of a sample have."""
    every = max(1, total // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own, key, _, _, _ = symbols(part.column("text"))
                who, name, _, _ = windows(part.column("text"))
                for kind, o, k in ((0, own, key), (1, who, name)):
                    order = np.lexsort((k, o))
                    o, k = o[order], k[order]
                    one = k[np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])])] if len(k) else k
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), kind, np.int32)), pa.array(one.view(np.int64))], ["kind", "name"])

    named = some.mapInArrow(run, "kind int, name long").groupBy("kind", "name").count()
    # of a bounded number of documents, bounded many names can be in HOT of them
    found = named.where(F.col("count") > HOT).select("kind", "name").collect()
    return tuple(np.sort(np.array([r.name for r in found if r.kind == k], dtype=np.int64).view(np.uint64)) for k in (0, 1))


def among(x: np.ndarray, names: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(x), bool)
    at = np.searchsorted(names, x)
    at[at == len(names)] = 0
    return names[at] == x


def by_document(packed: DataFrame, kinds: list[tuple[str, str]], tasks: int) -> DataFrame:
    """(doc, places): each document once, with its records (but the owner) as 32-bit numbers side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, *columns in undealt(batches, kinds):
            order = np.argsort(doc, kind="stable")
            doc = doc[order]
            rows = np.stack([c[order] for c in columns], axis=1).astype("<i4")
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            places = [rows[a:b].tobytes() for a, b in zip(first, [*first[1:], len(doc)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(places, pa.binary())], ["doc", "places"])

    return packed.repartition(tasks, "pid").sortWithinPartitions("pid").mapInArrow(run, "doc long, places binary")


def target(doc: np.ndarray, targets: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(targets)).astype(np.int32)


def deal_symbols(rows: DataFrame, hot: np.ndarray, targets: int) -> DataFrame:
    """Packed symbols of all documents. Hot ones are known to be shared; they go to negative targets of any kind."""
    known = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(SYMBOLS, targets, spread=True)
        for batch in batches:
            for part in slices(batch):
                own, key, more, at, n = symbols(part.column("text"))
                doc = np.asarray(part.column("doc_id"))[own]
                pid = (key % np.uint64(targets)).astype(np.int32)
                pid[among(key, known.value)] = -1
                yield from dealer.add(pid, key, more, doc, at, n)
        yield from dealer.flush()

    return rows.mapInArrow(run, Dealer.schema(SYMBOLS))


def shared(packed: DataFrame, tasks: int, targets: int) -> DataFrame:
    """Packed pairs of first window and number, dealt by document: of the windows filed under a symbol that several documents have, and with negative numbers (kind 1) of those settled by a long symbol that a smaller document has. Hot long symbols settle nothing, their windows are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealers = Dealer(SPANS, targets), Dealer(SPANS, targets)

        def kind(k: int, made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in made:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, k, np.int32)), *batch.columns], ["kind", *batch.schema.names])

        for pid, (key, more, doc, at, n) in undealt(batches, SYMBOLS, with_pid=True):
            if pid < 0:
                keep, settled = n > 0, np.zeros(len(n), bool)
            else:
                order = np.lexsort((more, key))
                key, more, doc, at, n = key[order], more[order], doc[order], at[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])]))
                count = np.diff(np.append(first, len(key)))
                least, most = np.repeat(np.minimum.reduceat(doc, first), count), np.repeat(np.maximum.reduceat(doc, first), count)
                keep, settled = (n > 0) & (least < most), (n < 0) & (doc > least)
            for k, some in enumerate((keep, settled)):
                yield from kind(k, dealers[k].add(target(doc[some], targets), doc[some], at[some], n[some]))
        for k in (0, 1):
            yield from kind(k, dealers[k].flush())

    return packed.repartition(tasks, "pid").sortWithinPartitions("pid").mapInArrow(run, f"kind int, {Dealer.schema(SPANS)}")


def deal_windows(rows: DataFrame, found: DataFrame, hot: np.ndarray, targets: int) -> DataFrame:
    """Packed windows of the spans found in each document, but settled ones; hot ones under negative targets, by the task that read them."""
    known = rows.sparkSession.sparkContext.broadcast(hot)
    joined = rows.join(found, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(WINDOWS, targets, spread=True)
        for batch in batches:
            for part in slices(batch):
                wanted = [np.frombuffer(x, "<i4").reshape(-1, 2) for x in part.column("places").to_pylist()]
                who, key, more, at = windows(part.column("text"), wanted)
                doc = np.asarray(part.column("doc_id"))[who]
                pid = (key % np.uint64(targets)).astype(np.int32)
                pid[among(key, known.value)] = -1
                yield from dealer.add(pid, key, more, doc, at)
        yield from dealer.flush()

    return joined.mapInArrow(run, Dealer.schema(WINDOWS))


def repeats(packed: DataFrame, tasks: int, targets: int, last: bool = False) -> DataFrame:
    """Packed records of two kinds: 0, a document's window that begins in a smaller document, too; 1, a hot window of the smallest document in one negative target, still to be held against the other targets' (last: none is left)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rest = Dealer(SPANS, targets), Dealer(WINDOWS, targets)

        def kind(k: int, made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in made:
                none = pa.nulls(batch.num_rows, pa.binary())
                names = ["pid", "rows", *(n for n, _ in WINDOWS), "n"]
                columns = [batch.column(n) if n in batch.schema.names else none for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, k, np.int32)), *columns], ["kind", *names])

        for pid, (key, more, doc, at) in undealt(batches, WINDOWS, with_pid=True):
            order = np.lexsort((doc, more, key))
            key, more, doc, at = key[order], more[order], doc[order], at[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])])
            later = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            yield from kind(0, found.add(target(doc[later], targets), doc[later], at[later], np.full(later.sum(), -1)))
            if pid < 0 and not last:
                own = ~later
                yield from kind(1, rest.add((key[own] % np.uint64(targets)).astype(np.int32), key[own], more[own], doc[own], at[own]))
        yield from kind(0, found.flush())
        yield from kind(1, rest.flush())

    return packed.repartition(tasks, "pid").sortWithinPartitions("pid").mapInArrow(run, f"kind int, {Dealer.schema(WINDOWS)}, n binary")


def covered(docs: DataFrame) -> DataFrame:
    """(doc, places): for each document with repeated windows, pairs of the first window and the number of windows, negative; docs: doc_id, text."""
    spark = docs.sparkSession
    tasks, targets = targets_of(spark)
    total = docs.count()
    hot_symbols, hot_windows = hot_names(docs, total)
    spans = cut(shared(deal_symbols(docs, hot_symbols, targets), tasks, targets), "shared")
    found = by_document(spans.drop("kind"), SPANS, tasks)
    records = cut(repeats(deal_windows(docs, found, hot_windows, targets), tasks, targets), "repeats")
    late = repeats(records.where("kind = 1").drop("kind", "n"), tasks, targets, last=True)
    places = records.where("kind = 0").unionByName(late).select("pid", "rows", "owner", "at", "n")
    out = cut(by_document(places.unionByName(spans.where("kind = 1").drop("kind")), SPANS, tasks), "places")
    drop(spans, records)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept): each row's words but those in windows that also start in a document with a smaller id; kept words are joined by one space.

    Null and empty texts have no words and keep an empty text; texts under 13 words lose nothing. Rows that repeat an id are one
    document in several pieces: they don't remove each other's words. Rows with a null id lose nothing and remove nothing.
    Copies of a text that many documents share are known by their digest: all but the smallest lose every window, so only
    that one takes part in the search. Texts of any length are taken whole. With keep, those columns and the text come
    along as a struct `row`, whatever their names are.
    """
    spark = docs.sparkSession
    digest = F.md5("text")
    row = [F.struct(F.col(text_col), *[quoted(c) for c in keep]).alias("row")] if keep is not None else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row)
    sizes = cut(rows.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 50"), "copies")
    total = rows.count()
    heavy = F.broadcast(sizes.where(F.col("n") > HEAVY * total).select("digest", "first"))  # fewer than 1 / HEAVY rows
    marked = rows.join(heavy, digest == F.col("digest"), "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("digest", "first")
    places = covered(marked.where("NOT copy AND doc_id IS NOT NULL").select("doc_id", "text"))
    joined = marked.join(places, F.col("doc_id") == F.col("doc"), "left").drop("doc")
    carried = ["row"] if row else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                bounds, words = word_lists(part.column("text"))
                n, gone = np.diff(bounds), np.zeros(len(words) + 1, np.int64)
                spans = [np.array([[0, min(0, WINDOW - 1 - n[i])]]) if copy else np.frombuffer(found or b"", "<i4").reshape(-1, 2) for i, (copy, found) in enumerate(zip(part.column("copy").to_pylist(), part.column("places").to_pylist(), strict=True))]
                first = np.concatenate(spans)[:, 0] + np.repeat(bounds[:-1], [len(x) for x in spans])
                count = np.concatenate(spans)[:, 1]
                first, count = first[count < 0], count[count < 0]
                np.add.at(gone, first, 1)
                np.add.at(gone, first - count + WINDOW - 1, -1)
                left = np.cumsum(gone)[:-1] == 0
                ends = np.concatenate([[0], np.cumsum(left)])[bounds]
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words if left.all() else words.filter(pa.array(left))), " ")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(n - np.diff(ends)), kept, *(part.column(c) for c in carried)], ["doc_id", "n_words", "n_removed", "kept", *carried])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), *(joined.schema[c] for c in carried)])
    return joined.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps."""
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
