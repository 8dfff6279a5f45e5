"""An exact n-gram Jaccard join by universe partitions and the pigeonhole principle.

A text's set holds its distinct word shingles as 64-bit names. Sets fall into bands by size, [2^k, 2^(k+1)). Within a
band all shingles are hashed to m segments. If 100 * |r & s| >= 80 * |r | s| and |r| <= |s|, the sets differ in at most
|r| / 4 shingles, so of any u + 1 credits, u = |r| // 4, one survives: a segment that is equal in both (one credit) or
that differs by one shingle (two credits, found by the segment itself and its one-deletion neighbours).

- Sets under 2^7 shingles are filed under all their segments and the segments' one-deletion neighbours: they have few
  segments, and there one shingle more or less costs few signatures. Larger sets use more segments and single credits.
- A set is filed in the bands that hold sets up to 5/4 of its size. Signatures that only one set has are dropped; a larger
  set whose other segments are too few for any partner (all filled ones less u) is dropped with all of them.
- A set that is left probes with as few segments as are sure to contain one that a partner shares. Which ones follows from
  their cost, the number of sets under them: the cheapest are taken, and segments of passages that many texts share are
  left out unless they are all that a text has.
- A larger set with so few filled segments that a partner may share none (chance fills them, so there is hardly ever one)
  is compared with every set's sketch.
- Sets under one signature are compared by odd sketches of a thousand bits, which differ at most as much as the sets do.
  Large buckets are dealt into cells of some thousand sets, so that no key is one task's work; of crowded ones, only what
  isn't in the largest component after that meets other cells. What may be linked makes clusters: every link lies within
  one.
- A cluster's whole sets meet in blocks of some megabytes, where each pair that sketches don't rule out and that isn't
  connected yet is verified exactly. Most clusters are one block. Of several blocks each is solved for itself, the largest
  components are joined by single members, and only sets outside the cluster's largest component are then held against
  the other blocks.

Copies are one set, known by 128 bits of its shingles' names. No stage emits the pairs of a group: only a row for each
document that names what it is connected to.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Dealer, components, cut, drop, mix, owners, slices, table, targets_of, undealt, word_names

WORDS = 5
#: Links have 100 * intersection >= LINK * union. The bounds below hold for this value.
LINK = 80
#: Bands of sets under 2^SMALL shingles use one-deletion neighbours.
SMALL = 7
#: Segments for each credit needed, over what the largest set of the band needs.
SLACK = 1.3
#: Groups of copies with more than this share of all documents are known to every task, so that only one copy is signed.
HEAVY = 1e-4
#: Bits of a set's sketch.
SKETCH = 1024
#: Sets of a bucket that are compared in one cell, about.
CELL = 2048
#: Cells of up to so many sets are compared all at once, larger ones set by set.
FEW = 24
#: Bytes of the sets that meet in one block, about, and the bytes that a set counts besides its shingles.
BLOCK, EACH = 8 << 20, 512
#: Components of a block that are joined to other blocks' by single members, and such members that meet at once, about.
TOP, MEET = 4, 4096
#: Places of the filter that finds wanted documents in a scan (a bit for each): a bound on what is broadcast.
PLACES = 1 << 22
#: `about` holds the mode (bit 31: small), the band (bits 26 to 30) and, of small sets, whether the signature probes, of
#: larger ones how many of a set's segments in the band a partner shares at least.
RECORD = [("sig", "<u8"), ("doc", "<i8"), ("size", "<i4"), ("about", "<u4")]
FOUND = [*RECORD, ("cost", "<u4")]
PROBES = [("sig", "<u8"), ("doc", "<i8"), ("size", "<i4")]
SEGMENT = np.uint64(0xA0761D6478BD642F)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, name) of each distinct shingle of each text, texts in order. With fewer than five words the whole sequence is one; without words there is none."""
    bounds, h = word_names(texts, lower=True)
    own, n = owners(bounds), np.diff(bounds)
    with np.errstate(over="ignore"):
        if len(h) >= WORDS:
            made = np.zeros(len(h) - WORDS + 1, np.uint64)
            for k in range(WORDS):
                made = mix(made * np.uint64(3) + h[k : k + len(made)])
            whole = own[: len(made)] == own[WORDS - 1 :]
            made, who = made[whole], own[: len(made)][whole]
        else:
            made, who = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        few = np.flatnonzero((n > 0) & (n < WORDS))
        if len(few):
            short = np.zeros(len(few), np.uint64)
            for k in range(WORDS - 1):
                has = n[few] > k
                short[has] = mix(short[has] * np.uint64(3) + h[bounds[few[has]] + k])
            short = mix(short ^ n[few].astype(np.uint64))
            made, who = np.concatenate([made, short]), np.concatenate([who, few])
            order = np.argsort(who, kind="stable")
            made, who = made[order], who[order]
    with np.errstate(over="ignore"):
        key = made + mix((who.astype(np.uint64) + np.uint64(1)) * SEGMENT)  # equal for equal shingles of one text
    order = np.argsort(key)
    again = order[1:][(key[order[1:]] == key[order[:-1]]) & (who[order[1:]] == who[order[:-1]])]
    first = np.ones(len(made), bool)
    first[again] = False
    return who[first], made[first]


def set_names(own: np.ndarray, names: np.ndarray, n: int) -> list[bytes]:
    """16 bytes for each text's whole set: two sums of its scrambled shingles, with the size."""
    ends = np.searchsorted(own, np.arange(n + 1))
    sums = []
    with np.errstate(over="ignore"):
        for seed in (SEGMENT, np.uint64(0xE7037ED1A0B428DB)):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(names ^ seed))])
            sums.append(mix(total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(np.uint64)))
    raw = np.stack(sums, axis=1).astype("<u8").tobytes()
    return [raw[i : i + 16] for i in range(0, 16 * n, 16)]


def segments(band: int, slack: float = SLACK) -> int:
    need = ((2 << band) - 1) // 4 + 1
    return int(np.ceil(SLACK * need / 2 if band < SMALL else slack * need))


def signatures(own: np.ndarray, names: np.ndarray, sizes: np.ndarray, band: int, doc: np.ndarray, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sig, owner, about) of the sets `doc` (sorted owners) in a band, and the sets whose partners may share none of their signatures."""
    m, small = segments(band, slack), band < SMALL
    at = np.searchsorted(doc, own)
    mine = (at < len(doc)) & (doc[np.minimum(at, len(doc) - 1)] == own)
    at, x = at[mine], mix(names[mine] + np.uint64(band))
    credits = sizes[doc] // 4 + 1
    with np.errstate(over="ignore"):
        cell = at * m + ((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        x = mix(x ^ SEGMENT)
        sums = np.zeros(len(doc) * m, np.uint64)
        np.add.at(sums, cell, x)
        counts = np.bincount(cell, minlength=len(sums))
        tags = np.tile(mix((np.arange(m, dtype=np.uint64) + np.uint64(1)) * SEGMENT + np.uint64(band)), len(doc))
        where = np.uint32(band << 26)
        if not small:
            cells = np.flatnonzero(counts)
            need = np.bincount(cells // m, minlength=len(doc)) - credits + 1
            about = where | np.clip(need, 1, (1 << 26) - 1).astype(np.uint32)
            return mix(sums[cells] + tags[cells]), doc[cells // m], about[cells // m], doc[need < 1]
        # credits in the order of the segments' sizes, until there are enough; empty segments give one where others don't suffice
        grid = counts.reshape(len(doc), m)
        credit = np.where(grid > 1, 2, grid)
        order = np.argsort(-grid, axis=1, kind="stable")
        worth = np.take_along_axis(credit, order, 1)
        chosen = np.zeros_like(grid, dtype=bool)
        np.put_along_axis(chosen, order, np.cumsum(worth, axis=1) - worth < credits[:, None], 1)
        chosen &= (grid > 0) | (credit.sum(axis=1) < credits)[:, None]
        chosen = chosen.ravel()
        some = counts[cell] > 1
        sig = np.concatenate([mix(sums + tags), mix(sums[cell[some]] - x[some] + tags[cell[some]])])
        who = np.concatenate([np.arange(len(sums)) // m, at[some]])
        probe = np.concatenate([chosen, chosen[cell[some]]])
    return sig, doc[who], np.uint32(1 << 31) | where | probe.astype(np.uint32), doc[:0]


def signed(own: np.ndarray, names: np.ndarray, sizes: np.ndarray, slack: float = SLACK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    full = np.flatnonzero(sizes)
    low = np.floor(np.log2(np.maximum(sizes[full], 1))).astype(int)
    high = np.floor(np.log2(np.maximum(sizes[full] + sizes[full] // 4, 1))).astype(int)
    for band in np.unique(np.concatenate([low, high])):
        doc = full[(low == band) | (high == band)]
        step = max(1, 200_000 // segments(int(band), slack))
        for a in range(0, len(doc), step):
            yield signatures(own, names, sizes, int(band), doc[a : a + step], slack)


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def odd_sketches(own: np.ndarray, names: np.ndarray, n: int, bits: int = SKETCH) -> np.ndarray:
    """For each text (of sorted owners) a row of bits, packed: whether an odd number of its shingles fall on each. Two sets' rows differ in no more bits than the sets differ in shingles."""
    bit = (mix(names ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(bits)).astype(np.int64)
    out, step = np.zeros((n, bits // 8), np.uint8), max(1, (1 << 19) // bits)
    for a in range(0, n, step):
        b = min(n, a + step)
        x, y = np.searchsorted(own, (a, b))
        odd = np.bincount((own[x:y] - a) * bits + bit[x:y], minlength=(b - a) * bits).reshape(b - a, bits) & 1
        out[a:b] = np.packbits(odd.astype(bool), axis=1)
    return out


def describe(rows: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, name, sketch) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own, names = shingles(part.column("text"))
                n = part.num_rows
                columns = [part.column("doc_id"), pa.array(np.bincount(own, minlength=n)), pa.array(set_names(own, names, n), pa.binary()), pa.array([x.tobytes() for x in odd_sketches(own, names, n)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "name", "sketch"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, name binary, sketch binary")


def deal_signatures(rows: DataFrame, heavy: dict[bytes, int], targets: int, slack: float = SLACK) -> DataFrame:
    """Packed signatures of all sets; of copies of a heavy set, only of the smallest id. Negative targets hold the sets whose partners may share none."""
    known = rows.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(RECORD, targets, spread=True)
        for batch in batches:
            for part in slices(batch):
                ids = np.asarray(part.column("doc_id"))
                own, names = shingles(part.column("text"))
                sizes = np.bincount(own, minlength=len(ids))
                if known.value:
                    whole = set_names(own, names, len(ids))
                    copy = np.array([known.value.get(w, d) != d for w, d in zip(whole, ids.tolist(), strict=True)])
                    names, own = names[~copy[own]], own[~copy[own]]
                    sizes[copy] = 0
                for sig, who, about, rest in signed(own, names, sizes, slack):
                    yield from dealer.add((sig % np.uint64(targets)).astype(np.int32), sig, ids[who], sizes[who], about)
                    if len(rest):
                        none = np.zeros(len(rest), np.uint64)
                        yield from dealer.add(np.full(len(rest), -1, np.int32), none, ids[rest], sizes[rest], none)
        yield from dealer.flush()

    return rows.where("doc_id IS NOT NULL").mapInArrow(run, Dealer.schema(RECORD))


def grouped(sig: np.ndarray, doc: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(records, group): one record of each set under each signature, of those with another set of 4/5 to 5/4 of its size beside it; records that are chains of such sizes share a group."""
    order = np.lexsort((doc, size, sig))
    s, d, n = sig[order], doc[order], size[order].astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    order, s, n = order[new], s[new], n[new]
    chain = np.zeros(len(s), bool)
    chain[1:] = (s[1:] == s[:-1]) & (n[:-1] * 5 >= n[1:] * 4)
    group = np.cumsum(~chain) - 1
    keep = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    return order[keep], group[keep]


def matched(packed: DataFrame, tasks: int, targets: int) -> DataFrame:
    """Packed records of signatures that several sets have, with their number as cost, dealt by document; negative targets as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(FOUND, targets, spread=True)
        for pid, (sig, doc, size, about) in undealt(batches, RECORD, with_pid=True):
            if pid < 0:
                yield from dealer.add(np.full(len(doc), -1, np.int32), sig, doc, size, about, about)
                continue
            if (about >> np.uint32(31)).any():  # of a set's equal signatures, a probe counts
                order = np.argsort(~about & np.uint32(1), kind="stable")
                sig, doc, size, about = sig[order], doc[order], size[order], about[order]
            rows, group = grouped(sig, doc, size)
            if len(rows):
                cost = np.bincount(group)[group]
                yield from dealer.add((mix(doc[rows].astype(np.uint64)) % np.uint64(targets)).astype(np.int32), sig[rows], doc[rows], size[rows], about[rows], cost)
        yield from dealer.flush()

    return packed.repartition(tasks, "pid").sortWithinPartitions("pid").mapInArrow(run, Dealer.schema(FOUND))


def probes(packed: DataFrame, tasks: int, targets: int) -> DataFrame:
    """Packed records (size * 2 + 1 where it probes) of the sets that may have a partner, dealt by signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(PROBES, targets)
        for sig, doc, size, about, cost in undealt(batches, FOUND):
            small = about >> np.uint32(31) > 0
            band = about >> np.uint32(26)
            order = np.lexsort((sig, cost, band, doc))
            sig, doc, size, about, band, small = sig[order], doc[order], size[order], about[order], band[order], small[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (band[1:] != band[:-1])
            group = np.cumsum(new) - 1
            count = np.bincount(group)[group]
            place = np.arange(len(doc)) - np.flatnonzero(new)[group]
            need = (about & np.uint32((1 << 26) - 1)).astype(np.int64)
            keep = small | (count >= need)
            probe = np.where(small, need, place <= count - need)
            yield from dealer.add((sig[keep] % np.uint64(targets)).astype(np.int32), sig[keep], doc[keep], size[keep].astype(np.int64) * 2 + probe[keep])
        yield from dealer.flush()

    return packed.repartition(tasks, "pid").sortWithinPartitions("pid").mapInArrow(run, Dealer.schema(PROBES))


def buckets(packed: DataFrame, tasks: int) -> DataFrame:
    """(bucket, doc, size, probe): the sets under each signature that at least one of them probes. Buckets with the same sets are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, doc, size in undealt(batches, PROBES):
            rows, group = grouped(sig, doc, size >> 1)
            doc, probe, size = doc[rows], size[rows] & 1, size[rows] >> 1
            keep = (np.bincount(group, probe) > 0)[group] if len(group) else np.zeros(0, bool)
            if not keep.any():
                continue
            group, doc, probe, size = np.unique(group[keep], return_inverse=True)[1], doc[keep], probe[keep], size[keep]
            with np.errstate(over="ignore"):
                bucket = np.zeros(group.max() + 1, np.uint64)
                np.add.at(bucket, group, mix(doc.astype(np.uint64) * np.uint64(2) + probe.astype(np.uint64) + SEGMENT))
                bucket = mix(bucket)
            one = np.zeros(len(bucket), bool)
            one[np.unique(bucket, return_index=True)[1]] = True
            keep = one[group]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[group[keep]].view(np.int64)), pa.array(doc[keep]), pa.array(size[keep].astype(np.int64)), pa.array(probe[keep].astype(np.int32))], ["bucket", "doc", "size", "probe"])

    return packed.repartition(tasks, "pid").sortWithinPartitions("pid").mapInArrow(run, "bucket long, doc long, size long, probe int")


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the links (a, b) connect it to."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def grid(asks: F.Column, answers: F.Column, down: F.Column, across: F.Column) -> F.Column:
    """The cells (cell, role) of a row of a bucket that is dealt into down times across cells: what asks goes to all cells of its row, what answers to all of its column."""
    column, row = F.pmod(F.xxhash64("doc"), across).cast("int"), F.pmod(F.xxhash64("doc"), down).cast("int")
    here = lambda i, j, role: F.struct((i * across + j).cast("int").alias("cell"), F.lit(role).alias("role"))
    answered = F.transform(F.sequence(F.lit(0), down - 1), lambda i: here(i, column, 0))
    asked = F.transform(F.sequence(F.lit(0), across - 1), lambda j: here(row, j, 1))
    none = F.array().cast("array<struct<cell int, role int>>")
    return F.concat(F.when(answers, answered).otherwise(none), F.when(asks, asked).otherwise(none))


def cells_of(n: str) -> F.Column:
    return F.ceil(F.col(n) / CELL).cast("int")


def clustered(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): links between sets of a bucket that size and sketch may allow, as far as they connect more; one of each pair probes.

    Buckets are dealt into cells, so many probing sets and so many others each. Of a bucket with few probing sets, those
    go to all cells. A bucket with many, such as one of near copies, is first dealt so that each set is in one cell; then
    only what that leaves outside the bucket's largest component meets the rest.
    """
    counts = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("probe").alias("p")).where("n > 1 AND p > 0")
    counts = cut(counts.select("bucket", cells_of("n").alias("across"), cells_of("p").alias("down"), (F.col("p") > CELL).alias("crowded")), "counts")
    members = members.join(counts, "bucket")
    probing, whole = F.col("probe") == 1, F.when(F.col("probe") == 1, 2).otherwise(0)
    own = F.pmod(F.xxhash64("doc"), F.col("across")).cast("int")
    alone = F.col("crowded") | (F.col("across") == 1)
    cells = F.when(alone, F.array(F.struct(own.alias("cell"), whole.alias("role")))).otherwise(grid(probing, F.lit(True), F.col("down"), F.col("across")))
    first = compared(members.join(sketches, "doc").withColumn("c", F.explode(cells)).select("bucket", "c.cell", "doc", "size", "c.role", "sketch"))
    if not counts.where("crowded").limit(1).count():
        return first
    return crowds(members.where("crowded"), sketches, cut(first, "first"))


def crowds(members: DataFrame, sketches: DataFrame, links: DataFrame) -> DataFrame:
    """links, and those that they lack between sets of buckets with many probing sets; members: bucket, doc, size, probe, across. Sketches go with those only that meet."""

    def labelled(links: DataFrame) -> DataFrame:
        roots = components(links)
        return members.join(roots, F.col("doc") == F.col("node"), "left").withColumn("label", F.coalesce("root", "doc")).drop("node", "root")

    # some members of each cell's largest components meet first; windows are over cells, which are of bounded size
    cell = F.pmod(F.xxhash64("doc"), F.col("across"))
    alike = Window.partitionBy("bucket", "cell", "label")
    known = labelled(links).withColumn("cell", cell).withColumn("n", F.count("*").over(alike)).withColumn("k", F.row_number().over(alike.orderBy("doc"))).where(F.col("k") <= TOP)
    large = known.withColumn("r", F.dense_rank().over(Window.partitionBy("bucket", "cell").orderBy(F.desc("n"), "label"))).where(F.col("r") <= TOP)
    part = F.pmod("cell", F.ceil(F.col("across") * TOP * TOP / MEET)).cast("int")
    meeting = large.join(sketches, "doc").select("bucket", part.alias("cell"), "doc", "size", F.lit(2).alias("role"), "sketch")
    links = cut(links.unionByName(compared(meeting)), "met")
    known = cut(labelled(links), "known")
    most = known.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    known = known.join(most, "bucket").withColumn("out", F.col("label") != F.col("most")).drop("most", "label")
    out, probing = F.col("out"), F.col("probe") == 1
    counts = known.groupBy("bucket").agg(F.count_if(out & probing).alias("asking"), F.count_if(~out & probing).alias("inner"), F.count_if(out & ~probing).alias("quiet"))
    known = known.join(counts.where("asking + quiet > 0"), "bucket")
    # probing sets outside meet all of the bucket; others outside meet the probing sets of the largest component
    outer = known.where("asking > 0").withColumn("c", F.explode(grid(out & probing, F.lit(True), cells_of("asking"), F.col("across"))))
    inner = known.where("inner > 0 AND quiet > 0").withColumn("c", F.explode(grid(~out & probing, out & ~probing, cells_of("inner"), cells_of("quiet"))))
    both = outer.select("bucket", "c.cell", "doc", "size", "c.role").unionByName(inner.select("bucket", (-1 - F.col("c.cell")).alias("cell"), "doc", "size", "c.role"))
    return links.unionByName(compared(both.join(sketches, "doc").select("bucket", "cell", "doc", "size", "role", "sketch")))


def compared(dealt: DataFrame) -> DataFrame:
    """(a, b): what connects the sets of each cell; dealt: bucket, cell, doc, size, role (0 answers, 1 asks, 2 both), sketch."""

    def may_link(size: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = size[i], size[j]
        out = np.minimum(x, y) * 5 >= np.maximum(x, y) * 4
        at = np.flatnonzero(out)
        out[at] = np.bitwise_count(words[i[at] if len(i) > 1 else i] ^ words[j[at]]).sum(axis=1, dtype=np.int64) * 9 <= (x + y)[at]
        return out

    def links(start: np.ndarray, doc: np.ndarray, size: np.ndarray, role: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        """start: where each cell begins."""
        counts = np.diff(np.append(start, len(doc)))
        a, b = [], []
        few = np.repeat(counts <= FEW, counts)
        cell = np.repeat(np.arange(len(start)), counts)
        for d in range(1, int(min(counts.max(), FEW))):
            i = np.flatnonzero(few[:-d] & (cell[:-d] == cell[d:]))
            i = i[(role[i] | role[i + d] > 0) & ~((role[i] == 1) & (role[i + d] == 1))]
            i = i[may_link(size, words, i, i + d)]
            a.append(i)
            b.append(i + d)
        for k in np.flatnonzero(counts > FEW):
            own = np.arange(start[k], start[k] + counts[k])
            others = own[role[own] != 1]
            for i in own[role[own] > 0]:
                near = others[may_link(size, words, np.array([i]), others)]
                a.append(np.full(len(near), i))
                b.append(near)
        ids, at = np.unique(doc, return_inverse=True)
        label = connected(len(ids), at[np.concatenate([*a, np.zeros(0, int)])], at[np.concatenate([*b, np.zeros(0, int)])])
        some = label != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label[some]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                rows = [np.asarray(batch.column(c)) for c in ("bucket", "cell", "doc", "size", "role")]
                rows.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(rows[0]), -1))
                held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if held is None or not len(held[0]):
                continue
            bucket, cell, *rest = held
            start = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])]))
            end = len(bucket)
            if batch is not None:  # the last cell may go on
                end, start = start[-1], start[:-1]
            held = [x[end:] for x in held]
            if end:
                yield links(start, *(x[:end] for x in rest))

    return dealt.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(run, "a long, b long").distinct()


def place(doc) -> F.Column:
    return F.pmod(F.xxhash64(doc), F.lit(PLACES)).cast("int")


def sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc, name, ...) with items: the sorted shingle names of the document's set.

    A filter of a fixed number of bits, one for each place of a wanted document, goes to the scan of the texts, so that
    few others are shuffled. A full filter lets all pass: the join decides.
    """
    word = F.shiftright(place(F.col("doc")), 5)
    bits = wanted.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place(F.col("doc")) % 32)).alias("b")).collect()  # PLACES / 32 rows at most
    table = np.zeros(PLACES // 32, np.int64)
    table[[r.w for r in bits]] = [r.b for r in bits]
    known = rows.sparkSession.sparkContext.broadcast(table.astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("place"))
            batch = batch.filter(pa.array(known.value[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1) > 0))
            for part in slices(batch):
                own, names = shingles(part.column("text"))
                ends = np.searchsorted(own, np.arange(part.num_rows + 1))
                items = [np.sort(names[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(set_names(own, names, part.num_rows), pa.binary()), pa.array(items, pa.binary())], ["doc", "name", "items"])

    found = rows.where("doc_id IS NOT NULL").withColumn("place", place(F.col("doc_id"))).mapInArrow(run, "doc long, name binary, items binary")
    return found.join(wanted, ["doc", "name"])


def unite(items: list[np.ndarray], label: np.ndarray, asks: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """The labels of sorted sets once all links between asking and answering ones are known: of two labels that a link joins, the smaller counts. Pairs that have the same label aren't compared."""
    label, n = label.copy(), np.array([len(x) for x in items], dtype=np.int64)
    bits = 64
    while bits < 8 * n.max() and len(items) * bits < 1 << 27:
        bits *= 2
    sketch = odd_sketches(np.repeat(np.arange(len(items)), n), np.concatenate(items), len(items), bits).view(np.uint64)
    both_ways = asks & answers
    for i in np.flatnonzero(asks):
        fits = answers & (label != label[i]) & (np.minimum(n, n[i]) * 5 >= np.maximum(n, n[i]) * 4)
        if both_ways[i]:
            fits[:i] &= ~both_ways[:i]  # those have been compared
        at = np.flatnonzero(fits)
        at = at[np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1, dtype=np.int64) * 9 <= n[at] + n[i]]
        if not len(at):
            continue
        every = np.concatenate([items[j] for j in at])
        place = np.searchsorted(items[i], every)
        place[place == n[i]] = 0
        both = np.add.reduceat(items[i][place] == every, np.concatenate([[0], np.cumsum(n[at])[:-1]]), dtype=np.int64)
        linked = label[at[100 * both >= LINK * (n[i] + n[at] - both)]]
        if len(linked):
            linked = np.append(linked, label[i])
            label[np.isin(label, linked)] = linked.min()
    return label


def met(rows: DataFrame, keys: list[str], solve, schema: str) -> DataFrame:
    """What solve (a group's key and columns doc, items and others as lists) returns for the rows (keys, doc, items, ...) of each group of keys, one after the other; groups are of bounded size."""
    columns = [c for c in rows.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in chain(batches, [None]):
            if batch is None:
                if held:
                    yield solve(key, held)
                return
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            start = 0
            for i in range(1, len(own) + 1):
                if i < len(own) and own[i] == own[start]:
                    continue
                if held and key != own[start]:
                    yield solve(key, held)
                    held = None
                key, held = own[start], held or {c: [] for c in columns}
                for c in columns:
                    held[c] += batch.column(c).slice(start, i - start).to_pylist()
                start = i

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def arrays(items: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in items]


def solved(sets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, doc, root: each set of (keys, doc, items) with the smallest one that it is connected to within its group of keys."""

    def solve(key: tuple, held: dict[str, list]) -> pa.RecordBatch:
        doc, first = np.unique(np.array(held["doc"], dtype=np.int64), return_index=True)
        every = np.ones(len(doc), bool)
        root = doc[unite([np.frombuffer(held["items"][i], "<u8") for i in first], np.arange(len(doc)), every, every)]
        return pa.RecordBatch.from_arrays([*(pa.array(np.full(len(doc), k)) for k in key), pa.array(doc), pa.array(root)], [*keys, "doc", "root"])

    return met(sets.select(*keys, "doc", "items"), keys, solve, f"{', '.join(f'{k} long' for k in keys)}, doc long, root long")


def across(rows: DataFrame, placed: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): links that connect the sets of clusters of several blocks. placed: doc, name, cluster, blocks, block; roots: cluster, block, doc, root of the blocks solved for themselves."""
    # single members of each block's largest components meet first
    order = Window.partitionBy("cluster", "block").orderBy(F.desc("n"), "doc")
    large = roots.groupBy("cluster", "block", F.col("root").alias("doc")).agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= TOP)
    sets = cut(sets_of(rows, placed), "sets")
    meeting = sets.join(large.select("doc"), "doc", "left_semi").withColumn("part", F.pmod("block", F.ceil(F.col("blocks") * TOP / MEET)).cast("long"))
    stars = roots.select(F.col("doc").alias("a"), F.col("root").alias("b"))
    stars = cut(stars.unionByName(solved(meeting, ["cluster", "part"]).select(F.col("doc").alias("a"), F.col("root").alias("b"))).where("a <> b"), "stars")
    known = roots.select("cluster", "doc").join(components(stars), F.col("doc") == F.col("node"), "left").select("cluster", "doc", F.coalesce("root", "doc").alias("label"))
    known = cut(known, "labels")
    most = known.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    asking = known.join(most, "cluster").withColumn("asks", F.col("label") != F.col("most"))
    parts = asking.groupBy("cluster").agg(F.ceil(F.count_if("asks") / MEET).alias("parts"))
    asking = asking.join(parts, "cluster").select("doc", "label", "asks", "parts").where("parts > 0")
    # what isn't in the cluster's largest component meets every block
    sets = sets.select("cluster", "blocks", "block", "doc", "items").join(asking, "doc")
    part = F.pmod(F.xxhash64("doc"), F.col("parts"))
    asked = sets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("asks", F.lit(False))
    asks = sets.where("asks").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = asked.unionByName(asks).select("cluster", "block", "part", "doc", "items", "label", "asks")

    def solve(key: tuple, held: dict[str, list]) -> pa.RecordBatch:
        asks, label = np.array(held["asks"]), np.array(held["label"], dtype=np.int64)
        new = unite(arrays(held["items"]), label, asks, ~asks)
        links = np.unique(np.stack([label, new])[:, label != new], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["a", "b"])

    return stars.unionByName(met(both, ["cluster", "block", "part"], solve, "a long, b long"))


def linked(rows: DataFrame, clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of the documents in clusters (node, root) by true links. nodes: doc, n_shingles, name."""
    ends = clusters.select(F.col("node").alias("doc"), F.col("root").alias("cluster"))
    ends = ends.unionByName(clusters.select(F.col("root").alias("doc"), F.col("root").alias("cluster")).distinct())
    placed = ends.join(nodes, "doc")
    total = placed.groupBy("cluster").agg(F.ceil(F.sum(F.col("n_shingles") * 8 + EACH) / BLOCK).alias("blocks"))
    placed = placed.join(total, "cluster").select("doc", "name", "cluster", "blocks", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("blocks")).alias("block"))
    placed = cut(placed, "placed")
    roots = cut(solved(sets_of(rows, placed), ["cluster", "block"]).join(placed.select("doc", "blocks"), "doc"), "solved")
    alone = roots.where("blocks = 1 AND doc <> root").select(F.col("doc").alias("node"), "root")
    several = roots.where("blocks > 1")
    if not several.limit(1).count():
        return alone
    return alone.unionByName(components(across(rows, placed.where("blocks > 1"), several.drop("blocks"))))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slack: float = SLACK) -> DataFrame:
    """(id, n_shingles, component_id): for every row its set's size and the smallest id that it reaches by links.

    Null, empty and wordless texts have no shingles and are their own component. Equal sets are linked without a
    comparison. Rows with a null id keep a null component and link to nothing. Rows that repeat an id are one document and
    each of them is returned; if their texts differ, the one whose set has the smallest name counts for links. Texts of
    any length are taken whole; other columns are not looked at. Empty input: no rows. slack decides how many segments
    larger sets have, which changes the work and not the result.
    """
    spark = docs.sparkSession
    rows = plain(docs, id_col, text_col)
    tasks, targets = targets_of(spark)
    described = cut(describe(rows), "described")
    full = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = full.groupBy("doc_id").agg(F.min("name").alias("name"))
    copies = nodes.groupBy("name").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copies = cut(copies, "copies")
    total = described.count()
    # fewer than 1 / HEAVY sets can have more than that share of the documents
    heavy = {bytes(r.name): r.first for r in copies.where(F.col("n") > max(50, HEAVY * total)).select("name", F.col("first").alias("first")).collect()}
    shown = cut(matched(deal_signatures(rows, heavy, targets, slack), tasks, targets), "matched")
    found = few = cut(buckets(probes(shown.where("pid >= 0"), tasks, targets), tasks), "buckets")
    rest = cut(shown.where("pid < 0").mapInArrow(lone_sets, "doc long").distinct(), "rest")
    if rest.limit(1).count():
        # those probe one bucket of all sets
        every = full.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size")).distinct().join(rest.withColumn("p", F.lit(1)), "doc", "left")
        found = found.unionByName(every.select(F.lit(0).cast("long").alias("bucket"), "doc", "size", F.coalesce("p", F.lit(0)).alias("probe")))
    # of copies only the first document is a member
    firsts = nodes.join(copies.where("n > 1"), "name").where("doc_id <> first").select(F.col("doc_id").alias("doc"), "first")
    members = found.join(firsts, "doc", "left").groupBy("bucket", F.coalesce("first", "doc").alias("doc")).agg(F.max("size").alias("size"), F.max("probe").alias("probe"))
    left = members.groupBy("bucket").agg(F.count("*").alias("n"), F.max("probe").alias("p")).where("n > 1 AND p > 0").select("bucket")
    members = cut(members.join(left, "bucket", "left_semi"), "members")
    drop(shown, few)
    kept = copies.select(F.col("first").alias("doc"), "name").join(full.select("doc_id", "name", "n_shingles", "sketch").dropDuplicates(["doc_id", "name"]).withColumnRenamed("doc_id", "doc"), ["doc", "name"])
    clusters = components(clustered(members, kept.select("doc", "sketch")))
    roots = linked(rows, clusters, kept.select("doc", "n_shingles", "name"))
    drop(members)
    known = copies.join(roots, F.col("first") == F.col("node"), "left").select("name", F.coalesce("root", "first").alias("root"))
    own = nodes.join(known, "name").select("doc_id", "root")
    out = described.join(own, "doc_id", "left")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def lone_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, doc, *_ in undealt(batches, FOUND):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(doc))], ["doc"])


def op4_universe_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component."""
    return join(table(spark, sf_dir, "documents"))
