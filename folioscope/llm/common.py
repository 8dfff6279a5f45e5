"""What the operators share: the shared folder, words as numbers, ranks without gaps."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text that one vectorised step holds at once, in bytes; a longer single text is one step of its own.
STEP_BYTES = 1 << 20
#: While a table is written: its shuffle files go at the end, and Python workers get few rows at a time.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a temporary one, for a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        path = _own[context.applicationId]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later stages don't depend on what made it, and its shuffles are over."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that no later stage reads."""
    for x in tables:
        path = x.sparkSession._jvm.org.apache.hadoop.fs.Path(x.written_to)
        path.getFileSystem(x.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8_size(text: Column) -> Column:
    """Bytes of the text in UTF-8; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def let_go() -> None:
    """Give memory that nothing holds back to the system: Python workers live on for other tasks, each with the most that it ever used."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about step bytes of the column each, so that memory doesn't follow the batch size."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // step
    at = 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1), len(sizes)]:
        if end > at:
            yield batch.slice(at, end - at)
            at = end
    let_go()


def word_lists(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words (runs without the six ASCII white spaces) of the texts: bounds by text, and the words one after the other. lower: A-Z only."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    bounds = bounds - bounds[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py() and len(flat):
        bounds, flat = np.concatenate([[0], np.cumsum(np.asarray(full))])[bounds], flat.filter(full)
    return bounds, flat


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words as word_lists has them: bounds by text, a code for each word, and the distinct words."""
    bounds, flat = word_lists(texts, lower)
    coded = flat.dictionary_encode()
    return bounds, np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit name for each word, the same everywhere."""
    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(w, seed) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled (a bijection), so that its high and low bits can be used apart."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


#: The bases of two fingerprints of sequences, odd.
BASES = (0x9E6C63D0876A9A47, 0xD1342543DE82EF95)
LENGTHS = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) among 64-bit numbers; kept for the next call unless they are many."""
    known = _powers.get(base)
    if known is not None and len(known) >= n:
        return known[:n]
    size = max(n, STEP_BYTES + (1 << 16))
    made = np.full(size, base, np.uint64)
    made[0] = 1
    with np.errstate(over="ignore"):
        made = np.cumprod(made)
    if size <= 2 * STEP_BYTES:
        _powers[base] = made
    return made[:n]


class Sequences:
    """Fingerprints of stretches of a line of numbers, each from two sums. Equal stretches have equal ones wherever they stand."""

    def __init__(self, h: np.ndarray, base: int = BASES[0]) -> None:
        with np.errstate(over="ignore"):
            self.down = powers(pow(base, -1, 1 << 64), len(h) + 1)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base, len(h) + 1)[:-1])])

    def names(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """A name for the width numbers from each of the places on."""
        with np.errstate(over="ignore"):
            return mix((self.sums[at + width] - self.sums[at]) * self.down[at] + np.asarray(width, dtype=np.uint64) * LENGTHS)


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte, for two fingerprints, and the same with A-Z as a-z.
BYTES = mix(np.arange(1, 513, dtype=np.uint64) * LENGTHS).reshape(2, 256)
LOWERED = BYTES.copy()
LOWERED[:, 65:91] = BYTES[:, 97:123]


def word_names(texts: pa.Array, lower: bool = False, two: bool = False) -> tuple[np.ndarray, ...]:
    """Bounds by text, and a 64-bit name for each word (a run without the six ASCII white spaces) of the texts, worked out from all their bytes at once; two: second names, independent of the first. lower: A-Z as a-z. Null texts have no words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~WHITE[data]
    step = np.diff(word)
    first, last = step[:-1] > 0, step[1:] < 0
    edges = ends[(ends > 0) & (ends < len(data))]  # where one text follows another, no word goes on
    first[edges] = word[1:-1][edges] > 0
    last[edges - 1] = word[1:-1][edges - 1] > 0
    start = np.flatnonzero(first)
    width = np.flatnonzero(last) + 1 - start
    table = LOWERED if lower else BYTES
    return np.searchsorted(start, ends), *(Sequences(table[k][data], BASES[k]).names(start, width) for k in range(2 if two else 1))


def owners(bounds: np.ndarray) -> np.ndarray:
    """The index of the text that each word belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """df with column name: the row's place (from 0, gapless) in its group by order; with weight, the sum of that column over the rows before it.

    Rows are dealt by ranges of (group, order), so that a group with most of the rows spreads over all tasks;
    only a row for each group and task is summed up to know where each range begins. The deal samples its input
    first: df should be a table, not a long computation.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    firsts = dealt.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.sum(weight if weight else F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if weight:
        inner = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # a part of a range's rows
        dealt = dealt.withColumn("_inner", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    a, b = dealt.alias("a"), firsts.alias("b")
    same = F.col("a._part") == F.col("b._part")
    for c in group:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    place = F.col("b._before") + (F.col("a._inner") if weight else F.col("a._at") - F.col("b._first"))
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in df.columns], place.cast("long").alias(name))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) can reach, of nodes that aren't that themselves.

    Alternating large-star and small-star rounds over a written table; no node's neighbours are ever gathered:
    each round only takes minima (combined before the shuffle) and joins, and the number of rounds grows with the
    logarithm of the longest shortest path. It ends when every node points to one root that points nowhere.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("to")), F.struct(F.col("v").alias("x"), F.lit(None).cast("long").alias("to")))).alias("e")).select("e.*")
        unlike = ends.groupBy("x").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.col("to").isNull()).alias("below"))
        if not unlike.where("low <> high OR (low IS NOT NULL AND below)").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: what is above u gets u's smallest neighbour
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: what is below u, and u itself, get u's smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = cut(small, "links")
        drop(edges)
        edges = new


#: Rows that a task gathers before it deals them out, and that one packed row holds at most.
DEALT_ROWS = 250_000


class Dealer:
    """Packs arrays of equal length into binary rows (pid, n, one binary for each column), dealt by a hash.

    Millions of small records move through the shuffle as some packed rows for each target, and numpy sorts them there.
    A packed column has its numbers' first bytes, then their second ones, and so on: what numbers share, such as leading
    zeros, is then one stretch, which compresses however few records a row has.
    """

    def __init__(self, kinds: list[tuple[str, str]], targets: int, spread: bool = False) -> None:
        """spread: records of pid -1 need no company; each packed row of them goes to a negative target of its own choice."""
        self.kinds, self.targets, self.parts, self.held, self.spread = kinds, targets, [], 0, spread
        context = TaskContext.get()
        self.lone = (context.partitionId() if context else 0) % targets

    @staticmethod
    def schema(kinds: list[tuple[str, str]]) -> str:
        return "pid int, rows int, " + ", ".join(f"{k} binary" for k, _ in kinds)

    def add(self, pid: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((pid, *columns))
        self.held += len(pid)
        if self.held >= DEALT_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        pid, *columns = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        if self.spread:
            pid = np.where(pid < 0, -1 - self.lone, pid)
        order = np.argsort(pid, kind="stable")
        pid = pid[order]
        full = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]]))
        ends = np.append(full, len(pid))
        out = [pa.array(pid[full], pa.int32()), pa.array(np.diff(ends), pa.int32())]
        full = range(len(full))
        for (_, kind), c in zip(self.kinds, columns, strict=True):
            c = np.ascontiguousarray(c[order], dtype=kind)
            c = c.view(np.uint8).reshape(len(c), -1)
            out.append(pa.array([c[ends[i] : ends[i + 1]].T.tobytes() for i in full], pa.binary()))
        yield pa.RecordBatch.from_arrays(out, ["pid", "rows", *(k for k, _ in self.kinds)])


def unpacked(column: bytes, kind: str) -> np.ndarray:
    """The numbers of a packed column."""
    planes = np.frombuffer(column, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def undealt(batches: Iterator[pa.RecordBatch], kinds: list[tuple[str, str]], with_pid: bool = False) -> Iterator:
    """The columns of all records of one pid after the other (with_pid: pid, columns); the packed rows must be sorted by pid."""

    def whole():
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return (pid, columns) if with_pid else columns

    let_go()
    pid, parts = None, []
    for batch in batches:
        ids = batch.column("pid").to_pylist()
        columns = [batch.column(k) for k, _ in kinds]
        for i, p in enumerate(ids):
            if p != pid and parts:
                yield whole()
                parts = []
            pid = p
            parts.append([unpacked(c[i].as_py(), kind) for c, (_, kind) in zip(columns, kinds, strict=True)])
    if parts:
        yield whole()


def targets_of(spark: SparkSession) -> tuple[int, int]:
    """(tasks, targets): targets are several times the tasks, so that a task sorts a small part of what it gets at once."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return n, 4 * n
