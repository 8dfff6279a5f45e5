"""Media columns: payloads as 8-bit samples of an ISO media file, and the features of such files.

A file is nested boxes (size, type, content). `encode` writes ftyp, moov (mvhd, trak/mdia/minf/stbl with the sample
tables) and mdat; `parse` walks the boxes of any such file, decodes the sample tables and returns codec, duration and
the byte ranges of samples and keyframes. It never decodes a sample.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import quoted, slices, table

#: Payloads are padded with zeros to a positive multiple of this.
UNIT = 64
#: Bytes of a media sample: a block of 8-bit mono samples.
BLOCK = 4096
#: Samples a second; one byte is one sample.
RATE = 8000
#: Every such block is marked as a keyframe.
KEY_EVERY = 8
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
#: Boxes within boxes, at most.
DEEPEST = 32


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    n = len(body) + 8
    return (struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8)) + body


def full(kind: bytes, *content: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *content)


def encode(payload: bytes) -> bytes:
    """An ISO media file with the payload as unsigned 8-bit mono samples ('raw '). Equal payloads give equal files."""
    n, whole = len(payload), len(payload) // BLOCK
    sizes = [BLOCK] * whole + [n % BLOCK] * (n % BLOCK > 0)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = ([(whole, BLOCK)] if whole else []) + ([(1, n % BLOCK)] if n % BLOCK else [])
    keys = range(1, len(sizes) + 1, KEY_EVERY)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def moov(at: int) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">I", len(runs)), *(struct.pack(">II", *r) for r in runs)),
            full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)),
            full(b"stsz", struct.pack(">II", 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes)),
            full(b"co64", struct.pack(">IQ", 1, at)),
            full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdhd = struct.pack(">IIIIHH", 0, 0, RATE, n & 0xFFFFFFFF, 0x55C4, 0)
        mdia = box(b"mdia", full(b"mdhd", mdhd), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = struct.pack(">IIIII", 0, 0, 1, 0, n & 0xFFFFFFFF) + bytes(8) + struct.pack(">HHHH", 0, 0, 0x0100, 0) + matrix + bytes(8)
        mvhd = struct.pack(">IIIIIH", 0, 0, RATE, n & 0xFFFFFFFF, 0x10000, 0x0100) + bytes(10) + matrix + bytes(24) + struct.pack(">I", 2)
        return box(b"moov", full(b"mvhd", mvhd), box(b"trak", full(b"tkhd", tkhd, flags=7), mdia))

    head = len(ftyp) + len(moov(0)) + (8 if n + 8 < 1 << 32 else 16)
    return ftyp + moov(head) + box(b"mdat", payload)


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the content of each box. Raises ValueError where sizes don't fit."""
    while at < end:
        if end - at < 8:
            raise ValueError("a box is cut off")
        n, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if n == 1:
            if end - at < 16:
                raise ValueError("a box is cut off")
            (n,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif n == 0:
            n = end - at
        if n < head or at + n > end:
            raise ValueError(f"box {kind!r} has a wrong size")
        yield kind, at + head, at + n
        at += n


def whole_samples(sizes: np.ndarray, chunks: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Where each sample begins. runs: rows (first chunk, samples in a chunk, description), first chunks counted from 1."""
    firsts = runs[:, 0]
    if len(chunks) and (not len(runs) or firsts[0] != 1 or (np.diff(firsts) <= 0).any() or firsts[-1] > len(chunks)):
        raise ValueError("the table of chunks is damaged")
    per = np.repeat(runs[:, 1], np.diff(np.append(firsts, len(chunks) + 1))) if len(chunks) else np.zeros(0, np.int64)
    ends = np.minimum(np.cumsum(np.minimum(per, len(sizes))), len(sizes))
    if len(sizes) != (ends[-1] if len(ends) else 0):
        raise ValueError("samples and chunks don't agree")
    before = np.concatenate([[0], np.cumsum(sizes)])
    first = np.concatenate([[0], ends[:-1]])
    return np.repeat(chunks - before[first], ends - first) + before[:-1]


def parse(media: bytes) -> list[dict]:
    """Of each track: codec, handler, timescale, duration, samples [(offset, size)], keys [sample index].

    Raises ValueError for a damaged file, for boxes nested deeper than DEEPEST, and for a fragmented file, whose samples
    stand in other tables. Nothing is allocated beyond a few times the file's size.
    """
    data, tracks = memoryview(media), []

    def walk(at: int, end: int, track: dict | None, depth: int) -> None:
        if depth > DEEPEST:
            raise ValueError("boxes are nested too deeply")
        for kind, a, b in boxes(data, at, end):
            if kind in (b"moof", b"mvex"):
                raise ValueError("a fragmented file")
            if kind == b"trak":
                tracks.append(track := {})
            if kind in CONTAINERS:
                walk(a, b, track, depth + 1)
            elif track is not None:
                track[kind] = data[a:b]

    def rows(box: memoryview, at: int, width: int, kind: str = ">u4") -> np.ndarray:
        """A table of the box: its length stands at `at`, width numbers in a row."""
        (n,) = struct.unpack_from(">I", box, at)
        if n * width * np.dtype(kind).itemsize > len(box) - at - 4:
            raise ValueError("a table is longer than its box")
        found = np.frombuffer(box, kind, n * width, at + 4)
        if len(found) and int(found.max()) >= 1 << 62:
            raise ValueError("a number is too large")
        return found.astype(np.int64).reshape(n, width)

    try:
        walk(0, len(data), None, 0)
        out = []
        for t in tracks:
            head = t[b"mdhd"]
            scale, duration = struct.unpack_from(">IQ", head, 20) if head[0] else struct.unpack_from(">II", head, 12)
            fixed, count = struct.unpack_from(">II", t[b"stsz"], 4)
            if fixed and fixed * count > len(data):
                raise ValueError("samples lie outside the file")
            sizes = np.full(count, fixed, dtype=np.int64) if fixed else rows(t[b"stsz"], 8, 1)[:, 0]
            chunks = rows(t[b"co64"], 4, 1, ">u8")[:, 0] if b"co64" in t else rows(t[b"stco"], 4, 1)[:, 0]
            starts = whole_samples(sizes, chunks, rows(t[b"stsc"], 4, 3))
            if len(starts) and (starts.min() < 0 or (starts + sizes).max() > len(data)):
                raise ValueError("samples lie outside the file")
            keys = rows(t[b"stss"], 4, 1)[:, 0] - 1 if b"stss" in t else np.arange(count)
            if len(keys) and (keys.min() < 0 or keys.max() >= count or (np.diff(keys) <= 0).any()):
                raise ValueError("the table of keyframes is damaged")
            ticks = sum(n * d for n, d in rows(t[b"stts"], 4, 2).tolist())
            if max(duration, ticks) >= 1 << 63:
                raise ValueError("a number is too large")
            text = lambda box, at: bytes(t[box][at : at + 4]).decode("latin-1")
            found = {"codec": text(b"stsd", 12), "handler": text(b"hdlr", 8), "timescale": scale, "duration": duration or ticks}
            out.append(found | {"samples": list(zip(starts.tolist(), sizes.tolist(), strict=True)), "keys": keys.tolist()})
        return out
    except (struct.error, KeyError, IndexError, OverflowError) as e:
        raise ValueError(f"not a whole media file: {e!r}") from e


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's UTF-8 bytes (null: none), padded with zeros to a positive multiple of 64, as a media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                media = [encode(x + bytes(-len(x) % UNIT or (0 if x else UNIT))) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary").withColumnRenamed("doc_id", id_col)


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """(codec, handler, timescale, duration, n_samples, keyframes [(offset, size)], payload, error, media, row) of each file's first track; row is a struct of the other columns, whatever their names are.

    payload is the samples' bytes in order. A null, empty, damaged or fragmented file, or one without a track, has null
    features and an error text; no row is lost. Equal files have equal features.
    """
    rows = media.select(quoted(media_col).alias("media"), F.struct(F.lit(True).alias("there"), *[quoted(c) for c in media.columns if c != media_col]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
        kinds = [("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", spans), ("payload", pa.binary()), ("error", pa.string())]
        for batch in batches:
            for part in slices(batch, "media"):
                made = []
                for raw in part.column("media").to_pylist():
                    row = dict.fromkeys(k for k, _ in kinds)
                    try:
                        if raw is None or not (tracks := parse(raw)):
                            raise ValueError("no track")
                        t = tracks[0]
                        row |= {k: t[k] for k in ("codec", "handler", "timescale", "duration")} | {"n_samples": len(t["samples"])}
                        row["keyframes"] = [{"offset": x, "size": n} for x, n in (t["samples"][i] for i in t["keys"])]
                        row["payload"] = b"".join(raw[x : x + n] for x, n in t["samples"])
                    except ValueError as e:
                        row["error"] = str(e)
                    made.append(row)
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in made], kind) for k, kind in kinds), *part.columns], [*(k for k, _ in kinds), "media", "row"])

    long = T.LongType()
    spans = T.ArrayType(T.StructType([T.StructField("offset", long), T.StructField("size", long)]))
    kinds = {"codec": T.StringType(), "handler": T.StringType(), "timescale": long, "duration": long, "n_samples": long, "keyframes": spans, "payload": T.BinaryType(), "error": T.StringType()}
    return rows.mapInArrow(run, T.StructType([*(T.StructField(k, v) for k, v in kinds.items()), *rows.schema.fields]))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a media file and what is read back from it.

    The digests come from the operator's columns: payload (read back from the file), media and the decoded features.
    They are taken by Spark's own functions. A null text is an empty one; repeated rows give repeated results.
    """
    out = media_features(to_media(table(spark, sf_dir, "documents")))
    keys = F.concat_ws(",", F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"], k["size"])))
    return out.select(
        "row.doc_id",
        "row.n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{UNIT}, {UNIT})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("codec="), F.trim("codec"), F.lit(";handler="), "handler", F.lit(";seconds="), F.format_string("%.6f", F.col("duration") / F.col("timescale")), F.lit(";samples="), F.col("n_samples").cast("string"), F.lit(";keyframes="), keys).alias("feature"),
    )
