"""Token ids of whole texts, and files of length-delimited records that hold them.

A record is: length of the payload (unsigned 64-bit, little-endian), masked CRC-32C of those 8 bytes, the payload, and
its masked CRC-32C. The payload is a kind byte, the document's id (64-bit), and its token ids (16-bit where all fit,
else 32-bit). Beside each file lies an index: for each record the document id, its place, its length and its ids.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import cut, new_path, slices, table

#: The id that ends each document.
END_ID = 2
#: Distinct words whose ids a worker keeps; beyond, it starts anew. A bound on memory only.
KEPT_WORDS = 500_000
#: Bytes of text whose distinct words are looked up at once.
TEXT_BYTES = 4 << 20
#: Distinct words that one call encodes.
CALL_WORDS = 2000
#: Split apart by Python and Arrow, but no white space to the tokenizer.
SEPARATORS = "[\x1c-\x1f]"
#: Stands between words in a call.
MARK = "\x01"
#: Beyond these characters, cases and letters may be understood otherwise by different libraries.
BEYOND_LATIN = "[^\\x00-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
#: A comma or full stop between a letter and white space is a piece of its own to tokenizers that part letters and signs.
TAIL = "([a-z\u00df-\u00f6\u00f8-\u00ff])([.,])(\\s|$)"
#: How a tokenizer file declares that it drops white space, lowers cases and parts letters, digits and signs.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PARTING = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: That parting for words in lower case within BEYOND_LATIN's limits.
LATIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
LATIN_WORD = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The default tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def parts_words(spec: dict) -> bool:
    """Whether a tokenizer file declares that white space parts tokens and is dropped, and that words fall into the pieces of PARTING."""
    steps, model = (spec.get("pre_tokenizer") or {}).get("pretokenizers", []), spec.get("model") or {}
    split, level = steps if len(steps) == 2 else ({}, {})
    return (
        spec.get("normalizer") == NORMALIZER
        and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": PARTING}, "Removed", True)
        and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
        and model.get("type") == "BPE"
        and bool(model.get("end_of_word_suffix"))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and all(t["special"] and t["content"] and not any(t.get(k) for k in ("normalized", "single_word", "lstrip", "rstrip")) for t in spec.get("added_tokens", []))
    )


def stretches(pool: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' stretches of the pool one after the other, and their lengths; row i ends at ends[i + 1]."""
    starts, lengths = ends[rows], ends[rows + 1] - ends[rows]
    at = np.concatenate([[0], np.cumsum(lengths)])
    return pool[np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])], lengths


@cache
def merger(path: str):
    """The file's merges alone, for pieces that white space parts and that are normal already."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = None
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][1]]}
    t = Tokenizer.from_str(json.dumps(spec))
    t.encode_special_tokens = True
    return t


class Encoder:
    """Ids of whole texts by a tokenizer that never joins what white space parts.

    Where the tokenizer's file declares so (parts_words), a text's ids are its words' ids in order: each distinct word of
    a step is encoded once, and steps share what they know. A word of ASCII and Latin-1 letters is cut into its pieces
    here, and the library only merges them; other words go through the whole library. Any other tokenizer, a text with a
    separator that only some libraries take for white space, and a text that holds the name of an added token (such as
    <|endoftext|>, which the library gives the token's one id) is encoded as it is.
    """

    def __init__(self, path: str) -> None:
        self.t = tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = parts_words(spec) and len(self.ids([MARK])[0]) == 1
        if self.by_word:
            self.mark = self.ids([MARK])[0][0]
            suffix = spec["model"]["end_of_word_suffix"]
            self.is_end = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.is_end[[i for word, i in spec["model"]["vocab"].items() if word.endswith(suffix)]] = True
            self.merge = merger(path)
            self.whole = "|".join([SEPARATORS, *(re.escape(t["content"]) for t in spec.get("added_tokens", []))])
        self.known: dict[str, int] = {}
        self.forget()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self, words: list[str] | None = None) -> None:
        """Forget all words but those given."""
        words = [w for w in words or [] if w in self.known]
        pool, ends = (self.pool, self.ends) if words else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        ids, lengths = stretches(pool, ends, np.array([self.known[w] for w in words], dtype=np.int64))
        self.known.clear()
        self.known.update(zip(words, range(len(words)), strict=True))
        self.pool, self.ends, self.used = np.concatenate([ids, np.zeros(1 << 20, np.uint32)]), np.concatenate([[0], np.cumsum(lengths)]), len(ids)

    def learn(self, words: list[str]) -> None:
        """Encode words in calls of many, and keep where each one's ids stand."""
        texts = pa.array(words, pa.string())
        letters, odd = np.asarray(pc.match_substring_regex(texts, LATIN_WORD)), np.asarray(pc.match_substring_regex(texts, f"{BEYOND_LATIN}|[A-Z\u00c0-\u00d6\u00d8-\u00de{MARK}]"))
        found, counts = [], [np.diff(self.ends)]
        for kind, call in ((letters, self.merged), (~letters & ~odd, self.pieced), (odd, self.call)):
            some_of = texts.filter(pa.array(kind)).to_pylist()
            for at in range(0, len(some_of), CALL_WORDS):
                made = call(some_of[at : at + CALL_WORDS])
                found.append(made[0])
                counts.append(made[1])
            self.known.update(zip(some_of, range(len(self.known), len(self.known) + len(some_of)), strict=True))
        for ids in found:
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        self.ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are one piece each, and how many each has: a piece's last token bears the suffix."""
        ids = np.asarray(self.merge.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        return ids, np.diff(np.flatnonzero(self.is_end[ids]), prepend=-1)

    def pieced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [LATIN_PIECE.findall(w) for w in words]
        ids, counts = self.merged([p for w in pieces for p in w])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum([len(w) for w in pieces])])]
        return ids, np.diff(ends)

    def call(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and how many each has, by the whole library. A mark, which no other word's ids contain, stands after each word."""
        if any(MARK in w for w in words):
            own = self.ids(words)
            return np.fromiter((i for w in own for i in w), dtype=np.uint32), np.array([len(w) for w in own], dtype=np.int64)
        ids = np.asarray(self.ids([f" {MARK} ".join([*words, ""])])[0], dtype=np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, bounds by text); null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            own = self.ids(texts.to_pylist())
            return np.fromiter((i for x in own for i in x), dtype=np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        odd = np.asarray(pc.match_substring_regex(texts, self.whole))
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        beyond = pc.match_substring_regex(plain, BEYOND_LATIN)
        lowered = pc.replace_substring_regex(pc.utf8_lower(plain), TAIL, r"\1 \2\3")
        plain = pc.if_else(beyond, plain, lowered) if pc.any(beyond).as_py() else lowered
        lists = pc.utf8_split_whitespace(plain)
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > KEPT_WORDS:
            self.forget(words)
        self.learn(new)
        rows = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))[np.asarray(coded.indices)]
        ids, lengths = stretches(self.pool, self.ends, rows)
        bounds = np.concatenate([[0], np.cumsum(lengths)])[bounds - bounds[0]]
        if odd.any():
            own = {int(i): self.ids([texts[int(i)].as_py()])[0] for i in np.flatnonzero(odd)}
            parts = [np.asarray(own[i], np.uint32) if i in own else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            ids, bounds = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int = END_ID) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids with the end id) of each row (doc_id, text)."""
    e = encoder(path)
    for batch in batches:
        for part in slices(batch, step=TEXT_BYTES):
            ids, bounds = e.encode(part.column("text"))
            for k, doc in enumerate(part.column("doc_id").to_pylist()):
                yield doc, np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")


@cache
def crc_table() -> np.ndarray:
    """CRC-32C (Castagnoli, reflected polynomial) of each byte, from its rule."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


@cache
def crc_steps(width: int) -> np.ndarray:
    """What a CRC-32C state becomes after `width` zero bytes, by each byte of the state: shape (4, 256)."""
    t = crc_table()
    out = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(width):
        out = t[out & 0xFF] ^ (out >> 8)
    return out


LANE = 64


def crc32c(items: list[bytes]) -> np.ndarray:
    """CRC-32C of each item, all side by side.

    Items are cut into lanes of 64 bytes (zeros before the first byte don't change a state of zero; the usual first
    state is added to the first four bytes instead), lanes run together, and states are joined by their linearity.
    """
    out = np.zeros(len(items), np.uint32)
    short = [i for i, x in enumerate(items) if len(x) < 4]
    for i in short:
        state = 0xFFFFFFFF
        for b in items[i]:
            state = int(crc_table()[(state ^ b) & 255]) ^ (state >> 8)
        out[i] = state
    rows = np.array([i for i, x in enumerate(items) if len(x) >= 4], dtype=np.int64)
    if not len(rows):
        return out ^ np.uint32(0xFFFFFFFF)
    sizes = np.array([len(items[i]) for i in rows], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    rows, sizes = rows[order], sizes[order]
    lanes = -(-sizes // LANE)
    ends = np.cumsum(lanes) * LANE
    data = np.zeros(int(ends[-1]), np.uint8)
    for i, n, end in zip(rows.tolist(), sizes.tolist(), ends.tolist(), strict=True):
        data[end - n : end] = np.frombuffer(items[i], np.uint8)
    data[((ends - sizes)[:, None] + np.arange(4)).ravel()] ^= 0xFF
    t, data = crc_table(), data.reshape(-1, LANE)
    states = np.zeros(len(data), np.uint32)
    for k in range(LANE):
        states = t[(states ^ data[:, k]) & 0xFF] ^ (states >> 8)
    z, state, firsts = crc_steps(LANE), np.zeros(len(rows), np.uint32), ends // LANE - lanes
    for j in range(int(lanes[0])):
        n = int(np.searchsorted(-lanes, -j, side="left"))  # items with more than j lanes come first
        s = state[:n]
        state[:n] = z[0][s & 255] ^ z[1][s >> 8 & 255] ^ z[2][s >> 16 & 255] ^ z[3][s >> 24] ^ states[firsts[:n] + j]
    out[rows] = state
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The checksum as record files store it: rotated right by 15 bits, plus a constant."""
    with np.errstate(over="ignore"):
        return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


def payload(doc: int, ids: np.ndarray) -> bytes:
    """doc_id and ids: kind 0 holds 16-bit ids, kind 1 32-bit ones."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return struct.pack("<Bq", wide, doc) + (ids.astype("<u4") if wide else ids.astype("<u2")).tobytes()


def parsed(raw: bytes) -> tuple[int, np.ndarray]:
    wide, doc = struct.unpack_from("<Bq", raw)
    return doc, np.frombuffer(raw, "<u4" if wide else "<u2", offset=9).astype("<u4")


def framed(items: list[bytes]) -> list[bytes]:
    """The records of payloads."""
    heads = [struct.pack("<Q", len(x)) for x in items]
    a, b = masked(crc32c(heads)).tolist(), masked(crc32c(items)).tolist()
    return [h + struct.pack("<I", x) + body + struct.pack("<I", y) for h, x, body, y in zip(heads, a, items, b, strict=True)]


def unframed(records: list[bytes]) -> list[bytes]:
    """The payloads of whole records; raises ValueError for a wrong length or checksum."""
    items = [r[12:-4] for r in records]
    ok = masked(crc32c([r[:8] for r in records])) == np.array([struct.unpack_from("<I", r, 8)[0] for r in records], np.uint32)
    ok &= masked(crc32c(items)) == np.array([struct.unpack("<I", r[-4:])[0] for r in records], np.uint32)
    if not ok.all() or any(struct.unpack_from("<Q", r)[0] != len(x) for r, x in zip(records, items, strict=True)):
        raise ValueError("a record is damaged")
    return items


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store that a URI or path names, and the path there; the same on the driver and the executors."""
    if not urlparse(path).scheme:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


#: Records that are framed, or read, at once.
GROUP = 2000
#: Stands in files for a null id, which comes before all others.
NO_ID = -(2**63)
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("n_ids", "<i8")])
FILE_SCHEMA = "file long, path string, n_docs long, n_ids long, n_bytes long"


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids in ascending id order as files path/part-NNNNN.rec with indexes .idx; returns a row for each file.

    Documents are dealt by ranges of their ids, so that files follow each other, and sorted in each task, which writes
    under a name of its own attempt and renames when done: a lost or repeated task leaves no half file under a final name.
    Null texts are empty (the end id alone); null ids come first and stay null; documents with the same id stand next to each other, by text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        k = context.partitionId()
        fs, root = filesystem(path)
        name = f"{root}/part-{k:05d}"
        own = f"{root}/.attempt-{k:05d}-{context.taskAttemptId()}"
        index, n_ids, at, group = [], 0, 0, []
        out = None

        def flush() -> None:
            nonlocal at, n_ids
            for (doc, n, _), record in zip(group, framed([x for _, _, x in group]), strict=True):
                out.write(record)
                index.append((doc, at, len(record), n))
                at += len(record)
                n_ids += n
            group.clear()

        for doc, ids in token_batches(batches, tokenizer_path, end_id):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{own}.rec")
            doc = NO_ID if doc is None else doc
            group.append((doc, len(ids), payload(doc, ids)))
            if len(group) >= GROUP:
                flush()
        if out is None:
            return
        flush()
        out.close()
        with fs.open_output_stream(f"{own}.idx") as f:
            f.write(np.array(index, dtype=INDEX).tobytes())
        for kind in ("rec", "idx"):
            fs.move(f"{own}.{kind}", f"{name}.{kind}")
        row = [k, f"{path}/part-{k:05d}", len(index), n_ids, at]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["file", "path", "n_docs", "n_ids", "n_bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return cut(dealt.mapInArrow(run, FILE_SCHEMA), "files")


def read_records(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every record of the files, checked; start counts the ids of all records before it.

    Each file is read by its index, some records at a time. There is a row for each file to order, never for each document.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    rows = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, root = filesystem(name)
                with fs.open_input_stream(f"{root}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                starts = base + np.concatenate([[0], np.cumsum(index["n_ids"])])
                with fs.open_input_file(f"{root}.rec") as f:
                    for a in range(0, len(index), GROUP):
                        some = index[a : a + GROUP]
                        raw = f.read_at(int(some["length"].sum()), int(some["offset"][0]))
                        cuts = some["offset"] - some["offset"][0]
                        items = [parsed(x) for x in unframed([raw[x : x + n] for x, n in zip(cuts.tolist(), some["length"].tolist(), strict=True)])]
                        if [d for d, _ in items] != some["doc_id"].tolist() or [len(x) for _, x in items] != some["n_ids"].tolist():
                            raise ValueError(f"{name}: the index doesn't fit the records")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some["doc_id"], mask=some["doc_id"] == NO_ID), pa.array(starts[a : a + len(some)]), pa.array(some["n_ids"]), pa.array([x.tobytes() for _, x in items], pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    n = files.sparkSession.sparkContext.defaultParallelism
    return rows.select("path", "base").repartition(max(n, 1) * 4).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op10_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place among all ids, from the files that hold them."""
    files = write_records(table(spark, sf_dir, "documents"), new_path(spark, "records"), vocabulary())
    return read_records(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
