import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioscope.llm import packing, tokens
from folioscope.llm.common import cut, new_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@cache
def library():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def test_records_equal_the_library(spark, docs, rows):
    files = tokens.write_records(docs, new_path(spark, "records"), PATH)
    out = sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in tokens.read_records(files).collect())
    at, expected = 0, []
    for d, t in sorted((r[0], r[1]) for r in rows):
        ids = ids_of(t)
        expected.append((d, at, len(ids), ids.tobytes()))
        at += len(ids)
    assert out == expected


def test_encoder_equals_the_library_on_random_text():
    rnd = random.Random(3)
    signs = [*"abcdefgXYZ's'tré'llÀÉßÿñ012 .,;!?-_#$%&\n\t\r\x0b\x0c\x01\x7f\x00 ", "'s", "'re", "'LL", "  ", "\u0301", "\u00a0", "\u0085", "\u3000", "\x1c", "İ", "ſ", "Ǆ", "中", "１", "²", "½", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "endoftext", "</w>", "\u200b", "e\u0301", "ﬁ", "Σς", "😀", "\u2028", "×"]
    for encoder in (tokens.Encoder(PATH), tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))):
        whole = Tokenizer.from_file(PATH if encoder.by_word else public_tokenizers.path("byte_bpe_50k.json"))
        for k in range(30):
            texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 40))) for _ in range(100)] + [None, ""]
            ids, bounds = encoder.encode(pa.array(texts, pa.string()))
            if encoder.by_word and k % 7 == 6:
                encoder.forget(list(encoder.known)[::2])  # what is kept stays right
            for i, t in enumerate(texts):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_names_of_special_tokens(spark):
    """Added tokens' names inside texts are one id each, as the library has them; other cases and parts are ordinary text. Through the files and the packed pieces."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|startoftext|>y", "<|ENDOFTEXT|> É", "中 <|endoftext|>", "<| endoftext |>", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokens.read_records(tokens.write_records(df, new_path(spark, "records"), PATH)).collect()}
    assert got == {i: ids_of(t).tolist() for i, t in enumerate(texts)} and 49407 in got[0] and 49407 not in got[3]
    pieces = packing.pieces(df, PATH, window=4).collect()
    for i, t in enumerate(texts):
        own, ids = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start), ids_of(t)
        assert sum(p.length for p in own) == len(ids) and all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)


def test_null_ids_repeats_and_no_rows(spark, empty):
    df = spark.createDataFrame([(None, "a b"), (4, None), (4, None), (1, "c")], "doc_id long, text string")
    files = tokens.write_records(df, new_path(spark, "records"), PATH)
    out = sorted(((r.doc_id or 0), r.start, r.n_tokens) for r in tokens.read_records(files).collect())
    assert out == [(0, 0, 3), (1, 3, 2), (4, 5, 1), (4, 6, 1)]
    assert tokens.read_records(tokens.write_records(empty, new_path(spark, "records"), PATH)).count() == 0


def test_frames_and_checksums():
    assert tokens.crc32c([b"123456789"])[0] == 0xE3069283  # the published check value
    rng = np.random.default_rng(0)
    items = [rng.bytes(int(n)) for n in (0, 1, 3, 4, 8, 63, 64, 65, 200, 4097)]
    table = tokens.crc_table().tolist()

    def plain(x):
        c = 0xFFFFFFFF
        for b in x:
            c = table[(c ^ b) & 255] ^ (c >> 8)
        return c ^ 0xFFFFFFFF

    assert tokens.crc32c(items).tolist() == [plain(x) for x in items]
    assert tokens.unframed(tokens.framed(items)) == items
    broken = tokens.framed(items)[-1]
    with pytest.raises(ValueError):
        tokens.unframed([broken[:50] + bytes([broken[50] ^ 1]) + broken[51:]])


def test_wide_ids():
    for ids in ([70000, 1], [1, 2], []):
        assert tokens.parsed(tokens.payload(-5, np.array(ids, dtype=np.uint32))) == (-5, pytest.approx(ids))


def test_packing_is_whole_and_tight(spark, docs, rows):
    out = packing.pack(cut(packing.pieces(docs, PATH, window=256), "pieces"), window=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {r[0] for r in rows}
    for d, t in ((r[0], r[1]) for r in rows):
        ids, at = ids_of(t), 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    total = sum(r.length for r in out)
    assert len(by_sequence) <= -(-total // 256) + 1
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_best_fill_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 40, 5), rng.integers(1, 4, 5), strict=True)}
        room = int(rng.integers(1, 90))
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        fill = packing.best_fill(counts, room)
        assert sum(n * k for n, k in fill.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in fill.items())
        used = Counter()
        for p, times in packing.patterns(counts, 100):
            assert sum(n * k for n, k in p.items()) <= 100
            used.update({n: k * times for n, k in p.items()})
        assert used == counts


def test_packing_nothing(spark, empty):
    assert packing.pack(cut(packing.pieces(empty, PATH), "pieces")).count() == 0
