import hashlib

import numpy as np
import pyarrow as pa

from folioscope.llm import recompress


def brute(rows, word):
    first, texts = {}, {}
    for d, t in sorted((r[0], r[1]) for r in rows):
        texts[d] = w = word.findall(t or "")
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    out = {}
    for d, w in texts.items():
        keep = [True] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                keep[i : i + 13] = [False] * 13
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out[d] = (len(w), len(w) - len(kept), " ".join(kept))
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in df.collect()}


def test_equals_brute_force(docs, rows, word):
    expected = brute(rows, word)
    assert sum(n for _, n, _ in expected.values()) > 1000
    assert result(recompress.deduplicate(docs)) == expected


def test_hot_windows_and_heavy_copies(spark, rows, word, monkeypatch):
    monkeypatch.setattr(recompress, "HOT", 2)
    hot = " ".join(f"h{i}" for i in range(20))
    many = [(i, f"own{i} {hot} tail{i}") for i in range(60)] + [(100 + i, rows[5][1]) for i in range(70)] + [(r[0] + 1000, r[1]) for r in rows[:30]]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(6)
    assert result(recompress.deduplicate(df)) == brute(many, word)


def test_empty_null_and_kept_columns(spark, empty):
    assert recompress.deduplicate(empty).count() == 0
    same = " ".join("abcdefghijklmnop")
    df = spark.createDataFrame([(None, same, 1), (1, same, 2), (2, same, 3), (3, None, 4)], "doc_id long, text string, copy int")
    out = recompress.deduplicate(df, keep=["copy"])
    assert {(r.doc_id, r.n_words, r.n_removed, r.row.copy) for r in out.collect()} == {(None, 16, 0, 1), (1, 16, 0, 2), (2, 16, 16, 3), (3, 0, 0, 4)}


def test_equal_windows_share_a_symbol():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 40, 60).astype(str).tolist() + ["r"] * 30
    texts = [" ".join([*rng.integers(0, 40, n).astype(str), *common, *rng.integers(0, 40, 9).astype(str)]) for n in (0, 3, 17)]
    own, key, more, at, n = recompress.symbols(pa.array(texts))
    assert set(key[n < 0][own[n < 0] == 0].tolist()) & set(key[n < 0][own[n < 0] == 1].tolist())  # a long symbol of the common part
    long = {}
    for o, k, m, a, c in zip(own, key, more, at, n, strict=True):
        if c < 0:
            long.setdefault((int(k), int(m)), set()).add(tuple(texts[o].split()[a : a - c + 12]))
    assert all(len(w) == 1 for w in long.values())
    filed, own, key, at, n = {}, own[n > 0], key[n > 0], at[n > 0], n[n > 0]
    for o, k, a, c in zip(own, key, at, n, strict=True):
        w = texts[o].split()
        for i in range(a, a + c):
            filed.setdefault(tuple(w[i : i + 13]), set()).add(int(k))
    assert all(len(k) == 1 for k in filed.values())
    assert sum(n) == sum(len(t.split()) - 12 for t in texts)


def test_query_equals_brute_force(spark, tables, word):
    """The registered query over its whole table."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    out = recompress.op7_recompression(spark, tables)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    expected = {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in brute(docs, word).items()}
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == expected
