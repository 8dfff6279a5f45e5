"""Collocations against brute force and the query against its SQL."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from folioscope.llm import collocations as C


def brute(rows, least=10, best=2000):
    """The contract's rows, word by word."""
    low, counts, total = {i: i + 32 for i in range(65, 91)}, Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(low)):
            ws = re.findall("[^ \t]+", piece)
            total[lang] += len(ws)
            counts.update((lang, tuple(ws[i : i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    made = []
    for (lang, p), a in counts.items():
        if len(p) == 1 or a < least:
            continue
        if len(p) == 2 and any(100 * x >= 50 * a for (g, q), x in counts.items() if len(q) == 3 and x >= least and g == lang and p in (q[:2], q[1:])):
            continue
        s, _, l, r = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        made.append((lang, -s, -a, " ".join(p).encode(), l, r))
    out, seen = [], Counter()
    for lang, s, a, phrase, l, r in sorted(made):
        seen[lang] += 1
        if seen[lang] <= best:
            out.append((lang, seen[lang], phrase.decode(), -a, l, r, total[lang], -s))
    return out


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def made_rows():
    rnd = random.Random(2)
    words = ["the", "The", "of", "a", "née", "b|c", "é", "x y", "中", "w1", "w2", "w3", "zz"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", ";", "\x0b", "!"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(n))
    rows = [(rnd.choice(["en", "en", "en", "de", None, "und", ""]), rnd.choice([text(rnd.randint(0, 60)), None, "", " , "])) for _ in range(150)]
    rows += [(None, "so it is"), ("und", "So it is not")] * 8 + [("en", "of the of the of the " * 5), ("fr", "ha " * 3000), ("en", "mono")] + [("en", "rare pair here")] * 12 + [("en", "deep blue sea"), ("en", "deep blue")] * 10
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = made_rows()
    df = spark.createDataFrame([(i if i % 7 else None, t, lang, "s", 1, "k", 2, 3) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, word int, w1 string, id int, n int").repartition(4)
    expected = brute(rows)
    assert result(C.collocations(df)) == expected and {r[0] for r in expected} >= {"en", "fr", "und"}
    assert result(C.collocations(df, best=7)) == brute(rows, best=7)
    assert result(C.collocations(df, best=None)) == brute(rows, best=10**9)


def test_many_small_shards_and_chunks(spark, monkeypatch):
    """Shards and steps of a few positions: popcounts are summed over shards, blocks and chunks."""
    rows = made_rows()
    for name, value in (("SHARD", 50), ("OPEN", 90), ("CHUNK", 3)):
        monkeypatch.setattr(C, name, value)
    laid, places = [], []
    for lang in {r[0] for r in rows}:
        place, words = C.layout(pa.array([t for g, t in rows if g == lang], pa.string()))
        laid += words.to_pylist()
        places.append(np.diff(place))
    assert all((p >= 1).all() and (p <= 2).all() for p in places)
    place, words = C.layout(pa.array([t for _, t in rows], pa.string()))
    coded = words.dictionary_encode()
    maps = C.Bitmaps(place, np.asarray(coded.indices, dtype=np.int64), int(place[-1]) + 1)
    assert sum(int(np.bitwise_count(maps.bits).sum()) for _ in (0,)) == len(place)
    got, names = Counter(), coded.dictionary.to_pylist()
    for said, n in C.phrases_of(maps):
        for *p, k in zip(*(w.tolist() for w in said), n.tolist(), strict=True):
            got[" ".join(names[w] for w in p)] += k
    plain = Counter()
    for _, t in rows:
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate({i: i + 32 for i in range(65, 91)})):
            ws = re.findall("[^ \t]+", piece)
            plain.update(" ".join(ws[i : i + k]) for k in (2, 3) for i in range(len(ws) - k + 1))
    assert got == plain


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.collocations(df).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "one", "en")], df.schema)).count() == 0


def test_scores_beyond_64_bits(spark):
    text = "aa bb " * 400_000
    df = spark.createDataFrame([(1, text, "en")] * 6, "doc_id long, text string, lang string")
    rows = {r.phrase: r for r in C.collocations(df).collect()}
    assert rows["aa bb aa"].a == 6 * 399_999 and all(r.score == 1000000 * r.a * r.a // (r.l * r.r) and 1000000 * r.a * r.a > 2**62 for r in rows.values())
