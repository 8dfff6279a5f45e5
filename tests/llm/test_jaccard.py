import numpy as np

from folioscope.llm import jaccard

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, word):
    sets = {}
    for r in rows:
        w = word.findall((r[1] or "").translate(UPPER))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force(docs, rows, word):
    expected = brute(rows, word)
    assert len({c for _, c in expected.values()}) < len(rows) - 10
    assert result(jaccard.join(docs)) == expected


def test_heavy_copies_and_repeats(spark, rows, word):
    many = [(10_000 + i, rows[3][1]) for i in range(80)] + [(r[0], r[1]) for r in rows[:20]]
    df = spark.createDataFrame([*many, many[0]], "doc_id long, text string")
    out = jaccard.join(df).collect()
    assert len(out) == len(many) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(many, word)


def test_cells_blocks_and_lone_sets(docs, rows, word, monkeypatch):
    """Buckets in many cells, clusters in many blocks, and larger sets whose signatures promise nothing: the same result."""
    for name, value in (("CELL", 3), ("FEW", 2), ("BLOCK", 3000), ("TOP", 1), ("MEET", 2), ("PLACES", 64)):
        monkeypatch.setattr(jaccard, name, value)
    assert result(jaccard.join(docs, slack=0.4)) == brute(rows, word)


def test_chains_over_blocks(spark, word, monkeypatch):
    """A cluster of sets that only a chain connects, and some that nothing does, over many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 4000)
    monkeypatch.setattr(jaccard, "MEET", 4)
    words = [f"c{i}" for i in range(400)]
    rows = [(1000 - i, " ".join(words[i * 3 : i * 3 + 100])) for i in range(100)] + [(2000 + i, " ".join([*words[:80], *(f"x{i}-{k}" for k in range(25))])) for i in range(15)]
    expected = brute(rows, word)
    assert len({c for _, c in expected.values()}) == 16
    assert result(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))) == expected


def test_crowded_buckets(spark, word, monkeypatch):
    """Buckets with far more probing sets than a cell holds: near copies, some of them only chained to others, and sets that share a passage and nothing else."""
    for name, value in (("CELL", 8), ("FEW", 3), ("TOP", 2), ("MEET", 6)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(90):
        near = list(base)
        near[int(rng.integers(0, 150))] = f"y{i}"
        rows.append((5000 - i, " ".join(near)))
    rows += [(100 + i, " ".join([*base[i * 2 :], *(f"z{k}" for k in range(i * 2))])) for i in range(60)]
    rows += [(8000 + i, " ".join([*base[:60], *(f"x{i}-{k}" for k in range(50))])) for i in range(40)]
    rows += [(9000 + i, " ".join([*(f"s{k}" for k in range(12)), f"t{i}"])) for i in range(50)]
    seen = []
    before = jaccard.crowds
    monkeypatch.setattr(jaccard, "crowds", lambda *x: seen.append(1) or before(*x))
    assert result(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, word)
    assert seen


def test_query_equals_brute_force(spark, tables, word):
    """The registered query over its whole table."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = jaccard.op4_universe_partition_join(spark, tables)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert result(out) == brute([(r.doc_id, r.text) for r in docs.collect()], word)


def test_empty_and_null_ids(spark, empty):
    assert jaccard.join(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()} == {(None, 2, None), (1, 2, 1), (2, 0, 2)}


def test_signatures_hold_their_promise():
    """Two sets that differ by as much as a link allows share a signature that one of them probes, or enough segments, or one is told to share none."""
    rng = np.random.default_rng(1)
    for n in (5, 9, 20, 63, 100, 130, 255, 300, 700):
        for _ in range(20):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            out = int(rng.integers(0, n // 9 + 1))
            b = np.concatenate([a[out:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 9 + 1)), dtype=np.uint64)])
            if 100 * (n - out) < 80 * len(np.union1d(a, b)):
                continue
            names, own = np.concatenate([np.sort(a), np.sort(b)]), np.repeat([0, 1], [len(a), len(b)])
            *found, lone = [np.concatenate(c) for c in zip(*jaccard.signed(own, names, np.array([len(a), len(b)])), strict=True)]
            if len(lone):
                continue
            mine = [{s: x for s, w, x in zip(*map(np.ndarray.tolist, found), strict=True) if w == k} for k in (0, 1)]
            both = mine[0].keys() & mine[1].keys()
            small = [s for s in both if mine[0][s] >> 31]
            if small:
                assert any(mine[k][s] & 1 for s in small for k in (0, 1))
            else:
                band = {s: mine[0][s] >> 26 for s in both}
                assert any(sum(band[s] == x for s in both) >= max(mine[k][s] & ((1 << 26) - 1) for s in both if band[s] == x) for x in set(band.values()) for k in (0, 1))
