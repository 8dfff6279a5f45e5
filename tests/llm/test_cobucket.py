"""The co-bucketed pair against a brute-force version: files, order, lineage, and what remains in the folder."""

import datetime as dt
import glob
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from folioscope.llm import cobucket
from folioscope.llm.common import new_path

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, from_file int"
LINES = "sale_id long, line_no int, item_id long, flag string, to_bucket string"


def order(row, key):
    """Sort key of a row: the key descending, the rest ascending, nulls first."""
    low = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    k = row[key]
    return ((k is not None, -k if k is not None else 0), *(low(v) for i, v in enumerate(row) if i != key))


def brute(sales, lines, item):
    """{(table, bucket): (sorted rows, lineage, rewritten)} and the pairs of each bucket."""
    crc = lambda s: zlib.crc32(s.encode())
    known = Counter(r[0] for r in sales if r[0] is not None)

    def bucket(x, orphans):
        return 601 if x is None else 600 if orphans and x not in known else crc(f"s{x}") % 600

    out, pairs = {}, Counter()
    for name, rows in (("sales", sales), ("sale_lines", lines)):
        start, final, starts = defaultdict(list), defaultdict(list), Counter()
        for r in rows:
            b = bucket(r[0], name == "sale_lines")
            s = (b - (b % 4 == 1)) if name == "sales" else 0 if r[item] is None else crc(str(r[item])) % 600
            start[s].append(b)
            final[b].append(r)
            starts[b, s] += 1
            if name == "sale_lines":
                pairs[b] += known[r[0]] if r[0] is not None else 0
        for b, own in final.items():
            from_ = sorted((s, n) for (k, s), n in starts.items() if k == b)
            stays = len(from_) == 1 and set(start[from_[0][0]]) == {b}
            out[name, b] = sorted(own, key=lambda r: order(r, 0)), ",".join(f"{s}:{n}" for s, n in from_), not stays
    return out, pairs


def held_to(found, expected, pairs, columns, folder):
    assert {(r.table_name, r.bucket) for r in found} == expected.keys() and len(found) == len(expected)
    for r in found:
        rows, lineage, rewritten = expected[r.table_name, r.bucket]
        assert r.columns == ",".join(columns[r.table_name]) and (r.n_rows, r.rewritten, r.n_joined) == (len(rows), rewritten, pairs[r.bucket] if r.bucket < 600 else 0)
        assert r.ids_sha256 == hashlib.sha256(",".join("" if x[0] is None else str(x[0]) for x in rows).encode()).hexdigest()
        assert r.lineage_sha256 == hashlib.sha256(lineage.encode()).hexdigest()
        file = pq.ParquetFile(r.path.removeprefix("file:")).read()
        assert file.column_names == columns[r.table_name] and [tuple(x.values()) for x in file.to_pylist()] == rows
    assert sorted(glob.glob(f"{folder.removeprefix('file:')}/**/*.*", recursive=True)) == sorted(r.path.removeprefix("file://").removeprefix("file:") for r in found)


def made():
    rnd = random.Random(4)
    day = dt.datetime(2024, 1, 1)
    sales = [(i, rnd.choice([1, 2, None]), rnd.choice(["open", "é", "z", None]), rnd.choice([1.5, -2.0, None]), rnd.choice([day, None]), rnd.randint(0, 2)) for i in rnd.sample(range(-50, 5000), 900)]
    sales += [sales[0]] * 2 + [(None, 1, "x", 0.0, None, 1), (None, None, None, None, None, None)]
    ids = [s[0] for s in sales]
    hot = ids[5]
    lines = [(rnd.choice([*ids, hot, hot, 10**12, 77777, None]), rnd.randint(1, 3), rnd.choice([1, 2, 3, 50, None]), rnd.choice(["kept", "swapped", "ß", "Z", None]), rnd.choice("ab")) for _ in range(900)]
    lines += [(hot, 1, 1, "kept", "a")] * 400 + [(-(2**63), None, 9, None, None), (2**63 - 1, 1, 2, "", "")]
    return sales, lines


@pytest.mark.parametrize("partitions", [3, 700])
def test_equals_brute_force(spark, partitions):
    sales, lines = made()
    a, b = spark.createDataFrame(sales, SALES).repartition(3), spark.createDataFrame(lines, LINES).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        folder = new_path(spark, "pair")
        found = cobucket.co_bucket(a, b, folder, "sale_id", "item_id", ("sales", "sale_lines")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    held_to(found, *brute(sales, lines, 2), {"sales": a.columns, "sale_lines": b.columns}, folder.removeprefix("file://"))
    assert {r.rewritten for r in found} == {True, False}


def test_the_query(spark, tables):
    a, b = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("sales", "sale_lines"))
    found = cobucket.op11_co_bucketed_pair(spark, tables).collect()
    folder = found[0].path.removeprefix("file://").removeprefix("file:").rsplit("/", 4)[0]
    held_to(found, *brute([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()], b.columns.index("item_id")), {"sales": a.columns, "sale_lines": b.columns}, folder)


def test_empty_tables(spark):
    a, b = spark.createDataFrame([], SALES), spark.createDataFrame([], LINES)
    assert cobucket.co_bucket(a, b, new_path(spark, "pair"), "sale_id", "item_id", ("sales", "sale_lines")).count() == 0
    lines = spark.createDataFrame([(1, 1, 1, "x", "y"), (None, 2, 2, "x", "y")], LINES)
    found = cobucket.co_bucket(a, lines, new_path(spark, "pair"), "sale_id", "item_id", ("sales", "sale_lines")).collect()
    assert sorted((r.table_name, r.bucket, r.n_rows, r.n_joined, r.rewritten) for r in found) == [("sale_lines", 600, 1, 0, False), ("sale_lines", 601, 1, 0, False)]


def test_filter(spark):
    """No key that was added is ruled out; of others few are. With far more keys than bits it rules nothing out."""
    keys = spark.range(-500, 200_000).withColumnRenamed("id", "k").repartition(9)
    bits = cobucket.bloom(keys, "k")
    held = cobucket.may_hold(spark, bits)
    assert keys.where(held("k")).count() == keys.count()
    assert spark.range(10**9, 10**9 + 100_000).where(held("id")).count() < 1000
    full = cobucket.may_hold(spark, np.full_like(bits, 255))
    assert spark.range(100).where(full("id")).count() == 100
