"""The registered queries over their whole tables: those with SQL against it, others against their contract."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_tokens_packing import ids_of

from folioscope.llm import packing, queries, sharding, tokens


@pytest.fixture(scope="module")
def db(tables):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(spark, tables):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, tables, db, name):
    df = queries.queries()[name](spark, tables)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = db.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    assert found == sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=repr) and found


def test_op3(spark, tables, texts):
    out = sharding.op3_longest_processing_time(spark, tables).collect()
    assert {r.doc_id for r in out} == texts.keys() and len(out) == len(texts)
    shards, slots, loads, heaviest = defaultdict(set), defaultdict(list), Counter(), Counter()
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        shards[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        heaviest[texts[r.doc_id]] += r.size
    assert all(len(s) == 1 for s in shards.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    # the greedy bound: no shard is above the mean by more than the heaviest group
    assert max(loads.values()) <= sum(loads.values()) / 40 + max(heaviest.values())


def test_op5(spark, tables, texts):
    out = packing.op5_minimum_bin_slack(spark, tables).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for d, own in pieces.items():
        ids, at = ids_of(texts[d]), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist() and sum(r.length for r in own) <= 4096
    assert len(windows) <= -(-sum(r.length for r in out) // 4096) + 1


def test_op10(spark, tables, texts):
    out = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.op10_record_files(spark, tables).collect()}
    at, expected = 0, {}
    for d in sorted(texts):
        ids = ids_of(texts[d])
        expected[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert out == expected
