"""A quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, a linear hinge loss fitted by dual coordinate descent.

Features of a text are indicators of its words, word pairs and triples of word shapes (cases, digits, signs, and
whether a word repeats the one before), hashed to 2^18 numbers. r is the log of the smoothed shares of the two classes
that a feature has; a text's vector is r at its features, at length 1. A sigmoid, fitted on held-back rows of the
sample and weighted to the labels' shares, turns margins into scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import hash_words, mix, owners, quoted, slices, split_words, table

BITS = 18
#: Labelled rows of each class that the classifier is fitted on, at most; they are the first by a hash of doc_id.
SAMPLE = 4000
THRESHOLD = 0.3
SMOOTHING = 1.0
COST = 10.0
ROUNDS = 12
FOLDS = 5


@dataclass(frozen=True)
class Model:
    """ratio: log-count ratios; weight: of the scaled features; margin = bias + weight . x; score = 1 / (1 + exp(-(a * margin + b)))."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    a: float
    b: float


def shapes(words: pa.Array) -> np.ndarray:
    """A number for each word's shape."""
    s = pc.replace_substring_regex(words, r"\p{Ll}+", "a")
    s = pc.replace_substring_regex(s, r"\p{Lu}+", "A")
    s = pc.replace_substring_regex(s, r"[0-9]+", "0").dictionary_encode()
    return hash_words(s.dictionary, 7)[np.asarray(s.indices)]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of each distinct feature of each text, in order. Null and empty texts have none."""
    bounds, codes, words = split_words(texts)
    n, own = len(codes), owners(bounds)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, shape = hash_words(pc.utf8_lower(words))[codes], shapes(words)[codes]
    two = own[1:] == own[:-1] if n > 1 else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        repeats = np.concatenate([[False], two & (h[1:] == h[:-1])])
        shape = mix(shape + repeats.astype(np.uint64) * np.uint64(0x51AFD7ED558CCD25))
        pairs = mix(h[:-1] * np.uint64(3) + h[1:])[two]
        three = two[:-1] & two[1:]
        triples = mix(shape[:-2] * np.uint64(5) + shape[1:-1] * np.uint64(3) + shape[2:])[three] if n > 2 else np.zeros(0, np.uint64)
    every = np.concatenate([mix(h), pairs, triples]) >> np.uint64(64 - BITS)
    keys = np.concatenate([own, own[1:][two], own[2:][three] if n > 2 else own[:0]]) << BITS | every.astype(np.int64)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys >> BITS, keys & ((1 << BITS) - 1)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.full((2, 1 << BITS), SMOOTHING)
    for f, label in zip(rows, y, strict=True):
        counts[int(label)][f] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum cost * hinge: one dual variable at a time, in a shuffled order with a fixed seed."""
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    sign, square = np.where(y > 0, 1.0, -1.0), np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(3)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            f, v = rows[i], values[i]
            slope = sign[i] * (w[f] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[f] += step * v
                bias += step
                moved = max(moved, abs(step) / cost[i])
        if moved < 1e-3:
            break
    return w, bias


def sigmoid_fit(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * margin + b))) by Newton steps with smoothed targets."""
    pos, neg = weight[y > 0].sum(), weight[y <= 0].sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, math.log((pos + 1) / (neg + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, s = weight * (p - target), weight * p * (1 - p) + 1e-9
        ga, gb = g @ margins + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = s @ margins**2 + 1e-3, s @ margins, s.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - max(-2.0, min(2.0, da)), b - max(-2.0, min(2.0, db))
        if abs(da) + abs(db) < 1e-7:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], y: np.ndarray, share: tuple[float, float]) -> Model:
    """A model of the rows (sorted feature numbers) and labels; share: the classes' counts among all labels.

    With one class only, or no rows, every score is that class's (no rows: 1), as nothing tells documents apart.
    """
    if len(set(y.tolist())) < 2:
        only = 1.0 if not len(y) or y[0] > 0 else 0.0
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0, 6.0 if only else -6.0)
    weight = np.array([share[int(k)] / max(1, int((y == k).sum())) for k in y])
    weight /= weight.mean()

    def trained(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        some = [rows[i] for i in own]
        ratio = log_count_ratios(some, y[own])
        values = [scaled(ratio[f]) for f in some]
        return (ratio, *descend(some, values, y[own], np.full(len(own), COST)))

    back = np.arange(len(y)) % FOLDS == 0
    if len(set(y[~back].tolist())) < 2 or not back.any():
        back = np.zeros(len(y), bool)
    ratio, w, bias = trained(np.flatnonzero(~back))
    held = np.flatnonzero(back) if back.any() else np.arange(len(y))
    margins = np.array([bias + float(w[rows[i]] @ scaled(ratio[rows[i]])) for i in held])
    a, b = sigmoid_fit(margins, y[held], weight[held])
    return Model(ratio, w, bias, a, b)


def scaled(v: np.ndarray) -> np.ndarray:
    n = math.sqrt(float(v @ v))
    return v / n if n else v


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    own, f = features(texts)
    r = model.ratio[f]
    dots = np.bincount(own, r * model.weight[f], minlength=len(texts))
    norms = np.sqrt(np.bincount(own, r * r, minlength=len(texts)))
    margins = model.bias + dots / np.where(norms > 0, norms, 1.0)
    return 1 / (1 + np.exp(-np.clip(model.a * margins + model.b, -35, 35)))


def is_held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled documents of each class whose remainder isn't held out.

    The sample's ids (a bounded number) are broadcast to the scan; its features go to one task, which fits the model.
    Rows with a null id or label, or a label other than 0 and 1, are left out; of a document's labels the smallest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = {int(q): int(c) for q, c in known.groupBy("quality").count().collect()}
    first = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(first[0].unionByName(first[1])), "doc_id")
    share = (n.get(0, 0), n.get(1, 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own, f = features(part.column("text"))
                ends = np.searchsorted(own, np.arange(part.num_rows + 1))
                packed = [f[a:b].astype("<i4").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(packed, pa.binary())], ["doc_id", "quality", "f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, q, f) for b in batches for d, q, f in zip(*(b.column(c).to_pylist() for c in ("doc_id", "quality", "f")), strict=True))
        m = fit([np.frombuffer(f, "<i4") for _, _, f in rows], np.array([q for _, q, _ in rows], dtype=np.int64), share)
        yield pa.RecordBatch.from_arrays([pa.array([m.ratio.astype("<f4").tobytes()]), pa.array([m.weight.astype("<f4").tobytes()]), pa.array([m.bias]), pa.array([m.a]), pa.array([m.b])], ["ratio", "weight", "bias", "a", "b"])

    packed = picked.mapInArrow(pack, "doc_id long, quality int, f binary")
    row = packed.repartition(1).mapInArrow(learn, "ratio binary, weight binary, bias double, a double, b double").first()
    if row is None:
        return fit([], np.zeros(0, np.int64), share)
    return Model(np.frombuffer(row.ratio, "<f4").astype(float), np.frombuffer(row.weight, "<f4").astype(float), row.bias, row.a, row.b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(score, row): each document's place in 0 to 1, and a struct of all its columns, whatever their names are. Only text is looked at, whole; null texts score like empty ones, equal texts equally."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[quoted(c) for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(scores(shared.value, part.column("text"))), part.column("row")], ["score", "row"])

    return rows.mapInArrow(run, T.StructType([T.StructField("score", T.DoubleType()), rows.schema["row"]]))


def op2_naive_bayes_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score. A row with a null id has no remainder: it isn't held out, and never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", F.coalesce(is_held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
