"""Audits of conversions: no word, comma or sign lost or added."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import shared
from folioscope.functions import rules
from folioscope.functions.text import WORD, deligature

#: Words of pairs that are compared at once. A bound on memory only.
STEP_WORDS = 1 << 18


def clean(text: Column) -> Column:
    """Text without what conversions drop on purpose: ligatures, card marks, print footers, URLs, page numbers, ordinal marks."""
    x = deligature(text)
    for pattern in (rules.CARD_MARK, rules.PRINT_FOOTER, rules.URL, rules.RECORD_MARK, rules.PAGE_OF):
        x = F.regexp_replace(x, pattern, " ")
    return F.replace(F.replace(x, F.lit("º"), F.lit(" ")), F.lit("ª"), F.lit(" "))


def cleaned(pairs: DataFrame) -> DataFrame:
    """(doc, alike, s, m): whether both sides are the same text, and their clean texts; of a pair that is alike only s. Texts are cleaned here and nowhere else: as rows of a generator, which plans don't work out again wherever they are used."""
    alike = F.coalesce(F.col("source") == F.col("made"), F.lit(False))
    both = F.struct(alike.alias("alike"), clean(F.col("source")).alias("s"), F.when(~alike, clean(F.col("made"))).alias("m"))
    return pairs.select("doc", F.explode(F.array(both)).alias("x")).select("doc", "x.alike", "x.s", "x.m")


def word_list(text: Column) -> Column:
    """Words of a clean text in lower case (ß as ss), accents kept but for the word that headings are written with."""
    found = F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda w: F.when(w == "artículo", "articulo").otherwise(w))


def fingerprint(words: Column) -> Column:
    """(how many, two sums of hashes) of words, whatever their order; different multisets hardly ever share it, equal ones always do."""
    half = lambda h: F.struct(F.shiftrightunsigned(h, 32).alias("a"), h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"))
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    sums = F.aggregate(F.transform(words, lambda w: half(F.xxhash64(w))), zero, lambda s, x: F.struct((s["a"] + x["a"]).alias("a"), (s["b"] + x["b"]).alias("b")))
    return F.struct(F.size(words).alias("n"), sums.alias("sums"))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """(doc, columns): each worked out once for a row, as rows of a generator, however often it is used afterwards."""
    return rows.select("doc", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("x")).select("doc", "x.*")


def words_alike(a: Column, b: Column) -> Column:
    """Whether two lists hold the same words, each as often: by how many there are, by fingerprints, and where these agree by the sorted words."""
    return F.when(a == b, True).when(F.size(a) != F.size(b), False).when(fingerprint(a) != fingerprint(b), False).otherwise(F.sort_array(a) == F.sort_array(b))


def differing(pairs: DataFrame) -> DataFrame:
    """(doc, a, b): the words of both sides of the pairs whose multisets of words differ. Told within the row; sides that are the same text aren't looked into."""
    texts = cleaned(pairs.where(~F.coalesce(F.col("source") == F.col("made"), F.lit(False))))
    both = once(texts, a=word_list(F.col("s")), b=word_list(F.col("m")))
    return both.where(~F.coalesce(words_alike(F.col("a"), F.col("b")), F.lit(False)))


def word_differences(pairs: DataFrame) -> DataFrame:
    """(doc, word, lost, added) of pairs (doc, source, made): how often a word is only in one of them. Only words that differ; only these are shuffled, so that repeated docs are added up."""
    sides = differing(pairs)
    kind = pairs.schema["doc"].dataType.simpleString()
    each = sides.mapInArrow(own_differences, f"doc {kind}, word string, d long")
    sums = each.groupBy("doc", "word").agg(F.sum("d").alias("d"))
    return sums.where("d <> 0").select("doc", "word", F.greatest("d", F.lit(0)).cast("long").alias("lost"), F.greatest(-F.col("d"), F.lit(0)).cast("long").alias("added"))


def own_differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, word, d) of rows (doc, a, b): how often more a word is in a than in b, where that isn't 0; for some words at a time."""
    for batch in batches:
        sizes = sum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(c)), 0), dtype=np.int64) for c in ("a", "b"))
        part, at = np.cumsum(sizes) // STEP_WORDS, 0
        for to in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]:
            if to > at:
                some, at = batch.slice(at, to - at), to
                rows, sign, words = [], [], []
                for c, s in (("a", 1), ("b", -1)):
                    lists = some.column(c)
                    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
                    rows.append(np.repeat(np.arange(len(n)), n))
                    sign.append(np.full(int(n.sum()), s))
                    words.append(lists.flatten())
                coded = pa.concat_arrays(words).dictionary_encode()
                key, of = np.unique(np.concatenate(rows) * max(len(coded.dictionary), 1) + np.asarray(coded.indices, dtype=np.int64), return_inverse=True)
                d = np.bincount(of, weights=np.concatenate(sign), minlength=len(key)).astype(np.int64)
                row, word = np.divmod(key[d != 0], max(len(coded.dictionary), 1))
                yield pa.RecordBatch.from_arrays([some.column("doc").take(pa.array(row)), coded.dictionary.take(pa.array(word)), pa.array(d[d != 0])], ["doc", "word", "d"])
    shared.let_go()


def commas(text: Column) -> Column:
    """How many a clean text has."""
    return (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))).cast("long")


def comma_census(pairs: DataFrame) -> DataFrame:
    """(doc, source_commas, made_commas, ok)."""
    both = once(cleaned(pairs), a=commas(F.col("s")), b=F.when(~F.col("alike"), commas(F.col("m"))), alike=F.col("alike"))
    b = F.when(F.col("alike"), F.col("a")).otherwise(F.col("b"))
    return both.select("doc", F.col("a").alias("source_commas"), b.alias("made_commas"), (F.col("a") == b).alias("ok"))


def signs(text: Column) -> Column:
    """The body's punctuation marks in a clean text, in order."""
    return F.regexp_replace(text, "[^" + rules.BODY_PUNCTUATION + "]+", "")


def sign_census(pairs: DataFrame) -> DataFrame:
    """(doc, sign, in_source, in_made) of the body's punctuation marks that occur. Counted within the row; repeated docs are added up."""
    both = once(cleaned(pairs), a=F.coalesce(signs(F.col("s")), F.lit("")), b=F.coalesce(signs(F.col("m")), F.lit("")), alike=F.col("alike"))
    n = lambda c, sign: (F.length(c) - F.length(F.replace(F.col(c), F.lit(sign), F.lit("")))).cast("long")
    each = F.array(*[F.struct(F.lit(x).alias("sign"), n("a", x).alias("a"), F.when(F.col("alike"), n("a", x)).otherwise(n("b", x)).alias("b")) for x in rules.BODY_PUNCTUATION])
    rows = both.select("doc", F.explode(F.filter(each, lambda x: x["a"] + x["b"] > 0)).alias("x")).select("doc", "x.*")
    return rows.groupBy("doc", "sign").agg(F.sum("a").alias("in_source"), F.sum("b").alias("in_made"))


def verdict(pairs: DataFrame) -> DataFrame:
    """(doc, words_ok, commas_ok, signs_ok, ok) for every pair, told within its row; of sides that are the same text nothing is looked into."""
    alike = F.coalesce(F.col("source") == F.col("made"), F.lit(False))
    yes = F.lit(True)
    same = pairs.where(alike).select("doc", yes.alias("words_ok"), yes.alias("commas_ok"), yes.alias("signs_ok"))
    x = {f"{k}_{side}": f(F.col(side)) for k, f in (("words", lambda c: F.coalesce(word_list(c), F.array().cast("array<string>"))), ("commas", commas), ("signs", lambda c: F.coalesce(signs(c), F.lit("")))) for side in ("s", "m")}
    made = once(cleaned(pairs.where(~alike)), **x)
    sorted_signs = lambda side: F.sort_array(F.split(f"signs_{side}", ""))
    signs_ok = F.when(F.col("signs_s") == F.col("signs_m"), True).otherwise(sorted_signs("s") == sorted_signs("m"))
    other = made.select("doc", words_alike(F.col("words_s"), F.col("words_m")).alias("words_ok"), (F.col("commas_s") == F.col("commas_m")).alias("commas_ok"), signs_ok.alias("signs_ok"))
    return same.unionByName(other).withColumn("ok", F.col("words_ok") & F.col("commas_ok") & F.col("signs_ok"))


def result(verdicts: DataFrame) -> DataFrame:
    """One row: (documents, good, ok)."""
    return verdicts.agg(F.count("*").alias("documents"), F.count(F.when(F.col("ok"), 1)).alias("good"), F.coalesce(F.every("ok"), F.lit(True)).alias("ok"))
