"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document's expected copies grow with its length, as words ** PULL, up to a limit, at
the scale that makes a source's expected words its target. The whole copies among them are certain; the fraction p is the
document's chance of one more. Documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and
the first ones are taken until their words fill what the certain copies leave of the target: samples of fixed size with
unequal chances. u comes from a hash of the document, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import cut, quoted, ranked, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: How expected copies grow with a document's words: 0 would take all documents alike.
PULL = 0.25
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random(doc_id: Column, source: Column, text: Column, seed: int = SEED) -> Column:
    """A document's random number in (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id.cast("long"), source, text), 11) + 0.5) / F.lit(float(1 << 53))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (_source, source_size; nulls last) with target: shares of the budget by weight, cut at `most` times the size, the excess reshared by weight until none is above."""
    places = ranked(sources.withColumn("_null", F.col("_source").isNull()), ["_all"], ["_null", "_source"], "_place")
    rows = cut(places.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))), "sources")
    budget = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    top = F.col("source_size") * most
    rate, full = 0.0, -1
    while True:
        over = top <= F.col("_w") * rate if full >= 0 else F.lit(False)
        n, taken, open_w = rows.agg(F.coalesce(F.sum(F.when(over, 1).otherwise(0)), F.lit(0)), F.coalesce(F.sum(F.when(over, top)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0))).first()
        if n == full or not open_w:
            break
        rate, full = (budget - taken) / open_w, n
    return rows.select("_source", "source_size", F.least(top, F.col("_w") * rate).alias("target"))


def expected(size: Column, scale: Column, most: float, pull: float) -> Column:
    """Expected copies; scale is null where all documents get the most."""
    return F.when(size == 0, 0.0).when(scale.isNull(), most).otherwise(F.least(F.lit(most), scale * F.pow(size, F.lit(pull))))


def whole_and_rest(copies: Column) -> tuple[Column, Column]:
    whole = F.floor(copies + 1e-9)
    return whole, F.greatest(F.lit(0.0), copies - whole)


def odds(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds."""
    return (u / (1 - u)) / (p / (1 - p))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, pull: float = PULL) -> DataFrame:
    """(_source, source_size, target, _scale, _last): of each source the scale of expected copies and the odds of the last document that is taken once more. rows: _source, _size, _u.

    Scales come from the sums of each length that occurs in a source; ranks are sums over ranges of the sorted rows, so no
    source is one task's work.
    """
    rows = cut(rows, "sizes")
    lengths = cut(rows.groupBy("_source", "_size").agg(F.sum("_size").alias("_words")), "lengths")
    sources = cut(lengths.groupBy("_source").agg(F.sum("_words").alias("source_size")).withColumn("_all", F.lit(0)), "sources")
    aims = targets(sources, weights, share, most)
    null_safe = lambda a, b: F.col(f"{a}._source").eqNullSafe(F.col(f"{b}._source"))
    force = F.pow("_size", F.lit(pull))
    down = Window.partitionBy("_source").orderBy(F.desc("_size"))
    full = lengths.where("_size > 0").withColumn("_above", F.sum("_words").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    full = full.withColumn("_below", F.coalesce(F.sum(F.col("_words") * force).over(down.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    # what the source would give if this length were the shortest that gets the most copies
    given = most * F.col("_above") + most / force * F.col("_below")
    capped = given <= F.col("target") * (1 + 1e-12)
    found = full.alias("f").join(aims.alias("a"), null_safe("f", "a")).select("f.*", "a.target").withColumn("_capped", capped)
    scales = found.groupBy("_source").agg(((F.max("target") - most * F.sum(F.when(F.col("_capped"), F.col("_words")).otherwise(0))) / F.sum(F.when(~F.col("_capped"), F.col("_words") * force))).alias("_scale"))
    aims = aims.alias("a").join(scales.alias("s"), null_safe("a", "s"), "left").select("a.*", "s._scale")
    whole, p = whole_and_rest(expected(F.col("_size"), F.col("_scale"), most, pull))
    certain = lengths.alias("l").join(aims.alias("a"), null_safe("l", "a")).select("l.*", "a._scale").groupBy("_source").agg(F.sum(whole * F.col("_words")).alias("_certain"))
    aims = cut(aims.alias("a").join(certain.alias("c"), null_safe("a", "c")).select("a.*", (F.col("a.target") - F.col("c._certain")).alias("_rest")), "aims")
    open_ = rows.alias("r").join(aims.alias("a"), null_safe("r", "a")).select("r.*", "a._scale", "a._rest").withColumn("_p", p).where("_p > 0")
    sums = ranked(cut(open_.select("_source", "_size", "_rest", odds(F.col("_u"), F.col("_p")).alias("_odds")), "odds"), ["_source"], ["_odds", "_size"], "_sum", "_size")
    last = sums.where(F.col("_sum") + F.col("_size") / 2 <= F.col("_rest")).groupBy("_source").agg(F.max("_odds").alias("_last"))
    return cut(aims.alias("a").join(last.alias("l"), null_safe("a", "l"), "left").select("a._source", "a.source_size", "a.target", "a._scale", "l._last"), "plan")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, pull: float = PULL, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(size, source_size, target, copies, taken, row): how often each document is taken. taken = copies * size; row is a struct of all its columns, whatever their names are.

    Null and empty texts have no words and are never taken. A null source is a source, and the last. Of a source's ranked
    documents the last one is taken if that brings the words nearer to the target. Equal rows have the same rank and are
    taken alike. No document is taken more than `most` times. Texts of any length count whole. Empty input: no rows.
    """
    text, source = quoted(text_col), quoted(source_col)
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), source.alias("_source"), n_words(text).alias("_size"), random(quoted(id_col), source, text, seed).alias("_u"))
    made = plan(rows.select("_source", "_size", "_u"), weights, share, most, pull)
    joined = rows.alias("r").join(made.alias("p"), F.col("r._source").eqNullSafe(F.col("p._source"))).select("r.row", "r._size", "r._u", "p.source_size", "p.target", "p._scale", "p._last")
    whole, p = whole_and_rest(expected(F.col("_size"), F.col("_scale"), most, pull))
    more = F.when((p > 0) & (odds(F.col("_u"), p) <= F.col("_last")), 1).otherwise(0)
    copies = (whole + more).cast("long")
    return joined.select(F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"), "row")


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mix(table(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", "taken")
