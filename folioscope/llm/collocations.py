"""Phrase collocation mining with position bitmaps.

Texts are laid out in shards: one position for each word, an empty one between pieces. Within a shard every frequent word
has a compressed bitmap of its positions (the blocks of BITS positions that have any, with their bits). A phrase's bitmap,
shifted by one position and ANDed with the words' bitmaps, gives the bitmaps of all phrases that are longer by a word; the
empty positions end them at the piece's end. Phrases are extended depth-first, some first words at a time. Popcounts are
added up over the shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Dealer, cut, drop, let_go, mix, ranked, slices, table, targets_of, undealt

#: Positions of a shard, about: it is closed by the step of text that reaches them.
SHARD = 1 << 20
#: Positions that a task holds of all its open shards.
OPEN = 4 * SHARD
#: Positions that a block of a bitmap has.
BITS = 16
#: Entries of bitmaps that are extended at once. A bound on memory only.
CHUNK = 1 << 16
#: Bytes that end a piece (. , ; : ! ? and line ends), bytes that end a word.
PIECE_ENDS = [0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]
WORD_ENDS = [0x20, 0x09]
UNKNOWN = "und"
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[PIECE_ENDS] = True
ENDS_WORD = ENDS_PIECE.copy()
ENDS_WORD[WORD_ENDS] = True
#: Packed records of phrases: the ids of their words (NONE where there is none) and how often they occur.
PHRASES = [("a", "<u4"), ("b", "<u4"), ("c", "<u4"), ("n", "<u4")]
NONE = np.uint32(0xFFFFFFFF)
#: Parts into which a language's candidates are dealt for the first selection of the best.
PARTS = 64


def layout(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place of each word, words with A-Z in lower case) of the texts laid out one after the other: an empty place stands before each piece that has words. Null texts have none."""
    texts = pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    if not len(texts):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    edges = ends[1:-1] - ends[0]
    edges = edges[(edges > 0) & (edges < len(data))]
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~ENDS_WORD[data]
    step = np.diff(word)
    first, last = step[:-1] > 0, step[1:] < 0
    first[edges] = word[1:-1][edges] > 0  # where one text follows another, no word goes on
    last[edges - 1] = word[1:-1][edges - 1] > 0
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    breaks = ENDS_PIECE[data].astype(np.int32)
    breaks[edges] += 1
    piece = np.cumsum(breaks)[start]
    new = np.concatenate([[True], piece[1:] != piece[:-1]]) if len(start) else np.zeros(0, bool)
    place = np.arange(len(start)) + np.cumsum(new)
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    letters = data[word[1:-1] > 0]
    return place, pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))])


class Open:
    """An open shard of a language: what was laid out so far."""

    def __init__(self) -> None:
        self.size, self.places, self.codes, self.words = 0, [], [], []

    def add(self, place: np.ndarray, words: pa.Array) -> None:
        coded = words.dictionary_encode()
        self.places.append(place + self.size)
        self.codes.append(np.asarray(coded.indices, dtype=np.int64) + sum(map(len, self.words)))
        self.words.append(coded.dictionary)
        self.size += int(place[-1]) + 1

    def close(self) -> tuple[pa.Array, np.ndarray, bytes]:
        """(distinct words, how often each occurs, packed codes by place from 1 on, 0 where none is)."""
        coded = pa.concat_arrays(self.words).dictionary_encode()
        code = np.asarray(coded.indices, dtype=np.int64)[np.concatenate(self.codes)]
        line = np.zeros(self.size, np.uint32)
        line[np.concatenate(self.places)] = code + 1
        return coded.dictionary, np.bincount(code, minlength=len(coded.dictionary)), packed(line)


def packed(line: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(line.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(shard, lang, words, counts, line): the texts laid out by language; line holds the code of the word at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, Open] = {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal made
            words, counts, line = held.pop(lang).close()
            made += 1
            columns = [pa.array([(task << 32) + made]), pa.array([lang]), pa.array([words.cast(pa.string()).to_pylist()], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([line], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "lang", "words", "counts", "line"])

        for batch in batches:
            for part in slices(batch):
                langs = part.column("lang").dictionary_encode()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    place, words = layout(part.column("text").filter(pc.equal(langs.indices, k)))
                    if len(place):
                        held.setdefault(lang, Open()).add(place, words)
                        if held[lang].size >= SHARD:
                            yield close(lang)
                while sum(x.size for x in held.values()) > OPEN:
                    yield close(max(held, key=lambda x: held[x].size))
        for lang in list(held):
            yield close(lang)
        let_go()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "shard long, lang string, words array<string>, counts array<long>, line binary")


class Bitmaps:
    """Compressed position bitmaps of a shard's words, by word and by block.

    Word i has the entries bounds[i] to bounds[i + 1] of (block, bits); block j those of starts[j] to starts[j + 1] of (word_in, bits_in).
    """

    def __init__(self, place: np.ndarray, word: np.ndarray, size: int) -> None:
        order = np.argsort(word, kind="stable")
        place, word = place[order], word[order]
        self.words, numbers = np.unique(word, return_inverse=True)
        block, bit = place // BITS, np.left_shift(np.uint32(1), (place % BITS).astype(np.uint32))
        first = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (block[1:] != block[:-1])])) if len(place) else np.zeros(0, np.int64)
        self.number, self.block, self.bits = numbers[first], block[first], np.bitwise_or.reduceat(bit, first) if len(first) else bit
        self.bounds = np.searchsorted(self.number, np.arange(len(self.words) + 1))
        order = np.argsort(self.block, kind="stable")
        self.word_in, self.bits_in = self.number[order], self.bits[order]
        self.starts = np.searchsorted(self.block[order], np.arange(size // BITS + 3))

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(phrase, word, block, bits) of the phrases' bitmaps (entries of phrase, block, bits) shifted by a position and ANDed with each word's."""
        shifted = np.left_shift(bits, np.uint32(1))
        over, stay = np.right_shift(shifted, np.uint32(BITS)), shifted & np.uint32((1 << BITS) - 1)
        a, b = np.flatnonzero(stay), np.flatnonzero(over)
        phrase, block, bits = np.concatenate([phrase[a], phrase[b]]), np.concatenate([block[a], block[b] + 1]), np.concatenate([stay[a], over[b]])
        n = self.starts[block + 1] - self.starts[block]
        entry = np.repeat(np.arange(len(n)), n)
        other = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[block], n)
        both = bits[entry] & self.bits_in[other]
        kept = np.flatnonzero(both)
        entry = entry[kept]
        return phrase[entry], self.word_in[other[kept]], block[entry], both[kept]


def grown(maps: Bitmaps, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """All phrases longer by a word: (phrase extended, word added, popcount) of each, and the entries (phrase, block, bits) of their bitmaps."""
    before, word, block, bits = maps.extend(phrase, block, bits)
    order = np.lexsort((word, before))
    before, word, block, bits = before[order], word[order], block[order], bits[order]
    new = np.concatenate([[True], (before[1:] != before[:-1]) | (word[1:] != word[:-1])]) if len(before) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    n = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return before[first], word[first], n, np.cumsum(new) - 1, block, bits


def phrases_of(maps: Bitmaps, longest: int = 3) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(ids of the first, second ... words, popcounts) of all phrases of 2 to longest words, depth-first from some first words at a time."""
    at = 0
    while at < len(maps.words):
        to = max(at + 1, int(np.searchsorted(maps.bounds, maps.bounds[at] + CHUNK, side="right")) - 1)
        a, b = maps.bounds[at], maps.bounds[to]
        phrase, block, bits = maps.number[a:b] - at, maps.block[a:b], maps.bits[a:b]
        said = [np.arange(at, to)]
        for _ in range(longest - 1):
            before, word, n, phrase, block, bits = grown(maps, phrase, block, bits)
            said = [*(w[before] for w in said), word]
            yield [maps.words[w] for w in said], n
        at = to


def mine(located: DataFrame, targets: int, longest: int = 3) -> DataFrame:
    """Packed PHRASES of each shard (line, known [(code, id)]): ids are those of the frequent words, other places are empty."""
    if longest > len(PHRASES) - 1:
        raise ValueError(f"phrases have {len(PHRASES) - 1} words at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(PHRASES, targets)
        for batch in batches:
            for k in range(batch.num_rows):
                known = batch.column("known")[k].values
                line = unpacked(batch.column("line")[k].as_py())
                ids = np.zeros(int(line.max(initial=0)) + 1, np.int64)
                ids[np.asarray(known.field("code"), dtype=np.int64)] = np.asarray(known.field("id"), dtype=np.int64) + 1
                word = ids[line]
                place = np.flatnonzero(word)
                for said, n in phrases_of(Bitmaps(place, word[place] - 1, len(line)), longest):
                    ids_of = [w.astype(np.uint32) for w in said] + [np.full(len(n), NONE)] * (3 - len(said))
                    with np.errstate(over="ignore"):
                        key = mix(mix(ids_of[0].astype(np.uint64) << np.uint64(32) | ids_of[1].astype(np.uint64)) + ids_of[2].astype(np.uint64))
                    yield from dealer.add((key % np.uint64(targets)).astype(np.int32), *ids_of, n.astype(np.uint32))
        yield from dealer.flush()
        let_go()

    return located.select("line", "known").mapInArrow(run, Dealer.schema(PHRASES))


def summed(dealt: DataFrame, tasks: int, least: int) -> DataFrame:
    """(w1, w2, w3, a): word ids of the phrases that occur least times over all shards; w3 is null for two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, c, n in undealt(batches, PHRASES):
            order = np.lexsort((c, b, a))
            a, b, c, n = a[order], b[order], c[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
            n = np.add.reduceat(n, first)
            kept = first[n >= least]
            columns = [pa.array(a[kept].astype(np.int64)), pa.array(b[kept].astype(np.int64)), pa.array(c[kept].astype(np.int64), mask=c[kept] == NONE), pa.array(n[n >= least])]
            yield pa.RecordBatch.from_arrays(columns, ["w1", "w2", "w3", "a"])

    return dealt.repartition(tasks, "pid").sortWithinPartitions("pid").mapInArrow(run, "w1 long, w2 long, w3 long, a long")


def frequent(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals (lang, n), vocabulary (id, lang, word, f), phrases (w1, w2, w3, a)) of the words and phrases of 2 and 3 words that occur least times in their language."""
    spark = docs.sparkSession
    tasks, targets = targets_of(spark)
    laid = cut(shards(docs, text_col, lang_col), "shards")
    held = laid.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("shard", "lang", (F.col("at") + 1).alias("code"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counts = cut(held.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    often = counts.where(F.col("f") >= least).withColumn("order", -F.col("f")).withColumn("all", F.lit(0))
    vocabulary = cut(ranked(cut(often, "often"), ["all"], ["order", "lang", "word"], "id").select("id", "lang", "word", "f"), "vocabulary")
    # the frequent words that each shard has; at most all words of a shard
    known = held.drop("n").join(vocabulary.select("id", "lang", "word"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("code", "id")).alias("known"))
    found = cut(summed(mine(laid.select("shard", "line").join(known, "shard"), targets), tasks, least), "phrases")
    drop(laid)
    return counts.groupBy("lang").agg(F.sum("f").alias("n")), vocabulary, found


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, best: int | None = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 or 3 words that occur least times.

    score is floor(1000000 * a * a / (l * r)) at the cut where it is lowest, in decimals of 38 digits (exact for counts below
    10 ** 15). Phrases of which a longer one with covered percent of their occurrences is made go. Ranks follow score, a, and
    the phrase in the order of UTF-8 bytes. A null lang is und, and one with it; null and empty texts have no words; repeated rows count
    each; a text is read whole, however long; no rows give none. Of other columns none is looked at.
    """
    totals, vocabulary, found = frequent(docs, least, text_col, lang_col)
    words = vocabulary.select("id", F.col("f"))
    two = found.where("w3 IS NULL").drop("w3")
    three = found.where("w3 IS NOT NULL")
    named = lambda k, f: words.select(F.col("id").alias(f"w{k}"), F.col("f").alias(f))
    pair = lambda i, j, f: two.select(F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{j}"), F.col("a").alias(f))
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    rated = lambda l, r: F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * exact("a") * exact("a"), exact(l) * exact(r))
    one = two.join(named(1, "l"), "w1").join(named(2, "r"), "w2").withColumn("score", rated("l", "r")).withColumn("w3", F.lit(None).cast("long"))
    covering = three.select(F.explode(F.array(F.struct("w1", "w2", "a"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))).alias("p")).select("p.*").groupBy("w1", "w2").agg(F.max("a").alias("most"))
    one = one.join(covering, ["w1", "w2"], "left").where(F.coalesce(F.col("most") * 100 < F.col("a") * covered, F.lit(True))).drop("most")
    cuts = three.join(named(1, "l1"), "w1").join(pair(2, 3, "r1"), ["w2", "w3"]).join(pair(1, 2, "l2"), ["w1", "w2"]).join(named(3, "r2"), "w3")
    cuts = cuts.withColumn("s1", rated("l1", "r1")).withColumn("s2", rated("l2", "r2"))
    early = F.col("s1") <= F.col("s2")
    more = cuts.select("w1", "w2", "w3", "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    every = one.select(*more.columns).unionByName(more)
    spelled = every.join(vocabulary.select(F.col("id").alias("w1"), "lang", F.col("word").alias("x1")), "w1").join(vocabulary.select(F.col("id").alias("w2"), F.col("word").alias("x2")), "w2")
    spelled = spelled.join(vocabulary.select(F.col("id").alias("w3"), F.col("word").alias("x3")), "w3", "left").withColumn("phrase", F.concat_ws(" ", "x1", "x2", "x3"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    if best is not None:  # the best of each part first, so that no task gets all of a language
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        spelled = spelled.withColumn("part", part).withColumn("rank", rank("lang", "part")).where(F.col("rank") <= best)
        spelled = spelled.withColumn("rank", rank("lang")).where(F.col("rank") <= best)
    else:
        spelled = ranked(cut(spelled.withColumn("s", -F.col("score")).withColumn("m", -F.col("a")), "spelled"), ["lang"], ["s", "m", "phrase"], "rank").withColumn("rank", F.col("rank") + 1)
    return spelled.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_position_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, CAST(k AS BIGINT) AS k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
s AS (SELECT f.lang, f.k, phrase, a, i, string_split(phrase, ' ') AS ws FROM f, (SELECT unnest([1, 2]) AS i) WHERE i < f.k),
c AS (SELECT s.lang, s.k, s.phrase, s.a, s.i, x.a AS l, y.a AS r, CAST(1000000::HUGEINT * s.a * s.a // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM s JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(s.ws[1:i], ' ') JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(s.ws[i + 1:], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS o FROM c) WHERE o = 1),
inside AS (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM s WHERE k = 3 AND i = 1 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM s WHERE k = 3 AND i = 1),
kept AS (SELECT b.* FROM b ANTI JOIN (SELECT b.lang, b.phrase FROM b JOIN inside ON inside.lang = b.lang AND inside.phrase = b.phrase WHERE b.k = 2 AND 100 * inside.a >= 50 * b.a) x USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""
