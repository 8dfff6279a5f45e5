"""Folding against the Unicode tables."""

import random
import unicodedata

from folioscope.functions import text as T


def plain(x):
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()


def test_folding_of_all_characters(spark):
    """Every assigned character, alone and within a word, and random texts of all kinds."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = [chr(c) for c in codes]
    rnd = random.Random(1)
    kinds = [texts[:600], [chr(c) for c in range(0xAC00, 0xAC00 + 11172)], [chr(c) for c in range(0x3200, 0x3400)], [chr(c) for c in range(0xFB00, 0xFE00)], texts]
    texts += ["".join(rnd.choices(rnd.choice(kinds) + ["a", " "], k=rnd.randint(0, 60))) for _ in range(2000)] + ["", "ABC é", "한국어 ㈱ ㎏ ㌀ ½ … ﬁn İstanbul"]
    texts = [x for x in texts if "Σ" not in x or len(x) == 1]  # a last sigma is lowered by what stands around it
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").repartition(4)
    wrong = [(texts[r.i], r.f) for r in df.select("i", T.fold("x").alias("f")).collect() if r.f != plain(texts[r.i])]
    assert not wrong, wrong[:20]
