"""Text as column expressions. All of it stays in the JVM; nothing here is a UDF."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \s, \w and \b know ASCII only unless (?U) is given.
SPACES = r"(?U)\s+"
EDGES = r"(?U)^\s+|\s+$"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
WORD = r"(?U)\w+"
FEATURE_WORD = "[a-z0-9]+"
#: Python's line ends.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLANK_LINES = r"\n(?U)\s*\n"
#: Typographic ligatures and their letters: fixed values.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


#: Hangul: the first syllable, how many there are, and how many vowels times tails, and tails (none is one) it has.
HANGUL, SYLLABLES, VOWELS_TAILS, TAILS = 0xAC00, 11172, 588, 28
JAMO = tuple("".join(map(chr, range(first, first + n))) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


@dataclass(frozen=True)
class Folding:
    """Characters that fold to one (src to dst; what is beyond dst's end folds to nothing), those that fold to several, and patterns of the latter."""

    src: str
    dst: str
    keys: str
    values: str
    pattern: str
    coarse: str


@cache
def folding() -> Folding:
    """Compatibility decomposition without marks in lower case, from the Unicode tables; of Hangul only the pattern, as syllables are worked out."""
    one, several, none = {}, {}, []
    for code in (*range(0x80, 0xAC00), *range(0xF900, 0x32000), *range(0xE0000, 0xE0200)):  # beyond these, characters are what they fold to
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if plain == "":
            none.append(c)
        elif len(plain) == 1 and plain != c:
            one[c] = plain
        elif len(plain) > 1:
            several[c] = plain
    ranges: list[list[int]] = []
    for code in sorted([*map(ord, several), HANGUL, HANGUL + SYLLABLES - 1]):
        if ranges and (code == ranges[-1][1] + 1 or code == HANGUL + SYLLABLES - 1):
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    in_class = lambda some: "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in some)
    coarse = [r for r in ranges if r[1] < 0x250] + [[0x250, 0x200F], [0x2025, 0x10FFFF]]
    return Folding("".join(one) + "".join(none), "".join(one.values()), "".join(several), "\0".join(several.values()), f"[{in_class(ranges)}]", f"[{in_class(coarse)}]")


def fold(x: Column) -> Column:
    """Lower case without diacritics; compatibility characters as their letters, Hangul syllables as theirs.

    ASCII texts are only lowered. Each distinct character of a text that stands for several letters is looked up once and
    replaced; most texts have none, which a pattern of few ranges tells. All other characters are translated at once.
    """
    return _folded(_lowered(x))


def _lowered(x: Column) -> Column:
    # the one capital whose small letter folds to another letter than it does itself
    return F.lower(F.replace(x, F.lit("\u03f9"), F.lit("\u03c3")))


def _folded(x: Column) -> Column:
    """fold() of lowered text."""
    f = folding()

    def letters(c: Column) -> Column:
        n = F.ascii(c) - HANGUL
        lead, vowel, tail = (n / VOWELS_TAILS).cast("int"), (n % VOWELS_TAILS / TAILS).cast("int"), n % TAILS
        jamo = lambda k, i: F.substring(F.lit(JAMO[k]), i, F.lit(1))
        hangul = F.concat(jamo(0, lead + 1), jamo(1, vowel + 1), F.when(tail > 0, jamo(2, tail)).otherwise(""))
        known = F.element_at(F.split(F.lit(f.values), "\0"), F.greatest(F.instr(F.lit(f.keys), c), F.lit(1)))
        return F.when((n >= 0) & (n < SYLLABLES), hangul).otherwise(known)

    odd = F.array_distinct(F.regexp_extract_all(x, F.lit(f.pattern), F.lit(0)))
    spelled = F.aggregate(odd, x, lambda text, c: F.replace(text, c, letters(c)))
    return F.when(F.octet_length(x) == F.length(x), x).otherwise(F.translate(F.when(x.rlike(f.coarse), spelled).otherwise(x), f.src, f.dst))


def collapse(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(x, SPACES, " "))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, EDGES, "")


def deligature(x: Column) -> Column:
    for c, letters in LIGATURES.items():
        x = F.replace(x, F.lit(c), F.lit(letters))
    return x


def excerpt(x: Column, n: int) -> Column:
    """The collapsed text, cut after n characters with an ellipsis."""
    flat = collapse(x)
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n), F.lit(" …")))


def tokens(x: Column) -> Column:
    """Terms of the full-text index."""
    return F.regexp_extract_all(fold(x), F.lit(TOKEN), F.lit(0))


def tokens_each(*xs: Column) -> Column:
    """The terms of each text, as an array of arrays. All texts go through one expression: folding holds tables of some thousand characters, which plans and their descriptions repeat wherever it stands."""
    return F.transform(F.transform(F.array(*xs), _lowered), lambda x: F.regexp_extract_all(_folded(x), F.lit(TOKEN), F.lit(0)))


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(WORD), F.lit(0))


def features(x: Column) -> Column:
    """Words as w:word, and for words of five letters or more the 4-grams of #word# as c:gram."""
    found = F.regexp_extract_all(fold(x), F.lit(FEATURE_WORD), F.lit(0))

    def grams(w: Column) -> Column:
        marked = F.concat(F.lit("#"), w, F.lit("#"))
        made = F.transform(F.sequence(F.lit(1), F.length(marked) - 3), lambda i: F.concat(F.lit("c:"), F.substring(marked, i, F.lit(4))))
        return F.when(F.length(w) >= 5, made).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(found, lambda w: F.concat(F.array(F.concat(F.lit("w:"), w)), grams(w))))


def feature_hash(feature: Column, dimensions: int = 1 << 20) -> Column:
    return (F.crc32(feature.cast("binary")) % dimensions).cast("int")


def focus(query: Column, text: Column, head: int = 900, window: int = 900, step: int = 250) -> Column:
    """Long texts as their head and the first window of those that hold most of the query's words (folded, over two letters, found anywhere).

    The text is folded once: the folded text and the words go through the windows as the state of a fold, as an expression
    that a lambda repeats is worked out again for every element.
    """
    asked = F.filter(F.array_distinct(words(fold(query))), lambda t: F.length(t) > 2)
    places = F.sequence(F.lit(head), F.greatest(F.length(text) - window, F.lit(head)), F.lit(step))
    start = F.struct(F.lit(-1).alias("s"), F.lit(head).alias("i"), fold(text).alias("t"), asked.alias("q"))

    def better(best: Column, i: Column) -> Column:
        here = F.struct(F.substring(best["t"], i + 1, F.lit(window)).alias("w"))
        score = F.aggregate(best["q"], F.struct(F.lit(0).alias("n"), here["w"].alias("w")), lambda a, t: F.struct((a["n"] + F.when(F.instr(a["w"], t) > 0, 1).otherwise(0)).alias("n"), a["w"].alias("w")), lambda a: a["n"])
        return F.transform(F.array(score), lambda s: F.struct(F.greatest(s, best["s"]).alias("s"), F.when(s > best["s"], i).otherwise(best["i"]).alias("i"), best["t"].alias("t"), best["q"].alias("q")))[0]

    at = F.aggregate(places, start, better, lambda best: best["i"])
    return F.when(F.length(text) <= head + window, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(" … "), F.substring(text, at + 1, F.lit(window))))


def slug(name: Column) -> Column:
    """A file name as lower-case words joined by hyphens."""
    x = F.replace(F.lower(name), F.lit("cdigo"), F.lit("codigo"))
    x = F.regexp_replace(F.translate(x, "áéíóú", "aeiou"), r"\(.*?\)", "")
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def article_key(article: Column) -> Column:
    """Orders articles by their leading number (9999 without one), then by themselves."""
    number = F.nullif(F.regexp_extract(article, r"^\d+", 0), F.lit("")).cast("int")
    return F.struct(F.coalesce(number, F.lit(9999)).alias("n"), article.alias("a"))


def article_label(number: Column, suffix: Column) -> Column:
    """Digits as they are, other numbers capitalised; a suffix in lower case after a space."""
    n = F.when(number.rlike(r"^\d+$"), number).otherwise(F.concat(F.upper(F.substring(number, 1, 1)), F.lower(F.substr(number, F.lit(2)))))
    return F.when(F.coalesce(suffix, F.lit("")) == "", n).otherwise(F.concat(n, F.lit(" "), F.lower(suffix)))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, halves to the even number."""
    return token_count(F.length(text))


def token_count(chars: Column) -> Column:
    return F.bround(chars / 4).cast("long")
