import random
import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, sig long, _rank int"


def made_rows() -> list[tuple]:
    """Random texts with copies, near copies, shared passages, nulls, empty and white texts, ties, a long text and columns whose names operators use inside."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Ä", "ß,", "To"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    passage = text(40)
    texts = [text(rnd.choice([1, 3, 4, 5, 6, 9, 14, 30, 80, 150, 300])) for _ in range(60)]
    texts += [f"{text(20)} {passage}\n{text(30)}" for _ in range(12)]
    base = text(200).split()
    for _ in range(10):
        near = list(base)
        for _ in range(rnd.randint(1, 9)):
            near[rnd.randrange(len(near))] = rnd.choice(words)
        texts.append(" ".join(near))
    for n in (4, 5, 8, 12, 25, 60):
        own = text(n).split()
        texts += [" ".join(own), " ".join([*own, "more"]), " ".join(own[1:]), " ".join(own).upper()]
    texts += [texts[0]] * 3 + [texts[70]] * 4 + ["To " * 50, "To " * 60, text(6000), "", "  \n ", None, None, "a\x1cb Ab", "x\x0by\x85z"]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    rows = [(i * 3 + 1, texts[k], "en", rnd.choice(["s1", "s2", "s2", "s2", None]), 1, "k", 7, 3) for i, k in enumerate(order)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def word():
    return WORD
