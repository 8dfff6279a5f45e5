"""Chat formatting: fingerprints and mappings, the template's round trip, the query against its SQL."""

import hashlib
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import chat

WORDS = st.lists(st.sampled_from([*chat.CONTROLS, "<", ">", "[", "]", "/", "\\", "s", " ", "\n", "INST", "[/INST", "</s", "é", "😀", "ROLE"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), WORDS), WORDS), max_size=6))
def test_template_round_trip(made):
    text, spans = chat.render([{"role": r, "text": t} for r, t in made])
    assert chat.parse(text) == made
    assert [chat.unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans] == [t for r, t in made if r == "assistant"]
    assert all(chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS) for _, t in made)


def test_mappings():
    read = chat.Reader(chat.MAPPINGS).read
    cases = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "id": 7}, "messages", [("user", "a"), ("assistant", "")]),
        ({"messages": []}, "messages", []),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "message parts", [("user", "ab")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}, "named speakers", [("user", "a"), ("assistant", "b"), ("tool", "c")]),
        ({"data": {"dialogue": [{"speaker": {"role": "user", "n": 1}, "utterance": "a"}]}}, "nested dialogue", [("user", "a")]),
        ({"instruction": "s", "input": "u", "output": "a"}, "instruction with input", [("system", "s"), ("user", "u"), ("assistant", "a")]),
        ({"instruction": "u", "output": "a"}, "instruction", [("user", "u"), ("assistant", "a")]),
        ({"system": "s", "prompt": "u", "completion": "a"}, "prompt and completion", [("system", "s"), ("user", "u"), ("assistant", "a")]),
        ({"question": "u", "answer": {"text": "a", "score": 0.5}}, "question and answer", [("user", "u"), ("assistant", "a")]),
    ]
    for record, layout, turns in cases:
        out = read(json.dumps(record))
        assert (out["layout"], [(t["role"], t["text"]) for t in out["turns"]], out["error"]) == (layout, turns, None), record
    a, b, c = (read(json.dumps(x))["fingerprint"] for x in ({"prompt": "a", "completion": "b"}, {"completion": "", "prompt": "zz"}, {"prompt": 1, "completion": "b"}))
    assert a == b != c
    for raw, error in ((None, "no object"), ("", "not JSON"), ("[1]", "no object"), ("{", "not JSON"), ('{"a": 1}', "unknown layout"), ('{"prompt": 1, "completion": "x"}', "unknown layout"), ("[" * 100_000, "not JSON")):
        assert read(raw)["error"] == error and read(raw)["turns"] is None


def test_canonical_keeps_rows_and_reports_layouts(spark):
    rows = [(1, '{"prompt": "a", "completion": "b"}', "x", 1), (1, '{"prompt": "a", "completion": "b"}', "x", 1), (None, None, None, None), (2, "", "y", 2), (3, '{"weird": [1]}', "z", 3), (4, '{"prompt": "' + "long " * 300_000 + '", "completion": ""}', "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, record string, layout string, turns int").repartition(3)
    out = chat.canonical(df)
    found = sorted(((r["row"]["doc_id"] or 0, r["row"]["layout"], r["row"]["turns"], r["layout"], r["error"]) for r in out.collect()), key=repr)
    fits = "prompt and completion"
    assert found == sorted([(1, "x", 1, fits, None), (1, "x", 1, fits, None), (0, None, None, None, "no object"), (2, "y", 2, None, "not JSON"), (3, "z", 3, None, "unknown layout"), (4, "", 0, fits, None)], key=repr)
    assert sorted(((r.layout or "", r.n) for r in chat.layouts(df).collect())) == [("", 1), (fits, 3)]
    made = chat.formatted(out.select("turns", "row.doc_id"))
    assert sorted(len(r.formatted) for r in made.collect() if r.formatted is not None) == [25, 25, 1_500_023]
    empty = spark.createDataFrame([], df.schema)
    assert chat.formatted(chat.canonical(empty).select("turns")).count() == 0 and chat.layouts(empty).count() == 0


def brute(rows):
    """DIGESTS by conversation, straight from the contract."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        learned = "".join(x for _, r, x in own if r == "assistant")
        every = "".join(f"{r}\n{x}\n" for _, r, x in own)
        out[conv] = (len(own), hashlib.sha256(every.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_conversations_of_all_kinds(spark):
    """Nulls in any column, unknown roles, control strings, repeated turns, a conversation of many parts with most of the rows, clashing names."""
    rnd = random.Random(1)
    bits = [*chat.CONTROLS, "a b", "\\", "\n", "é😀", "", '"', "{}", "\x01", " "]
    text = lambda: "".join(rnd.choices(bits, k=rnd.randint(0, 8)))
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", "human", "", None]), rnd.choice([text(), text(), None])) for c in range(40) for t in range(rnd.randint(1, 7))]
    rows += [(100 + c, t, r, text()) for c in range(12) for t, r in enumerate(["user", "assistant"])] + [(200 + c, t, r, text()) for c in range(12) for t, r in enumerate(["system", "user", "assistant"])]
    rows += [(500, t, "assistant" if t % 2 else "user", f"{t} {text()}") for t in range(-70, 900)]
    rows += [(600, 1, "user", "same")] * 5 + [(700, None, "user", "x"), (700, 3, None, None), (None, 0, "user", "lost"), (800, 0, "assistant", "w " * 200_000)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, record string, part int").repartition(5)
    made = chat.formatted(chat.canonical(chat.records(df)).select("turns", "row.conv_id"))
    out = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(made.select("row.conv_id", "formatted", "loss")).collect()}
    assert out == brute(rows)
    used = {r.layout for r in chat.layouts(chat.records(df)).collect()}
    assert used == {m.name for m in chat.MAPPINGS}


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(chat.canonical(chat.records(df)).select("turns", "row.conv_id")).select("row.conv_id", "formatted", "loss")).count() == 0
