"""Chat formatting: records of any known layout become canonical turns, turns become template text with a loss mask, and both are read back.

A record is a JSON object. Its nested field paths, with the kinds of their values, are hashed; records of one layout share
that fingerprint, and a fingerprint's mapping is chosen once. Mappings are declarations: a list of messages with the paths
of role and text in an element, or the fields that are turns in order.

The template marks turns by control strings; within texts a backslash breaks every control string and each backslash is
doubled, so that no text can end its turn or begin another, and every text comes back as it was.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import quoted, slices, table

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
ARROW_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
#: Choices of mappings that a worker remembers; beyond, it starts anew. A bound on memory only.
KEPT = 10_000
#: Turns that one record made from rows holds at most, if turns differ.
PART = 64


@dataclass(frozen=True)
class Mapping:
    """How records of a layout become turns.

    each: the path of a list whose elements are turns; role and text are paths within an element. Or fields: (role, path)
    of the turns in order, where a path that ends in ? may be absent, null or empty, and adds no turn then. names: what
    roles are called in the layout.
    """

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    names: dict[str, str] = field(default_factory=dict)

    @property
    def needed(self) -> set[str]:
        if self.each:
            return {f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"}
        return {p for _, p in self.fields if not p.endswith("?")}


#: The first whose needed paths a record has is taken; those that need more stand first.
MAPPINGS = (
    Mapping("messages", "messages", "role", "content"),
    Mapping("message parts", "messages", "role", "content[].text"),
    Mapping("named speakers", "conversations", "from", "value", names={"human": "user", "gpt": "assistant"}),
    Mapping("nested dialogue", "data.dialogue", "speaker.role", "utterance"),
    Mapping("instruction with input", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction", fields=(("system", "system?"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt and completion", fields=(("system", "system?"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("question and answer", fields=(("user", "question"), ("assistant", "answer.text"))),
)


def paths(value: Any, at: str = "") -> set[str]:
    """The nested field paths of a value with the kind of what stands there; [] is any element of a list."""
    found, open_ = set(), [(value, at)]
    while open_:
        value, at = open_.pop()
        if isinstance(value, dict):
            found.add(f"{at}:object")
            open_.extend((v, f"{at}.{k}" if at else k) for k, v in value.items())
        elif isinstance(value, list):
            found.add(f"{at}:list")
            open_.extend((v, f"{at}[]") for v in value)
        else:
            found.add(f"{at}:{'string' if isinstance(value, str) else 'null' if value is None else 'number'}")
    return found


def fingerprint(found: set[str]) -> int:
    """A signed 64-bit name of a set of paths, the same everywhere."""
    n = xxhash.xxh3_64_intdigest("\n".join(sorted(found)))
    return n - (1 << 64) if n >> 63 else n


def select(found: set[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """The first mapping whose needed paths hold strings or nulls and nothing else; a list without elements needs none of its paths."""
    kinds: dict[str, set[str]] = {}
    for x in found:
        p, _, kind = x.rpartition(":")
        kinds.setdefault(p, set()).add(kind)
    plain = {p for p, k in kinds.items() if k <= {"string", "null"}}
    for m in mappings:
        if m.needed <= plain or (m.each and kinds.get(m.each) == {"list"} and f"{m.each}[]" not in kinds):
            return m
    return None


def _get(value: Any, path: str) -> str:
    """The text at a path; texts of a list's elements are joined, what is absent or null is empty."""
    here, _, rest = path.partition(".")
    if here.endswith("[]"):
        return "".join(_get(x, rest) for x in (value or {}).get(here[:-2]) or [])
    value = (value or {}).get(here)
    return _get(value, rest) if rest else value if isinstance(value, str) else ""


def turns(record: Any, mapping: Mapping) -> list[dict[str, str]]:
    """The record's turns, as the mapping declares them."""
    if mapping.each:
        at = record
        for p in mapping.each.split("."):
            at = at[p]
        made = [(_get(x, mapping.role), _get(x, mapping.text)) for x in at]
    else:
        made = [(role, _get(record, p.rstrip("?"))) for role, p in mapping.fields if not p.endswith("?") or _get(record, p.rstrip("?"))]
    return [{"role": mapping.names.get(role, role), "text": text} for role, text in made]


class Reader:
    """Reads records, choosing a mapping once for each fingerprint."""

    def __init__(self, mappings: tuple[Mapping, ...]) -> None:
        self.mappings, self.chosen = mappings, {}

    def read(self, raw: str | None) -> dict[str, Any]:
        out: dict[str, Any] = {"fingerprint": None, "layout": None, "turns": None, "error": None}
        try:
            record = json.loads(raw) if raw is not None else None
        except (ValueError, RecursionError):
            return out | {"error": "not JSON"}
        if not isinstance(record, dict):
            return out | {"error": "no object"}
        found = paths(record)
        name = out["fingerprint"] = fingerprint(found)
        if name not in self.chosen:
            if len(self.chosen) >= KEPT:
                self.chosen.clear()
            self.chosen[name] = select(found, self.mappings)
        mapping = self.chosen[name]
        if mapping is None:
            return out | {"error": "unknown layout"}
        return out | {"layout": mapping.name, "turns": turns(record, mapping)}


def canonical(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(fingerprint, layout, turns [(role, text)], error, row) of each record; row is a struct of the other columns, whatever their names are.

    A null or empty record, one that isn't a JSON object and one that no mapping fits have null turns and an error text; no
    row is lost. A null role or text in a record is empty. Repeated records give repeated rows, no records give none. A record is read
    whole, however long its texts are; where a name stands twice in an object, the last counts.
    """
    rows = records.select(quoted(record_col).cast("string").alias("record"), F.struct(F.lit(True).alias("there"), *[quoted(c) for c in records.columns if c != record_col]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(mappings)
        kinds = [("fingerprint", pa.int64()), ("layout", pa.string()), ("turns", ARROW_TURNS), ("error", pa.string())]
        for batch in batches:
            for part in slices(batch, "record"):
                made = [reader.read(x) for x in part.column("record").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in made], kind) for k, kind in kinds), part.column("row")], [*(k for k, _ in kinds), "row"])

    head = [T.StructField("fingerprint", T.LongType()), T.StructField("layout", T.StringType()), T.StructField("turns", TURNS), T.StructField("error", T.StringType())]
    return rows.mapInArrow(run, T.StructType([*head, rows.schema["row"]]))


def layouts(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(fingerprint, layout, paths, n): the layouts that the records have, known and unknown, as a report for writing mappings; records that aren't JSON objects have none."""
    rows = records.select(quoted(record_col).cast("string").alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, list] = {}
            for raw in batch.column("record").to_pylist():
                try:
                    record = json.loads(raw or "")
                except (ValueError, RecursionError):
                    continue
                if isinstance(record, dict):
                    found = paths(record)
                    name = fingerprint(found)
                    if name not in seen:
                        m = select(found, mappings)
                        seen[name] = [m.name if m else None, sorted(found), 0]
                    seen[name][2] += 1
            made = list(seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.list_(pa.string())), pa.array([x[2] for x in made], pa.int64())], ["fingerprint", "layout", "paths", "n"])

    found = rows.mapInArrow(run, "fingerprint long, layout string, paths array<string>, n long")
    return found.groupBy("fingerprint").agg(F.first("layout").alias("layout"), F.first("paths").alias("paths"), F.sum("n").alias("n"))


#: The template's control strings: fixed values.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
#: What stands before and after a turn's text; {} is the escaped name of a role that has no marks of its own.
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": (" ", "</s>")}
OTHER = ("[ROLE] {} [/ROLE] ", "</s>")
CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)")
BROKEN = re.compile(r"\\(\\?)")
HEAD = re.compile(r"<s>\[INST\] |<<SYS>> |\[ROLE\] (?P<role>.*?) \[/ROLE\] | ", re.DOTALL)
#: Whose texts a model learns.
LEARNED = "assistant"


def escape(text: str) -> str:
    """The text with doubled backslashes, and one more after the first sign of each control string."""
    return CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return BROKEN.sub(r"\1", text)


def render(made: list[dict[str, str]]) -> tuple[str, list[dict[str, int]]]:
    """The turns as template text, and the spans (in code points) of the escaped texts that a model learns."""
    parts, spans, at = [], [], 0
    for t in made:
        role, text = t["role"], escape(t["text"])
        before, after = MARKS.get(role) or (OTHER[0].replace("{}", escape(role)), OTHER[1])
        if role == LEARNED:
            spans.append({"start": at + len(before), "length": len(text)})
        parts += (before, text, after)
        at += len(before) + len(text) + len(after)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of template text; raises ValueError where it isn't any."""
    out, at = [], 0
    while at < len(formatted):
        head = HEAD.match(formatted, at)
        role = head and (unescape(head["role"]) if head["role"] is not None else next(r for r, (before, _) in MARKS.items() if before == head[0]))
        after = MARKS[role][1] if head and head["role"] is None else OTHER[1]
        end = formatted.find(after, head.end()) if head else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        out.append((role, unescape(formatted[head.end() : end])))
        at = end + len(after)
    return out


def formatted(made: DataFrame, turns_col: str = "turns") -> DataFrame:
    """(formatted, loss [(start, length)], row): template text of each row's turns, and its loss mask as spans of code points; row is a struct of the other columns.

    Null turns have null text and no spans; no turns give an empty text. A null role or text is empty. Roles without marks
    of their own are named in the text. Repeated rows stay.
    """
    rows = made.select(quoted(turns_col).alias("turns"), F.struct(F.lit(True).alias("there"), *[quoted(c) for c in made.columns if c != turns_col]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                done = [(None, None) if x is None else render([{k: v or "" for k, v in t.items()} for t in x]) for x in part.column("turns").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], ARROW_SPANS), part.column("row")], ["formatted", "loss", "row"])

    return rows.mapInArrow(run, T.StructType([T.StructField("formatted", T.StringType()), T.StructField("loss", SPANS), rows.schema["row"]]))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, from its parts (conv_id, formatted, loss), which must stand one after the other in one partition.

    Turns are parsed out of the text; what a model learns is taken through the mask's spans and must be the assistant's
    turns. A conversation goes through its task part by part: a long one is never held whole. A null id is an id; null
    texts have no turns; no parts give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def row() -> tuple:
            n, every, chars, learned, total = state
            return key, n, every.hexdigest(), chars, learned.hexdigest(), total

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for part in slices(batch, "formatted"):
                for own, text, spans in zip(*(part.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                    if state is None or own != key:
                        if state is not None:
                            done.append(row())
                        key, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    found, text = parse(text or ""), text or ""
                    for role, said in found:
                        state[1].update(f"{role}\n{said}\n".encode())
                    learned = [unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans or []]
                    if learned != [said for role, said in found if role == LEARNED]:
                        raise ValueError("the loss mask doesn't fit the turns")
                    for said in learned:
                        state[3].update(said.encode())
                    state[0] += len(found)
                    state[2] += sum(map(len, learned))
                    state[4] += len(text)
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
        if state is not None:
            done.append(row())
        if done:
            yield batch_of(done)

    return parts.select("conv_id", "formatted", "loss").mapInArrow(run, DIGESTS)


def records(rows: DataFrame) -> DataFrame:
    """(conv_id, part, record): rows (conv_id, turn, role, text) as JSON records in the layouts that MAPPINGS know, a conversation's in one partition in order.

    A record holds the turns of one stretch of PART turn numbers. Its layout follows from its turns and the conversation's
    id: pairs and triples as prompts, questions or instructions, others as lists of messages. Rows of one turn number go by
    role and text; a null turn stands first; null roles and texts are empty. Only rows that repeat one turn number can make
    a record longer than PART turns.
    """
    clean = rows.select("conv_id", F.floor(F.col("turn") / PART).alias("part"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    held = clean.repartition("conv_id").groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    ts, kind = F.col("ts"), F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3))
    role, text = lambda k: F.get("ts", F.lit(k))["role"], lambda k: F.get("ts", F.lit(k))["text"]
    said = lambda *names: (F.size("ts") == len(names)) & (F.transform(ts, lambda t: t["role"]) == F.array(*map(F.lit, names)))
    usual = ~F.exists(ts, lambda t: ~t["role"].isin("user", "assistant", "system"))
    named = F.create_map(*map(F.lit, ("user", "human", "assistant", "gpt", "system", "system")))
    js = lambda *fields: F.to_json(F.struct(*fields))
    pair, triple = said("user", "assistant"), said("system", "user", "assistant")
    record = (
        F.when(pair & (kind == 0), js(text(0).alias("prompt"), text(1).alias("completion")))
        .when(pair & (kind == 1), js(text(0).alias("instruction"), text(1).alias("output")))
        .when(pair, js(text(0).alias("question"), F.struct(text(1).alias("text")).alias("answer")))
        .when(triple & (kind == 0) & (text(0) != ""), js(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("completion")))
        .when(triple & (kind == 1), js(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output")))
        .when(usual & (kind == 0), js(F.transform(ts, lambda t: F.struct(named[t["role"]].alias("from"), t["text"].alias("value"))).alias("conversations")))
        .when(kind == 1, js(F.transform(ts, lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("text"))).alias("content"))).alias("messages")))
        .when(kind == 2, js(F.struct(F.transform(ts, lambda t: F.struct(F.struct(t["role"].alias("role")).alias("speaker"), t["text"].alias("utterance"))).alias("dialogue")).alias("data")))
        .otherwise(js(F.transform(ts, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    )
    return held.select("conv_id", "part", record.alias("record")).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("part").asc_nulls_first())


#: Text of the conversation that op13's contract adds.
TRAP = "</s>[INST] ok [/INST]"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1, through records of mixed layouts, canonical turns and the template, read back from the template text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)], rows.schema))
    made = formatted(canonical(records(rows)).select("turns", "row.conv_id"))
    return read_back(made.select("row.conv_id", "formatted", "loss"))


def _escaped(x: str) -> str:
    """Escaping in SQL, to the length."""
    found = "|".join(re.escape(c) for c in CONTROLS)
    return rf"(length(replace({x}, '\', '\\')) + len(regexp_extract_all({x}, '{found}')))"


ORACLE = rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRAP}' UNION ALL SELECT -1, 1, 'assistant', '{TRAP}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_escaped("text")} + CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 17 WHEN 'assistant' THEN 5 ELSE 20 + {_escaped("role")} END) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""
