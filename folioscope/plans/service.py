"""Search, exact articles, related articles and advisory bundles over an index, and the tool protocol that serves them."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.rules import LAW_KINDS
from folioscope.operators import advisory, dense, fusion, graph, lexical, sparse
from folioscope.plans.index import Index

PROTOCOL = "2024-11-05"


class Service:
    def __init__(self, spark: SparkSession, index: Index, encoder=None, reranker=None) -> None:
        """encoder: as operators.dense.encode takes it, for an index of dense vectors. reranker: as operators.fusion.hybrid takes it."""
        self.spark, self.index, self.encoder, self.reranker = spark, index, encoder, reranker

    def asked(self, *queries: str) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(queries)), "qid long, query string")

    def semantic(self, queries: DataFrame, k: int) -> DataFrame:
        if self.index.sparse is not None:
            return sparse.cosine(self.index.sparse, queries, k)
        encoded = dense.encode(queries, "qid", "query", self.encoder, "query")
        return dense.nearest(self.index.vectors, encoded, k)

    def hybrid(self, queries: DataFrame, slug: str | None = None, types: tuple[str, ...] | None = LAW_KINDS, with_repealed: bool = False, **options) -> DataFrame:
        """Hits of all queries (qid, query) in one plan."""
        size = options.get("pool_size", fusion.POOL)
        allowed = self.index.chunks.where(F.col("slug") == slug) if slug else None
        words = lexical.bm25(self.index.lexicon, queries, size, allowed)
        return fusion.hybrid(self.index.chunks, words, self.semantic(queries, size), slug=slug, types=types, with_repealed=with_repealed, reranker=self.reranker, queries=queries, **options)

    def search(self, query: str, slug: str | None = None, **options) -> list[dict]:
        return [r.asDict() for r in self.hybrid(self.asked(query), slug, **options).orderBy("rank").collect()]

    def lexical(self, query: str, k: int = 5, slug: str | None = None) -> list[dict]:
        return [r.asDict() for r in lexical.lexical(self.index.chunks, self.index.lexicon, self.asked(query), k, slug).orderBy("rank").collect()]

    def article(self, number: str, slug: str | None = None) -> list[dict]:
        """All chunks of an article number, repealed ones with their flag."""
        rows = self.index.chunks.where(F.col("article") == str(number))
        rows = rows.where(F.col("slug") == slug) if slug else rows
        out = rows.orderBy("rid").select("citation", "structure", (F.col("vigente") == 1).alias("vigente"), (F.col("vigente") != 1).alias("derogado"), "text", "reformas")
        return [r.asDict() for r in out.collect()]

    def related(self, number: str, slug: str) -> dict:
        seed = self.spark.createDataFrame([(slug, str(number))], "slug string, article string")
        row = graph.listed(graph.related(self.index.chunks, self.index.refs, seed)).first()
        return {k: list(row[k]) if row else [] for k in ("cites", "cited_by", "neighbors")}

    def citation(self, number: str, slug: str) -> str:
        return graph.citations(self.index.chunks, self.spark.createDataFrame([(slug, str(number))], "slug string, article string")).first()["citation"]

    def parts(self, queries: DataFrame, slug: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Core hits, related articles and topics of all queries in one plan."""
        core = self.hybrid(queries, slug)
        return core, advisory.expand(core, self.index.chunks, self.index.refs), advisory.topics(self.index.chunks, self.index.lexicon, queries)

    def bundles(self, queries: DataFrame, slug: str | None = None) -> DataFrame:
        """(qid, bundle as JSON)."""
        return advisory.bundle(queries, *self.parts(queries, slug))

    def sheet(self, question: str, slug: str | None = None) -> str:
        """A bundle to read."""
        asked = self.asked(question)
        return advisory.sheets(asked, *self.parts(asked, slug)).first()["sheet"]

    def consult(self, question: str, slug: str | None = None) -> dict:
        return json.loads(self.bundles(self.asked(question), slug).first()["bundle"])


def _schema(required: list[str], **fields: str) -> dict:
    return {"type": "object", "properties": {k: {"type": "string", "description": v} for k, v in fields.items()}, "required": required}


CODE = "slug of a body of law"
TOOLS = {
    "legal_search": ("Hybrid search; as many law articles as are relevant, with citation and branch.", _schema(["query"], query="a question in plain words", code=CODE)),
    "legal_article": ("The text of an exact article, repealed or not.", _schema(["article", "code"], article="number, such as 1045", code=CODE)),
    "legal_related": ("What an article cites, what cites it, and its neighbours.", _schema(["article", "code"], article="number", code=CODE)),
    "legal_consult": ("A bundle for a question: relevant articles, related ones and study topics.", _schema(["question"], question="the question", code=CODE)),
}


def call(service: Service, name: str, given: dict) -> object:
    code = given.get("code")
    if name == "legal_search":
        return [{k: r[k] for k in ("doc_type", "rama", "citation", "structure", "score", "text")} for r in service.search(given["query"], code)]
    if name == "legal_article":
        return service.article(given["article"], code)
    if name == "legal_related":
        return service.related(given["article"], given["code"])
    if name == "legal_consult":
        return service.consult(given["question"], code)
    raise ValueError(f"unknown tool: {name}")


def initialized(service: Service, given: dict) -> dict:
    return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "folioscope", "version": "0.1.0"}}


def listed(service: Service, given: dict) -> dict:
    return {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s) in TOOLS.items()]}


def called(service: Service, given: dict) -> dict:
    try:
        found = call(service, given["name"], given.get("arguments", {}))
    except Exception as e:  # the client gets the error
        return {"content": [{"type": "text", "text": f"ERROR: {e}"}], "isError": True}
    return {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False, indent=2)}]}


METHODS = {"initialize": initialized, "tools/list": listed, "tools/call": called}


def answer(service: Service, message: dict) -> dict | None:
    """The reply to a message; none to a notification."""
    method, mid = message.get("method"), message.get("id")
    if method in METHODS:
        body = {"result": METHODS[method](service, message.get("params", {}))}
    elif method is None or mid is None:
        return None
    else:
        body = {"error": {"code": -32601, "message": f"unsupported method: {method}"}}
    return {"jsonrpc": "2.0", "id": mid, **body}


def messages(lines: Iterable[bytes]) -> Iterator[dict]:
    """The JSON objects among lines of UTF-8, a byte-order mark before them or not."""
    for raw in lines:
        try:
            found = json.loads(raw.decode("utf-8-sig", "replace"))
        except ValueError:
            continue
        if isinstance(found, dict):
            yield found


def serve(service: Service, source: BinaryIO | None = None, sink: BinaryIO | None = None) -> None:
    """Answer messages line by line; lines that aren't JSON objects are passed over."""
    sink = sink or sys.stdout.buffer
    for message in messages(source or sys.stdin.buffer):
        reply = answer(service, message)
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False).encode() + b"\n")
            sink.flush()
