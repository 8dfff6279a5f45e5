"""Behaviour of single operators, and an index from files to served answers."""

import io
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.functions import text as T
from folioscope.operators import audit, chunking, dense, fusion, graph, lexical, sparse
from folioscope.plans import cli, index, service
from folioscope.sources import markdown, pages
from folioscope.streaming import refresh


def value(spark, column, **given):
    names = list(given)
    schema = ", ".join(f"{k} string" for k in names) or "x string"
    return spark.createDataFrame([tuple(given.values()) or ("",)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "slug,kind,law,branch",
    [
        ("codigo-penal-2026", "ley", True, "Derecho Penal"),
        ("temario-derecho-penal-2025", "temario", False, "Derecho Penal"),
        ("ley-general-de-la-administracion-publica", "ley", True, "Derecho Administrativo"),
        ("constitucion-politica", "ley", True, "Derecho Constitucional"),
        ("codigo-de-trabajo", "ley", True, "Derecho Laboral"),
        ("código_tributario", "ley", True, "Derecho Tributario"),
        ("codigo-de-comercio", "ley", True, "Derecho Comercial"),
        ("jurisprudencia-sala-constitucional", "jurisprudencia", True, "Derecho Constitucional"),
        ("manual-de-derecho-civil", "doctrina", False, "Derecho Civil"),
        ("apuntes", "otro", False, "General"),
    ],
)
def test_classification(spark, slug, kind, law, branch):
    r = rules.classify(spark.createDataFrame([(slug,)], "slug string")).first()
    assert (r.doc_type, r.is_law, r.rama) == (kind, law, branch)


@pytest.mark.parametrize(
    "text,alive",
    [("Derogado por ley 1", False), ("  (Derogada por el artículo 2)", False), ("SIN  VIGENCIA", False), ("Téngase por derogado", False), ("DEROGADOS.-", False), ("Todo daño se repara.", True), ("Deróguese la ley 5", True), ("Quedan derogadas las normas", True)],
)
def test_in_force(spark, text, alive):
    assert value(spark, rules.in_force(F.col("x")), x=text) is alive


@pytest.mark.parametrize(
    "text,found",
    [
        ("según el artículo 45 de este", {"45"}),
        ("artículo 5 de la Ley 7020", set()),
        ("los artículos 3 y 4 del Código Penal", set()),
        ("artículos 5, 6 y 7", {"5", "6", "7"}),
        ("ARTICULOS 5 a 9", {"5", "6", "7", "8", "9"}),
        ("artículo 246 bis", {"246"}),
        ("artículos 1 a 90", {"1", "90"}),
        ("artículo 4° de la ley", {"4"}),
        ("artículo 8 y artículo 9 de la Constitución", {"8"}),
        ("nada", set()),
    ],
)
def test_references(spark, text, found):
    assert set(value(spark, graph.references(F.col("x")), x=text)) == found


def test_notes(spark):
    body = "Operativo (en adelante, el comprador) sigue.\n\n(Así reformado el inciso a) por ley 5)\n \n(Nota del editor: (anidada) fin)\n\nMás texto."
    kept, notes = (value(spark, c, body=body) for c in chunking.split_notes(F.col("body")))
    assert kept == "Operativo (en adelante, el comprador) sigue. Más texto."
    assert notes == "(Así reformado el inciso a) por ley 5) (Nota del editor: (anidada) fin)"
    only = "(Adicionado por ley 3)"
    assert value(spark, chunking.split_notes(F.col("body"))[0], body=only) == only


def test_text_functions(spark):
    assert value(spark, T.fold(F.col("x")), x="ÁÉñ ﬁn Nº ½ ß İ") == "aen fin no 1⁄2 ß i"
    assert value(spark, T.features(F.col("x")), x="Niñez sí") == ["w:ninez", "c:#nin", "c:nine", "c:inez", "c:nez#", "w:si"]
    assert value(spark, T.excerpt(F.col("x"), 5), x="  a\n b  cdef ") == "a b c …"
    assert value(spark, T.article_label(F.lit("ÚNICO"), F.lit("BIS"))) == "Único bis"
    assert value(spark, T.token_estimate(F.col("x")), x="a" * 10) == 2
    long = "x" * 1000 + " casa perro " + "y" * 2000
    assert "casa perro" in value(spark, T.focus(F.lit("casa perro"), F.col("x")), x=long) and value(spark, T.focus(F.lit("casa"), F.col("x")), x="corto") == "corto"
    order = spark.createDataFrame([("10",), ("9 bis",), ("9",), ("único",)], "a string").orderBy(T.article_key(F.col("a")))
    assert [r.a for r in order.collect()] == ["9", "9 bis", "10", "único"]


def test_frontmatter(spark):
    raw = '---\nsource: "a: b.pdf"\nk: 1\nk: 2\n---\nbody'
    assert value(spark, markdown.frontmatter(F.col("x")), x=raw) == {"source": "a: b.pdf", "k": "2"}
    assert value(spark, markdown.body(F.col("x")), x=raw) == "\nbody"
    assert value(spark, markdown.strict_body(F.col("x")), x=raw) == "body"
    assert value(spark, markdown.body(F.col("x")), x="no --- here") == "no --- here"


def test_conversion(spark):
    rows = [("Cdigo X.pdf", 0, "TÍTULO I\n\nArtículo 1º.- Uno. Artículo 2 BIS.- Dos"), ("Cdigo X.pdf", 1, "sigue ﬁn.\n\n2 de 9\n\nFicha articulo Artículo ÚNICO.- www.x.y z"), ("Temario P.pdf", 0, "Portada\n1 de 3\nTemario penal\nTema 1")]
    out = {r.slug: r for r in pages.convert(spark.createDataFrame(rows, "doc string, page_no long, text string"), F.lit("2024-01-01")).collect()}
    assert out["codigo-x"].n_articles == 3 and out["codigo-x"].text.startswith('---\ntype: reference\ndoc_kind: codigo\nsource: "Cdigo X.pdf"')
    assert [x for x in out["codigo-x"].body.split("\n") if x] == ["### TÍTULO I", "## Artículo 1", "Uno.", "## Artículo 2 bis", "Dos sigue fin.", "## Artículo Único", "z"]
    assert out["temario-p"].body == "Portada\n\n# Temario penal\n\nTema 1" and out["temario-p"].n_articles == 0


def test_audit(spark):
    pairs = spark.createDataFrame([(1, "a, b c", "a, b c"), (2, "a, b b", "a b d"), (3, "Artículo 2º", "articulo 2")], "doc long, source string, made string")
    assert {(r.doc, r.word, r.lost, r.added) for r in audit.word_differences(pairs).collect()} == {(2, "b", 1, 0), (2, "d", 0, 1)}
    assert {r.doc: r.ok for r in audit.verdict(pairs).collect()} == {1: True, 2: False, 3: True}
    assert tuple(audit.result(audit.verdict(pairs)).first()) == (3, 2, False)


def test_fusion_properties(spark):
    lists = [spark.createDataFrame([(0, i, k + 1) for k, i in enumerate(ids)], "qid long, rid long, rank int") for ids in ([1, 2, 3], [3, 4])]
    a = {r.rid: r.rrf for r in fusion.fuse(lists).collect()}
    assert a == {r.rid: r.rrf for r in fusion.fuse(lists[::-1]).collect()}
    assert a == pytest.approx({1: 1 / 61, 2: 1 / 62, 3: 1 / 63 + 1 / 61, 4: 1 / 62})
    hits = spark.createDataFrame([(0, i, float(s)) for i, s in enumerate((9, 8, 7, 6.9, 1))], "qid long, rid long, score double")
    assert [r.rid for r in fusion.margin_cut(hits).orderBy("rank").collect()] == [0, 1, 2]
    assert [r.rid for r in fusion.ratio_cut(hits, "score", cap=3).orderBy("rank").collect()] == [0, 1, 2]


def test_dense_encoder(spark):
    def encoder():
        return lambda texts, kind: np.array([[len(t), 1.0 if kind == "query" else 2.0] for t in texts])

    rows = spark.createDataFrame([(1, "abc"), (2, None)], "rid long, t string")
    out = {r.rid: r.embedding for r in dense.encode(rows, "rid", "t", encoder).collect()}
    assert out[1] == pytest.approx([3 / 13**0.5, 2 / 13**0.5]) and out[2] == pytest.approx([0, 1])
    with pytest.raises(ValueError):
        dense.nearest(rows, rows, 1, most_queries=1)


FILES = {
    "codigo-civil-2026": "---\nsource: \"c.pdf\"\n---\n\npreámbulo\n\n### CAPITULO I\n\nepígrafe\n\n## Artículo 1\n\nEl inquilino puede subarrendar según el artículo 2.\n\n(Así reformado por ley 9)\n\n## Artículo 2\n\nDerogado.\n\n## Artículo 3\n\nEl dueño repara el daño; véanse los artículos 1 a 2.\n\n### CAPITULO II\n\n## Artículo 4\n\n \n\n## Transitorio\n\nNorma del inquilino.\n",
    "temario-derecho-civil-2025": "# Temario\n\nEl arrendamiento y el inquilino en general\n\ncorto\n\n## \n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("home")
    (home / "markdown").mkdir()
    for slug, text in FILES.items():
        (home / "markdown" / f"{slug}.md").write_text(text, encoding="utf-8")
    return home, index.build(spark, str(home / "markdown"), str(home / "index"))


def test_chunks(built):
    rows = built[1].chunks.orderBy("rid").collect()
    assert [(r.rid, r.slug, r.article, r.structure, r.section, r.vigente) for r in rows] == [
        (1, "codigo-civil-2026", "1", "CAPITULO I", "codigo-civil-2026#1", 1),
        (2, "codigo-civil-2026", "2", "CAPITULO I", "codigo-civil-2026#1", 0),
        (3, "codigo-civil-2026", "3", "CAPITULO I", "codigo-civil-2026#1", 1),
        (4, "codigo-civil-2026", None, "CAPITULO II", "codigo-civil-2026#2", 1),
        (5, "temario-derecho-civil-2025", None, "", "temario-derecho-civil-2025#0", 1),
    ]
    assert rows[0].text == "El inquilino puede subarrendar según el artículo 2." and rows[0].reformas == "(Así reformado por ley 9)"
    assert rows[0].citation == "Código Civil, art. 1" and rows[3].citation == "Código Civil — Transitorio" and rows[0].source == "c.pdf"
    assert tuple(index.report(built[1]).first()) == (5, 2, 3, 1, 3)


def test_norms(built):
    assert all(abs(r.norm - 1) < 1e-3 for r in sparse.norms(built[1].sparse).collect())


def test_service(spark, built):
    s = service.Service(spark, index.load(spark, str(built[0] / "index")))
    assert [r["article"] for r in s.search("inquilino subarrendar")][0] == "1"
    assert all(r["vigente"] for r in s.search("derogado dueño")) and s.search("zzz") == [] and s.search("") == []
    assert s.article("2")[0]["derogado"] and s.article("9") == []
    assert s.related("1", "codigo-civil-2026") == {"cites": ["2"], "cited_by": ["3"], "neighbors": ["2", "3"]}
    assert s.related("77", "codigo-civil-2026") == {"cites": [], "cited_by": [], "neighbors": []}
    assert "«inquilino»" in s.lexical("inquilino", 1)[0]["snippet"]
    bundle = s.consult("inquilino")
    assert "1" in [r["article"] for r in bundle["core"]] and {r["article"]: r["relation"] for r in bundle["related"]}["2"] == "cita" and bundle["topics"]
    lines = [b"\xef\xbb\xbf" + json.dumps({"id": 1, "method": "initialize"}).encode(), b"", b"not json", b"[1]", json.dumps({"method": "notifications/initialized"}).encode()]
    lines += [json.dumps(m).encode() for m in ({"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "legal_article", "arguments": {"article": "1", "code": "codigo-civil-2026"}}}, {"id": 4, "method": "tools/call", "params": {"name": "no"}}, {"id": 5, "method": "odd"})]
    sink = io.BytesIO()
    service.serve(s, io.BytesIO(b"\n".join(lines)), sink)
    out = {m["id"]: m for m in map(json.loads, sink.getvalue().splitlines())}
    assert list(out) == [1, 2, 3, 4, 5] and out[1]["result"]["protocolVersion"] == "2024-11-05" and len(out[2]["result"]["tools"]) == 4
    assert json.loads(out[3]["result"]["content"][0]["text"])[0]["citation"] == "Código Civil, art. 1"
    assert out[4]["result"]["isError"] and out[5]["error"]["code"] == -32601


def test_command_line(built, capsys, tmp_path):
    home = ["--home", str(built[0])]
    assert cli.main([*home, "article", "1", "--code", "codigo-civil-2026"]) == 0 and "### Código Civil, art. 1" in capsys.readouterr().out
    assert cli.main([*home, "doctor"]) == 0 and "2 files" in capsys.readouterr().out
    cfg, js = tmp_path / "c.toml", tmp_path / "c.json"
    js.write_text('{"other": 1}')
    for _ in range(2):
        assert cli.main(["register", "--toml", str(cfg), "--json", str(js)]) == 0
    assert cfg.read_text().count("[mcp_servers.") == 1 and json.loads(js.read_text())["other"] == 1
    assert cli.main(["register", "--toml", str(tmp_path / "no.toml"), "--dry-run"]) == 0 and not (tmp_path / "no.toml").exists()


def test_dense_index(spark, built, monkeypatch, tmp_path):
    def encoder():
        return lambda texts, kind: np.array([[t.count("inquilino"), t.count("daño"), 0.1] for t in texts])

    made = index.build(spark, str(built[0] / "markdown"), str(tmp_path / "i"), encoder, "counts")
    assert made.meta["embedder"] == "dense:counts"
    assert service.Service(spark, made, encoder).search("daño")[0]["article"] == "3"
    monkeypatch.setenv(index.EMBEDDER, "sparse")
    assert index.backend(True) == "sparse"


def test_lexical_phrase(spark):
    rows = spark.createDataFrame([(1, "foo bar"), (2, "bar foo"), (3, "x")], "rid long, text string")
    found = lexical.bm25(lexical.index(rows), spark.createDataFrame([(0, "foo_bar")], "qid long, query string"), 5)
    assert [r.rid for r in found.collect()] == [1]


def hits(ix, spark, queries):
    """Both lists by slug and heading, as row ids are an index's own."""
    asked = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    out = []
    for found in (lexical.bm25(ix.lexicon, asked, 10), sparse.cosine(ix.sparse, asked, 10)):
        rows = found.join(ix.chunks.select("rid", "slug", "heading", "text"), "rid")
        out.append(sorted((r.qid, r.slug, r.heading, r.text, round(r.score, 6)) for r in rows.collect()))
    return out


def test_streaming_refresh_equals_a_full_rebuild(spark, tmp_path):
    """New files, a changed one, the same batch again, and a merge: searches, edges and report are those of an index built anew, and only changed files are read."""
    src, path = tmp_path / "in", str(tmp_path / "index")
    src.mkdir()
    asked = ["inquilino", "dueño daño", "párrafo bastante largo", "el_inquilino", "zzz"]

    def equal_to_rebuild(ix):
        anew = index.build(spark, str(src), str(tmp_path / f"anew-{time.time_ns()}"))
        assert hits(ix, spark, asked) == hits(anew, spark, asked) and any(hits(anew, spark, asked))
        assert tuple(index.report(ix).first()) == tuple(index.report(anew).first()) and ix.meta["N"] == anew.meta["N"]
        assert sorted(map(tuple, ix.refs.collect())) == sorted(map(tuple, anew.refs.collect()))
        assert sorted(map(tuple, ix.lexicon.frequencies.collect())) == sorted(map(tuple, anew.lexicon.frequencies.collect()))

    for slug, text in FILES.items():
        (src / f"{slug}.md").write_text(text, encoding="utf-8")
    refresh.refresh(spark, str(src), path, str(tmp_path / "cp")).awaitTermination()
    refresh.sync(spark, str(src), path)  # notes what is there
    time.sleep(1)
    (src / "temario-derecho-civil-2025.md").unlink()
    (src / "temario-derecho-civil-2025.md").write_text("Un párrafo bastante largo.\n\nOtro párrafo bastante largo.\n", encoding="utf-8")
    (src / "codigo-nuevo.md").write_text("## Artículo 1\n\nEl inquilino paga; véase el artículo 2.\n\n## Artículo 2\n\nFin.\n", encoding="utf-8")
    refresh.sync(spark, str(src), path)
    now = index.state(spark, path)
    assert spark.read.parquet(f"{path}/{now.segments[-1]}/chunks").select("slug").distinct().count() == 2
    again = spark.createDataFrame([(f.stem, f.name, f.read_text(encoding="utf-8")) for f in src.glob("*temario*.md")], "slug string, file_name string, raw string")
    equal_to_rebuild(index.add(spark, again, path))  # as a batch that is run twice
    (src / "codigo-nuevo.md").unlink()
    gone = spark.createDataFrame([("codigo-nuevo",)], "slug string")
    index.add(spark, again.where("false"), path, removed=gone)
    assert spark.read.parquet(f"{path}/{now.segments[-1]}/chunks").count() > 0  # what was written stays as it is
    equal_to_rebuild(index.merge(spark, path))
    assert len(index.state(spark, path).segments) == 1
    index.sweep(spark, path)
    assert len(list((tmp_path / "index").glob("s*"))) == 2 and index.load(spark, path).chunks.count() == 6
