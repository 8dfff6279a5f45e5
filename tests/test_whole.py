"""What queries over whole tables return beyond parts of them, and the entry module without its training-text part."""

import json
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from folioscope.operators import advisory, dense
from folioscope.plans import adapters, catalog, oracle
from folioscope.plans.adapters import view

TABLES = "orders documents embeddings benchmark labels".split()


@pytest.fixture(scope="module")
def db(tables):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return c


def test_dense_blocks(spark):
    vectors = spark.range(30).selectExpr("id AS rid", "transform(sequence(1, 4), i -> float((id * 7 + i * i * 3) % 11)) AS embedding")
    asked = vectors.withColumnRenamed("rid", "qid").where("qid < 7")
    assert dense.nearest(vectors, asked, 3).count() == 21
    many = spark.range(1001).selectExpr("id AS qid", "array(1.0f, 0.0f, 0.0f, 0.0f) AS embedding")
    assert dense.nearest(vectors, many, 2).count() == 2002


def test_bundles_take_both_lists(spark, tables, db):
    """Before, the semantic list was the lexical one once more, and both had 20 rows."""
    sql = f"WITH RECURSIVE {oracle.INDEX}, {oracle.SPARSE}, {oracle.bm25(oracle.QU, 200)}, {oracle.cosine(200)}, {oracle.hybrid('c.doc_type = $$fr$$')} SELECT qid, count(*) FROM cutoff GROUP BY qid"
    found = {r.qid: r.n_core for r in catalog.consult_bundle(spark, tables).collect() if r.n_core}
    assert found == dict(db.sql(sql).fetchall()) and found


def test_rerank_reads_whole_texts(spark):
    """A match after character 900 counts as one before it."""
    hits = spark.createDataFrame([(0, 1, "casa dueño", "x " * 600 + "Casa del dueño"), (0, 2, "casa dueño", "casa")], "qid long, rid long, query string, text string")
    assert {r.rid: r.score for r in catalog.words_held(hits).collect()} == {1: 2.0, 2: 1.0}


def test_related_follow_hits_of_any_id(spark, tables):
    """Before, the core was nine articles with ids up to 81, the same for every question."""
    rows = view(spark, tables, adapters.STATUTES)
    asked = spark.createDataFrame([(0, "derogadas otras normas"), (1, "ley orgánica")], "qid long, query string")
    core = {}
    for r in catalog.found_core(rows, asked).collect():
        core.setdefault(r.qid, set()).add(r.rid)
    assert core[0] != core[1] and max(core[0]) > 81 and all(len(c) == 25 for c in core.values())


def test_related_of_every_article(spark, tables):
    """Before, five articles were asked."""
    edges = {tuple(r) for r in catalog.ref_edges(spark, tables).select("slug", "src", "dst").collect()}
    cites = {(r.slug, r.article, r.other) for r in catalog.related_cites(spark, tables).collect()}
    cited = {(r.slug, r.other, r.article) for r in catalog.related_cited_by(spark, tables).collect()}
    assert cites == cited == edges and len({c[1] for c in cites}) > 5


def test_rare_terms_and_features(spark, tables):
    """Before, the first 100 terms and 200 features were returned, so none that a single document has."""
    for made in (catalog.fold_tokens_df(spark, tables), catalog.sparse_features(spark, tables)):
        assert made.count() > 200 and made.where("df = 1").count() > 0


def test_sheet(spark):
    """A page has the laws by their best hit, ties between articles by kind, and topics by branch."""
    asked = spark.createDataFrame([(0, "¿qué?"), (1, "nada")], "qid long, query string")
    fields = "qid long, rank int, score double, name string, rama string, structure string, article string, citation string, text string, doc_type string"
    core = spark.createDataFrame([(0, 1, 0.5, "B", "Rama b", "", "7", "B, art. 7", "uno  dos", "ley"), (0, 2, 0.9, "A", "Rama a", "CAP I", None, "A — Nota", "x" * 300, "ley"), (0, 3, 0.4, "B", "Rama b", "", "8", "B, art. 8", "tres", "ley"), (0, 4, 0.8, "T", "t", "", None, "T", "y", "temario")], fields)
    related = spark.createDataFrame([(0, 1, "cita", "B, art. 9", True), (0, 3, "cita", "B, art. 11", False), (0, 2, "misma_materia", "B, art. 10", None)], "qid long, place int, relation string, citation string, vigente boolean")
    topics = spark.createDataFrame([(0, 2, "R2", "dos"), (0, 1, "R1", "uno"), (0, 3, "R1", "tres")], "qid long, rank int, rama string, topic string")
    out = {r.qid: r.sheet for r in advisory.sheets(asked, core, related, topics).collect()}
    assert out[0].split("\n") == [
        "PREGUNTA: ¿qué?", "", "════ FUENTES DE LEY · 3 artículo(s) en 2 cuerpo(s) legal(es) ════",
        "", "── A  ·  Rama a ──", "  • A — Nota  ·  CAP I", "      " + "x" * 240 + " …",
        "", "── B  ·  Rama b ──", "  • art. 7", "      uno dos", "  • art. 8", "      tres",
        "", "════ ARTÍCULOS RELACIONADOS · 3 por concordancia ════", "  [cita a] B, art. 9 · B, art. 11 ⚠DEROG", "  [misma materia] B, art. 10",
        "", "════ TEMARIO · guía de estudio (NO es la ley) ════", "  ── R1 ──", "    • uno", "    • tres", "  ── R2 ──", "    • dos",
    ]
    assert out[1] == "PREGUNTA: nada\n\n════ FUENTES DE LEY · 0 artículo(s) en 0 cuerpo(s) legal(es) ════"


def test_entry_without_the_training_text_part():
    """With the subpackage gone, the pipeline's file there or not, the other queries are there."""
    code = """
import json, sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("folioscope.llm") or (name == "corpus_pipeline" and "both" in sys.argv):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))
"""
    for given in ([], ["both"]):
        found = json.loads(subprocess.run([sys.executable, "-c", code, *given], capture_output=True, text=True, check=True, cwd=__spark_entry__.__file__.rsplit("/", 1)[0]).stdout.splitlines()[-1])
        assert found == [sorted(catalog.QUERIES), sorted(oracle.SQL)]
