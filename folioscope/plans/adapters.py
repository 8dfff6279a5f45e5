"""The engine's tables made from the test tables. Each adapter is one SQL text that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: A chunk for each document: its source is its slug, its language its kind, its quality its force.
CHUNKS = """
SELECT d.doc_id + 1 AS rid, d.source AS slug, d.source AS name, d.lang AS doc_type, '' AS heading, CAST(d.doc_id AS STRING) AS article, '' AS structure,
       concat(d.source, ', art. ', CAST(d.doc_id AS STRING)) AS citation, d.text AS text, concat(d.source, '#', CAST(d.doc_id % 9 AS STRING)) AS section,
       d.lang AS rama, d.source AS source, COALESCE(l.quality, 1) AS vigente
FROM {documents} d LEFT JOIN (SELECT doc_id, MIN(quality) AS quality FROM {labels} GROUP BY doc_id) l ON d.doc_id = l.doc_id
"""
#: An article for each order, with references, marks of repeal, notes, ranges and references to other laws in turn.
STATUTES = """
SELECT o_orderkey + 1 AS rid, concat('code-', CAST(o_orderkey % 5 AS STRING)) AS slug, 'ley' AS doc_type, CAST(o_orderkey AS STRING) AS article,
       concat('code-', CAST(o_orderkey % 5 AS STRING), '#', CAST((o_orderkey - o_orderkey % 40) / 40 AS STRING)) AS section,
       concat('Code ', CAST(o_orderkey % 5 AS STRING), ', art. ', CAST(o_orderkey AS STRING)) AS citation, '' AS structure, o_orderkey % 10 AS grp,
       concat(CASE WHEN o_orderkey % 11 = 0 THEN 'Derogado. ' WHEN o_orderkey % 11 = 1 THEN 'Quedan derogadas otras normas. ' ELSE 'La parte puede pedir. ' END,
              'Véase el artículo ', CAST(o_orderkey + 5 * (o_custkey % 7 + 1) AS STRING),
              CASE WHEN o_orderkey % 13 = 0 THEN ' de la Ley orgánica' WHEN o_orderkey % 13 = 1 THEN ' del Código de otra materia' ELSE ' y concordantes' END, '.',
              CASE WHEN o_orderkey % 17 = 0 THEN ' Los artículos 10 a 14 rigen.' WHEN o_orderkey % 17 = 1 THEN ' Los artículos 5, 15 y 25 rigen.' ELSE '' END,
              CASE WHEN o_orderkey % 7 = 0 THEN '

(Así reformado por el artículo 3 de otra ley)' ELSE '' END) AS text
FROM {orders}
"""
#: A Markdown file for each of 40 groups of orders, as lines with places.
LINES = """
SELECT concat('code-', CAST(o_orderkey % 40 AS STRING)) AS slug, 2 * o_orderkey + i AS pos,
       CASE WHEN i = 0 AND o_orderkey % 400 < 40 THEN concat('### CAPITULO ', CAST((o_orderkey - o_orderkey % 400) / 400 AS STRING))
            WHEN i = 0 AND o_orderkey % 3 = 0 THEN concat('## Artículo ', CAST(o_orderkey AS STRING))
            WHEN i = 0 AND o_orderkey % 3 = 1 THEN concat('## Título ', CAST(o_orderkey AS STRING))
            WHEN i = 1 AND o_orderkey % 12 = 0 THEN '  ' ELSE concat('texto ', CAST(o_custkey AS STRING)) END AS line
FROM {orders} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 AS i) t
"""
PAGES = "SELECT concat('doc ', CAST(conv_id AS STRING)) AS doc, turn AS page_no, text FROM {conversations}"
#: Texts and what became of them: of every fifth one a word or a comma is lost.
PAIRS = """
SELECT doc_id AS doc, text AS source,
       CASE WHEN doc_id % 5 = 0 THEN concat(substring(text, 1, 40), ' añadido') WHEN doc_id % 5 = 1 THEN replace(text, ',', '') WHEN doc_id % 5 = 2 THEN concat(text, ' (fin)') ELSE text END AS made
FROM {documents}
"""
#: The name of a source for each order: a known one, or one that rules must tell, with years and other joints in turn.
SLUGS = """
SELECT o_orderkey AS id, concat(name, CASE WHEN k < 3 OR o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN '-2019' ELSE ' 1998' END) AS slug
FROM {orders} JOIN (SELECT * FROM (VALUES (0, 'codigo-civil-2026'), (1, 'temario-derecho-penal-2025'), (2, 'examen-incorporacion-caacr-2026'), (3, 'ley-general-de-la-administracion-publica'), (4, 'constitucion-politica'), (5, 'codigo-de-trabajo'), (6, 'codigo_tributario'), (7, 'jurisprudencia-sala-primera'), (8, 'manual-de-doctrina-civil'), (9, 'jurisprudencia-sala-constitucional'), (10, 'codigo-de-comercio'), (11, 'reglamento-de-transito'), (12, 'programa de estudio notarial'), (13, 'voto 123 sala'), (14, 'apuntes'), (15, 'procesal laboral norma'), (16, 'registro-publico-ley'), (17, 'ambiente y agraria'), (18, 'protocolo internacional menores'), (19, 'Cdigo de Comercio')) AS t(k, name)) n ON o_orderkey % 20 = k
"""
#: A file name for each order.
FILES = """
SELECT o_orderkey AS id, concat(name, ' ', CAST(o_custkey AS STRING), '.pdf') AS file
FROM {orders} JOIN (SELECT * FROM (VALUES (0, 'Cdigo Civil (2026)'), (1, 'Temario Derecho Penal 2025'), (2, 'EXAMEN Incorporacion'), (3, 'Mi codigo de comercio'), (4, 'Resolución número 5'), (5, '--raro--')) AS t(k, name)) n ON o_orderkey % 6 = k
"""
#: A Markdown file for every 200 documents of a source, an article for each document.
MARKDOWN = """
SELECT concat(coalesce(source, 'none'), '-', CAST((doc_id - doc_id % 200) / 200 AS STRING)) AS slug, doc_id, concat('## Artículo ', CAST(doc_id AS STRING), '

', coalesce(text, ''), '

') AS part FROM {documents}
"""
#: (qid, query): words that some dozens of the documents have.
QUERIES = """
SELECT * FROM (VALUES (0, 'estion ndat'), (1, 'the ndtion ated the'), (2, 'leque ément'), (3, 'enheit'), (4, 'zzzz'), (5, 'ciónos el')) AS t(qid, query)
"""
#: (qid, query): questions to the statutes.
STATUTE_QUERIES = "SELECT * FROM (VALUES (0, 'derogadas otras normas'), (1, 'la parte puede pedir 15 y 25'), (2, 'ley orgánica'), (3, 'artículo 777'), (4, 'zzzz')) AS t(qid, query)"
#: Passages as queries.
PASSAGES = "SELECT item_id AS qid, text AS query FROM {benchmark}"


def duck(sql: str) -> str:
    """The adapter as DuckDB reads it."""
    return re.sub(r"AS STRING\)", "AS VARCHAR)", re.sub(r"\{(\w+)\}", r"\1", sql)).replace("(o_orderkey - o_orderkey % 40) / 40", "(o_orderkey - o_orderkey % 40) // 40").replace("(o_orderkey - o_orderkey % 400) / 400", "(o_orderkey - o_orderkey % 400) // 400").replace("(doc_id - doc_id % 200) / 200", "(doc_id - doc_id % 200) // 200")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The adapter over the tables in sf_dir."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    text = sql.replace("(o_orderkey - o_orderkey % 40) / 40", "(o_orderkey - o_orderkey % 40) div 40").replace("(o_orderkey - o_orderkey % 400) / 400", "(o_orderkey - o_orderkey % 400) div 400").replace("(doc_id - doc_id % 200) / 200", "(doc_id - doc_id % 200) div 200")
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})
