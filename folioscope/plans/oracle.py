"""The catalog's results in DuckDB's SQL, written apart from the Spark plans."""

from __future__ import annotations

from folioscope.plans import adapters

CH = adapters.duck(adapters.CHUNKS)
ST = adapters.duck(adapters.STATUTES)
LI = adapters.duck(adapters.LINES)
PG = adapters.duck(adapters.PAGES)
PR = adapters.duck(adapters.PAIRS)
SL = adapters.duck(adapters.SLUGS)
FI = adapters.duck(adapters.FILES)
QU = adapters.duck(adapters.QUERIES)
PA = adapters.duck(adapters.PASSAGES)
TOKENS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"


def toks(x: str) -> str:
    return TOKENS.format(x)


INDEX = f"""
ch AS ({CH}),
toks AS (SELECT rid, {toks("text")} AS t FROM ch),
terms AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM toks) GROUP BY ALL),
lens AS (SELECT rid, len(t) AS dl FROM toks),
dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens)"""


def bm25(queries: str, k: int, where: str = "true", name: str = "bm") -> str:
    return f"""
qs AS (SELECT CAST(qid AS BIGINT) AS qid, query FROM ({queries})),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({toks("query")}) AS term FROM qs) GROUP BY ALL),
sc AS (SELECT qid, rid, sum(times * CASE WHEN (n - df + 0.5) / (df + 0.5) <= 1 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN terms USING (term) JOIN dfs USING (term) JOIN lens USING (rid) JOIN ch USING (rid), tot WHERE {where} GROUP BY ALL),
{name} AS (SELECT qid, rid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rid) AS rank FROM sc) WHERE rank <= {k})"""


#: CRC-32 of a text's bytes, by a table made from the polynomial.
CRC = """
crc_steps(i, k, v) AS (SELECT CAST(i AS UBIGINT), 0, CAST(i AS UBIGINT) FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE k = 8)"""


def features(rows: str, key: str, text: str, name: str) -> str:
    return f"""
{name}_w AS (SELECT {key}, unnest(regexp_extract_all(translate(lower({text}), 'äçèéêíñóöü', 'aceeeinoou'), '[a-z0-9]+')) AS w FROM {rows}),
{name}_f AS (SELECT {key}, 'w:' || w AS feature FROM {name}_w UNION ALL
  SELECT {key}, 'c:' || substr('#' || w || '#', i, 4) FROM (SELECT {key}, w, unnest(range(1, len(w) - 0)) AS i FROM {name}_w WHERE len(w) >= 5)),
{name}_n AS (SELECT {key}, feature, count(*) AS tf FROM {name}_f GROUP BY ALL),
{name}_d AS (SELECT feature, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(feature) + 1), lambda i: CAST(ascii(substr(feature, i, 1)) AS UBIGINT))),
    lambda a, x: xor(t[CAST(xor(a, x) & 255 AS BIGINT) + 1], a >> 8)), 4294967295::UBIGINT) % 1048576 AS INTEGER) AS dim FROM (SELECT DISTINCT feature FROM {name}_n), crc_table),
{name} AS (SELECT {key}, feature, dim, tf FROM {name}_n JOIN {name}_d USING (feature))"""


SPARSE = f"""
{CRC},
{features("ch", "rid", "text", "cf")},
sdf AS (SELECT dim, count(DISTINCT rid) AS df FROM cf GROUP BY dim),
idf AS (SELECT dim, ln(n / df) AS v FROM sdf, (SELECT count(*) AS n FROM ch) WHERE df < n),
raw AS (SELECT rid, dim, sum((1 + ln(tf)) * v) AS x FROM cf JOIN idf USING (dim) GROUP BY ALL),
post AS (SELECT rid, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY rid)), 5) AS w FROM raw)"""


def cosine(k: int, name: str = "cs") -> str:
    return f"""
{features("qs", "qid", "query", "qf")},
qraw AS (SELECT qid, dim, sum((1 + ln(tf)) * round(v, 5)) AS x FROM qf JOIN idf USING (dim) WHERE v > 0 GROUP BY ALL),
qvec AS (SELECT qid, dim, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS q FROM qraw),
csc AS (SELECT qid, rid, sum(q * w) AS score FROM qvec JOIN post USING (dim) GROUP BY ALL),
{name} AS (SELECT qid, rid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rid) AS rank FROM csc) WHERE rank <= {k})"""


def hybrid(where: str) -> str:
    return f"""
fused AS (SELECT qid, rid, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT qid, rid, rank FROM bm UNION ALL SELECT qid, rid, rank FROM cs) GROUP BY ALL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, rid) AS place FROM fused) WHERE place <= 200),
hits AS (SELECT p.qid, p.rrf, c.*, max(p.rrf) OVER (PARTITION BY p.qid) AS best FROM pool p JOIN ch c USING (rid) WHERE {where}),
cutoff AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, rid) AS rank FROM hits WHERE rrf >= best * 0.3) WHERE rank <= 25)"""


DENSE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings),
s AS (SELECT q.vec_id AS qid, v.vec_id AS rid, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS score FROM v, v q WHERE q.vec_id % 50 = 0)
SELECT qid, CAST(rank AS INTEGER) AS rank, rid, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rid) AS rank FROM s) WHERE rank <= 10"""


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def flat(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def clean(x: str) -> str:
    """Of the audit, as far as the test texts need it."""
    for pattern in (r"(?i)ficha\s+articulo", r"https?://\S+|www\.\S+", r"(?i)\btexto completo acta:\s*\w+", r"\b[0-9]{1,4}\s+de\s+[0-9]{1,4}\b"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return x


SECTIONS = f"""
li AS ({LI}),
marked AS (SELECT *, line LIKE '### %' AS d, line LIKE '## %' AS h, sum((line LIKE '### %')::INT) OVER w AS sec, sum((line LIKE '### %' OR line LIKE '## %')::INT) OVER w AS unit,
  last_value(CASE WHEN line LIKE '### %' THEN trim(substr(line, 5)) END IGNORE NULLS) OVER w AS structure FROM li WINDOW w AS (PARTITION BY slug ORDER BY pos ROWS UNBOUNDED PRECEDING)),
units AS (SELECT slug, unit, min(pos) AS pos, arg_min(line, pos) AS line, arg_min(h, pos) AS h, min(sec) AS sec, arg_min(coalesce(structure, ''), pos) AS structure,
  {strip("coalesce(string_agg(CASE WHEN NOT d AND NOT h THEN line END, chr(10) ORDER BY pos), '')")} AS body FROM marked WHERE unit > 0 GROUP BY slug, unit),
arts AS (SELECT slug, pos, trim(substr(line, 4)) AS heading, sec, structure, body FROM units WHERE h AND body <> '')"""

HEAD = r"(?i)art[ií]culos?\b[\s:]*([0-9]{1,4}(?:\s*(?:bis|ter))?(?:(?:[\s,ye]+|\s+a\s+)[0-9]{1,4}(?:\s*(?:bis|ter))?)*)"
REFS = rf"""
st AS ({ST}),
spans AS (SELECT rid, slug, article, text, unnest(regexp_extract_all(text, '{HEAD}((?s:.{{0,20}}))', 1)) AS region, unnest(regexp_extract_all(text, '{HEAD}((?s:.{{0,20}}))', 2)) AS tail FROM st),
own AS (SELECT * FROM spans WHERE NOT regexp_matches(tail, '(?i)^\s*(?:de\s+la\s+(?:ley|constituci|convenci)|de\s+los?\s+c[oó]digos?|del\s+c[oó]digo)')),
refs AS (SELECT DISTINCT rid, slug, article, dst FROM (
  SELECT rid, slug, article, unnest(regexp_extract_all(region, '[0-9]{{1,4}}')) AS dst FROM own
  UNION ALL SELECT rid, slug, article, CAST(unnest(range(a, b + 1)) AS VARCHAR) FROM (
    SELECT rid, slug, article, CAST(regexp_extract(r, '^[0-9]+') AS BIGINT) AS a, CAST(regexp_extract(r, '[0-9]+$') AS BIGINT) AS b FROM (SELECT rid, slug, article, unnest(regexp_extract_all(region, '[0-9]{{1,4}}\s+a\s+[0-9]{{1,4}}')) AS r FROM own)) WHERE b > a AND b - a <= 50)),
edges AS (SELECT r.slug, r.article AS src, r.dst FROM refs r WHERE r.dst <> r.article AND EXISTS (SELECT 1 FROM st s WHERE s.slug = r.slug AND s.article = r.dst)),
inforce AS (SELECT *, NOT regexp_matches({strip("text")}, '(?i)^\(?\s*(?:derogad[oa]s?\b|sin\s+vigencia\b|t[eé]ngase\s+por\s+derogad)') AS ok FROM st)"""

def related(select: str) -> str:
    return f"""WITH {REFS}, found AS ({select})
SELECT slug, article, other, CAST(row_number() OVER (PARTITION BY slug, article ORDER BY coalesce(TRY_CAST(regexp_extract(other, '^[0-9]+') AS INTEGER), 9999), other) AS INTEGER) AS place FROM (SELECT DISTINCT * FROM found)"""


#: What the rules must say of the sources' names, in the adapter's order.
EXPECTED = """
(0, 'ley', 'Derecho Civil', 'Código Civil'), (1, 'temario', 'Derecho Penal', 'Temario de Derecho Penal'), (2, 'examen', 'General', 'Examen de Incorporación CAACR 2026'), (3, 'ley', 'Derecho Administrativo', 'Ley General De La Administracion Publica'), (4, 'ley', 'Derecho Constitucional', 'Constitucion Politica'), (5, 'ley', 'Derecho Laboral', 'Código De Trabajo'), (6, 'ley', 'Derecho Tributario', 'Código Tributario'), (7, 'jurisprudencia', 'General', 'Jurisprudencia Sala Primera'), (8, 'doctrina', 'Derecho Civil', 'Manual De Doctrina Civil'), (9, 'jurisprudencia', 'Derecho Constitucional', 'Jurisprudencia Sala Constitucional'), (10, 'ley', 'Derecho Comercial', 'Código De Comercio'), (11, 'ley', 'General', 'Reglamento De Transito'), (12, 'temario', 'Derecho Notarial', 'Programa De Estudio Notarial'), (13, 'jurisprudencia', 'General', 'Voto 123 Sala'), (14, 'otro', 'General', 'Apuntes'), (15, 'ley', 'Derecho Procesal Laboral', 'Procesal Laboral Norma'), (16, 'ley', 'Derecho Registral', 'Registro Publico Ley'), (17, 'otro', 'Derecho Ambiental', 'Ambiente Y Agraria'), (18, 'ley', 'Derecho de la Niñez', 'Protocolo Internacional Menores'), (19, 'otro', 'Derecho Comercial', 'Código De Comercio')
"""

BLOCKS = rf"list_filter(list_transform(regexp_split_to_array({{}}, '\n\s*\n'), lambda b: {flat('b')}), lambda b: b <> '' AND NOT regexp_matches(b, '(?i)^[0-9]{{{{1,4}}}}(\s+de\s+[0-9]{{{{1,4}}}})?$'))"
PAGE = rf"""
raw AS (SELECT doc, count(*) AS n_pages, string_agg('1/2/24, 10:30 Texto Completo norma.html 1/9' || chr(10) || chr(10) || 'TÍTULO ' || page_no || chr(10) || chr(10) || 'Ficha articulo Artículo ' || (page_no + 1) || 'º.- '
   || text || ' Artículo ' || (page_no + 100) || ' BIS.- fin http://x.y/z' || chr(10) || chr(10) || '12 de 30' || chr(10) || chr(10), chr(10) ORDER BY page_no) AS raw FROM ({PG}) GROUP BY doc),
bare AS (SELECT doc, n_pages, regexp_replace(regexp_replace(raw, '(?is)[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}},\s*[0-9]{{1,2}}:[0-9]{{2}}\s*Texto Completo.*?\.html\s*[0-9]+\s*/\s*[0-9]+', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g') AS raw FROM raw)"""
CORE = r"art[ií]culo\s+([0-9]+|[úu]nico)\s*(bis|ter)?\s*[ºo°ªa]?\s*[.\-]+\s*"

SQL = {
    "fold_tokens_df": f"WITH {INDEX} SELECT term, df FROM dfs",
    "term_index": f"WITH {INDEX} SELECT rid, dl, coalesce(a, 0) AS n_terms, CAST(coalesce(b, 0) AS BIGINT) AS n_tokens, coalesce(c, 0) AS max_tf FROM lens LEFT JOIN (SELECT rid, count(*) AS a, sum(tf) AS b, max(tf) AS c FROM terms GROUP BY rid) USING (rid)",
    "bm25_topk": f"WITH {INDEX}, {bm25(QU, 10)} SELECT qid, CAST(rank AS INTEGER) AS rank, rid, round(score, 4) AS score FROM bm",
    "bm25_topk_by_source": f"WITH {INDEX}, {bm25(QU, 10, 'slug = $$src3$$')} SELECT qid, CAST(rank AS INTEGER) AS rank, rid, round(score, 4) AS score FROM bm",
    "bm25_phrase": f"""WITH {INDEX},
places AS (SELECT rid, t, unnest(range(1, len(t))) AS i FROM toks),
pairs AS (SELECT rid, t[i] AS a, t[i + 1] AS b FROM places),
ph AS (SELECT 0::BIGINT AS qid, 'of' AS a, 'the' AS b UNION ALL SELECT 1, 'and', 'the'),
hits AS (SELECT qid, rid, count(*) AS tf FROM pairs JOIN ph USING (a, b) GROUP BY ALL),
every AS (SELECT qid, rid, tf, count(*) OVER (PARTITION BY qid) AS df FROM hits UNION ALL SELECT 1, rid, tf, df FROM terms JOIN dfs USING (term) WHERE term = 'of'),
sc AS (SELECT qid, rid, sum(CASE WHEN (n - df + 0.5) / (df + 0.5) <= 1 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM every JOIN lens USING (rid), tot GROUP BY ALL)
SELECT qid, CAST(rank AS INTEGER) AS rank, rid, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rid) AS rank FROM sc) WHERE rank <= 10""",
    "lexical_snippet": f"""WITH {INDEX}, {bm25(QU, 5)},
q AS (SELECT qid, list_distinct({toks("query")}) AS terms FROM qs),
s AS (SELECT b.qid, b.rank, b.rid, c.citation, c.doc_type, q.terms, regexp_extract_all(c.text, '[\\p{{L}}\\p{{N}}]+') AS f, regexp_split_to_array(c.text, '[\\p{{L}}\\p{{N}}]+') AS g FROM bm b JOIN ch c USING (rid) JOIN q USING (qid)),
w AS (SELECT *, unnest(range(0, greatest(len(f) - 16, 0) + 1)) AS i FROM s),
p AS (SELECT *, len(list_intersect(list_distinct(list_transform(f[i + 1:i + 16], lambda x: lower(strip_accents(x)))), terms)) AS n FROM w),
best AS (SELECT qid, rank, rid, citation, doc_type, any_value(terms) AS terms, any_value(f) AS f, any_value(g) AS g, arg_max(i, n * 1000000 - i) AS i FROM p GROUP BY ALL)
SELECT qid, CAST(rank AS INTEGER) AS rank, rid, citation, doc_type, CASE WHEN i > 0 THEN ' … ' ELSE g[1] END ||
 array_to_string(list_transform(range(i + 1, least(i + 16, len(f)) + 1), lambda k: CASE WHEN k = i + 1 THEN '' ELSE g[k] END || CASE WHEN list_contains(terms, lower(strip_accents(f[k]))) THEN '«' || f[k] || '»' ELSE f[k] END), '')
 || CASE WHEN i + 16 < len(f) THEN ' … ' ELSE g[len(g)] END AS snippet FROM best""",
    "sparse_features": f"WITH RECURSIVE {INDEX}, {SPARSE} SELECT feature, dim, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM cf GROUP BY feature, dim",
    "sparse_idf": f"WITH RECURSIVE {INDEX}, {SPARSE} SELECT dim, round(round(v, 5), 4) AS v FROM idf",
    "sparse_cosine_topk": f"WITH RECURSIVE {INDEX}, {SPARSE}, qs AS (SELECT CAST(qid AS BIGINT) AS qid, query FROM ({QU})), {cosine(10)} SELECT qid, CAST(rank AS INTEGER) AS rank, rid, round(score, 3) AS score FROM cs",
    "dense_batch_topk": DENSE,
    "rrf_fuse": f"WITH RECURSIVE {INDEX}, {SPARSE}, {bm25(QU, 50)}, {cosine(50)} SELECT qid, rid, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf FROM (SELECT qid, rid, rank FROM bm UNION ALL SELECT qid, rid, rank FROM cs) GROUP BY qid, rid",
    "hybrid_adaptive": f"WITH RECURSIVE {INDEX}, {SPARSE}, {bm25(QU, 200)}, {cosine(200)}, {hybrid('vigente = 1')} SELECT qid, CAST(rank AS INTEGER) AS rank, rid, round(rrf, 4) AS score, citation, vigente = 1 AS vigente FROM cutoff",
    "hybrid_filtered": f"WITH RECURSIVE {INDEX}, {SPARSE}, {bm25(QU, 200, 'slug = $$src3$$')}, {cosine(200)}, {hybrid('vigente = 1 AND c.slug = $$src3$$ AND c.doc_type IN ($$en$$, $$fr$$)')} SELECT qid, CAST(rank AS INTEGER) AS rank, rid, round(rrf, 4) AS score, doc_type FROM cutoff",
    "hybrid_batch": f"""WITH RECURSIVE {INDEX}, {SPARSE}, {bm25(PA, 200)}, {cosine(200)}, {hybrid("true")}
SELECT qid, CAST(rank AS INTEGER) AS rank, rid, round(rrf, 4) AS score FROM cutoff""",
    "rerank_cut": f"""WITH RECURSIVE {INDEX}, {SPARSE}, {bm25(QU, 200)}, {cosine(200)}, {hybrid("true")},
scored AS (SELECT p.qid, p.rid, CAST(len(list_intersect(list_distinct({toks("q.query")}), list_distinct({toks("c.text")}))) AS DOUBLE) AS s FROM pool p JOIN ch c USING (rid) JOIN qs q USING (qid)),
best AS (SELECT *, max(s) OVER (PARTITION BY qid) AS top FROM scored)
SELECT qid, CAST(rank AS INTEGER) AS rank, rid, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rid) AS rank FROM best WHERE s >= top - 0.5) WHERE rank <= 25""",
    "exact_lookup": f"SELECT rid, citation, vigente = 1 AS vigente, vigente <> 1 AS derogado, text FROM ({CH}) WHERE article = '45' OR (article = '103' AND slug = 'src3')",
    "paragraph_chunks": f"""SELECT rid, count(*) AS n, CAST(sum(length(p)) AS BIGINT) AS chars, min(length(p)) AS shortest
FROM (SELECT rid, {strip("regexp_replace(" + strip("unnest(string_split(text, chr(10)))") + ", '^[# ]+', '')")} AS p FROM ({CH})) WHERE length(p) >= 15 GROUP BY rid""",
    "sectionize": rf"WITH {SECTIONS} SELECT slug, heading, nullif(trim(regexp_extract(heading, '^Art[ií]culo\s+(.+)$', 1)), '') AS article, CAST(sec AS BIGINT) AS sec, structure, body FROM arts",
    "numbered_chunks": f"WITH {SECTIONS} SELECT row_number() OVER (ORDER BY slug, pos) AS rid, slug, heading FROM arts",
    "frontmatter_kv": r"""SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN 'reference' END AS type, CASE WHEN doc_id % 10 > 0 THEN source END AS from_source, CASE WHEN doc_id % 10 > 0 THEN 'a: b' END AS note, CASE WHEN doc_id % 10 > 0 THEN lang END AS from_lang,
 length(text) + CASE WHEN doc_id % 10 > 0 THEN 1 ELSE 0 END AS body_chars, length(text) AS strict_chars FROM documents""",
    "inforce_flag": f"WITH {REFS} SELECT slug, article, ok AS in_force FROM inforce",
    "split_notes": f"""WITH st AS ({ST}), parts AS (SELECT slug, article, text, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: {flat("p")}), lambda p: p <> '') AS ps FROM st)
SELECT slug, article, CASE WHEN len(list_filter(ps, lambda p: NOT regexp_matches(p, '(?i)^\\(\\s*as[ií]\\s+reformad'))) = 0 THEN text ELSE array_to_string(list_filter(ps, lambda p: NOT regexp_matches(p, '(?i)^\\(\\s*as[ií]\\s+reformad')), ' ') END AS operative,
 array_to_string(list_filter(ps, lambda p: regexp_matches(p, '(?i)^\\(\\s*as[ií]\\s+reformad')), ' ') AS notes FROM parts""",
    "classify_sources": f"SELECT id, slug, doc_type, rama, label, doc_type IN ('ley', 'jurisprudencia') AS is_law FROM ({SL}) JOIN (VALUES {EXPECTED}) t(k, doc_type, rama, label) ON id % 20 = k",
    "file_names": f"SELECT id, file, concat(name, '-', regexp_extract(file, '([0-9]+)[.]pdf$', 1)) AS slug, kind FROM ({FI}) JOIN (VALUES (0, 'codigo-civil', 'codigo'), (1, 'temario-derecho-penal-2025', 'temario'), (2, 'examen-incorporacion', 'examen'), (3, 'mi-codigo-de-comercio', 'codigo'), (4, 'resolucion-numero-5', 'generic'), (5, 'raro', 'generic')) t(k, name, kind) ON id % 6 = k",
    "refs_extract": f"WITH {REFS} SELECT article, dst FROM refs",
    "ref_edges": f"WITH {REFS} SELECT slug, src, dst FROM edges",
    "related_cites": related("SELECT slug, src AS article, dst AS other FROM edges"),
    "related_cited_by": related("SELECT slug, dst AS article, src AS other FROM edges"),
    "related_neighbors": f"""WITH {REFS}
SELECT a.slug, a.article, count(*) AS n, arg_min(b.article, CAST(b.article AS BIGINT)) AS first FROM st a JOIN st b ON a.section = b.section AND a.article <> b.article GROUP BY a.slug, a.article""",
    "citation_fallback": f"SELECT w.slug, w.article, coalesce(s.citation, w.slug || ' art. ' || w.article) AS citation FROM (VALUES ('code-0', '10'), ('code-1', '11'), ('code-1', '10'), ('none', '1')) w(slug, article) LEFT JOIN ({ST}) s ON s.slug = w.slug AND s.article = w.article",
    "consult_related": f"""WITH {INDEX.replace(CH, ST)}, {bm25(adapters.STATUTE_QUERIES, 25)}, {REFS},
core AS (SELECT qid, rank, st.slug, st.article FROM bm JOIN st USING (rid)),
seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS seed FROM core) WHERE seed <= 6),
rel AS (SELECT s.qid, s.seed, 0 AS step, e.slug, e.dst AS article, 'cita' AS relation FROM seeds s JOIN edges e ON e.slug = s.slug AND e.src = s.article
  UNION ALL SELECT s.qid, s.seed, 1, e.slug, e.src, 'citado_por' FROM seeds s JOIN edges e ON e.slug = s.slug AND e.dst = s.article
  UNION ALL SELECT s.qid, s.seed, 2, s.slug, b.article, 'misma_materia' FROM seeds s JOIN st a ON a.slug = s.slug AND a.article = s.article JOIN st b ON b.section = a.section AND b.article <> a.article WHERE s.seed <= 2),
ordered AS (SELECT *, row_number() OVER (PARTITION BY qid, slug, article ORDER BY seed, step) AS k FROM rel r WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.qid = r.qid AND c.slug = r.slug AND c.article = r.article)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY seed, step, CAST(article AS INTEGER), article, slug) AS place FROM ordered WHERE k = 1)
SELECT f.qid, CAST(f.place AS INTEGER) AS place, f.slug, f.article, f.relation, i.citation, i.ok AS vigente, CASE WHEN length({flat("i.text")}) <= 220 THEN {flat("i.text")} ELSE substr({flat("i.text")}, 1, 220) || ' …' END AS excerpt
FROM firsts f JOIN inforce i ON i.slug = f.slug AND i.article = f.article WHERE f.place <= 40""",
    "consult_groups": f"""WITH {INDEX}, {bm25(QU, 25)}, g AS (SELECT qid, c.name, max(round(score, 4)) AS best, min(rank) AS first FROM bm JOIN ch c USING (rid) GROUP BY ALL)
SELECT qid, name, CAST(row_number() OVER (PARTITION BY qid ORDER BY best DESC, first) AS INTEGER) AS group_place, best AS best_score FROM g""",
    "topic_hits": f"WITH {INDEX}, {bm25(QU, 6, 'doc_type = $$en$$')} SELECT qid, CAST(rank AS INTEGER) AS rank, c.citation, c.rama, CASE WHEN length({flat('c.text')}) <= 100 THEN {flat('c.text')} ELSE substr({flat('c.text')}, 1, 100) || ' …' END AS topic FROM bm JOIN ch c USING (rid)",
    "focus_window": f"""WITH ch AS ({CH}), long AS (SELECT rid, text, lower(strip_accents(text)) AS folded FROM ch WHERE length(text) > 1800),
places AS (SELECT rid, text, folded, unnest(range(900, length(text) - 899, 250)) AS i FROM long),
scored AS (SELECT rid, text, i, (contains(w, 'estion')::INT + contains(w, 'ndtion')::INT + contains(w, 'ement')::INT + contains(w, 'heit')::INT) AS s FROM (SELECT *, substr(folded, i + 1, 900) AS w FROM places)),
best AS (SELECT rid, text, arg_max(i, s * 1000000 - i) AS i FROM scored GROUP BY rid, text),
made AS (SELECT rid, substr(text, 1, 900) || ' … ' || substr(text, CAST(i AS BIGINT) + 1, 900) AS f FROM best)
SELECT rid, length(f) AS n, md5(f) AS digest FROM made""",
    "excerpts": f"SELECT rid, CASE WHEN length(t) <= 100 THEN t ELSE substr(t, 1, 100) || ' …' END AS excerpt FROM (SELECT rid, {flat('text')} AS t FROM ({CH}))",
    "fidelity_words": rf"""WITH p AS ({PR}), w AS (
  SELECT doc, unnest(regexp_extract_all(replace(lower({clean("source")}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')) AS word, 1 AS s FROM p UNION ALL SELECT doc, unnest(regexp_extract_all(replace(lower({clean("made")}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')), -1 FROM p),
d AS (SELECT doc, word, sum(s) AS d FROM w GROUP BY ALL HAVING sum(s) <> 0)
SELECT doc, CAST(sum(greatest(d, 0)) AS BIGINT) AS lost, CAST(sum(greatest(-d, 0)) AS BIGINT) AS added, count(*) AS words FROM d GROUP BY doc""",
    "fidelity_commas": f"SELECT doc, a AS source_commas, b AS made_commas, a = b AS ok FROM (SELECT doc, length(s) - length(replace(s, ',', '')) AS a, length(m) - length(replace(m, ',', '')) AS b FROM (SELECT doc, {clean('source')} AS s, {clean('made')} AS m FROM ({PR})))",
    "fidelity_punct": f"""WITH p AS ({PR}), c AS (SELECT doc, unnest(regexp_extract_all({clean("source")}, '[,;:()¿?¡!«»]')) AS sign, 1 AS a, 0 AS b FROM p UNION ALL SELECT doc, unnest(regexp_extract_all({clean("made")}, '[,;:()¿?¡!«»]')), 0, 1 FROM p)
SELECT doc, sign, CAST(sum(a) AS BIGINT) AS in_source, CAST(sum(b) AS BIGINT) AS in_made FROM c GROUP BY doc, sign""",
    "fidelity_verdict": rf"""WITH p AS (SELECT doc, {clean("source")} AS s, {clean("made")} AS m FROM ({PR})),
v AS (SELECT doc, list_sort(regexp_extract_all(replace(lower(s), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')) = list_sort(regexp_extract_all(replace(lower(m), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')) AND list_sort(regexp_extract_all(s, '[,;:()¿?¡!«»]')) = list_sort(regexp_extract_all(m, '[,;:()¿?¡!«»]')) AS ok FROM p)
SELECT count(*) AS documents, count(*) FILTER (ok) AS good, bool_and(ok) AS ok FROM v""",
    "article_resegment": rf"""WITH {PAGE}, split AS (SELECT doc, unnest({BLOCKS.format(rf"regexp_replace(regexp_replace(raw, '(?i)ficha\s+articulo', chr(10) || chr(10), 'g'), '(?i)({CORE})', chr(10) || chr(10) || '\1', 'g')")}) AS b FROM bare),
kinds AS (SELECT doc, CASE WHEN regexp_matches(b, '(?i)^{CORE}') THEN 'a' WHEN regexp_matches(b, '(?i)^(libro|t[ií]tulo|cap[ií]tulo|secci[oó]n|disposiciones|parte)\b') AND length(b) < 90 THEN 's' ELSE 't' END AS kind FROM split)
SELECT doc, count(*) FILTER (kind = 'a') AS n_article, count(*) FILTER (kind = 's') AS n_structure, count(*) FILTER (kind = 't') AS n_text FROM kinds GROUP BY doc""",
    "outline_lines": rf"""WITH r AS (SELECT doc, 'Intro' || chr(10) || chr(10) || '3 de 9' || chr(10) || ' Temario de prueba ' || chr(10) || 'el temario' || chr(10) || string_agg(text, chr(10) ORDER BY page_no) AS raw FROM ({PG}) GROUP BY doc),
l AS (SELECT doc, list_filter(list_transform(string_split(raw, chr(10)), lambda s: {strip("s")}), lambda s: s <> '' AND NOT regexp_full_match(s, '[0-9]{{1,4}}\s+de\s+[0-9]{{1,4}}')) AS ls FROM r)
SELECT doc, md5(array_to_string(list_transform(ls, lambda s, i: CASE WHEN i = 2 THEN '# ' || s ELSE s END), chr(10) || chr(10))) AS digest FROM l""",
    "page_noise": f"WITH {PAGE} SELECT doc, n_pages, len({BLOCKS.format('raw')}) AS n_blocks FROM bare",
    "page_density": f"""WITH p AS (SELECT doc, text, row_number() OVER (PARTITION BY doc ORDER BY page_no) AS k, count(*) OVER (PARTITION BY doc) AS n FROM ({PG})), d AS (SELECT doc, n, sum(length(text)) FILTER (k <= 5)::DOUBLE / least(n, 5) AS per FROM p GROUP BY doc, n)
SELECT doc, n AS n_pages, round(per, 4) AS per_page, CASE WHEN per > 200 THEN 'DIGITAL (texto)' ELSE 'ESCANEADO? (OCR)' END AS kind FROM d""",
    "corpus_report": f"""WITH s AS (SELECT slug AS doc, count(*) AS n_pages, CAST(sum(vigente) AS BIGINT) AS n_articles, CAST(sum(length(text)) AS BIGINT) AS chars FROM ({CH}) GROUP BY slug), t AS (SELECT *, CAST(round_even(chars / 4, 0) AS BIGINT) AS tokens FROM s)
SELECT * FROM t UNION ALL SELECT NULL, NULL, NULL, CAST(sum(chars) AS BIGINT), CAST(sum(tokens) AS BIGINT) FROM t""",
    "index_report": f"WITH {REFS} SELECT (SELECT count(*) FROM st) AS chunks, (SELECT count(DISTINCT slug) FROM st) AS documents, (SELECT count(*) FROM inforce WHERE NOT ok) AS repealed, (SELECT count(*) FROM edges) AS edges",
}
SQL |= {
    "stored_bm25_topk": SQL["bm25_topk"],
    "stored_phrase": SQL["bm25_phrase"],
    "stored_hybrid": SQL["hybrid_adaptive"],
    "refreshed_search": f"WITH RECURSIVE {INDEX}, {SPARSE}, {bm25(QU, 10)}, {cosine(10)} SELECT 'words' AS list, qid, CAST(rank AS INTEGER) AS rank, round(score, 3) AS score FROM bm UNION ALL SELECT 'vectors', qid, CAST(rank AS INTEGER), round(score, 3) FROM cs",
}
