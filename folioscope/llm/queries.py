"""The operators' queries and, where SQL can express them, the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import chat, cobucket, collocations, urls
from folioscope.llm.jaccard import op4_universe_partition_join
from folioscope.llm.media import op8_media_columns
from folioscope.llm.mixing import op9_pareto_mix
from folioscope.llm.packing import op5_minimum_bin_slack
from folioscope.llm.quality import op2_naive_bayes_support_vectors
from folioscope.llm.recompress import op7_recompression
from folioscope.llm.sharding import op3_longest_processing_time
from folioscope.llm.tokens import op10_record_files
from folioscope.llm.topk import op6_tiled_top_k


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        urls.op1_temporal_list_join,
        op2_naive_bayes_support_vectors,
        op3_longest_processing_time,
        op4_universe_partition_join,
        op5_minimum_bin_slack,
        op6_tiled_top_k,
        op7_recompression,
        op8_media_columns,
        op9_pareto_mix,
        op10_record_files,
        cobucket.op11_co_bucketed_pair,
        collocations.op12_position_bitmaps,
        chat.op13_chat_formatting,
    ]
    return {f.__name__: f for f in made}


#: The ten best integer inner products of every hundredth vector.
TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v JOIN v q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

#: Words outside every window of 13 that also starts in a smaller document.
REPEATS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
least AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (k) WHERE d < win.doc_id)),
words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {urls.op1_temporal_list_join.__name__: urls.ORACLE, op6_tiled_top_k.__name__: TOP_K, op7_recompression.__name__: REPEATS, collocations.op12_position_bitmaps.__name__: collocations.ORACLE, chat.op13_chat_formatting.__name__: chat.ORACLE}
