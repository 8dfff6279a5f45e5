"""URL filters by a temporal list join: each capture is judged by the list entries that were active when it was fetched.

A list is a log of dated entries (list, key, action add or remove, day). Entries of a key become validity intervals
[day, next entry's day); a key is a domain, which covers its subdomains, or a domain and a path prefix. A capture meets
the keys of its own URL by an equi-join, and of each key the one interval that holds its fetch day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
FIRST_DAY = "2024-01-01"


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to): when each key was on each list; valid_to is null for an open end.

    entries: list, key, action, day. Of several entries of a key on a day a removal wins; repeated adds extend nothing:
    an interval ends at the key's next entry and the next add begins another. Entries without key, day or a known action
    count as none.
    """
    known = entries.where(F.col("action").isin("add", "remove") & F.col("key").isNotNull() & F.col("day").isNotNull())
    days = known.groupBy("list", F.lower("key").alias("key"), "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("list", "key").orderBy("day"))
    return days.withColumn("valid_to", until).where("action = 'add'").select("list", "key", F.col("day").alias("valid_from"), "valid_to")


def url_keys(url: Column) -> Column:
    """The keys that can cover a URL: its host and the host's parent domains, and the host with each prefix of its path."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    paths = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))
    keys = F.concat(domains, F.when(F.size(steps) > 0, paths).otherwise(F.array().cast("array<string>")))
    return F.when(host != "", F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """(id, host, fetched, n_active, matched, verdict) for every row of captures.

    The longest active key decides; of an allow and a block entry with the same key, block. verdict: block, allow or none.
    A null URL, a URL without host and a null fetch day meet no entry. Repeated rows are judged as one.
    """
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(day_col).alias("_day"))
    keyed = rows.select("*", F.explode(url_keys(F.col("_url"))).alias("key"))
    spans = intervals(entries)
    live = (keyed["key"] == spans["key"]) & (spans["valid_from"] <= keyed["_day"]) & (spans["valid_to"].isNull() | (keyed["_day"] < spans["valid_to"]))
    # an inner join, so that only captures with an active entry are summed up; its hot keys can be split or broadcast
    hits = keyed.join(spans, live).select("_id", "_url", "_day", keyed["key"], "list")
    strongest = F.max(F.struct(F.length("key").alias("n"), F.col("key"), F.col("list")))
    found = hits.groupBy("_id", "_url", "_day").agg(F.count("*").alias("n_active"), strongest.alias("top"))
    a, b = rows.distinct().alias("a"), found.alias("b")
    same = F.col("a._id").eqNullSafe(F.col("b._id")) & F.col("a._url").eqNullSafe(F.col("b._url")) & F.col("a._day").eqNullSafe(F.col("b._day"))
    return a.join(b, same, "left").select(
        F.col("a._id").alias(id_col),
        F.nullif(F.lower(F.regexp_extract("a._url", HOST, 1)), F.lit("")).alias("host"),
        F.col("a._day").alias(day_col),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("top.key").alias("matched"),
        F.coalesce("top.list", F.lit("none")).alias("verdict"),
    )


def _number(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("long")


def dated_entries(pages: DataFrame) -> DataFrame:
    """Entries for the pages' own hosts, as the tables hold no list: two thirds of the hosts are added on some day and removed on a later one, some come back, and some get an allow entry."""
    host = F.lower(F.regexp_extract("url", HOST, 1))
    hosts = pages.select(host.alias("key")).where("key <> ''").distinct().withColumn("n", _number(F.col("key")))
    first = F.to_date(F.lit(FIRST_DAY))
    day = lambda expr: F.date_add(first, (expr).cast("int"))
    n = F.col("n")
    made = [
        hosts.where(n % 3 > 0).select(F.lit("block").alias("list"), "key", F.lit("add").alias("action"), day(n % 400).alias("day")),
        hosts.where(n % 3 > 0).select(F.lit("block"), "key", F.lit("remove"), day(n % 400 + 30 + n % 200)),
        hosts.where(n % 3 == 2).select(F.lit("block"), "key", F.lit("add"), day(n % 400 + 260 + n % 200)),
        hosts.where(n % 5 == 0).select(F.lit("allow"), "key", F.lit("add"), day(n % 300)),
    ]
    out = made[0]
    for x in made[1:]:
        out = out.union(x)
    return out


def op1_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list as of its fetch day. The tables hold no fetch day: it follows from the page's id."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.to_date(F.lit(FIRST_DAY)), (F.col("page_id") % 730).cast("int"))
    return judge(pages.withColumn("fetched", fetched), dated_entries(pages))


ORACLE = r"""
WITH captures AS (
  SELECT DISTINCT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
         string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/') AS steps,
         DATE '2024-01-01' + CAST(page_id % 730 AS INTEGER) AS fetched
  FROM pages),
hosts AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS n FROM (SELECT DISTINCT host AS key FROM captures WHERE host <> '')),
entries AS (
  SELECT 'block' AS list, key, 'add' AS action, DATE '2024-01-01' + CAST(n % 400 AS INTEGER) AS day FROM hosts WHERE n % 3 > 0
  UNION ALL SELECT 'block', key, 'remove', DATE '2024-01-01' + CAST(n % 400 + 30 + n % 200 AS INTEGER) FROM hosts WHERE n % 3 > 0
  UNION ALL SELECT 'block', key, 'add', DATE '2024-01-01' + CAST(n % 400 + 260 + n % 200 AS INTEGER) FROM hosts WHERE n % 3 = 2
  UNION ALL SELECT 'allow', key, 'add', DATE '2024-01-01' + CAST(n % 300 AS INTEGER) FROM hosts WHERE n % 5 = 0),
days AS (SELECT list, key, day, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS until FROM days) WHERE action = 'add'),
labels_of AS (SELECT *, string_split(host, '.') AS labels, list_filter(steps, lambda s: s <> '') AS parts FROM captures WHERE host <> ''),
keyed AS (
  SELECT page_id, url, fetched, array_to_string(labels[i:], '.') AS key FROM labels_of, LATERAL (SELECT unnest(range(1, len(labels) + 1)) AS i)
  UNION SELECT page_id, url, fetched, host || '/' || array_to_string(parts[1:i], '/') FROM labels_of, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
hits AS (SELECT k.page_id, k.url, k.fetched, k.key, s.list FROM keyed k JOIN spans s ON k.key = s.key AND s.day <= k.fetched AND (s.until IS NULL OR k.fetched < s.until)),
found AS (SELECT page_id, url, fetched, count(*) AS n, max(struct_pack(n := length(key), key := key, list := list)) AS top FROM hits GROUP BY ALL)
SELECT c.page_id, nullif(c.host, '') AS host, c.fetched, coalesce(f.n, 0) AS n_active, f.top.key AS matched, coalesce(f.top.list, 'none') AS verdict
FROM captures c LEFT JOIN found f ON c.page_id = f.page_id AND c.url = f.url
"""
