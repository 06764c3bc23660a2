"""Temporal URL lists: dated entries become validity intervals, joined as of each capture's fetch time.

A list is a log of (scope, pattern, action, at): scope ``host`` (that host), ``domain`` (it and its
subdomains) or ``prefix`` (host and leading path segments); action ``add`` or ``remove``. An entry holds
from its ``add`` until the next ``remove`` of the same scope and pattern, or for ever; a further ``add``
meanwhile changes nothing; at equal times ``remove`` comes last. A capture meets, under each key its URL
has, the intervals that contain its fetch time.

A capture has as many keys as its host has labels and its path has segments, whatever the lists hold, so
the join grows with the captures. Intervals are broadcast only below a counted size; beyond it Spark
joins on the key and splits keys that many captures share.

Defined results: a null or hostless URL or a null fetch time matches nothing; entries with a null
field or another scope or action are ignored; repeated entries count once; repeated captures give
repeated rows; empty lists block nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.llm.common import broadcast_if, stage

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The lower-cased host, or null."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(scope, pattern, since, until): maximal times at which an entry is active; until is null for ever."""
    log = entries.select("scope", F.lower("pattern").alias("pattern"), "action", F.col("at").cast("timestamp").alias("at"))
    log = log.filter(F.col("scope").isin("host", "domain", "prefix") & F.col("action").isin("add", "remove") & F.col("pattern").isNotNull() & F.col("at").isNotNull())
    log = log.groupBy("scope", "pattern", "at").agg(F.max("action").alias("action"))
    by = Window.partitionBy("scope", "pattern").orderBy("at")
    turns = log.withColumn("before", F.lag("action").over(by)).filter((F.col("action") == "add") & (F.coalesce("before", F.lit("remove")) == "remove") | (F.col("action") == "remove") & (F.col("before") == "add"))
    return turns.select("scope", "pattern", F.col("at").alias("since"), F.lead("at").over(by).alias("until"), "action").filter("action = 'add'").drop("action")


def keys_of(url: Column) -> Column:
    """The (scope, pattern) keys under which a URL can be listed."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("scope"), F.array_join(F.slice(labels, i, 1 << 20), ".").alias("pattern")))
    segments = F.filter(F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))), lambda i: F.struct(F.lit("prefix").alias("scope"), F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")).alias("pattern")))
    exact = F.array(F.struct(F.lit("host").alias("scope"), host.alias("pattern")))
    return F.when(host.isNotNull(), F.concat(exact, domains, prefixes))


def evaluate(captures: DataFrame, active: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """page_id, url, host, fetched_at, n_active (entries that hold), matched (the first of them, as
    scope:pattern), since (when the oldest began) and blocked, a row per capture."""
    active = stage(active, "intervals")
    rows = stage(captures.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("bigint").alias("page_id"), "url", F.col("fetched_at").cast("timestamp").alias("fetched_at")), "captures")
    keyed = rows.select("row", "fetched_at", F.explode(keys_of(F.col("url"))).alias("key")).select("row", "fetched_at", "key.scope", "key.pattern")
    listed = broadcast_if(active, active.count(), broadcast_rows)
    met = keyed.join(listed, ["scope", "pattern"]).filter((F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    met = met.groupBy("row").agg(F.count(F.lit(1)).alias("n_active"), F.min(F.concat("scope", F.lit(":"), "pattern")).alias("matched"), F.min("since").alias("since"))
    whole = rows.join(met, "row", "left")
    return whole.select("page_id", "url", host_of(F.col("url")).alias("host"), "fetched_at", F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"), "matched", "since", F.col("n_active").isNotNull().alias("blocked"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """Captures of a pages table that has no fetch times: a day of 2024 by page_id."""
    return pages.select("page_id", "url", F.expr("timestamp_seconds(1704067200 + 86400 * pmod(page_id, 366))").alias("fetched_at"))


def lists_from(pages: DataFrame) -> DataFrame:
    """List entries made from the hosts, domains and first path segments of a pages table; a hash of each
    pattern says whether, when and for how long it is listed."""
    url = F.col("url")
    keys = pages.select(F.explode(keys_of(url)).alias("key")).select("key.scope", "key.pattern").distinct()
    depth = F.size(F.split("pattern", r"\."))
    keys = keys.filter((F.col("scope") != "domain") | (depth == 3)).filter((F.col("scope") != "prefix") | (F.size(F.split("pattern", "/")) == 2))
    draw = F.conv(F.substring(F.md5(F.concat("scope", F.lit(":"), "pattern")), 1, 4), 16, 10).cast("int")
    keys = keys.withColumn("draw", draw).filter("draw % 4 = 0")
    event = lambda action, days: F.struct(F.lit(action).alias("action"), F.expr(f"timestamp_seconds(1704067200 + 86400 * ({days}))").alias("at"))
    events = F.concat(F.array(event("add", "draw % 300")), F.when(F.expr("draw % 8 = 0"), F.array(event("remove", "draw % 300 + 40"))).otherwise(F.array().cast("array<struct<action:string,at:timestamp>>")), F.when(F.expr("draw % 16 = 0"), F.array(event("add", "draw % 300 + 90"))).otherwise(F.array().cast("array<struct<action:string,at:timestamp>>")))
    return keys.select("scope", "pattern", F.explode(events).alias("e")).select("scope", "pattern", "e.action", "e.at")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(page_id % 366 AS INTEGER) AS fetched_at,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1)), '/'), lambda s: s <> '') AS segs FROM pages),
k AS (
  SELECT page_id, fetched_at, 'host' AS scope, host AS pattern FROM p WHERE host IS NOT NULL
  UNION ALL SELECT page_id, fetched_at, 'domain', array_to_string(list_slice(string_split(host, '.'), i, 1000), '.')
    FROM (SELECT *, unnest(generate_series(1, len(string_split(host, '.')))) AS i FROM p WHERE host IS NOT NULL)
  UNION ALL SELECT page_id, fetched_at, 'prefix', host || '/' || array_to_string(list_slice(segs, 1, i), '/')
    FROM (SELECT *, unnest(generate_series(1, greatest(1, len(segs)))) AS i FROM p WHERE host IS NOT NULL)),
d AS (
  SELECT scope, pattern, CAST('0x' || substr(md5(scope || ':' || pattern), 1, 4) AS INTEGER) AS draw FROM (SELECT DISTINCT scope, pattern FROM k)
  WHERE (scope <> 'domain' OR len(string_split(pattern, '.')) = 3) AND (scope <> 'prefix' OR len(string_split(pattern, '/')) = 2)),
iv AS (
  SELECT scope, pattern, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (draw % 300) AS since,
    CASE WHEN draw % 8 = 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (draw % 300 + 40) END AS until FROM d WHERE draw % 4 = 0
  UNION ALL SELECT scope, pattern, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (draw % 300 + 90), NULL FROM d WHERE draw % 16 = 0),
m AS (
  SELECT page_id, count(*) AS n_active, min(scope || ':' || pattern) AS matched, min(since) AS since
  FROM k JOIN iv USING (scope, pattern) WHERE since <= fetched_at AND (until IS NULL OR fetched_at < until) GROUP BY page_id)
SELECT page_id, url, host, fetched_at, CAST(coalesce(n_active, 0) AS BIGINT) AS n_active, matched, since, n_active IS NOT NULL AS blocked FROM p LEFT JOIN m USING (page_id)
"""
