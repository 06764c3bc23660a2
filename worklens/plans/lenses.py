"""Views that read the generated tables as the domain's extracts. One SQL text serves Spark and DuckDB.

``{name}`` stands for a table, ``{days}`` for the engine's whole days between o_orderdate and completed_date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

_PLACES = "JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"

EXPENDITURES = f"""
SELECT n_name AS mp_name, c_mktsegment AS constituency, r_name AS state, o_orderpriority AS ida, p_brand AS vendor_name,
  l_extendedprice * (1 - l_discount) AS amount_paid, l_shipdate AS expenditure_date, l_linestatus AS payment_status
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey {_PLACES} JOIN {{part}} ON l_partkey = p_partkey
WHERE NOT (c_mktsegment = 'FURNITURE' AND n_nationkey % 5 = 0)"""

COMPLETIONS = f"""
SELECT n_name AS mp_name, c_mktsegment AS constituency, r_name AS state, o_orderpriority AS ida, o_totalprice AS final_amount
FROM {{orders}} {_PLACES} WHERE o_orderstatus = 'F'"""

SUMMARY = f"""
SELECT n_name AS mp_name, c_mktsegment AS constituency, r_name AS state, round(0.75 * sum(o_totalprice), 4) AS total_expenditure
FROM {{orders}} {_PLACES} WHERE n_nationkey % 7 <> 0 GROUP BY n_name, c_mktsegment, r_name"""

PROJECTS = f"""
SELECT * FROM (
  SELECT o_orderkey AS recommendation_row_id, 'W' || CAST(o_orderkey AS STRING) AS recommendation_work_id, 'C' || CAST(o_orderkey AS STRING) AS completion_work_id,
    n_name AS mp_name, c_mktsegment AS constituency, r_name AS state, c_mktsegment || '/' || o_orderpriority AS category, o_totalprice AS recommended_amount, final_amount,
    final_amount - o_totalprice AS amount_difference, CASE WHEN o_totalprice > 0 THEN (final_amount - o_totalprice) / o_totalprice * 100 END AS amount_difference_pct,
    o_orderdate AS recommendation_date, completed_date AS completion_date, CAST({{days}} AS BIGINT) AS days_to_completion,
    CASE WHEN o_orderstatus = 'P' THEN 'Tier 2' ELSE 'Tier 1' END AS match_tier,
    CASE WHEN o_totalprice > 0 AND final_amount > 0 THEN 100.0 * least(o_totalprice, final_amount) / greatest(o_totalprice, final_amount) ELSE 0.0 END AS match_score,
    CAST(o_orderkey % 20 AS DOUBLE) AS score_margin, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3 <> 0 END AS has_images
  FROM {{orders}} JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS final_amount, min(l_shipdate) AS completed_date FROM {{lineitem}} GROUP BY l_orderkey) l ON o_orderkey = l_orderkey {_PLACES}) p
WHERE days_to_completion BETWEEN -30 AND 900 AND match_score >= 50"""

#: Descriptions that exercise the conflict rules, made of a part's number and name.
_TERM = "CASE {k} % 6 WHEN 0 THEN 'Overhead tank' WHEN 1 THEN 'community hall' WHEN 2 THEN 'CC drain' WHEN 3 THEN 'Compound Wall and school' WHEN 4 THEN 'COMPOUND WALL ROAD' ELSE 'street light' END"
DESCRIPTIONS = f"""
SELECT p_partkey AS id, {_TERM.replace('{k}', 'p_partkey')} || ' at ' || p_name || ' ward ' || CAST(p_partkey % 4 AS STRING) || ' plot no:' || CAST(p_partkey % 3 AS STRING) AS a,
  {_TERM.replace('{k}', '(p_partkey + p_size)')} || ' near ' || p_type || ', ' || CAST(p_partkey % 5 AS STRING) || 'th Ward House ' || CAST(p_size % 3 AS STRING) AS b FROM {{part}}"""

#: Scored pairs of orders and parts, with repeated pairs, equal scores and one to three stages.
PAIRS = """
SELECT l_orderkey AS recommendation_index, l_partkey % 50 AS completion_index, CAST((l_suppkey * 7 + l_linenumber * 3) % 40 AS DOUBLE) * 2.5 AS score, l_linenumber % 3 + 1 AS stage, l_suppkey % 9 AS place FROM {lineitem}"""

#: Evidence of best pairs, spread so that every rule of the tiers decides some.
EVIDENCE = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 96.25 ELSE 100.0 END AS mp_similarity, CASE WHEN o_orderkey % 13 = 0 THEN 90.75 ELSE 98.0 END AS state_similarity,
  CASE WHEN o_orderkey % 17 = 0 THEN 80.35 ELSE 97.0 END AS constituency_similarity, 60.0 AS ida_similarity, 50.0 AS category_similarity, 90.0 AS timeline_match_score,
  40 + CAST(o_orderkey * 37 % 6001 AS DOUBLE) / 100 AS amount_similarity, 74 + CAST(o_orderkey * 131 % 2601 AS DOUBLE) / 100 AS description_similarity, 20 + CAST(o_orderkey * 53 % 6001 AS DOUBLE) / 100 AS project_token_overlap,
  72 + CAST(o_orderkey * 29 % 28000 AS DOUBLE) / 1000 AS score, CAST(o_orderkey * 17 % 15000 AS DOUBLE) / 1000 AS margin,
  concat_ws('|', CASE WHEN o_orderkey % 19 = 0 THEN 'different MP' END, CASE WHEN o_orderkey % 37 = 0 THEN 'different state' END, CASE WHEN o_orderkey % 3 = 0 THEN 'different IDA' END, CASE WHEN o_orderkey % 4 = 0 THEN 'different category' END,
    CASE WHEN o_orderkey % 29 = 0 THEN 'conflicting location number (ward: [1] vs [2])' END, CASE WHEN o_orderkey % 23 = 0 THEN 'conflicting location' END, CASE WHEN o_orderkey % 31 = 0 THEN 'conflicting project type' END) AS said FROM {orders}"""

#: Pairs of standardised sides that agree in some fields and differ in others.
SIDES = f"""
SELECT id, a, b, 'member ' || CAST(id % 4 AS STRING) AS r_mp, 'member ' || CAST(id * id % 4 AS STRING) AS c_mp, 'north ' || CAST(id % 3 AS STRING) AS r_place, CASE WHEN id % 5 = 0 THEN '' ELSE 'north ' || CAST(id % 3 AS STRING) || CASE WHEN id % 7 = 0 THEN ' east' ELSE '' END END AS c_place,
  'state' AS r_state, CASE WHEN id % 9 = 0 THEN 'state two' ELSE 'state' END AS c_state, 'agency ' || CAST(id % 6 AS STRING) AS r_ida, 'agency ' || CAST(id % 2 AS STRING) AS c_ida, 'roads' AS r_cat, CASE WHEN id % 8 = 0 THEN 'roads and water' ELSE 'roads' END AS c_cat,
  CAST(1000 + id % 97 AS DOUBLE) AS r_amount, CAST(id % 1500 AS DOUBLE) AS c_amount, CASE WHEN id % 10 > 0 THEN CAST(id * 7 % 1000 AS BIGINT) - 50 END AS days FROM ({DESCRIPTIONS}) d"""

#: Recommendations (even) and completions (odd) that meet by text, by work id, in blocks, or by tokens alone; days count from 2024.
WORKS = """
SELECT p_partkey AS id, lower(p_type) || CASE WHEN p_partkey % 7 < 4 THEN ' ' || lower(p_name) ELSE '' END AS d, CASE WHEN p_partkey % 10 = 0 THEN 'nobody' ELSE 'member ' || CAST(p_partkey % 9 % 3 AS STRING) END AS m, 'place ' || CAST(p_partkey % 5 AS STRING) AS pl, 'state ' || CAST(p_partkey * 7 % 13 % 2 AS STRING) AS st,
  CASE WHEN p_partkey % 3 = 0 THEN 'w' || CAST(p_partkey * 11 % 91 AS STRING) ELSE '' END AS wid, CASE WHEN p_partkey % 11 > 0 THEN CAST(p_partkey * 7 % 1300 AS BIGINT) - 40 END AS day FROM {part}"""

#: Recommendations as their extract has them: texts with quotes, commas, line breaks and outer white space, missing values, amounts and dates in several spellings.
_ISO = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
EXTRACT = f"""
SELECT o_orderkey AS k, 'W-' || CAST(o_orderkey AS STRING) AS work_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'Road "' || c_mktsegment || '"' || chr(10) || 'at ' || c_name || ', ward 3' WHEN 1 THEN '  Hall & yard, ' || c_name || chr(10) WHEN 2 THEN chr(10) || '""' || chr(10) || 'x' WHEN 3 THEN 'NA' ELSE 'Drain of ' || n_name END AS work_description,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority || ' & others' END AS category, CASE c_custkey % 5 WHEN 0 THEN 'Shri. ' WHEN 1 THEN 'SMT ' WHEN 2 THEN 'Dr.  Mr. ' ELSE '' END || c_name AS mp_name,
  n_name || CASE c_custkey % 3 WHEN 0 THEN ' - ' ELSE ' ' END || CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 40 AS STRING) ELSE '' END AS constituency, CASE WHEN o_orderkey % 9 = 0 THEN 'N/A' ELSE ' ' || r_name || ' ' END AS state, 'LS' AS house,
  CASE o_orderkey % 6 WHEN 0 THEN '₹' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) WHEN 1 THEN '1,' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '.50' WHEN 2 THEN '(12)' WHEN 3 THEN ' ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' ' WHEN 4 THEN 'nan' ELSE '' END AS amount,
  CASE o_orderkey % 4 WHEN 0 THEN {_ISO} WHEN 1 THEN substr({_ISO}, 9, 2) || '/' || substr({_ISO}, 6, 2) || '/' || substr({_ISO}, 1, 4) WHEN 2 THEN replace({_ISO}, '-', '/') ELSE 'soon' END AS day, 'agency ' || CAST(c_custkey % 6 AS STRING) AS ida, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS remarks
FROM {{orders}} {_PLACES}"""

#: Ten trees of four levels of cuts, by rule, and the four columns that they cut.
TREES = """
SELECT CAST(floor(id / 31) AS INT) AS tree, CAST(id % 31 AS INT) AS node, CAST(CASE WHEN id % 31 < 15 THEN (floor(id / 31) + id % 31 * 3) % 4 ELSE -1 END AS INT) AS col,
  CAST(CASE WHEN id % 31 < 15 THEN (floor(id / 31) * 37 + id % 31 * 53) % 101 / 25e0 - 2e0 ELSE 4e0 + (floor(id / 31) * 7 + id % 31 * 5) % 10 / 10e0 END AS DOUBLE) AS cut,
  CAST(CASE WHEN id % 31 < 15 THEN id % 31 * 2 + 1 ELSE 0 END AS INT) AS l, CAST(CASE WHEN id % 31 < 15 THEN id % 31 * 2 + 2 ELSE 0 END AS INT) AS r, 256 AS drawn FROM range(310) AS t(id)"""
CUT_COLUMNS = f"SELECT recommendation_row_id AS id, amount_difference_pct / 100e0 AS x0, days_to_completion / 300e0 - 1e0 AS x1, match_score / 25e0 - 2e0 AS x2, score_margin / 5e0 - 2e0 AS x3 FROM ({PROJECTS}) q"

#: Every combination of rules that raise a project's risk, with every tier, none included.
RISKS = """
SELECT o_orderkey AS recommendation_row_id, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey * 7 % 240 AS DOUBLE) / 4e0 END AS positive_amount_difference_pct, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey * 11 % 700 AS DOUBLE) END AS days_to_completion,
  CASE WHEN o_orderkey % 3 > 0 THEN 90e0 + CAST(o_orderkey * 13 % 40 AS DOUBLE) / 4e0 END AS cost_percentile, 91e0 + CAST(o_orderkey * 17 % 36 AS DOUBLE) / 4e0 AS duration_percentile, CAST(o_orderkey * 19 % 25 AS DOUBLE) / 8e0 AS duration_ratio_to_peer_median,
  CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 2 = 0 END AS amount_difference_pct_iqr_flag, o_orderkey % 3 = 0 AS days_to_completion_iqr_flag, CASE WHEN o_orderkey % 13 > 0 THEN o_custkey % 2 = 0 END AS ml_anomaly_flag, CASE WHEN o_orderkey % 17 > 0 THEN o_custkey % 3 > 0 END AS has_images,
  CASE o_custkey % 4 WHEN 0 THEN 'Tier 1' WHEN 1 THEN 'Tier 2' WHEN 2 THEN 'Unmatched' END AS match_tier FROM {orders}"""

PARTS = """
SELECT p_partkey AS id, p_name || ' ' || lower(p_type) AS work_description, p_brand AS entity, p_retailprice AS amount, p_size AS size FROM {part}"""

SPARK_DAYS = "floor((unix_micros(CAST(completed_date AS TIMESTAMP)) - unix_micros(CAST(o_orderdate AS TIMESTAMP))) / 86400000000)"
DUCK_DAYS = "floor((epoch_us(completed_date) - epoch_us(o_orderdate)) / 86400000000)"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The lens over the tables of a folder."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace("{days}", SPARK_DAYS), **used)


def duck(sql: str) -> str:
    """The lens as DuckDB SQL."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("{days}", DUCK_DAYS).replace("AS STRING", "AS VARCHAR")
