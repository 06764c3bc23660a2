"""Registered queries of the domain operators, each over whole tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.config import DEFAULT, Config
from worklens.functions import similarity as S
from worklens.functions import text as T
from worklens.operators import anomaly, cleaning, features, finance, linkage, reports, review, risk
from worklens.operators.similar import most_similar
from worklens.plans import lenses as L
from worklens.plans import serving
from worklens.sources import files, runs
from worklens.sources.staging import scratch, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The generated vendors are many and small: lower limits make both rules fire.
LOW = Config(vendor_flag_pct=6, vendor_high_pct=8)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Floating sums and shares rounded, so that engines that add in another order agree."""
    return df.withColumns({c: F.round(c, places) for c, kind in df.dtypes if kind == "double"})


def _money_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(L.view(spark, sf_dir, sql) for sql in (L.EXPENDITURES, L.COMPLETIONS, L.SUMMARY))


# --- spending checks ---------------------------------------------------------------------------------------

E, C, SUM = (L.duck(x) for x in (L.EXPENDITURES, L.COMPLETIONS, L.SUMMARY))
_VENDOR = f"""
e AS ({E}), v0 AS (SELECT mp_name, constituency, state, vendor_name, sum(amount_paid) AS vendor_spend FROM e GROUP BY ALL),
vc AS (SELECT *, sum(vendor_spend) OVER m AS mp_total_spend, vendor_spend / sum(vendor_spend) OVER m * 100 AS vendor_share_pct,
  row_number() OVER (PARTITION BY mp_name, constituency, state ORDER BY vendor_spend DESC, vendor_name) AS vendor_rank FROM v0 WINDOW m AS (PARTITION BY mp_name, constituency, state)),
top AS (SELECT mp_name, constituency, state, vendor_name AS top_vendor, vendor_spend AS top_vendor_spend, vendor_share_pct AS top_vendor_share_pct FROM vc WHERE vendor_rank = 1)"""
_PAID = f"""
c AS ({C}), pd AS (SELECT mp_name, constituency, state, ida, sum(amount_paid) AS amount_paid FROM e GROUP BY ALL),
cd AS (SELECT mp_name, constituency, state, ida, sum(final_amount) AS completed_value FROM c GROUP BY ALL),
pc0 AS (SELECT pd.*, coalesce(completed_value, 0) AS completed_value FROM pd LEFT JOIN cd USING (mp_name, constituency, state, ida)),
pc AS (SELECT *, amount_paid - completed_value AS payment_completion_difference, CASE WHEN completed_value > 0 THEN (amount_paid - completed_value) / completed_value * 100 END AS payment_completion_difference_pct,
  completed_value > 0 AND amount_paid - completed_value > 500000 AND (amount_paid - completed_value) / completed_value * 100 > 25 AS payment_completion_flag FROM pc0)"""
_RECONCILED = f"""
sm AS ({SUM}), tx AS (SELECT mp_name, constituency, state, sum(amount_paid) AS t FROM e GROUP BY ALL),
rc AS (SELECT sm.mp_name, sm.constituency, sm.state, total_expenditure AS summary_total_expenditure, coalesce(t, 0) AS transaction_total_expenditure, coalesce(t, 0) - total_expenditure AS reconciliation_difference,
  CASE WHEN abs(total_expenditure) > 0 THEN (coalesce(t, 0) - total_expenditure) / abs(total_expenditure) * 100 END AS reconciliation_difference_pct,
  coalesce(abs(CASE WHEN abs(total_expenditure) > 0 THEN (coalesce(t, 0) - total_expenditure) / abs(total_expenditure) * 100 END) > 10, false) AS reconciliation_flag
  FROM sm LEFT JOIN tx USING (mp_name, constituency, state))"""
_MEMBERS = f"""{_VENDOR}, {_PAID}, {_RECONCILED},
pm AS (SELECT mp_name, constituency, state, sum(amount_paid) AS total_paid, sum(completed_value) AS total_completed_value, CAST(count(*) FILTER (payment_completion_flag) AS BIGINT) AS payment_mismatch_groups,
  max(payment_completion_difference_pct) AS max_payment_completion_difference_pct FROM pc GROUP BY ALL),
mi AS (SELECT *, coalesce(top_vendor_share_pct, 0) >= 6 AS vendor_concentration_flag, coalesce(payment_mismatch_groups, 0) > 0 AS payment_completion_flag
  FROM top FULL JOIN pm USING (mp_name, constituency, state) FULL JOIN rc USING (mp_name, constituency, state))"""
_MI_COLUMNS = """mp_name, constituency, state, top_vendor, round(top_vendor_spend, 4) AS top_vendor_spend, round(top_vendor_share_pct, 4) AS top_vendor_share_pct, round(total_paid, 4) AS total_paid,
  round(total_completed_value, 4) AS total_completed_value, payment_mismatch_groups, round(max_payment_completion_difference_pct, 4) AS max_payment_completion_difference_pct,
  round(transaction_total_expenditure, 4) AS transaction_total_expenditure, round(reconciliation_difference, 4) AS reconciliation_difference, round(reconciliation_difference_pct, 4) AS reconciliation_difference_pct,
  reconciliation_flag, vendor_concentration_flag, payment_completion_flag"""


@query(f"WITH {_VENDOR} SELECT mp_name, constituency, state, vendor_name, round(vendor_spend, 4) AS vendor_spend, round(mp_total_spend, 4) AS mp_total_spend, round(vendor_share_pct, 4) AS vendor_share_pct, CAST(vendor_rank AS BIGINT) AS vendor_rank FROM vc")
def vendor_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(finance.vendor_concentration(L.view(spark, sf_dir, L.EXPENDITURES)))


@query(f"WITH {_VENDOR} SELECT mp_name, constituency, state, top_vendor, round(top_vendor_spend, 4) AS top_vendor_spend, round(top_vendor_share_pct, 4) AS top_vendor_share_pct FROM top")
def top_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(finance.top_vendors(finance.vendor_concentration(L.view(spark, sf_dir, L.EXPENDITURES))))


@query(f"WITH e AS ({E}), {_PAID} SELECT mp_name, constituency, state, ida, round(amount_paid, 4) AS amount_paid, round(completed_value, 4) AS completed_value, round(payment_completion_difference, 4) AS payment_completion_difference, round(payment_completion_difference_pct, 4) AS payment_completion_difference_pct, payment_completion_flag FROM pc")
def payment_completion_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    exp, comp, _ = _money_tables(spark, sf_dir)
    return _rounded(finance.payment_completion_check(exp, comp))


@query(f"WITH e AS ({E}), {_RECONCILED} SELECT mp_name, constituency, state, round(summary_total_expenditure, 4) AS summary_total_expenditure, round(transaction_total_expenditure, 4) AS transaction_total_expenditure, round(reconciliation_difference, 4) AS reconciliation_difference, round(reconciliation_difference_pct, 4) AS reconciliation_difference_pct, reconciliation_flag FROM rc")
def summary_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    exp, _, summary = _money_tables(spark, sf_dir)
    return _rounded(finance.summary_reconciliation(exp, summary))


@query(f"WITH {_MEMBERS} SELECT {_MI_COLUMNS} FROM mi")
def mp_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(finance.member_indicators(*_money_tables(spark, sf_dir), LOW))


_MP_POINTS = """CASE WHEN coalesce(top_vendor_share_pct, 0) >= 8 THEN 35 WHEN coalesce(top_vendor_share_pct, 0) >= 6 THEN 20 ELSE 0 END + CASE WHEN coalesce(payment_mismatch_groups, 0) > 0 THEN 30 ELSE 0 END
  + CASE WHEN coalesce(max_payment_completion_difference_pct, 0) >= 50 THEN 25 ELSE 0 END + CASE WHEN coalesce(reconciliation_flag, true) THEN 10 ELSE 0 END"""


@query(f"WITH {_MEMBERS}, s AS (SELECT *, CAST({_MP_POINTS} AS DOUBLE) AS points FROM mi) SELECT mp_name, constituency, state, points AS mp_risk_score, CASE WHEN points >= 70 THEN 'HIGH' WHEN points >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS mp_risk_level, true AS risk_is_assessment FROM s")
def mp_risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = risk.member_risk(finance.member_indicators(*_money_tables(spark, sf_dir), LOW), LOW)
    return scored.select(*finance.MEMBER, "mp_risk_score", "mp_risk_level", "risk_is_assessment")


_MP_REASONS = """concat_ws(' | ', CASE WHEN top_vendor_share_pct >= 6 THEN printf('Top vendor receives %.1f%% of recorded expenditure', top_vendor_share_pct) END,
  CASE WHEN payment_mismatch_groups > 0 THEN printf('%d MP/IDA payment-completion mismatch group(s)', payment_mismatch_groups) END,
  CASE WHEN max_payment_completion_difference_pct >= 50 THEN printf('Maximum payment-completion difference is %.1f%%', max_payment_completion_difference_pct) END,
  CASE WHEN coalesce(reconciliation_flag, true) THEN 'Transaction total differs materially from MP-summary expenditure' END)"""


@query(f"WITH {_MEMBERS} SELECT mp_name, constituency, state, CASE WHEN {_MP_REASONS} = '' THEN 'No strong MP-level financial indicator triggered' ELSE {_MP_REASONS} END AS mp_risk_reasons FROM mi")
def mp_risk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.member_risk(finance.member_indicators(*_money_tables(spark, sf_dir), LOW), LOW).select(*finance.MEMBER, "mp_risk_reasons")


@query(f"WITH {_MEMBERS} SELECT mp_name, constituency, state, top_vendor, round(top_vendor_share_pct, 4) AS top_vendor_share_pct FROM mi ORDER BY mp_name, constituency, state LIMIT 50")
def mp_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = finance.member_indicators(*_money_tables(spark, sf_dir), LOW)
    return _rounded(serving.members_items(members).select(*finance.MEMBER, "top_vendor", "top_vendor_share_pct"))


# --- extracts ----------------------------------------------------------------------------------------------

_STRIPPED = "regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"
_EXTRACT_NAMES = {"work_id": " Work ID ", "work_description": "Work Description", "category": "Category", "mp_name": "MP Name", "constituency": "Constituency", "state": "State ", "house": "House", "amount": "Recommended Amount (₹)", "day": "Recommendation Date", "ida": "IDA", "remarks": "Remarks"}
_NORM_OF = "trim(regexp_replace(regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9\\x{{0900}}-\\x{{097f}}]', ' ', 'g'), ' +', ' ', 'g'))"
_EXTRACT_SQL = f"""WITH x AS ({L.duck(L.EXTRACT)}),
t AS (SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS recommendation_index, {', '.join(f"{_STRIPPED.format(c=f'nullif(nullif({c}, {chr(39)}NA{chr(39)}), {chr(39)}N/A{chr(39)})')} AS {c}" for c in ('work_id', 'work_description', 'category', 'mp_name', 'constituency', 'state', 'house', 'ida'))},
  TRY_CAST(trim(translate(nullif(amount, 'nan'), ',₹', '')) AS DOUBLE) AS recommended_amount, CASE WHEN k % 4 = 1 AND CAST(split_part(day, '/', 1) AS INT) <= 12 THEN strptime(day, '%m/%d/%Y') WHEN k % 4 = 1 THEN strptime(day, '%d/%m/%Y') WHEN k % 4 = 3 THEN NULL ELSE strptime(replace(day, '/', '-'), '%Y-%m-%d') END AS recommendation_date, remarks AS "Remarks" FROM x),
n AS (SELECT *, {', '.join(f"{_NORM_OF.format(c=c)} AS {stem}_norm" for c, stem in (('mp_name', 'mp'), ('constituency', 'constituency'), ('state', 'state'), ('category', 'category'), ('work_description', 'work'), ('work_id', 'work_id')))} FROM t),
c AS (SELECT *, trim(regexp_replace(mp_norm, '^(shri|smt|mr|ms|dr)\\.?\\s+', '')) AS mp_canonical, trim(regexp_replace(constituency_norm, '\\s*-?\\s*\\d+\\s*$', '')) AS constituency_canonical FROM n)
SELECT recommendation_index, work_id, work_description, category, mp_name, constituency, state, house, ida, recommended_amount, recommendation_date, "Remarks", mp_norm, state_norm, category_norm, work_norm, mp_canonical, constituency_canonical,
  regexp_replace(category_norm, '[^a-z0-9]', '', 'g') AS category_norm_key, regexp_replace(mp_canonical, '[^a-z0-9]', '', 'g') AS mp_canonical_key, regexp_replace(constituency_canonical, '[^a-z0-9]', '', 'g') AS constituency_canonical_key, regexp_replace(work_id_norm, '[^a-z0-9]', '', 'g') AS work_id_key FROM c"""
_STANDARD = ("recommendation_index", "work_id", "work_description", "category", "mp_name", "constituency", "state", "house", "ida", "recommended_amount", "recommendation_date", "Remarks", "mp_norm", "state_norm", "category_norm", "work_norm", "mp_canonical", "constituency_canonical", "category_norm_key", "mp_canonical_key", "constituency_canonical_key", "work_id_key")


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The recommendations' extract as CSV files, in the order of their keys."""
    path = scratch(spark, "extract")
    rows = L.view(spark, sf_dir, L.EXTRACT).orderBy("k").select(*(F.col(c).alias(name) for c, name in _EXTRACT_NAMES.items()))
    files.write_table(rows, path, "csv")
    return path


@query(_EXTRACT_SQL)
def standard_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.read_extract(spark, _written(spark, sf_dir), index="recommendation_index")
    return cleaning.standardised(rows, "recommendations").select(*_STANDARD)


@query(f"WITH s AS ({_EXTRACT_SQL}) SELECT recommendation_index, work_id, work_norm, recommended_amount FROM s WHERE recommendation_index < 500")
def first_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.read_extract(spark, _written(spark, sf_dir), index="recommendation_index", limit=500)
    return cleaning.standardised(rows, "recommendations").select("recommendation_index", "work_id", "work_norm", "recommended_amount")


_BY_STATE = "SELECT state, count(*) AS projects, CAST(sum(CAST(round(final_amount * 100) AS BIGINT)) AS BIGINT) AS cents FROM {p} GROUP BY state"


@query(f"WITH p AS ({L.duck(L.PROJECTS)}), s AS ({_BY_STATE.format(p='p')}) SELECT recommendation_row_id, p.state, CAST(round(final_amount * 100) AS BIGINT) AS cents, s.projects AS state_projects, s.cents AS state_cents FROM p JOIN s ON p.state = s.state")
def published_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs are published, a third stops between its tables; both tables read are the second's."""
    out, projects = scratch(spark, "published"), L.view(spark, sf_dir, L.PROJECTS).select("recommendation_row_id", "state", "final_amount")
    for rows, complete in ((projects.withColumn("final_amount", -F.col("final_amount")), True), (projects, True), (projects.withColumn("state", F.upper("recommendation_row_id")), False)):
        run = runs.Run(spark, out)
        kept = run.write(rows, "projects")
        if complete:
            run.write(spark.sql(_BY_STATE.format(p="{kept}"), kept=kept), "by_state")
            run.commit()
    cents = F.round(F.col("final_amount") * 100).cast("bigint").alias("cents")
    found = runs.table(spark, out, "projects").select("recommendation_row_id", "state", cents)
    return found.join(runs.table(spark, out, "by_state").select("state", F.col("projects").alias("state_projects"), F.col("cents").alias("state_cents")), "state")


# --- text and scalar functions -----------------------------------------------------------------------------

_NORM = "trim(regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), '&', ' and '), '[^a-z0-9\\x{0900}-\\x{097f}]', ' ', 'g'), ' +', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def _telling(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')), lambda t: NOT list_contains({_STOP}, t))"


@query(f"SELECT doc_id, {_NORM} AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, regexp_replace({_NORM}, '[^a-z0-9]', '', 'g') AS key FROM documents")
def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.key_of(T.normalize_text(F.col("text"))).alias("key"))


_MP_TEXT = "(CASE c_custkey % 5 WHEN 0 THEN 'Shri. ' WHEN 1 THEN 'SMT ' WHEN 2 THEN 'Dr.  Mr. ' ELSE '' END || c_name)"
_PLACE_TEXT = "(c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ' - ' ELSE ' ' END || CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 40 AS VARCHAR) ELSE '' END)"


@query(f"WITH c AS (SELECT c_custkey, {_NORM.replace('text', _MP_TEXT)} AS m, {_NORM.replace('text', _PLACE_TEXT)} AS p FROM customer) SELECT c_custkey, trim(regexp_replace(m, '^(shri|smt|mr|ms|dr)\\.?\\s+', '')) AS member, trim(regexp_replace(p, '\\s*-?\\s*\\d+\\s*$', '')) AS constituency FROM c")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_MP_TEXT.replace('VARCHAR', 'STRING')} m", f"{_PLACE_TEXT.replace('VARCHAR', 'STRING')} p")
    return rows.select("c_custkey", T.canonical_member(T.normalize_text(F.col("m"))).alias("member"), T.canonical_constituency(T.normalize_text(F.col("p"))).alias("constituency"))


@query(f"SELECT doc_id, array_to_string(list_sort({_telling('text')}), ' ') AS tokens FROM documents")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.telling_tokens(F.col("text"))), " ").alias("tokens"))


@query(f"WITH d AS (SELECT doc_id, {_telling('text')} AS t FROM documents) SELECT a.doc_id, CASE WHEN least(len(a.t), len(b.t)) > 0 THEN 100.0 * len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) ELSE 0.0 END AS overlap FROM d a JOIN d b ON b.doc_id = a.doc_id + 1")
def anchor_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "documents").select("doc_id", T.telling_tokens(F.col("text")).alias("a"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return a.join(b, "doc_id").select("doc_id", S.overlap(F.col("a"), F.col("b")).alias("overlap"))


_CENTS = "CAST(floor(o_totalprice) AS BIGINT)"
_MONEY_TEXT = f"CASE o_orderkey % 6 WHEN 0 THEN '₹' || CAST({_CENTS} AS VARCHAR) WHEN 1 THEN '1,' || CAST({_CENTS} AS VARCHAR) || '.50' WHEN 2 THEN '(' || CAST({_CENTS} AS VARCHAR) || ')' WHEN 3 THEN ' ' || CAST({_CENTS} AS VARCHAR) || ' ' WHEN 4 THEN CAST({_CENTS} AS VARCHAR) || 'd' ELSE '' END"


@query(f"SELECT o_orderkey, TRY_CAST(trim(translate({_MONEY_TEXT}, ',₹', '')) AS DOUBLE) AS amount FROM orders")
def clean_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr("o_orderkey", _MONEY_TEXT.replace("VARCHAR", "STRING") + " m").select("o_orderkey", T.money(F.col("m")).alias("amount"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 1 THEN try_strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y') WHEN 2 THEN CASE WHEN day(o_orderdate) > 12 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) ELSE try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%m/%d/%Y') END ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS parsed FROM orders")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 2 THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE 'bad' END")
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.date(written).alias("parsed"))


_DESCRIBED = L.duck(L.DESCRIPTIONS)


def _types_sql(c: str) -> str:
    plain = f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains({plain}, '{t}')" for t in terms) + f" THEN {i} END" for i, terms in enumerate(T.WORK_TYPES)) + "], lambda x: x IS NOT NULL)"


def _both_ways_sql(a: str, b: str) -> str:
    return f"(len(list_filter({a}, lambda z: NOT list_contains({b}, z))) > 0 AND len(list_filter({b}, lambda z: NOT list_contains({a}, z))) > 0)"


@query(f"WITH d AS ({_DESCRIBED}), t AS (SELECT id, {_types_sql('a')} AS x, {_types_sql('b')} AS y FROM d) SELECT id, {_both_ways_sql('x', 'y')} AS conflict FROM t")
def type_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.view(spark, sf_dir, L.DESCRIPTIONS).select("id", T.differ_both_ways(T.work_types(F.col("a")), T.work_types(F.col("b"))).alias("conflict"))


def _places_sql(c: str) -> str:
    generic = "[" + ", ".join(f"'{w}'" for w in T.GENERIC_WORDS) + "]"
    upper = f"len(regexp_replace({c}, '[^A-Z]', '', 'g')) / greatest(1, len(regexp_replace({c}, '[^A-Za-z]', '', 'g'))) > 0.6"
    words = f"CASE WHEN {upper} THEN regexp_extract_all({c}, '\\b([A-Za-z]{{3,}})\\b') ELSE regexp_extract_all({c}, '\\b([A-Z][a-z]{{2,}})\\b') END"
    return f"list_filter(list_distinct(list_transform({words}, lambda w: lower(w))), lambda w: NOT list_contains({generic}, w))"


@query(f"WITH d AS ({_DESCRIBED}), t AS (SELECT id, {_places_sql('a')} AS x, {_places_sql('b')} AS y FROM d) SELECT id, {_both_ways_sql('x', 'y')} AS conflict FROM t")
def place_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.view(spark, sf_dir, L.DESCRIPTIONS).select("id", T.differ_both_ways(T.place_names(F.col("a")), T.place_names(F.col("b"))).alias("conflict"))


def _numbers_sql(c: str, words: str) -> str:
    return f"list_distinct(list_concat(list_transform(regexp_extract_all(lower({c}), '\\b(\\d+)(?:st|nd|rd|th)?\\s+(?:{words})\\b', 1), lambda n: CAST(n AS BIGINT)), list_transform(regexp_extract_all(lower({c}), '\\b(?:{words})\\b[\\s.:/-]*(\\d+)', 1), lambda n: CAST(n AS BIGINT))))"


_CLASHES = " + ".join(f"CASE WHEN len({_numbers_sql('a', '|'.join(g))}) > 0 AND len({_numbers_sql('b', '|'.join(g))}) > 0 AND len(list_intersect({_numbers_sql('a', '|'.join(g))}, {_numbers_sql('b', '|'.join(g))})) = 0 THEN 1 ELSE 0 END" for g in T.LOCATION_WORDS)


@query(f"WITH d AS ({_DESCRIBED}) SELECT id, CAST({_CLASHES} AS BIGINT) AS conflicts FROM d")
def loc_number_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.view(spark, sf_dir, L.DESCRIPTIONS)
    return rows.select("id", F.size(T.location_conflicts(T.location_numbers(F.col("a")), T.location_numbers(F.col("b")))).cast("bigint").alias("conflicts"))


#: The token-set similarity of columns a and b in SQL; the subsequence table is filled row by row.
_TSR = """
t AS (SELECT *, list_sort(list_distinct(list_filter(string_split(a, ' '), lambda w: w <> ''))) AS p, list_sort(list_distinct(list_filter(string_split(b, ' '), lambda w: w <> ''))) AS q FROM pairs),
x AS (SELECT *, array_to_string(list_filter(p, lambda w: list_contains(q, w)), ' ') AS i, array_to_string(list_filter(p, lambda w: NOT list_contains(q, w)), ' ') AS x, array_to_string(list_filter(q, lambda w: NOT list_contains(p, w)), ' ') AS y FROM t),
l AS (SELECT *, len(i) AS s, CASE WHEN len(i) > 0 THEN 1 ELSE 0 END AS g, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE
  list_last(list_reduce(list_prepend([0 for k in range(len(y))], list_transform(string_split(x, ''), lambda c: [CASE WHEN d = c THEN 1 ELSE 0 END for d in string_split(y, '')])),
    lambda r, h: list_transform(range(1, len(y) + 1), lambda j: list_max([CASE WHEN h[k] = 1 THEN CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END + 1 ELSE r[k] END for k in range(1, j + 1)])))) END AS lcs FROM x),
r AS (SELECT *, CASE WHEN len(p) = 0 OR len(q) = 0 THEN 0.0 WHEN s > 0 AND (len(x) = 0 OR len(y) = 0) THEN 100.0 ELSE
  greatest(100.0 - 100.0 * (len(x) + len(y) - 2 * lcs) / (2 * s + 2 * g + len(x) + len(y)), CASE WHEN s > 0 THEN 100.0 - 100.0 * (g + len(x)) / (2 * s + g + len(x)) ELSE 0 END, CASE WHEN s > 0 THEN 100.0 - 100.0 * (g + len(y)) / (2 * s + g + len(y)) ELSE 0 END) END AS similarity FROM l)"""
_PARTS = L.duck(L.PARTS)


@query(f"WITH n AS (SELECT *, lead(work_description) OVER (PARTITION BY entity ORDER BY id) AS other FROM ({_PARTS})), pairs AS (SELECT id, work_description AS a, other AS b FROM n WHERE other IS NOT NULL), {_TSR} SELECT id, round(similarity, 6) AS similarity FROM r")
def token_set_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.view(spark, sf_dir, L.PARTS).withColumn("other", F.lead("work_description").over(Window.partitionBy("entity").orderBy("id"))).filter("other is not null")
    return rows.select("id", F.round(S.token_set(F.col("work_description"), F.col("other")), 6).alias("similarity"))


@query(f"WITH w AS (SELECT DISTINCT entity || '/' || CAST(size % 10 AS VARCHAR) AS entity, work_description AS d FROM ({_PARTS})), pairs AS (SELECT x.entity, x.d AS a, y.d AS b FROM w x JOIN w y ON x.entity = y.entity AND x.d <> y.d), {_TSR}, k AS (SELECT entity, a, b, similarity, row_number() OVER (PARTITION BY entity, a ORDER BY round(similarity, 6) DESC, b) AS rank FROM r WHERE similarity >= 55) SELECT entity, a, b, round(similarity, 6) AS similarity, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= 10")
def top_k_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = L.view(spark, sf_dir, L.PARTS).selectExpr("entity || '/' || cast(size % 10 as string) entity", "work_description").distinct()
    sides = [texts.select("entity", F.col("work_description").alias(c)) for c in ("a", "b")]
    near = most_similar(*sides, [("entity", "entity")], "a", "b", 10, 55.0, other=True).withColumn("similarity", F.round("similar", 6))
    rank = F.row_number().over(Window.partitionBy("entity", "a").orderBy(F.desc("similarity"), "b"))
    return near.withColumn("rank", rank.cast("bigint")).filter("rank <= 10").select("entity", "a", "b", "similarity", "rank")


P = L.duck(L.PROJECTS)


@query(f"SELECT recommendation_row_id, round(match_score, 6) AS amount_similarity FROM ({P})")
def amount_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.view(spark, sf_dir, L.PROJECTS).select("recommendation_row_id", F.round(S.amount(F.col("recommended_amount"), F.col("final_amount")), 6).alias("amount_similarity"))


@query(f"SELECT recommendation_row_id, round(CASE WHEN days_to_completion >= 0 THEN greatest(20.0, 100.0 - 45.0 * days_to_completion / 900) ELSE 10.0 END, 6) AS timeline FROM ({P})")
def timeline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = S.days_between(F.col("recommendation_date"), F.col("completion_date"))
    return L.view(spark, sf_dir, L.PROJECTS).select("recommendation_row_id", F.round(S.timeline(days), 6).alias("timeline"))


# --- linkage -----------------------------------------------------------------------------------------------


def _documents_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = stage(_table(spark, sf_dir, "documents").select("doc_id", T.telling_tokens(F.col("text")).alias("tokens")), "tokens")
    return docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("recommendation_index"), F.col("tokens").alias("r_tokens")), docs.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("completion_index"), F.col("tokens").alias("c_tokens"))


@query(f"""WITH d AS (SELECT doc_id, unnest({_telling('text')}) AS token FROM documents), p AS (SELECT * FROM d WHERE doc_id % 2 = 1), f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
a AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY df, token) AS rank FROM d JOIN f USING (token) WHERE doc_id % 2 = 0),
m AS (SELECT a.doc_id AS recommendation_index, p.doc_id AS completion_index, min(rank) AS rank FROM a JOIN p USING (token) WHERE rank <= 8 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY recommendation_index ORDER BY rank, completion_index) AS pool_rank FROM m)
SELECT recommendation_index, completion_index, CAST(pool_rank AS BIGINT) AS pool_rank FROM r WHERE pool_rank <= 1200""")
def rare_token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = linkage.token_pool(*_documents_sides(spark, sf_dir), DEFAULT.pool_limit)
    return pool.withColumn("pool_rank", F.col("pool_rank").cast("bigint"))


def _linked_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as recommendations (even keys) and completions (odd keys), standardised."""
    # the text work of a row outweighs the file's bytes, by which Spark would deal tasks
    rows = L.view(spark, sf_dir, L.PARTS).repartition(2 * spark.sparkContext.defaultParallelism, "id")
    norm, entity = T.normalize_text(F.col("work_description")), T.normalize_text(F.col("entity"))
    names = {f"{n}_{k}": entity if k != "key" else T.key_of(entity) for n in ("mp", "constituency", "state", "ida", "category") for k in ("norm",)}
    rows = rows.withColumns({"work_norm": norm, **names, "mp_canonical": entity, "constituency_canonical": entity})
    rows = rows.withColumns({k: T.key_of(entity) for k in ("mp_canonical_key", "constituency_canonical_key", "state_norm_key", "category_norm_key")} | {"work_id_key": F.lit("")})
    rec = rows.filter("id % 2 = 0").withColumns({"recommendation_index": F.col("id"), "recommended_amount": F.col("amount"), "recommendation_date": F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(size)"), "mp_name": F.col("entity"), "constituency": F.col("entity"), "state": F.col("entity"), "category": F.col("entity"), "ida": F.col("entity"), "work_id": F.lit("")})
    comp = rows.filter("id % 2 = 1").withColumns({"completion_index": F.col("id"), "final_amount": F.col("amount"), "completed_date": F.expr("timestamp_ntz'2024-03-01' + make_dt_interval(size)"), "mp_name": F.col("entity"), "constituency": F.col("entity"), "state": F.col("entity"), "category": F.col("entity"), "ida": F.col("entity"), "work_id": F.lit("")})
    return rec, comp


_KEEP_WARNINGS = "list_filter(string_split(said, '|'), lambda w: w <> '')"
_CLASH = "list_filter(w, lambda x: starts_with(x, 'conflicting '))"
_HARD = "list_filter(w, lambda x: x IN ('different MP', 'different state', 'different constituency'))"
_CONTEXT = ("mp_similarity", "state_similarity", "constituency_similarity")


@query(f"""WITH e AS (SELECT *, {_KEEP_WARNINGS} AS w FROM ({L.duck(L.EVIDENCE)})), f AS (SELECT *, {_CLASH} AS clash, {_HARD} AS hard,
  mp_similarity >= 97 AND state_similarity >= 97 AND constituency_similarity >= 97 AS strong, description_similarity < 78 OR project_token_overlap < 25 AS weak, list_contains(w, 'different IDA') AS ida, list_contains(w, 'different category') AS cat FROM e),
g AS (SELECT *, strong AND NOT weak AND len(clash) = 0 AND len(hard) = 0 AS fine FROM f),
h AS (SELECT *, fine AND score >= 88 AND margin >= 8 AND description_similarity >= 90 AS one, fine AND score >= 78 AND margin >= 4 AND project_token_overlap >= 35 AS two FROM g),
r AS (SELECT *, CASE WHEN amount_similarity < 50 THEN printf('Amount similarity hard gate failed (amount_similarity=%.1f < 50 required)', amount_similarity)
  WHEN one AND ida AND description_similarity < 96 THEN printf('IDA mismatch with insufficient description similarity for override (description_similarity=%.1f < 96 required when IDA differs)', description_similarity)
  WHEN one AND cat AND description_similarity < 95 THEN printf('Category mismatch with insufficient description similarity for override (description_similarity=%.1f < 95 required when category differs)', description_similarity)
  WHEN one THEN ''
  WHEN two AND ida AND description_similarity < 90 THEN printf('IDA mismatch with insufficient description similarity for Tier 2 override (description_similarity=%.1f < 90 required when IDA differs)', description_similarity)
  WHEN two THEN ''
  WHEN len(clash) > 0 THEN 'Conflicting field(s) detected: ' || array_to_string(clash, '; ')
  WHEN len(hard) > 0 THEN 'Hard entity mismatch: ' || array_to_string(hard, ', ')
  WHEN NOT strong THEN 'Insufficient context strength (requires ≥97): ' || concat_ws(', ', {", ".join(f"CASE WHEN {c} < 97 THEN printf('{c}=%.1f', {c}) END" for c in _CONTEXT)})
  WHEN weak THEN 'Weak description signal: ' || concat_ws('; ', CASE WHEN description_similarity < 78 THEN printf('description_similarity=%.1f < 78 floor', description_similarity) END, CASE WHEN project_token_overlap < 25 THEN printf('project_token_overlap=%.1f < 25 floor', project_token_overlap) END)
  WHEN score < 78 THEN printf('Score below Tier 2 threshold (score=%.3f < 78)', score)
  WHEN margin < 4 THEN printf('Score margin too small (margin=%.3f < 4 required)', margin)
  WHEN project_token_overlap < 35 THEN printf('Token overlap below Tier 2 minimum (project_token_overlap=%.1f < 35)', project_token_overlap)
  ELSE printf('Score/margin/tier conditions not met (score=%.3f, margin=%.3f)', score, margin) END AS blocker FROM h)
SELECT id, CASE WHEN blocker <> '' THEN 'Unmatched' WHEN one THEN 'Tier 1' ELSE 'Tier 2' END AS match_tier, CASE WHEN blocker <> '' THEN 'Unmatched' WHEN one THEN 'Verified' ELSE 'Provisional' END AS match_confidence, blocker FROM r""")
def match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.view(spark, sf_dir, L.EVIDENCE).withColumn("warnings", F.filter(F.split("said", r"\|"), lambda w: w != ""))
    return linkage.tiered(rows).select("id", "match_tier", "match_confidence", "blocker")


@query(f"""WITH p AS ({L.duck(L.PAIRS)}), o AS (SELECT *, row_number() OVER (PARTITION BY recommendation_index, completion_index ORDER BY score DESC, stage, place) AS turn FROM p),
n AS (SELECT *, lead(score) OVER w AS next, row_number() OVER w AS place_in FROM o WHERE turn = 1 WINDOW w AS (PARTITION BY recommendation_index ORDER BY score DESC, stage, place, completion_index))
SELECT recommendation_index, completion_index, score, CAST(stage AS BIGINT) AS stage, score - coalesce(next, 0.0) AS margin FROM n WHERE place_in = 1""")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.ranked(L.view(spark, sf_dir, L.PAIRS)).select("recommendation_index", "completion_index", "score", F.col("stage").cast("bigint").alias("stage"), "margin")


def _norm_sql(c: str) -> str:
    return _NORM.replace("text", c)


_FIELDS = (("d", "na", "nb"), ("m", "r_mp", "c_mp"), ("p", "r_place", "c_place"), ("s", "r_state", "c_state"), ("i", "r_ida", "c_ida"), ("k", "r_cat", "c_cat"))
_NUMBER_CLASH = ", ".join(
    f"CASE WHEN len(x{g}) > 0 AND len(y{g}) > 0 AND len(list_intersect(x{g}, y{g})) = 0 THEN 'conflicting location number ({T.LOCATION_WORDS[g][0]}: [' || array_to_string(list_sort(x{g}), ', ') || '] vs [' || array_to_string(list_sort(y{g}), ', ') || '])' END" for g in range(len(T.LOCATION_WORDS))
)
_SIDES_SQL = f"""d AS (SELECT *, {_norm_sql('a')} AS na, {_norm_sql('b')} AS nb FROM ({L.duck(L.SIDES)})),
pairs AS ({" UNION ALL ".join(f"SELECT id, '{k}' AS kind, {x} AS a, {y} AS b FROM d" for k, x, y in _FIELDS)}), {_TSR},
e AS (SELECT id, {", ".join(f"max(CASE WHEN kind = '{k}' THEN similarity END) AS e{i}" for i, (k, _, _) in enumerate(_FIELDS))} FROM r GROUP BY id),
v AS (SELECT d.*, e0, e1, e2, e3, e4, e5, CASE WHEN r_amount > 0 AND c_amount > 0 THEN 100.0 * least(r_amount, c_amount) / greatest(r_amount, c_amount) ELSE 0.0 END AS e6,
  CASE WHEN days IS NULL THEN 45.0 WHEN days BETWEEN 0 AND 900 THEN greatest(20.0, 100.0 - 45.0 * days / 900) WHEN days BETWEEN -30 AND -1 THEN 10.0 ELSE 0.0 END AS e7, {_telling('na')} AS ta, {_telling('nb')} AS tb,
  {_places_sql('d.a')} AS pa, {_places_sql('d.b')} AS pb, {_types_sql('d.a')} AS wa, {_types_sql('d.b')} AS wb, {", ".join(f"{_numbers_sql(n, '|'.join(words))} AS {x}{g}" for g, words in enumerate(T.LOCATION_WORDS) for x, n in (("x", "na"), ("y", "nb")))} FROM d JOIN e ON d.id = e.id),
o AS (SELECT *, CASE WHEN least(len(ta), len(tb)) > 0 THEN 100.0 * len(list_intersect(ta, tb)) / least(len(ta), len(tb)) ELSE 0.0 END AS e8 FROM v),
q AS (SELECT *, CASE WHEN r_mp <> c_mp THEN 'different MP' END AS z1, CASE WHEN r_state <> c_state THEN 'different state' END AS z2, CASE WHEN c_place <> '' AND r_place <> c_place THEN 'different constituency' END AS z3, CASE WHEN r_ida <> c_ida THEN 'different IDA' END AS z4,
  CASE WHEN r_cat <> c_cat THEN 'different category' END AS z5, CASE WHEN e8 < 30 AND e0 < 95 THEN 'weak shared project tokens' END AS z6, concat_ws('; ', {_NUMBER_CLASH}) AS z7, CASE WHEN {_both_ways_sql('pa', 'pb')} THEN 'conflicting location' END AS z8, CASE WHEN {_both_ways_sql('wa', 'wb')} THEN 'conflicting project type' END AS z9 FROM o)"""


@query(f"""WITH {_SIDES_SQL} SELECT id, {", ".join(f"CAST(round_even(e{i}, 2) AS DOUBLE) AS {n}" for i, n in enumerate(linkage.EVIDENCE))},
  round(greatest(0.0, 0.66 * e0 + 0.10 * e1 + 0.09 * e2 + 0.04 * e3 + 0.03 * e4 + 0.03 * e5 + 0.03 * e6 + 0.02 * e7 - (CASE WHEN z1 IS NULL THEN 0 ELSE 8 END + CASE WHEN z2 IS NULL THEN 0 ELSE 8 END + CASE WHEN z3 IS NULL THEN 0 ELSE 8 END + CASE WHEN z4 IS NULL THEN 0 ELSE 14 END
  + CASE WHEN z5 IS NULL THEN 0 ELSE 10 END + CASE WHEN z6 IS NULL THEN 0 ELSE 6 END + CASE WHEN z7 = '' THEN 0 ELSE 8 * len(string_split(z7, '; ')) END + CASE WHEN z8 IS NULL THEN 0 ELSE 8 END + CASE WHEN z9 IS NULL THEN 0 ELSE 8 END)), 6) AS score,
  concat_ws('; ', z1, z2, z3, z4, z5, z6, CASE WHEN z7 <> '' THEN z7 END, z8, z9) AS warnings FROM q""")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.view(spark, sf_dir, L.SIDES)

    def side(x: str, text: str, index: str, amount: str, date: str) -> DataFrame:
        names = {"mp_canonical": "mp", "mp_norm": "mp", "constituency_canonical": "place", "state_norm": "state", "ida_norm": "ida", "category_norm": "cat"}
        keys = {"mp_canonical_key": "mp", "constituency_canonical_key": "place", "state_norm_key": "state", "ida_key": "ida", "category_norm_key": "cat"}
        when = F.expr("timestamp_ntz'2024-01-01'") if x == "r" else F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(days as int))")
        fields = [F.col(f"{x}_{c}").alias(n) for n, c in names.items()] + [T.key_of(F.col(f"{x}_{c}")).alias(n) for n, c in keys.items()]
        return rows.select(F.col("id").alias(index), F.col(text).alias("work_description"), T.normalize_text(F.col(text)).alias("work_norm"), *fields, F.col(f"{x}_amount").alias(amount), when.alias(date))

    rec = linkage.recommendations_side(side("r", "a", "recommendation_index", "recommended_amount", "recommendation_date"))
    comp = linkage.completions_side(side("c", "b", "completion_index", "final_amount", "completed_date"))
    found = linkage.scored(rec.join(comp, F.col("recommendation_index") == F.col("completion_index")))
    return found.select(F.col("recommendation_index").alias("id"), *linkage.EVIDENCE, F.round("score", 6).alias("score"), F.array_join("warnings", "; ").alias("warnings"))


_ON_TIME = "(c_day IS NULL OR r_day IS NULL OR c_day - r_day BETWEEN -30 AND 900)"


@query(f"""WITH w AS ({L.duck(L.WORKS)}),
ds AS (SELECT DISTINCT d FROM w), pairs AS (SELECT x.d AS a, y.d AS b FROM ds x CROSS JOIN ds y), {_TSR},
rec AS (SELECT id AS rid, d AS rd, m AS rm, pl AS rp, st AS rs, wid AS rw, day AS r_day FROM w WHERE id % 2 = 0), comp AS (SELECT id AS cid, d AS cd, m AS cm, pl AS cp, st AS cs, wid AS cw, day AS c_day FROM w WHERE id % 2 = 1),
ones AS (SELECT rid, cid, 1 AS stage, cid AS place, 'exact normalized description' AS source, r_day, c_day FROM rec JOIN comp ON rd = cd AND rm = cm AND rp = cp AND rs = cs),
few AS (SELECT *, row_number() OVER (PARTITION BY cw ORDER BY cid) AS turn FROM comp WHERE cw <> ''),
twos AS (SELECT rid, cid, 2 AS stage, cid AS place, 'corroborated Work ID' AS source, r_day, c_day FROM rec JOIN few ON rw = cw JOIN r ON r.a = rd AND r.b = cd WHERE turn <= 10 AND similarity >= 80 AND rm = cm AND rs = cs),
sure AS (SELECT * FROM (SELECT * FROM ones UNION ALL SELECT * FROM twos) WHERE {_ON_TIME}),
rest AS (SELECT * FROM rec WHERE rid NOT IN (SELECT rid FROM sure)),
blocks AS (SELECT cm, cp, cs, count(*) AS block FROM comp GROUP BY ALL),
sized AS (SELECT rest.*, coalesce(block, 0) BETWEEN 1 AND 1200 AS blocked FROM rest LEFT JOIN blocks ON rm = cm AND rp = cp AND rs = cs),
near AS (SELECT rid, cid, row_number() OVER (PARTITION BY rid ORDER BY similarity DESC, cid) AS place, r_day, c_day FROM sized JOIN comp ON rm = cm AND rp = cp AND rs = cs JOIN r ON r.a = rd AND r.b = cd WHERE blocked AND similarity >= 55),
posts AS (SELECT cid, unnest({_telling('cd')}) AS token FROM comp), freq AS (SELECT token, count(*) AS df FROM posts GROUP BY token),
asked AS (SELECT rid, token, row_number() OVER (PARTITION BY rid ORDER BY df, token) AS rank FROM (SELECT rid, unnest({_telling('rd')}) AS token FROM sized WHERE NOT blocked) JOIN freq USING (token)),
met AS (SELECT rid, cid, min(rank) AS rank FROM asked JOIN posts USING (token) WHERE rank <= 8 GROUP BY ALL), pool AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY rank, cid) AS pool_rank FROM met),
fits AS (SELECT pool.rid, pool.cid, pool_rank, r_day, c_day, CASE WHEN rs = cs AND rp = cp THEN 2 WHEN rs = cs THEN 1 ELSE 0 END AS fit FROM pool JOIN rec ON pool.rid = rec.rid JOIN comp ON pool.cid = comp.cid WHERE pool_rank <= 1200),
most AS (SELECT *, max(fit) OVER (PARTITION BY rid) AS best FROM fits), far AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pool_rank) AS place FROM most WHERE fit >= best)
SELECT rid AS recommendation_index, cid AS completion_index, CAST(stage AS BIGINT) AS stage, CAST(place AS BIGINT) AS place, source FROM (SELECT rid, cid, stage, place, source FROM sure
  UNION ALL SELECT rid, cid, 3, place, 'blocked fuzzy retrieval' FROM near WHERE place <= 10 AND {_ON_TIME} UNION ALL SELECT rid, cid, 3, place, 'fuzzy token retrieval' FROM far WHERE place <= 10 AND {_ON_TIME})""")
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.view(spark, sf_dir, L.WORKS)
    same = {"work_norm": "d", "work_description": "d", "mp_norm": "m", "mp_canonical": "m", "constituency_canonical": "pl", "state_norm": "st", "work_id_key": "wid"}
    keys = {"mp_canonical_key": "m", "constituency_canonical_key": "pl", "state_norm_key": "st"}
    rows = rows.select("id", *(F.col(c).alias(n) for n, c in same.items()), *(T.key_of(F.col(c)).alias(n) for n, c in keys.items()), F.lit(1.0).alias("amount"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(day as int))").alias("date"))
    rec = rows.filter("id % 2 = 0").withColumnsRenamed({"id": "recommendation_index", "amount": "recommended_amount", "date": "recommendation_date"})
    comp = rows.filter("id % 2 = 1").withColumnsRenamed({"id": "completion_index", "amount": "final_amount", "date": "completed_date"})
    sides = linkage.told_once(linkage.plain_recommendations(rec), "r"), linkage.told_once(linkage.plain_completions(comp), "c")
    found = linkage.candidates(*(stage(side, name) for side, name in zip(sides, ("recommendations", "completions"))))
    return found.select("recommendation_index", "completion_index", F.col("stage").cast("bigint").alias("stage"), "place", "source")


@query()
def match_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.match_records(*_linked_parts(spark, sf_dir)).select(*linkage.RESULT)


#: Claims of orders on customers, as matches that compete for completions.
_CLAIMS = "SELECT o_orderkey AS recommendation_index, CASE WHEN o_totalprice > 50000 THEN o_custkey ELSE -1 END AS completion_index, CASE WHEN o_totalprice > 50000 THEN round(least(100.0, o_totalprice / 5000), 1) ELSE 0.0 END AS match_score, CASE WHEN o_totalprice > 200000 THEN 'Tier 1' WHEN o_totalprice > 50000 THEN 'Tier 2' ELSE 'Unmatched' END AS match_tier, CASE WHEN o_totalprice > 200000 THEN 'Verified' WHEN o_totalprice > 50000 THEN 'Provisional' ELSE 'Unmatched' END AS match_confidence, CAST(o_orderkey % 13 AS DOUBLE) AS score_margin, o_custkey AS best_candidate_index, round(o_totalprice / 5000, 1) AS best_candidate_score, 'x; description=' || CAST(o_orderkey % 100 AS STRING) || '.0' AS match_reason FROM {orders}"
_CLAIMED = f"""k AS ({L.duck(_CLAIMS)}), o AS (SELECT *, completion_index >= 0 AND row_number() OVER (PARTITION BY completion_index ORDER BY match_score DESC, recommendation_index) > 1 AS lost FROM k),
m AS (SELECT recommendation_index, CASE WHEN lost THEN -1 ELSE completion_index END AS completion_index, CASE WHEN lost THEN 0.0 ELSE match_score END AS match_score, CASE WHEN lost THEN 'Unmatched' ELSE match_tier END AS match_tier, CASE WHEN lost THEN 'Unmatched' ELSE match_confidence END AS match_confidence,
  score_margin, best_candidate_index, best_candidate_score, CASE WHEN lost THEN '[UNMATCHED REASON] Candidate already assigned to a stronger recommendation (one-to-one matching) || ' || match_reason ELSE match_reason END AS match_reason FROM o)"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.one_to_one(L.view(spark, sf_dir, _CLAIMS))


@query(f"WITH {_CLAIMED} SELECT * FROM m")
def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)


@query(f"""WITH {_CLAIMED} SELECT 'accepted match scores in range' AS "check", bool_and(match_score BETWEEN 0 AND 100) AS passed FROM m UNION ALL SELECT 'valid tiers', bool_and(match_tier IN ('Tier 1', 'Tier 2', 'Unmatched')) FROM m
UNION ALL SELECT 'no duplicate completion assignments', count(*) = count(DISTINCT completion_index) FROM m WHERE completion_index >= 0 UNION ALL SELECT 'unmatched rows have nonpositive completion index', bool_and(completion_index < 0) FROM m WHERE match_tier = 'Unmatched'""")
def match_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.validate_matches(_assigned(spark, sf_dir)).select("check", "passed")


@query(f"WITH {_CLAIMED} SELECT recommendation_index, CASE WHEN starts_with(match_reason, '[UNMATCHED REASON]') THEN trim(string_split(substr(match_reason, 19), ' || ')[1]) ELSE '' END AS cause, TRY_CAST(regexp_extract(match_reason, 'description=([0-9.]+)', 1) AS DOUBLE) AS description FROM m")
def parsed_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.col("match_reason")
    return _assigned(spark, sf_dir).select("recommendation_index", T.unmatched_reason(reason).alias("cause"), T.reason_value(T.reason_evidence(reason), "description").alias("description"))


# --- projects ----------------------------------------------------------------------------------------------


def _stat(c: str, q: float) -> str:
    return f"CASE WHEN enough THEN quantile_cont({c}, {q}) OVER near ELSE quantile_cont({c}, {q}) OVER wide END"


def _rank(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY peer_group ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY peer_group, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY peer_group) * 100 END"


_PEERS = f"""
p0 AS (SELECT *, CASE WHEN amount_difference_pct IS NOT NULL THEN greatest(amount_difference_pct, 0) END AS positive_amount_difference_pct, count(*) OVER (PARTITION BY state, category) >= 15 AS enough FROM ({P})),
p1 AS (SELECT * REPLACE (CAST(days_to_completion AS DOUBLE) AS days_to_completion), CASE WHEN enough THEN state || ' | ' || category ELSE category END AS peer_group FROM p0),
p2 AS (SELECT *, {_stat('positive_amount_difference_pct', 0.5)} AS cost_peer_median, {_stat('positive_amount_difference_pct', 0.75)} AS cost_peer_p75, {_stat('positive_amount_difference_pct', 0.95)} AS cost_peer_p95,
  {_stat('days_to_completion', 0.5)} AS duration_peer_median, {_stat('days_to_completion', 0.75)} AS duration_peer_p75, {_stat('days_to_completion', 0.95)} AS duration_peer_p95,
  {_rank('positive_amount_difference_pct')} AS cost_percentile, {_rank('days_to_completion')} AS duration_percentile FROM p1 WINDOW near AS (PARTITION BY state, category), wide AS (PARTITION BY category)),
peers AS (SELECT *, CASE WHEN duration_peer_median > 0 THEN days_to_completion / duration_peer_median END AS duration_ratio_to_peer_median, CASE WHEN cost_peer_median > 0 THEN positive_amount_difference_pct / cost_peer_median END AS cost_ratio_to_peer_median FROM p2)"""
_FLAGS = f"""{_PEERS},
iq AS (SELECT count(positive_amount_difference_pct) AS n1, quantile_cont(positive_amount_difference_pct, 0.25) AS a1, quantile_cont(positive_amount_difference_pct, 0.75) AS b1, count(days_to_completion) AS n2, quantile_cont(days_to_completion, 0.25) AS a2, quantile_cont(days_to_completion, 0.75) AS b2 FROM peers),
flags AS (SELECT peers.*, coalesce(n1 >= 15 AND b1 <> a1 AND positive_amount_difference_pct > b1 + 1.5 * (b1 - a1), false) AS amount_difference_pct_iqr_flag, coalesce(n2 >= 15 AND b2 <> a2 AND days_to_completion > b2 + 1.5 * (b2 - a2), false) AS days_to_completion_iqr_flag,
  coalesce(cost_percentile >= 95, false) AS cost_peer_high_flag, coalesce(duration_percentile >= 95, false) AS duration_peer_high_flag, coalesce(duration_ratio_to_peer_median >= 2, false) AS duration_ratio_high_flag FROM peers CROSS JOIN iq)"""
_RISK = f"""{_FLAGS},
pts AS (SELECT *, (CASE WHEN positive_amount_difference_pct >= 50 THEN 18 WHEN positive_amount_difference_pct >= 25 THEN 10 ELSE 0 END + CASE WHEN amount_difference_pct_iqr_flag THEN 8 ELSE 0 END + CASE WHEN cost_percentile >= 95 THEN 12 ELSE 0 END
  + CASE WHEN days_to_completion >= 540 THEN 14 WHEN days_to_completion >= 360 THEN 8 ELSE 0 END + CASE WHEN days_to_completion_iqr_flag THEN 7 ELSE 0 END + CASE WHEN duration_percentile >= 95 THEN 10 ELSE 0 END
  + CASE WHEN duration_ratio_to_peer_median >= 2 THEN 8 ELSE 0 END + CASE WHEN has_images = false THEN 12 ELSE 0 END) * CASE WHEN match_tier = 'Tier 2' THEN 0.85 ELSE CAST(1.0 AS DOUBLE) END AS points FROM flags),
risk AS (SELECT *, round(CAST(least(100.0, points) AS DOUBLE), 2) AS risk_score, CASE WHEN points >= 70 THEN 'HIGH' WHEN points >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM pts)"""


def _peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.peer_features(L.view(spark, sf_dir, L.PROJECTS))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.project_risk(anomaly.statistical_flags(_peers(spark, sf_dir)).withColumn("ml_anomaly_flag", F.lit(False)))


@query(f"SELECT recommendation_row_id, round(amount_difference, 4) AS amount_difference, round(amount_difference_pct, 6) AS amount_difference_pct, days_to_completion, match_tier, has_images FROM ({P})")
def project_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.view(spark, sf_dir, L.PROJECTS)
    matches = rows.select(F.col("recommendation_row_id").alias("recommendation_index"), F.col("recommendation_row_id").alias("completion_index"), "match_score", "match_tier", F.lit("").alias("match_confidence"), "score_margin", F.lit("").alias("match_reason"))
    rec = rows.withColumnsRenamed({"recommendation_row_id": "recommendation_index"}).select("recommendation_index", "recommended_amount", "recommendation_date", "state", "category")
    comp = rows.select(F.col("recommendation_row_id").alias("completion_index"), "final_amount", F.col("completion_date").alias("completed_date"), "has_images")
    out = features.project_features(rec, comp, matches)
    return out.select("recommendation_row_id", F.round("amount_difference", 4).alias("amount_difference"), F.round("amount_difference_pct", 6).alias("amount_difference_pct"), "days_to_completion", "match_tier", "has_images")


_STATS = ("cost_peer_median", "cost_peer_p75", "cost_peer_p95", "duration_peer_median", "duration_peer_p75", "duration_peer_p95", "duration_ratio_to_peer_median", "cost_ratio_to_peer_median")


@query(f"WITH {_PEERS} SELECT recommendation_row_id, peer_group, " + ", ".join(f"round({c}, 6) AS {c}" for c in _STATS) + " FROM peers")
def peer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_peers(spark, sf_dir).select("recommendation_row_id", "peer_group", *_STATS), 6)


@query(f"WITH {_PEERS} SELECT recommendation_row_id, round(cost_percentile, 6) AS cost_percentile, round(duration_percentile, 6) AS duration_percentile FROM peers")
def peer_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_peers(spark, sf_dir).select("recommendation_row_id", "cost_percentile", "duration_percentile"), 6)


_FLAG_NAMES = ("amount_difference_pct_iqr_flag", "days_to_completion_iqr_flag", "cost_peer_high_flag", "duration_peer_high_flag", "duration_ratio_high_flag")


@query(f"WITH {_FLAGS} SELECT recommendation_row_id, {', '.join(_FLAG_NAMES)} FROM flags")
def iqr_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.statistical_flags(_peers(spark, sf_dir)).select("recommendation_row_id", *_FLAG_NAMES)


_SPARSE = f"SELECT recommendation_row_id, CASE WHEN recommendation_row_id % 7 <> 0 THEN final_amount END AS final_amount, CASE WHEN recommendation_row_id % 3 <> 0 THEN CAST(days_to_completion AS DOUBLE) END AS days FROM ({L.PROJECTS}) z"
_SPARSE_DUCK = L.duck(_SPARSE)


@query(f"WITH s AS ({_SPARSE_DUCK}), m AS (SELECT median(final_amount) AS f, median(days) AS d FROM s) SELECT recommendation_row_id, round(coalesce(final_amount, f), 6) AS final_amount, round(coalesce(days, d), 6) AS days FROM s CROSS JOIN m")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(anomaly.imputed(L.view(spark, sf_dir, _SPARSE), ("final_amount", "days")), 6)


@query(f"WITH s AS ({_SPARSE_DUCK}), q AS (SELECT quantile_cont(final_amount, 0.5) AS m1, quantile_cont(final_amount, 0.75) - quantile_cont(final_amount, 0.25) AS w1, quantile_cont(days, 0.5) AS m2, quantile_cont(days, 0.75) - quantile_cont(days, 0.25) AS w2 FROM s) SELECT recommendation_row_id, round((final_amount - m1) / CASE WHEN w1 = 0 THEN 1 ELSE w1 END, 6) AS final_amount, round((days - m2) / CASE WHEN w2 = 0 THEN 1 ELSE w2 END, 6) AS days FROM s CROSS JOIN q")
def robust_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(anomaly.robust_scaled(L.view(spark, sf_dir, _SPARSE), ("final_amount", "days")), 6)


@query()
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.isolation_forest(_peers(spark, sf_dir)).select("recommendation_row_id", "ml_anomaly_score", "ml_anomaly_flag")


_STEP = ", ".join(f"s{i + 1} AS (SELECT s.*  EXCLUDE (node), CASE WHEN (CASE n.col WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END) < n.cut THEN n.l ELSE n.r END AS node FROM s{i} s JOIN n ON s.tree = n.tree AND s.node = n.node)" for i in range(4))


@query(f"WITH n AS ({L.duck(L.TREES)}), x AS ({L.duck(L.CUT_COLUMNS)}), s0 AS (SELECT x.*, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM n)), {_STEP} SELECT id, round(power(2.0, -(avg(n.cut) / {anomaly._expected_depth(256)!r})), 9) AS isolation FROM s4 JOIN n ON s4.tree = n.tree AND s4.node = n.node GROUP BY id")
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomaly.isolation(L.view(spark, sf_dir, L.CUT_COLUMNS), spark.sql(L.TREES), ["x0", "x1", "x2", "x3"], "isolation")
    return rows.select("id", F.round("isolation", 9).alias("isolation"))


@query(f"WITH {_RISK} SELECT recommendation_row_id, risk_score, risk_level FROM risk")
def project_risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("recommendation_row_id", "risk_score", "risk_level")


_OVER, _LONG = "printf('Final amount is %.1f%% above recommended amount', positive_amount_difference_pct)", "printf('Long recommendation-to-completion timeline (%.0f days)', days_to_completion)"
_REASONS = f"""concat_ws(' | ', CASE WHEN positive_amount_difference_pct >= 25 THEN {_OVER} END, CASE WHEN amount_difference_pct_iqr_flag THEN 'Positive cost deviation is an upper-IQR outlier' END,
  CASE WHEN cost_percentile >= 95 THEN printf('Cost deviation is at about the %.0fth peer percentile', cost_percentile) END, CASE WHEN days_to_completion >= 360 THEN {_LONG} END,
  CASE WHEN days_to_completion_iqr_flag THEN 'Completion duration is an upper-IQR outlier' END, CASE WHEN duration_percentile >= 95 THEN printf('Duration is at about the %.0fth peer percentile', duration_percentile) END,
  CASE WHEN duration_ratio_to_peer_median >= 2 THEN printf('Duration is about %.1fx the peer median', duration_ratio_to_peer_median) END, CASE WHEN has_images = false THEN 'Completed work has no photographic proof of completion' END,
  CASE WHEN match_tier = 'Tier 2' THEN 'Project evidence comes from a provisional Tier 2 linkage' END)"""


_ALL_REASONS = f"""concat_ws(' | ', nullif({_REASONS.replace("CASE WHEN has_images = false", "CASE WHEN ml_anomaly_flag THEN 'Isolation Forest detected an unusual multi-feature profile' END, CASE WHEN has_images = false")}, ''), CASE WHEN coalesce(match_tier, 'Unmatched') = 'Unmatched' THEN 'Project linkage is not verified' END)"""
_RULES = """(CASE WHEN positive_amount_difference_pct >= 50 THEN 18 WHEN positive_amount_difference_pct >= 25 THEN 10 ELSE 0 END + CASE WHEN amount_difference_pct_iqr_flag THEN 8 ELSE 0 END + CASE WHEN cost_percentile >= 95 THEN 12 ELSE 0 END + CASE WHEN days_to_completion >= 540 THEN 14 WHEN days_to_completion >= 360 THEN 8 ELSE 0 END + CASE WHEN days_to_completion_iqr_flag THEN 7 ELSE 0 END
  + CASE WHEN duration_percentile >= 95 THEN 10 ELSE 0 END + CASE WHEN duration_ratio_to_peer_median >= 2 THEN 8 ELSE 0 END + CASE WHEN ml_anomaly_flag THEN 15 ELSE 0 END + CASE WHEN has_images = false THEN 12 ELSE 0 END)"""


@query(f"WITH d AS ({L.duck(L.RISKS)}), s AS (SELECT *, least(100e0, {_RULES} * CASE coalesce(match_tier, 'Unmatched') WHEN 'Tier 2' THEN 0.85e0 WHEN 'Unmatched' THEN 0.6e0 ELSE 1e0 END) AS points, {_ALL_REASONS} AS reasons FROM d) SELECT recommendation_row_id, round(points, 2) AS risk_score, CASE WHEN points >= 70 THEN 'HIGH' WHEN points >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, CASE WHEN reasons = '' THEN 'No strong project-level anomaly indicators triggered' ELSE reasons END AS risk_reasons FROM s")
def project_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.project_risk(L.view(spark, sf_dir, L.RISKS)).select("recommendation_row_id", "risk_score", "risk_level", "risk_reasons")


@query(f"WITH {_RISK} SELECT recommendation_row_id, CASE WHEN {_REASONS} = '' THEN 'No strong project-level anomaly indicators triggered' ELSE {_REASONS} END AS risk_reasons FROM risk")
def project_risk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("recommendation_row_id", "risk_reasons")


@query(f"WITH {_RISK} SELECT recommendation_row_id, risk_score, state, category FROM risk WHERE risk_level = 'HIGH'")
def high_risk_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter("risk_level = 'HIGH'").select("recommendation_row_id", "risk_score", "state", "category")


_ROLL = "CAST(count(recommendation_row_id) AS BIGINT) AS projects, CAST(count(*) FILTER (risk_level = 'HIGH') AS BIGINT) AS high_risk_projects, CAST(count(*) FILTER (risk_level = 'MEDIUM') AS BIGINT) AS medium_risk_projects, round(avg(risk_score), 6) AS avg_risk_score, round(avg(amount_difference_pct), 6) AS avg_cost_difference_pct, round(avg(days_to_completion), 6) AS avg_days_to_completion"


@query(f"WITH {_RISK} SELECT state, {_ROLL} FROM risk GROUP BY state")
def state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.rollup(_scored(spark, sf_dir), "state"), 6)


@query(f"WITH {_RISK} SELECT category, {_ROLL} FROM risk GROUP BY category")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.rollup(_scored(spark, sf_dir), "category"), 6)


@query(f"WITH {_RISK} SELECT state, constituency, {_ROLL} FROM risk GROUP BY state, constituency")
def constituency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.rollup(_scored(spark, sf_dir), "state", "constituency"), 6)


@query(f"WITH {_RISK} SELECT state, category, constituency, CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(constituency) = 0 THEN 'constituency' ELSE 'state' END AS level, {_ROLL} FROM risk GROUP BY GROUPING SETS ((state), (category), (state, constituency))")
def rollup_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.rollup_sets(_scored(spark, sf_dir)), 6)


def _profile_sql(name: str, columns: dict[str, bool]) -> str:
    parts = [f"SELECT '{name}' AS dataset, '{c}' AS \"column\", count(*) AS \"rows\", CAST({len(columns)} AS BIGINT) AS columns, CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS missing, CAST({f'count(*) FILTER (trim({c}) = {chr(39) * 2})' if text else '0'} AS BIGINT) AS blank_strings, CAST(count(DISTINCT {c}) + CASE WHEN count(*) FILTER ({c} IS NULL) > 0 THEN 1 ELSE 0 END AS BIGINT) AS unique_values, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 3) AS missing_pct, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name})) AS BIGINT) AS duplicate_rows_in_dataset FROM {name}" for c, text in columns.items()]
    return " UNION ALL ".join(parts)


_PROFILED = {"orders": {"o_orderkey": False, "o_custkey": False, "o_orderstatus": True, "o_totalprice": False, "o_orderdate": False, "o_orderpriority": True}, "documents": {"doc_id": False, "text": True, "lang": True, "source": True, "n_chars": False}}


@query(" UNION ALL ".join(_profile_sql(n, c) for n, c in _PROFILED.items()))
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quality_report({n: _table(spark, sf_dir, n) for n in _PROFILED}).drop("dtype")


@query(" UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS \"rows\", CAST({len(c)} AS BIGINT) AS columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {n})) AS duplicate_rows FROM {n}" for n, c in _PROFILED.items()))
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dataset_summary({n: _table(spark, sf_dir, n) for n in _PROFILED})


@query(f"""WITH {_RISK} SELECT 'risk score range' AS "check", bool_and(risk_score BETWEEN 0 AND 100) AS passed FROM risk UNION ALL SELECT 'valid risk levels', bool_and(risk_level IN ('LOW', 'MEDIUM', 'HIGH')) FROM risk UNION ALL SELECT 'unique recommendation rows', count(*) = count(DISTINCT recommendation_row_id) FROM risk
UNION ALL SELECT 'non-negative financial values', bool_and(recommended_amount >= 0 AND final_amount >= 0) FROM risk UNION ALL SELECT 'no large negative durations', bool_and(days_to_completion >= -30) FROM risk""")
def project_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.validate_projects(_scored(spark, sf_dir)).select("check", "passed")


@query(f"""WITH {_MEMBERS} SELECT 'project output nonempty' AS "check", (SELECT count(*) > 0 FROM ({P})) AS passed UNION ALL SELECT 'MP output nonempty', (SELECT count(*) > 0 FROM mi)""")
def output_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.validate_outputs(L.view(spark, sf_dir, L.PROJECTS), finance.member_indicators(*_money_tables(spark, sf_dir))).select("check", "passed")


# --- review and serving ------------------------------------------------------------------------------------


@query(f"""WITH {_CLAIMED}, lo AS (SELECT recommendation_index, match_score, score_margin, 'low' AS part FROM m WHERE match_tier = 'Tier 1' ORDER BY match_score, score_margin, recommendation_index LIMIT 3),
hi AS (SELECT recommendation_index, match_score, score_margin, 'high' AS part FROM m WHERE match_tier = 'Tier 1' AND recommendation_index NOT IN (SELECT recommendation_index FROM lo) ORDER BY match_score DESC, score_margin DESC, recommendation_index LIMIT 2) SELECT * FROM lo UNION ALL SELECT * FROM hi""")
def review_borderline_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = review.parts_of(_assigned(spark, sf_dir), "match_tier", {"Tier 1": [review.weakest(), review.strongest()]}, (3, 2))
    return picks.select("recommendation_index", "match_score", "score_margin", F.when(F.col("part") == 0, "low").otherwise("high").alias("part"))


def _sample_sql() -> str:
    """CTEs of the picks, part after part in each tier, and their union as ``picks``."""
    chance = (f"md5(concat_ws(':', CAST(recommendation_index AS VARCHAR), '{DEFAULT.seed}')), recommendation_index", 5)
    weak, strong = ("match_score, score_margin, recommendation_index", 3), ("match_score DESC, score_margin DESC, recommendation_index", 2)
    near, far = ("best_candidate_score DESC, recommendation_index", 3), ("best_candidate_score, recommendation_index", 2)
    parts, names = [], []
    for b, (tier, orders) in enumerate((("Tier 1", (chance, weak, strong)), ("Tier 2", (chance, weak, strong)), ("Unmatched", (chance, near, far)))):
        for i, (order, n) in enumerate(orders):
            taken = "".join(f" AND recommendation_index NOT IN (SELECT recommendation_index FROM s{b}{j})" for j in range(i))
            parts.append(f"s{b}{i} AS (SELECT *, {b} AS block, {i} AS part, row_number() OVER (ORDER BY {order}) AS turn FROM m WHERE match_tier = '{tier}'{taken} ORDER BY {order} LIMIT {n})")
            names.append(f"SELECT * FROM s{b}{i}")
    return ", ".join(parts) + f", picks AS ({' UNION ALL '.join(names)})"


@query(f"WITH {_CLAIMED}, {_sample_sql()} SELECT * EXCLUDE (block, part, turn), row_number() OVER (ORDER BY block, part, turn) AS review_id FROM picks")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_picks(_assigned(spark, sf_dir))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assigned(spark, sf_dir)
    return rows.withColumns({"review_type": F.when(F.col("match_tier") == "Unmatched", "unmatched").otherwise("matched"), "human_verdict": F.expr("CASE recommendation_index % 4 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'reject' WHEN 2 THEN 'SKIP' END"), "human_notes": F.lit("n")})


_VERDICTS = f"{_CLAIMED}, w AS (SELECT *, CASE WHEN match_tier = 'Unmatched' THEN 'unmatched' ELSE 'matched' END AS review_type, CASE recommendation_index % 4 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'reject' WHEN 2 THEN 'SKIP' END AS human_verdict FROM m)"


def _metric(name: str, condition: str, recovery: bool = False) -> str:
    yes, no, n = "count(*) FILTER (upper(human_verdict) = 'ACCEPT')", "count(*) FILTER (upper(human_verdict) = 'REJECT')", "count(*)"
    pct = f"round(100.0 * {yes} / nullif({n}, 0), 2)"
    cols = f"NULL::BIGINT AS accepted, NULL::BIGINT AS rejected, NULL::DOUBLE AS precision_pct, {yes} AS accepted_as_recovered, {no} AS correctly_unmatched, {pct} AS recovery_pct" if recovery else f"{yes} AS accepted, {no} AS rejected, {pct} AS precision_pct, NULL::BIGINT AS accepted_as_recovered, NULL::BIGINT AS correctly_unmatched, NULL::DOUBLE AS recovery_pct"
    return f"SELECT '{name}' AS metric_group, {n} AS reviewed, {cols} FROM w WHERE upper(human_verdict) IN ('ACCEPT', 'REJECT') AND {condition}"


@query(f"WITH {_VERDICTS} " + " UNION ALL ".join([_metric("Tier 1", "match_tier = 'Tier 1'"), _metric("Tier 2", "match_tier = 'Tier 2'"), _metric("Unmatched review", "review_type = 'unmatched'", True), _metric("All reviewed matches", "review_type = 'matched'")]))
def review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_metrics(_verdicts(spark, sf_dir))


@query(f"WITH {_VERDICTS} SELECT recommendation_index, review_type, CASE WHEN recommendation_index % 3 = 0 THEN coalesce(human_verdict, '') ELSE '' END AS human_verdict FROM w")
def verdict_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _verdicts(spark, sf_dir)
    earlier = rows.filter("recommendation_index % 3 = 0")
    fresh = rows.withColumns({"human_verdict": F.lit(""), "human_notes": F.lit("")})
    return review.carried_over(fresh, earlier).select("recommendation_index", "review_type", "human_verdict")


@query(f"WITH {_RISK} SELECT recommendation_row_id, state, category, risk_score, risk_level FROM risk WHERE risk_level = 'LOW' ORDER BY risk_score DESC NULLS LAST, recommendation_row_id LIMIT 20 OFFSET 20")
def projects_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.projects_items(_scored(spark, sf_dir), page=2, page_size=20, risk_level="LOW").select("recommendation_row_id", "state", "category", "risk_score", "risk_level")


@query(f"WITH {_RISK} SELECT recommendation_row_id, risk_score, risk_level FROM risk WHERE CAST(recommendation_row_id AS VARCHAR) = (SELECT CAST(min(recommendation_row_id) AS VARCHAR) FROM risk)")
def project_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _published(spark, sf_dir)
    projects = spark.read.parquet(f"{path}/rows")
    first = projects.agg(F.min("recommendation_row_id")).first()[0]  # from the files' statistics
    return serving.project_detail(projects, first).select("recommendation_row_id", "risk_score", "risk_level")


def _published(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "projects")
    serving.publish_projects(_scored(spark, sf_dir), path)
    return path


@query(f"WITH {_RISK}, p AS (SELECT recommendation_row_id, state, category, risk_score, risk_level, row_number() OVER (ORDER BY risk_score DESC NULLS LAST, recommendation_row_id) AS place FROM risk), s AS (SELECT state FROM risk ORDER BY recommendation_row_id LIMIT 1), f AS (SELECT p.*, count(*) OVER () AS total FROM p JOIN s USING (state) WHERE risk_level = 'LOW') SELECT recommendation_row_id, state, category, risk_score, risk_level, CAST(total AS BIGINT) AS total FROM f ORDER BY place LIMIT 30 OFFSET 30")
def projects_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _published(spark, sf_dir)
    state = spark.read.parquet(f"{path}/rows").orderBy("recommendation_row_id").select("state").first()
    equal = {"risk_level": "LOW", "state": state[0] if state else None}
    first = serving.published_page(spark, path, page_size=30, **equal)
    second = serving.published_page(spark, path, first.after if first.after is not None else 1 << 62, 30, **equal)
    return second.items.select("recommendation_row_id", "state", "category", "risk_score", "risk_level", F.lit(second.total).cast("bigint").alias("total"))


@query(f"WITH {_RISK} SELECT recommendation_row_id, risk_score, risk_level FROM risk WHERE risk_level IN ('HIGH', 'MEDIUM') ORDER BY CASE risk_level WHEN 'HIGH' THEN 0 ELSE 1 END, risk_score DESC, recommendation_row_id LIMIT 10")
def top_risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.top_risky(_scored(spark, sf_dir)).select("recommendation_row_id", "risk_score", "risk_level")


@query(f"WITH {_RISK} SELECT state, round(avg(risk_score), 6) AS avg_risk_score FROM risk GROUP BY state ORDER BY 2 DESC, state LIMIT 15")
def top_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(serving.top_states(reports.rollup(_scored(spark, sf_dir), "state")).select("state", "avg_risk_score"), 6)


@query(f"WITH {_RISK}, n AS (SELECT recommendation_row_id, (CASE WHEN positive_amount_difference_pct >= 25 THEN 1 ELSE 0 END + CASE WHEN amount_difference_pct_iqr_flag THEN 1 ELSE 0 END + CASE WHEN cost_percentile >= 95 THEN 1 ELSE 0 END + CASE WHEN days_to_completion >= 360 THEN 1 ELSE 0 END + CASE WHEN days_to_completion_iqr_flag THEN 1 ELSE 0 END + CASE WHEN duration_percentile >= 95 THEN 1 ELSE 0 END + CASE WHEN duration_ratio_to_peer_median >= 2 THEN 1 ELSE 0 END + CASE WHEN has_images = false THEN 1 ELSE 0 END + CASE WHEN match_tier = 'Tier 2' THEN 1 ELSE 0 END) AS k FROM risk) SELECT recommendation_row_id, CAST(greatest(k, 1) AS BIGINT) AS reasons FROM n")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.split_reasons(_scored(spark, sf_dir)).groupBy("recommendation_row_id").agg(F.count(F.lit(1)).alias("reasons"))


@query()
def explanation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.explanation_prompt(_scored(spark, sf_dir))


@query()
def input_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.input_manifest(spark, f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet")
