"""Samples for human review, carried-over verdicts, review metrics, and the review page."""

from __future__ import annotations

import html
from functools import reduce
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.config import DEFAULT, Config
from worklens.functions import text as T
from worklens.sources.staging import stage

KEY = ("review_type", "recommendation_index", "completion_index", "best_candidate_index")
#: Evidence columns of a review row and the names they have in a match reason.
REASON_VALUES = {"timeline_match_score": "timeline", "description_similarity": "description", "mp_similarity": "mp", "constituency_similarity": "constituency", "state_similarity": "state", "ida_similarity": "ida", "category_similarity": "category", "amount_similarity": "amount", "project_token_overlap": "token_overlap"}


def _ascending(column: str) -> Column:
    return F.struct(F.col(column).isNotNull().alias("given"), F.col(column).cast("double").alias("by"))


def _descending(column: str) -> Column:
    return F.struct(F.col(column).isNull().alias("given"), (-F.col(column).cast("double")).alias("by"))


def _cuts(rows: DataFrame, stratum: str, orders: dict[str, list[tuple[Column, int]]]) -> DataFrame:
    """(stratum, cuts: by order, what its last row to keep is sorted by), a local table. A task holds the first rows of
    an order, as many as are kept, and sorts no others."""
    tops = [rows.filter(F.col(stratum) == value).select(F.col(stratum).alias("stratum"), F.lit(i).alias("order"), key.alias("key")).orderBy("key").limit(n) for value, own in orders.items() for i, (key, n) in enumerate(own)]
    last = reduce(DataFrame.union, tops).groupBy("stratum", "order").agg(F.max("key").alias("key"))
    cuts = last.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("order", "key"))).alias("cuts"))
    return rows.sparkSession.createDataFrame(cuts.collect(), cuts.schema)  # a row a stratum


def strata_tops(rows: DataFrame, stratum: str, orders: dict[str, list[tuple[Column, int]]]) -> DataFrame:
    """(stratum, row: the row's columns, order, place): the first rows of each stratum in each of its orders, which are
    columns to sort by and how many rows to keep. Where the orders end is found first; then all strata and orders come
    from one scan, and only rows up to there are sorted or moved. ``rows`` should be stored."""
    kinds = [F.when(F.col(stratum) == value, F.array(*(F.struct(F.lit(i).alias("order"), F.lit(n).alias("most"), key.alias("key")) for i, (key, n) in enumerate(own)))) for value, own in orders.items()]
    within = F.filter(F.coalesce(*kinds), lambda x: x["key"] <= F.element_at("cuts", x["order"]))
    cuts = _cuts(rows, stratum, orders).withColumnsRenamed({"stratum": "_stratum"})
    long = rows.join(F.broadcast(cuts), F.col(stratum) == F.col("_stratum")).select(F.col(stratum).alias("stratum"), F.struct(*(rows[c] for c in rows.columns)).alias("row"), F.explode(within).alias("by"))
    place = F.row_number().over(Window.partitionBy("stratum", "by.order").orderBy("by.key"))
    most = max(n for own in orders.values() for _, n in own)
    first = long.select("stratum", "row", "by", place.alias("place")).filter(F.col("place") <= most)
    return first.filter(F.col("place") <= F.col("by.most")).select("stratum", "row", F.col("by.order").alias("order"), "place")


def sort_key(first: Column | None = None, second: Column | None = None, code: Column | None = None) -> Column:
    """What rows are sorted by, in a form that all orders share; recommendation_index decides ties."""
    nothing = F.struct(F.lit(False).alias("given"), F.lit(0.0).alias("by"))
    by = [nothing if c is None else c for c in (first, second)]
    return F.struct(by[0].alias("a"), by[1].alias("b"), (F.lit("").cast("binary") if code is None else code).alias("code"), F.col("recommendation_index").alias("index"))


def weakest() -> Column:
    return sort_key(_ascending("match_score"), _ascending("score_margin"))


def strongest() -> Column:
    return sort_key(_descending("match_score"), _descending("score_margin"))


def parts_of(rows: DataFrame, stratum: str, orders: dict[str, list[Column]], takes: tuple[int, ...]) -> DataFrame:
    """Rows picked part after part in each stratum: the first ``takes[i]`` of its i-th order that the earlier parts left.
    Adds ``part`` and ``turn`` (from 1). A recommendation has one row.

    A part's rows are among the first of its order, as many as it and the parts before it take; so a few rows a stratum,
    with their places in the orders, decide."""
    most = [sum(takes[: i + 1]) for i in range(len(takes))]
    first = strata_tops(stage(rows, "strata"), stratum, {value: list(zip(keys, most)) for value, keys in orders.items()})
    places = first.groupBy("stratum", "row.recommendation_index").agg(F.any_value("row").alias("row"), *(F.min(F.when(F.col("order") == i, F.col("place"))).alias(f"place{i}") for i in range(len(takes))))
    part = F.lit(None).cast("int")
    for i, n in enumerate(takes):
        places = places.withColumn("part", part)
        left = F.when(F.col("part").isNull() & F.col(f"place{i}").isNotNull(), F.col(f"place{i}"))
        turn = F.row_number().over(Window.partitionBy("stratum").orderBy(left.asc_nulls_last()))
        places = places.withColumn(f"turn{i}", F.when(left.isNotNull() & (turn <= n), turn))
        part = F.coalesce("part", F.when(F.col(f"turn{i}").isNotNull(), F.lit(i)))
    picked = places.withColumn("part", part).filter("part is not null")
    return picked.select("row.*", "part", F.coalesce(*(f"turn{i}" for i in range(len(takes)))).alias("turn"))


def review_picks(matches: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The sampled matches with ``review_id``: per tier 5 by a seeded hash, the 3 weakest and the 2 strongest
    of the rest; of the unmatched 5 by hash, the 3 best and the 2 worst candidates of the rest."""
    chance = sort_key(code=F.md5(F.concat_ws(":", F.col("recommendation_index").cast("string"), F.lit(str(config.seed))).cast("binary")).cast("binary"))
    near, far = sort_key(_descending("best_candidate_score")), sort_key(_ascending("best_candidate_score"))
    tiers = {"Tier 1": [chance, weakest(), strongest()], "Tier 2": [chance, weakest(), strongest()], "Unmatched": [chance, near, far]}
    picked = parts_of(matches, "match_tier", tiers, (5, 3, 2))
    order = Window.partitionBy(F.lit(0)).orderBy(F.array_position(F.array(*map(F.lit, tiers)), F.col("match_tier")), "part", "turn")  # at most 30 rows
    return picked.withColumn("review_id", F.row_number().over(order).cast("bigint")).drop("part", "turn")


def review_rows(matches: DataFrame, recommendations: DataFrame, completions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The review table: picks with both sides' fields, parsed evidence, and empty verdicts."""
    picks = review_picks(matches, config)
    matched = F.col("match_tier") != "Unmatched"
    evidence = F.when(matched, F.col("match_reason")).otherwise(T.reason_evidence(F.col("match_reason")))
    picks = picks.withColumns({"review_type": F.when(matched, "matched").otherwise("unmatched"), "_evidence": evidence, "unmatched_reason": F.when(matched, "").otherwise(T.unmatched_reason(F.col("match_reason")))})
    col = lambda df, c: F.col(c) if c in df.columns else F.lit("")
    fields = {"work_id": "work_id", "description": "work_description", "mp": "mp_name", "state": "state", "constituency": "constituency", "category": "category", "ida": "ida"}
    rec = recommendations.select("recommendation_index", *(col(recommendations, c).alias(f"recommendation_{n}") for n, c in fields.items()), "recommended_amount")
    comp = completions.select("completion_index", *(col(completions, c).alias(f"completion_{n}") for n, c in fields.items()), "final_amount")
    best = completions.select(F.col("completion_index").alias("best_candidate_index"), *(F.when(F.lit(True), col(completions, c)).alias(f"_best_{n}") for n, c in (("description", "work_description"), ("mp", "mp_name"))))
    out = picks.join(rec, "recommendation_index", "left").join(comp, "completion_index", "left").join(best, "best_candidate_index", "left")
    out = out.withColumns({f"best_candidate_{n}": F.when(~matched, F.coalesce(f"_best_{n}", F.lit(""))).otherwise("") for n in ("description", "mp")})
    out = out.withColumns({f"completion_{n}": F.coalesce(f"completion_{n}", F.lit("")) for n in fields} | {c: T.reason_value(F.col("_evidence"), name) for c, name in REASON_VALUES.items()})
    return out.withColumns({"human_verdict": F.lit(""), "human_notes": F.lit("")}).drop("_evidence", "_best_description", "_best_mp")


def carried_over(review: DataFrame, previous: DataFrame) -> DataFrame:
    """The review rows with the verdicts and notes of the first earlier row of the same key: of the smallest
    ``review_id``, where there is one, then of the smallest verdict and notes."""
    order = [F.col(c) for c in ("review_id", "human_verdict", "human_notes") if c in previous.columns]
    known = previous.withColumn("_turn", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).filter("_turn = 1")
    known = known.select(*KEY, F.col("human_verdict").alias("_verdict"), F.col("human_notes").alias("_notes"))
    out = review.drop("human_verdict", "human_notes").join(known, list(KEY), "left")
    return out.withColumns({"human_verdict": F.coalesce("_verdict", F.lit("")), "human_notes": F.coalesce("_notes", F.lit(""))}).drop("_verdict", "_notes")


#: What a reviewer may say.
VERDICTS = ("ACCEPT", "REJECT", "SKIP")


def with_verdicts(review: DataFrame, given: DataFrame) -> DataFrame:
    """The review rows with the verdicts and notes of ``given`` (review_id, human_verdict, human_notes) in place of their
    own. Raises ValueError for verdicts other than VERDICTS (in any case), review_ids that no row has, and those given
    twice."""
    given = given.select(F.col("review_id").try_cast("bigint").alias("review_id"), F.upper(F.trim("human_verdict")).alias("_verdict"), F.coalesce("human_notes", F.lit("")).alias("_notes"))
    known = review.select("review_id", F.lit(True).alias("_known")).distinct()
    wrong = given.join(known, "review_id", "left").withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("review_id")))
    wrong = wrong.filter(~F.coalesce(F.col("_verdict").isin(*VERDICTS), F.lit(False)) | F.col("_known").isNull() | (F.col("_times") > 1))
    if rows := wrong.orderBy("review_id").limit(5).collect():
        raise ValueError("verdicts that cannot be recorded: " + "; ".join(f"review_id {r.review_id}: {r['_verdict']}" for r in rows))
    out = review.join(given, "review_id", "left")
    return out.withColumns({"human_verdict": F.coalesce("_verdict", "human_verdict"), "human_notes": F.coalesce("_notes", "human_notes")}).drop("_verdict", "_notes").select(*review.columns)


def review_metrics(reviewed: DataFrame) -> DataFrame:
    """Precision of the tiers and recovery among the unmatched, from ACCEPT and REJECT verdicts."""
    verdict = F.upper(F.coalesce("human_verdict", F.lit("")))
    rows = reviewed.withColumn("_v", verdict).filter(F.col("_v").isin("ACCEPT", "REJECT"))
    yes, no = F.count_if(F.col("_v") == "ACCEPT"), F.count_if(F.col("_v") == "REJECT")
    pct = F.when(F.count(F.lit(1)) > 0, F.round(100.0 * yes / F.count(F.lit(1)), 2))

    def group(name: str, condition: str, recovery: bool = False) -> DataFrame:
        counts = (yes.alias("accepted_as_recovered"), no.alias("correctly_unmatched"), pct.alias("recovery_pct")) if recovery else (yes.alias("accepted"), no.alias("rejected"), pct.alias("precision_pct"))
        return rows.filter(condition).agg(F.count(F.lit(1)).alias("reviewed"), *counts).withColumn("metric_group", F.lit(name))

    parts = [group(t, f"review_type = 'matched' and match_tier = '{t}'") for t in ("Tier 1", "Tier 2")]
    parts += [group("Unmatched review", "review_type = 'unmatched'", True), group("All reviewed matches", "review_type = 'matched'")]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select("metric_group", "reviewed", "accepted", "rejected", "precision_pct", "accepted_as_recovered", "correctly_unmatched", "recovery_pct")


def review_page(review: DataFrame, limit: int = 1000) -> str:
    """An HTML page with a card per review row, at most ``limit`` (a sample has no more than 30)."""
    e = lambda x: html.escape("" if x is None else str(x))
    cards = []
    for r in review.orderBy("review_id").limit(limit).collect():
        lone = r["review_type"] == "unmatched"
        shown = [c for c in REASON_VALUES if r[c] is not None]
        grid = "".join(f"<div>{e(c.replace('_', ' '))} <b>{r[c]:.1f}</b></div>" for c in shown)
        banner = f"<p class='why'><b>Unmatched because</b> {e(r['unmatched_reason'])}</p>" if lone and r["unmatched_reason"] else ""
        other, member = ("best_candidate_description", "best_candidate_mp") if lone else ("completion_description", "completion_mp")
        cards.append(
            f"<article><header>{e(r['match_tier'])} <b>Score {r['match_score'] or 0:.2f}</b></header><h2>Recommendation</h2><p>{e(r['recommendation_description'])}</p>"
            f"<p>{e(r['recommendation_mp'])}, {e(r['recommendation_constituency'])}, {e(r['recommendation_state'])}</p><h2>{'Best rejected candidate' if lone else 'Matched completion'}</h2>"
            f"<p>{e(r[other])}</p><p>{e(r[member])}</p><section>{grid}</section>{banner}<footer>{e(r['match_reason'])}</footer></article>"
        )
    return "<!doctype html><meta charset='utf-8'><title>Match review</title><h1>Match review</h1><p>A match is a linkage assessment, not a finding.</p>" + "".join(cards)
