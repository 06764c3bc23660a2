"""Cleaning, features, risk, finance, reports, review, serving and the whole run, on hand-made cases."""

import datetime as dt
import json
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from worklens.config import DEFAULT
from worklens.functions import text as T
from worklens.operators import anomaly, cleaning, features, finance, ranks, reports, review, risk
from worklens.plans import pipeline, serving
from worklens.sources import files, runs


def values(spark, function, cases, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("c"))).collect()]


def test_money_and_dates(spark):
    got = values(spark, T.money, ["₹1,00,000", " 5 ", "(5)", "", None, "1e3", "inf", "1d", "-.5"])
    assert got == [100000.0, 5.0, None, None, None, 1000.0, math.inf, None, -0.5]
    got = values(spark, T.date, ["03/04/2024", "2024-04-03", "25/04/2024", "bad", None, "2024-04-03 10:00:00"])
    assert got == [dt.datetime(2024, 3, 4), dt.datetime(2024, 4, 3), dt.datetime(2024, 4, 25), None, None, dt.datetime(2024, 4, 3, 10)]


def test_names(spark):
    normal = lambda c: T.normalize_text(c)
    assert values(spark, normal, ["Ünï & CC-Road\tसड़क", None, "  ", "ｆｕｌｌ"]) == ["n and cc road सड़क", "", "", "full"]
    assert values(spark, lambda c: T.key_of(normal(c)), ["Ab-1 सड़क"]) == ["ab1"]
    assert values(spark, lambda c: T.canonical_member(normal(c)), ["Shri. Dr. X", "Smt Y", "Shriram"]) == ["dr x", "y", "shriram"]
    assert values(spark, lambda c: T.canonical_constituency(normal(c)), ["Pune - 12", "12"]) == ["pune", ""]


def pair(spark, function, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(function(F.col("a"), F.col("b"))).first()[0]


def test_conflicts(spark):
    numbers = lambda a, b: F.size(T.location_conflicts(T.location_numbers(a), T.location_numbers(b)))
    assert pair(spark, numbers, "13th ward", "ward 14") == 1
    assert pair(spark, numbers, "plot 3, ward 2", "plot 3, ward 5") == 1
    assert pair(spark, numbers, "survey no:782", "number 782") == 0
    assert pair(spark, numbers, "ward १३", "ward 13") == 0
    types = lambda a, b: T.differ_both_ways(T.work_types(a), T.work_types(b))
    assert pair(spark, types, "overhead tank", "Community Hall")
    assert not pair(spark, types, "compound wall", "boundary wall")
    assert pair(spark, types, "overhead tank and compound wall", "community hall with compound wall")
    places = lambda a, b: T.differ_both_ways(T.place_names(a), T.place_names(b))
    assert pair(spark, places, "ROAD IN PUNE", "Road in Nashik") and not pair(spark, places, "Road in Pune", "road")


def test_reasons(spark):
    text = "[UNMATCHED REASON] too weak || src; description=81.5; mp=x; description=82.5"
    rows = spark.createDataFrame([(text,), ("plain; mp=3",)], "r string")
    got = rows.select(T.unmatched_reason(F.col("r")), T.reason_evidence(F.col("r")), T.reason_value(T.reason_evidence(F.col("r")), "description"), T.reason_value(T.reason_evidence(F.col("r")), "mp")).collect()
    assert tuple(got[0]) == ("too weak", "src; description=81.5; mp=x; description=82.5", 82.5, None)
    assert tuple(got[1]) == ("", "plain; mp=3", None, 3.0)


def test_peers(spark):
    rows = spark.createDataFrame([(i, "S", "Roads", 10.0 + i, 100 + i) for i in range(15)] + [(100 + i, "T", "Roads", 5.0, None) for i in range(14)], "recommendation_row_id long, state string, category string, amount_difference_pct double, days_to_completion long")
    got = {r.recommendation_row_id: r for r in features.peer_features(rows).collect()}
    assert all(got[i].cost_percentile == pytest.approx((i + 1) / 15 * 100) and got[i].peer_group == "S | Roads" for i in range(15))
    assert got[0].cost_peer_median == 17 and got[0].duration_peer_median == 107
    assert got[100].peer_group == "Roads" and got[100].cost_peer_median == 10.0 and got[100].duration_percentile is None
    assert got[100].cost_percentile == pytest.approx(7.5 / 14 * 100)


def test_outliers(spark):
    flags = lambda xs: [r.f for r in anomaly.iqr_flags(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double"), {"x": "f"}).orderBy("i").collect()]
    assert flags([1.0 * i for i in range(14)] + [900.0])[-1] and not any(flags([1.0 * i for i in range(13)] + [900.0]))
    assert not any(flags([5.0] * 20)) and flags([1.0 * i for i in range(20)] + [None, 999.0])[-2:] == [False, True]


def test_isolation_forest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *(float(x) for x in rng.normal(size=3))) for i in range(300)] + [(1000, 40.0, -35.0, 50.0)]
    frame = spark.createDataFrame(rows, "recommendation_row_id long, recommended_amount double, final_amount double, match_score double")
    once = {r.recommendation_row_id: r for r in anomaly.isolation_forest(frame, trees=50).collect()}
    again = {r.recommendation_row_id: r for r in anomaly.isolation_forest(frame.repartition(3), trees=50).collect()}
    assert max(once.values(), key=lambda r: r.ml_anomaly_score).recommendation_row_id == 1000 and once[1000].ml_anomaly_flag
    assert all(-0.5 <= r.ml_anomaly_score <= 0.5 and r.ml_anomaly_score == pytest.approx(again[i].ml_anomaly_score, abs=2e-4) for i, r in once.items())
    assert {r.ml_anomaly_score for r in anomaly.isolation_forest(frame.limit(49)).collect()} == {0.0}


def test_a_stored_forest_scores_new_rows(spark, tmp_path):
    frame = spark.createDataFrame([(i, float(i % 7), float(i % 5) if i % 11 else None, float("nan") if i == 3 else 1.0) for i in range(200)] + [(999, 500.0, 90.0, 1.0)], "recommendation_row_id long, recommended_amount double, final_amount double, match_score double")
    forest = anomaly.fit_forest(frame, trees=40)
    forest.save(str(tmp_path / "forest"))
    stored = anomaly.Forest.load(spark, str(tmp_path / "forest"))
    assert [r.name for r in stored.scale.orderBy("col").collect()] == ["recommended_amount", "final_amount", "match_score"]
    own = {r.recommendation_row_id: r.ml_anomaly_score for r in anomaly.isolation_forest(frame, trees=40).collect()}
    assert {r.recommendation_row_id: r.ml_anomaly_score for r in anomaly.forest_flags(frame, stored).collect()} == own
    new = spark.createDataFrame([(1, 3.0, 2.0, 1.0), (2, 800.0, 95.0, 1.0), (3, None, None, None)], frame.schema)
    got = {r.recommendation_row_id: r for r in anomaly.forest_flags(new, stored).collect()}
    assert got[2].ml_anomaly_flag and got[2].ml_anomaly_score > got[1].ml_anomaly_score and len(got) == 3


def test_isolation_forest_scores_repeated_keys_row_by_row(spark):
    frame = spark.range(60).selectExpr("id % 30 recommendation_row_id", "cast(id as double) recommended_amount")
    assert anomaly.isolation_forest(frame, trees=5).count() == 60


def test_exact_quantiles_and_ranks(spark):
    rng = np.random.default_rng(3)
    rows = [(g, None if rng.random() < 0.1 else float(rng.integers(0, 40))) for g in ["hot"] * 900 + ["cold"] * 7 + [None] * 50 + ["empty"] * 0]
    frame = spark.createDataFrame([*rows, ("empty", None)], "g string, x double").repartition(5)
    values = [x for _, x in rows if x is not None]
    one = ranks.quantiles(frame, ("x",), (0.0, 0.25, 0.5, 0.95, 1.0)).first()
    assert one["x.n"] == len(values) and one["x.q"] == pytest.approx(np.quantile(values, [0.0, 0.25, 0.5, 0.95, 1.0]).tolist())
    for r in ranks.value_ranks(frame, ["g"], "x").collect():
        own = [x for g, x in rows if g == r.g and x is not None]
        assert (r.n, r.before, r.total) == (own.count(r.x), sum(x < r.x for x in own), len(own))
    none = ranks.quantiles(frame.limit(0), ("x",), (0.5,)).first()
    assert none["x.n"] == 0 and none["x.q"] == [None]


def test_numbers_follow_the_partitions(spark):
    frame = files.numbered(spark.range(1000, numPartitions=7), "n")
    assert [r.n for r in frame.orderBy("id").collect()] == list(range(1000)) and files.numbered(spark.range(50), "n", 8).count() == 8


def test_reasons_round_ties_to_even(spark):
    got = spark.createDataFrame([(96.5,), (97.5,), (98.51,)], "v double").select(T.formatted("%.0fth of %d", F.col("v"), F.lit(1))).collect()
    assert [r[0] for r in got] == ["96th of 1", "98th of 1", "99th of 1"]


def test_project_risk(spark):
    columns = "positive_amount_difference_pct double, amount_difference_pct_iqr_flag boolean, cost_percentile double, days_to_completion double, days_to_completion_iqr_flag boolean, duration_percentile double, duration_ratio_to_peer_median double, ml_anomaly_flag boolean, has_images boolean, match_tier string"
    rows = spark.createDataFrame([(80.0, True, 99.0, 700.0, True, 99.0, 2.5, True, None, "Tier 1"), (80.0, True, 99.0, 700.0, True, 99.0, 2.5, True, False, "Tier 1"), (None, None, None, None, None, None, None, None, True, "Tier 1"), (30.0, False, 0.0, 400.0, False, 0.0, 0.0, False, False, "Tier 2")], columns)
    got = [(r.risk_score, r.risk_level, r.risk_reasons.count(" | ")) for r in risk.project_risk(rows).collect()]
    assert got == [(92.0, "HIGH", 7), (100.0, "HIGH", 8), (0.0, "LOW", 0), (25.5, "LOW", 3)]


def test_members(spark):
    exp = spark.createDataFrame([("a", "c", "s", "i", "v", 2_000_000.0), ("a", "c", "s", "i", "w", 1_000_000.0), ("b", None, "s", "i", "v", 5.0)], "mp_name string, constituency string, state string, ida string, vendor_name string, amount_paid double")
    comp = spark.createDataFrame([("a", "c", "s", "i", 1_000_000.0), ("b", None, "s", "i", 0.0)], "mp_name string, constituency string, state string, ida string, final_amount double")
    summary = spark.createDataFrame([("a", "c", "s", 3_000_000.0), ("z", "c", "s", 10.0)], "mp_name string, constituency string, state string, total_expenditure double")
    got = {r.mp_name: r for r in risk.member_risk(finance.member_indicators(exp, comp, summary)).collect()}
    assert (got["a"].mp_risk_score, got["a"].mp_risk_level, got["a"].reconciliation_flag) == (90.0, "HIGH", False)
    assert got["b"].payment_mismatch_groups == 0 and got["b"].reconciliation_flag is None and got["b"].mp_risk_score == 45.0
    assert got["z"].top_vendor is None and got["z"].reconciliation_flag and got["z"].mp_risk_score == 10.0


def test_reports(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (2, " "), (None, None)], "i int, t string")
    assert tuple(reports.dataset_summary({"d": frame}).first()) == ("d", 4, 2, 1)
    got = {r.column: r for r in reports.quality_report({"d": frame}).collect()}
    assert (got["t"].missing, got["t"].blank_strings, got["t"].unique_values, got["t"].missing_pct, got["t"].duplicate_rows_in_dataset) == (1, 1, 3, 25.0, 1)
    matches = spark.createDataFrame([(1, 50.0, "Tier 1"), (1, 60.0, "Tier 2"), (-1, 0.0, "Unmatched")], "completion_index long, match_score double, match_tier string")
    assert [r.passed for r in reports.validate_matches(matches).collect()] == [True, True, False, True]
    assert all(r.passed for r in reports.validate_matches(matches.limit(0)).collect())


def test_review_metrics(spark):
    rows = spark.createDataFrame([("matched", "Tier 1", "ACCEPT"), ("matched", "Tier 1", "reject"), ("matched", "Tier 2", "SKIP"), ("unmatched", "Unmatched", "ACCEPT"), ("unmatched", "Unmatched", "REJECT")], "review_type string, match_tier string, human_verdict string")
    got = {r.metric_group: r for r in review.review_metrics(rows).collect()}
    assert got["Tier 1"].precision_pct == 50.0 and got["Unmatched review"].recovery_pct == 50.0 and got["Tier 2"].precision_pct is None


def test_paging(spark):
    rows = spark.createDataFrame([(i, "HIGH" if i % 2 else "LOW", float(i % 3)) for i in range(10)], "recommendation_row_id long, risk_level string, risk_score double")
    page = serving.projects_page(rows, page=2, page_size=2, risk_level="HIGH")
    assert [r.recommendation_row_id for r in page.items.collect()] == [7, 3] and (page.total, page.total_pages) == (5, 3)
    assert serving.project_detail(rows, "7").count() == 1 and serving.project_detail(rows, 70).count() == 0
    with pytest.raises(ValueError):
        serving.projects_items(rows, page=0)


def test_whole_run(spark, tmp_path):
    def extract(name, header, rows):
        (tmp_path / f"{name}.csv").write_text("\n".join([",".join(header)] + [",".join(f'"{c}"' for c in r) for r in rows]), encoding="utf-8")
        return str(tmp_path / f"{name}.csv")

    works = [f"Construction of hall number{i} at place{i}" for i in range(6)]
    base = lambda i: [f"W{i}", works[i], "Halls", "Shri. Member A", "Pune - 12", "MH", "LS"]
    paths = {
        "recommendations": extract("r", ["Work ID", "Work Description", "Category", "MP Name", "Constituency", "State", "House", "Recommended Amount (₹)", "Recommendation Date", "IDA"], [[*base(i), "₹1,00,000", "2024-01-01", "I1"] for i in range(6)]),
        "completions": extract("c", ["Work ID", "Work Description", "Category", "MP Name", "Constituency", "State", "House", "Final Amount (₹)", "Completed Date", "IDA", "Has Images"], [[*base(i), "1,50,000", "25/04/2025", "I1", "False"] for i in range(5)]),
        "expenditures": extract("e", ["MP Name", "Constituency", "State", "House", "Work Description", "Vendor", "IDA", "Expenditure Amount (₹)", "Expenditure Date", "Payment Status"], [["Shri. Member A", "Pune - 12", "MH", "LS", works[0], "V", "I1", "9,00,000", "2024-05-01", "Paid"]]),
        "mp_summary": extract("s", ["MP Name", "Constituency", "State", "House", "Total Expenditure (₹)"], [["Shri. Member A", "Pune - 12", "MH", "LS", "9,00,000"]]),
    }
    out = str(tmp_path / "out")
    summary = pipeline.run_pipeline(spark, paths, out)
    assert (summary["recommendations"], summary["projects"], summary["members"]) == (6, 5, 1)
    assert pipeline.missing_outputs(spark, out) == []
    project = runs.table(spark, out, "project_risk_scores").first()
    assert project.amount_difference_pct == 50.0 and project.has_images is False and project.risk_score > 0
    folder = tmp_path / "out" / "runs" / runs.current(spark, out)["run"]
    assert json.loads((folder / "pipeline_summary.json").read_text())["tier1_matches"] == summary["tier1_matches"] == runs.current(spark, out)["summary"]["tier1_matches"]
    assert "Match review" in (folder / "review" / "match_review.html").read_text(encoding="utf-8")
    with pytest.raises(pipeline.NoMatches):  # stops after some tables
        pipeline.run_pipeline(spark, paths, out, config=replace(DEFAULT, tier1_score=1e9, tier2_score=1e9))
    assert runs.current(spark, out)["run"] == folder.name and pipeline.missing_outputs(spark, out) == []
    assert len(list(folder.parent.iterdir())) == 2
    assert pipeline.run_pipeline(spark, paths, str(tmp_path / "two"), limit=2)["recommendations"] == 2
    with pytest.raises(FileNotFoundError):
        pipeline.run_pipeline(spark, paths | {"completions": "/nowhere.csv"}, out)


def test_readers(spark, tmp_path):
    (tmp_path / "x.csv").write_text(' a ,b\n"1","NA"\n"two\nlines","say ""hi"""\n', encoding="utf-8")
    frame = files.read_extract(spark, str(tmp_path / "x.csv"), index="n")
    assert [tuple(r) for r in frame.orderBy("n").collect()] == [("1", None, 0), ("two\nlines", 'say "hi"', 1)]
    assert cleaning.renamed(frame, "recommendations").columns == ["a", "b", "n"]
    with pytest.raises(ValueError):
        files.numbered(frame, "m", 0)


def test_all_earlier_verdicts_are_carried_over(spark):
    n = 120_000
    rows = spark.range(n).selectExpr("'matched' review_type", "id recommendation_index", "id completion_index", "id best_candidate_index", "'' human_verdict", "'' human_notes")
    known = rows.selectExpr("review_type", "recommendation_index", "completion_index", "best_candidate_index", "'ACCEPT' human_verdict", "'seen' human_notes")
    found = review.carried_over(rows, known)
    assert found.count() == n == found.filter("human_verdict = 'ACCEPT' and human_notes = 'seen'").count()


def test_one_decimal_place_rounds_ties_of_exact_values_to_even(spark):
    values = [49.35, 42.85, 77.25, 77.35, 0.05, 0.25, 100.0, 1.0, 127.95, 128.05, 128.25, 99.95, 12345.65, -3.25, 1e9]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.one_place(F.col("v")).alias("s"), T.formatted("%.1f%% of %d", F.col("v"), F.lit(3)).alias("t")).collect()
    assert [r.s for r in rows if 1 <= r.v < 16384] == [f"{v:.1f}" for v in values if 1 <= v < 16384]
    assert rows[2].t == "77.2% of 3"


def test_first_verdict_of_a_key_is_carried_over(spark):
    key = "review_type string, recommendation_index long, completion_index long, best_candidate_index long, review_id long, human_verdict string, human_notes string"
    rows_of_review = spark.createDataFrame([("matched", 1, 2, 2, 1, "", ""), ("matched", 3, 4, 4, 2, "", "")], key)
    previous = spark.createDataFrame([("matched", 1, 2, 2, 9, "REJECT", "late"), ("matched", 1, 2, 2, 5, "ACCEPT", "early"), ("matched", 1, 2, 2, 7, "", "")], key)
    got = {r.recommendation_index: (r.human_verdict, r.human_notes) for r in review.carried_over(rows_of_review, previous).collect()}
    assert got == {1: ("ACCEPT", "early"), 3: ("", "")}


def test_staging_needs_a_shared_folder_on_a_cluster(spark, tmp_path):
    from types import SimpleNamespace

    from worklens.sources import staging

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError):
        staging.shared_dir(far)
    assert staging.stage(spark.range(5), "t").count() == 5


def test_few_long_texts_reach_python_at_once(spark):
    from pyspark.sql import functions as F

    from worklens.functions import text as T

    rows = spark.createDataFrame([("plain",), ("ﬁne ①",), (None,)], "t string").select(T.normalize_text(F.col("t")).alias("n"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan  # a hundred rows at once, and not thousands
    assert [r.n for r in rows.collect()] == ["plain", "fine 1", ""]
