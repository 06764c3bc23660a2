"""The whole run: extracts in, published tables, reviews and manifest out."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.config import DEFAULT, Config
from worklens.operators import anomaly, cleaning, features, finance, linkage, reports, review, risk
from worklens.sources import files, runs

INPUTS = ("recommendations", "completions", "expenditures", "mp_summary")


class NoMatches(RuntimeError):
    """No recommendation could be linked, so nothing can be scored."""


def scored_projects(recommendations: DataFrame, completions: DataFrame, matches: DataFrame, config: Config = DEFAULT) -> DataFrame:
    rows = features.peer_features(features.project_features(recommendations, completions, matches), config)
    return risk.project_risk(anomaly.isolation_forest(anomaly.statistical_flags(rows), config=config), config)


def run_pipeline(spark: SparkSession, paths: dict[str, str], out: str, limit: int | None = None, config: Config = DEFAULT) -> dict:
    """Read the four CSV extracts (``paths`` by the names in INPUTS), publish every table under ``out`` as one run (see
    :mod:`worklens.sources.runs`), and return the summary. ``limit`` keeps the first recommendations only. Tables that
    several outputs need are written once and read again. A run that fails publishes nothing."""
    began = time.time()
    if gone := files.missing_inputs(spark, *(paths[k] for k in INPUTS)):
        raise FileNotFoundError(f"Missing input files: {', '.join(gone)}")
    raw = {k: files.read_extract(spark, paths[k], index={"recommendations": "recommendation_index", "completions": "completion_index"}.get(k), limit=limit if k == "recommendations" else None) for k in INPUTS}

    run = runs.Run(spark, out)
    kept = run.write
    tables = {k: kept(cleaning.standardised(raw[k], k), f"standard/{k}") for k in INPUTS}
    contract = {k: tables[k].select(*(c for c in cleaning.HEADERS[k].values() if c in tables[k].columns)) for k in INPUTS}
    kept(reports.dataset_summary(contract), "dataset_summary")
    kept(reports.quality_report(contract), "data_quality_report")
    rec, comp, exp = tables["recommendations"], tables["completions"], tables["expenditures"]

    matches = kept(linkage.match_records(rec, comp, config), "match_results")
    kept(reports.validate_matches(matches), "match_validation")
    sheet = review.review_rows(matches, rec, comp, config)
    if (verdicts := known_verdicts(spark, out)) is not None:
        sheet = review.carried_over(sheet, verdicts)
    sheet = kept(sheet, "review/match_review")
    run.write_text(review.review_page(sheet), "review/match_review.html")

    if matches.filter("completion_index >= 0").isEmpty():
        raise NoMatches("No accepted matches")
    projects = kept(scored_projects(rec, comp, matches, config), "project_risk_scores")
    kept(projects.filter("risk_level = 'HIGH'"), "high_risk_projects")
    kept(reports.validate_projects(projects), "project_validation")
    for name, keys in (("state", ["state"]), ("category", ["category"]), ("constituency", ["state", "constituency"])):
        kept(reports.rollup(projects, *keys), f"{name}_rollup")
    members = kept(risk.member_risk(finance.member_indicators(exp, comp, tables["mp_summary"], config), config), "mp_risk_indicators")
    kept(reports.validate_outputs(projects, members), "output_validation")

    tiers = matches.agg(F.count(F.lit(1)).alias("recommendations"), *(F.count_if(F.col("match_tier") == t).alias(n) for t, n in (("Tier 1", "tier1_matches"), ("Tier 2", "tier2_matches"), ("Unmatched", "unmatched_recommendations")))).first()
    levels = projects.agg(F.count(F.lit(1)).alias("projects"), *(F.count_if(F.col("risk_level") == v).alias(f"{v.lower()}_risk_projects") for v in ("HIGH", "MEDIUM", "LOW"))).first()
    reviews = sheet.agg(F.count(F.lit(1)).alias("review_rows"), F.count_if(F.col("match_tier") == "Tier 1").alias("tier1_review_rows"), F.count_if(F.col("match_tier") == "Tier 2").alias("tier2_review_rows"), F.count_if(F.col("review_type") == "unmatched").alias("unmatched_review_rows")).first()
    summary = tiers.asDict() | levels.asDict() | reviews.asDict() | {"members": members.count(), "runtime_seconds": round(time.time() - began, 2), "notes": "Scores are assessments for review, not findings."}
    inputs = [r.asDict() for r in files.input_manifest(spark, *(paths[k] for k in INPUTS)).collect()]
    run.write_text(files.as_json(summary), "pipeline_summary.json")
    run.commit(inputs=inputs, config=config.__dict__, summary=summary)
    return summary


OUTPUTS = ("dataset_summary", "data_quality_report", "match_results", "match_validation", "project_risk_scores", "high_risk_projects", "project_validation", "state_rollup", "category_rollup", "constituency_rollup", "mp_risk_indicators", "output_validation", "review/match_review", "pipeline_summary.json")


def missing_outputs(spark: SparkSession, out: str) -> list[str]:
    """Those of a run's outputs that the latest published run lacks, or whose files are not those it wrote."""
    return runs.damaged(spark, out, *OUTPUTS)


def _verdicts_under(out: str) -> str:
    return f"{out}/verdicts"


def known_verdicts(spark: SparkSession, out: str) -> DataFrame | None:
    """All verdicts recorded so far, of whichever runs; None where there are none."""
    under = _verdicts_under(out)
    return runs.table(spark, under, "verdicts") if runs.current(spark, under) else None


def record_verdicts(spark: SparkSession, out: str, given: DataFrame) -> DataFrame:
    """Publish a reviewer's verdicts (review_id, human_verdict, human_notes) on the latest run's review sheet where the next
    run looks for them, and return the metrics of all that is known. Earlier verdicts stay unless these replace them."""
    sheet = review.with_verdicts(runs.table(spark, out, "review/match_review"), given)
    said = sheet.filter("human_verdict <> ''")
    if (before := known_verdicts(spark, out)) is not None:
        said = said.unionByName(before.join(said.select(*review.KEY), list(review.KEY), "left_anti"), allowMissingColumns=True)
    run = runs.Run(spark, _verdicts_under(out))
    kept = run.write(said, "verdicts")
    run.commit()
    return review.review_metrics(kept)
