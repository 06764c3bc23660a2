"""Risk indicators: points by rule, with the reasons. They are assessments for review, not findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.config import DEFAULT, Config
from worklens.functions import text as T


def _number(df: DataFrame, c: str) -> Column:
    """The column as a number, 0 where it is missing, null or not finite."""
    if c not in df.columns:
        return F.lit(0.0)
    x = F.col(c).cast("double")
    return F.when(F.abs(x) < float("inf"), x).otherwise(0.0)


def _true(df: DataFrame, c: str, unknown: bool = False) -> Column:
    return F.coalesce(F.col(c).cast("boolean"), F.lit(unknown)) if c in df.columns else F.lit(False)


def _level(score: Column, config: Config) -> Column:
    return F.when(score >= config.high_risk, "HIGH").when(score >= config.medium_risk, "MEDIUM").otherwise("LOW")


def _told(rules: list[tuple[Column, float, Column]], none: str, more: Column | None = None) -> tuple[Column, Column]:
    """Points of the rules that hold, and their reasons joined."""
    points = reduce(lambda a, b: a + b, (F.when(c, float(p)).otherwise(0.0) for c, p, _ in rules))
    reasons = F.concat_ws(" | ", *(F.when(c, r) for c, _, r in rules), *([more] if more is not None else []))
    return points, F.when(reasons == "", none).otherwise(reasons)


def project_risk(projects: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds risk_score (0-100, two places), risk_level (by the unrounded score), risk_reasons and
    risk_is_assessment."""
    n = {c: _number(projects, c) for c in ("positive_amount_difference_pct", "days_to_completion", "cost_percentile", "duration_percentile", "duration_ratio_to_peer_median")}
    over, days = n["positive_amount_difference_pct"], n["days_to_completion"]
    above, long_ = T.formatted("Final amount is %.1f%% above recommended amount", over), T.formatted("Long recommendation-to-completion timeline (%.0f days)", days)
    images = F.coalesce(F.col("has_images").cast("boolean") == F.lit(False), F.lit(False)) if "has_images" in projects.columns else F.lit(False)
    # fixed values: limits, points and wording of the reasons
    rules = [
        (over >= 50, 18, above),
        ((over >= 25) & (over < 50), 10, above),
        (_true(projects, "amount_difference_pct_iqr_flag"), 8, F.lit("Positive cost deviation is an upper-IQR outlier")),
        (n["cost_percentile"] >= 95, 12, T.formatted("Cost deviation is at about the %.0fth peer percentile", n["cost_percentile"])),
        (days >= 540, 14, long_),
        ((days >= 360) & (days < 540), 8, long_),
        (_true(projects, "days_to_completion_iqr_flag"), 7, F.lit("Completion duration is an upper-IQR outlier")),
        (n["duration_percentile"] >= 95, 10, T.formatted("Duration is at about the %.0fth peer percentile", n["duration_percentile"])),
        (n["duration_ratio_to_peer_median"] >= 2, 8, T.formatted("Duration is about %.1fx the peer median", n["duration_ratio_to_peer_median"])),
        (_true(projects, "ml_anomaly_flag"), 15, F.lit("Isolation Forest detected an unusual multi-feature profile")),
        (images, 12, F.lit("Completed work has no photographic proof of completion")),
    ]
    tier = F.coalesce("match_tier", F.lit("Unmatched")) if "match_tier" in projects.columns else F.lit("Unmatched")
    note = F.when(tier == "Tier 2", "Project evidence comes from a provisional Tier 2 linkage").when(tier == "Unmatched", "Project linkage is not verified")
    points, reasons = _told(rules, "No strong project-level anomaly indicators triggered", note)
    score = F.least(F.lit(100.0), points * F.when(tier == "Tier 2", 0.85).when(tier == "Unmatched", 0.60).otherwise(1.0))
    return projects.withColumns({"risk_score": F.round(score, 2), "risk_level": _level(score, config), "risk_reasons": reasons, "risk_is_assessment": F.lit(True)})


def member_risk(members: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds mp_risk_score, mp_risk_level, mp_risk_reasons and risk_is_assessment. An unknown reconciliation
    counts as a difference."""
    share, groups, most = (_number(members, c) for c in ("top_vendor_share_pct", "payment_mismatch_groups", "max_payment_completion_difference_pct"))
    told = T.formatted("Top vendor receives %.1f%% of recorded expenditure", share)
    # fixed values: points and wording of the reasons
    rules = [
        (share >= config.vendor_high_pct, 35, told),
        ((share >= config.vendor_flag_pct) & (share < config.vendor_high_pct), 20, told),
        (groups > 0, 30, T.formatted("%d MP/IDA payment-completion mismatch group(s)", groups.cast("bigint"))),
        (most >= 50, 25, T.formatted("Maximum payment-completion difference is %.1f%%", most)),
        (_true(members, "reconciliation_flag", unknown=True), 10, F.lit("Transaction total differs materially from MP-summary expenditure")),
    ]
    points, reasons = _told(rules, "No strong MP-level financial indicator triggered")
    score = F.least(F.lit(100.0), points)
    return members.withColumns({"mp_risk_score": F.round(score, 2), "mp_risk_level": _level(score, config), "mp_risk_reasons": reasons, "risk_is_assessment": F.lit(True)})
