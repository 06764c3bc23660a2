"""Spending checks per member: vendor concentration, payments against completions, and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.config import DEFAULT, Config
from worklens.functions.similarity import share

MEMBER = ("mp_name", "constituency", "state")
GROUP = (*MEMBER, "ida")


def _amount(c: str):
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def vendor_concentration(expenditures: DataFrame) -> DataFrame:
    """Spend of each member's vendors, its share of the member's total, and the vendor's rank."""
    spend = expenditures.groupBy(*MEMBER, "vendor_name").agg(F.sum(_amount("amount_paid")).alias("vendor_spend"))
    total = F.sum("vendor_spend").over(Window.partitionBy(*MEMBER))
    rank = F.row_number().over(Window.partitionBy(*MEMBER).orderBy(F.desc("vendor_spend"), "vendor_name"))
    return spend.withColumn("mp_total_spend", total).withColumns({"vendor_share_pct": share(F.col("vendor_spend"), F.col("mp_total_spend")), "vendor_rank": rank.cast("bigint")})


def top_vendors(concentration: DataFrame) -> DataFrame:
    named = {"vendor_name": "top_vendor", "vendor_spend": "top_vendor_spend", "vendor_share_pct": "top_vendor_share_pct"}
    return concentration.filter("vendor_rank = 1").select(*MEMBER, *(F.col(a).alias(b) for a, b in named.items()))


def _null_safe(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """A join on keys of which null equals null, with one column for each key."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    joined = left.join(renamed, on, how)
    return joined.withColumns({k: F.coalesce(k, f"_{k}") for k in keys}).drop(*(f"_{k}" for k in keys)) if how == "full_outer" else joined.drop(*(f"_{k}" for k in keys))


def payment_completion_check(expenditures: DataFrame, completions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """What was paid per member and authority against the value completed there; completions without any
    payment do not appear, and groups with nothing completed are never flagged."""
    paid = expenditures.groupBy(*GROUP).agg(F.sum(_amount("amount_paid")).alias("amount_paid"))
    done = completions.groupBy(*GROUP).agg(F.sum(_amount("final_amount")).alias("completed_value"))
    both = _null_safe(paid, done, GROUP, "left").withColumn("completed_value", F.coalesce("completed_value", F.lit(0.0)))
    both = both.withColumn("payment_completion_difference", F.col("amount_paid") - F.col("completed_value"))
    both = both.withColumn("payment_completion_difference_pct", share(F.col("payment_completion_difference"), F.col("completed_value")))
    flag = (F.col("payment_completion_difference") > config.mismatch_min_abs) & (F.col("payment_completion_difference_pct") > config.mismatch_min_pct)
    return both.withColumn("payment_completion_flag", F.coalesce(flag, F.lit(False)))


def summary_reconciliation(expenditures: DataFrame, summary: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Transactions of each summary row's member against the total the summary states."""
    paid = expenditures.groupBy(*MEMBER).agg(F.sum(_amount("amount_paid")).alias("transaction_total_expenditure"))
    stated = summary.select(*MEMBER, F.col("total_expenditure").try_cast("double").alias("summary_total_expenditure"))
    both = _null_safe(stated, paid, MEMBER, "left").withColumn("transaction_total_expenditure", F.coalesce("transaction_total_expenditure", F.lit(0.0)))
    both = both.withColumn("reconciliation_difference", F.col("transaction_total_expenditure") - F.col("summary_total_expenditure"))
    both = both.withColumn("reconciliation_difference_pct", share(F.col("reconciliation_difference"), F.abs("summary_total_expenditure")))
    return both.withColumn("reconciliation_flag", F.coalesce(F.abs("reconciliation_difference_pct") > config.reconciliation_pct, F.lit(False)))


def member_indicators(expenditures: DataFrame, completions: DataFrame, summary: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row per member seen anywhere. Members without a summary have a null reconciliation_flag."""
    top = top_vendors(vendor_concentration(expenditures))
    checks = payment_completion_check(expenditures, completions, config).groupBy(*MEMBER).agg(
        F.sum("amount_paid").alias("total_paid"), F.sum("completed_value").alias("total_completed_value"),
        F.count_if("payment_completion_flag").alias("payment_mismatch_groups"), F.max("payment_completion_difference_pct").alias("max_payment_completion_difference_pct"),
    )
    reconciled = summary_reconciliation(expenditures, summary, config).drop("summary_total_expenditure")
    out = _null_safe(_null_safe(top, checks, MEMBER, "full_outer"), reconciled, MEMBER, "full_outer")
    return out.withColumns({"vendor_concentration_flag": F.coalesce("top_vendor_share_pct", F.lit(0.0)) >= config.vendor_flag_pct, "payment_completion_flag": F.coalesce("payment_mismatch_groups", F.lit(0)) > 0})
