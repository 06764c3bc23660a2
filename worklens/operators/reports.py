"""Rollups, data-quality reports and validations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _measures() -> list[Column]:
    return [
        F.count("recommendation_row_id").alias("projects"), F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_projects"), F.count_if(F.col("risk_level") == "MEDIUM").alias("medium_risk_projects"),
        F.avg("risk_score").alias("avg_risk_score"), F.avg("amount_difference_pct").alias("avg_cost_difference_pct"), F.avg("days_to_completion").alias("avg_days_to_completion"),
    ]


def rollup(projects: DataFrame, *keys: str) -> DataFrame:
    """Counts and means per key, highest mean risk first."""
    return projects.groupBy(*keys).agg(*_measures()).orderBy(F.desc_nulls_last("avg_risk_score"), *keys)


def rollup_sets(projects: DataFrame) -> DataFrame:
    """The rollups by state, by category, and by state and constituency, in one pass; ``level`` names them."""
    sets = projects.groupingSets([["state"], ["category"], ["state", "constituency"]], "state", "category", "constituency")
    level = F.when(F.grouping("category") == 0, "category").when(F.grouping("constituency") == 0, "constituency").otherwise("state")
    return sets.agg(level.alias("level"), *_measures())


#: Bytes of a value beyond which its SHA-256 stands for it where values are counted.
LONG = 32


def _canonical(column: str, kind: str) -> Column:
    """A value as text, equal for equal values."""
    c = F.col(f"`{column}`")
    if kind in ("double", "float"):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)  # both zeros are one value
    if kind == "binary":
        return F.hex(c)
    return F.when(c.isNotNull(), F.to_json(F.struct(c))) if kind.startswith(("array", "struct", "map")) else c.cast("string")


def _short(value: Column) -> Column:
    return F.when(F.octet_length(value) > LONG, F.concat(F.lit("#"), F.sha2(value, 256))).otherwise(F.concat(F.lit("="), value))


def _counted(df: DataFrame, columns: list[tuple[str, str]], rows: bool) -> DataFrame:
    """(place, n, missing, blank, distinct) of each column, by its place, and of whole rows as place -1.

    Every row gives a pair of place and value for each column. Tasks add up equal pairs before these move, so a frequent
    value costs a pair a task; the pairs are counted by value and then by column."""
    values = {c: _canonical(c, kind) for c, kind in columns}
    blank = lambda c, kind: (F.trim(F.col(f"`{c}`")) == "") if kind == "string" else F.lit(False)
    pairs = [F.struct(F.lit(i).alias("place"), _short(values[c]).alias("value"), F.coalesce(blank(c, kind), F.lit(False)).alias("blank")) for i, (c, kind) in enumerate(columns)]
    if rows:
        whole = F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for c, kind in df.dtypes for v in [_canonical(c, kind)]))
        pairs.append(F.struct(F.lit(-1).alias("place"), F.sha2(whole, 256).alias("value"), F.lit(False).alias("blank")))
    met = df.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.place", "p.value").agg(F.count(F.lit(1)).alias("n"), F.bool_or("p.blank").alias("blank"))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return met.groupBy("place").agg(F.sum("n").alias("n"), total(F.col("value").isNull()).alias("missing"), total(F.col("blank")).alias("blank"), F.count(F.lit(1)).alias("distinct"))


def dataset_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """dataset, rows, columns and duplicate_rows (rows that repeat an earlier one)."""
    parts = []
    for name, df in frames.items():
        n, distinct = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))
        parts.append(_counted(df, [], True).agg(n.alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"), (n - distinct).alias("duplicate_rows")).select(F.lit(name).alias("dataset"), "rows", "columns", "duplicate_rows"))
    return reduce(DataFrame.unionByName, parts)


def quality_report(frames: dict[str, DataFrame]) -> DataFrame:
    """A row per dataset and column: missing, blank_strings, missing_pct (three places), unique_values (null
    counts as one), dtype, and the dataset's rows, columns and duplicate rows. One pass over each dataset."""
    parts = []
    for name, df in frames.items():
        columns = df.dtypes
        found = _counted(df, columns, True).agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("n", "missing", "blank", "distinct")))).alias("of"))  # a row a column
        whole = F.col("of")[F.lit(-1)]
        zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
        rows = [F.struct(F.lit(c).alias("column"), F.lit(kind).alias("dtype"), *(zero(F.col("of")[F.lit(i)][field]).alias(out) for field, out in (("missing", "missing"), ("blank", "blank_strings"), ("distinct", "unique_values")))) for i, (c, kind) in enumerate(columns)]
        long = found.select(zero(whole["n"]).alias("rows"), zero(whole["n"] - whole["distinct"]).alias("duplicate_rows_in_dataset"), F.explode(F.array(*rows)).alias("s"))
        long = long.select(F.lit(name).alias("dataset"), "rows", F.lit(len(columns)).cast("bigint").alias("columns"), "s.*", "duplicate_rows_in_dataset")
        parts.append(long.withColumn("missing_pct", F.when(F.col("rows") > 0, F.round(F.col("missing") / F.col("rows") * 100, 3)).otherwise(0.0)))
    return reduce(DataFrame.unionByName, parts)


def _checked(df: DataFrame, checks: list[tuple[str, Column, str]]) -> DataFrame:
    """check, passed, detail; a check without rows to fail it passes."""
    wide = df.agg(*(F.coalesce(c, F.lit(True)).alias(f"c{i}") for i, (_, c, _) in enumerate(checks)))
    rows = F.array(*(F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("passed"), F.lit(detail).alias("detail")) for i, (name, _, detail) in enumerate(checks)))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def _all(condition: Column) -> Column:
    """Whether it holds in all rows; null counts as not holding."""
    return F.bool_and(F.coalesce(condition, F.lit(False)))


def validate_matches(matches: DataFrame) -> DataFrame:
    taken = F.when(F.col("completion_index") >= 0, F.col("completion_index"))
    return _checked(matches, [
        ("accepted match scores in range", _all(F.col("match_score").between(0, 100)), "every score lies within 0 to 100"),
        ("valid tiers", _all(F.col("match_tier").isin("Tier 1", "Tier 2", "Unmatched")), "every tier is Tier 1, Tier 2 or Unmatched"),
        ("no duplicate completion assignments", F.count(taken) == F.count_distinct(taken), "no completion is taken twice"),
        ("unmatched rows have nonpositive completion index", _all((F.col("match_tier") != "Unmatched") | (F.col("completion_index") < 0)), "an unmatched row names no completion"),
    ])


def validate_projects(projects: DataFrame) -> DataFrame:
    id_ = F.col("recommendation_row_id")
    amounts = (F.coalesce("recommended_amount", F.lit(0.0)) >= 0) & (F.coalesce("final_amount", F.lit(0.0)) >= 0)
    return _checked(projects, [
        ("risk score range", _all(F.col("risk_score").between(0, 100)), "every risk score lies within 0 to 100"),
        ("valid risk levels", _all(F.col("risk_level").isin("LOW", "MEDIUM", "HIGH")), "every level is LOW, MEDIUM or HIGH"),
        ("unique recommendation rows", F.count(id_) == F.count_distinct(id_), "no recommendation has two rows"),
        ("non-negative financial values", _all(amounts), "no amount is below zero"),
        ("no large negative durations", _all(F.coalesce(F.col("days_to_completion") >= -30, F.lit(True))), "no completion precedes its recommendation by more than 30 days"),
    ])


def validate_outputs(projects: DataFrame, members: DataFrame) -> DataFrame:
    """Whether both outputs have rows."""
    some = lambda df, name, detail: _checked(df, [(name, F.count(F.lit(1)) > 0, detail)])
    return some(projects, "project output nonempty", "there are projects to score").unionByName(some(members, "MP output nonempty", "there are members with indicators"))
