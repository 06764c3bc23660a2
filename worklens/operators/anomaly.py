"""Outliers: interquartile rules, threshold flags, robust scaling, and an isolation forest."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.config import DEFAULT, Config
from worklens.operators.ranks import quantiles
from worklens.sources.staging import stage

MODEL_COLUMNS = ("recommended_amount", "final_amount", "positive_amount_difference_pct", "days_to_completion", "cost_percentile", "duration_percentile", "duration_ratio_to_peer_median", "match_score", "score_margin")


def iqr_flags(df: DataFrame, columns: dict[str, str], least: int = 15) -> DataFrame:
    """A flag for each column (as columns[name]): above the third quartile by 1.5 interquartile ranges. No
    row is flagged where fewer than ``least`` values or no spread exist, or where the value is null or not a number."""
    joined = df.crossJoin(F.broadcast(quantiles(df, tuple(columns), (0.25, 0.75))))  # one row of statistics
    for c, flag in columns.items():
        low, high = F.col(f"`{c}.q`")[0], F.col(f"`{c}.q`")[1]
        fine = (F.col(f"`{c}.n`") >= least) & (high - low != 0) & (F.abs(high - low) < float("inf"))
        joined = joined.withColumn(flag, F.coalesce(fine & (F.col(c) > high + 1.5 * (high - low)) & ~F.isnan(F.col(c).cast("double")), F.lit(False)))
    return joined.drop(*(f"{c}.{x}" for c in columns for x in "nq"))


def statistical_flags(projects: DataFrame) -> DataFrame:
    """Interquartile flags of cost and duration, and the flags of high peer ranks and ratios."""
    flagged = iqr_flags(projects, {"positive_amount_difference_pct": "amount_difference_pct_iqr_flag", "days_to_completion": "days_to_completion_iqr_flag"})
    above = lambda c, t: F.coalesce(F.col(c) >= t, F.lit(False))
    return flagged.withColumns({"cost_peer_high_flag": above("cost_percentile", 95), "duration_peer_high_flag": above("duration_percentile", 95), "duration_ratio_high_flag": above("duration_ratio_to_peer_median", 2)})


def imputed(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns as doubles, infinities and nulls replaced by the column's median, or 0 without one."""
    finite = df.withColumns({c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in columns})
    joined = finite.crossJoin(F.broadcast(quantiles(finite, columns, (0.5,))))
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"`{c}.q`")[0], F.lit(0.0)) for c in columns}).drop(*(f"{c}.{x}" for c in columns for x in "nq"))


def robust_scaled(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(x - median) / interquartile range, which counts as 1 where it is 0."""
    joined = df.crossJoin(F.broadcast(quantiles(df, columns, (0.25, 0.5, 0.75))))
    q = {c: F.col(f"`{c}.q`") for c in columns}
    spread = lambda c: F.when(q[c][2] == q[c][0], 1.0).otherwise(q[c][2] - q[c][0])
    return joined.withColumns({c: (F.col(c) - q[c][1]) / spread(c) for c in columns}).drop(*(f"{c}.{x}" for c in columns for x in "nq"))


def _expected_depth(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grown_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """An isolation tree as nodes (column, cut, left, right); a leaf has column -1 and its depth as cut."""
    deepest, nodes = ceil(log2(max(2, len(x)))), [()]
    work = [(0, x, 0)]
    while work:
        at, rows, depth = work.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth >= deepest or len(rows) <= 1 or not len(open_):
            nodes[at] = (-1, depth + _expected_depth(len(rows)), 0, 0)
            continue
        c = int(rng.choice(open_))
        cut = float(rng.uniform(low[c], high[c]))
        nodes[at] = (c, cut, len(nodes), len(nodes) + 1)
        nodes += [(), ()]
        below = rows[:, c] < cut
        work += [(nodes[at][2], rows[below], depth + 1), (nodes[at][3], rows[~below], depth + 1)]
    return nodes


def _forest_scores(trees: list[list[tuple]], sample: int, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for nodes in trees:
        column, cut, left, right = (np.array(v) for v in zip(*nodes))
        at = np.zeros(len(x), np.int64)
        while (inner := column[at] >= 0).any():
            i = np.flatnonzero(inner)
            below = x[i, column[at[i]]] < cut[at[i]]
            at[i] = np.where(below, left[at[i]], right[at[i]])
        total += cut[at]
    return 2.0 ** -(total / len(trees) / _expected_depth(sample))


NODES = "tree int, node int, col int, cut double, l int, r int, drawn int"


@dataclass(frozen=True)
class Forest:
    """An isolation forest as two tables, which can be stored and read again. nodes: a row a node (``col``: the number of
    the column it cuts, -1 for a leaf, whose ``cut`` is its depth; l, r: the nodes below and not below the cut; drawn: rows
    of the tree's sample). scale: a row a column: number, name, what stands for missing values, centre and spread. Both
    are bounded: by trees and sample rows, and by columns."""

    nodes: DataFrame
    scale: DataFrame

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.scale.write.mode("overwrite").parquet(f"{path}/scale")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/scale"))


def scaling(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(col, name, fill, centre, spread) of the columns: the median of the finite values, or 0 without one, then the median
    and the interquartile range (1 where it is 0) of the filled ones."""
    numbers = df.select(*(F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).alias(c) for c in columns))
    numbers = stage(numbers, "numbers")
    fills = stage(quantiles(numbers, columns, (0.5,)).select(*(F.coalesce(F.col(f"`{c}.q`")[0], F.lit(0.0)).alias(c) for c in columns)), "fills")
    filled = numbers.crossJoin(F.broadcast(fills.select(*(F.col(c).alias(f"_fill_{c}") for c in columns)))).select(*(F.coalesce(c, f"_fill_{c}").alias(c) for c in columns))
    q = {c: F.col(f"`{c}.q`") for c in columns}
    row = quantiles(filled, columns, (0.25, 0.5, 0.75)).crossJoin(F.broadcast(fills))
    return row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("col"), F.lit(c).alias("name"), F.col(c).alias("fill"), q[c][1].alias("centre"), F.when(q[c][2] == q[c][0], 1.0).otherwise(q[c][2] - q[c][0]).alias("spread")) for i, c in enumerate(columns)))).alias("s")).select("s.*")


def _scaled(df: DataFrame, scale: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the scaled columns of a forest's scale (a row a column), in its order."""
    rows = scale.orderBy("col").collect()
    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    names = [f"_x_{r.name}" for r in rows]
    return df.withColumns({n: (F.coalesce(number(r.name), F.lit(r.fill)) - r.centre) / r.spread for n, r in zip(names, rows)}), names


def isolation(rows: DataFrame, nodes: DataFrame, features: list[str], name: str) -> DataFrame:
    """Adds the isolation score (0 to 1) of rows, whose ``features`` are the columns that the nodes count. The nodes, which
    a forest bounds, are handed to all tasks."""
    grown: dict[int, list] = {}
    size = 1
    for n in nodes.orderBy("tree", "node").collect():
        grown.setdefault(n.tree, []).append((n.col, n.cut, n.l, n.r))
        size = max(size, n.drawn)
    shared = rows.sparkSession.sparkContext.broadcast(list(grown.values()))

    @F.pandas_udf("double")
    def isolated(*cols: pd.Series) -> pd.Series:
        return pd.Series(_forest_scores(shared.value, size, np.column_stack([c.to_numpy(float) for c in cols])))

    return rows.withColumn(name, isolated(*features))


def fit_forest(projects: DataFrame, key: str = "recommendation_row_id", trees: int = 300, sample: int = 256, config: Config = DEFAULT) -> Forest:
    """Each tree grows from ``sample`` rows drawn by hashes of key, tree and seed, so results depend neither on
    order nor on partitions. The trees draw from one pool, about as large as all samples together, so that most
    rows of a large table are passed over by a single hash. Rows of one key are drawn together."""
    columns = tuple(c for c in MODEL_COLUMNS if c in projects.columns)
    n = projects.count()
    scale = stage(scaling(projects, columns), "scale")
    model, features = _scaled(projects, scale)
    # a row enters a tree's sample with a chance somewhat above sample / n: first the pool, then the tree
    chance = min(1.0, (sample + 8 * sample**0.5) / max(n, 1))
    pool = min(1.0, chance * trees)
    share = lambda *salt: F.pmod(F.xxhash64(key, *salt, F.lit(config.seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = model.select(key, *features).filter(share(F.lit("pool")) < pool)
    drawn = drawn.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: share(t) < chance / pool))).withColumn("draw", share("tree"))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", key, *features]).head(sample)
        t = int(rows["tree"].iloc[0])
        nodes = grown_tree(rows[features].to_numpy(float), np.random.default_rng([config.seed, t]))
        out = pd.DataFrame(nodes, columns=["col", "cut", "l", "r"])
        return out.assign(tree=t, node=range(len(out)), drawn=len(rows))[["tree", "node", "col", "cut", "l", "r", "drawn"]]

    return Forest(stage(drawn.groupBy("tree").applyInPandas(grow, NODES), "nodes"), scale)


def forest_flags(projects: DataFrame, forest: Forest) -> DataFrame:
    """Adds ml_anomaly_score (isolation score less 0.5) and ml_anomaly_flag (score above 0) by a forest, grown from these
    rows or others."""
    model, features = _scaled(projects, forest.scale)
    scored = isolation(model, forest.nodes, features, "ml_anomaly_score").withColumn("ml_anomaly_score", F.round(F.col("ml_anomaly_score") - 0.5, 4))
    return scored.withColumn("ml_anomaly_flag", F.col("ml_anomaly_score") > 0).drop(*features)


def isolation_forest(projects: DataFrame, key: str = "recommendation_row_id", trees: int = 300, sample: int = 256, least: int = 50, config: Config = DEFAULT) -> DataFrame:
    """The flags of a forest that the rows themselves grow, see :func:`fit_forest`. Fewer than ``least`` rows: score 0, no
    flag. Rows of one key are scored one by one."""
    projects = stage(projects, "projects")  # read for the statistics, the samples and the scores
    if projects.count() < least or not any(c in projects.columns for c in MODEL_COLUMNS):
        return projects.withColumns({"ml_anomaly_score": F.lit(0.0), "ml_anomaly_flag": F.lit(False)})
    return forest_flags(projects, fit_forest(projects, key, trees, sample, config))
