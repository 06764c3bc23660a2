"""Features of linked projects and of their peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.config import DEFAULT, Config
from worklens.functions.similarity import days_between, share
from worklens.operators.ranks import melted, null_safe_left, quantile, value_ranks
from worklens.sources.staging import stage


def project_features(recommendations: DataFrame, completions: DataFrame, matches: DataFrame) -> DataFrame:
    """A row per accepted match: both sides' fields, cost difference and duration."""
    kept = matches.filter("completion_index >= 0").select("recommendation_index", "completion_index", "match_score", "match_tier", "match_confidence", "score_margin", "match_reason")
    col = lambda df, c: F.col(c) if c in df.columns else F.lit("")
    rec = recommendations.select("recommendation_index", col(recommendations, "work_id").alias("recommendation_work_id"), *(col(recommendations, c).alias(c) for c in ("mp_name", "constituency", "state", "category", "ida", "work_description")), "recommended_amount", "recommendation_date")
    images = F.col("has_images") if "has_images" in completions.columns else F.lit(None).cast("boolean")
    comp = completions.select("completion_index", col(completions, "work_id").alias("completion_work_id"), "final_amount", F.col("completed_date").alias("completion_date"), images.alias("has_images"))
    rows = kept.join(rec, "recommendation_index").join(comp, "completion_index").withColumnsRenamed({"recommendation_index": "recommendation_row_id", "completion_index": "completion_row_id"})
    difference = F.col("final_amount") - F.col("recommended_amount")
    return rows.withColumns({"amount_difference": difference, "amount_difference_pct": share(difference, F.col("recommended_amount")), "days_to_completion": days_between(F.col("recommendation_date"), F.col("completion_date"))})


def peer_features(projects: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Statistics of a project's peers (same state and category, or the whole category where those are too
    few) and its percentile among the projects labelled with the same peer group."""
    over = F.col("amount_difference_pct")
    days = F.col("days_to_completion").cast("double")
    rows = projects.withColumns({"positive_amount_difference_pct": F.when(over.isNotNull(), F.greatest(over, F.lit(0.0))), "days_to_completion": days})
    rows = stage(rows, "rows")
    near = {"state": F.col("state"), "category": F.col("category")}
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    sizes = rows.groupBy(*near).agg((F.count("recommendation_row_id") >= config.peer_group).alias("_enough"))
    sizes = sizes.withColumn("peer_group", F.when(F.col("_enough"), F.concat(name("state"), F.lit(" | "), name("category"))).otherwise(name("category")))
    # where a label is that of one group of near peers, ranks among these are those among the labelled; statistics of a
    # whole category are needed where one of its groups is too small
    alone = F.col("_enough") & (F.count(F.lit(1)).over(Window.partitionBy("peer_group")) == 1)
    sizes = sizes.withColumns({"_alone": alone, "_wide": ~F.bool_and("_enough").over(Window.partitionBy("category"))})
    rows = null_safe_left(rows, sizes, near)
    # ranks of both values among the near peers, the wide peers and the labelled group, counted in one pass
    values = {"positive_amount_difference_pct": ("cost_peer", "cost_percentile"), "days_to_completion": ("duration_peer", "duration_percentile")}
    text, none = lambda c: F.col(c).cast("string"), F.lit(None).cast("string")
    sets = {"near": (F.col("_enough"), text("state"), text("category")), "wide": (F.col("_wide"), none, text("category")), "label": (~F.col("_alone"), none, F.col("peer_group"))}
    levels = F.filter(F.array(*(F.when(need, F.struct(F.lit(k).alias("level"), a.alias("a"), b.alias("b"))) for k, (need, a, b) in sets.items())), lambda x: x.isNotNull())
    long = melted(rows.select(*values, F.explode(levels).alias("_level")), tuple(values), F.col("_level")).select("_level.*", "column", "value")
    ranked = stage(value_ranks(long, ["level", "a", "b", "column"], "value"), "peer-ranks")
    points = (("median", 0.5), ("p75", 0.75), ("p95", 0.95))
    stats = ranked.filter("level <> 'label'").groupBy("level", "a", "b").agg(*(quantile(F.col("column") == c, q).alias(f"{prefix}_{suffix}") for c, (prefix, _) in values.items() for suffix, q in points))
    # a row looks up the one group that counts for it
    mine = {"level": F.when(F.col("_enough"), "near").otherwise("wide"), "a": F.when(F.col("_enough"), text("state")), "b": text("category")}
    rows = null_safe_left(rows, stats, mine)
    ratio = lambda c, prefix: F.when(F.col(f"{prefix}_median") > 0, F.col(c) / F.col(f"{prefix}_median"))
    rows = rows.withColumns({"duration_ratio_to_peer_median": ratio("days_to_completion", "duration_peer"), "cost_ratio_to_peer_median": ratio("positive_amount_difference_pct", "cost_peer")})
    own = {"level": F.when(F.col("_alone"), "near").otherwise("label"), "a": F.when(F.col("_alone"), text("state")), "b": F.when(F.col("_alone"), text("category")).otherwise(F.col("peer_group"))}
    for c, (_, out) in values.items():
        mean_rank = F.col("before") + (F.col("n") + 1) / 2.0
        place = ranked.filter((F.col("level") != "wide") & (F.col("column") == c)).select("level", "a", "b", "value", (mean_rank / F.col("total") * 100).alias(out))
        rows = null_safe_left(rows, place, own | {"value": F.col(c)})
    return rows.drop("_enough", "_alone", "_wide")
