"""Read queries over the published tables: pages, details, lists for a dashboard, and a prompt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.sources.files import numbered

#: The fields of a listed project.
PAGE_FIELDS = ("recommendation_row_id", "recommendation_work_id", "completion_work_id", "mp_name", "constituency", "state", "category", "recommended_amount", "final_amount", "match_score", "match_tier", "risk_score", "risk_level")


@dataclass(frozen=True)
class Page:
    items: DataFrame
    total: int
    page: int
    page_size: int

    @property
    def total_pages(self) -> int:
        return -(-self.total // self.page_size)


def _paged(df: DataFrame, page: int, page_size: int, order: list) -> DataFrame:
    if page < 1 or not 1 <= page_size <= 1000:
        raise ValueError("page must be at least 1 and page_size within 1 to 1000")
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def filtered(projects: DataFrame, risk_level: str | None = None, state: str | None = None, category: str | None = None) -> DataFrame:
    for c, value in (("risk_level", risk_level), ("state", state), ("category", category)):
        if value:
            projects = projects.filter(F.col(c) == value)
    return projects


def projects_items(projects: DataFrame, page: int = 1, page_size: int = 50, sort_by: str = "risk_score", order: str = "desc", **equal: str | None) -> DataFrame:
    """A page of projects, by a column in either direction (nulls last) and then by row id."""
    found = filtered(projects, **equal)
    first = [] if sort_by not in found.columns else [F.asc_nulls_last(sort_by) if order.lower() == "asc" else F.desc_nulls_last(sort_by)]
    items = _paged(found, page, page_size, [*first, "recommendation_row_id"])
    return items.select(*(c for c in PAGE_FIELDS if c in items.columns))


def projects_page(projects: DataFrame, page: int = 1, page_size: int = 50, sort_by: str = "risk_score", order: str = "desc", **equal: str | None) -> Page:
    return Page(projects_items(projects, page, page_size, sort_by, order, **equal), filtered(projects, **equal).count(), page, page_size)


POSITION = "_position"
#: Equality filters that a published table has counts for.
FILTERS = ("risk_level", "state", "category")


def publish_projects(projects: DataFrame, path: str, sort_by: str = "risk_score", order: str = "desc", group_bytes: int = 16 << 20, files_of: int = 1_000_000) -> None:
    """Write projects for reading by page and by id: ordered as :func:`projects_items` orders them, each with its position,
    so that row groups (of ``group_bytes``) hold ranges of positions; a Bloom filter of the row id in each of them; and,
    beside them, the number of projects for each combination of FILTERS. About ``files_of`` rows a file."""
    first = F.asc_nulls_last(sort_by) if order.lower() == "asc" else F.desc_nulls_last(sort_by)
    rows = numbered(projects.orderBy(first, "recommendation_row_id"), POSITION)
    n = rows.count()
    writer = rows.repartitionByRange(-(-n // files_of) or 1, POSITION).sortWithinPartitions(POSITION).write.mode("overwrite")
    bloom = {"parquet.bloom.filter.enabled#recommendation_row_id": "true", "parquet.bloom.filter.expected.ndv#recommendation_row_id": str(min(max(n, 1), files_of))}
    writer.options(**bloom, **{"parquet.block.size": str(group_bytes)}).parquet(f"{path}/rows")
    projects.groupBy(*(c for c in FILTERS if c in projects.columns)).agg(F.count(F.lit(1)).alias("projects")).write.mode("overwrite").parquet(f"{path}/counts")


@dataclass(frozen=True)
class CursorPage:
    """Items after a position; ``after``: the position to go on from, None at the end."""

    items: DataFrame
    total: int
    after: int | None


def published_page(spark: SparkSession, path: str, after: int = -1, page_size: int = 50, **equal: str | None) -> CursorPage:
    """The projects of a published table that follow a position (-1: from the start) and pass the filters. Positions are
    read in ranges, the first of one page's length and each twice as long as the one before, until the page is full, so
    the cost does not depend on how far the page lies from the start. The total comes from the stored counts."""
    if not 1 <= page_size <= 1000:
        raise ValueError("page_size must be within 1 to 1000")
    rows = filtered(spark.read.parquet(f"{path}/rows"), **equal)
    counts = spark.read.parquet(f"{path}/counts")
    whole, total = (c.agg(F.coalesce(F.sum("projects"), F.lit(0))).first()[0] for c in (counts, filtered(counts, **equal)))
    low, width, found = after, page_size, []
    while low < whole - 1 and len(found) < page_size and total:
        within = rows.filter((F.col(POSITION) > low) & (F.col(POSITION) <= low + width))
        found += [r[0] for r in within.select(POSITION).orderBy(POSITION).limit(page_size - len(found)).collect()]
        low, width = low + width, 2 * width
    last = found[-1] if found else after
    items = rows.filter((F.col(POSITION) > after) & (F.col(POSITION) <= last)).orderBy(POSITION)
    return CursorPage(items.select(*(c for c in PAGE_FIELDS if c in items.columns)), total, last if len(found) == page_size and last < whole - 1 else None)


def project_detail(projects: DataFrame, row_id: str | int) -> DataFrame:
    """The project of that row id; no rows if there is none. The id is read as the column's type, so that the comparison
    reaches the files; a text that is not what that type writes names no project."""
    kind = dict(projects.dtypes)["recommendation_row_id"]
    text = str(row_id)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        try:
            fits = str(int(text)) == text and -(1 << 63) <= int(text) < 1 << 63
        except ValueError:
            fits = False
        return projects.filter(F.col("recommendation_row_id") == int(text) if fits else F.lit(False)).limit(1)
    own = F.col("recommendation_row_id")
    return projects.filter((own if kind == "string" else own.cast("string")) == text).limit(1)


def members_items(members: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    return _paged(members, page, page_size, ["mp_name", "constituency", "state"])


def members_page(members: DataFrame, page: int = 1, page_size: int = 50) -> Page:
    return Page(members_items(members, page, page_size), members.count(), page, page_size)


def top_risky(projects: DataFrame, n: int = 10) -> DataFrame:
    """The n riskiest projects of high level, filled up with those of medium level."""
    rank = F.when(F.col("risk_level") == "HIGH", 0).otherwise(1)
    return projects.filter(F.col("risk_level").isin("HIGH", "MEDIUM")).orderBy(rank, F.desc("risk_score"), "recommendation_row_id").limit(n).select(*(c for c in PAGE_FIELDS if c in projects.columns))


def top_states(states: DataFrame, n: int = 15) -> DataFrame:
    return states.orderBy(F.desc_nulls_last("avg_risk_score"), "state").limit(n)


def split_reasons(projects: DataFrame) -> DataFrame:
    """A row per project and reason."""
    return projects.select("recommendation_row_id", F.posexplode(F.split("risk_reasons", r" \| ")).alias("place", "reason"))


FALLBACK_EXPLANATION = "No explanation could be fetched; the listed risk factors stand for themselves."


def explanation_prompt(projects: DataFrame) -> DataFrame:
    """recommendation_row_id and a prompt made only of stored fields; sending it is left to the caller."""
    shown = {"Work": "work_description", "Member": "mp_name", "State": "state", "Category": "category", "Recommended amount": "recommended_amount", "Final amount": "final_amount", "Amount difference %": "amount_difference_pct", "Days to completion": "days_to_completion", "Has images": "has_images", "Risk score": "risk_score", "Risk level": "risk_level", "Model flag": "ml_anomaly_flag", "Risk reasons": "risk_reasons"}
    lines = [F.concat(F.lit(f"- {label}: "), F.coalesce(F.col(c).cast("string"), F.lit("N/A"))) for label, c in shown.items() if c in projects.columns]
    intro = F.lit("Explain this computed risk assessment in two to four plain sentences. Use only the figures given.")
    return projects.select("recommendation_row_id", F.concat_ws("\n", intro, *lines).alias("prompt"))
