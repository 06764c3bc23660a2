"""Published projects: pages by position, lookups by id, and what they read."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from worklens.plans import serving

LEVELS = ["HIGH", "MEDIUM", "LOW"]


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    rows = spark.range(60_000).select(F.col("id").alias("recommendation_row_id"), F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("id") % 3 + 1).cast("int")).alias("risk_level"), F.when(F.col("id") % 50 > 0, (F.hash("id") % 500).cast("double")).alias("risk_score"), F.concat(F.lit("state "), F.col("id") % 7).alias("state"), F.lit("c").alias("category"), F.sha2(F.col("id").cast("string"), 512).alias("mp_name"))
    path = str(tmp_path_factory.mktemp("published"))
    serving.publish_projects(rows, path, group_bytes=100_000, files_of=20_000)
    return rows, path


def scanned(df):
    """Rows that the scan hands on."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_pages_equal_offset_paging(spark, published):
    rows, path = published
    for equal in ({}, {"risk_level": "HIGH"}, {"risk_level": "LOW", "state": "state 3"}):
        after, got = -1, []
        for _ in range(3):
            page = serving.published_page(spark, path, after, 40, **equal)
            got += [r.recommendation_row_id for r in page.items.collect()]
            after = page.after
        want = [r[0] for n in (1, 2, 3) for r in serving.projects_items(rows, n, 40, **equal).select("recommendation_row_id").collect()]
        assert got == want and page.total == serving.filtered(rows, **equal).count()
    end = serving.published_page(spark, path, 59_990, 40)
    assert end.items.count() == 9 and end.after is None
    none = serving.published_page(spark, path, risk_level="NONE")
    assert none.items.count() == 0 and none.total == 0 and none.after is None


def test_a_far_page_reads_no_more_than_the_first(spark, published):
    _, path = published
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{path}/rows/*.parquet")]
    assert len(groups) == 3 and sum(groups) > 12
    near, far = (scanned(serving.published_page(spark, path, after, 50).items) for after in (-1, 50_000))
    assert far <= 60_000 / sum(groups) * 3 and near <= 60_000 / sum(groups) * 3


def test_lookup_reaches_the_files(spark, published):
    _, path = published
    rows = spark.read.parquet(f"{path}/rows")
    found = serving.project_detail(rows, "31415")
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(recommendation_row_id), EqualTo(recommendation_row_id,31415)]" in plan
    groups = sum(pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{path}/rows/*.parquet"))
    assert [r.recommendation_row_id for r in found.collect()] == [31415]
    # ids lie anywhere in the order of scores: without the Bloom filters every group would be read
    assert scanned(rows.filter("recommendation_row_id = 31415")) <= 60_000 / groups * 3
    assert serving.project_detail(rows, 31415).count() == 1
    for other in ("x", "031415", "31415.0", "", 1 << 70, -1):
        assert serving.project_detail(rows, other).count() == 0
    texts = rows.limit(5).withColumn("recommendation_row_id", F.concat(F.lit("r"), F.col("recommendation_row_id")))
    assert serving.project_detail(texts, texts.first()[0]).count() == 1
