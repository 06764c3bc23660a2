"""Profiles of datasets: exact counts without an expansion of the rows for each column."""

from pyspark.sql import functions as F

from worklens.operators import reports


def test_counts_of_hard_values(spark):
    nan, long = float("nan"), "x" * 100
    rows = [(1, 0.0, "a", b"1", [1]), (1, -0.0, "a ", b"1", [1]), (2, nan, " ", None, None), (2, nan, "", b"", []), (None, None, None, b"1", [1, 2]), (1, 0.0, long + "y", b"2", [1]), (1, 0.0, long + "z", b"2", [1]), (1, -0.0, "a", b"1", [1])]
    frame = spark.createDataFrame(rows, "i int, d double, t string, b binary, `l.x` array<int>")
    got = {r.column: (r.missing, r.blank_strings, r.unique_values, r.rows, r.duplicate_rows_in_dataset) for r in reports.quality_report({"d": frame}).collect()}
    assert got == {"i": (1, 0, 3, 8, 1), "d": (1, 0, 3, 8, 1), "t": (1, 2, 7, 8, 1), "b": (1, 0, 4, 8, 1), "l.x": (1, 0, 4, 8, 1)}
    assert tuple(reports.dataset_summary({"d": frame}).first()) == ("d", 8, 5, 1)
    nothing = {r.column: (r.rows, r.missing, r.unique_values, r.missing_pct, r.duplicate_rows_in_dataset) for r in reports.quality_report({"d": frame.limit(0)}).collect()}
    assert len(nothing) == 5 and set(nothing.values()) == {(0, 0, 0, 0.0, 0)}
    assert tuple(reports.dataset_summary({"d": frame.limit(0)}).first()) == ("d", 0, 5, 0)


def test_one_pass_without_expand_and_without_hot_tasks(spark):
    frame = spark.range(40_000, numPartitions=4).select("id", F.lit("same").alias("hot"), (F.col("id") % 100).alias("few"))
    report = reports.quality_report({"d": frame})
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Range (") == 1
    assert {r.column: r.unique_values for r in report.collect()} == {"id": 40_000, "hot": 1, "few": 100}
    # what moves for the hot column is a pair a task
    pairs = reports._counted(frame.select("hot"), [("hot", "string")], False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = pairs.select("*")
        pairs.collect()
        node, moved = pairs._jdf.queryExecution().executedPlan(), []
        todo = [node]
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange":
                moved.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert moved and max(moved) <= 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
