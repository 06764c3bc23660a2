"""The review sample: one scan, parts picked one after the other."""

import random

from worklens.config import DEFAULT
from worklens.operators import review
from worklens.sources import runs


def plain(rows, takes, keys):
    left, out = list(rows), []
    for i, (n, key) in enumerate(zip(takes, keys)):
        for turn, row in enumerate(sorted(left, key=key)[:n], 1):
            out.append((row[0], i, turn))
            left.remove(row)
    return out


def test_parts_equal_picks_one_after_the_other(spark):
    rng = random.Random(3)
    for n in (0, 2, 7, 200):
        rows = [(i, rng.choice([None, 50.0, 60.0, 70.5, 80.0]), rng.choice([None, 1.0, 2.0]), rng.choice(["a", "b", "c"])) for i in range(n)]
        frame = spark.createDataFrame(rows, "recommendation_index long, match_score double, score_margin double, tier string")
        got = review.parts_of(frame, "tier", {"a": [review.weakest(), review.strongest()], "b": [review.strongest(), review.weakest()]}, (3, 2))
        low = lambda r: tuple((x is not None, x or 0.0) for x in r[1:3]) + (r[0],)
        high = lambda r: tuple((x is None, -(x or 0.0)) for x in r[1:3]) + (r[0],)
        want = [w for tier, keys in (("a", (low, high)), ("b", (high, low))) for w in plain([r for r in rows if r[3] == tier], (3, 2), keys)]
        assert sorted((r.recommendation_index, r.part, r.turn) for r in got.collect()) == sorted(want)


def test_sample_scans_the_matches_once(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 3), ["Tier 1", "Tier 2", "Unmatched"][i % 3], float(i % 5)) for i in range(300)]
    spark.createDataFrame(rows, "recommendation_index long, match_score double, score_margin double, match_tier string, best_candidate_score double").write.parquet(str(tmp_path / "m"))
    picks = review.review_picks(spark.read.parquet(str(tmp_path / "m")), DEFAULT)
    plan = picks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("WindowGroupLimit") >= 2
    got = picks.collect()
    assert len(got) == 30 and sorted(r.review_id for r in got) == list(range(1, 31)) and len({r.recommendation_index for r in got}) == 30


def test_only_rows_within_the_cuts_are_sorted(spark, tmp_path):
    rows = [(i, [None, 50.0, 70.5][i % 3], [1.0, None][i % 2], "abc"[i % 3 % 2]) for i in range(3000)]
    spark.createDataFrame(rows, "recommendation_index long, match_score double, score_margin double, tier string").write.parquet(str(tmp_path / "m"))
    frame = spark.read.parquet(str(tmp_path / "m"))
    first = review.strata_tops(frame, "tier", {"a": [(review.weakest(), 4), (review.strongest(), 6)], "b": [(review.strongest(), 5)], "z": [(review.weakest(), 3)]})
    assert len(first.collect()) == 15
    nodes, sorted_rows = [first._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Generate":
            sorted_rows.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert sorted_rows == [15]


def test_verdicts_are_recorded_and_carried_over(spark, tmp_path, capsys):
    from worklens.__main__ import main
    from worklens.plans import pipeline

    out = str(tmp_path / "out")
    rows = [(i, "matched" if i < 4 else "unmatched", 10 * i, 20 * i, 20 * i, "Tier 1" if i < 4 else "Unmatched", "", "") for i in range(1, 7)]
    columns = "review_id long, review_type string, recommendation_index long, completion_index long, best_candidate_index long, match_tier string, human_verdict string, human_notes string"
    sheet = spark.createDataFrame(rows, columns)
    run = runs.Run(spark, out)
    run.write(sheet, "review/match_review")
    run.commit()
    (tmp_path / "first.csv").write_text("review_id,human_verdict,human_notes\n1,accept,\"seen, twice\"\n2,REJECT,\n5,skip,\n", encoding="utf-8")
    assert main(["verdicts", "--out", out, "--file", str(tmp_path / "first.csv")]) == 0
    second = spark.createDataFrame([(2, "ACCEPT", None), (6, "REJECT", "no")], "review_id int, human_verdict string, human_notes string")
    metrics = {r.metric_group: r for r in pipeline.record_verdicts(spark, out, second).collect()}
    assert (metrics["Tier 1"].accepted, metrics["Tier 1"].rejected, metrics["Unmatched review"].correctly_unmatched) == (2, 0, 1)
    kept = {r.review_id: (r.human_verdict, r.human_notes) for r in review.carried_over(sheet, pipeline.known_verdicts(spark, out)).collect()}
    assert kept == {1: ("ACCEPT", "seen, twice"), 2: ("ACCEPT", ""), 3: ("", ""), 4: ("", ""), 5: ("SKIP", ""), 6: ("REJECT", "no")}
    for wrong in ("9,ACCEPT,", "1,MAYBE,", "1,ACCEPT,\n1,REJECT,", "x,ACCEPT,"):
        (tmp_path / "wrong.csv").write_text(f"review_id,human_verdict,human_notes\n{wrong}\n", encoding="utf-8")
        assert main(["verdicts", "--out", out, "--file", str(tmp_path / "wrong.csv")]) == 1
    assert main(["check", "--out", out]) == 1 and "match_results" in capsys.readouterr().out
    assert main(["preflight", *(x for k in pipeline.INPUTS for x in (f"--{k.replace('_', '-')}", "/nowhere.csv"))]) == 1
