"""Runs published as a whole."""

import pytest

from worklens.sources import runs


def published(spark, out, n, **more):
    run = runs.Run(spark, out)
    run.write(spark.range(n), "a")
    run.write(spark.range(n, 2 * n), "b/c")
    run.write_text(f"{n}", "note.txt")
    run.commit(**more)
    return run.id


def test_readers_follow_the_last_manifest(spark, tmp_path):
    out = str(tmp_path / "out")
    assert runs.current(spark, out) is None and runs.damaged(spark, out, "a") == ["a"]
    with pytest.raises(FileNotFoundError):
        runs.table(spark, out, "a")
    ids = [published(spark, out, n, size=n) for n in (3, 5)]
    stopped = runs.Run(spark, out)
    stopped.write(spark.range(9), "a")
    assert runs.current(spark, out)["run"] == ids[1] and runs.current(spark, out)["size"] == 5
    assert runs.table(spark, out, "a").count() == 5 and runs.table(spark, out, "b/c").agg({"id": "max"}).first()[0] == 9
    (tmp_path / "out" / "commits" / f"00000003-{stopped.id}.json.part").write_text("{")  # cut off before the rename
    assert runs.current(spark, out)["run"] == ids[1]
    with pytest.raises(FileNotFoundError):
        runs.location(spark, out, "d")
    with pytest.raises(ValueError):
        stopped.write(spark.range(1), "a")
    for n in range(3, 12):
        ids.append(published(spark, out, n))
    assert runs.current(spark, out)["run"] == ids[-1]  # beyond nine


def test_files_are_held_against_the_manifest(spark, tmp_path):
    out = str(tmp_path / "out")
    folder = tmp_path / "out" / "runs" / published(spark, out, 4)
    assert runs.damaged(spark, out, "a", "b/c", "note.txt", "d") == ["d"]
    next((folder / "a").glob("*.parquet")).unlink()
    (folder / "note.txt").unlink()
    assert runs.damaged(spark, out, "a", "b/c", "note.txt") == ["a", "note.txt"]


def test_earlier_runs_are_forgotten(spark, tmp_path):
    out = str(tmp_path / "out")
    ids = [published(spark, out, n) for n in (1, 2, 3)]
    stopped = runs.Run(spark, out)
    stopped.write(spark.range(1), "a")
    assert runs.forget(spark, out, keep=2) == ids[:1]
    assert {p.name for p in (tmp_path / "out" / "runs").iterdir()} == {*ids[1:], stopped.id}
    assert set(runs.forget(spark, out, 1, unfinished_hours=0)) == {ids[1], stopped.id}
    assert runs.table(spark, out, "a").count() == 3
    with pytest.raises(ValueError):
        runs.forget(spark, out, 0)
