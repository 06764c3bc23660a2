"""A run's outputs, published as a whole.

Every run writes to a folder of its own, ``out/runs/<id>``; its tables count from the moment its manifest lies under
``out/commits``, which is written last and put in place by one rename. Readers follow the latest manifest, so they see
all of a run or nothing of it: a run that stops between two tables, or is stopped, leaves the one before as it was.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from worklens.sources.files import as_json, missing_inputs, write_table, write_text


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _system(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """Name and time of change, in seconds, of what lies in a folder; nothing where there is no folder."""
    if missing_inputs(spark, folder):
        return []
    return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in _system(spark, folder).listStatus(_path(spark, folder))]


def _size(spark: SparkSession, name: str) -> dict[str, int]:
    found = _system(spark, name).getContentSummary(_path(spark, name))
    return {"files": found.getFileCount(), "bytes": found.getLength()}


def _commits(spark: SparkSession, out: str) -> list[str]:
    """Names of the manifests, latest first."""
    return sorted((n for n, _ in _listed(spark, f"{out}/commits") if n.endswith(".json")), reverse=True)


class Run:
    """A run in the making: ``write`` its tables and texts, then ``commit``."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out, self.id = spark, out.rstrip("/"), uuid.uuid4().hex
        self.names: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.out}/runs/{self.id}/{name}"

    def _named(self, name: str) -> str:
        if name in self.names:
            raise ValueError(f"{name} is written already")
        self.names.append(name)
        return self.path(name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table, once, and read it back."""
        path = self._named(name)
        write_table(df, path)
        return self.spark.read.parquet(path)

    def write_text(self, text: str, name: str) -> None:
        write_text(self.spark, text, self._named(name))

    def commit(self, **more) -> dict:
        """Publish what is written; the manifest lists the files and bytes of each output, and ``more``."""
        outputs = {name: _size(self.spark, self.path(name)) for name in self.names}
        manifest = {"run": self.id, "committed_at": round(time.time(), 3), "outputs": outputs} | more
        latest = next(iter(_commits(self.spark, self.out)), "0-")
        name = f"{self.out}/commits/{int(latest.split('-')[0]) + 1:08d}-{self.id}.json"
        write_text(self.spark, as_json(manifest), f"{name}.part")
        if not _system(self.spark, name).rename(_path(self.spark, f"{name}.part"), _path(self.spark, name)):
            raise OSError(f"could not put {name} in place")
        return manifest


def current(spark: SparkSession, out: str) -> dict | None:
    """The manifest of the latest published run; None where there is none."""
    for name in _commits(spark, out):
        return json.loads(spark.read.text(f"{out}/commits/{name}", wholetext=True).first()[0])
    return None


def location(spark: SparkSession, out: str, name: str) -> str:
    """Where an output of the latest published run lies."""
    found = current(spark, out)
    if not found or name not in found["outputs"]:
        raise FileNotFoundError(f"No published {name} under {out}")
    return f"{out}/runs/{found['run']}/{name}"


def table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the latest published run."""
    return spark.read.parquet(location(spark, out, name))


def damaged(spark: SparkSession, out: str, *names: str) -> list[str]:
    """Those of the names that the latest published run lacks, or whose files are not those of its manifest."""
    found = current(spark, out) or {"run": "", "outputs": {}}
    there = lambda n: f"{out}/runs/{found['run']}/{n}"
    listed = [n for n in names if n in found["outputs"]]
    gone = set(missing_inputs(spark, *map(there, listed)))
    whole = {n for n in listed if there(n) not in gone and _size(spark, there(n)) == found["outputs"][n]}
    return [n for n in names if n not in whole]


def forget(spark: SparkSession, out: str, keep: int = 2, unfinished_hours: float = 48) -> list[str]:
    """Delete all published runs but the latest ``keep`` (at least 1), each manifest before its tables, and runs without a
    manifest whose folder has not changed for a time. Gives the ids of what is deleted."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    began = {n: at for n, at in _listed(spark, f"{out}/runs")}
    commits = _commits(spark, out)
    owner = lambda n: n.removesuffix(".json").split("-", 1)[1]
    old = {owner(n): n for n in commits[keep:]}
    known = {owner(n) for n in commits}
    dead = [i for i, at in began.items() if i not in known and at < time.time() - unfinished_hours * 3600]
    for name in [*(f"{out}/commits/{n}" for n in old.values()), *(f"{out}/runs/{i}" for i in [*old, *dead])]:
        _system(spark, name).delete(_path(spark, name), True)
    return [*old, *dead]
