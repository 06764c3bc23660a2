"""CSV records in byte ranges, row numbers in file order."""

import random

import pytest

from worklens.functions.text import NA_TOKENS
from worklens.sources import files


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def made(rng, rows, end):
    def cell():
        text = "".join(rng.choices(["a", "b", '"', "\n", "\r\n" if end == "\r\n" else "\n", ",", " ", "é", "NA"], k=rng.randint(0, 14)))
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in '"\n,\r') or rng.random() < 0.2 else text

    return end.join(["id,a b, Amount (₹)"] + [f"{i},{cell()},{cell()}" for i in range(rows)]) + end


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n")])
def test_equal_to_the_reader_of_whole_files(small_ranges, tmp_path, seed, end):
    spark = small_ranges
    path = tmp_path / "x.csv"
    path.write_bytes((made(random.Random(seed), 60, end) + end).encode())
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path))
    want = [[None if v in NA_TOKENS else v for v in r] for r in whole.collect()]
    assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 5
    got = files.read_extract(spark, str(path), index="n").orderBy("n")
    assert got.columns == [*whole.columns, "n"]
    assert [list(r) for r in got.collect()] == [[*r, i] for i, r in enumerate(want)] and len(want) == 60


@pytest.mark.parametrize("line_breaks", [True, False])
def test_numbers_follow_file_names_and_places(small_ranges, tmp_path, line_breaks):
    spark = small_ranges
    for name, rows in (("a", 3), ("b", 120), ("c", 0), ("d", 1)):
        (tmp_path / f"{name}.csv").write_text("key,place\n" + "".join(f"{name}{i},{i}\n" for i in range(rows)))
    want = [f"{name}{i}" for name, rows in (("a", 3), ("b", 120), ("d", 1)) for i in range(rows)]
    got = files.read_extract(spark, str(tmp_path), line_breaks, "n").orderBy("n").collect()
    assert [r.key for r in got] == want and [r.n for r in got] == list(range(len(want)))
    few = files.read_extract(spark, str(tmp_path), line_breaks, limit=5)
    assert few.columns == ["key", "place"] and sorted(r.key for r in few.collect()) == sorted(want[:5])
    assert sorted(r.key for r in files.read_extract(spark, str(tmp_path), line_breaks).collect()) == sorted(want)
    with pytest.raises(ValueError):
        files.read_extract(spark, str(tmp_path), line_breaks, "n", 0)


def test_one_record_over_many_ranges(small_ranges, tmp_path):
    text = "line of some length\n" * 40
    (tmp_path / "x.csv").write_text(f'a,b\n1,"{text}"\n2,end\n')
    got = files.read_extract(small_ranges, str(tmp_path / "x.csv"), index="n").orderBy("n").collect()
    assert [tuple(r) for r in got] == [("1", text, 0), ("2", "end", 1)]


def test_digests_of_large_files_take_turns(spark, tmp_path, monkeypatch):
    import hashlib

    from worklens.sources import digests

    rng, before = random.Random(5), spark.conf.get("spark.sql.files.maxPartitionBytes")
    contents = {"a.parquet": rng.randbytes(300_000), "b.csv": b"\xef\xbb\xbfx,y\n" * 20_000, "c": b"\n\n" + b"\r\n\x00" * 9_000, "d": b"z" * 5_000, "e": b"small\n"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    want = {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    monkeypatch.setattr(files, "WHOLE", 1_000)
    monkeypatch.setattr(digests, "ROUND", 40_000)
    monkeypatch.setattr(digests, "PIECE", 700)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for library in (digests._library, lambda: None):
            monkeypatch.setattr(digests, "_library", library)
            assert {r.file: (r.bytes, r.sha256) for r in files.input_manifest(spark, str(tmp_path)).collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
