"""Reading and writing extracts, and the record of a run's inputs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions.text import NA_TOKENS
from worklens.sources import digests
from worklens.sources.staging import stage


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, text) of the CSV records of the files at a path: their number in the file from 0, the header
    included, and their text with the line breaks inside quotes.

    Files are split at byte ranges like any text. A range does not know whether it begins inside quotes, so its lines are
    numbered for either case; the quotes of the ranges before, odd or even, then tell which case it is, and how many
    records came before. A record of several lines, in one range or in many, is put together by its number; others
    stay where they are. Files are UTF-8; lines end in LF, or in CRLF if the
    first one does, which then is LF inside fields; quotes are only used as quotes (a quote inside a
    field is doubled), blank lines are no records."""
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("odd", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2)
    so_far = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("inside", (F.sum("odd").over(so_far) - F.col("odd")) % 2)
    blank = F.col("value").isin("", "\r")
    begins = {f"begun_{b}": F.sum(((F.col("inside") == b) & ~blank).cast("int")).over(so_far) for b in (0, 1)}
    lines = stage(lines.withColumns(begins), "lines")
    ranges = lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd"), F.max("begun_0").alias("begun_0"), F.max("begun_1").alias("begun_1"), F.min_by(F.endswith("value", F.lit("\r")), "at").alias("crlf"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("start", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    ranges = ranges.withColumn("past", F.coalesce(F.sum(F.when(F.col("start") == 1, F.col("begun_1")).otherwise(F.col("begun_0"))).over(before), F.lit(0)))
    ranges = ranges.withColumn("crlf", F.first("crlf").over(Window.partitionBy("file").orderBy("block")))
    lines = lines.join(ranges.select("file", "block", "start", "past", "crlf"), ["file", "block"])
    lines = lines.withColumn("value", F.when(F.col("crlf"), F.regexp_replace("value", r"\r$", "")).otherwise(F.col("value")))
    own = F.when(F.col("start") == 1, F.col("begun_1")).otherwise(F.col("begun_0"))
    lines = lines.withColumns({"number": F.col("past") + own - 1, "within": F.col("inside") != F.col("start")}).filter(F.col("within") | ~blank)
    single = ~F.col("within") & (F.col("odd") == 0)
    whole = lines.filter(single).select("file", "number", F.col("value").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    joined = lines.filter(~single).groupBy("file", "number").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("text"))
    return whole.union(joined)


def _without_na(df: DataFrame, *also: str) -> DataFrame:
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns if c not in also), *also)


def read_extract(spark: SparkSession, path: str, line_breaks: bool = True, index: str | None = None, limit: int | None = None) -> DataFrame:
    """A CSV extract with a header, all columns as text, missing-value spellings as null; ``path``: a file, or a folder of
    files with equal headers. ``index``: name of a column for the row number from 0, by file name and order in the file;
    ``limit``: only the first rows (at least 1). Large files are split among tasks, see :func:`records`; without
    ``line_breaks`` by the plain reader, whose fields end with the line."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    plain = spark.read.option("header", True).option("escape", '"')
    if line_breaks:
        names = plain.option("multiLine", True).csv(path).columns
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
        rows = records(spark, path)
        fields = F.from_csv("text", F.lit(schema), {"escape": '"'})
        rows = rows.filter("number > 0").select(F.col("file").alias("_file"), (F.col("number") - 1).alias("_number"), fields.alias("_fields")).select("_file", "_number", "_fields.*")
        if not (index or limit):
            return _without_na(rows.drop("_file", "_number"))
        rows = stage(rows, "records")
        sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("rows"))
        return _first(_without_na(_placed(rows, sizes, ["_file"], F.col("_number"), index or "_index"), index or "_index"), index, limit)
    if not (index or limit):
        return _without_na(plain.csv(path))
    own = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}
    rows = stage(plain.csv(path).select("*", *(c.alias(n) for n, c in own.items())), "numbered")
    sizes = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("rows"), F.min("_at").alias("_first"))  # a range's ids follow each other
    return _first(_without_na(_placed(rows, sizes, ["_file", "_block"], F.col("_at") - F.col("_first"), index or "_index"), index or "_index"), index, limit)


def _placed(rows: DataFrame, sizes: DataFrame, keys: list[str], place: Column, index: str) -> DataFrame:
    """Adds the place among all rows, given that within the part that the keys name; sizes: a row a part."""
    starts = sizes.withColumn("_start", F.sum("rows").over(Window.orderBy(*keys)) - F.col("rows")).drop("rows")
    return rows.join(starts, keys).withColumn(index, F.col("_start") + place).drop(*keys, "_start", "_number", "_at", "_first")


def _first(rows: DataFrame, index: str | None, limit: int | None) -> DataFrame:
    if limit is not None:
        rows = rows.filter(F.col(index or "_index") < limit)
    return rows if index else rows.drop("_index")


def numbered(df: DataFrame, index: str, limit: int | None = None) -> DataFrame:
    """Adds the row number from 0 in the order of the frame's partitions, which for files is not that of their names (see
    :func:`read_extract`); only the first ``limit`` rows, if given (at least 1)."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    rows = stage(df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), F.min("_at").alias("_first"))
    return _first(_placed(rows, sizes, ["_part"], F.col("_at") - F.col("_first"), index).select(*df.columns, index), index, limit)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write as Parquet, or as CSV with a header (white space at the ends of fields kept), replacing what is there."""
    writer = df.write.mode("overwrite")
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (writer.options(**kept).csv(path) if form == "csv" else writer.parquet(path))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file with a bounded text (a page, a manifest), through Spark's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


#: Bytes of the largest file that is digested as one row, and endings of files that Spark's readers would decompress.
WHOLE, COMPRESSED = 128 << 20, r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd|xz)$"


def input_manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """file, bytes and sha256 of every file under the paths. The content of a file of up to WHOLE bytes, or a compressed
    one, passes through one row; larger ones are read in ranges."""
    every = lambda *some: spark.read.format("binaryFile").load(list(some))
    whole = lambda df: df.select("path", "length", F.sha2("content", 256).alias("sha256"))
    files = whole(every(*paths).filter(F.col("length") <= WHOLE))
    big = every(*paths).filter(F.col("length") > WHOLE).select("path", F.col("path").rlike(COMPRESSED).alias("packed")).collect()
    if packed := [r.path for r in big if r.packed]:
        files = files.union(whole(every(*packed)))
    if plain := [r.path for r in big if not r.packed]:
        files = files.union(digests.large(spark, plain, WHOLE))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), "sha256")


def missing_inputs(spark: SparkSession, *paths: str) -> list[str]:
    """Those of the paths that do not exist."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)
    return [p for p in paths if not there(p)]


def as_json(value: dict) -> str:
    return json.dumps(value, indent=2, default=str)
