"""Benchmark decontamination with a distributed positional inverted index (DataFrame operations only).

Training texts become postings (row, position, term), stored as Parquet in the shared folder. Test texts
become windows of consecutive words. Each window is looked up by its two rarest terms: their posting
lists, each shifted by the term's offset in the window, are intersected on (row, start). What survives
names alignments of a whole item with a document, and the remaining terms of the item are looked up at
the positions the alignment expects; runs of at least a window's length of found terms are exact matches.

Only terms of the test texts are indexed, since no other term is ever looked up; each row also has one
header posting (position 0, a term of its own kind) with its doc_id and number of words.

Defined results: null text has no words; an item without words matches nothing; an item shorter than a
window is one window; a null item_id is not counted in ``n_items`` nor listed, but its words are hit;
several items of one text all count; rows with the same item_id are separate texts of one item; a null
doc_id passes through; repeated rows are separate rows of the result; empty tables give an empty result
or no hits; other columns are ignored by :func:`match` and kept by :func:`keep_clean`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.llm.common import broadcast_if, stage, unused

#: Fixed value: what separates words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Keys among which the header postings are dealt.
HEADERS = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    window: int = 10
    rarest: int = 2
    broadcast_rows: int = 200_000


def tokens(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text. ``lower`` is used where all bytes are ASCII, where it is the same."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(lowered, BREAKS), lambda w: w != "")


def item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, size, offset, term) of the test texts; item numbers the rows."""
    numbered = stage(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), tokens(F.col("text")).alias("words")).filter(F.size("words") > 0), "items")
    return numbered.select("item", "item_id", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))


def build_index(docs: DataFrame, terms: DataFrame, broadcast_rows: int) -> DataFrame:
    """Stored postings of the given (term, tid): row, pos (from 1), tid; headers have pos 0 and tid -1."""
    # no word holds a zero byte; headers share HEADERS keys, so that none of them is hot where the join shuffles
    headers = docs.sparkSession.range(HEADERS).select(F.concat(F.lit("\0"), "id").alias("term"), F.lit(-1).cast("long").alias("tid"))
    headed = broadcast_if(terms.select("term", "tid").union(headers), terms.count() + HEADERS, broadcast_rows)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), tokens(F.col("text")).alias("words"))
    header = F.concat(F.lit("\0"), F.pmod(F.xxhash64("row"), F.lit(HEADERS)))
    rows = rows.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(header), "words")).alias("pos", "term"))
    head = F.col("pos") == 0
    return stage(rows.join(headed, "term").select("row", "pos", "tid", F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("n_words")).alias("n_words")), "postings")


def _numbered(words: DataFrame) -> DataFrame:
    """(term, tid) of the distinct terms."""
    return stage(words.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "terms")


def _rarest(words: DataFrame, index: DataFrame, s: Settings) -> DataFrame:
    """(item, start, tid, shift): the terms by which each window is looked up; windows with a term that the
    index lacks are left out. start is the window's offset in its item, shift the term's in the window."""
    found = index.filter("tid >= 0").groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    ranked = words.join(found, "tid", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    length = F.least(F.col("size"), F.lit(s.window))
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("offset") - length + 1), F.least(F.col("offset"), F.col("size") - length)))
    windows = ranked.select("item", "tid", "df", "offset", starts.alias("start"))
    by = Window.partitionBy("item", "start")
    windows = windows.select("item", "start", "tid", (F.col("offset") - F.col("start")).alias("shift"), F.min("df").over(by).alias("least"), F.row_number().over(by.orderBy("df", "tid", "offset")).alias("rank"), F.count(F.lit(1)).over(by).alias("terms"))
    return windows.filter((F.col("least") > 0) & (F.col("rank") <= s.rarest)).select("item", "start", "tid", "shift", F.least(F.col("terms"), F.lit(s.rarest)).alias("lists"))


def _candidates(lookups: DataFrame, index: DataFrame, s: Settings) -> DataFrame:
    """(row, item, at): alignments at which the rarest terms of a window meet; at is the position of the
    item's first word (it may lie before the text)."""
    lookups = stage(lookups, "lookups")
    n = lookups.count()
    sought = broadcast_if(lookups.select("tid").distinct(), n, s.broadcast_rows)
    lists = index.select("row", "pos", "tid").join(sought, "tid", "left_semi").join(broadcast_if(lookups, n, s.broadcast_rows), "tid")
    lists = lists.select("row", "item", "start", "lists", (F.col("pos") - F.col("shift")).alias("first"))
    met = lists.groupBy("row", "item", "start", "first", "lists").agg(F.count(F.lit(1)).alias("found")).filter("found = lists")
    return met.select("row", "item", (F.col("first") - F.col("start")).alias("at")).distinct()


def phrases(words: DataFrame, index: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(row, item, item_id, first, last): maximal runs of document positions (from 1) that one alignment of an
    item matches exactly, each at least a window long. ``words``: from :func:`item_words`, with tid."""
    s = settings
    aligned = stage(_candidates(_rarest(words, index, s), index, s), "aligned")
    expected = aligned.join(words.select("item", "item_id", "size", "offset", "tid"), "item")
    expected = expected.withColumn("pos", F.col("at") + F.col("offset")).filter("pos > 0")
    near = index.join(aligned.select("row").distinct(), "row", "left_semi").select("row", "pos", "tid")
    found = expected.join(near, ["row", "pos", "tid"])
    alignment = ["row", "item", "at"]
    island = F.col("offset") - F.row_number().over(Window.partitionBy(*alignment).orderBy("offset"))
    runs = found.withColumn("island", island).groupBy(*alignment, "island").agg(F.first("item_id").alias("item_id"), F.first("size").alias("size"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.filter(F.col("last") - F.col("first") + 1 >= F.least(F.col("size"), F.lit(s.window))).select("row", "item", "item_id", "first", "last")


def near_matches(words: DataFrame, index: DataFrame, settings: Settings = Settings(), slop: int = 5) -> DataFrame:
    """(row, item, item_id, start): proximity matches. A window of an item is near a document position of its
    rarest term if every one of its distinct terms occurs within ``window + slop`` positions of it; order and
    gaps do not matter. Exact matches are near matches too."""
    s = settings
    reach = s.window + slop
    length = F.least(F.col("size"), F.lit(s.window))
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("offset") - length + 1), F.least(F.col("offset"), F.col("size") - length)))
    windows = words.select("item", "item_id", "tid", starts.alias("start")).distinct()
    needed = windows.groupBy("item", "start").agg(F.count(F.lit(1)).alias("terms"))
    anchors = _rarest(words, index, Settings(s.window, 1, s.broadcast_rows)).join(needed, ["item", "start"])
    posts = index.select("row", "pos", "tid").filter("tid >= 0")
    spots = posts.join(anchors.select("item", "start", "tid", "terms"), "tid").select("row", "item", "start", "terms", F.col("pos").alias("spot"))
    cells = spots.withColumn("cell", F.explode(F.array(*[F.floor(F.col("spot") / reach) + i for i in (-1, 0, 1)])))
    cells = cells.join(windows, ["item", "start"])
    around = posts.withColumn("cell", F.floor(F.col("pos") / reach))
    met = cells.join(around, ["row", "cell", "tid"]).filter(F.abs(F.col("pos") - F.col("spot")) <= reach)
    met = met.groupBy("row", "item", "item_id", "start", "spot", "terms").agg(F.count_distinct("tid").alias("got"))
    return met.filter("got = terms").select("row", "item", "item_id", "start").distinct()


def match(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """row, doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, a row per document."""
    s = settings
    words = item_words(items)
    terms = _numbered(words)
    words = stage(words.join(terms, "term"), "words")
    index = build_index(docs, terms, s.broadcast_rows)
    found = stage(phrases(words, index, s), "phrases")
    named = found.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    # overlapping runs of positions become disjoint ones, whose lengths add up
    before = F.max("last").over(Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    hit = found.select("row", "first", "last").distinct().withColumn("before", F.coalesce(before, F.lit(0)))
    hit = hit.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("before"), F.col("first") - 1))).alias("n_hit"))
    heads = index.filter("tid = -1").select("row", "doc_id", "n_words")
    whole = heads.join(hit.join(named, "row", "left"), "row", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("bigint")
    return whole.select("row", "doc_id", F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"), F.size(items_).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", items_), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents without any hit, all columns kept. A hit depends on the text alone, so rows go by the hash of
    their text, whatever their doc_id: null and repeated ones are no special case."""
    own, name = F.xxhash64(docs["text"].cast("string")), unused(docs, "gone_hash")
    hit = stage(match(docs.select(own.alias("doc_id"), "text"), items, settings).filter("contaminated").select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    hit = broadcast_if(hit, hit.count(), 2_000_000)
    return docs.join(hit, own == F.col(name), "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, list_aggregate(list_slice(words, s, s + least(10, len(words)) - 1), 'string_agg', ' ') AS gram
  FROM (SELECT item_id, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS s FROM b WHERE len(words) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, s, list_aggregate(list_slice(words, s, s + n - 1), 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS s FROM d, lens WHERE len(words) >= n)),
hits AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
