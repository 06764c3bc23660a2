"""Near-duplicate groups by circulant MinHash.

A document is the set of its word shingles. Two permutations of the 32-bit numbers make every signature
coordinate: one spreads the shingles once, the other, shifted circularly by k places, gives coordinate k.
Bands of coordinates are hashed into buckets; documents that share a bucket are candidates, and each
candidate is confirmed by the exact Jaccard similarity of the two full sets.

Documents with equal sets form one class, and only classes are compared. Within a bucket of at most
``small`` classes all pairs are confirmed. In a larger bucket every class is compared with a leader, the
one that meets most others. As only reachability is asked for, classes now connected with their leader
need no comparison among themselves; the few that are not are compared with the whole bucket. So no
link of a bucket is lost, and a group of thousands of copies costs about one comparison each.

With 40 bands of 5 coordinates a pair at similarity 0.8 shares no bucket with probability 1.3e-7.

Defined results: null, empty or blank texts have no shingles, link with nothing and are kept; a text
shorter than a shingle is one shingle (its whole word sequence); a null doc_id takes part but is never
the name of a group that has another; repeated rows belong to the group of their text; an empty table
gives an empty result; other columns are ignored by :func:`groups` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.llm import flat
from worklens.llm.common import broadcast_if, stage, text_batches, tidied, unused
from worklens.llm.graph import components

SPACE = flat.word_table(breaks=bytes([0x20, *range(0x09, 0x0E)]))
_U32 = np.uint32
_CHUNK = 1 << 15


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    small: int = 24
    block: int = 256


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct k-word shingles of a run of documents, sorted."""
    w = flat.words(raw, offsets, SPACE)
    count = np.bincount(w.doc, minlength=len(offsets) - 1)
    h = w.hash
    for i in range(1, min(k, len(w.hash))):
        h = flat.joined(h[:-1], w.hash[i:])
    if len(w.hash) < k:
        h = h[:0]
    whole = w.doc[: len(h)] == w.doc[k - 1 :] if len(h) else np.zeros(0, bool)
    doc, h = w.doc[: len(h)][whole], h[whole]
    if (short := (count > 0) & (count < k)).any():
        first = np.cumsum(count) - count
        at = np.arange(len(w.doc)) - first[w.doc]
        mine = short[w.doc]
        terms = flat.mix64(w.hash[mine] + at[mine].astype(np.uint64))
        d = w.doc[mine]
        cut = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        doc = np.concatenate([doc, d[cut]])
        h = np.concatenate([h, flat.mix64(np.add.reduceat(terms, cut) + count[d[cut]].astype(np.uint64))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]


def _spread(x: np.ndarray, room: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place; room: scratch of the same size."""
    for shift, by in ((16, a), (15, b)):
        np.right_shift(x, _U32(shift), out=room)
        np.bitwise_xor(x, room, out=x)
        np.multiply(x, _U32(by), out=x)
    np.right_shift(x, _U32(16), out=room)
    return np.bitwise_xor(x, room, out=x)


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Coordinates (k x n_docs): coordinate i is the minimum of pi(sigma(shingle) + i mod 2**32)."""
    out = np.full((k, n_docs), 0xFFFFFFFF, dtype=np.uint32)
    base = (h >> np.uint64(32)).astype(np.uint32)
    base = _spread(base, np.empty_like(base), 0x7FEB352D, 0x846CA68B)
    for a in range(0, len(base), _CHUNK):
        part, d = base[a : a + _CHUNK], doc[a : a + _CHUNK]
        cut = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        named = d[cut]
        x, room = np.empty_like(part), np.empty_like(part)
        for i in range(k):
            np.add(part, _U32(i), out=x)
            least = np.minimum.reduceat(_spread(x, room, 0x21F0AAAD, 0x735A2D97), cut)
            out[i, named] = np.minimum(out[i, named], least)
    return out


def _described(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, hash of the text, number of shingles, 128-bit digest of the set, bucket of each band."""
    names = ["doc_id", "text_hash", "n", "d1", "d2", "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in flat.runs(batch.column(2)):
                doc, h = shingles(raw, offsets, s.words)
                n = np.bincount(doc, minlength=b - a)
                digests = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    sums = np.zeros(b - a, np.uint64)
                    if len(doc):
                        cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                        sums[doc[cut]] = np.add.reduceat(flat.mix64(h ^ np.uint64(salt)), cut)
                    digests.append(sums.view(np.int64))
                sig = signatures(doc, h, b - a, s.bands * s.rows).astype(np.uint64)
                bucket = np.empty((b - a, s.bands), np.int64)
                for i in range(s.bands):
                    x = np.full(b - a, i + 1, np.uint64)
                    for j in range(s.rows):
                        x = flat.mix64(x * np.uint64(0x9E3779B97F4A7C15) + sig[i * s.rows + j])
                    bucket[:, i] = x.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * s.bands + 1, s.bands, dtype=np.int32)), pa.array(bucket.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n.astype(np.int64)), *map(pa.array, digests), lists], names=names)

    source = text_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(text) text_hash", "cast(text as string) text")
    return source.mapInArrow(tidied(run), "doc_id long, text_hash long, n long, d1 long, d2 long, buckets array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sides = []
                for i in (2, 3):
                    raw, offsets = flat.bytes_of(part.column(i))
                    sides.append(shingles(raw, offsets, s.words))
                doc = np.concatenate([sides[0][0], sides[1][0]])
                h = np.concatenate([sides[0][1], sides[1][1]])
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                both = doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])]
                shared = np.bincount(both, minlength=part.num_rows)
                union = np.bincount(doc, minlength=part.num_rows) - shared
                yield part.select([0, 1]).filter(pa.array((100 * shared >= s.percent * union) & (union > 0)))

    one = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(tidied(run), "a long, b long")


def _near_in_size(s: Settings):
    return 100 * F.least("n_a", "n_b") >= s.percent * F.greatest("n_a", "n_b")


def _links(docs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """(node, label) of the classes that have a link."""
    rows = classes.select("cid", "n", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    reach = F.sum("size").over(Window.partitionBy("cid"))  # at most one row a band
    members = stage(rows.join(shared, "bucket").withColumn("reach", reach), "members")
    # the class that shares most buckets with most others is the likeliest original of a bucket's copies
    leads = members.groupBy("bucket").agg(F.max(F.struct("reach", F.negative("cid").alias("order"), "cid", "n")).alias("lead"))
    members = stage(members.join(leads.select("bucket", F.col("lead.cid").alias("lead"), F.col("lead.n").alias("n_lead")), "bucket"), "members")
    small = (
        members.filter(F.col("size") <= s.small)
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("cid", "n"))).alias("m"))
        .select("m")
        .distinct()
        .select("m", F.posexplode("m").alias("i", "y"))
        .filter("i > 0")
        .select("y", F.explode(F.expr("slice(m, 1, i)")).alias("x"))
        .select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
    )
    stars = members.filter((F.col("size") > s.small) & (F.col("cid") != F.col("lead")))
    stars = stars.select(F.col("lead").alias("a"), F.col("cid").alias("b"), F.col("n_lead").alias("n_a"), F.col("n").alias("n_b"))
    pairs = stage(small.union(stars).filter(_near_in_size(s)).select("a", "b").distinct(), "pairs")
    edges = _edges(docs, classes, pairs, s)
    labels = components(edges)
    named = members.join(labels, F.col("cid") == F.col("node"), "left").select("bucket", "cid", "n", "size", "lead", F.coalesce("label", "cid").alias("label"))
    named = stage(named, "named")
    large = named.filter(F.col("size") > s.small)
    goal = large.filter("cid = lead").select("bucket", F.col("label").alias("goal"))
    apart = stage(large.join(goal, "bucket").filter("label <> goal").select("lead", "cid").distinct(), "apart")
    if apart.isEmpty():
        return labels
    rest = large.filter("cid <> lead").join(apart.select("lead").distinct(), "lead", "left_semi").select("lead", "cid").distinct()
    return components(stage(edges.union(_within_families(docs, classes, apart, stage(rest, "rest"), s)), "edges"))


def _within_families(docs: DataFrame, classes: DataFrame, apart: DataFrame, rest: DataFrame, s: Settings) -> DataFrame:
    """Links between the classes ``apart`` from their leader and the ``rest`` of the leader's buckets, both as
    (lead, cid). Both sides are cut into blocks, and the sets of two blocks are compared as a product of
    0/1 matrices, so pairs are never made, only the links that are found."""
    texts = _texts(docs, classes, rest.select("cid").distinct())

    def blocks(df: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
        n = df.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"n_{name}"))
        return df.join(n, "lead").withColumn(name, F.pmod(F.xxhash64("cid"), F.col(f"n_{name}")).cast("int")).drop(f"n_{name}"), n

    few, n_few = blocks(apart, s.block, "i")
    many, n_many = blocks(rest, 2 * s.block, "j")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    few = few.join(n_many, "lead").join(texts, "cid").select("lead", "i", every("n_j", "j"), "cid", "text").toDF("lead", "i", "j", "cid", "text")
    many = many.join(n_few, "lead").join(texts, "cid").select("lead", every("n_i", "i"), "j", "cid", "text").toDF("lead", "i", "j", "cid", "text")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        (d1, h1), (d2, h2) = (shingles(*flat.bytes_of(pa.array(df["text"].tolist(), pa.large_string())), s.words) for df in (left, right))
        n1, n2 = np.bincount(d1, minlength=len(left)), np.bincount(d2, minlength=len(right))
        common = np.intersect1d(h1, h2)
        shared = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(common), 4096):
            part = common[at : at + 4096]
            sides = []
            for d, h, n in ((d1, h1, len(left)), (d2, h2, len(right))):
                place = np.minimum(np.searchsorted(part, h), len(part) - 1)
                hit = part[place] == h
                m = np.zeros((n, len(part)), np.float32)
                m[d[hit], place[hit]] = 1
                sides.append(m)
            shared += sides[0] @ sides[1].T
        union = n1[:, None] + n2[None, :] - shared
        i, j = np.nonzero((100 * shared >= s.percent * union) & (union > 0))
        a, b = left["cid"].to_numpy()[i], right["cid"].to_numpy()[j]
        other = a != b
        return pd.DataFrame({"a": np.minimum(a, b)[other], "b": np.maximum(a, b)[other]})

    key = ["lead", "i", "j"]
    return few.groupBy(*key).cogroup(many.groupBy(*key)).applyInPandas(compare, "a long, b long").distinct()


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of the wanted classes, staged. Only their texts are read and moved."""
    wanted = stage(classes.join(wanted, "cid", "left_semi").select("cid", "doc_id", "text_hash"), "wanted")
    own = docs.selectExpr("cast(doc_id as bigint) id", "xxhash64(text) th", "cast(text as string) text")
    wanted = broadcast_if(wanted, wanted.count(), 500_000)
    texts = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("text_hash")))
    return stage(texts.select("cid", "text").dropDuplicates(["cid"]), "texts")


def _edges(docs: DataFrame, classes: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """Confirmed pairs, staged."""
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    return stage(_confirmed(pairs, _texts(docs, classes, wanted), s), "edges")


def groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and text_hash (which with doc_id names a row)."""
    return _grouped(docs, settings).drop("family")


def _grouped(docs: DataFrame, s: Settings) -> DataFrame:
    """The rows of :func:`groups` with the number of the component, which ids, as they may repeat, do not name."""
    described = stage(_described(docs, s), "described")
    named = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("rep")
    classes = described.filter("n > 0").groupBy("d1", "d2").agg(named, F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("cid"), "d1", "d2", "n", "rep.doc_id", "rep.text_hash", "buckets"), "classes")
    labels = _links(docs, classes, s)
    linked = classes.join(labels, F.col("cid") == F.col("node")).select("cid", "doc_id", "label")
    firsts = linked.groupBy("label").agg(F.min("doc_id").alias("first_id"))
    linked = linked.join(firsts, "label").select("cid", "first_id", "label")
    named = classes.join(linked, "cid", "left").select("d1", "d2", F.coalesce("first_id", "doc_id").alias("component"), F.coalesce("label", "cid").alias("family"))
    whole = described.select("doc_id", "text_hash", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", F.when(F.col("n") > 0, F.col("family")).alias("family"))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each group, all columns kept: of the smallest id (null ids last), then the smallest text
    hash; of rows that share both, any one. Texts without shingles are in no group and stay."""
    pair = ["family", "doc_id", "text_hash"]
    pairs = stage(_grouped(docs, settings).filter("family is not null").groupBy(*pair).agg(F.count(F.lit(1)).alias("times")), "pairs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "times")).alias("first")
    firsts = stage(pairs.groupBy("family").agg(first).select("first.doc_id", "first.text_hash", "first.times"), "firsts")
    alone = firsts.filter("times = 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    gone = pairs.join(alone, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_hash").eqNullSafe(F.col("hash")), "left_anti")
    gone_id, gone_hash = unused(docs, "gone_id"), unused(docs, "gone_hash")
    names = [F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)]
    gone, again = stage(gone.select(*names), "gone"), firsts.filter("times > 1").select(*names)
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col(gone_id)) & F.xxhash64(docs["text"]).eqNullSafe(F.col(gone_hash))
    kept = docs.join(broadcast_if(gone, gone.count(), 2_000_000), same, "left_anti")
    copies = docs.join(broadcast_if(again, again.count(), 2_000_000), same).dropDuplicates([gone_id, gone_hash])
    return kept.union(copies.select(*(docs[c] for c in docs.columns)))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
