"""Phrases that occur more often than their parts let expect, mined with weighted acyclic automata.

A-Z are lower-cased, texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``;
everything is counted per language. f is the number of contiguous occurrences of a phrase within pieces.

1. A shard of documents (about CHUNK bytes of text) numbers its words in byte order, sorts the windows of ``longest``
   words that begin at each word (padded at the end of a piece) and builds from them, one range of prefixes after
   the other, count transducers: an arc reads a word and weighs as many occurrences as the path that ends with it has.
   States with equal arcs, weights and goals are stored once.
2. The transducers of a range of prefixes are united: the words of their arcs are renumbered together, equal paths
   meet, their weights are added. Ranges are cut by phrases of a bounded sample, whatever word they begin with, so that
   a common first word may be spread over many of them; only their balance rests on the sample. A path on the edge of
   a range may go on in the next one, so edges are handed on whatever they weigh, and added up before the threshold.
3. Frequent phrases are composed with the united counts of their parts: both parts of a frequent phrase are frequent
   themselves, so this is a join with the same table.

Defined results: null and empty texts have no words; a null lang is ``und``; repeated rows count again; doc_id and
other columns are ignored; an empty table gives an empty result; a text longer than a shard is a shard of its own.
Ties of score and count are ordered by the phrase's bytes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.llm import flat
from worklens.llm.common import stage, text_batches, tidied, trimmed

#: Bytes of text of a shard, and of the corpus for each range of prefixes. They bound the memory of a task.
CHUNK = 24 << 20
RANGE = 12 << 20
#: Bytes of text sampled, tasks that work on them, and phrases each may name, to find the edges of ranges.
SAMPLE, SAMPLERS, NAMED = 16 << 20, 16, 4096
#: Leading bytes of a word that count in an edge.
EDGE = 64

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


@dataclass(frozen=True)
class Settings:
    longest: int = 3
    least: int = 10
    percent: int = 50
    top: int = 2000
    chunk: int = CHUNK
    range: int = RANGE


def words(texts: pa.ChunkedArray | list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words in byte order, number in it from 1 of each word of the texts, number of its piece)."""
    data, sizes, pieces, base = [], [], [], 0
    for column in texts.chunks if isinstance(texts, pa.ChunkedArray) else texts:
        for _, _, raw, offsets in flat.runs(column):
            kind = _KIND[raw]
            inside = kind == 0
            before = np.empty_like(inside)
            before[1:] = inside[:-1]
            starts = offsets[:-1][offsets[:-1] < len(raw)]
            before[starts] = False
            after = np.zeros_like(inside)
            after[:-1] = inside[1:]
            after[starts[starts > 0] - 1] = False
            first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
            breaks = (kind == 2).astype(np.int32)
            breaks[starts] += 1
            pieces.append(np.cumsum(breaks)[first] + base)
            base += int(breaks.sum()) + 1
            data.append(flat.LOWER[raw[inside]])
            sizes.append(last - first + 1)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    every = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(data) if data else b"")])
    coded = every.dictionary_encode()
    order = np.asarray(pc.array_sort_indices(coded.dictionary)).astype(np.int64)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)), number[np.asarray(coded.indices)], np.concatenate(pieces) if pieces else np.zeros(0, np.int64)


def counted(columns: list[np.ndarray], weights: np.ndarray | None, base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows, sorted, of columns of numbers below ``base``, and the sum of their weights (1 each)."""
    if base ** len(columns) < 1 << 63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key * base + c
        if weights is None:
            key = np.sort(key)
        else:
            order = np.argsort(key, kind="stable")
            key, weights = key[order], weights[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.diff(np.append(new, len(key))) if weights is None else np.add.reduceat(weights, new) if len(new) else weights
        key = key[new]
        out = []
        for _ in columns[1:]:
            key, last = np.divmod(key, base)
            out.append(last)
        return [key, *out[::-1]], total
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    weights = np.ones(len(order), np.int64) if weights is None else weights[order]
    new = np.flatnonzero(_changes(columns))
    return [c[new] for c in columns], np.add.reduceat(weights, new) if len(new) else weights


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row of the sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def windows(code: np.ndarray, piece: np.ndarray, base: int, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct windows, sorted, and how often each occurs; 0 where a piece has ended."""
    columns = [code]
    for j in range(1, longest):
        following = np.zeros_like(code)
        np.copyto(following[:-j], code[j:], where=piece[j:] == piece[:-j])
        columns.append(following)
    return counted(columns, None, base)


def _small(x: np.ndarray) -> bytes:
    """Numbers as bytes: their width, then the numbers in it."""
    top = int(x.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class Transducer:
    """Counts of phrases. Layer d has the arcs that read the d-th word, state by state: ``first`` (the arcs of state s
    are first[s] to first[s + 1]), word, weight and goal (a state of layer d + 1, none in the last layer)."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.layers = layers

    @classmethod
    def built(cls, columns: list[np.ndarray], counts: np.ndarray) -> Transducer:
        """From sorted distinct windows."""
        arcs, rows, new = [], len(counts), np.zeros(len(counts), bool)
        new[:1] = True
        parent = np.zeros(rows, np.int64)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
            at = np.flatnonzero(new)
            weight = np.add.reduceat(counts, at) if rows else counts
            real = column[at] > 0
            arcs.append((column[at][real], weight[real], parent[at][real]))
            number = np.cumsum(real) - 1  # of the arcs that end in a word
            parent = np.repeat(number, np.diff(np.append(at, rows)))
        layers, goals = [], np.zeros(len(arcs[-1][0]), np.int64)
        for depth in range(len(arcs) - 1, -1, -1):
            word, weight, parent = arcs[depth]
            states = len(arcs[depth - 1][0]) if depth else 1
            first = np.searchsorted(parent, np.arange(states + 1)) if depth else np.array([0, len(word)])
            first, keep, goal_of = cls._shared(first, word, weight, goals)
            layers.append((first, word[keep], weight[keep], goals[keep]))
            goals = goal_of
        return cls(layers[::-1])

    @staticmethod
    def _shared(first: np.ndarray, word: np.ndarray, weight: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal states as one: (arc ranges of the states kept, their arcs, the kept state of each state)."""
        states, size = len(first) - 1, np.diff(first)
        at = np.arange(len(word)) - np.repeat(first[:-1], size)
        u = lambda x: x.astype(np.uint64)
        mixed = flat.mix64(flat.mix64(flat.mix64(u(word) + flat.U64(0x9E3779B97F4A7C15)) + u(weight)) + u(goal)) * u(2 * at + 1)
        total = np.append(flat.U64(0), np.cumsum(mixed, dtype=np.uint64))
        sign = total[first[1:]] - total[first[:-1]] + u(size)
        coded = pa.array(sign).dictionary_encode()
        code = np.asarray(coded.indices).astype(np.int64)
        like = np.full(len(coded.dictionary), states, np.int64)
        np.minimum.at(like, code, np.arange(states))
        like = like[code]  # the first state of the same signature
        same = size == size[like]
        where = np.repeat(same, size)
        other = (np.repeat(first[:-1][like], size) + at)[where]
        equal = np.ones(len(word), bool)
        equal[where] = (word[where] == word[other]) & (weight[where] == weight[other]) & (goal[where] == goal[other])
        wrong = np.append(0, np.cumsum(~equal))
        like = np.where(same & (wrong[first[1:]] == wrong[first[:-1]]), like, np.arange(states))
        kept = like == np.arange(states)
        number = np.cumsum(kept) - 1
        return np.append(0, np.cumsum(size[kept])), np.repeat(kept, size), number[like]

    def paths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The windows it was built from, and their counts."""
        longest = len(self.layers)
        state, prefix = np.zeros(1, np.int64), []
        out: list[tuple[list[np.ndarray], np.ndarray]] = []
        owed = None
        for first, word, weight, goal in self.layers:
            size = first[state + 1] - first[state]
            arc = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[state], size)
            if owed is not None:  # what of the shorter paths does not go on
                gone = np.zeros(len(owed), np.int64)
                np.add.at(gone, np.repeat(np.arange(len(size)), size), weight[arc])
                ends = owed > gone
                out.append(([c[ends] for c in prefix], (owed - gone)[ends]))
            prefix = [np.repeat(c, size) for c in prefix] + [word[arc]]
            owed, state = weight[arc], goal[arc]
        out.append((prefix, owed))
        pad = lambda c, n: [*c, *[np.zeros(n, np.int64)] * (longest - len(c))]
        every = [(pad(c, len(n)), n) for c, n in out]
        return [np.concatenate([c[i] for c, _ in every]) for i in range(longest)], np.concatenate([n for _, n in every])

    def packed(self, names: pa.Array) -> tuple[bytes, bytes, list[bytes]]:
        """(lengths of its words, their bytes, its layers), with its words numbered anew."""
        used = np.unique(np.concatenate([word for _, word, _, _ in self.layers]))
        own = names.take(pa.array(used - 1))
        arrays = []
        for first, word, weight, goal in self.layers:
            arrays += [np.diff(first), np.searchsorted(used, word), weight - 1, goal]
        return _small(np.asarray(pc.binary_length(own))), b"".join(own.to_pylist()), [_small(x) for x in arrays]

    @classmethod
    def unpacked(cls, arrays: list[bytes], number: np.ndarray) -> Transducer:
        """``number``: the new number of each of its words."""
        layers = []
        for i in range(0, len(arrays), 4):
            size, word, weight, goal = map(_large, arrays[i : i + 4])
            layers.append((np.append(0, np.cumsum(size)), number[word], weight + 1, goal))
        return cls(layers)


def _row_of(edge: tuple[bytes, ...], names: list[bytes], columns: list[np.ndarray]) -> int:
    """The first row of the sorted windows that is not below a phrase."""
    low, high = 0, len(columns[0])
    for word, column in zip(edge, columns):
        at = bisect_left(names, word)
        number = at + 1
        part = column[low:high]
        if at == len(names) or names[at] != word:
            return low + int(np.searchsorted(part, number))
        low, high = low + int(np.searchsorted(part, number)), low + int(np.searchsorted(part, number, side="right"))
    return low


def _by_lang(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[list[tuple[str, list[pa.Array]]]]:
    """Shards of about ``chunk`` bytes: the texts of each language."""
    held: dict[str, list[pa.Array]] = {}
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for lang in pc.unique(part.column(0)).to_pylist():
                held.setdefault(lang, []).append(part.column(1).filter(pc.equal(part.column(0), lang)))
            size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if size >= chunk:
                yield list(held.items())
                held, size = {}, 0
    if held:
        yield list(held.items())


def _source(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("coalesce(cast(lang as string), 'und') lang", "cast(text as string) text").filter("text is not null")


def _edges(docs: DataFrame, size: int, s: Settings) -> list[tuple[bytes, ...]]:
    """Language and words of the phrases at which ranges are cut, sorted: as many as the size of the corpus asks for."""
    ranges = size // s.range + 1

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _by_lang(batches, 1 << 62):
            total = sum(sum(len(t) for t in texts) for _, texts in shard)
            for lang, texts in shard:
                names, code, piece = words(texts)
                columns, _ = windows(code, piece, len(names) + 1, s.longest)
                most = max(1, NAMED * sum(len(t) for t in texts) // max(1, total))
                at = np.linspace(0, len(columns[0]) - 1, min(most, len(columns[0]))).astype(np.int64)
                picked = [[names[int(c[i]) - 1].as_py()[:EDGE] for c in columns if c[i]] for i in at]
                share = len(columns[0]) / max(1, len(picked))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(picked), pa.string()), pa.array(picked, pa.list_(pa.binary())), pa.array([share] * len(picked), pa.float64())], names=["lang", "words", "share"])

    if ranges == 1:
        return []
    sample = _source(docs).sample(min(1.0, SAMPLE / size), 7).repartition(SAMPLERS)
    rows = sorted(((r.lang.encode(), *map(bytes, r.words)), r.share) for r in sample.mapInArrow(tidied(named), "lang string, words array<binary>, share double").collect())
    mass = np.cumsum([share for _, share in rows])
    at = np.searchsorted(mass, mass[-1] * np.arange(1, ranges) / ranges) if rows else []
    return sorted({rows[i][0] for i in at})


PIECES = "range int, lang string, lengths binary, words binary, arcs array<binary>"
COUNTS = "lang string, phrase string, words int, f long"


def _sharded(docs: DataFrame, edges: list[tuple[bytes, ...]], s: Settings) -> DataFrame:
    """The transducers of all shards, cut at the edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _by_lang(batches, s.chunk):
            for lang, texts in shard:
                names, code, piece = words(texts)
                if not len(code):
                    continue
                columns, counts = windows(code, piece, len(names) + 1, s.longest)
                del code, piece
                key = lang.encode()
                a, b = bisect_right(edges, (key,)), bisect_left(edges, (key + b"\0",))
                listed = names.to_pylist() if b > a else []
                cuts = [0, *(_row_of(e[1:], listed, columns) for e in edges[a:b]), len(counts)]
                for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
                    if high > low:
                        lengths, data, arcs = Transducer.built([c[low:high] for c in columns], counts[low:high]).packed(names)
                        yield pa.RecordBatch.from_arrays([pa.array([a + i], pa.int32()), pa.array([lang]), pa.array([lengths], pa.binary()), pa.array([data], pa.binary()), pa.array([arcs], pa.list_(pa.binary()))], names=["range", "lang", "lengths", "words", "arcs"])
            trimmed()

    return text_batches(_source(docs)).mapInArrow(tidied(run), PIECES)


def _united(s: Settings):
    def run(pieces: pa.Table) -> pa.Table:
        """The union of the transducers of a range: its phrases of weight ``least`` at least, those on its edges, and
        (without a phrase) the number of its words."""
        lang = pieces.column("lang")[0].as_py()
        sizes = [_large(x) for x in pieces.column("lengths").to_pylist()]
        ends = np.append(0, np.cumsum(np.concatenate(sizes)))
        data = b"".join(pieces.column("words").to_pylist())
        coded = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        order = np.asarray(pc.array_sort_indices(coded.dictionary)).astype(np.int64)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(1, len(order) + 1)
        number, names = number[np.asarray(coded.indices)], coded.dictionary.take(pa.array(order))
        parts, at = [], 0
        for size, arcs in zip(sizes, pieces.column("arcs").to_pylist()):
            parts.append(Transducer.unpacked(arcs, number[at : at + len(size)]).paths())
            at += len(size)
        columns, counts = counted([np.concatenate([p[0][i] for p in parts]) for i in range(s.longest)], np.concatenate([p[1] for p in parts]), len(names) + 1)
        del parts
        found: list[list] = [[None], [0], [int(counts.sum())]]
        new = np.zeros(len(counts), bool)
        new[:1] = True
        for depth, column in enumerate(columns, 1):
            new[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(new)
            weight = np.add.reduceat(counts, first)
            open_ = np.zeros(len(first), bool)
            open_[[0, -1]] = True
            keep = (column[first] > 0) & ((weight >= s.least) | open_)
            picked = [names.take(pa.array(c[first[keep]] - 1)).cast(pa.large_string()) for c in columns[:depth]]
            found[0] += (picked[0] if depth == 1 else pc.binary_join_element_wise(*picked, pa.scalar(" ", pa.large_string()))).to_pylist()
            found[1] += [depth] * int(keep.sum())
            found[2] += weight[keep].tolist()
        out = pa.table([pa.array([lang] * len(found[0]), pa.string()), pa.array(found[0], pa.string()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.int64())], names=["lang", "phrase", "words", "f"])
        trimmed()
        return out

    return run


def counts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, phrase, words and f of all phrases of up to ``longest`` words that occur ``least`` times or more, staged.
    A row of each language without a phrase has the number of its words."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    pieces = _sharded(docs, _edges(docs, size, settings), settings)
    found = pieces.groupBy("range", "lang").applyInArrow(_united(settings), COUNTS)
    return stage(found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("f") >= settings.least) | F.col("phrase").isNull()), "phrases")


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score of the first ``top`` phrases of each language."""
    s = settings
    found = counts(docs, s)
    total = found.filter("phrase is null").select("lang", F.col("f").alias("n"))
    known = found.filter("phrase is not null")
    candidates = known.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    inner = "flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(w, i, n), ' '))))"
    longer = candidates.filter("words > 2").withColumn("w", F.split("phrase", " ")).select("lang", F.explode(F.expr(inner)).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {s.percent} * a").drop("longer")
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    part = lambda name, value: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    scored = scored.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= s.top)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= s.top)
    return scored.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda w: w <> '') AS w FROM d),
g AS (
  SELECT lang, w[i : i + k - 1] AS g FROM (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM p WHERE len(w) > 0), (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, array_to_string(g, ' ') AS phrase, len(g) AS words, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10),
o AS (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE words = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE words = 3) GROUP BY ALL),
k AS (SELECT c.lang, c.phrase, c.a, k.k, array_to_string(w[1:k.k], ' ') AS head, array_to_string(w[k.k + 1:], ' ') AS rest
  FROM c LEFT JOIN o ON c.lang = o.lang AND c.phrase = o.phrase JOIN (VALUES (1), (2)) k(k) ON k.k < c.words WHERE longer IS NULL OR 100 * longer < 50 * c.a),
s AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM k JOIN f l ON k.lang = l.lang AND k.head = l.phrase JOIN f r ON k.lang = r.lang AND k.rest = r.phrase),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
