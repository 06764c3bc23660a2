"""Cross-tokenizer alignment: tokens of two vocabularies that cover the same bytes, found by lockstep merging.

Vocabulary A is a byte-level BPE file in JSON, B a SentencePiece model; both read the text with a space before it. The
tokens of a document are two sorted lists of byte offsets. One state vector holds, for all documents of a batch at
once, the pointers into both lists. Each step emits one link a document (its current A and B tokens overlap), a cut
where both end at the same offset, advances the pointer whose token ends first (both at a cut), and from time to time
the vector is compacted to the documents that are not finished. A long document takes several lanes of the vector,
which begin at offsets that are known to be cuts.

Tokens come from the vocabularies' own libraries. Both read words apart: neither merges across a space that follows
something that is not white space, so a shard's texts are cut there into units, and each distinct unit is encoded once.
A SentencePiece model that normalises texts or has pieces with a space inside gets whole texts as units.

How often an id pair is linked in the whole corpus is counted in two levels (shards in groups, then groups) by bucket
of B ids, so that a bucket knows the likeliest partner of its ids; the counts go back to the shards that asked. A
bucket holds each pair once a group at most, and there are at most as many pairs as the product of the vocabularies.

Defined results: texts null, empty, or that the tokens' bytes do not give back, have no tokens: all columns 0, the
digest ''. A null doc_id passes through; repeated rows give repeated rows and their links count again; an empty table
gives an empty result; other columns are ignored. Equal counts share the first place.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm import flat
from worklens.llm.bpe import PATTERN, _byte_of_char
from worklens.llm.common import shared_dir, stage, text_batches, tidied, trimmed

MARK = "▁"
#: Bytes of text of a shard, of the documents merged in lockstep at once, and of the corpus for each bucket of B ids.
SHARD, BATCH, BUCKET = 6 << 20, 2 << 20, 8 << 20
#: Units of a lane of the state vector.
LANE = 512
#: Pre-tokens and (in each of two generations) units whose ids a worker keeps, and strings for a library at once.
REMEMBERED, PARTS = 150_000, 10_000
#: Shards whose counts are added up first.
GROUP = 256


class Tokens(NamedTuple):
    """Tokens of many strings: ids and ends (byte offset in the string) one string after the other, where each string's
    tokens begin (n + 1), and whether those of both vocabularies give its bytes back."""

    ids: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    whole: np.ndarray


class Vocabularies:
    """Both vocabularies as their libraries read them."""

    def __init__(self, a: str, b: str):
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = _byte_of_char()
        names = spec["model"]["vocab"]
        self.size_a = max([*names.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_a = [b""] * self.size_a
        for name, i in names.items():
            self.bytes_a[i] = bytes(stand_in[c] for c in name if c in stand_in)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.size_b = self.b.get_piece_size()
        self.pre_tokens: dict[str, bytes] = {}
        self.units: dict[bytes, tuple[bytes, bytes, bool]] = {}
        self.older: dict[bytes, tuple[bytes, bytes, bool]] = {}
        self.find = regex.compile(PATTERN).findall
        self.bytes_b = []
        for i in range(self.size_b):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else piece.replace(MARK, " ").encode())
        self.mark = self.b.piece_to_id(MARK)
        plain = "a  b Åﬁ　 c "
        self.apart = spec["pre_tokenizer"].get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"].get("add_prefix_space", True)
        self.apart &= all(MARK not in self.b.id_to_piece(i).lstrip(MARK) for i in range(self.size_b)) and self.b.normalize(plain) == MARK + plain.replace(" ", MARK)

    def encode(self, units: list[bytes]) -> tuple[Tokens, Tokens]:
        """Tokens of both vocabularies. Units that the worker has met lately are not encoded again."""
        if len(self.units) > REMEMBERED:
            self.older, self.units = self.units, {}
        known, older = self.units, self.older
        new = [u for u in units if u not in known]
        known.update((u, older[u]) for u in new if u in older)
        new = [u for u in new if u not in known]
        for low in range(0, len(new), PARTS):
            self._learn(new[low : low + PARTS])
        a, b, kept = zip(*map(known.__getitem__, units)) if units else ((), (), ())
        return self._tokens(a, self.bytes_a, kept), self._tokens(b, self.bytes_b, kept)

    def _learn(self, units: list[bytes]) -> None:
        texts = [u.decode("utf-8") for u in units]
        sides, whole = [self._ids_a(texts), self._ids_b(texts)], []
        for found, bytes_of in zip(sides, (self.bytes_a, self.bytes_b)):
            first = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4))
            ids = np.frombuffer(b"".join(found), np.int32)
            ends = np.append(0, np.cumsum(np.fromiter(map(len, bytes_of), np.int64, len(bytes_of))[ids]))
            same = ends[first[1:]] - ends[first[:-1]] == np.fromiter(map(len, units), np.int64, len(units))
            if not same.all() or b"".join(map(bytes_of.__getitem__, ids.tolist())) != b"".join(units):
                same = [b"".join([bytes_of[i] for i in np.frombuffer(part, np.int32)]) == u for part, u in zip(found, units)]
            whole.append(same)
        self.units.update(zip(units, zip(*sides, (bool(x and y) for x, y in zip(*whole)))))

    def _ids_a(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each. Each distinct pre-token goes to the library once."""
        packed = lambda some: (array("i", e.ids).tobytes() for e in self.a.encode_batch_fast(some, add_special_tokens=False))
        if not self.apart:
            return list(packed(texts))
        if len(self.pre_tokens) > REMEMBERED:
            self.pre_tokens = {}
        known, parts = self.pre_tokens, list(map(self.find, texts))
        new = list({p for p in chain.from_iterable(parts) if p not in known})
        known.update(zip(new, packed(new)))
        ids_of = known.__getitem__
        return [b"".join(map(ids_of, part)) for part in parts]

    def _ids_b(self, texts: list[str]) -> list[bytes]:
        """Likewise; the model adds the space that each text begins with."""
        found = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [array("i", ids if len(t) > 1 else [self.mark]).tobytes() for ids, t in zip(found, texts)]

    @staticmethod
    def _tokens(found: tuple[bytes, ...], known: list[bytes], whole: tuple[bool, ...]) -> Tokens:
        first = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4))
        ids = np.frombuffer(b"".join(found), np.int32)
        ends = np.append(0, np.cumsum(np.fromiter(map(len, known), np.int64, len(known))[ids]))
        return Tokens(ids, (ends[1:] - np.repeat(ends[first[:-1]], np.diff(first))).astype(np.int32), first, np.array(whole, bool))


@lru_cache(maxsize=2)
def vocabularies(a: str, b: str) -> Vocabularies:
    """One pair per worker process."""
    return Vocabularies(a, b)


def unit_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units of the texts (each with its leading space) begin: at each text, and at each space after a character
    that is surely not white space."""
    at = np.flatnonzero(raw[1:] == 0x20) + 1
    last = raw[at - 1]
    sure = (last > 0x20) & (last < 0x7F)
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):  # the lead byte tells; C2, E1, E2 and E3 begin white space beside other characters
        where = at[wide]
        second, third = raw[where - 2], raw[np.maximum(where - 3, 0)]
        sure[wide] = np.where(second >= 0xC0, second >= 0xC3, np.where(third >= 0xC0, (third == 0xE0) | (third >= 0xE4), True))
    begins = np.zeros(len(raw), bool)
    begins[at[sure]] = True
    begins[offsets[:-1]] = True
    return np.flatnonzero(begins)


def _ragged(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places of the elements of the lists ``which``, one after the other; the length of each)."""
    size = first[which + 1] - first[which]
    return np.arange(size.sum()) + np.repeat(first[which] - np.cumsum(size) + size, size), size


class Batch(NamedTuple):
    """Documents aligned: tokens of all documents one after the other (ids, end offsets), where those of each document
    begin, and their links (places of an A and a B token, in order), of which ``cut`` tells where both tokens end;
    first_link: where the links of each document begin."""

    a: np.ndarray
    a_end: np.ndarray
    a_first: np.ndarray
    b: np.ndarray
    b_end: np.ndarray
    b_first: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut: np.ndarray
    first_link: np.ndarray


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A places, B places, cuts) of the links of all lanes, and the number of links of each lane. The tokens of lane k
    are a_first[k] to a_first[k + 1] and b_first[k] to b_first[k + 1]; both end at the same offset."""
    room = np.append(0, np.cumsum(np.diff(a_first) + np.diff(b_first)))
    link_a, link_b = np.empty(room[-1], np.int32), np.empty(room[-1], np.int32)
    cut, used = np.zeros(room[-1], bool), np.zeros(room[-1], bool)
    i, j, out, stop = a_first[:-1].copy(), b_first[:-1].copy(), room[:-1].copy(), a_first[1:]
    alive = i < stop
    while True:
        if not alive.all():
            i, j, out, stop = i[alive], j[alive], out[alive], stop[alive]
        if not len(i):
            break
        x, y = a_end[i], b_end[j]
        link_a[out], link_b[out], used[out] = i, j, True
        left, right = x <= y, y <= x
        cut[out] = left & right
        i += left
        j += right
        out += 1
        alive = i < stop
    links = np.add.reduceat(np.append(used, False), room[:-1], dtype=np.int64) * (np.diff(room) > 0) if len(room) > 1 else room[:0]
    return link_a[used], link_b[used], cut[used], links


class Shard:
    """The texts of a shard, cut into units, and the tokens of its distinct units."""

    def __init__(self, texts: pa.Array, known: Vocabularies):
        empty = np.asarray(pc.fill_null(pc.equal(pc.binary_length(texts), 0), True))
        joined = pc.binary_join_element_wise(pa.scalar(" ", texts.type), pc.fill_null(texts, ""), pa.scalar("", texts.type))
        self.raw, self.offsets = flat.bytes_of(joined)
        starts = unit_starts(self.raw, self.offsets) if known.apart else self.offsets[:-1]
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(self.raw))), pa.py_buffer(self.raw)]).dictionary_encode()
        self.code = np.asarray(units.indices)
        self.tokens_a, self.tokens_b = known.encode(units.dictionary.to_pylist())
        self.first = np.searchsorted(starts, self.offsets)  # unit of each text
        whole = self.tokens_a.whole[self.code]
        broken = np.append(0, np.cumsum(~whole))
        self.gone = empty | (broken[self.first[1:]] > broken[self.first[:-1]])
        self.starts = starts

    def batches(self) -> Iterator[tuple[int, int, Batch]]:
        """(first document, one past the last, their alignment)."""
        low, n = 0, len(self.offsets) - 1
        while low < n:
            high = min(n, max(low + 1, int(np.searchsorted(self.offsets, self.offsets[low] + BATCH, side="right")) - 1))
            yield low, high, self._batch(low, high)
            low = high

    def _batch(self, low: int, high: int) -> Batch:
        units = np.arange(self.first[low], self.first[high])
        doc = np.repeat(np.arange(high - low), np.diff(self.first[low : high + 1]))
        kept = ~self.gone[low:high][doc]
        units, doc = units[kept], doc[kept]
        code, base = self.code[units], self.starts[units] - self.offsets[low:high][doc]
        sides = []
        for t in (self.tokens_a, self.tokens_b):
            place, size = _ragged(t.first, code)
            sides += [t.ids[place], (t.ends[place] + np.repeat(base, size)).astype(np.int64), np.append(0, np.cumsum(size))]
        a, a_end, a_unit, b, b_end, b_unit = sides
        edge = np.searchsorted(doc, np.arange(high - low + 1))  # unit of each document
        lane = np.unique(np.concatenate([edge, np.arange(len(units)) [(np.arange(len(units)) - edge[doc]) % LANE == 0]])) if len(units) else np.zeros(1, np.int64)
        link_a, link_b, cut, links = lockstep(a_end, b_end, a_unit[lane], b_unit[lane])
        total = np.append(0, np.cumsum(links))
        return Batch(a, a_end, a_unit[edge], b, b_end, b_unit[edge], link_a, link_b, cut, total[np.searchsorted(lane, edge)])


def digests(batch: Batch, names: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups, '' without tokens. ``names``: see :func:`_names`."""
    end_a, end_b = np.zeros(len(batch.a), bool), np.zeros(len(batch.b), bool)
    end_a[batch.link_a[batch.cut]] = True
    end_b[batch.link_b[batch.cut]] = True
    till_a, till_b = np.flatnonzero(end_a) + 1, np.flatnonzero(end_b) + 1
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    order = np.empty(len(batch.a) + len(batch.b), np.int64)
    order[np.arange(len(batch.a)) + np.append(0, till_b)[group_a]] = 3 * batch.a.astype(np.int64) + end_a
    order[np.arange(len(batch.b)) + till_a[group_b]] = 3 * batch.b.astype(np.int64) + 2 * end_b
    edge = batch.a_first + batch.b_first
    return [hashlib.sha256("".join(names[order[i:j]].tolist())[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]


def _names(size: int) -> np.ndarray:
    """Ids followed by a comma, a bar and a semicolon."""
    return np.array([f"{i}{mark}" for i in range(size) for mark in ",|;"], dtype=object)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by their lowest bytes, then the next ones, as many as the largest needs."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").ravel()


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows (doc_id, text) of about ``size`` bytes of text."""
    held, total = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < len(ends):
            done = int(ends[low - 1]) if low else 0
            high = min(len(ends), int(np.searchsorted(ends, done + size - total)) + 1)
            held.append(batch.slice(low, high - low))
            total += int(ends[high - 1]) - done
            low = high
            if total >= size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _texts(table: pa.Table) -> pa.Array:
    column = table.column("text").combine_chunks()
    return column.cast(pa.large_string()) if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks).cast(pa.large_string())


def _source(docs: DataFrame) -> DataFrame:
    return text_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def alignments(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Of every document: ids and end offsets (bytes, in the text with its space) of the tokens of both vocabularies, the
    links (numbers of an A and a B token, from 0) and the cuts (offsets at which both end)."""
    schema = "doc_id long, a array<int>, a_end array<long>, b array<int>, b_end array<long>, links array<struct<a:int,b:int>>, cuts array<long>"

    def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(a, b)
        for table in _shards(batches, SHARD):
            for low, high, x in Shard(_texts(table), known).batches():
                doc = np.repeat(np.arange(high - low), np.diff(x.first_link))
                pairs = pa.StructArray.from_arrays([pa.array((x.link_a - x.a_first[doc]).astype(np.int32)), pa.array((x.link_b - x.b_first[doc]).astype(np.int32))], names=["a", "b"])
                links = pa.ListArray.from_arrays(pa.array(x.first_link.astype(np.int32)), pairs)
                cuts = lists(x.a_end[x.link_a[x.cut]], np.append(0, np.cumsum(x.cut))[x.first_link])
                ids = table.column("doc_id").combine_chunks()
                columns = [ids.slice(low, high - low), lists(x.a, x.a_first), lists(x.a_end, x.a_first), lists(x.b, x.b_first), lists(x.b_end, x.b_first), links, cuts]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "a_end", "b", "b_end", "links", "cuts"])

    return _source(docs).mapInArrow(tidied(run), schema)


MADE = "shard long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, bucket int, ranks binary, keys binary, counts binary"
_MADE = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("links", pa.binary()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("ranks", "keys", "counts"))])


def _made(docs: DataFrame, a: str, b: str, buckets: int) -> DataFrame:
    """Rows of documents, whose links are ranks of id pairs in their shard, and rows (with a bucket) of the shards'
    pairs: their ranks, keys (A id * size of B + B id, in order) and counts."""

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _MADE], schema=_MADE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(a, b)
        names = _names(max(known.size_a, known.size_b))
        shard = TaskContext.get().partitionId() << 32
        for table in _shards(batches, SHARD):
            parts, keys = [], []
            for _, _, x in Shard(_texts(table), known).batches():
                groups = np.append(0, np.cumsum(x.cut))[x.first_link]
                parts.append((np.diff(x.a_first), np.diff(x.b_first), np.diff(groups), np.diff(x.first_link), digests(x, names)))
                keys.append(pa.array(x.a[x.link_a].astype(np.int64) * known.size_b + x.b[x.link_b]))
            coded = pa.chunked_array(keys).combine_chunks().dictionary_encode()
            del keys
            code, key = np.asarray(coded.indices), np.asarray(coded.dictionary)
            count = np.bincount(code, minlength=len(key))
            rank = np.empty(len(key), np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(key))
            code = rank[code]
            n_a, n_b, n_groups, n_links = (np.concatenate(c) for c in list(zip(*parts))[:4])
            first = np.append(0, np.cumsum(n_links)).tolist()
            yield rows(shard=[shard] * len(n_a), doc_id=table.column("doc_id").combine_chunks(), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=[d for p in parts for d in p[4]], links=[_planes(code[i:j]) for i, j in zip(first, first[1:])])
            bucket = key % known.size_b % buckets
            order = np.lexsort((key, bucket))
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
            every = [order[i:j] for i, j in zip(cuts, [*cuts[1:], len(order)])]
            yield rows(shard=[shard] * len(every), bucket=[int(bucket[o[0]]) for o in every], ranks=[_planes(rank[o]) for o in every], keys=[_planes(np.diff(key[o], prepend=0)) for o in every], counts=[_planes(count[o]) for o in every])
            shard += 1
            del coded, code, key, parts
            trimmed()

    return stage(_source(docs).mapInArrow(tidied(run), MADE), "aligned", "zstd")


def _added(cells: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of the cells, and the sums of their counts."""
    key = np.concatenate([np.cumsum(_numbers(k)) for k in cells.column("keys").to_pylist()])
    count = np.concatenate([_numbers(n) for n in cells.column("counts").to_pylist()])
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    return key[new], np.add.reduceat(count, new)


def _answered(cells: pa.Table, totals: pa.Table) -> pa.Table:
    """For each cell the corpus-wide counts of its pairs, and whether each is its B id's highest."""
    known, count, best = (_numbers(totals.column(c)[0].as_py()) for c in ("keys", "counts", "best"))
    known = np.cumsum(known)
    counts, bests = [], []
    for packed in cells.column("keys").to_pylist():
        at = np.searchsorted(known, np.cumsum(_numbers(packed)))
        counts.append(_planes(count[at]))
        bests.append(_planes(best[at]))
    trimmed()
    return cells.select(["shard", "ranks"]).append_column("counts", pa.array(counts, pa.binary())).append_column("best", pa.array(bests, pa.binary()))


def _closed(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """n_best and count_sum of the documents of a shard."""
    best, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if answers.num_rows:
        rank = np.concatenate([_numbers(x) for x in answers.column("ranks").to_pylist()])
        count, best = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        count[rank] = np.concatenate([_numbers(x) for x in answers.column("counts").to_pylist()])
        best[rank] = np.concatenate([_numbers(x) for x in answers.column("best").to_pylist()])
    n_best, sums = [], []
    for packed in docs.column("links").to_pylist():
        links = _numbers(packed)
        n_best.append(int(best[links].sum()))
        sums.append(int(count[links].sum()))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))
    out = out.append_column("groups_sha256", docs.column("groups_sha256"))
    trimmed()
    return out


def linked(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    ``a``, ``b``: paths of the vocabularies, readable on every executor. n_best: links whose pair has the highest count
    of its B id; count_sum: the counts of the pairs of all links, added."""
    shared_dir(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    made = _made(docs, a, b, size // BUCKET + 1)
    width = vocabularies(a, b).size_b
    groups = (made.filter("bucket is not null").agg(F.count_distinct("shard")).first()[0] or 0) // GROUP + 1
    cells = made.filter("bucket is not null").select("bucket", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("part"), "shard", "ranks", "keys", "counts")

    def partial(cells: pa.Table) -> pa.Table:
        key, count = _added(cells)
        return cells.select(["bucket"]).slice(0, 1).append_column("keys", pa.array([_planes(np.diff(key, prepend=0))], pa.binary())).append_column("counts", pa.array([_planes(count)], pa.binary()))

    def total(cells: pa.Table) -> pa.Table:
        key, count = _added(cells)
        highest = np.zeros(width, np.int64)
        np.maximum.at(highest, key % width, count)
        columns = [_planes(np.diff(key, prepend=0)), _planes(count), _planes(count == highest[key % width])]
        out = cells.select(["bucket"]).slice(0, 1)
        for name, column in zip(("keys", "counts", "best"), columns):
            out = out.append_column(name, pa.array([column], pa.binary()))
        return out

    sums = cells.groupBy("bucket", "part").applyInArrow(lambda t: partial(t), "bucket int, keys binary, counts binary")
    totals = sums.groupBy("bucket").applyInArrow(lambda t: total(t), "bucket int, keys binary, counts binary, best binary")
    totals = totals.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    answers = cells.groupBy("bucket", "part").cogroup(totals.groupBy("bucket", "part")).applyInArrow(lambda x, y: _answered(x, y) if x.num_rows else pa.table({"shard": pa.array([], pa.int64()), "ranks": pa.array([], pa.binary()), "counts": pa.array([], pa.binary()), "best": pa.array([], pa.binary())}), "shard long, ranks binary, counts binary, best binary")
    rows = made.filter("bucket is null").select("shard", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    return rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_closed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
