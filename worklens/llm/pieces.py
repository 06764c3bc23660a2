"""Sampled SentencePiece segmentations without replacement, and decoding.

The normalised text (a dummy prefix, spaces as U+2581) is a chain of words, each beginning at a space
mark. The pieces of the model span the lattice of a word, byte pieces standing in for characters it
lacks. BPE models give pieces ranks, not probabilities, so a piece of rank r weighs
``(1 / (r + 1)) ** alpha``; a segmentation weighs the product of its pieces' weights, and has the
probability its weight bears to the sum over the lattice.

The k segmentations of a text are those with the largest Gumbel-perturbed log probabilities, that is a
sample without replacement in order. A search tree of sets of segmentations is explored best first: the
root's perturbed maximum is drawn, the set whose maximum is largest is opened, a segmentation having
that maximum is drawn from the set and emitted, and the rest of the set is divided by the first word at
which a segmentation differs from the emitted one; the maxima of those subsets are drawn truncated at
the emitted value (the bounds of the A-star search are thus exact). The k+1-st maximum is the threshold
for the inclusion scores ``1 - exp(-exp(log p - threshold))``. Random numbers are seeded by the row's
doc_id and the seed parameter, so results do not depend on partitions.

Pieces of several space marks, which such models score -1e9, are not used. Defined results: null and
empty texts have one segmentation, of the dummy prefix alone; texts with fewer than k segmentations give
all of them, with inclusion 1; a null doc_id is a row key of its own; rows with the same doc_id are seeded
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Collection, Generator, Iterator
from functools import lru_cache
from itertools import chain, repeat
from math import exp, expm1, inf, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from worklens.llm.common import text_batches, tidied, trimmed
from worklens.llm.flat import mix64

MARK = "▁"
#: So many words, and those of one batch, are the most of which a worker keeps the best paths.
REMEMBERED = 200_000


#: Length of the longest words whose best paths are found many at a time.
WIDE = 40
CHUNK = 2048
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_POWERS = np.cumprod(np.array([1] + [int(_BASE)] * (WIDE + 1), np.uint64), dtype=np.uint64)


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def gumbel(rng: np.random.Generator, location: float) -> float:
    return location - log(-log(rng.random() or 5e-324))


def truncated_gumbel(rng: np.random.Generator, location: float, bound: float) -> float:
    """A Gumbel variable of the given location, given that it is at most ``bound``."""
    if bound == inf:
        return gumbel(rng, location)
    return location - log(exp(location - bound) - log(rng.random() or 5e-324)) if location - bound < 700 else bound


def log_sum(terms: list[float]) -> float:
    top = max(terms, default=-inf)
    return top if top == -inf else top + log(sum(exp(t - top) for t in terms))


class Lattice:
    """The lattice of one word: for each reachable offset its edges (log probability, next offset, ids).
    ``log_other``: log probability of all segmentations but the best, -inf only where there is no other."""

    __slots__ = ("edges", "best", "log_best", "log_other")

    def __init__(self, edges: list, best: bytes, log_best: float, log_other: float):
        self.edges, self.best, self.log_best, self.log_other = edges, best, log_best, log_other

    def drawn(self, rng: np.random.Generator, at: int = 0) -> bytes:
        """Ids of a segmentation of what follows an offset."""
        out = []
        while at < len(self.edges):
            edge = self._chosen(rng, [e[0] for e in self.edges[at]])
            _, at, ids = self.edges[at][edge]
            out.append(ids)
        return b"".join(out)

    @staticmethod
    def _chosen(rng: np.random.Generator, terms: list[float]) -> int:
        """An index, drawn by log weights of which one at least is finite."""
        if len(terms) == 1:
            return 0
        top = max(terms)
        weights = [exp(t - top) for t in terms]
        u, last = rng.random() * sum(weights), 0
        for i, w in enumerate(weights):
            if w > 0:
                u, last = u - w, i
                if u < 0:
                    break
        return last

    def likeliest(self) -> Iterator[tuple[float, bytes]]:
        """(probability, ids) of all segmentations, likeliest first: A-star with exact bounds, all equal to the
        probability of the part so far, since edges carry conditional probabilities."""
        heap = [(0.0, 0, b"")]
        while heap:
            p, at, ids = heapq.heappop(heap)
            if at == len(self.edges):
                yield exp(-p), ids
            else:
                for q, till, more in self.edges[at]:
                    heapq.heappush(heap, (p - q, till, ids + more))

    def _path(self, ids: bytes, lengths: dict[bytes, int]) -> list[int]:
        """The edges, by their number at each offset, of a segmentation given by its ids."""
        at, i, path = 0, 0, []
        while at < len(self.edges):
            for n, (_, till, edge) in enumerate(self.edges[at]):
                if ids.startswith(edge, i) and lengths.get(edge, 1) == till - at:
                    path.append(n)
                    at, i = till, i + len(edge)
                    break
            else:
                raise ValueError(f"no segmentation of this word: {list(array('H', ids))}")
        return path

    def log_probability(self, ids: bytes, lengths: dict[bytes, int]) -> float:
        """Of a segmentation given by its ids."""
        if ids == self.best:
            return self.log_best
        at, total = 0, 0.0
        for n in self._path(ids, lengths):
            p, at, _ = self.edges[at][n]
            total += p
        return total

    def _without(self, banned: Collection[bytes], lengths: dict[bytes, int]) -> tuple[dict, list, list, list]:
        """The beginnings of the banned segmentations as a tree: children by (node, edge), -1 where one ends; of each
        node the offset, the log weights of the edges that follow, and their sum, all without the banned ones.
        Nothing is subtracted, so small masses stay exact."""
        child: dict = {}
        where = [0]
        for ids in set(banned):
            node = at = 0
            for n in self._path(ids, lengths):
                at = self.edges[at][n][1]
                if at == len(self.edges):
                    child[node, n] = -1
                elif (node, n) in child:
                    node = child[node, n]
                else:
                    child[node, n] = len(where)
                    node = len(where)
                    where.append(at)
        weights, total = [()] * len(where), [-inf] * len(where)
        for node in range(len(where) - 1, -1, -1):
            terms = []
            for n, (p, _, _) in enumerate(self.edges[where[node]]):
                further = child.get((node, n))
                terms.append(p if further is None else -inf if further < 0 else p + total[further])
            weights[node], total[node] = terms, log_sum(terms)
        return child, where, weights, total

    def log_without(self, banned: Collection[bytes], lengths: dict[bytes, int]) -> float:
        """Log probability of all segmentations but the banned ones; -inf only if there is no other."""
        if len(banned) == 1 and self.best in banned:
            return self.log_other
        return self._without(banned, lengths)[3][0]

    def drawn_without(self, rng: np.random.Generator, banned: Collection[bytes], lengths: dict[bytes, int]) -> bytes | None:
        """Ids of a segmentation other than the banned ones, or None if there is none."""
        child, where, weights, total = self._without(banned, lengths)
        if total[0] == -inf:
            return None
        node, out = 0, []
        while node is not None:
            n = self._chosen(rng, weights[node])
            _, at, ids = self.edges[where[node]][n]
            out.append(ids)
            node = child.get((node, n))
        return b"".join(out) + self.drawn(rng, at)


class Drawn(NamedTuple):
    """A segmentation of a word other than the best one: its ids, its log probability, and those of all but it, and of
    all but it and the best one."""

    ids: bytes
    log_probability: float
    log_other: float
    log_both: float


class Known:
    """The best paths of words: ids, log probability, and that of all other segmentations, by the word's number."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.best: list[bytes] = []
        self.log_best, self.log_other = np.empty(0), np.empty(0)

    def __getitem__(self, word: str) -> tuple[bytes, float, float]:
        i = self.number[word]
        return self.best[i], float(self.log_best[i]), float(self.log_other[i])

    def add(self, words: list[str], best: list[bytes], log_best: np.ndarray, log_other: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.best), len(self.best) + len(words))))
        self.best += best
        self.log_best, self.log_other = np.concatenate([self.log_best, log_best]), np.concatenate([self.log_other, log_other])

    def only(self, words: Collection[str]) -> Known:
        """Those of the words that are known."""
        out, words = Known(), [w for w in words if w in self.number]
        at = [self.number[w] for w in words]
        out.add(words, [self.best[i] for i in at], self.log_best[at], self.log_other[at])
        return out


class Tables(NamedTuple):
    """Of plain words, by offset and word: the length of the best edge (the longest of equal ones), its id, the log share
    of that edge, and of all others; of what begins there, the log probability of the best path and of all others. Where
    asked for, also the log mass of what begins with an edge, by offset, length of the edge less one, and word, and ids."""

    size: np.ndarray
    edge: np.ndarray
    best: np.ndarray
    share: np.ndarray
    rest: np.ndarray
    log_best: np.ndarray
    log_other: np.ndarray
    terms: np.ndarray | None
    ids: np.ndarray | None


def _uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    """Numbers from 0 to 1, one for each seed and step."""
    return (mix64(seeds + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) * 2.0**-53


def _log_total(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=1)
    return top + np.log(np.exp(terms - top[:, None]).sum(axis=1))


def _shares(terms: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log share of the chosen edge, of all others) in each row of log masses. Nothing is subtracted from 1."""
    rows = np.arange(len(terms))
    others = terms.copy()
    own = terms[rows, chosen]
    others[rows, chosen] = -np.inf
    top = others.max(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        rest = np.where(top > -np.inf, top + np.log(np.exp(others - top[:, None]).sum(axis=1)), -np.inf)
        total = np.logaddexp(own, rest)
        return np.where(own > -np.inf, own - total, 0.0), np.where(rest > -np.inf, rest - total, -np.inf)


class Model:
    """Pieces of a SentencePiece model, and its words' lattices."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.alpha = alpha
        self.weight: dict[str, float] = {}
        self.id: dict[str, bytes] = {}
        self.surface: list[bytes] = []
        self.bytes_id: list[bytes] = [b""] * 256
        for i in range(own.get_piece_size()):
            piece = own.id_to_piece(i)
            packed = array("H", [i]).tobytes()
            if own.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = packed
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif own.is_control(i) or own.is_unknown(i):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace(MARK, " ").encode("utf-8"))
                if MARK not in piece[1:]:
                    self.weight[piece] = -alpha * log(1.0 - own.get_score(i))
                    self.id[piece] = packed
        self.byte_weight = -alpha * log(1.0 + own.get_piece_size())
        self.longest = max(map(len, self.weight))
        self.starts: dict[str, int] = {}
        for piece in self.weight:
            for n in range(1, len(piece) + 1):
                self.starts.setdefault(piece[:n], 0)
        self.lengths = {v: len(k) for k, v in self.id.items()}
        self.singles = {piece for piece in self.weight if len(piece) == 1}
        hashes = np.array([_hash_of(piece) for piece in self.weight], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.hash_weights = np.array(list(self.weight.values()))[order]
        self.hash_ids = np.frombuffer(b"".join(self.id.values()), np.uint16)[order]
        # by 20 bits of their hashes times a factor; those that find their slot taken go to a further table
        self.slots: list[tuple[np.uint64, np.ndarray]] = []
        homeless = np.arange(len(self.hashes))
        for factor in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9):
            slots = np.full(1 << 20, -1, np.int32)
            slot = self.hashes[homeless] * np.uint64(factor) >> np.uint64(44)
            slots[slot] = homeless
            homeless = homeless[slots[slot] != homeless]
            self.slots.append((np.uint64(factor), slots))
        if len(homeless):
            raise ValueError("pieces of equal hashes")
        self.surfaces = pa.array(self.surface, pa.large_binary())
        self.words = Known()
        self.recent: dict[str, Lattice] = {}

    def lattice(self, word: str, best: bytes | None = None) -> Lattice:
        """The lattice of a word; ``best``: ids of the path to list first, where known."""
        n, weight, starts, ids_of = len(word), self.weight, self.starts, self.id
        beta = [0.0] * (n + 1)
        edges: list = [()] * n
        for i in range(n - 1, -1, -1):
            found = []
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = word[i:j]
                if piece not in starts:
                    break
                w = weight.get(piece)
                if w is not None:
                    found.append((w + beta[j], j, ids_of[piece]))
            if not found or found[0][1] > i + 1:
                data = word[i].encode("utf-8", "surrogatepass")
                found.append((self.byte_weight * len(data) + beta[i + 1], i + 1, b"".join(self.bytes_id[b] for b in data)))
            if len(found) == 1:
                beta[i] = found[0][0]
                edges[i] = ((0.0, found[0][1], found[0][2]),)
            else:
                found.sort(reverse=True)
                top = found[0][0]
                total = log(sum(exp(f[0] - top) for f in found))
                beta[i] = top + total
                edges[i] = tuple((f[0] - top - total, f[1], f[2]) for f in found)
        at, path, lp, i, other = 0, [], 0.0, 0, []
        while at < n:
            if best is not None:
                edges[at] = tuple(sorted(edges[at], key=lambda e: not (best.startswith(e[2], i) and self.lengths.get(e[2], 1) == e[1] - at)))
            other += [lp + e[0] for e in edges[at][1:]]
            p, at, ids = edges[at][0]
            lp += p
            path.append(ids)
            i += len(ids)
        return Lattice(edges, b"".join(path), lp, log_sum(other))

    def learn(self, words: Collection[str]) -> None:
        """Have the best paths of these words, which are distinct, in ``self.words``."""
        plain, odd = [], []
        for w in words:
            if w not in self.words.number:
                (plain if len(w) <= WIDE and self.singles.issuperset(w) else odd).append(w)
        plain.sort(key=len)  # so that words of a chunk are of about one length
        for at in range(0, len(plain), CHUNK):
            self.words.add(plain[at : at + CHUNK], *self._best_paths(plain[at : at + CHUNK]))
        found = [self.lattice(w) for w in odd]
        self.words.add(odd, [x.best for x in found], np.array([x.log_best for x in found]), np.array([x.log_other for x in found]))

    def forget(self) -> None:
        """Drop what was learned of words; a worker that Spark keeps should not hold it through other stages."""
        self.words = Known()
        self.recent.clear()

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the places at which the hash is a piece's, the pieces' numbers)."""
        places, pieces, where = [], [], None
        for factor, slots in self.slots:
            at = slots.take((h * factor >> np.uint64(44)).view(np.int64))
            taken = np.flatnonzero(at >= 0)
            h, at, where = h[taken], at[taken], taken if where is None else where[taken]
            same = self.hashes[at] == h
            places.append(where[same])
            pieces.append(at[same])
            h, where = h[~same], where[~same]
            if not len(where):
                break
        return np.concatenate(places), np.concatenate(pieces)

    def _tables(self, words: list[str], whole: bool = False) -> Tables:
        """Substrings are looked up by rolling hashes, for all words together. ``whole``: with all edges."""
        n, wide = len(words), max(map(len, words))
        size = np.fromiter(map(len, words), np.int64, n)
        letters = np.array(words, dtype=f"U{wide}").view(np.uint32).reshape(n, wide).T
        hashed = np.zeros((wide + 1, n), np.uint64)
        for i in range(wide):
            hashed[i + 1] = hashed[i] * _BASE + letters[i] + np.uint64(1)
        reach, shortest, column = min(self.longest, wide), size.min(), np.arange(n)
        beta, log_best, log_other = np.zeros((wide + 1, n)), np.zeros((wide + 1, n)), np.full((wide + 1, n), -np.inf)
        edge, best = np.zeros((wide, n), np.int64), np.zeros((wide, n), np.uint16)
        share, rest = np.zeros((wide, n)), np.full((wide, n), -np.inf)
        terms = np.full((wide, reach, n), -np.inf) if whole else None
        ids = np.zeros((wide, reach, n), np.uint16) if whole else None
        steps = np.arange(1, reach + 1, dtype=np.uint8)[:, None]
        for i in range(wide - 1, -1, -1):
            w = min(reach, wide - i)
            at, piece = self._found((hashed[i + 1 : i + w + 1] - hashed[i] * _BASE_POWERS[1 : w + 1, None]).ravel())
            if i + w > shortest:
                inside = at // n + i < size[at % n]
                at, piece = at[inside], piece[inside]
            mass, name = np.full((w, n), -np.inf), np.zeros((w, n), np.uint16)
            mass.ravel()[at] = self.hash_weights[piece] + beta[i + 1 : i + w + 1].ravel()[at]
            name.ravel()[at] = self.hash_ids[piece]
            if whole:
                terms[i, :w], ids[i, :w] = mass, name
            top = mass.max(axis=0)
            length = ((mass == top) * steps[:w]).max(axis=0).astype(np.int64)
            best[i] = name[length - 1, column]
            mass[length - 1, column] = -np.inf
            peak = mass.max(axis=0)
            with np.errstate(invalid="ignore", divide="ignore"):
                others = np.where(peak > -np.inf, peak + np.log(np.exp(mass - peak).sum(axis=0)), -np.inf)
                more = np.log1p(np.exp(others - top))
            on = i < size
            edge[i] = length
            beta[i] = np.where(on, top + more, 0.0)
            share[i] = np.where(on, -more, 0.0)
            rest[i] = np.where(on, others - beta[i], -np.inf)
            log_best[i] = share[i] + np.where(on, log_best[i + length, column], 0.0)
            log_other[i] = np.where(on, np.logaddexp(rest[i], share[i] + log_other[i + length, column]), -np.inf)
        return Tables(size, edge, best, share, rest, log_best, log_other, terms, ids)

    def _best_paths(self, words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """As :meth:`lattice` finds them, for many words at once."""
        own = self._tables(words)
        wide, n = own.edge.shape
        at, count, paths = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, wide), np.uint16)
        on, t = np.arange(n), 0
        while len(on := on[at[on] < own.size[on]]):
            here = at[on]
            paths[on, t] = own.best[here, on]
            at[on] += own.edge[here, on]
            t += 1
            count[on] = t
        packed, width = paths.tobytes(), 2 * wide
        return [packed[a : a + 2 * c] for a, c in zip(range(0, n * width, width), count.tolist())], own.log_best[0], own.log_other[0]

    def drawn_others(self, asked: list[tuple[str, int]]) -> list[Drawn]:
        """For each word and seed a segmentation other than the word's best one, drawn by its probability."""
        out: list = [None] * len(asked)
        plain, odd = [], []
        for i, (w, _) in enumerate(asked):
            (plain if len(w) <= WIDE and self.singles.issuperset(w) else odd).append(i)
        for i in odd:
            word, seed = asked[i]
            lattice = self.lattice(word)
            ids = lattice.drawn_without(np.random.Generator(np.random.Philox(key=seed)), (lattice.best,), self.lengths)
            out[i] = Drawn(ids, lattice.log_probability(ids, self.lengths), lattice.log_without((ids,), self.lengths), lattice.log_without((ids, lattice.best), self.lengths))
        plain.sort(key=lambda i: len(asked[i][0]))
        for a in range(0, len(plain), CHUNK):
            part = plain[a : a + CHUNK]
            names = list({asked[i][0]: None for i in part})
            number = {w: i for i, w in enumerate(names)}
            seeds = np.array([asked[i][1] for i in part], np.uint64)
            for i, found in zip(part, self._drawn(names, np.array([number[asked[i][0]] for i in part]), seeds)):
                out[i] = found
        return out

    def _drawn(self, names: list[str], word: np.ndarray, seeds: np.ndarray) -> Iterator[Drawn]:
        """A segmentation of ``names[word]`` for each seed: it follows the best one up to a step drawn by the mass that
        leaves the best one there, takes another edge, and goes on freely."""
        own = self._tables(names, whole=True)
        size, terms, ids, best = own.size, own.terms, own.ids, own.edge - 1
        wide, reach, n = terms.shape
        # what leaves the best path at each of its steps
        leaves, at, lp = np.full((wide, n), -np.inf), np.zeros(n, np.int64), np.zeros(n)
        on, t = np.arange(n), 0
        while len(on := on[at[on] < size[on]]):
            here = at[on]
            leaves[t, on] = lp[on] + own.rest[here, on]
            lp[on] += own.share[here, on]
            at[on] += own.edge[here, on]
            t += 1
        mine = leaves[:, word]
        odds = np.cumsum(np.exp(mine - mine.max(axis=0)), axis=0)
        turn = np.minimum((odds <= _uniform(seeds, 0) * odds[-1]).sum(axis=0), wide - 1)
        at, lp, other, both, count = np.zeros(len(word), np.int64), np.zeros(len(word)), np.full(len(word), -np.inf), np.full(len(word), -np.inf), np.zeros(len(word), np.int64)
        paths = np.zeros((len(word), wide), np.uint16)
        on, t = np.arange(len(word)), 0
        while len(on := on[at[on] < size[word[on]]]):
            here, w = at[on], word[on]
            edge, share, rest = best[here, w], own.share[here, w], own.rest[here, w]
            apart = rest.copy()
            free = np.flatnonzero(turn[on] <= t)  # the others follow the best one
            if len(free):
                weights = terms[here[free], :, w[free]]
                open_to = weights.copy()
                turning = np.flatnonzero(turn[on[free]] == t)
                open_to[turning, edge[free[turning]]] = -np.inf
                odds = np.cumsum(np.exp(open_to - open_to.max(axis=1, keepdims=True)), axis=1)
                chosen = np.minimum((odds <= (_uniform(seeds[on[free]], t + 1) * odds[:, -1])[:, None]).sum(axis=1), reach - 1)
                edge[free] = chosen
                share[free], rest[free] = _shares(weights, chosen)
                apart[free] = rest[free]
                open_to[turning, chosen[turning]] = -np.inf
                peak, total = open_to[turning].max(axis=1), _log_total(weights[turning])
                with np.errstate(invalid="ignore", divide="ignore"):
                    apart[free[turning]] = np.where(peak > -np.inf, peak + np.log(np.exp(open_to[turning] - peak[:, None]).sum(axis=1)) - total, -np.inf)
            other[on] = np.logaddexp(other[on], lp[on] + rest)
            both[on] = np.logaddexp(both[on], lp[on] + apart)
            both[on] = np.logaddexp(both[on], np.where(turn[on] < t, mine[t, on], -np.inf))
            lp[on] += share
            paths[on, count[on]] = ids[here, edge, w]
            count[on] += 1
            at[on] += edge + 1
            t += 1
        # steps of the best path after the drawn one has ended
        late = np.where(np.arange(wide)[:, None] >= np.maximum(count, turn + 1), mine, -np.inf)
        both = np.logaddexp(both, np.logaddexp.reduce(late, axis=0))
        packed, width = paths.tobytes(), 2 * wide
        for i, (c, *rest) in enumerate(zip(count.tolist(), lp.tolist(), other.tolist(), both.tolist())):
            yield Drawn(packed[i * width : i * width + 2 * c], *rest)

    @staticmethod
    def split(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct words of the normalised texts, each with its space mark; the words of all texts by their numbers
        there; where each text begins among these, and the end). A line end, which no piece contains, is a word too."""
        found = pc.replace_substring(pa.array([t or "" for t in texts], pa.large_string()), MARK, " ")
        found = pc.replace_substring(pc.replace_substring(found, "\n", f"\n{MARK}{MARK}\n"), " ", "\n" + MARK)  # two marks: a line end
        found = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), found, pa.scalar("", pa.large_string())), "\n")
        words = found.flatten().dictionary_encode()
        at, names = words.indices.to_numpy(), ["\n" if w == MARK + MARK else w for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
        full = at != names.index("") if "" in names else np.ones(len(at), bool)  # none follows a line end
        return names, at[full], np.concatenate([[0], np.cumsum(full)])[found.offsets.to_numpy()]

    def samples(self, text: str | None, key: bytes, k: int) -> list[tuple[float, float, float, bytes]]:
        """Up to k of (perturbed, log probability, inclusion, ids), in the order in which they were drawn."""
        return self.many_samples([text], [key], k)[0]

    def many_samples(self, texts: list[str | None], keys: list[bytes], k: int) -> list[list[tuple[float, float, float, bytes]]]:
        """:meth:`samples` of each text by its own key; the draws that the texts' searches ask for are made together."""
        names, word, ends = self.split(texts)
        if len(self.words.best) > REMEMBERED:
            self.words = self.words.only(names)
        self.learn([w for w in names if w])
        number = self.words.number
        at = np.fromiter(map(number.get, names, repeat(-1)), np.int64, len(names))[word]
        log_best, log_other = self.words.log_best[at], self.words.log_other[at]
        results: list = [None] * len(texts)
        waiting = []
        for i, key in enumerate(keys):
            own = slice(ends[i], ends[i + 1])
            best = list(map(self.words.best.__getitem__, at[own].tolist()))
            waiting.append((i, self._search(names, word[own], best, log_best[own], log_other[own], key, k), None))
        while waiting:
            asked, going = [], []
            for i, search, answer in waiting:
                try:
                    wanted = search.send(answer)
                except StopIteration as end:
                    results[i] = end.value
                else:
                    going.append((i, search, len(asked), len(asked) + len(wanted)))
                    asked += wanted
            found = self.drawn_others(asked)
            waiting = [(i, search, found[a:b]) for i, search, a, b in going]
        return results

    def _search(self, names: list[str], word: np.ndarray, base: list[bytes], log_best: np.ndarray, log_other: np.ndarray, key: bytes, k: int) -> Generator[list[tuple[str, int]], list[Drawn], list]:
        """The search of one text, of the words ``names[word]``. It yields (word, seed) pairs, is sent their :class:`Drawn`, and returns the samples."""
        seed = np.frombuffer(hashlib.blake2b(key, digest_size=16).digest(), np.uint64)
        rng = np.random.Generator(np.random.Philox(key=seed))
        chance = np.exp(log_other)

        def lattice(i: int) -> Lattice:
            found = self.recent.get(names[word[i]])
            if found is None:
                if len(self.recent) >= 10_000:
                    self.recent.clear()
                found = self.recent[names[word[i]]] = self.lattice(names[word[i]], base[i])
            return found

        # an entry: (-maximum, tie, emitted path, log mass of the subsets by word, first word, banned there)
        heap: list = []
        ties = 0

        def divided(bound: float, path: dict, masses: np.ndarray, first: int, banned: tuple) -> None:
            nonlocal ties
            top = masses.max() if len(masses) else -inf
            if top == -inf:
                return
            location = float(top + log(np.exp(masses - top).sum()))
            ties += 1
            heapq.heappush(heap, (-truncated_gumbel(rng, location, bound), ties, path, masses, first, banned))

        def emitted(value: float, prefix: dict, first: int, banned: tuple) -> Generator:
            """Draw a path that keeps the prefix before word ``first``, where it avoids the banned; then divide.
            A path holds what was drawn at words where it leaves their best segmentations."""
            path: dict[int, Drawn] = {i: d for i, d in prefix.items() if i < first}
            start, left, places = first, -inf, []
            if banned == (base[first],):
                places, start = [first], first + 1
            elif banned:
                start, own = first + 1, lattice(first)
                ids = own.drawn_without(rng, banned, self.lengths)
                if ids is None:
                    return
                left = own.log_without((*banned, ids), self.lengths)
                if ids != base[first]:
                    path[first] = Drawn(ids, own.log_probability(ids, self.lengths), own.log_without((ids,), self.lengths), 0.0)
            places += (np.flatnonzero(rng.random(len(word) - start) < chance[start:]) + start).tolist()
            seeds = rng.integers(1 << 64, size=len(places), dtype=np.uint64).tolist()
            path.update(zip(places, (yield [(names[i], seed) for i, seed in zip(word[places].tolist(), seeds)])))
            each, other = log_best.copy(), log_other.copy()
            for i, own in path.items():
                each[i], other[i] = own.log_probability, own.log_other
            out.append((value, float(each.sum()), path))
            before = np.cumsum(each) - each
            masses = before[first:] + other[first:]
            if banned:
                masses[0] = before[first] + (path[first].log_both if banned == (base[first],) else left)
            divided(value, path, masses, first, banned)

        out: list = []
        yield from emitted(gumbel(rng, 0.0), {}, 0, ())
        while len(out) < k and heap:
            negative, _, path, masses, first, banned = heapq.heappop(heap)
            odds = np.cumsum(np.exp(masses - masses.max()))
            i = min(int(np.searchsorted(odds, rng.random() * odds[-1], side="right")), len(masses) - 1)
            rest = masses.copy()
            rest[i] = -inf
            divided(-negative, path, rest, first, banned)
            at = first + i
            yield from emitted(-negative, path, at, (*(banned if i == 0 else ()), path[at].ids if at in path else base[at]))
        threshold = -heap[0][0] if heap else -inf
        results = []
        for value, lp, path in out[:k]:
            ids = base
            if path:
                ids = list(base)
                for i, own in path.items():
                    ids[i] = own.ids
            inclusion = 1.0 if threshold == -inf else -expm1(-exp(min(lp - threshold, 700.0)))
            results.append((value, lp, inclusion, b"".join(ids)))
        return results

    def spelled(self, packed: list[bytes], texts: list[bytes]) -> list[bool]:
        """Whether each row of ids spells its text, in UTF-8."""
        ids = np.frombuffer(b"".join(packed), np.uint16)
        found = self.surfaces.take(pa.array(ids))
        offsets, data = np.frombuffer(found.buffers()[1], np.int64, len(ids) + 1), found.buffers()[2].to_pybytes()
        ends = offsets[np.cumsum([0] + [len(p) // 2 for p in packed])].tolist()
        return [data[a + 1 : b] == text for a, b, text in zip(ends, ends[1:], texts)]

    def decoded(self, ids: bytes) -> str:
        """The text that the ids spell, without the dummy prefix."""
        return b"".join(map(self.surface.__getitem__, array("H", ids)))[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str, alpha: float) -> Model:
    """One model per worker process."""
    return Model(path, alpha)


def sample(docs: DataFrame, path: str, k: int = 2, alpha: float = 8.0, seed: int = 0, ids: bool = True) -> DataFrame:
    """A row per document and sampled segmentation: doc_id, rank (from 1), n_pieces, log_prob, perturbed,
    inclusion, ids_sha256, decoded_ok (the ids spell the text, space marks in it read as spaces), and the ids
    themselves unless ``ids`` is false. ``path``: of the model, readable on every executor."""
    names = ["doc_id", "rank", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_sha256", "decoded_ok", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path, alpha)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, plain, texts, doc_ids = [], [], part.column(1).to_pylist(), part.column(0).to_pylist()
                found = own.many_samples(texts, [f"{seed}:{d}".encode() for d in doc_ids], k)
                for doc_id, text, drawn in zip(doc_ids, texts, found):
                    plain += [(text or "").replace(MARK, " ").encode()] * len(drawn)
                    for i, (value, lp, inclusion, packed) in enumerate(drawn):
                        rows.append((doc_id, i + 1, len(packed) // 2, lp, value, inclusion, hashlib.sha256(packed).hexdigest(), packed))
                *cols, packed = zip(*rows)
                cols.append(own.spelled(packed, plain))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
                arrays = [pa.array(c, t) for c, t in zip(cols, types)]
                if ids:
                    ends = np.cumsum([0] + [len(p) // 2 for p in packed]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.uint16).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            trimmed()
        own.forget()

    schema = "doc_id long, rank int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_sha256 string, decoded_ok boolean" + ", ids array<int>" * ids
    return text_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidied(run), schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, rank, text) of rows with ``ids``; null ids give null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path, 1.0)
        for batch in batches:
            texts = [None if i is None else own.decoded(array("H", i).tobytes()) for i in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "rank", "text"])

    return rows.selectExpr("cast(doc_id as bigint) doc_id", "cast(rank as int) rank", "ids").mapInArrow(tidied(run), "doc_id long, rank int, text string")
