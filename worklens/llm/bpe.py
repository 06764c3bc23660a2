"""Token counts by byte-pair merging on a heap and a linked list.

Text is cut into pre-tokens by the vocabulary's pattern. The bytes of a pre-token form a doubly linked
list; a heap holds the adjacent pairs that have a merge rule, keyed by (rank, position). Popping the
lowest pair joins two symbols and pushes the pairs that newly touch. The count of a pre-token is its
number of bytes less the number of merges; identifiers are never made. Special strings inside texts
count as one token each, as the vocabulary's library has it by default.

Defined results: null text counts as empty (0 bytes, 0 tokens); null doc_id passes through; repeated
rows give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from worklens.llm.common import text_batches, tidied

#: Fixed value: the pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a worker keeps in each of two generations.
REMEMBERED = 400_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeCounter(dict):
    """Pre-token -> number of tokens, computed where missing."""

    def __init__(self, path: str):
        super().__init__()
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = _byte_of_char()
        symbol = lambda s: bytes(stand_in[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(symbol(a), symbol(b)): i for i, (a, b) in enumerate(pairs)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.older: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        n = self.older.get(token)
        if n is None:
            n = self.merged(token.encode("utf-8"))
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[token] = n
        return n

    def merged(self, data: bytes) -> int:
        """Symbols left once no adjacent pair has a rule."""
        n = count = len(data)
        if n < 2:
            return n
        ranks = self.ranks
        symbols: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            left = symbols[i]
            j = after[i]
            if left is None or j >= n or ranks.get((left, symbols[j])) != rank:
                continue
            left = symbols[i] = left + symbols[j]
            symbols[j] = None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((left, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], left))) is not None:
                heapq.heappush(heap, (r, h))
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.find(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.find(p))) for p in parts if p)


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    """One counter per worker process and vocabulary."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document.

    ``vocabulary``: path of a byte-level BPE file in JSON, readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8")) if t else 0 for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return text_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidied(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
