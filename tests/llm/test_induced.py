"""Induced sorting against plainly sorted suffixes."""

import random

import numpy as np
import pytest

from worklens.llm import induced


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("room", [3, 1 << 20])
def test_order_and_common_prefixes(seed, room, monkeypatch):
    rng = random.Random(seed)
    if room == 3:
        monkeypatch.setattr(induced, "BLOCK", 7)
    text = [rng.randint(1, rng.choice([2, 4, 200])) for _ in range(rng.randint(0, 300))]
    if seed % 2:
        text = text + [3] * rng.randint(0, 120) + text[: len(text) // 2] + [1] + text
    data = np.array([*text, 0], np.uint8)
    blocks = list(induced.descending(data, 100, room))
    at = np.concatenate([b[0] for b in blocks]) if blocks else np.zeros(0, int)
    lcp = np.concatenate([b[1] for b in blocks]).tolist() if blocks else []
    suffixes = [bytes(data[i:]) for i in at]
    assert sorted(at.tolist()) == list(range(len(text)))
    assert [s[:100] for s in suffixes] == sorted((s[:100] for s in suffixes), reverse=True)
    assert lcp == [min(100, shared(a, b)) for a, b in zip([b"", *suffixes], suffixes)]


def test_recursion_on_names(monkeypatch):
    rng = random.Random(1)
    words = [[rng.randint(1, 3) for _ in range(rng.randint(2, 6))] + [9] for _ in range(6)]
    text = [x for _ in range(3000) for x in rng.choice(words)]
    data = np.array([*text, 0], np.uint8)
    depth, inner = [], induced.sorted_samples
    monkeypatch.setattr(induced, "sorted_samples", lambda *a: depth.append(1) or inner(*a))
    at = np.concatenate([b[0] for b in induced.descending(data, 60, 1000)])
    assert len(depth) > 1
    suffixes = [bytes(data[i : i + 60]) for i in at]
    assert suffixes == sorted(suffixes, reverse=True) and len(set(at.tolist())) == len(text)
