"""Substring deduplication against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from worklens.llm import repeats


def plain(rows, length):
    """rows: (doc_id, text) in stored order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, gone = set(), {}
    for i in order:
        data = (rows[i][1] or "").encode()
        marks = bytearray(len(data))
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                marks[at : at + length] = b"\1" * length
            seen.add(window)
        gone[i] = marks
    out = []
    for i, (doc_id, text) in enumerate(rows):
        data, marks = (text or "").encode(), gone[i]
        kept = bytes(b for b, m in zip(data, marks) if not m)
        spans = sum(1 for j, m in enumerate(marks) if m and (not j or not marks[j - 1]))
        out.append((doc_id, len(data), sum(marks), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, chunk int, shard string").coalesce(1)


def removed(spark, rows, **settings):
    return sorted(map(tuple, repeats.digests(frame(spark, rows), repeats.Settings(**settings)).collect()), key=str)


def made(rng, n, alphabet="ab é\n"):
    text = lambda k: "".join(rng.choices(alphabet, k=k))
    passages = [text(rng.randint(20, 400)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else text(rng.randint(0, 200)) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([None, i, i // 2, -i]), "".join(parts)))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "-" * 700), (5, "ab" * 300), (2, rows[3][1]), (n + 4, rows[3][1]), (None, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,settings", [(1, {}), (2, dict(chunk=3000, bucket=4000, shard=5000, hot=3, room=50)), (3, dict(length=30, gram=13, chunk=2000, shard=3000, hot=2)), (4, dict(length=24, gram=24, hot=1))])
def test_equal_to_all_windows(spark, seed, settings):
    rng = random.Random(seed)
    rows = made(rng, 60, "abcdefghij klmnop" if seed % 2 else "ab é\n")
    assert removed(spark, rows, **settings) == plain(rows, settings.get("length", 100))


def test_long_text_and_blocks(spark, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=5000))
    text = passage + "".join(rng.choices("xyz ", k=3000)) + passage[100:4000] + "-" * 3000
    rows = [(1, text), (2, passage + "tail"), (0, passage[50:300])]
    assert removed(spark, rows) == plain(rows, 100)
    whole = list(repeats.windows(pa.array([text]), repeats.Settings()))
    monkeypatch.setattr(repeats, "BLOCK", 500)
    parts = list(repeats.windows(pa.array([text]), repeats.Settings()))
    assert len(whole) == 1 and len(parts) > 10
    each = lambda found: np.concatenate([np.repeat(w.anchor, w.count) for _, _, w in found])
    assert (each(whole) == each(parts)).all() and len(each(whole)) == len(text) - 99


def test_empty_table_and_spans(spark):
    empty = repeats.digests(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    text = "".join(random.Random(2).choices("abcdefg", k=150))
    left = {r.doc_id: r for r in repeats.remove(frame(spark, [(2, "+++" + text + "+"), (1, text)])).collect()}
    assert [tuple(x) for x in left[2].spans] == [(3, 153)] and bytes(left[2].kept) == b"++++" and left[1].spans == []
