"""Phrases against a plain count over small tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from worklens.llm import phrases


def plain(rows, longest, least, percent, top):
    found = Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            for i in range(len(w)):
                for k in range(1, min(longest, len(w) - i) + 1):
                    found[lang or "und", tuple(w[i : i + k])] += 1
    out = []
    for lang in {k[0] for k in found}:
        f = {g: n for (own, g), n in found.items() if own == lang}
        candidates = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        hidden = set()
        for g, n in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    if 100 * n >= percent * f[g[i : i + k]]:
                        hidden.add(g[i : i + k])
        scored = []
        for g, a in candidates.items():
            if g not in hidden:
                score, _, left, right = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), left, right))
        total = sum(n for g, n in f.items() if len(g) == 1)
        out += [(lang, i, p.decode(), -a, left, right, total, -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(None, t, lang, 1) for t, lang in rows], "doc_id long, text string, lang string, phrase int")


def mined(df, **settings):
    return sorted(map(tuple, phrases.collocations(df, phrases.Settings(**settings)).collect()))


@pytest.mark.parametrize("longest,chunk,width", [(3, 1 << 30, 1 << 30), (3, 400, 900), (2, 300, 500), (4, 5000, 700)])
def test_equal_to_plain_counts(spark, longest, chunk, width):
    rng = random.Random(longest * chunk)
    some = ["a", "B", "b", "été", "ß", "of", "the", " x", "long" * 30]
    texts = ["".join(rng.choice(some) + rng.choice([" ", "  ", " \t", ", ", ".", "\n", " ", " "]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = [(t, rng.choice(["en", "de", None, "und"])) for t in texts] + [(None, "en"), ("", "fr"), (" . \t", "de"), ("one word", "xx")] + [("the same Text again", "en")] * 12
    got = mined(frame(spark, rows).repartition(3), longest=longest, least=3, chunk=chunk, range=width)
    assert got == plain(rows, longest, 3, 50, 2000)
    assert mined(frame(spark, rows), longest=longest, least=3, top=4, percent=90, range=width) == plain(rows, longest, 3, 90, 4)


def test_empty_table_and_large_counts(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(None, "en"), ("", None)])) == []
    text = "x y " * 4000
    assert mined(frame(spark, [(text, "en")])) == plain([(text, "en")], 3, 10, 50, 2000)


def test_transducers_share_states_and_give_back_their_windows():
    rng = np.random.default_rng(5)
    columns = [rng.integers(1, 6, 4000), rng.integers(0, 40, 4000), rng.integers(0, 9, 4000)]
    columns[2][columns[1] == 0] = 0
    windows, counts = phrases.counted(columns, None, 41)
    built = phrases.Transducer.built(windows, counts)
    size = [np.diff(layer[0]) for layer in built.layers]
    assert len(size[2]) < len(np.unique(windows[0] * 41 + windows[1]))
    back, again = phrases.counted(*built.paths(), 41)
    assert all((a == b).all() for a, b in zip(windows, back)) and (counts == again).all()


def test_rows_beyond_64_bits_are_counted_alike():
    rng = np.random.default_rng(6)
    columns = [rng.integers(0, 3, 500) for _ in range(3)]
    weights = rng.integers(1, 5, 500)
    for w in (None, weights):
        small, large = phrases.counted(columns, w, 3), phrases.counted(columns, w, 1 << 30)
        assert all((a == b).all() for a, b in zip(small[0], large[0])) and (small[1] == large[1]).all()
