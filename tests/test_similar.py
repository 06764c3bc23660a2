"""Bounds of the similarity, and the pairs that are verified."""

import random

import pytest
from pyspark.sql import functions as F

from worklens.functions.similarity import token_set_similarity
from worklens.operators import similar

WORDS = ["road", "of", "the", "hall", "construction", "repair", "ward", "12", "school", "été", "cc", "drain", "tank", "a", "wall"]


def texts_of(rng, n, low=0, high=9):
    return [" ".join(rng.choices(WORDS, k=rng.randint(low, high))) for _ in range(n)]


def test_bounds_are_not_below_the_similarity(spark):
    rng = random.Random(4)
    pairs = [(a, b) for a, b in zip(texts_of(rng, 400), texts_of(rng, 400))] + [("", "a"), ("a", ""), ("x y", "y x"), ("a" * 300, "b" + "a" * 250), ("aab", "abb"), ("é" * 40 + " 漢字", "漢字 e")]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    found = similar.bounded(similar.profiled(similar.profiled(frame, "a", "p"), "b", "q"), "p", "q").select("i", "bound").collect()
    exact = {i: token_set_similarity(a, b) for i, (a, b) in enumerate(pairs)}
    assert all(r.bound >= exact[r.i] for r in found) and len(found) == len(pairs)
    assert sum(r.bound == exact[r.i] for r in found) > 50 and sum(r.bound < 55 for r in found) > 50


@pytest.mark.parametrize("other", [False, True])
def test_most_similar_against_all_pairs(spark, other):
    rng = random.Random(7)
    left = [(f"e{rng.randint(0, 2)}", t) for t in texts_of(rng, 60, 1)]
    right = [(f"e{rng.randint(0, 2)}", t) for t in texts_of(rng, 150, 1)] + left[:10] + [("e0", right) for right in ["road road"] * 3] + [("e1", None), (None, "road")]
    k, cutoff = 4, 40.0
    sides = (spark.createDataFrame(left, "block string, l string"), spark.createDataFrame(right, "own string, r string"))
    got = {(r.block, r.l, r.r): r.similar for r in similar.most_similar(*sides, [("block", "own")], "l", "r", k, cutoff, other).collect()}
    for block, text in set(left):
        scores = sorted(((token_set_similarity(text, t), t) for b, t in set(right) if b == block and t is not None and not (other and t == text)), reverse=True)
        scores = [(s, t) for s, t in scores if s >= cutoff]
        least = scores[k - 1][0] if len(scores) >= k else cutoff
        assert {(block, text, t): s for s, t in scores if s >= least}.items() <= got.items()
    assert all(got[key] == token_set_similarity(key[1], key[2]) and got[key] >= cutoff for key in got)


def test_few_pairs_reach_python(spark):
    rng = random.Random(5)
    names = [f"{rng.choice(['construction of', 'repair of', ''])} {rng.choice(['hall', 'road', 'school', 'tank', 'drain'])} near {rng.choice(['pune', 'satara', 'kolhapur', 'nashik', 'jalgaon', 'thane'])} {''.join(rng.choices('abcdefghijklmnopqrst', k=9))} ward {rng.randint(1, 30)}" for _ in range(300)]
    frame = spark.createDataFrame([("e", t) for t in names], "block string, text string")
    left, right = frame.select("block", F.col("text").alias("l")), frame.select(F.col("block").alias("own"), F.col("text").alias("r"))
    texts, _, pairs = similar.block_pairs(left, right, [("block", "own")], "l", "r")
    every, reached = pairs.count(), sum(w.count() for w in similar.waves(pairs, texts, 3, 55.0))
    assert every == len(set(names)) ** 2 and reached < every / 4
    equal = spark.createDataFrame([(f"e{i}", "same text here") for i in range(50)] + [(f"e{i}", "other text there") for i in range(50)], "block string, text string")
    texts, _, pairs = similar.block_pairs(equal.select("block", F.col("text").alias("l")), equal.select(F.col("block").alias("own"), F.col("text").alias("r")), [("block", "own")], "l", "r")
    assert pairs.count() == 200 and similar.verified(pairs, texts).count() == 4
