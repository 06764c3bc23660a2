"""Linking against a plain one-record-at-a-time reading of the rules, and the hand-derived cases."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from worklens.config import Config
from worklens.functions.similarity import common_subsequence, token_set_similarity
from worklens.operators import linkage

FIELDS = "work_norm string, work_description string, mp_norm string, mp_canonical string, mp_canonical_key string, constituency_norm string, constituency_canonical string, constituency_canonical_key string, state_norm string, state_norm_key string, ida_norm string, category_norm string, category_norm_key string, work_id_key string"


def record(text, amount, date, member="a", place="c", state="s", ida="i", category="x", work_id="", described=None):
    return (text, text if described is None else described, member, member, member, place, place, place, state, state, ida, category, category, work_id, amount, date)


def tables(spark, recs, comps, ida_key=False):
    rec = spark.createDataFrame([(i, *r) for i, r in enumerate(recs)], f"recommendation_index long, {FIELDS}, recommended_amount double, recommendation_date timestamp_ntz")
    comp = spark.createDataFrame([(i, *c) for i, c in enumerate(comps)], f"completion_index long, {FIELDS}, final_amount double, completed_date timestamp_ntz")
    if ida_key:
        rec, comp = rec.withColumn("ida_key", rec.ida_norm), comp.withColumn("ida_key", comp.ida_norm)
    return rec, comp


def matched(spark, recs, comps, config=Config(), **options):
    return {r.recommendation_index: r for r in linkage.match_records(*tables(spark, recs, comps, **options), config).collect()}


DAY = dt.datetime(2024, 1, 1)


def on(n):
    return DAY + dt.timedelta(days=n)


@given(st.text("abcde", max_size=12), st.text("abcde", max_size=12))
@settings(max_examples=300, deadline=None)
def test_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        old = row[:]
        for j, d in enumerate(b):
            row[j + 1] = old[j] + 1 if c == d else max(old[j + 1], row[j])
    assert common_subsequence(a, b) == row[-1]


def test_similarity_cases():
    assert token_set_similarity("a b", "b a a") == 100.0
    assert token_set_similarity("road to x", "road") == 100.0
    assert token_set_similarity("", "a") == 0.0
    assert token_set_similarity("abc", "xyz") == 0.0
    assert round(token_set_similarity("ro water plant ponnavolu village", "ro plant marthuvaripalli village"), 2) == 66.67


def test_identical_and_different_works(spark):
    same = "construction of cc road village a"
    got = matched(spark, [record(same, 100000.0, on(0))], [record(same, 99000.0, on(91))])[0]
    assert got.match_tier == "Tier 1" and abs(got.match_score - 99.879) < 1e-9 and got.score_margin == got.match_score
    got = matched(spark, [record("ro water plant ponnavolu village", 300000.0, on(0), ida="i1")], [record("ro plant marthuvaripalli village", 283000.0, on(60), ida="i2")], ida_key=True)[0]
    assert got.match_tier == "Unmatched" and abs(got.best_candidate_score - 62.27) < 0.01
    assert got.match_reason.startswith("[UNMATCHED REASON] ") and "different IDA" in got.match_reason


def test_stages_and_edges(spark):
    road = "cc road to temple near bazaar"
    recs = [
        record("", 1.0, on(0)),
        record("zzz qqq", 5.0, on(0), member="nobody"),
        record(road, 100.0, on(0), member="m1"),
        record(road, 100.0, on(0), member="m1"),
        record("new library hall at kota", 100.0, on(0), member="m2", work_id="w1"),
        record("solar pump at rampur", 100.0, on(0), member="m3"),
        record("canal wall bilaspur", 100.0, on(0), member="m4"),
    ]
    comps = [
        record(road, 100.0, on(10), member="m1"),
        record("new library hall kota", 95.0, on(10), member="m2", place="d", work_id="w1"),
        record("solar pump at rampur", 100.0, on(5000), member="m3"),
        record("canal wall bilaspur", 100.0, on(10), member="m4"),
        record("canal wall bilaspur", 100.0, on(10), member="m4"),
    ]
    got = matched(spark, recs, comps)
    assert got[0].match_reason == "Missing work description." and got[0].best_candidate_index == -1
    assert got[1].match_reason == "No candidate survived description/date screening."
    assert (got[2].completion_index, got[3].completion_index) == (0, -1)  # equal scores: the first keeps it
    assert "one-to-one" in got[3].match_reason and got[3].best_candidate_tier == "Tier 1" and got[3].match_score == 0.0
    assert got[4].best_candidate_index == 1 and "corroborated Work ID" in got[4].match_reason and "different constituency" in got[4].match_reason
    assert got[5].match_reason.startswith("Best candidate did not reach a match tier; ") and got[5].best_candidate_index == 2
    assert got[6].score_margin == 0.0 and "Score margin too small" in got[6].match_reason
    assert got[6].best_candidate_index == 3
    empty = matched(spark, recs[:3], [])
    assert all(r.match_tier == "Unmatched" for r in empty.values()) and len(empty) == 3


def test_top_candidates_are_chosen_before_dates(spark):
    comps = [record(f"hand pump school yard {c}", 100.0, on(5000), member="m") for c in "abcdefghij"] + [record("hand pump yard", 100.0, on(5), member="m")]
    got = matched(spark, [record("hand pump school yard", 100.0, on(0), member="m")], comps)[0]
    assert got.completion_index == -1 and got.match_reason.startswith("Best candidate")


def test_large_blocks_use_tokens(spark):
    comps = [record(f"road work number{i} sector{i % 7}", 100.0, on(5)) for i in range(30)]
    got = matched(spark, [record("road work number17 sector3", 100.0, on(0))], comps, Config(block_limit=20))[0]
    assert "fuzzy token retrieval" in got.match_reason or "exact" in got.match_reason
    got = matched(spark, [record("roadway number17 sector3 part", 100.0, on(0))], comps, Config(block_limit=20))[0]
    assert "fuzzy token retrieval" in got.match_reason and got.best_candidate_index == 17


def brute_force(recs, comps, config=Config()):
    """Links of a single entity block, by the rules, one record after another."""
    out = {}
    for ri, r in enumerate(recs):
        found = [(ci, 1) for ci, c in enumerate(comps) if c[0] == r[0] and -30 <= (c[15] - r[15]).days <= 900]
        if not found:
            near = sorted(((token_set_similarity(r[0], c[0]), ci) for ci, c in enumerate(comps)), key=lambda x: (-x[0], x[1]))
            found = [(ci, 3) for s, ci in near if s >= 55][:10]
            found = [(ci, stage) for ci, stage in found if -30 <= (comps[ci][15] - r[15]).days <= 900]
        scored = []
        for place, (ci, _) in enumerate(found):
            c = comps[ci]
            desc, days = token_set_similarity(r[0], c[0]), (c[15] - r[15]).days
            amount = 100 * min(r[14], c[14]) / max(r[14], c[14])
            time = 100 - 45 * days / 900 if days >= 0 else 10
            stop = set(linkage.T.STOP_WORDS)
            a, b = set(r[0].split()) - stop, set(c[0].split()) - stop
            overlap = 100 * len(a & b) / min(len(a), len(b)) if a and b else 0
            score = 0.66 * desc + 10 + 9 + 4 + 3 + 3 + 0.03 * amount + 0.02 * time - (6 if overlap < 30 and desc < 95 else 0)
            scored.append((-max(0, score), place, ci, desc, overlap, amount))
        scored.sort()
        if not scored:
            out[ri] = (None, None)
            continue
        best = scored[0]
        margin = -best[0] - (-scored[1][0] if len(scored) > 1 else 0)
        clean = best[3] >= 78 and best[4] >= 25 and best[5] >= 50
        tier = "Tier 1" if clean and -best[0] >= 88 and margin >= 8 and best[3] >= 90 else "Tier 2" if clean and -best[0] >= 78 and margin >= 4 and best[4] >= 35 else "Unmatched"
        out[ri] = (round(-best[0], 3), tier)
    return out


def test_scores_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda"]
    text = lambda: " ".join(rng.sample(words, rng.randint(2, 5)))
    recs = [record(text(), float(rng.randint(50, 150)), on(rng.randint(0, 100))) for _ in range(25)]
    comps = [record(text(), float(rng.randint(50, 150)), on(rng.randint(60, 1100))) for _ in range(25)]
    got = matched(spark, recs, comps)
    for ri, (score, tier) in brute_force(recs, comps).items():
        if score is None:
            assert got[ri].match_reason.startswith("Best candidate")
        else:
            assert got[ri].best_candidate_score == pytest.approx(score, abs=1e-3) and got[ri].best_candidate_tier == tier
    taken = [r.completion_index for r in got.values() if r.completion_index >= 0]
    assert len(taken) == len(set(taken))


def test_equal_records_are_scored_once(spark, monkeypatch):
    recs, comps = [record("hand pump at kota", 100.0, on(0))] * 12, [record("hand pump at kota", 90.0, on(10))] * 9 + [record("hand pump at kota", 80.0, on(10))]
    own, pairs = linkage.scored, []
    monkeypatch.setattr(linkage, "scored", lambda rows, config: pairs.append(rows.count()) or own(rows, config))
    got = matched(spark, recs, comps)
    assert pairs[0] == 3  # two of the nine, and the other
    assert [got[i].completion_index for i in range(12)] == [-1] * 12 and {(r.best_candidate_index, r.score_margin) for r in got.values()} == {(0, 0.0)}


def test_equal_texts_look_up_tokens_once(spark, monkeypatch):
    own, asked = linkage._pools, []
    monkeypatch.setattr(linkage, "_pools", lambda rows, *args: asked.append(rows.count()) or own(rows, *args))
    rec, comp = tables(spark, [record("solar pump part", 1.0, on(0), place=p) for p in "aabb"], [record(f"solar {w} pump", 1.0, on(1), place=p) for w in ("x", "y", "z") for p in "ab"])
    got = linkage.candidates(linkage.recommendations_side(rec), linkage.completions_side(comp), Config(block_limit=1)).select("recommendation_index", "completion_index", "place").collect()
    assert asked == [1]
    assert sorted(map(tuple, got)) == sorted((r, c, i + 1) for r, place in enumerate((0, 0, 1, 1)) for i, c in enumerate(range(place, 6, 2)))


@pytest.mark.parametrize("limit", [1, 3, 10, 100])
def test_pools_without_sorting_pairs(spark, limit):
    rng = random.Random(limit)
    texts = [[rng.sample("abcdefghijklmnopqr", rng.randint(0, 12)) for _ in range(40)] for _ in range(2)]
    rec = spark.createDataFrame(list(enumerate(texts[0])), "recommendation_index long, r_tokens array<string>")
    comp = spark.createDataFrame(list(enumerate(texts[1])), "completion_index long, c_tokens array<string>")
    pool = linkage.token_pool(rec, comp, limit)
    assert "Window" not in pool._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]
    df = {t: sum(t in c for c in texts[1]) for t in "abcdefghijklmnopqr"}
    want = []
    for r, own in enumerate(texts[0]):
        rare = sorted((df[t], t) for t in own if df[t])[:8]
        found = sorted((min(i for i, (_, t) in enumerate(rare) if t in c), k) for k, c in enumerate(texts[1]) if any(t in c for _, t in rare))
        want += [(r, k, i + 1) for i, (_, k) in enumerate(found[:limit])]
    assert sorted(map(tuple, pool.collect())) == sorted(want)


def test_best_of_many_equal_descriptions_without_scoring_all(spark, monkeypatch):
    rng = random.Random(5)
    some = lambda n: [record("hand pump at kota", rng.choice([None, 0.0, 80.0, 90.0, 100.0 + rng.random()]), None if rng.random() < 0.1 else on(rng.randint(0, 60)), ida=rng.choice("ij")) for _ in range(n)]
    recs, comps = some(25), some(40)
    own, pairs = linkage.scored, []
    monkeypatch.setattr(linkage, "scored", lambda rows, config: pairs.append(rows.count()) or own(rows, config))
    monkeypatch.setattr(linkage, "TILE", 7)
    got = matched(spark, recs, comps, Config(date_window=20, early_days=-5), ida_key=True)
    assert pairs.pop(0) <= 2 * len(recs)
    monkeypatch.setattr(linkage, "FEW", 100)
    assert got == matched(spark, recs, comps, Config(date_window=20, early_days=-5), ida_key=True)


def test_large_sides_are_not_sent_through_the_driver(spark):
    rec, comp = tables(spark, [record("hand pump at kota", 1.0, on(0), place=p) for p in "ab"], [record("hand pump at kota", 1.0, on(d), place=p) for p in "bc" for d in (1, -40)])
    got = linkage.candidates(*(linkage.stage(s, "side") for s in (linkage.recommendations_side(rec), linkage.completions_side(comp))), Config(block_limit=1))
    assert sorted((r.recommendation_index, r.completion_index, r.stage) for r in got.collect()) == [(0, 0, 3), (0, 2, 3), (1, 0, 1)]
    depth, sent = None, []
    for line in got._jdf.queryExecution().executedPlan().toString().splitlines():
        at = next((i for i, c in enumerate(line) if c.isalpha()), 0)
        depth = None if depth is not None and at <= depth else depth
        if depth is None and "BroadcastExchange" in line:
            depth = at
        elif depth is not None and "FileScan" in line:
            sent.append(line)
    assert not [line for line in sent if "recommendation_index" in line or "completion_index" in line]
