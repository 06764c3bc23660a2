"""Near duplicates, decontamination, language model, neighbours, segmentations and the pipeline."""

import math
import random
import re
from collections import Counter
from itertools import chain

import numpy as np
import pytest

from worklens.llm import decontaminate, flat, lm, minhash, neighbours, pieces, queries

WORDS = [f"w{i}" for i in range(40)] + ["Été", "ß", "x1"]


def texts_of(rng, n, low=0, high=40):
    return [" ".join(rng.choices(WORDS, k=rng.randint(low, high))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), True) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept boolean")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def set_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components_of(sets, ids):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    named = {}
    for i, d in enumerate(ids):
        if d is not None:
            named[find(i)] = min(named.get(find(i), d), d)
    return [named.get(find(i)) for i in range(len(sets))]


@pytest.mark.parametrize("small", [2, 24])
def test_groups_equal_brute_force(spark, small):
    rng = random.Random(11)
    rows = []
    for family in range(4):
        base = rng.choices(WORDS, k=60)
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(60)] = rng.choice(WORDS)
            rows.append(" ".join(copy))
    rows += texts_of(rng, 30) + ["", "   ", None, "one", "ONE", "one two", rows[0], rows[0]]
    ids = [*range(len(rows) - 1), None]
    got = minhash.groups(frame(spark, zip(ids, rows)), minhash.Settings(words=2, small=small, block=4)).collect()
    sets = [set_of(t, 2) for t in rows]
    want = dict(zip(ids, components_of(sets, ids)))
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = minhash.keep_one(frame(spark, zip(ids, rows)), minhash.Settings(words=2, small=small))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d in ids if d is not None and want[d] == d)
    assert kept.columns == frame(spark, []).columns
    assert minhash.groups(frame(spark, [])).count() == 0


def test_words_and_signatures():
    rng = random.Random(4)
    texts = texts_of(rng, 50) + ["", "A-b  c\n d"]
    import pyarrow as pa

    (a, b, raw, offsets), = flat.runs(pa.array(texts))
    w = flat.words(raw, offsets, minhash.SPACE)
    found = [(int(d), bytes(flat.LOWER[raw[s:e]]).decode()) for d, s, e in zip(w.doc, w.start, w.end)]
    assert found == [(i, x) for i, t in enumerate(texts) for x in re.findall(r"[^\x20\x09-\x0D]+", lowered(t))]
    doc, h = minhash.shingles(raw, offsets, 1)
    sig = minhash.signatures(doc, h, len(texts), 400)
    sets = [set_of(t, 1) for t in texts]
    for i, j in ((0, 1), (2, 3), (4, 5)):
        if sets[i] and sets[j]:
            assert abs((sig[:, i] == sig[:, j]).mean() - len(sets[i] & sets[j]) / len(sets[i] | sets[j])) < 0.12


def words_of(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text)) if w]


def hits_of(doc, item, window):
    n = min(window, len(item))
    grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
    return {p for s in range(len(doc) - n + 1) if n and tuple(doc[s : s + n]) in grams for p in range(s, s + n)}


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(i, t) for i, t in enumerate(texts_of(rng, 12, 1, 25))] + [(20, "the the the the"), (21, None), (22, "..."), (None, "zz yy xx"), (23, "solo"), (24, "solo")]
    docs = [(i, t) for i, t in enumerate(texts_of(rng, 40))]
    for i in range(12):
        body = words_of(items[i][1])
        docs.append((100 + i, " ".join([*rng.choices(WORDS, k=5), *body[: rng.randint(1, len(body))], "+", *rng.choices(WORDS, k=4), *body])))
    docs += [(200, None), (201, ""), (202, "THE, the; the the the!"), (203, "Solo"), (None, "solo"), (204, "zz yy xx"), (100, docs[40][1])]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, row int")
    for window in (3, 10):
        got = decontaminate.match(frame(spark, docs), bench, decontaminate.Settings(window=window)).collect()
        assert len(got) == len(docs)
        want = []
        for d, t in docs:
            w, hit, names = words_of(t), set(), []
            for i, it in items:
                found = hits_of(w, words_of(it), window)
                hit |= found
                names += [str(i)] if found and i is not None else []
            want.append((-1 if d is None else d, len(w), len(hit), len(set(names)), ",".join(sorted(set(names)))))
        import hashlib

        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == sorted((*x[:4], hashlib.sha256(x[4].encode()).hexdigest()) for x in want)
        assert all(r.contaminated == (r.n_hit > 0) for r in got)
    clean = decontaminate.keep_clean(frame(spark, docs), bench)
    assert clean.columns == frame(spark, []).columns and 202 not in {r.doc_id for r in clean.collect()}
    assert decontaminate.match(frame(spark, []), bench).count() == 0
    assert decontaminate.match(frame(spark, docs), bench.limit(0)).filter("contaminated").count() == 0


def test_rows_of_null_and_repeated_ids_are_judged_one_by_one(spark):
    bad, item = "x one two three four five six seven eight nine ten y", "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, bad), (None, "clean a"), (None, None), (7, bad), (7, "clean b"), (8, "clean c")]
    clean = decontaminate.keep_clean(frame(spark, rows), bench).collect()
    assert sorted(str((r.doc_id, r.text)) for r in clean) == sorted(map(str, [rows[1], rows[2], rows[4], rows[5]]))
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcd"]
    near = texts[0] + " end"
    rows = [(None, texts[0]), (None, near), (None, texts[0]), (3, texts[1]), (3, texts[1]), (3, texts[1] + " end"), (2, texts[2]), (None, texts[2]), (3, texts[3]), (None, None), (None, "")]
    kept = minhash.keep_one(frame(spark, rows)).collect()
    found = Counter((r.doc_id, (r.text or "").removesuffix(" end")) for r in kept)
    assert found == {(None, texts[0]): 1, (3, texts[1]): 1, (2, texts[2]): 1, (3, texts[3]): 1, (None, ""): 2}
    assert kept[0].asDict().keys() == set(frame(spark, []).columns)


def test_stages_bear_columns_of_any_name(spark):
    item = " ".join(f"item{i}" for i in range(10))
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in "ab"]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0] + " end"), (3, texts[1]), (4, item), (None, None), (5, "")]
    names = ["gone_id", "GONE_hash", "gone_hash_", "family", "component_id", "kept", "text_hash", "times", "first", "id", "row", "n_hit", "words"]
    docs = spark.createDataFrame([(*r, *(["x"] * len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, item, "x")], "item_id long, text string, row string")
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["1", "1", "2", "3", "5", "None"]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "None"]
    empty = docs.limit(0)
    assert minhash.keep_one(empty).count() == decontaminate.keep_clean(empty, bench).count() == 0


def test_proximity_matches(spark):
    docs = frame(spark, [(1, "a b x c d e"), (2, "e d c b a"), (3, "a b c " + "z " * 40 + "d e"), (4, "a b c d")])
    items = spark.createDataFrame([(7, "a b c d e")], "item_id long, text string")
    words = decontaminate.item_words(items)
    terms = decontaminate._numbered(words)
    words = words.join(terms, "term")
    index = decontaminate.build_index(docs, terms, 100)
    ids = {r.row: r.doc_id for r in index.filter("tid = -1").collect()}
    assert {ids[r.row] for r in decontaminate.near_matches(words, index, slop=2).collect()} == {1, 2}
    assert decontaminate.phrases(words, index).count() == 0


@pytest.mark.parametrize("order, chunk", [(1, 1 << 20), (2, 500), (3, 1), (3, 3000), (4, 1 << 20)])
def test_backoff_equals_brute_force(spark, order, chunk):
    rng = random.Random(6)
    texts = texts_of(rng, 60) + [None, "", "...", "rare once", "A a a A", "w1 " * 5000]
    texts += [texts[0], texts[0]]
    ids = [*range(len(texts) - 1), None]
    s = lm.Settings(order=order, chunk=chunk, bucket=2000)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r) for r in lm.score(frame(spark, zip(ids, texts)), s).collect()), key=lambda x: x[0])
    bodies = [words_of(t) for t in texts]
    grams = [Counter(tuple(b[i : i + n]) for n in range(1, order + 1) for i in range(len(b) - n + 1)) for b in bodies]
    everything = sum(grams, Counter())
    total = sum(map(len, bodies))

    def chance(gram, own):
        left = everything[gram] - own[gram]
        if len(gram) == 1:
            return math.log(max(left, 1) / total)
        return math.log(left / (everything[gram[:-1]] - own[gram[:-1]])) if left else math.log(s.alpha) + chance(gram[1:], own)

    assert len(got) == len(texts)
    for (i, r), b, own in zip(got, [bodies[-1], *bodies], [grams[-1], *grams]):
        assert (r.n_words, r.n_unknown) == (len(b), sum(everything[(w,)] == own[(w,)] for w in b))
        want = sum(chance(tuple(b[max(0, j - order + 1) : j + 1]), own) for j in range(len(b)))
        assert r.log_score is None if not b else abs(r.log_score - want) < 2e-4
        assert r.log_score_per_word is None if not b else abs(r.log_score_per_word - want / len(b)) < 2e-6
    assert lm.score(frame(spark, []), s).count() == 0


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(400, 16)).astype(np.float32)
    v[50:60] = v[0]
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(400)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (None, rows[3][1], 1), (7, rows[8][1], 1), (1100, [float("inf")] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    s = neighbours.Settings(every=50, candidate_block=32, query_block=4)
    got = neighbours.search(table, s).collect()
    ids = np.array([*range(400), 7])
    full = np.concatenate([v, v[8:9]]).astype(float)
    for q in range(0, 400, 50):
        d = np.sqrt(np.cumsum((full - full[q]) ** 2, axis=1)[:, -1])
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert mine == [(i + 1, int(ids[j]), float(d[j])) for i, j in enumerate(order)]
    assert {r.query_id for r in got} == set(range(0, 400, 50))
    few = neighbours.search(table.filter("vec_id in (0, 1, 2)"), s).collect()
    assert [(r.rank, r.query_id) for r in sorted(few, key=lambda r: r.rank)] == [(1, 0), (2, 0)]
    assert neighbours.search(table.limit(0), s).count() == 0


@pytest.mark.parametrize("size", [1e200, 1e-200, 3.0])
def test_neighbours_of_huge_and_tiny_vectors(spark, size):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8)) * size
    v[40:] /= size
    table = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)], "vec_id long, embedding array<double>")
    got = neighbours.search(table, neighbours.Settings(every=30, candidate_block=16)).collect()
    for q in (0, 30):
        d = [math.dist(v[i] / size, v[q] / size) if size > 1 else math.hypot(*(v[i] - v[q])) for i in range(60)]
        want = [i for _, i in sorted((x, i) for i, x in enumerate(d) if i != q)][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert len(mine) == 10 and all(math.isfinite(x) and x > 0 for _, _, x in mine)
        if size != 1e-200:
            assert [i for _, i, _ in mine] == want and all(math.isclose(x, d[i] * (size if size > 1 else 1), rel_tol=1e-9) for _, i, x in mine)


def test_production_scores_with_trigrams(spark):
    texts = ["a b c", "a b c", "x b d", "x b d", "a b d"]
    got = {r.doc_id: r.log_score for r in lm.score(frame(spark, enumerate(texts))).collect()}
    start = math.log(2 / 15) + math.log(2 / 2)  # of a in the other documents, then b after it
    assert abs(got[0] - (start + math.log(1 / 2))) < 1e-4  # by bigrams: 1 / 4
    assert abs(got[4] - (start + math.log(0.4) + math.log(2 / 4))) < 1e-4  # no other document has "a b d"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path(queries.PIECES)


def test_samples_are_distinct_and_as_likely_as_they_say(path):
    m = pieces.Model(path, 0.3)
    segmentations = {ids: p for p, ids in m.lattice("▁thean").likeliest()}
    assert abs(sum(segmentations.values()) - 1) < 1e-9
    first, n = Counter(), 3000
    for i in range(n):
        a, b = m.samples("thean", f"{i}".encode(), 2)
        assert a[3] != b[3] and a[0] >= b[0] and abs(a[1] - math.log(segmentations[a[3]])) < 1e-9
        first[a[3]] += 1
    for ids, p in segmentations.items():
        assert abs(first[ids] / n - p) < 0.04
    everything = m.samples("ab ab", b"k", 1000)
    assert len({s[3] for s in everything}) == len(everything) == 16 and abs(sum(math.exp(s[1]) for s in everything) - 1) < 1e-9
    assert all(s[2] == 1.0 for s in everything)


def test_fast_paths_equal_lattices(path):
    m = pieces.Model(path, 2.0)
    words = {"▁" + "".join(random.Random(i).choices("abcdefgñéöst.,*", k=i % 30)) for i in range(200)}
    m.learn(words)
    for w in words:
        lattice = m.lattice(w)
        assert m.words[w][2] == lattice.log_other == -math.inf or abs(m.words[w][2] - lattice.log_other) < 1e-8
        assert m.words[w][0] == lattice.best and abs(m.words[w][1] - lattice.log_best) < 1e-9


@pytest.mark.parametrize("alpha", [0.3, 2.0, 8.0])
def test_draws_equal_enumeration(path, alpha):
    m = pieces.Model(path, alpha)
    words = ["▁hello", "▁thean", "▁ab", "▁the", "▁Öl", "▁日an", "▁" + "x" * 45]
    for word in words:
        everything = {ids: lp for lp, ids in ((math.log(p) if p > 0 else -math.inf, ids) for p, ids in m.lattice(word).likeliest())} if len(word) < 20 else {}
        n = 2000 if everything else 5
        m.learn([word])
        best = m.words[word][0]
        seen = Counter()
        for d in m.drawn_others([(word, seed) for seed in range(n)]):
            seen[d.ids] += 1
            assert d.ids != best and m.decoded(d.ids) == word[1:]
            if everything:
                others = [lp for ids, lp in everything.items() if ids != d.ids]
                rest = [lp for ids, lp in everything.items() if ids not in (d.ids, best)]
                assert math.isclose(d.log_probability, everything[d.ids], rel_tol=1e-9, abs_tol=1e-9)
                assert math.isclose(d.log_other, pieces.log_sum(others), rel_tol=1e-9, abs_tol=1e-9)
                assert d.log_both == pieces.log_sum(rest) == -math.inf or math.isclose(d.log_both, pieces.log_sum(rest), rel_tol=1e-9, abs_tol=1e-9)
        for ids, lp in everything.items():
            if ids != best:
                assert abs(seen[ids] / n - math.exp(lp - m.words[word][2])) < 0.05


def test_samples_at_the_registered_alpha(path):
    m = pieces.Model(path, 8.0)
    everything = {ids: p for p, ids in m.lattice("▁thean").likeliest()}
    n, first, second = 3000, Counter(), Counter()
    for one, two in m.many_samples(["thean"] * n, [f"{i}".encode() for i in range(n)], 2):
        first[one[3]] += 1
        second[one[3], two[3]] += 1
    for a, p in everything.items():
        assert abs(first[a] / n - p) < 0.04
        for b, q in everything.items():
            assert a == b or abs(second[a, b] / n - p * q / (1 - p)) < 0.04


def test_unlikely_segmentations_are_not_lost(spark, path):
    rows = frame(spark, enumerate(["hello world", "children"]))
    found = pieces.sample(rows, path).collect()
    assert len(found) == 4 and len({(r.doc_id, r.ids_sha256) for r in found}) == 4 and all(r.decoded_ok for r in found)
    for alpha in (0.3, 8.0, 32.0):
        m = pieces.Model(path, alpha)
        everything = m.samples("children", b"k", 10_000)
        assert len({s[3] for s in everything}) == len(everything) == len(list(m.lattice("▁children").likeliest())) > 100
        m.learn({"▁children"})
        lattice = m.lattice("▁children")
        others = [s[1] for s in everything if s[3] != lattice.best]
        assert math.isclose(m.words["▁children"][2], pieces.log_sum(others), rel_tol=1e-9, abs_tol=1e-9) and abs(lattice.log_other - m.words["▁children"][2]) < 1e-8


def test_texts_of_a_batch_are_split_and_checked_together(path):
    rng = random.Random(3)
    texts = [None, "", "\n", " ", "\n\n a\n", "a  b", "▁a▁▁\n▁"] + ["".join(rng.choices("ab \n▁é\x00日", k=rng.randint(0, 30))) for _ in range(300)]
    names, word, ends = pieces.Model.split(texts)
    for text, a, b in zip(texts, ends, ends[1:]):
        first, *lines = (text or "").replace("▁", " ").split("\n")
        words = re.findall("▁[^▁]*", "▁" + first.replace(" ", "▁"))
        for line in lines:
            words += ["\n", *re.findall("▁[^▁]*|^[^▁]+", line.replace(" ", "▁"))]
        assert [names[i] for i in word[a:b]] == words
    m = pieces.Model(path, 8.0)
    drawn = [(t, s[3]) for t, found in zip(texts, m.many_samples(texts, [b"%d" % i for i in range(len(texts))], 2)) for s in found]
    plain = [(t or "").replace("▁", " ").encode() for t, _ in drawn]
    assert m.spelled([ids for _, ids in drawn], plain) == [True] * len(drawn)
    assert m.spelled([ids for _, ids in drawn], plain[1:] + [b"x"]) == [a == b for a, b in zip(plain, plain[1:] + [b"x"])]


def test_words_given_up_are_found_again(path, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("aehnost", k=rng.randint(1, 9))) for _ in range(40)) for _ in range(30)]
    keys = [b"%d" % i for i in range(30)]
    m, small = pieces.Model(path, 2.0), pieces.Model(path, 2.0)
    want = m.many_samples(texts, keys, 2)
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    got = [found for i in range(0, 30, 3) for found in small.many_samples(texts[i : i + 3], keys[i : i + 3], 2)]
    assert len(small.words.best) <= 50 + 120 < len(m.words.best)
    for a, b in zip(chain.from_iterable(want), chain.from_iterable(got)):
        assert a[3] == b[3] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[:3], b[:3]))


def test_sampling_round_trip(spark, path):
    texts = ["Hello there, the weather.\nNext  line", None, "", "日本 😀 \x00\t é", "x" * 3000, "Hello there, the weather.\nNext  line"]
    rows = frame(spark, [(i % 5, t) for i, t in enumerate(texts)])
    got = pieces.sample(rows, path, k=3)
    found = got.collect()
    assert all(r.decoded_ok for r in found)
    assert {(r.doc_id, r.rank, r.ids_sha256) for r in found} == {(r.doc_id, r.rank, r.ids_sha256) for r in pieces.sample(rows.repartition(3), path, k=3).collect()}
    texts_back = {(r.doc_id, r.text) for r in pieces.decode(got, path).collect()}
    assert texts_back == {(i % 5, t or "") for i, t in enumerate(texts)}
    assert pieces.sample(frame(spark, []), path).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    good = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(50)) for _ in range(150)]
    bad = [" ".join(f"{w}***" for w in t.split()) for t in good[100:]]
    item = " ".join(f"item{i}" for i in range(12))
    rows = [(i, t) for i, t in enumerate(good)] + [(500 + i, t) for i, t in enumerate(bad)]
    rows += [(900, good[0]), (901, f"{good[1]} {item}"), (902, good[2] + " changed"), (903, f"{' '.join(good[3].split()[::-1])} password=abcdefgh99")]
    docs = frame(spark, rows).drop("kept")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 500), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, step) in enumerate(pipeline.STAGES):
        out = step(spark, kept, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        kept = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert kept.columns == docs.columns
            seen[name] = {r.doc_id: r.text for r in kept.collect()}
    assert not [i for i in seen["quality"] if 500 <= i < 900] and set(range(150)) <= set(seen["quality"])
    assert {900, 902}.isdisjoint(seen["near_duplicates"]) and set(range(150)) <= set(seen["near_duplicates"])
    assert 901 not in seen["benchmark"] and set(range(150)) <= set(seen["benchmark"])
    assert "password" not in seen["secrets"][903] and seen["secrets"][5] == good[5]
    rows = kept.collect()
    assert {r.doc_id for r in rows} == set(seen["secrets"]) and all(r.decoded_ok for r in rows)


def test_pipeline_bears_null_empty_and_repeated_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(None, None), (None, ""), (1, None), (2, ""), (3, "plain words " * 20000), (4, "some other words"), (4, "some other words"), (None, "some other words")]
    for name, docs in (("few", rows), ("none", [])):
        folder = str(tmp_path / name)
        frame(spark, docs).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = pipeline.run(spark, folder).collect()
        assert all(r.decoded_ok for r in got) and (name == "few" or not got)
        assert all(sum(r.doc_id == i for r in got) <= 2 for i in (3, 4))


def test_headers_of_the_index_are_dealt(spark):
    docs = frame(spark, [(i, "a b") for i in range(50)])
    terms = spark.createDataFrame([("a", 0)], "term string, tid long")
    index = decontaminate.build_index(docs, terms, 0)  # nothing is broadcast
    assert {(r.doc_id, r.n_words) for r in index.filter("tid = -1").collect()} == {(i, 2) for i in range(50)} and index.filter("tid = 0").count() == 50
