"""Alignment against the libraries on whole texts and a plain merge."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from worklens.llm import align
from worklens.llm.bpe import _byte_of_char

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The cat sat, didn't it?", "", None, " ", "  two  spaces \n\n x  ", "été naïve œuvre : «ça»", "中文 空格　全角   x", "<|endoftext|> is plain <s> </s> <unk> <0x41>", "a▁b ▁",
    "\t tab\r\nlines\n \n  end\n", "emoji 👩‍👩‍👧 🇫🇷 x", "don't we'll I'm 'tis ''s 12 345.6", "a​b ﻿x é ﬁ", "x" * 3000, "wörd, " * 1500, "\u0085 \u0085x   y　 z", "null \x00 byte \x1c\x1d z", "...  ...   !!!\n\n\n   \n z",
]


@pytest.fixture(scope="module")
def readers():
    tokens = Tokenizer.from_file(A)
    tokens.encode_special_tokens = True
    return tokens, sentencepiece.SentencePieceProcessor(model_file=B)


def sides(readers, text):
    """((id, end offset) of A, the same of B) as the libraries read the whole text; None where bytes differ."""
    tokens, model = readers
    stand_in = _byte_of_char()
    found = [(i, bytes(stand_in[c] for c in tokens.id_to_token(i))) for i in tokens.encode(" " + text, add_special_tokens=False).ids]
    pieces = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(text) for p in [model.id_to_piece(i)]]
    out = []
    for part in (found, pieces):
        if b"".join(x for _, x in part) != (" " + text).encode():
            return None
        at, ends = 0, []
        for i, x in part:
            at += len(x)
            ends.append((i, at))
        out.append(ends)
    return out


def plain(readers, rows):
    made, count = [], Counter()
    for doc_id, text in rows:
        both = sides(readers, text) if text else None
        links, groups = [], []
        if both:
            a, b = both
            spans = [[(i, s, e) for (i, e), s in zip(x, [0, *(e for _, e in x)])] for x in (a, b)]
            j = 0
            for i, s, e in spans[0]:
                while spans[1][j][2] <= s:
                    j += 1
                k = j
                while k < len(spans[1]) and spans[1][k][1] < e:
                    links.append((i, spans[1][k][0]))
                    k += 1
            cuts = {e for _, e in a} & {e for _, e in b}
            own = ([], [])
            for e, side, i in sorted([(e, 0, i) for i, e in a] + [(e, 1, i) for i, e in b]):
                own[side].append(str(i))
                if e in cuts and side == 1:
                    groups.append("|".join(map(",".join, own)))
                    own = ([], [])
        count.update(links)
        made.append((doc_id, both, links, groups))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for doc_id, both, links, groups in made:
        n_a, n_b = map(len, both or ((), ()))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if both else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, shard int, links string")


def test_equal_to_a_plain_merge_of_whole_texts(spark, readers, monkeypatch):
    rng = random.Random(3)
    alphabet = [*"abcDE .,'\n\t  12é中　  ß", "'s", " the", "ing", "▁", "🙂"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(400)] + ["same text again."] * 5
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, TEXTS[0])]
    want = plain(readers, rows)
    assert sorted(map(tuple, align.linked(frame(spark, rows), A, B).collect()), key=str) == want
    monkeypatch.setattr(align, "GROUP", 1)
    monkeypatch.setattr(align, "BUCKET", 1000)
    assert sorted(map(tuple, align.linked(frame(spark, rows).repartition(4), A, B).collect()), key=str) == want


def test_lanes_batches_and_shards_do_not_matter(readers, monkeypatch):
    import pyarrow as pa

    known = align.vocabularies(A, B)
    assert known.apart
    texts = pa.array([t for t in TEXTS for _ in (0, 1)], pa.large_string())
    names = align._names(known.size_a)
    want = [d for _, _, x in align.Shard(texts, known).batches() for d in align.digests(x, names)]
    monkeypatch.setattr(align, "LANE", 3)
    monkeypatch.setattr(align, "BATCH", 50)
    assert [d for _, _, x in align.Shard(texts, known).batches() for d in align.digests(x, names)] == want
    known.apart = False
    try:
        assert [d for _, _, x in align.Shard(texts, known).batches() for d in align.digests(x, names)] == want
    finally:
        known.apart = True


def test_alignments_and_empty_table(spark, readers):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for doc_id, *columns in map(tuple, align.alignments(frame(spark, rows), A, B).collect()):
        a, a_end, b, b_end, links, cuts = columns
        both = sides(readers, TEXTS[doc_id]) if TEXTS[doc_id] else None
        assert [list(zip(a, a_end)), list(zip(b, b_end))] == (both or [[], []])
        assert cuts == sorted(set(a_end) & set(b_end))
        start = lambda ends, i: ends[i - 1] if i else 0
        assert all(max(start(a_end, i), start(b_end, j)) < min(a_end[i], b_end[j]) for i, j in links)
        assert len(links) == len(set(links)) == len(a) + len(b) - len(cuts)
    empty = align.linked(frame(spark, []), A, B)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
