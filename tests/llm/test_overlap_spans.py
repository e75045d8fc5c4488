"""Maximal matches of evaluation and training pairs against brute force."""

import random

import numpy as np

from pairlab.llm.overlaps import WordIndex, merged, overlaps
from pairlab.llm.sketches import word_hashes


def maximal(e, t):
    """(first, stop) of all stretches of ``t`` that occur in ``e`` and lie in no longer one that does."""
    have = {tuple(e[i:j]) for i in range(len(e)) for j in range(i + 1, len(e) + 1)}
    found = [(i, j) for i in range(len(t)) for j in range(i + 1, len(t) + 1) if tuple(t[i:j]) in have]
    return [(i, j) for i, j in found if not any((a, b) != (i, j) and a <= i and j <= b for a, b in found)]


def joined(spans):
    out = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def test_matches_that_overlap_are_all_found():
    evals, probe = ["a b c d e f", "e f g h"], "a b c d e f g h"
    index = WordIndex(*word_hashes(evals), 2, 3)
    coded = index.code(word_hashes([probe])[0])
    whole = index.matches(coded, np.array([0]), np.array([8]))
    assert list(zip(*(x.tolist() for x in whole))) == [(0, 0, 6), (0, 4, 8)]
    each = index.matches(coded, np.array([0, 0]), np.array([8, 8]), np.array([0, 1]))
    assert list(zip(*(x.tolist() for x in each))) == [(0, 0, 6), (1, 4, 8)]
    assert [x.tolist() for x in merged(*whole)] == [[0], [0], [8]]


def test_matches_against_brute_force():
    r = random.Random(5)
    draw = lambda least: [" ".join(r.choices("abcde"[: r.randint(1, 5)], k=r.randint(least, 25))) for _ in range(20)]
    evals, probes = [*draw(0), ""], [x.replace("e", "zz") for x in draw(1)]
    index = WordIndex(*word_hashes(evals), len(evals), 3)
    words, text = word_hashes(probes)
    pairs = [(e, t) for t in range(len(probes)) for e in range(len(evals))]
    e, t = (np.array(x) for x in zip(*pairs))
    start, end = np.searchsorted(text, t), np.searchsorted(text, t, "right")
    which, first, stop = index.matches(index.code(words), start, end, e)
    got = {k: [] for k in range(len(pairs))}
    for k, a, b in zip(which.tolist(), first - start[which], stop - start[which]):
        got[k].append((int(a), int(b)))
    assert got == {k: maximal(evals[x].split(), probes[y].split()) for k, (x, y) in enumerate(pairs)}


def test_spans_of_pairs(spark):
    r = random.Random(6)
    evals, train = [], []
    for i in range(12):
        base = [f"w{r.randint(0, 15)}" for _ in range(50)]
        other = list(base)
        other[r.randint(0, 49)] = "zz"
        cut = r.randint(5, 40)
        evals.append((f"e{i}", " ".join(base)))
        train += [(f"t{i}", " ".join(other)), (f"u{i}", " ".join(base[cut - 4 :] + base[:cut]))]
    frames = [spark.createDataFrame(x, "id string, text string") for x in (evals, train)]
    rows = overlaps(*frames, {"text": ("id", "text")}, 0.7, 3).collect()
    assert len(rows) >= 24
    e, t = dict(evals), dict(train)
    for x in rows:
        found = maximal(e[x.eval_id].split(), t[x.train_id].split())
        spans = joined([(a, b) for a, b in found if b - a >= 8])
        assert x.longest_span == max(b - a for a, b in found)
        assert [tuple(s) for s in x.spans] == spans and x.span_words == sum(b - a for a, b in spans)
