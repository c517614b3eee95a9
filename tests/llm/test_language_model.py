"""Language-model scores against all segmentations written out, and base scores against plain counts."""

import math
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from lexiforge.llm import language as L

TOY = {" ": 3.0, "a": 4.0, "b": 5.0, " a": 0.0, "ab": 1.0, " ab": 2.0, "ba": 6.0, "aba": 7.0, "é": 8.0, "bab": 9.0}


def weight_of(pieces, weights, piece):
    h = np.zeros(1, np.uint64)
    for c in L.code_points(piece).astype(np.uint64):
        h = L._extended(h, c)
    return weights[int(np.searchsorted(pieces.hashes, h[0]))]


def segmentations(word, vocabulary):
    """All ways to cut a word, each a list of pieces or of single code points as (bytes,)."""
    if not word:
        return [[]]
    out = [[(word[0].encode(),), *rest] for rest in segmentations(word[1:], vocabulary)]
    return out + [[word[:k], *rest] for k in range(1, len(word) + 1) if word[:k] in vocabulary for rest in segmentations(word[k:], vocabulary)]


def plain(pieces, weights, vocabulary):
    def p(x):
        if isinstance(x, tuple):
            return math.prod(weights[pieces.bytes_at + b] for b in x[0])
        return weight_of(pieces, weights, x)

    return cache(lambda word: [(s, math.prod(map(p, s))) for s in segmentations(" " + word, vocabulary)])


WORDS = ["a", "ab", "abab", "babab", "é", "aéb", "aba", "😀b", "x\x00", "ж", "bbbbbb", "▁a"]


def test_marginals_and_expected_counts_over_all_segmentations():
    pieces = L.pieces_of(TOY)
    rng = np.random.default_rng(1)
    weights = rng.dirichlet(np.ones(len(pieces.start)))
    lattice, of = L.Lattice(pieces, weights), plain(pieces, weights, TOY)
    got = lattice.log_probabilities(WORDS)
    assert np.allclose(got, [math.log(sum(p for _, p in of(w))) for w in WORDS])
    n = rng.integers(1, 9, len(WORDS)).astype(float)
    expected = lattice.expected(WORDS, n)
    want = Counter()
    for w, times in zip(WORDS, n):
        total = sum(p for _, p in of(w))
        for s, p in of(w):
            for x in s:
                if isinstance(x, tuple):
                    want.update({b: 0 for b in x[0]})
                    for b in x[0]:
                        want[b] += times * p / total
                else:
                    want[x] += times * p / total
    for x, v in want.items():
        at = pieces.bytes_at + x if isinstance(x, int) else int(np.flatnonzero(weights == weight_of(pieces, weights, x))[0])
        assert expected[at] == pytest.approx(v)
    assert expected.sum() == pytest.approx(sum(want.values()))


def test_long_words_go_in_stretches(monkeypatch):
    pieces = L.pieces_of(TOY)
    lattice = L.Lattice(pieces, pieces.start)
    words = ["ab" * 300 + "é" + "ba" * 57, "a" * 700, "b", "aba" * 40]
    whole = lattice.log_probabilities(words)
    for cells in (50, 7, 3):
        monkeypatch.setattr(L, "CELLS", cells)
        assert np.allclose(lattice.log_probabilities(words), whole)


def test_public_vocabulary():
    pieces = L.public_pieces()
    assert len(pieces.hashes) > 31_000 and pieces.start.sum() == pytest.approx(1) and pieces.longest == 16
    lattice = L.Lattice(pieces, pieces.start)
    p = dict(zip(("the", "house", "xqzvk"), lattice.log_probabilities(["the", "house", "xqzvk"])))
    assert p["the"] > p["house"] > p["xqzvk"]


def plain_base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base score) by plain counting."""
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t, *_ in rows if not out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(words(t)), sum(w in c for w in words(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t, *_ in rows]


def check(frame, rows, **options):
    got = sorted(frame and L.scores(frame, **options).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    want = sorted(plain_base(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert np.allclose([r.base_score for r in got], [w[5] for w in want], rtol=1e-9)
    return got


def test_scores_of_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.collect()]
    by_rest = check(odd, rows, share=3, rounds=1)  # nearly all words go by the join
    by_head = check(odd, rows, rounds=1)
    assert [r.score for r in by_rest] == [r.score for r in by_head]
    empty = {r.score for r in by_head if r.n_tokens == 1}
    assert len(empty) == 1 and all(r.score < 0 for r in by_head)
    same = [r.score for r in by_head if r.doc_id in (1, 2)]
    assert len(same) == 3 and len(set(same)) == 1
    assert L.scores(none).count() == 0
    held = odd.where("doc_id is null")
    assert {(r.train_tokens, r.n_known, r.base_score) for r in L.scores(held).collect()} == {(0, 0, 0.0)}


def test_long_words_join_by_their_digest(spark):
    rows = [(i, f"w{i} {'x' * 40}{i % 3} {'y' * 3000} Tail", "en") for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string, key string"), rows, share=20, rounds=1)


def test_scores_follow_from_the_weights(spark, small):
    """The query's scores are the sums over words of what plain recursion in probabilities gives."""
    rows = [tuple(r) for r in small.collect()]
    pieces = L.public_pieces()
    got = check(small, rows)
    counts = L.token_counts(small).cache()
    weights = L.estimated(pieces, counts)
    assert weights.sum() == pytest.approx(1) and L.estimated(pieces, counts.repartition(7)) == pytest.approx(weights, abs=1e-12)
    lattice = L.Lattice(pieces, weights)

    @cache
    def word(w):
        codes, p = " " + w, [1.0]
        hashes = dict(zip(pieces.hashes.tolist(), weights))
        for i in range(1, len(codes) + 1):
            total = p[i - 1] * math.prod(weights[pieces.bytes_at + b] for b in codes[i - 1].encode())
            for k in range(1, min(16, i) + 1):
                h = np.zeros(1, np.uint64)
                for c in L.code_points(codes[i - k : i]).astype(np.uint64):
                    h = L._extended(h, c)
                total += p[i - k] * hashes.get(int(h[0]), 0.0)
            p.append(total)
        return math.log10(p[-1])

    some = {i: t for i, t, *_ in rows[:6]}
    for r in got:
        if r.doc_id in some:
            own = [w.decode() for w in L.tokens((some[r.doc_id] or "").encode())][:400]
            if r.n_tokens <= 401:
                assert r.score == pytest.approx(sum(map(word, own)) + math.log10(weights[pieces.end]), rel=1e-9)
    # Rounds raise the likelihood of training words, and held-out texts gain as well.
    before = L.Lattice(pieces, pieces.start)
    words = [(r.word, r.n) for r in counts.collect() if r.word]
    gain = lattice.log_probabilities([w for w, _ in words]) - before.log_probabilities([w for w, _ in words])
    assert (gain * [n for _, n in words]).sum() > 0
    start = {(r.doc_id, r.n_tokens): r.score for r in L.scores(small, rounds=0).collect()}
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(start[r.doc_id, r.n_tokens] for r in held)
    counts.unpersist()
