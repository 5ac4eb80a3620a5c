"""Matching blocks against Python's own matcher."""

import difflib

import numpy as np
import pytest

from markwright.functions import sequences


def _text(rng, n, letters):
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


def _pair(rng, most):
    """Two texts that share stretches: random ones, edited copies, repeats, and texts of few letters."""
    letters = ["ab", "abcd", "abcdefghij ", "etaoin shrdlu", "abcdefghijklmnopqrstuvwxyz 0123456789éß"][rng.integers(0, 5)]
    a = _text(rng, int(rng.integers(0, most)), letters)
    kind = rng.integers(0, 4)
    if kind == 0:
        return a, _text(rng, int(rng.integers(0, most)), letters)
    b = list(a)
    for _ in range(int(rng.integers(0, 8))):
        at = int(rng.integers(0, len(b) + 1))
        b[at : at + int(rng.integers(0, 6))] = _text(rng, int(rng.integers(0, 6)), letters)
    b = "".join(b)
    if kind == 2:
        cut = len(b) // 2
        b = b[cut:] + b[:cut]
    if kind == 3:
        a, b = a[: most // 3] * 2, b[: most // 4] * 3
    return a, b


@pytest.mark.parametrize(("pairs", "most"), [(8600, 60), (1300, 260), (90, 1200), (10, 5000)])
def test_blocks_are_those_of_the_library(pairs, most):
    rng = np.random.default_rng(most)
    for _ in range(pairs):
        a, b = _pair(rng, most)
        matcher = difflib.SequenceMatcher(None, a, b)
        assert sequences.ratio(a, b) == matcher.ratio(), (a, b)
        merged = []
        for i, j, n in sequences.matching_blocks(a, b):
            if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
                merged[-1] = (merged[-1][0], merged[-1][1], merged[-1][2] + n)
            else:
                merged.append((i, j, n))
        assert merged == [tuple(m) for m in matcher.get_matching_blocks()[:-1]], (a, b)


def test_the_automaton_is_linear():
    for x in ("a" * 3000, "ab" * 1500, "".join(chr(97 + i * i % 26) for i in range(3000))):
        assert len(sequences.SuffixAutomaton(x, 0, len(x), frozenset()).next) <= 2 * len(x)


def test_line_scores_are_those_of_trying_all_windows():
    def slow(t, c):
        a, b = t.split(), c.split()
        if not a or not b:
            return 0.0
        of = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
        both, tol = len(set(a) & set(b)), 1 if len(a) <= 3 else max(2, int(len(a) * 0.35))
        local = max((of(t, " ".join(b[i : i + n])) for n in range(max(1, len(a) - tol), min(len(b), len(a) + tol) + 1) for i in range(len(b) - n + 1)), default=0.0)
        score = 0.55 * both / len(set(a)) + 0.25 * local + 0.15 * both / len(set(a) | set(b)) + 0.05 * of(t, c)
        return min(1.0, score + (0.10 if both / len(set(a)) >= 0.75 else 0.0))

    rng = np.random.default_rng(9)
    words = ["the", "water", "cycle", "rain", "evaporates", "sun", "a", "of", "seas", "clouds"]
    for _ in range(150):
        t, c = (" ".join(words[i] for i in rng.integers(0, 10, rng.integers(0, n))) for n in (12, 30))
        c = c.replace("a", "o", int(rng.integers(0, 3)))
        assert sequences.line_score(t, c) == pytest.approx(slow(t, c), abs=1e-12)
    assert sequences.line_score(None, "a") == 0.0 == sequences.line_score("a", "")


def test_containment_counts_as_equal():
    assert sequences.sequence_score("water", "the water") == 1.0
    assert sequences.sequence_score("", "x") == 0.0 == sequences.sequence_score(None, None)


def test_best_lines_are_those_of_scoring_all():
    rng = np.random.default_rng(3)
    words = ["".join("abcde"[k] for k in rng.integers(0, 5, 3)) for _ in range(30)]
    text = lambda most: " ".join(words[k] for k in rng.integers(0, 30, rng.integers(0, most)))
    looked = 0
    for _ in range(60):
        target, lines = text(9), [text(25) for _ in range(6)]
        scores = [sequences.line_score(target, x) for x in lines]
        found = dict(sequences.best_lines(target, lines))
        looked += len(found)
        assert all(scores[at] == x for at, x in found.items())
        assert {at for at, x in enumerate(scores) if x >= max(scores) - 1e-4} <= found.keys()
    assert looked < 60 * 6 / 2  # lines that can't be best aren't worked out
    assert sequences.best_lines(None, ["a", ""]) == [(0, 0.0), (1, 0.0)]


def test_both_ways_to_the_longest_block():
    rng = np.random.default_rng(5)
    for _ in range(1500):
        a, b = _pair(rng, 300)
        dead = sequences.popular(b)
        alive = sequences.live(a, dead) if dead else None
        searched = sequences._found_block(a, b, 0, len(a), 0, len(b), alive)
        assert searched == sequences._automaton_block(a, b, 0, len(a), 0, len(b), dead), (a, b)
