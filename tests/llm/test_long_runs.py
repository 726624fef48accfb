"""Language ID sums over all segmentations of a letter run, however long it is."""

import math

import numpy as np
import pytest

from kerbline.llm import langid


def slow_sums(unit, ids, probs, unknown):
    """(log of the sum over all segmentations, expected number of each piece), with exact integers for floats' range."""
    from fractions import Fraction

    p = [Fraction(float(x)) for x in probs]
    arcs = [(i, j, ids[unit[i:j]]) for i in range(len(unit)) for j in range(i + 1, min(len(unit), i + 9) + 1) if unit[i:j] in ids]
    arcs += [(i, i + 1, unknown) for i, c in enumerate(unit) if c not in ids]
    fore, back = ([Fraction(0)] * (len(unit) + 1) for _ in range(2))
    fore[0] = back[-1] = Fraction(1)
    for i, j, k in sorted(arcs, key=lambda a: a[1]):
        fore[j] += fore[i] * p[k]
    for i, j, k in sorted(arcs, key=lambda a: -a[0]):
        back[i] += p[k] * back[j]
    counts = np.zeros(len(p))
    for i, j, k in arcs:
        counts[k] += float(fore[i] * p[k] * back[j] / fore[-1])
    return math.log(fore[-1].numerator) - math.log(fore[-1].denominator), counts


@pytest.mark.parametrize("run", ["ab", "abc" * 7 + "ab", "abc" * 8, "abcab" * 9, "zab" * 60, "z" * 150])
def test_every_segmentation_counts(run):
    names = sorted(["a", "b", "c", "ab", "bc", "abc", "cab", "abcabc", "▁a", "▁"])
    pieces = langid.Pieces(names)
    ids = {x: i for i, x in enumerate(names)}
    probs = np.random.default_rng(1).dirichlet(np.ones(len(names) + 1), 2).T
    probs[-1] = 1e-9
    got = langid.run_likelihoods(pieces, probs, [run, "b", run])
    counts, _ = langid.expected_counts(pieces, np.ascontiguousarray(probs[:, 0]), ["▁" + run], np.array([3.0]))
    for k in range(2):
        want, number = slow_sums("▁" + run, ids, probs[:, k], len(names))
        assert got[0, k] == got[2, k] == pytest.approx(want, rel=1e-9)
        if k == 0:
            assert counts == pytest.approx(3 * number, rel=1e-6, abs=1e-9)


def test_very_long_runs_stay_finite():
    pieces = langid.Pieces(["a", "aa", "▁"])
    assert np.isfinite(langid.run_likelihoods(pieces, np.full((4, 2), 1e-10), ["a" * 20_000, "q" * 5_000])).all()
