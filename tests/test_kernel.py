import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riverstone.operators import kernel

MODES = ["sequential", "rounds"]


def cost(points, weights, centres):
    d = ((points[:, None, :] - points[centres][None, :, :]) ** 2).sum(axis=2)
    return float((weights * d.min(axis=1)).sum())


@pytest.mark.parametrize("mode", MODES)
@given(n=st.integers(1, 120), d=st.integers(1, 12), m=st.integers(1, 40), kinds=st.integers(1, 120), seed=st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_invariants(mode, n, d, m, kinds, seed):
    """Mass is kept, centres are distinct rows, no more than m, and none stands for nothing; with duplicates too."""
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(min(kinds, n), d))[rng.integers(0, min(kinds, n), n)]
    weights = rng.integers(1, 5, n).astype(float)
    at, mass = kernel.coreset(points, weights, m, kernel.generator(seed), mode=mode)
    assert len(at) == len(set(at.tolist())) <= min(m, n)
    assert abs(mass.sum() - weights.sum()) < 1e-9 and (mass > 0).all()
    if n > m:
        assert len(at) == min(m, len(np.unique(points[at], axis=0)))


@pytest.mark.parametrize("mode", MODES)
def test_cost_falls_with_m_and_is_near_k_means(mode):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.3, (700, 3)) for c in ((0, 0, 0), (5, 5, 0), (0, 5, 5))])
    w = np.ones(len(points))
    costs = [np.mean([cost(points, w, kernel.coreset(points, w, m, kernel.generator(s), mode=mode)[0]) for s in range(5)]) for m in (1, 3, 10, 50, 200)]
    assert all(a > b for a, b in zip(costs, costs[1:], strict=False))
    assert costs[1] < 4 * 2100 * 3 * 0.09
    uniform = np.mean([cost(points, w, np.random.default_rng(s).integers(0, len(points), 50)) for s in range(5)])
    assert costs[3] < 1.2 * uniform


@pytest.mark.parametrize("mode", MODES)
def test_mass_of_a_leaf_is_that_of_its_points(mode):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.01, (n, 2)) for c, n in (((0, 0), 100), ((9, 9), 300))])
    at, mass = kernel.coreset(points, np.ones(400), 2, kernel.generator(4), mode=mode)
    assert sorted(mass) == [100, 300] and sorted(points[at][:, 0].round()) == [0, 9]


@pytest.mark.parametrize("mode", MODES)
def test_options(mode):
    rng = np.random.default_rng(2)
    points, w = rng.normal(size=(300, 5)), rng.integers(1, 4, 300).astype(float)
    for metric, pick in (("cosine", "farthest"), ("cosine", "d2"), ("l2", "farthest")):
        at, mass = kernel.coreset(points, w, 20, kernel.generator(1), mode=mode, metric=metric, pick=pick)
        assert len(at) == 20 and abs(mass.sum() - w.sum()) < 1e-9
    _, rows = kernel.coreset(points, w, 20, kernel.generator(1), mode=mode, weight_mode="leaf_count", cost_mode="unweighted")
    assert rows.sum() == 300
    a, b = (kernel.coreset(points, w, 20, kernel.generator(9), mode=mode)[0].tolist() for _ in range(2))
    assert a == b
    with pytest.raises(ValueError):
        kernel.coreset(points, w, 0, kernel.generator(1))


@pytest.mark.parametrize("mode", MODES)
def test_small_inputs_pass_through(mode):
    points = np.array([[1.0], [2.0], [2.0]])
    for m in (3, 10):
        at, mass = kernel.coreset(points, np.array([1.0, 2.0, 3.0]), m, kernel.generator(0), mode=mode)
        assert at.tolist() == [0, 1, 2] and mass.tolist() == [1, 2, 3]
    at, mass = kernel.coreset(points, np.array([1.0, 0.0, 3.0]), 1, kernel.generator(0), mode=mode)
    assert mass.tolist() == [4.0] and at[0] in (0, 2)
    at, _ = kernel.coreset(np.zeros((0, 2)), np.zeros(0), 3, kernel.generator(0), mode=mode)
    assert len(at) == 0


def test_draws_are_distinct_and_positive():
    rng = np.random.default_rng(0)
    for _ in range(300):
        c = rng.random(rng.integers(1, 8)) * (rng.random() < 0.9)
        c[rng.random(len(c)) < 0.4] = 0
        got = kernel._drawn(c, 3, rng)
        assert len(set(got.tolist())) == len(got) == min(3, int((c > 0).sum())) and (c[got] > 0).all()


def test_scan_goes_on_to_a_better_point():
    """Each try takes the first point from its draw on that beats the tries before, as a plain loop does."""
    rng = np.random.default_rng(6)
    for seed in range(40):
        points, w = rng.normal(size=(30, 2)), rng.integers(1, 4, 30).astype(float)
        at, mass = kernel.coreset(points, w, 2, kernel.generator(seed), pick="scan")
        draw = kernel.generator(seed)
        total = np.cumsum(w)
        first = int(np.searchsorted(total, draw.random() * total[-1], side="right"))
        own = w * ((points - points[first]) ** 2).sum(axis=1)
        least, picked = np.inf, None
        for u in draw.random(3):
            for c in range(30):
                if own[: c + 1].sum() > u * own.sum() and (left := cost(points, w, [first, c])) < least - 1e-12:
                    least, picked = left, c
                    break
        assert set(at.tolist()) == {first, picked} and abs(mass.sum() - w.sum()) < 1e-9
