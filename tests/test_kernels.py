import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.functions import kernels, stats


def test_tails_against_closed_forms():
    # Student t with 1 degree of freedom is Cauchy; F(2, d) has a closed tail.
    r = 0.5
    t = math.sqrt(1 * r * r / (1 - r * r))
    assert stats.correlation_p(r, 3) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
    assert stats.f_tail(3.0, 2, 10) == pytest.approx((1 + 2 * 3.0 / 10) ** (-5), abs=1e-12)
    assert stats.correlation_p(1.0, 10) == 0.0
    assert math.isnan(stats.correlation_p(0.3, 2))


def test_digamma_is_a_harmonic_number():
    assert stats.digamma(1) == pytest.approx(-0.5772156649)
    assert stats.digamma(4) == pytest.approx(1 + 1 / 2 + 1 / 3 - 0.5772156649)


def test_unit_root_test_tells_walks_from_noise():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=400)
    assert stats.adf_p(noise) < 0.01
    assert stats.adf_p(np.cumsum(noise)) > 0.05
    assert len(stats.stationary(np.cumsum(noise))) == 399


def test_granger_finds_the_leader():
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    y = np.concatenate(([0], 0.8 * x[:-1])) + 0.3 * rng.normal(size=500)
    assert stats.lag_order(x, y, 5) == 1
    assert stats.granger(x, y, 1)[1] < 1e-6 < stats.granger(y, x, 1)[1]


def test_information_of_dependent_series_is_positive():
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    assert stats.ksg(x, rng.normal(size=300)) < 0.1
    rho = 0.9
    y = rho * x + math.sqrt(1 - rho * rho) * rng.normal(size=300)
    assert stats.ksg(x, y) == pytest.approx(-0.5 * math.log(1 - rho * rho), abs=0.2)


def test_precision_matrices():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4))
    x[:, 1] += x[:, 0]
    w = stats.ledoit_wolf(x)
    assert np.allclose(w, w.T) and np.linalg.eigvalsh(w).min() > 0
    p = stats.graphical_lasso_cv(x)
    assert p[0, 1] < -0.2 and abs(p[2, 3]) < 0.1


K5 = list(itertools.combinations(range(5), 2))
K33 = [(a, b) for a in range(3) for b in range(3, 6)]


def test_planarity():
    assert not kernels.is_planar(K5)
    assert not kernels.is_planar(K33)
    assert kernels.is_planar(K5[1:])
    assert kernels.is_planar(K33[1:])
    grid = [((i, j), (i + 1, j)) for i in range(5) for j in range(6)] + [((i, j), (i, j + 1)) for i in range(6) for j in range(5)]
    assert kernels.is_planar(grid)
    subdivided = [e for k, (a, b) in enumerate(K5) for e in ((a, 100 + k), (100 + k, b))]
    assert not kernels.is_planar(subdivided)
    petersen = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
    assert not kernels.is_planar(petersen)


def test_planar_filter_of_k5_drops_one_edge():
    assert len(kernels.planar_filter(K5, 5)) == 9


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20))
def test_betweenness_sums_to_inner_vertices_of_paths(edges):
    adj = {}
    for a, b in edges:
        if a != b:
            adj.setdefault(a, []).append((b, 1.0))
            adj.setdefault(b, []).append((a, 1.0))
    adj = {a: sorted(set(n)) for a, n in adj.items()}
    for v in adj:
        d = kernels.distances(v, adj)
        assert sum(kernels.dependencies(v, adj).values()) == pytest.approx(sum(x - 1 for x in d.values() if x))
        assert sum(kernels.dependencies(v, adj, weighted=True).values()) == pytest.approx(sum(x - 1 for x in d.values() if x))


def test_communities_of_two_cliques():
    clique = lambda o: [(o + a, o + b, 1.0) for a, b in itertools.combinations(range(5), 2)]
    edges = clique(0) + clique(10) + [(0, 10, 1.0)]
    vertices = [*range(5), *range(10, 15)]
    for method in (kernels.louvain, kernels.greedy_modularity):
        c = method(edges, vertices)
        assert len({c[v] for v in range(5)}) == 1 and len(set(c.values())) == 2


def test_kmeans_splits_clear_groups():
    x = np.vstack([np.zeros((5, 2)), np.ones((5, 2)) * 9])
    own = kernels.kmeans(x, 2)
    assert len(set(own[:5])) == 1 and own[0] != own[9]
