"""Nearest-neighbour importance against all pairs, and the critical line against its conditions."""

import numpy as np
import pytest

from tessella.operators import information, optimize


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def plain(x, y, k=3):
    cx, cy = (1 / (v.std() or 1.0) for v in (x, y))
    dx, dy = np.abs(x[:, None] - x[None]) * cx, np.abs(y[:, None] - y[None]) * cy
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, 1)[:, k - 1][:, None]
    count = lambda e: (np.where(r > 0, e < r, e <= 0)).sum(1)
    mean = np.mean([digamma(a) + digamma(b) for a, b in zip(count(dx), count(dy), strict=True)])
    return max(0.0, digamma(len(x)) + digamma(k) - mean)


@pytest.mark.parametrize("strip,least", [(8, 512), (1, 20)])
def test_importance_is_that_of_all_pairs(spark, monkeypatch, strip, least):
    monkeypatch.setattr(information, "STRIP", strip)
    monkeypatch.setattr(information, "LEAST", least)
    rnd = np.random.default_rng(3)
    n = 2000
    y = rnd.normal(size=n)
    table = {
        "near": y + rnd.normal(size=n) * 0.3, "none": rnd.normal(size=n), "square": y * y, "heavy": rnd.standard_cauchy(n) * 1e3,
        "tied": np.where(rnd.random(n) < 0.4, 7.0, np.round(y, 1)), "whole": rnd.integers(0, 50, n).astype(float), "same": np.full(n, 2.0),
    }
    y[:40] = y[40]
    for v in table.values():
        v[:20] = v[40]  # equal rows
    rows = [tuple(map(float, r)) for r in zip(y, *table.values(), strict=True)] + [(None, *[1.0] * 7), (1.0, float("nan"), *[1.0] * 6)]
    df = spark.createDataFrame(rows, "target double, " + ", ".join(f"{c} double" for c in table)).repartition(5)
    got = {r.feature: r.importance for r in information.knn_information(df, "target", list(table)).collect()}
    assert set(got) == set(table)
    for c, v in table.items():
        assert got[c] == pytest.approx(plain(v, y), abs=1e-9), c
    assert got["near"] > got["none"] and got["square"] > 0.5


def test_importance_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "y double, x double")
    assert [tuple(r) for r in information.knn_information(df, "y", ["x"]).collect()] == [("x", 0.0)]
    assert information.knn_information(df.where("x > 9"), "y", ["x"]).count() == 0
    few = spark.createDataFrame([(float(i), float(i * i % 7)) for i in range(9)], "y double, x double")
    x = np.array([i * i % 7 for i in range(9)], float)
    assert information.knn_information(few, "y", ["x"]).first().importance == pytest.approx(plain(x, np.arange(9.0)), abs=1e-9)


def problem(rnd, case):
    n, days = int(rnd.integers(1, 25)), int(rnd.integers(30, 200))
    cov = np.cov((rnd.normal(size=(days, n)) * rnd.uniform(0.5, 2, n)).T).reshape(n, n)
    mu = rnd.normal(size=n) * 0.1
    mu = np.round(mu, 1) if case % 5 == 0 else np.full(n, 0.1) if case % 7 == 0 else mu
    return optimize.Moments(tuple(f"t{i}" for i in range(n)), mu, cov)


def test_every_corner_is_optimal():
    rnd = np.random.default_rng(1)
    for case in range(150):
        x = problem(rnd, case)
        low, high = rnd.choice([0.0, 0.01]), rnd.choice([0.4, 0.5, 1.0])
        if not optimize.feasible(len(x.mu), low, high):
            continue
        at, ends = optimize.path(x, low, high)
        for g, w in zip(at[1:], ends[1:], strict=True):
            assert optimize.residual(x, w, g, low, high) < 1e-9 * max(1.0, g)
        assert ends[0] @ x.mu == pytest.approx(max(w @ x.mu for w in ends))
        for g in (0.0, 0.05, 0.7):
            assert optimize.residual(x, optimize.solve(x, low, high, g), g / 2, low, high) < 1e-9


def test_no_portfolio_is_better_than_the_path():
    rnd = np.random.default_rng(2)
    for case in range(60):
        x = problem(rnd, case)
        if not optimize.feasible(len(x.mu), 0.0, 0.4):
            continue
        ends = optimize.corners(x, 0.0, 0.4)
        for _ in range(40):
            w = rnd.dirichlet(np.ones(len(x.mu)) * rnd.choice([0.3, 1.0, 5.0]))
            if (w > 0.4).any():
                continue
            best = optimize.least_risk_at(x, ends, w @ x.mu)
            assert optimize.spread(x, best) <= optimize.spread(x, w) + 1e-12 and best @ x.mu >= w @ x.mu - 1e-12
            loose, said = optimize.max_return(x, 0.4, optimize.spread(x, w))
            assert said == "optimal" and loose @ x.mu >= w @ x.mu - 1e-9 and optimize.spread(x, loose) <= optimize.spread(x, w) + 1e-12


def test_many_assets_are_not_refused():
    rnd = np.random.default_rng(4)
    n = 150
    x = optimize.Moments(tuple(map(str, range(n))), rnd.normal(size=n) * 0.01, np.cov(rnd.normal(size=(400, n)).T))
    assert not hasattr(optimize, "MAX_ASSETS")
    w, said = optimize.min_variance(x, 0.0, 0.5)
    assert said == "optimal" and optimize.residual(x, w, 0.0, 0.0, 0.5) < 1e-9
