"""Windows of many series at once against a plain version of each window."""

import time

import numpy as np
import pandas as pd
import pytest

from marlstone.functions import windows
from marlstone.functions.windows import Ordered, Rows
from marlstone.operators import time_series  # noqa: F401
from marlstone.plans.spec import load

SIZES = [1, 2, 7, 0, 40, 3, 16, 95, 64]


def made(seed, sizes=SIZES, digits=1):
    rng = np.random.default_rng(seed)
    n = sum(sizes)
    x = np.round(rng.normal(size=n) * 3, digits)
    x[rng.random(n) < 0.2] = np.nan
    y = np.round(rng.normal(size=n) + 2, digits)
    y[rng.random(n) < 0.1] = np.nan
    return Rows(np.cumsum(sizes)), x, y


def spans(rows, w):
    return [(max(int(f), i - w + 1), i + 1) for i, f in enumerate(rows.first)]


@pytest.mark.parametrize("w", [1, 2, 3, 5, 16, 33, 1000])
def test_moments_and_pairs(w):
    rows, x, y = made(w)
    n, mean, m2, m3, m4 = windows.moments(rows, x, w, 4)
    p = windows.pairs(rows, x, y, w)
    for i, (a, b) in enumerate(spans(rows, w)):
        v = x[a:b][~np.isnan(x[a:b])]
        assert n[i] == len(v)
        if len(v):
            d = v - v.mean()
            assert np.allclose([mean[i], m2[i], m3[i], m4[i]], [v.mean(), (d**2).sum(), (d**3).sum(), (d**4).sum()], atol=1e-9)
        good = ~np.isnan(x[a:b]) & ~np.isnan(y[a:b])
        u, v = x[a:b][good], y[a:b][good]
        assert p[0][i] == len(u)
        if len(u):
            assert np.allclose([q[i] for q in p[1:]], [u.mean(), v.mean(), ((u - u.mean()) ** 2).sum(), ((v - v.mean()) ** 2).sum(), ((u - u.mean()) * (v - v.mean())).sum()], atol=1e-9)


@pytest.mark.parametrize("w", [1, 2, 4, 31, 500])
def test_extremes_sums_and_places(w):
    rows, x, _ = made(w + 50, digits=0)
    got = {k: g(rows, x, w) for k, g in (("max", windows.largest), ("min", windows.smallest), ("sum", windows.sums), ("prod", windows.products))}
    places = {(hi, early): windows.place_of(rows, x, w, hi, early) for hi in (True, False) for early in (True, False)}
    counts = windows.counts(rows, ~np.isnan(x), w)
    for i, (a, b) in enumerate(spans(rows, w)):
        v = x[a:b][~np.isnan(x[a:b])]
        assert counts[i] == len(v)
        assert got["max"][i] == (v.max() if len(v) else -np.inf) and got["min"][i] == (v.min() if len(v) else np.inf)
        assert got["sum"][i] == v.sum() and np.isclose(got["prod"][i], v.prod())
        for (hi, early), where in places.items():
            if not len(v):
                assert where[i] == -1
                continue
            same = a + np.nonzero(x[a:b] == (v.max() if hi else v.min()))[0]
            assert where[i] == (same[0] if early else same[-1])


@pytest.mark.parametrize("w", [1, 2, 6, 50, None])
def test_order_statistics(w):
    rows, x, y = made(99 if w is None else w, digits=0)
    values, left, right = windows.valid_ranges(rows, x, w)
    order = Ordered(values)
    q = {p: order.quantile(left, right, p) for p in (0.0, 0.25, 0.5, 0.9, 1.0)}
    mad = order.middle_distance(left, right, q[0.5])
    less, most = order.below(left, right, y), order.below(left, right, y, equal=True)
    far = windows.mean_distance(rows, x, w or rows.n, np.nan_to_num(y))
    for i, (a, b) in enumerate(spans(rows, w or rows.n)):
        v = x[a:b][~np.isnan(x[a:b])]
        if not len(v):
            assert np.isnan(mad[i]) and all(np.isnan(z[i]) for z in q.values()) and np.isnan(far[i])
            continue
        for p, z in q.items():
            assert np.isclose(z[i], np.quantile(v, p))
        assert np.isclose(mad[i], np.median(np.abs(v - np.median(v))))
        assert np.isclose(far[i], np.abs(v - np.nan_to_num(y)[i]).mean())
        if not np.isnan(y[i]):
            assert (less[i], most[i]) == ((v < y[i]).sum(), (v <= y[i]).sum())


def test_nothing_at_all():
    rows = Rows([])
    none = np.zeros(0)
    assert len(windows.sums(rows, none, 3)) == len(windows.moments(rows, none, 3)[1]) == len(Ordered(none).quantile(*[np.zeros(0, int)] * 2, 0.5)) == 0
    rows, x = Rows([4]), np.full(4, np.nan)
    values, left, right = windows.valid_ranges(rows, x, 2)
    assert np.isnan(Ordered(values).quantile(left, right, 0.5)).all() and (windows.moments(rows, x, 2)[0] == 0).all()


def test_equal_values_have_no_spread_and_outliers_leave_no_trace():
    x = np.array([1e12, 0.1, 0.1, 0.1, 0.1, 0.3, 0.3, 0.3, 0.3, 0.3, -1e12] * 40)
    rows = Rows([len(x)])
    n, mean, m2 = windows.moments(rows, x, 3, 2)
    for i, (a, b) in enumerate(spans(rows, 3)):
        if len(set(x[a:b])) == 1:
            assert m2[i] == 0 and mean[i] == x[i]
        else:
            d = x[a:b] - x[a:b].mean()
            assert m2[i] == pytest.approx((d**2).sum(), rel=1e-12)


def call(name, *x, rows, **params):
    with np.errstate(all="ignore"):
        return load()[name].build(rows, *x, **params)


def test_expanding_dense_rank():
    rows, x, _ = made(5, digits=0)
    for ascending in (True, False):
        got = call("unary.expanding_rank_pct", x, rows=rows, min_periods=2, ascending=ascending, ties_method="dense")
        for i, (a, b) in enumerate(spans(rows, rows.n)):
            v = sorted(set(x[a:b][~np.isnan(x[a:b])]), reverse=not ascending)
            want = np.nan if np.isnan(x[i]) or (~np.isnan(x[a:b])).sum() < 2 else (v.index(x[i]) + 1) / len(v)
            assert got[i] == want or np.isnan(got[i]) and np.isnan(want)


def test_time_does_not_depend_on_the_window():
    rng = np.random.default_rng(0)
    n = 1_000_000
    rows, x, y = Rows([n]), rng.normal(size=n), rng.normal(size=n)
    took = {}
    for w in (20, 2000, 20, 2000):
        for name, columns in (("unary.rolling_std", (x,)), ("binary.rolling_corr", (x, y)), ("unary.rolling_max", (x,)), ("unary.rolling_argmin", (x,)), ("unary.rolling_median", (x,))):
            began = time.process_time()
            call(name, *columns, rows=Rows([n]), window=w, min_periods=None)
            took[name, w] = min(took.get((name, w), 1e9), time.process_time() - began)
    assert all(took[k, 2000] < 1.5 * took[k, 20] + 0.1 for k, w in took if w == 20), took
    got = call("unary.rolling_std", x, rows=rows, window=2000, min_periods=None)
    assert np.allclose(got[1999::5003], pd.Series(x).rolling(2000).std()[1999::5003], rtol=1e-9)
    began = time.process_time()
    rank = call("unary.expanding_rank", x, rows=rows, min_periods=1, ascending=True, ties_method="min")
    middle = call("unary.expanding_median", x, rows=rows, min_periods=1)
    assert time.process_time() - began < 30
    for i in (0, 10, 999, 500_000, n - 1):
        assert rank[i] == (x[: i + 1] < x[i]).sum() + 1 and middle[i] == pytest.approx(np.median(x[: i + 1]))


def test_neutral_within_many_levels():
    rng = np.random.default_rng(1)
    neutral = load()["controls.neutralize_by"].build
    y, v, g = rng.normal(size=300), rng.normal(size=300), np.array([f"g{i}" for i in rng.integers(0, 7, 300)], dtype=object)
    y[5], v[9], g[11] = np.nan, np.nan, None
    good = ~np.isnan(y) & ~np.isnan(v) & np.array([x is not None for x in g])
    design = np.column_stack([np.ones(good.sum()), v[good], *[(g[good] == k).astype(float) for k in sorted(set(g[good]))[1:]]])
    want = y[good] - design @ np.linalg.lstsq(design, y[good], rcond=None)[0]
    assert np.allclose(neutral(y, [g, v], intercept=True)[good], want) and np.isnan(neutral(y, [g, v], intercept=True)[~good]).all()
    n = 200_000
    levels = np.array([f"g{i}" for i in rng.integers(0, 10_000, n)], dtype=object)
    y = rng.normal(size=n)
    began = time.process_time()
    left = neutral(y, [levels], intercept=True)
    assert time.process_time() - began < 20
    means = pd.Series(left).groupby(levels).mean()
    assert means.abs().max() < 1e-9 and len(means) > 9_900
