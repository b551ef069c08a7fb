"""Operators over the rows of one code in time order. Windows count rows; aggregates skip NULL and are NULL below min_periods."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scan, windows
from ..functions.columns import correlation, finite_or_null, safe_div
from ..plans.spec import Bool, Choice, Float, Int, RequestError, operator


def _d(c):
    return c.cast("double")


def _window_rule(p):
    if p.get("min_periods") is not None and p["min_periods"] > p["window"]:
        raise RequestError("min_periods may not exceed window")


ROLLING = {"window": Int(ge=1), "min_periods": Int(None, ge=1)}
EXPANDING = {"min_periods": Int(1, ge=1)}


def _rolling(name, fields="col", output="NUMBER", **more):
    params = ROLLING | more.pop("params", {})
    return operator("TS", name, fields, output, rule=_window_rule, params=params, **more)


def _expanding(name, fields="col", **more):
    return operator("TS", name, fields, params=EXPANDING | more.pop("params", {}), **more)


def _guard(frame, valid, least, value):
    return F.when(F.count(valid).over(frame) >= least, value)


def _both(left, right):
    return F.when(left.isNotNull() & right.isNotNull(), F.lit(1))


def _least(window, min_periods):
    return window if min_periods is None else min_periods


# Expanding forms: Spark carries these aggregates from row to row.
_SO_FAR = {
    "mean": lambda c, w: F.avg(_d(c)).over(w),
    "sum": lambda c, w: F.sum(_d(c)).over(w),
    "min": lambda c, w: F.min(c).over(w),
    "max": lambda c, w: F.max(c).over(w),
    "prod": lambda c, w: F.product(_d(c)).over(w),
    "count": lambda c, w: F.count(c).over(w),
    "std": lambda c, w: F.stddev_samp(_d(c)).over(w),
    "var": lambda c, w: F.var_samp(_d(c)).over(w),
    "sem": lambda c, w: F.stddev_samp(_d(c)).over(w) / F.sqrt(F.count(c).over(w)),
}
for _name in ("count", "max", "mean", "min", "prod", "sum"):
    _expanding(f"unary.cum_{_name}", scan=scan.running(_name))(lambda f, col, min_periods, g=_SO_FAR[_name]: _guard(f.past(), col, min_periods, g(col, f.past())))
for _name in ("sem", "std", "var"):
    _expanding(f"unary.expanding_{_name}", scan=scan.running(_name))(lambda f, col, min_periods, g=_SO_FAR[_name]: _guard(f.past(), col, min_periods, g(col, f.past())))

_EXPANDING_TWO = {
    "beta": lambda x, y, w: finite_or_null(F.regr_slope(_d(y), _d(x)).over(w)),
    "corr": lambda x, y, w: correlation(x, y, lambda c: c.over(w)),
    "cov": lambda x, y, w: F.covar_samp(_d(x), _d(y)).over(w),
}
for _name, _g in _EXPANDING_TWO.items():
    _expanding(f"binary.expanding_{_name}", "left right", scan=scan.running_pairs(_name))(lambda f, left, right, min_periods, g=_g: _guard(f.past(), _both(left, right), min_periods, g(left, right, f.past())))


# Rolling forms would make Spark go through every row's frame anew. They are kernels over all series of a pass, whose time doesn't depend on the window.
def _moment(value, order=2):
    return lambda rows, x, w: value(x, *windows.moments(rows, x, w, order))


def _root(x):
    return np.sqrt(np.where(x >= 0, x, np.nan))


def _sample(n, total):
    return np.where(n > 1, total / (n - 1), np.nan)


def _skew(x, n, mean, m2, m3):
    """Two values have no skew; equal ones have none that is defined."""
    return np.where(n == 2, 0.0, np.where(m2 > 0, np.sqrt(n) * m3 / m2**1.5, np.nan))


def _extreme(g):
    return lambda rows, x, w: np.where(np.isfinite(v := g(rows, x, w)), v, np.nan)


_WINDOW_ONE = {
    "mean": windows.means,
    "sum": windows.sums,
    "min": _extreme(windows.smallest),
    "max": _extreme(windows.largest),
    "prod": windows.products,
    "count": lambda rows, x, w: windows.counts(rows, ~np.isnan(x), w).astype(float),
    "std": _moment(lambda x, n, mean, m2: _root(_sample(n, m2))),
    "var": _moment(lambda x, n, mean, m2: _sample(n, m2)),
    "sem": _moment(lambda x, n, mean, m2: _root(_sample(n, m2)) / np.sqrt(n)),
    "zscore": _moment(lambda x, n, mean, m2: np.where(m2 > 0, (x - mean) / _root(_sample(n, m2)), np.nan)),
    "skew": _moment(_skew, 3),
    "kurt": _moment(lambda x, n, mean, m2, m3, m4: np.where((n >= 3) & (m2 > 0), n * m4 / m2**2, np.nan), 4),
    "median": lambda rows, x, w: _quantile(rows, x, w, 0.5),
}


def _quantile(rows, x, w, q):
    values, left, right = windows.valid_ranges(rows, x, w)
    return windows.Ordered(values).quantile(left, right, q)


def _enough(rows, good, window, min_periods, value):
    return np.where(windows.counts(rows, good, window) >= _least(window, min_periods), value, np.nan)


for _name, _g in _WINDOW_ONE.items():
    _rolling(f"unary.rolling_{_name}", joint=True)(lambda rows, x, window, min_periods, g=_g: _enough(rows, ~np.isnan(x), window, min_periods, g(rows, x, window)))
Q = {"q": Float(ge=0, le=1)}
_rolling("unary.rolling_quantile", joint=True, params=Q)(lambda rows, x, window, min_periods, q: _enough(rows, ~np.isnan(x), window, min_periods, _quantile(rows, x, window, q)))


def _expanding_quantile(rows, x, min_periods, q=0.5):
    values, left, right = windows.valid_ranges(rows, x, None)
    return np.where(right - left >= min_periods, windows.Ordered(values).quantile(left, right, q), np.nan)


_expanding("unary.expanding_median", joint=True)(_expanding_quantile)
_expanding("unary.expanding_quantile", joint=True, params=Q)(_expanding_quantile)


@_rolling("unary.rolling_last")
def rolling_last(f, col, window, min_periods):
    """The value at the row itself."""
    seen = yield F.count(col).over(f.past())
    return F.when(_within(f, seen, window) >= _least(window, min_periods), col)


@_rolling("unary.rolling_first")
def rolling_first(f, col, window, min_periods):
    """The value at the window's first row, NULL or not."""
    row = yield _row(f)
    seen = yield F.count(col).over(f.past())
    first = F.when(row >= window, F.lag(col, window - 1).over(f.series())).otherwise(F.first(col).over(f.past()))
    return F.when(_within(f, seen, window) >= _least(window, min_periods), first)


def _within(f, seen, window):
    """How many of a window's rows count, from the numbers so far."""
    return seen - F.coalesce(F.lag(seen, window).over(f.series()), F.lit(0))


def _beta(n, mx, my, xx, yy, xy):
    return np.where(xx > 0, xy / xx, np.nan)


_WINDOW_TWO = {
    "beta": lambda x, y, *m: _beta(*m),
    "alpha": lambda x, y, *m: m[2] - _beta(*m) * m[1],
    "corr": lambda x, y, n, mx, my, xx, yy, xy: np.where((xx > 0) & (yy > 0), xy / np.sqrt(xx * yy), np.nan),
    "cov": lambda x, y, n, mx, my, xx, yy, xy: _sample(n, xy),
    "residual": lambda x, y, *m: y - m[2] - _beta(*m) * (x - m[1]),
}
for _name, _g in _WINDOW_TWO.items():
    _rolling(f"binary.rolling_{_name}", "left right", joint=True)(lambda rows, x, y, window, min_periods, g=_g: _enough(rows, ~np.isnan(x) & ~np.isnan(y), window, min_periods, g(x, y, *windows.pairs(rows, x, y, window))))


def _crossing(above):
    def build(f, left, right):
        was_left, was_right = F.lag(left).over(f.series()), F.lag(right).over(f.series())
        now, before = (left > right, was_left <= was_right) if above else (left < right, was_left >= was_right)
        return F.coalesce(now & before, F.lit(False))

    return build


operator("TS", "binary.cross_above", "left right", "BOOL")(_crossing(True))
operator("TS", "binary.cross_below", "left right", "BOOL")(_crossing(False))


def _ts(name, output="NUMBER", **more):
    return operator("TS", f"unary.{name}", "col", output, **more)


def _row(f):
    return F.row_number().over(f.series())


@_ts("bars_since")
def bars_since(f, col):
    """Rows since the last true one; NULL before the first."""
    row = yield _row(f)
    return row - F.max(F.when(col, row)).over(f.past())


LIMIT = {"limit": Int(None, ge=1)}
_ts("ffill", "ANY", params=LIMIT)(lambda f, col, limit: F.last(col, ignorenulls=True).over(f.past() if limit is None else f.between(-limit, 0)))
_ts("bfill", "ANY", params=LIMIT)(lambda f, col, limit: F.first(col, ignorenulls=True).over(f.future() if limit is None else f.between(0, limit)))


@_ts("changed", "BOOL", params={"null_equal": Bool(False)})
def changed(f, col, null_equal):
    """The first row has changed; two NULLs have unless null_equal."""
    before = F.lag(col).over(f.series())
    return F.when(_row(f) == 1, True).when(col.isNull() & before.isNull(), F.lit(not null_equal)).otherwise(~col.eqNullSafe(before))


@_ts("consecutive_count")
def consecutive_count(f, col):
    """Length of the run of true rows so far; a NULL neither adds to it nor ends it."""
    isle = yield F.sum(F.when(~col, 1).otherwise(0)).over(f.past())
    return F.sum(F.when(col, 1).otherwise(0)).over(f.past(isle))


def rising_mean(rows, x, window):
    """Window mean with weights 1, 2, ... from the window's first row on, missing values left out: by the mean row, the mean value and their central product."""
    n, at, mean, _, _, both = windows.pairs(rows, rows.at.astype(float), x, window)
    weight = at - rows.since(window) + 1
    return np.where(n > 0, mean + both / np.where(n > 0, n * weight, 1), np.nan)


@_rolling("unary.decay_linear", joint=True)
def decay_linear(rows, x, window, min_periods):
    """Weights 1..window, the newest heaviest; only full windows count."""
    full = rows.at - rows.since(window) + 1 == window
    return np.where(full, _enough(rows, ~np.isnan(x), window, min_periods, rising_mean(rows, x, window)), np.nan)


PERIODS = {"periods": Int(1, ge=1)}
_ts("diff", params=PERIODS, chunk=lambda rows, x, periods: x - windows.lagged(rows, x, periods))(lambda f, col, periods: _d(col) - F.lag(_d(col), periods).over(f.series()))
_ts("log_return", params=PERIODS, chunk=lambda rows, x, periods: np.log(x) - np.log(windows.lagged(rows, x, periods)))(lambda f, col, periods: F.log(_d(col)) - F.log(F.lag(_d(col), periods).over(f.series())))
_ts("pct_change", params=PERIODS, chunk=lambda rows, x, periods: x / windows.lagged(rows, x, periods) - 1)(lambda f, col, periods: safe_div(_d(col), F.lag(_d(col), periods).over(f.series())) - 1)
_ts("shift", params={"periods": Int(1)})(lambda f, col, periods: F.lag(col, periods).over(f.series()))


def _flags(f, col, window):
    """(rows, values, true values) of each window, from the numbers so far; whole numbers, so a difference is exact."""
    row = yield _row(f)
    seen = yield F.count(col).over(f.past())
    true = yield F.count(F.when(col, 1)).over(f.past())
    return F.least(row, F.lit(window)), _within(f, seen, window), _within(f, true, window)


@_rolling("unary.rolling_all", output="BOOL")
def rolling_all(f, col, window, min_periods):
    """False below min_periods."""
    _, n, true = yield from _flags(f, col, window)
    return F.coalesce((n >= _least(window, min_periods)) & (true == n), F.lit(False))


@_rolling("unary.rolling_any", output="BOOL")
def rolling_any(f, col, window, min_periods):
    """False below min_periods."""
    _, n, true = yield from _flags(f, col, window)
    return F.coalesce((n >= _least(window, min_periods)) & (true > 0), F.lit(False))


@_rolling("unary.rolling_true_count")
def rolling_true_count(f, col, window, min_periods):
    """NULL counts as false, so the guard counts rows."""
    n, _, true = yield from _flags(f, col, window)
    return F.when(n >= _least(window, min_periods), true)


def _place(highest):
    def build(rows, x, window, min_periods):
        """Rows from the window's first to its earliest extreme."""
        at = windows.place_of(rows, x, window, highest, earliest=True)
        return _enough(rows, ~np.isnan(x), window, min_periods, np.where(at >= 0, at - rows.since(window), np.nan))

    return build


_rolling("unary.rolling_argmax", joint=True)(_place(True))
_rolling("unary.rolling_argmin", joint=True)(_place(False))


@_rolling("unary.rolling_mad", joint=True)
def rolling_mad(rows, x, window, min_periods):
    """Median distance from the median."""
    values, left, right = windows.valid_ranges(rows, x, window)
    order = windows.Ordered(values)
    return np.where(right - left >= _least(window, min_periods), order.middle_distance(left, right, order.quantile(left, right, 0.5)), np.nan)


def _ranks(order, left, right, x, ascending, ties_method):
    """Rank of x among the values of each range, x itself one of them."""
    less, most = order.below(left, right, x), order.below(left, right, x, equal=True)
    if not ascending:
        less, most = right - left - most, right - left - less
    return {"min": less + 1, "max": most, "average": (less + 1 + most) / 2}[ties_method]


def _rolling_rank(share):
    def build(rows, x, window, min_periods, ascending, ties_method):
        values, left, right = windows.valid_ranges(rows, x, window)
        rank = _ranks(windows.Ordered(values), left, right, x, ascending, ties_method)
        n = right - left
        return np.where(~np.isnan(x) & (n >= _least(window, min_periods)), rank / n if share else rank, np.nan)

    return build


_RANK = {"ascending": Bool(True), "ties_method": Choice("min", "max", "average", default="min")}
_rolling("unary.rolling_rank", joint=True, params=_RANK)(_rolling_rank(False))
_rolling("unary.rolling_rank_pct", joint=True, params=_RANK)(_rolling_rank(True))


def _firsts(rows, x):
    """x where a series has a value for the first time, else NaN."""
    _, code = np.unique(x, return_inverse=True)
    series = np.searchsorted(rows.ends, rows.at, "right")
    _, at = np.unique(series * (int(code.max(initial=0)) + 1) + code, return_index=True)
    out = np.full(rows.n, np.nan)
    out[at] = x[at]
    return out


def _expanding_rank(share):
    def build(rows, x, min_periods, ascending, ties_method):
        """A dense rank is one among each value's first places."""
        values, left, right = windows.valid_ranges(rows, x, None)
        good = ~np.isnan(x) & (right - left >= min_periods)
        if ties_method == "dense":
            values, left, right = windows.valid_ranges(rows, _firsts(rows, x), None)
        rank = _ranks(windows.Ordered(values), left, right, x, ascending, "min" if ties_method == "dense" else ties_method)
        return np.where(good, rank / (right - left) if share else rank, np.nan)

    return build


_RANK_ALL = {"ascending": Bool(True), "ties_method": Choice("min", "max", "average", "dense", default="min")}
_expanding("unary.expanding_rank", joint=True, params=_RANK_ALL)(_expanding_rank(False))
_expanding("unary.expanding_rank_pct", joint=True, params=_RANK_ALL)(_expanding_rank(True))


def _one_decay(p):
    if sum(p[k] is not None for k in ("com", "span", "half_life", "alpha")) != 1:
        raise RequestError("exactly one of com, span, half_life, alpha")


EWM = {
    "com": Float(None, ge=0),
    "span": Float(None, ge=1),
    "half_life": Float(None, gt=0),
    "alpha": Float(None, gt=0, le=1),
    "min_periods": Int(0, ge=0),
    "adjust": Bool(True),
    "ignore_na": Bool(False),
}
BIAS = EWM | {"bias": Bool(False)}


def _ewm_op(name, fields, params, g):
    operator("TS", name, fields, rule=_one_decay, recurrence=True, params=params)(g)


_ewm_op("unary.ewm_mean", "col", EWM, lambda x, **p: scan.ewm_mean(x, p))
_ewm_op("unary.ewm_std", "col", BIAS, lambda x, **p: scan.ewm_std(x, p))
_ewm_op("unary.ewm_var", "col", BIAS, lambda x, **p: scan.ewm_cov(x, x, p))
_ewm_op("binary.ewm_cov", "left right", BIAS, lambda x, y, **p: scan.ewm_cov(x, y, p))
_ewm_op("binary.ewm_corr", "left right", BIAS, lambda x, y, **p: scan.ewm_corr(x, y, p))
