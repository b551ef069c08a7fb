"""Operators over the rows of one time. NULL rows take no part; reductions stand on every row of the section."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.columns import correlation, finite_or_null, safe_div
from ..functions.normal import inverse_normal
from ..plans.spec import Bool, Choice, Float, Int, operator

TIES = Choice("min", "max", "average", "first", "dense", default="min")
UP = Bool(True)


def _cs(name, fields="col", output="NUMBER", **more):
    return operator("CS", name, fields, output, **more)


def _d(c):
    return c.cast("double")


_WHOLE = {
    "count": F.count,
    "max": F.max,
    "mean": lambda c: F.avg(_d(c)),
    "median": lambda c: F.percentile(_d(c), F.lit(0.5)),
    "min": F.min,
    "sum": lambda c: F.sum(_d(c)),
}
for _name, _g in _WHOLE.items():
    _cs(f"unary.{_name}")(lambda f, col, g=_g: g(col).over(f.whole()))


@_cs("unary.skew")
def skew(f, col):
    return finite_or_null(F.skewness(_d(col)).over(f.whole()))


@_cs("unary.kurt")
def kurt(f, col):
    """Population kurtosis, 3 for a normal distribution."""
    return finite_or_null(F.kurtosis(_d(col)).over(f.whole())) + 3


def _spread(col, ddof, window, squared=False):
    g = {(0, False): F.stddev_pop, (1, False): F.stddev_samp, (0, True): F.var_pop, (1, True): F.var_samp}[ddof, squared]
    return g(_d(col)).over(window)


DDOF = {"ddof": Choice(0, 1, default=1)}
_cs("unary.std", params=DDOF)(lambda f, col, ddof: _spread(col, ddof, f.whole()))
_cs("unary.var", params=DDOF)(lambda f, col, ddof: _spread(col, ddof, f.whole(), True))


@_cs("unary.quantile", params={"q": Float(ge=0, le=1)})
def quantile(f, col, q):
    return F.percentile(_d(col), F.lit(q)).over(f.whole())


_cs("unary.demean")(lambda f, col: _d(col) - F.avg(_d(col)).over(f.whole()))
_cs("unary.zscore", params=DDOF)(lambda f, col, ddof: safe_div(_d(col) - F.avg(_d(col)).over(f.whole()), _spread(col, ddof, f.whole())))
_cs("unary.normalize_sum")(lambda f, col: safe_div(_d(col), F.sum(_d(col)).over(f.whole())))
_cs("unary.normalize_l1")(lambda f, col: safe_div(_d(col), F.sum(F.abs(_d(col))).over(f.whole())))
_cs("unary.normalize_l2")(lambda f, col: safe_div(_d(col), F.sqrt(F.sum(_d(col) * _d(col)).over(f.whole()))))


def _grouped(name, **more):
    return _cs(f"grouped.{name}", "col by", **more)


_grouped("mean")(lambda f, col, by: F.when(by.isNotNull(), F.avg(_d(col)).over(f.whole(by))))
_grouped("demean")(lambda f, col, by: F.when(by.isNotNull(), _d(col) - F.avg(_d(col)).over(f.whole(by))))
_grouped("zscore", params=DDOF)(lambda f, col, by, ddof: F.when(by.isNotNull(), safe_div(_d(col) - F.avg(_d(col)).over(f.whole(by)), _spread(col, ddof, f.whole(by)))))


def ranked(f, col, ascending, ties_method, *by):
    """Rank from 1 among the values that are not NULL; NULL for NULL."""
    up = (lambda c: c.asc()) if ascending else (lambda c: c.desc())
    w = f.sorted(up(col), by=(col.isNull(), *by))
    least, most = F.rank().over(w), F.count(F.lit(1)).over(w)  # the frame runs to the last tie
    rank = {
        "min": least,
        "max": most,
        "average": (least + most) / 2,
        "first": F.row_number().over(f.sorted(up(col), *f.order, by=(col.isNull(), *by))),
        "dense": F.dense_rank().over(w),
    }[ties_method]
    return F.when(col.isNotNull(), rank)


def ranked_pct(f, col, ascending, ties_method, *by):
    if ties_method != "dense":
        return ranked(f, col, ascending, ties_method, *by) / F.count(col).over(f.whole(*by))
    up, down = ranked(f, col, ascending, "dense", *by), ranked(f, col, not ascending, "dense", *by)
    return up / (up + down - 1)  # below, above and itself: the number of distinct values


_RANKING = {"ascending": UP, "ties_method": TIES}
_cs("unary.rank", params=_RANKING)(lambda f, col, ascending, ties_method: ranked(f, col, ascending, ties_method))
_cs("unary.rank_pct", params=_RANKING)(lambda f, col, ascending, ties_method: ranked_pct(f, col, ascending, ties_method))
_cs("unary.rank_dense", params={"ascending": UP})(lambda f, col, ascending: ranked(f, col, ascending, "dense"))
_grouped("rank_pct", params=_RANKING)(lambda f, col, by, ascending, ties_method: F.when(by.isNotNull(), ranked_pct(f, col, ascending, ties_method, by)))


@_cs("unary.rank_normal", params={"ascending": UP})
def rank_normal(f, col, ascending):
    """Normal score of the average rank: its place from the middle of the first n-th to that of the last."""
    return inverse_normal((ranked(f, col, ascending, "average") - 0.5) / F.count(col).over(f.whole()))


@_cs("unary.qcut", params={"q": Int(ge=2)})
def qcut(f, col, q):
    """Bin 0..q-1 by rank; ties share the lowest."""
    return F.floor((ranked(f, col, True, "min") - 1) * q / F.count(col).over(f.whole()))


def _best(f, col, limit, ascending):
    order = [col.asc_nulls_last() if ascending else col.desc_nulls_last(), *f.order]
    return F.coalesce(col.isNotNull() & (F.row_number().over(f.sorted(*order)) <= limit), F.lit(False))


for _name, _up in (("bottom", True), ("top", False)):
    _cs(f"unary.{_name}_n", output="BOOL", params={"n": Int(ge=1)})(lambda f, col, n, up=_up: _best(f, col, F.lit(n), up))
    _cs(f"unary.{_name}_pct", output="BOOL", params={"pct": Float(gt=0, le=1)})(lambda f, col, pct, up=_up: _best(f, col, F.ceil(F.count(col).over(f.whole()) * F.lit(pct)), up))


def _median_and_mad(f, col):
    median = yield F.percentile(_d(col), F.lit(0.5)).over(f.whole())
    mad = yield F.percentile(F.abs(_d(col) - median), F.lit(0.5)).over(f.whole())
    return median, mad


@_cs("unary.mad")
def mad(f, col):
    """Median distance from the median."""
    return (yield from _median_and_mad(f, col))[1]


@_cs("unary.robust_zscore", params={"scale": Float(1.4826, gt=0)})
def robust_zscore(f, col, scale):
    median, spread = yield from _median_and_mad(f, col)
    return safe_div(_d(col) - median, spread * scale)


def _clamp(x, low, high):
    return F.when(x < low, low).when(x > high, high).otherwise(x)


@_cs("unary.winsorize_mad", params={"n": Float(3.0, gt=0), "scale": Float(1.4826, gt=0)})
def winsorize_mad(f, col, n, scale):
    median, spread = yield from _median_and_mad(f, col)
    return _clamp(_d(col), median - spread * (n * scale), median + spread * (n * scale))


@_cs("unary.winsorize", params={"lower": Float(0.01, ge=0, lt=0.5), "upper": Float(0.99, gt=0.5, le=1)})
def winsorize(f, col, lower, upper):
    both = F.percentile(_d(col), F.array(F.lit(lower), F.lit(upper))).over(f.whole())
    bounds = yield both
    return _clamp(_d(col), F.get(bounds, F.lit(0)), F.get(bounds, F.lit(1)))


def _pair(name):
    return _cs(f"binary.{name}", "left right")


def _complete(left, right):
    good = left.isNotNull() & right.isNotNull()
    return F.when(good, _d(left)), F.when(good, _d(right))


_pair("corr")(lambda f, left, right: correlation(left, right, lambda c: c.over(f.whole())))
_pair("cov")(lambda f, left, right: F.covar_samp(_d(left), _d(right)).over(f.whole()))
_pair("beta")(lambda f, left, right: finite_or_null(F.regr_slope(_d(right), _d(left)).over(f.whole())))
_pair("alpha")(lambda f, left, right: finite_or_null(F.regr_intercept(_d(right), _d(left)).over(f.whole())))


@_pair("residual")
def residual(f, left, right):
    """What the line of right on left leaves of right."""
    w = f.whole()
    return finite_or_null(_d(right) - F.regr_intercept(_d(right), _d(left)).over(w) - F.regr_slope(_d(right), _d(left)).over(w) * _d(left))


@_pair("rank_corr")
def rank_corr(f, left, right):
    """Correlation of ranks over the pairs that are complete; ties take the least rank."""
    a, b = _complete(left, right)
    x = yield ranked(f, a, True, "min")
    y = yield ranked(f, b, True, "min")
    return correlation(x, y, lambda c: c.over(f.whole()))


def _design(controls):
    """Columns of the regression: numbers as they are, categories as indicators without their first level; constants are left out."""
    for c in controls:
        if c.dtype.kind in "fiu":
            yield c.astype(float)
        else:
            text = np.array([str(v) for v in c])
            for level in np.unique(text)[1:]:
                yield (text == level).astype(float)


def _within_levels(y, texts, numbers):
    """The residual on one category and numbers, by distances from each level's means: no column for each level, so levels may be many."""
    levels, level = np.unique(np.array([str(v) for v in texts]), return_inverse=True)
    if (len(levels) == 1 and not numbers) or len(y) <= 1 or len(y) <= len(levels) + len(numbers):
        return y - y.mean()
    size = np.bincount(level)
    inside = lambda x: x - (np.bincount(level, x) / size)[level]
    y = inside(y)
    if not numbers:
        return y
    x = np.column_stack([inside(c) for c in numbers])
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


@_cs("controls.neutralize_by", "target controls+", kernel=True, params={"intercept": Bool(True)})
def neutralize_by(target, controls, intercept):
    """Least-squares residual of target on the controls of its section; without a column or with too few rows, the distance from the mean. Incomplete rows stay NULL."""
    good = np.isfinite(target)
    for c in controls:
        good &= np.isfinite(c.astype(float)) if c.dtype.kind in "fiu" else np.array([v is not None and v == v for v in c], dtype=bool)
    out = np.full(len(target), np.nan)
    y = target[good]
    if not len(y):
        return out
    controls = [c[good] for c in controls]
    texts = [c for c in controls if c.dtype.kind not in "fiu"]
    if intercept and len(texts) == 1:
        out[good] = _within_levels(y, texts[0], [c.astype(float) for c in controls if c.dtype.kind in "fiu" and np.ptp(c) > 0])
        return out
    columns = [x for x in _design(controls) if np.ptp(x) > 0]
    if not columns or len(y) <= 1 or len(y) <= len(columns) + intercept:
        out[good] = y - y.mean()
        return out
    x = np.column_stack([np.ones(len(y))] * intercept + columns)
    out[good] = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return out
