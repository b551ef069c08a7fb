"""Technical indicators over a code's series. Windows are full or NULL; recursive ones pass over rows with a NULL input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import series as S
from ..functions import scan, windows
from ..functions.columns import safe_div
from ..plans.spec import Choice, Float, Int, RequestError, operator
from .time_series import rising_mean


def _d(c):
    return c.cast("double")


def _ta(name, fields="col", **more):
    return operator("TS", f"talib.{name}", fields, **more)


def period(least=1):
    return {"time_period": Int(ge=least)}


def _all(*cols):
    good = cols[0].isNotNull()
    for c in cols[1:]:
        good = good & c.isNotNull()
    return F.when(good, F.lit(1))


def _kernel(name, fields="col", params=None, rule=None):
    """A kernel over the rows where all inputs stand."""

    def enter(g):
        def dense(*columns, **p):
            good = np.isfinite(np.vstack(columns)).all(0)
            out = S.blank(len(good))
            x = [c[good] for c in columns]
            if len(x[0]):
                out[good] = g(*x, **p)
            return out

        dense.__doc__ = g.__doc__
        return _ta(name, fields, kernel=True, params=params, rule=rule)(dense)

    return enter


# Row-wise prices.
_ta("avgPrice", "open high low close")(lambda f, o, h, l, c: (_d(o) + _d(h) + _d(l) + _d(c)) / 4)
_ta("medPrice", "high low")(lambda f, h, l: (_d(h) + _d(l)) / 2)
_ta("typPrice", "high low close")(lambda f, h, l, c: (_d(h) + _d(l) + _d(c)) / 3)
_ta("wclPrice", "high low close")(lambda f, h, l, c: (_d(h) + _d(l) + 2 * _d(c)) / 4)
_ta("bop", "open high low close")(lambda f, o, h, l, c: F.when(_d(h) == _d(l), (_d(c) - _d(o)) * 0).otherwise(safe_div(_d(c) - _d(o), _d(h) - _d(l))))


# Lags.
def _lagged(name, g, of):
    def chunk(rows, x, time_period):
        return of(x, windows.lagged(rows, x, time_period))

    _ta(name, params=period(), chunk=chunk)(lambda f, col, time_period: g(_d(col), F.lag(_d(col), time_period).over(f.series())))


_lagged("mom", lambda x, y: x - y, lambda x, y: x - y)
_lagged("roc", lambda x, y: 100 * (safe_div(x, y) - 1), lambda x, y: 100 * (x / y - 1))
_lagged("rocp", lambda x, y: safe_div(x, y) - 1, lambda x, y: x / y - 1)
_lagged("rocr", safe_div, lambda x, y: x / y)
_lagged("rocr100", lambda x, y: 100 * safe_div(x, y), lambda x, y: 100 * x / y)


# Windows: kernels over all series of a pass, by functions whose time doesn't depend on the window.
def _window(name, fields="col", params=None):
    """A kernel g(rows, n, series..., other parameters) for windows of time_period rows, NULL where one of the series lacks a value in the window."""

    def enter(g):
        def build(rows, *x, time_period, **more):
            good = ~np.isnan(np.vstack(x)).any(0)
            return np.where(windows.counts(rows, good, time_period) == time_period, g(rows, time_period, *x, **more), np.nan)

        build.__doc__ = g.__doc__
        return _ta(name, fields, joint=True, params=params or period())(build)

    return enter


def _middle(top, bottom):
    return (top + bottom) / 2


_window("sma")(lambda rows, n, x: windows.means(rows, x, n))
_window("stddev", params=period(2) | {"nbdev": Float(1.0, gt=0)})(lambda rows, n, x, nbdev: np.sqrt(windows.moments(rows, x, n)[2] / n) * nbdev)
_window("var", params=period() | {"nbdev": Float(1.0, gt=0)})(lambda rows, n, x, nbdev: windows.moments(rows, x, n)[2] / n)
_window("midPoint", params=period(2))(lambda rows, n, x: _middle(windows.largest(rows, x, n), windows.smallest(rows, x, n)))
_window("midPrice", "high low", params=period(2))(lambda rows, n, h, l: _middle(windows.largest(rows, h, n), windows.smallest(rows, l, n)))


@_window("correl", "high low")
def correl(rows, n, x, y):
    _, _, _, xx, yy, xy = windows.pairs(rows, x, y, n)
    return np.where((xx > 0) & (yy > 0), xy / np.sqrt(xx * yy), np.nan)


@_window("willr", "high low close", params=period(2))
def willr(rows, n, high, low, close):
    top, bottom = windows.largest(rows, high, n), windows.smallest(rows, low, n)
    return np.where(top == bottom, 0.0, -100 * (top - close) / (top - bottom))


_window("wma")(lambda rows, n, x: rising_mean(rows, x, n))


@_window("trima")
def trima(rows, n, x):
    """A mean of means: the weights of the two lengths fold to a triangle."""
    k = n - n // 2
    first = np.where(windows.counts(rows, ~np.isnan(x), k) == k, windows.moments(rows, x, k, 1)[1], np.nan)
    return windows.moments(rows, first, n // 2 + 1, 1)[1]


def _regression(name, value):
    def build(rows, n, x):
        _, at, mean, xx, _, xy = windows.pairs(rows, rows.at.astype(float), x, n)
        slope = xy / xx
        return value(slope, lambda row: mean + slope * (row - at), rows.at, n)

    _window(name, params=period(2))(build)


_regression("linearreg", lambda slope, line, row, n: line(row))
_regression("linearreg_slope", lambda slope, line, row, n: slope)
_regression("linearreg_intercept", lambda slope, line, row, n: line(row - n + 1))
_regression("linearreg_angle", lambda slope, line, row, n: np.degrees(np.arctan(slope)))
_regression("tsf", lambda slope, line, row, n: line(row + 1))


@_ta("beta", "high low", joint=True, params=period())
def beta(rows, high, low, time_period):
    """Slope of the second series' returns on the first's."""
    x, y = (np.where(b != 0, a / b, np.nan) - 1 for a, b in ((s, windows.lagged(rows, s, 1)) for s in (high, low)))
    n, _, _, xx, _, xy = windows.pairs(rows, x, y, time_period)
    return np.where((n == time_period) & (xx > 0), xy / xx, np.nan)


@_ta("ad", "high low close volume")
def ad(f, high, low, close, volume):
    """Running sum of volume weighed by where the close lies between low and high."""
    h, l, c = _d(high), _d(low), _d(close)
    return F.sum(F.coalesce(safe_div((c - l) - (h - c), h - l) * _d(volume), F.lit(0.0))).over(f.past())


@_ta("trange", "high low close")
def trange(f, high, low, close):
    before = F.lag(_d(close)).over(f.series())
    good = _all(high, low, before)
    return F.when(good.isNotNull(), F.greatest(_d(high), before) - F.least(_d(low), before))


def _since(rows, high, low, n):
    """Row of the latest highest high and of the latest lowest low of n + 1 rows, and where all of them stand."""
    top, bottom = windows.place_of(rows, high, n + 1, True, earliest=False), windows.place_of(rows, low, n + 1, False, earliest=False)
    return top, bottom, windows.counts(rows, ~np.isnan(high) & ~np.isnan(low), n + 1) == n + 1


@_ta("aroon", "high low", joint=True, params=period(2) | {"output": Choice("down", "up", default="up")})
def aroon(rows, high, low, time_period, output):
    top, bottom, full = _since(rows, high, low, time_period)
    return np.where(full, 100 * (time_period - (rows.at - (top if output == "up" else bottom))) / time_period, np.nan)


@_ta("aroonOsc", "high low", joint=True, params=period(2))
def aroon_osc(rows, high, low, time_period):
    top, bottom, full = _since(rows, high, low, time_period)
    return np.where(full, 100 * (top - bottom) / time_period, np.nan)


@_window("cci", "high low close", params=period(2))
def cci(rows, n, high, low, close):
    """Distance from the mean in mean distances from it."""
    price = (high + low + close) / 3
    mean = windows.moments(rows, price, n, 1)[1]
    far = windows.mean_distance(rows, price, n, mean)
    return np.where(far == 0, 0.0, (price - mean) / (0.015 * far))


@_ta("mfi", "high low close volume", joint=True, params=period(2))
def mfi(rows, high, low, close, volume, time_period):
    price = (high + low + close) / 3
    step = np.sign(price - windows.lagged(rows, price, 1))
    flow = price * volume
    up, every = (windows.sums(rows, np.where(s, flow, 0.0), time_period) for s in (step > 0, (step > 0) | (step < 0)))
    full = windows.counts(rows, ~np.isnan(step) & ~np.isnan(volume), time_period) == time_period
    return np.where(full, np.where(every < 1, 0.0, 100 * up / every), np.nan)


def _rising(p):
    if not p["period1"] < p["period2"] < p["period3"]:
        raise RequestError("the periods must increase")


@_ta("ultOsc", "high low close", joint=True, rule=_rising, params={"period1": Int(7, ge=1), "period2": Int(14, ge=2), "period3": Int(28, ge=3)})
def ult_osc(rows, high, low, close, period1, period2, period3):
    before = windows.lagged(rows, close, 1)
    good = ~np.isnan(high + low + close + before)
    floor = np.minimum(low, before)
    pressure, reach = np.where(good, close - floor, np.nan), np.where(good, np.maximum(high, before) - floor, np.nan)

    def part(n):
        below = windows.sums(rows, reach, n)
        return np.where(below != 0, windows.sums(rows, pressure, n) / below, np.nan)

    return np.where(windows.counts(rows, good, period3) == period3, 100 * (4 * part(period1) + 2 * part(period2) + part(period3)) / 7, np.nan)


# Recursive ones.
MA_TYPE = {"ma_type": Choice(*S.AVERAGES, default=0)}
for _name, _g in (("ema", scan.ema), ("dema", scan.dema), ("tema", scan.tema), ("trix", scan.trix)):
    _ta(_name, params=period(), recurrence=True)(lambda x, time_period, g=_g: g(x, time_period))
_ta("t3", params=period() | {"vfactor": Float(0.7, gt=0, le=1)}, recurrence=True)(lambda x, time_period, vfactor: scan.t3(x, time_period, vfactor))
_kernel("kama", params=period())(lambda x, time_period: S.kama(x, time_period))
_kernel("ma", params=period() | MA_TYPE)(lambda x, time_period, ma_type: S.AVERAGES[ma_type](x, time_period))
_ta("rsi", params=period(2), recurrence=True)(lambda x, time_period: scan.rsi(x, time_period))


def _fast_first(p):
    if p["fast_period"] >= p["slow_period"]:
        raise RequestError("fast_period must be below slow_period")


FAST_SLOW = {"fast_period": Int(12, ge=2), "slow_period": Int(26, ge=2)}


@_kernel("apo", params=FAST_SLOW | MA_TYPE, rule=_fast_first)
def apo(x, fast_period, slow_period, ma_type):
    return S.AVERAGES[ma_type](x, fast_period) - S.AVERAGES[ma_type](x, slow_period)


@_kernel("ppo", params=FAST_SLOW | MA_TYPE, rule=_fast_first)
def ppo(x, fast_period, slow_period, ma_type):
    slow = S.AVERAGES[ma_type](x, slow_period)
    with np.errstate(all="ignore"):
        return np.where(slow == 0, np.nan, 100 * (S.AVERAGES[ma_type](x, fast_period) - slow) / slow)


@_kernel("macd", params=FAST_SLOW | {"signal_period": Int(9, ge=1), "output": Choice("macd", "signal", "hist", default="macd")}, rule=_fast_first)
def macd(x, fast_period, slow_period, signal_period, output):
    return S.macd(x, fast_period, slow_period, signal_period)[("macd", "signal", "hist").index(output)]


@_kernel("bBands", params=period(2) | {"nbdev_up": Float(2.0, gt=0), "nbdev_down": Float(2.0, gt=0)} | MA_TYPE | {"output": Choice("upper", "middle", "lower", default="middle")})
def bands(x, time_period, nbdev_up, nbdev_down, ma_type, output):
    middle = S.AVERAGES[ma_type](x, time_period)
    spread = S.blank(len(x))
    if len(x) >= time_period:
        spread[time_period - 1 :] = np.lib.stride_tricks.sliding_window_view(x, time_period).std(1)
    return {"upper": middle + nbdev_up * spread, "middle": middle, "lower": middle - nbdev_down * spread}[output]


_HLC = "high low close"
_ta("atr", _HLC, params=period(), recurrence=True)(lambda h, l, c, time_period: scan.atr(h, l, c, time_period))


@_ta("natr", _HLC, params=period(), recurrence=True)
def natr(high, low, close, time_period):
    reach = yield from scan.atr(high, low, close, time_period)
    return np.where(close == 0, np.nan, 100 * reach / np.where(close == 0, 1, close))


_kernel("dx", _HLC, period(2))(lambda h, l, c, time_period: S.dx(h, l, c, time_period))
_kernel("adx", _HLC, period(2))(lambda h, l, c, time_period: S.adx(h, l, c, time_period))
_kernel("plus_di", _HLC, period())(lambda h, l, c, time_period: S.indicators(h, l, c, time_period)[0])
_kernel("minus_di", _HLC, period())(lambda h, l, c, time_period: S.indicators(h, l, c, time_period)[1])
_kernel("plus_dm", "high low", period())(lambda h, l, time_period: S.shifted(S.wilder_sum(S.moves(h, l)[0], time_period)))
_kernel("minus_dm", "high low", period())(lambda h, l, time_period: S.shifted(S.wilder_sum(S.moves(h, l)[1], time_period)))


@_kernel("adxr", _HLC, period(2))
def adxr(h, l, c, time_period):
    """Mean of ADX now and time_period - 1 rows earlier."""
    x = S.adx(h, l, c, time_period)
    return (x + np.concatenate([S.blank(time_period - 1), x[: len(x) - time_period + 1]])) / 2 if len(x) >= time_period else S.blank(len(x))


_ta("obv", "close volume", recurrence=True)(lambda close, volume: scan.obv(close, volume))
