"""Recursive series functions over numpy arrays without gaps; rows of the warm-up are NaN."""

from __future__ import annotations

from itertools import accumulate

import numpy as np


def blank(n: int) -> np.ndarray:
    return np.full(n, np.nan)


def after(x: np.ndarray, f) -> np.ndarray:
    """f over x without its leading NaNs."""
    lead = int(np.isnan(x).cumprod().sum())
    return np.concatenate([blank(lead), f(x[lead:])])


def windowed(x: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    out = blank(len(x))
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n) @ (weights / weights.sum())
    return out


def sma(x, n):
    return windowed(x, n, np.ones(n))


def wma(x, n):
    return windowed(x, n, np.arange(1.0, n + 1))


def trima(x, n):
    i = np.arange(n)
    return windowed(x, n, np.minimum(i + 1, n - i).astype(float))


def recur(x, start: int, seed: float, k: float) -> np.ndarray:
    """Exponential smoothing with factor k: seed stands at `start`."""
    out = blank(len(x))
    if start < len(x):
        out[start:] = list(accumulate(x[start + 1 :].tolist(), lambda value, v: value + k * (v - value), initial=float(seed)))
    return out


def ema(x, n):
    """Seeded with the mean of the first n values."""
    return recur(x, n - 1, x[:n].mean(), 2 / (n + 1)) if len(x) >= n else blank(len(x))


def ema_chain(x, n, depth):
    out = [ema(x, n)]
    while len(out) < depth:
        out.append(after(out[-1], lambda y: ema(y, n)))
    return out


def dema(x, n):
    a, b = ema_chain(x, n, 2)
    return 2 * a - b


def tema(x, n):
    a, b, c = ema_chain(x, n, 3)
    return 3 * a - 3 * b + c


def t3(x, n, v=0.7):
    """Three generalised double averages: the expansion of (1 + v - v*E)^3 over six averages."""
    e = ema_chain(x, n, 6)
    return (1 + v) ** 3 * e[2] - 3 * v * (1 + v) ** 2 * e[3] + 3 * v**2 * (1 + v) * e[4] - v**3 * e[5]


def kama(x, n, fast=2, slow=30):
    """Smoothing that adapts to the efficiency ratio, between the factors of a fast and a slow average."""
    out = blank(len(x))
    if len(x) <= n:
        return out
    low, high = 2 / (slow + 1), 2 / (fast + 1)
    path = np.lib.stride_tricks.sliding_window_view(np.abs(np.diff(x)), n).sum(1)
    ratio = np.where(path == 0, 1.0, np.minimum(1.0, np.abs(x[n:] - x[:-n]) / np.where(path == 0, 1.0, path)))
    factor = (ratio * (high - low) + low) ** 2
    steps = zip(x[n:].tolist(), factor.tolist())
    out[n:] = list(accumulate(steps, lambda value, s: value + s[1] * (s[0] - value), initial=float(x[n - 1])))[1:]
    return out


# The numbers of moving averages are fixed values of requests.
# As a moving average T3 runs with factor 1.
AVERAGES = {0: sma, 1: ema, 2: wma, 3: dema, 4: tema, 5: trima, 6: kama, 8: lambda x, n: t3(x, n, 1.0)}


def wilder_mean(x, n):
    """Mean of the first n values, then smoothing by 1/n."""
    return recur(x, n - 1, x[:n].mean(), 1 / n) if len(x) >= n else blank(len(x))


def wilder_sum(x, n):
    """Sum of the first n - 1 values at the row of the last of them, then s - s/n + x."""
    out = blank(len(x))
    if n == 1:
        return x.copy()
    if len(x) >= n - 1:
        out[n - 2 :] = list(accumulate(x[n - 1 :].tolist(), lambda value, v: value + v - value / n, initial=float(x[: n - 1].sum())))
    return out


def macd(x, fast, slow, signal):
    """(line, signal, difference); the fast average is seeded so that both begin on the same row."""
    if len(x) < slow:
        return blank(len(x)), blank(len(x)), blank(len(x))
    quick = recur(x, slow - 1, x[slow - fast : slow].mean(), 2 / (fast + 1))
    line = quick - ema(x, slow)
    smooth = after(line, lambda y: ema(y, signal))
    line = np.where(np.isnan(smooth), np.nan, line)
    return line, smooth, line - smooth


def true_range(high, low, close):
    """From the second row on."""
    before = close[:-1]
    return np.maximum(high[1:], before) - np.minimum(low[1:], before)


def moves(high, low):
    """Directional moves up and down, from the second row on."""
    up, down = np.diff(high), -np.diff(low)
    return np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)


def shifted(x, n=1):
    return np.concatenate([blank(n), x])


def indicators(high, low, close, n):
    """Directional indicators (up, down) in percent, first at row n."""
    tr = wilder_sum(true_range(high, low, close), n)
    out = []
    for move in moves(high, low):
        with np.errstate(all="ignore"):
            di = np.where(tr == 0, 0.0, 100 * wilder_sum(move, n) / tr)
        if n > 1:
            di[: n - 1] = np.nan
        out.append(shifted(di))
    return out


def dx(high, low, close, n):
    up, down = indicators(high, low, close, n)
    with np.errstate(all="ignore"):
        return np.where(up + down == 0, 0.0, 100 * np.abs(up - down) / (up + down))


def adx(high, low, close, n):
    return after(dx(high, low, close, n), lambda x: wilder_mean(x, n))
