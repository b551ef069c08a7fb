"""Recurrences as associative scans: y = a * y + b along a series, or a running maximum.

Maps y -> a * y + b compose, so a block's rows make one map, blocks are joined one after another, and a series that is dealt out in chunks only has to know the value that its chunk begins with. A recurrence is a generator: it yields the scans it needs next, a list of (a, b) or (MAX, x), gets for each (the values, the values before each row), and returns the result. Whole series and chunks run the same generators; each round of yields is a pass over the chunks.

Before its first row a series has the value 0, or minus infinity for a maximum.
"""

from __future__ import annotations

import numpy as np

from .windows import Rows

MAX = "max"
#: Rows of a block: its maps are composed row by row for all blocks together, then blocks one by one.
BLOCK = 512


def _empty(scan) -> float:
    return -np.inf if scan[0] is MAX else 0.0


def solve(rows: Rows, scan, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values, values before each row) of one scan; start: the value before the first row of each series."""
    most = scan[0] is MAX
    empty = _empty(scan)
    start = np.full(len(rows.ends), empty) if start is None else start
    out = np.zeros(rows.n)
    a, b = np.ones(rows.n) if most else np.broadcast_to(np.asarray(scan[0], float), rows.n), np.broadcast_to(np.asarray(scan[1], float), rows.n)
    series = np.repeat(np.arange(len(rows.ends)), rows.ends - rows.starts)
    for places, follows in rows.blocks(BLOCK):
        la, lb = np.append(a, 1.0)[places], np.append(b, empty)[places]
        if most:
            lb = np.maximum.accumulate(lb, axis=0)
        else:
            for k in range(1, len(la)):
                lb[k] += la[k] * lb[k - 1]
            la = np.multiply.accumulate(la, axis=0)
        begin = start[series[places[0]]]
        for j in np.nonzero(follows)[0]:
            begin[j] = max(begin[j - 1], lb[-1, j - 1]) if most else la[-1, j - 1] * begin[j - 1] + lb[-1, j - 1]
        got = np.maximum(lb, begin) if most else la * begin + lb
        there = places < rows.n
        out[places[there]] = got[there]
    before = np.append(empty, out[:-1]) if rows.n else out
    full = rows.ends > rows.starts
    before[rows.starts[full]] = start[full]
    return out, before


def total(rows: Rows, scan, last: int) -> tuple[float, float]:
    """The map (a, b) of the whole of one series."""
    s, e = rows.starts[last], rows.ends[last]
    if scan[0] is MAX:
        return 1.0, float(np.max(scan[1][s:e], initial=-np.inf))
    a = np.broadcast_to(np.asarray(scan[0], float), rows.n)[s:e]
    b = np.broadcast_to(np.asarray(scan[1], float), rows.n)[s:e]
    one = Rows([e - s])
    return float(np.prod(a)), float(solve(one, (a, b))[0][-1]) if e > s else 0.0


def run(rows: Rows, recurrence) -> np.ndarray:
    """A recurrence over whole series."""
    try:
        asked = next(recurrence)
        while True:
            asked = recurrence.send([solve(rows, s) for s in asked])
    except StopIteration as end:
        return end.value


def rounds(recurrence) -> int:
    """How many rounds of scans a recurrence asks for; it has to have been made over no rows."""
    n, none = 0, Rows([])
    try:
        asked = next(recurrence)
        while True:
            n += 1
            asked = recurrence.send([solve(none, s) for s in asked])
    except StopIteration:
        return n


def _put(x, good):
    return np.where(good, x, 0.0)


def counted(good):
    """(number of good rows so far, the same before each row)."""
    ((n, before),) = yield [(1.0, good)]
    return n, before


def latest(x, good):
    """(the latest good value, the same before each row); 0 before there is one."""
    ((y, before),) = yield [(np.where(good, 0.0, 1.0), _put(x, good))]
    return y, before


# Exponentially weighted moments, by the weight so far, then means less the first value, then central products.
def _weights(good, factor, alpha, adjust, ignore_na):
    n, before = yield from counted(good)
    seen = before > 0
    fade = np.where(seen & (good | (not ignore_na)), factor, 1.0)
    ((_, weight),) = yield [(fade if adjust else np.where(good, 0.0, fade), _put(1.0, good))]
    new = 1.0 if adjust else alpha
    return n, seen, fade, fade * weight, new


def _alpha(p) -> float:
    if p["com"] is not None:
        return 1 / (1 + p["com"])
    if p["span"] is not None:
        return 2 / (p["span"] + 1)
    return 1 - np.exp(-np.log(2) / p["half_life"]) if p["half_life"] is not None else p["alpha"]


def weighted(columns, pairs, p):
    """Means of the columns (if pairs is empty) or, for each pair of them, (central product, sum of weights, that squared less the sum of their squares), over the rows in which all stand; and the number of such rows. The last is the sum of the products of different rows' weights, added up as such: as a difference it would be what rounding leaves where there is one row."""
    good = ~np.isnan(np.vstack(columns)).any(0)
    alpha = _alpha(p)
    n, seen, fade, old, new = yield from _weights(good, 1 - alpha, alpha, p["adjust"], p["ignore_na"])
    whole = old + new
    first = yield [(np.where(seen, 1.0, 0.0), _put(x, good & ~seen)) for x in columns]
    less = [_put(x - f, good) for x, (f, _) in zip(columns, first)]
    keep, take = np.where(good, old / whole, 1.0), _put(new / whole, good)
    asked = [(keep, take * x) for x in less]
    if not pairs:
        got = yield asked
        return n, [f + m for (f, _), (m, _) in zip(first, got)]
    scale = 1.0 if p["adjust"] else np.where(good, 1 / whole, 1.0)
    asked += [(fade * scale, _put(new * scale, good)), ((fade * scale) ** 2, _put(2 * old * new * scale**2, good))]
    got = yield asked
    means, (weight, _), (apart, _) = got[: len(columns)], got[-2], got[-1]
    central = lambda i, j: keep * (means[i][1] - means[i][0]) * (means[j][1] - means[j][0]) + take * (less[i] - means[i][0]) * (less[j] - means[j][0])
    products = yield [(keep, _put(central(i, j), good)) for i, j in pairs]
    return n, [c for c, _ in products], weight, apart


def _least(n, p, value):
    return np.where(n >= max(1, p["min_periods"]), value, np.nan)


def ewm_mean(x, p):
    n, (mean,) = yield from weighted([x], [], p)
    return _least(n, p, mean)


def ewm_cov(x, y, p):
    n, (product,), weight, apart = yield from weighted([x, y], [(0, 1)], p)
    if not p["bias"]:
        product = np.where(apart > 0, weight**2 / np.where(apart > 0, apart, 1.0) * product, np.nan)
    return _least(n, p, product)


def ewm_std(x, p):
    return np.sqrt(np.maximum((yield from ewm_cov(x, x, p)), 0.0))


def ewm_corr(x, y, p):
    n, (xy, xx, yy), _, _ = yield from weighted([x, y], [(0, 1), (0, 0), (1, 1)], p)
    spread = np.sqrt(np.maximum(xx * yy, 0.0))
    return _least(n, p, np.where(spread > 0, xy / np.where(spread > 0, spread, 1.0), np.nan))


# Averages that begin with the mean of their first n values and pass over rows without one.
def smoothed(x, n, k):
    good = ~np.isnan(x)
    c, _ = yield from counted(good)
    ((begun, _),) = yield [(1.0, _put(x, good & (c <= n)))]
    on = good & (c > n)
    ((y, _),) = yield [(np.where(good & (c == n), 0.0, np.where(on, 1 - k, 1.0)), np.where(good & (c == n), begun / n, _put(k * x, on)))]
    return np.where(good & (c >= n), y, np.nan)


def ema(x, n):
    return (yield from smoothed(x, n, 2 / (n + 1)))


def chain(x, n, depth):
    out = [(yield from ema(x, n))]
    while len(out) < depth:
        out.append((yield from ema(out[-1], n)))
    return out


def dema(x, n):
    a, b = yield from chain(x, n, 2)
    return 2 * a - b


def tema(x, n):
    a, b, c = yield from chain(x, n, 3)
    return 3 * a - 3 * b + c


def t3(x, n, v):
    """Three generalised double averages: the expansion of (1 + v - v*E)^3 over six averages."""
    e = yield from chain(x, n, 6)
    return (1 + v) ** 3 * e[2] - 3 * v * (1 + v) ** 2 * e[3] + 3 * v**2 * (1 + v) * e[4] - v**3 * e[5]


def trix(x, n):
    e = (yield from chain(x, n, 3))[2]
    good = ~np.isnan(e)
    _, before = yield from counted(good)
    _, last = yield from latest(e, good)
    return np.where(good & (before > 0) & (last != 0), 100 * (e / np.where(last != 0, last, 1.0) - 1), np.nan)


def changes(x):
    """x less the value before it, rows without one passed over."""
    good = ~np.isnan(x)
    _, before = yield from counted(good)
    _, last = yield from latest(x, good)
    return np.where(good & (before > 0), x - last, np.nan)


def rsi(x, n):
    d = yield from changes(x)
    gain = yield from smoothed(np.maximum(d, 0), n, 1 / n)
    loss = yield from smoothed(np.maximum(-d, 0), n, 1 / n)
    whole = gain + loss
    return np.where(whole == 0, 0.0, 100 * gain / np.where(whole == 0, 1.0, whole))


def atr(high, low, close, n):
    """Wilder's mean of true ranges, which the first row with all three prices doesn't have."""
    good = ~np.isnan(high + low + close)
    _, before = yield from counted(good)
    _, last = yield from latest(close, good)
    reach = np.where(good & (before > 0), np.maximum(high, last) - np.minimum(low, last), np.nan)
    return (yield from smoothed(reach, n, 1 / n))


def obv(close, volume):
    """Starts at the first volume. Here a gap in close counts: its row adds its volume, the row after it adds nothing."""
    there, gap = ~np.isnan(volume), np.isnan(close)
    (n, before), (_, row), (_, last), (_, gone) = yield [(1.0, there), (1.0, np.ones(len(close))), (0.0, _put(close, ~gap)), (0.0, gap.astype(float))]
    step = np.where(gap, 1.0, np.where((row == 0) | (gone > 0), 0.0, np.sign(_put(close, ~gap) - last)))
    step = np.where(there & (before == 0), 1.0, step)
    ((sum_, _),) = yield [(1.0, _put(volume * step, there))]
    return np.where(n > 0, sum_, np.nan)


# Running aggregates, for series in chunks; whole ones are Spark's.
def running(kind):
    def of(x, min_periods):
        good = ~np.isnan(x)
        n, before = yield from counted(good)
        if kind == "count":
            value = n
        elif kind in ("max", "min"):
            sign = 1 if kind == "max" else -1
            ((y, _),) = yield [(MAX, np.where(good, sign * x, -np.inf))]
            value = sign * y
        elif kind == "prod":
            ((value, _),) = yield [(np.where(good, np.where(before > 0, x, 0.0), 1.0), _put(x, good & (before == 0)))]
        elif kind in ("sum", "mean"):
            ((value, _),) = yield [(1.0, _put(x, good))]
            value = value / np.maximum(n, 1) if kind == "mean" else value
        else:  # spreads: the mean, then squares by a streaming update
            ((mean, last),) = yield [(np.where(good, before / np.maximum(n, 1), 1.0), _put(x / np.maximum(n, 1), good))]
            ((squares, _),) = yield [(1.0, _put((x - last) * (x - mean), good))]
            var = np.where(n > 1, squares / np.maximum(n - 1, 1), np.nan)
            value = {"var": var, "std": np.sqrt(var), "sem": np.sqrt(var / np.maximum(n, 1))}[kind]
        return np.where((n >= min_periods) & (n > 0 if kind != "count" else True), value, np.nan)

    return of


def running_pairs(kind):
    def of(x, y, min_periods):
        good = ~np.isnan(x) & ~np.isnan(y)
        n, before = yield from counted(good)
        many = np.maximum(n, 1)
        keep = np.where(good, before / many, 1.0)
        (_, mx), (_, my) = yield [(keep, _put(x / many, good)), (keep, _put(y / many, good))]
        dx, dy, share = x - mx, y - my, before / many
        (xx, _), (yy, _), (xy, _) = yield [(1.0, _put(a * b * share, good)) for a, b in ((dx, dx), (dy, dy), (dx, dy))]
        value = {"beta": np.where(xx > 0, xy / xx, np.nan), "corr": np.where((xx > 0) & (yy > 0), xy / np.sqrt(xx * yy), np.nan), "cov": np.where(n > 1, xy / np.maximum(n - 1, 1), np.nan)}[kind]
        return np.where(n >= min_periods, value, np.nan)

    return of
