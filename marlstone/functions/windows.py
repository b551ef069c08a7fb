"""Sliding windows over many series at once, in time that doesn't depend on the window's length.

Each series is cut into blocks as long as the window. A window is then the tail of one block and the head of the next, so heads and tails, made in one pass each, give every window by one merge: extremes, sums and products by their operation, moments by the pairwise update of means and central sums. Nothing is ever subtracted from a running total, so a window's result depends on its own values alone: means and central sums carry the error of a streaming update over at most w values, about w roundings of the window's largest deviation, and a window of equal values has a spread of exactly zero.

Missing values are NaN and take no part.
"""

from __future__ import annotations

import numpy as np


class Rows:
    """Series that lie one after another; ends: where each ends."""

    def __init__(self, ends):
        self.ends = np.asarray(ends, dtype=np.int64)
        self.starts = np.append(np.int64(0), self.ends)[:-1]
        self.n = int(self.ends[-1]) if len(self.ends) else 0
        self.first = np.repeat(self.starts, self.ends - self.starts)
        self.at = np.arange(self.n)
        self._blocks: dict[int, list] = {}

    def since(self, w: int) -> np.ndarray:
        """First row of each row's window."""
        return np.maximum(self.first, self.at - w + 1)

    def blocks(self, w: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, follows): places has a column for each block and holds the rows in it, n where there is none; follows tells which blocks go on from the one before. A series not longer than the window is one block; such blocks are laid out by size."""
        if w in self._blocks:
            return self._blocks[w]
        size = self.ends - self.starts
        out = []

        def lay(starts, ends, width, follows):
            places = starts + np.arange(width)[:, None]
            places[places >= ends] = self.n
            out.append((places, follows))

        if (long := size > w).any():
            count = -(-size[long] // w)
            own = np.repeat(self.starts[long], count)
            starts = own + w * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            lay(starts, np.minimum(starts + w, np.repeat(self.ends[long], count)), w, starts > own)
        short = (size > 0) & ~long
        width = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        for c in np.unique(width[short]):
            some = short & (width == c)
            lay(self.starts[some], self.ends[some], int(min(c, w)), np.zeros(some.sum(), bool))
        self._blocks[w] = out
        return out

    def fold(self, w: int, columns: list[np.ndarray], head, merge, empty: list[float]) -> list[np.ndarray]:
        """A value (several arrays) for each row's window. head(blocks, back) gives the values of all heads of blocks, with back those of blocks that were turned round; merge(tail, head) joins neighbours; empty stands for no row."""
        out = None
        for places, follows in self.blocks(w):
            laid = [np.append(c, np.nan)[places] for c in columns]
            got = head(laid, False)
            if follows.any():
                tails = [t[::-1] for t in head([x[::-1] for x in laid], True)]
                before = []
                for t, e in zip(tails, empty):
                    b = np.full(t.shape, e, t.dtype)
                    b[:-1, 1:] = t[1:, :-1]
                    b[:, ~follows] = e
                    before.append(b)
                got = merge(before, got)
            if out is None:
                out = [np.zeros(self.n, g.dtype) for g in got]
            there = places < self.n
            for o, g in zip(out, got):
                o[places[there]] = g[there]
        return out or [np.zeros(0) for _ in empty]


def counts(rows: Rows, good: np.ndarray, w: int) -> np.ndarray:
    """How many rows of each window are good; whole numbers, so a difference is exact."""
    upto = np.append(0, np.cumsum(good))
    return upto[rows.at + 1] - upto[rows.since(w)]


def lagged(rows: Rows, x: np.ndarray, n: int) -> np.ndarray:
    """Each series' values n rows later."""
    at = rows.at - n
    return np.where(at >= rows.first, x[np.maximum(at, 0)], np.nan) if rows.n else x


def _simple(operation, empty):
    def over(rows: Rows, x: np.ndarray, w: int) -> np.ndarray:
        x = np.where(np.isnan(x), empty, x)

        def head(laid, back):
            return [operation.accumulate(np.where(np.isnan(laid[0]), empty, laid[0]), axis=0)]

        return rows.fold(w, [x], head, lambda a, b: [operation(a[0], b[0])], [empty])[0]

    return over


#: Sums over so many rows at most are added up from the oldest on, as aggregates over a frame are, so that their last bits agree.
PLAIN = 16
_block_sums, products = _simple(np.add, 0.0), _simple(np.multiply, 1.0)
largest, smallest = _simple(np.maximum, -np.inf), _simple(np.minimum, np.inf)


def sums(rows: Rows, x: np.ndarray, w: int) -> np.ndarray:
    if w > PLAIN:
        return _block_sums(rows, x, w)
    x, out = np.where(np.isnan(x), 0.0, x), np.zeros(rows.n)
    for n in range(w - 1, -1, -1):
        out += np.nan_to_num(lagged(rows, x, n), nan=0.0, posinf=np.inf, neginf=-np.inf)
    return out


def means(rows: Rows, x: np.ndarray, w: int) -> np.ndarray:
    """Sums over counts, as aggregates have them, so that equal rows of values tie."""
    n = counts(rows, ~np.isnan(x), w)
    return np.where(n > 0, sums(rows, x, w) / np.maximum(n, 1), np.nan)


def place_of(rows: Rows, x: np.ndarray, w: int, highest: bool, earliest: bool) -> np.ndarray:
    """Row of each window's extreme, the earliest or the latest of equal ones; -1 without a value."""
    x = x if highest else -x

    def head(laid, back):
        value, at = laid
        best, where = np.full(value.shape, -np.inf), np.full(value.shape, -1, np.int64)
        b, p = np.full(value.shape[1], -np.inf), np.full(value.shape[1], -1, np.int64)
        for k in range(len(value)):
            v = value[k]
            takes = (v > b) | ((p < 0) & (v == b)) if earliest != back else v >= b
            b, p = np.where(takes, v, b), np.where(takes, at[k], p).astype(np.int64)
            best[k], where[k] = b, p
        return [best, where]

    def merge(tail, head):
        newer = (head[0] > tail[0]) if earliest else (head[0] >= tail[0])
        newer |= tail[1] < 0
        return [np.where(newer, head[0], tail[0]), np.where(newer, head[1], tail[1])]

    return rows.fold(w, [x, rows.at.astype(float)], head, merge, [-np.inf, -1])[1]


def moments(rows: Rows, x: np.ndarray, w: int, order: int = 2) -> list[np.ndarray]:
    """[number, mean, central sums of powers 2 to order] of each window."""

    def head(laid, back):
        v = laid[0]
        out = [np.empty(v.shape) for _ in range(order + 1)]
        s = [np.zeros(v.shape[1]) for _ in range(order + 1)]
        for k in range(len(v)):
            good = ~np.isnan(v[k])
            before = s[0]
            n = before + good
            d = np.where(good, v[k] - s[1], 0.0)
            dn = d / np.maximum(n, 1)
            t = d * dn * before
            new = [n, s[1] + dn]
            if order >= 2:
                new.append(s[2] + t)
            if order >= 3:
                new.append(s[3] + t * dn * (n - 2) - 3 * dn * s[2])
            if order >= 4:
                new.append(s[4] + t * dn * dn * (n * n - 3 * n + 3) + 6 * dn * dn * s[2] - 4 * dn * s[3])
            s = new
            for o, value in zip(out, s):
                o[k] = value
        return out

    def merge(a, b):
        n = a[0] + b[0]
        safe = np.maximum(n, 1)
        d = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
        mean = np.where(a[0] == 0, b[1], np.where(b[0] == 0, a[1], a[1] + d * b[0] / safe))
        out = [n, mean]
        both = a[0] * b[0] / safe
        if order >= 2:
            out.append(a[2] + b[2] + d * d * both)
        if order >= 3:
            out.append(a[3] + b[3] + d**3 * both * (a[0] - b[0]) / safe + 3 * d * (a[0] * b[2] - b[0] * a[2]) / safe)
        if order >= 4:
            fourth = d**4 * both * (a[0] ** 2 - a[0] * b[0] + b[0] ** 2) / safe**2
            out.append(a[4] + b[4] + fourth + 6 * d * d * (a[0] ** 2 * b[2] + b[0] ** 2 * a[2]) / safe**2 + 4 * d * (a[0] * b[3] - b[0] * a[3]) / safe)
        return out

    return rows.fold(w, [x], head, merge, [0.0] * (order + 1))


def pairs(rows: Rows, x: np.ndarray, y: np.ndarray, w: int) -> list[np.ndarray]:
    """[number, mean of x, mean of y, central sums of xx, yy and xy] of each window's rows in which both stand."""
    x, y = np.where(np.isnan(y), np.nan, x), np.where(np.isnan(x), np.nan, y)

    def head(laid, back):
        out = [np.empty(laid[0].shape) for _ in range(6)]
        n, mx, my, xx, yy, xy = np.zeros((6, laid[0].shape[1]))
        for k in range(len(laid[0])):
            u, v = laid[0][k], laid[1][k]
            good = ~np.isnan(u)
            n = n + good
            dx, dy = np.where(good, u - mx, 0.0), np.where(good, v - my, 0.0)
            safe = np.maximum(n, 1)
            mx, my = mx + dx / safe, my + dy / safe
            share = (n - 1) / safe
            xx, yy, xy = xx + dx * dx * share, yy + dy * dy * share, xy + dx * dy * share
            for o, value in zip(out, (n, mx, my, xx, yy, xy)):
                o[k] = value
        return out

    def merge(a, b):
        n = a[0] + b[0]
        safe = np.maximum(n, 1)
        met = (a[0] > 0) & (b[0] > 0)
        both = a[0] * b[0] / safe
        d = [np.where(met, b[i] - a[i], 0.0) for i in (1, 2)]
        mean = [np.where(a[0] == 0, b[i], np.where(b[0] == 0, a[i], a[i] + d[i - 1] * b[0] / safe)) for i in (1, 2)]
        return [n, *mean, a[3] + b[3] + d[0] * d[0] * both, a[4] + b[4] + d[1] * d[1] * both, a[5] + b[5] + d[0] * d[1] * both]

    return rows.fold(w, [x, y], head, merge, [0.0] * 6)


class Ordered:
    """Order statistics of any range of a sequence without gaps, all ranges at once: a wavelet matrix over the values' ranks. A query goes through one level for each bit of the number of distinct values."""

    def __init__(self, x: np.ndarray, sums: bool = False):
        self.values, code = np.unique(x, return_inverse=True)
        self.bits = max(1, int(len(self.values) - 1).bit_length())
        self.levels, self.sums = [], []
        for b in range(self.bits - 1, -1, -1):
            one = (code >> b & 1).astype(bool)
            zeros = np.append(0, np.cumsum(~one)).astype(np.int32 if len(x) < 1 << 31 else np.int64)
            self.levels.append((b, zeros, int(zeros[-1])))
            if sums:  # of the values that go to the left
                self.sums.append(np.append(0.0, np.cumsum(np.where(one, 0.0, x))))
                x = np.concatenate([x[~one], x[one]])
            code = np.concatenate([code[~one], code[one]])

    def kth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, in each [left, right); NaN where there is none."""
        empty = (k < 0) | (k >= right - left)
        l, r, k = left.copy(), np.where(empty, left, right), np.where(empty, 0, k)
        code = np.zeros(len(l), np.int64)
        for b, zeros, split in self.levels:
            zl, zr = zeros[l].astype(np.int64), zeros[r].astype(np.int64)
            one = k >= zr - zl
            k = np.where(one, k - (zr - zl), k)
            code |= one.astype(np.int64) << b
            l, r = np.where(one, split + l - zl, zl), np.where(one, split + r - zr, zr)
        if not len(self.values):
            return np.full(len(left), np.nan)
        return np.where(empty, np.nan, self.values[np.minimum(code, len(self.values) - 1)])

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray, equal: bool = False) -> np.ndarray:
        """How many values in each [left, right) are less than x, or at most x."""
        code = np.searchsorted(self.values, x, "right" if equal else "left")
        every = code >= len(self.values)
        code = np.where(every, 0, code)
        l, r, out = left.copy(), right.copy(), np.zeros(len(left), np.int64)
        for b, zeros, split in self.levels:
            zl, zr = zeros[l].astype(np.int64), zeros[r].astype(np.int64)
            one = (code >> b & 1).astype(bool)
            out += np.where(one, zr - zl, 0)
            l, r = np.where(one, split + l - zl, zl), np.where(one, split + r - zr, zr)
        return np.where(every, right - left, out)

    def below_sum(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, sum) of the values less than x in each [left, right); made with sums."""
        code = np.searchsorted(self.values, x, "left")
        every = code >= len(self.values)
        code = np.where(every, len(self.values) - 1, code)  # the greatest is then added at the end
        l, r = left.copy(), right.copy()
        number, total = np.zeros(len(left), np.int64), np.zeros(len(left))
        for (b, zeros, split), upto in zip(self.levels, self.sums):
            zl, zr = zeros[l].astype(np.int64), zeros[r].astype(np.int64)
            one = (code >> b & 1).astype(bool)
            number += np.where(one, zr - zl, 0)
            total += np.where(one, upto[r] - upto[l], 0.0)
            l, r = np.where(one, split + l - zl, zl), np.where(one, split + r - zr, zr)
        if len(self.values):
            number += np.where(every, r - l, 0)
            total += np.where(every, (r - l) * self.values[-1], 0.0)
        return number, total

    def quantile(self, left: np.ndarray, right: np.ndarray, q: float) -> np.ndarray:
        """Linear between the two nearest; NaN where there is no value."""
        place = (right - left - 1) * q
        low = np.floor(np.maximum(place, 0)).astype(np.int64)
        a, b = self.kth(left, right, low), self.kth(left, right, np.minimum(low + 1, np.maximum(right - left - 1, 0)))
        share = place - low
        return np.where(right > left, a * (1 - share) + b * share, np.nan)

    def middle_distance(self, left: np.ndarray, right: np.ndarray, center: np.ndarray) -> np.ndarray:
        """Median of the distances from center. Values below center, going down, and the rest, going up, are two sorted lists of distances; how many of the least come from the first is found by halving."""
        n, less = right - left, self.below(left, right, center)

        def down(i):
            return np.where((i >= 0) & (i < less), center - self.kth(left, right, less - 1 - i), np.where(i < 0, -np.inf, np.inf))

        def up(i):
            return np.where((i >= 0) & (i < n - less), self.kth(left, right, less + i) - center, np.where(i < 0, -np.inf, np.inf))

        take = (n - 1) // 2 + 1  # the lower middle is the last of these
        low, high = np.maximum(0, take - (n - less)), np.minimum(take, less)
        for _ in range(int(np.max(n, initial=1)).bit_length()):
            middle = (low + high) // 2
            more = (middle < high) & (down(middle) < up(take - middle - 1))  # one more from the first list belongs to the least
            low, high = np.where(more, middle + 1, low), np.where(more, high, middle)
        lower = np.maximum(down(low - 1), up(take - low - 1))
        upper = np.where(n % 2 == 1, lower, np.minimum(down(low), up(take - low)))
        with np.errstate(invalid="ignore"):
            return np.where(n > 0, (lower + upper) / 2, np.nan)


def valid_ranges(rows: Rows, x: np.ndarray, w: int | None):
    """(the values of x, [left, right) of each row's window among them); w None: from the series' first row."""
    good = ~np.isnan(x)
    upto = np.append(0, np.cumsum(good))
    return x[good], upto[rows.first if w is None else rows.since(w)], upto[rows.at + 1]


def mean_distance(rows: Rows, x: np.ndarray, w: int, center: np.ndarray) -> np.ndarray:
    """Mean distance of each window's values from that row's center: n times the center and the window's sum are known, so the sum of the values below the center is enough. Sums by level of the ordered values run over values less their series' mean, and their differences carry about one rounding of the run's sum of distances."""
    good = ~np.isnan(x)
    size = np.maximum(rows.ends - rows.starts, 1)
    level = np.repeat(np.add.reduceat(np.append(np.where(good, x, 0.0), 0.0), rows.starts) / size, rows.ends - rows.starts) if rows.n else x
    values, left, right = valid_ranges(rows, x - level, w)
    order = Ordered(values, sums=True)
    number, total = order.below_sum(left, right, center - level)
    n = right - left
    whole = sums(rows, x - level, w)
    center = center - level
    return np.where(n > 0, np.maximum(whole - 2 * total + center * (2 * number - n), 0.0) / np.maximum(n, 1), np.nan)
