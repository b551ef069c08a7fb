"""SQL for recursive series: a code's series is a list, a recursion a fold that appends to a list.

Lists are aligned at their ends: one that lacks the warm-up is shorter at the front. Each step is a common table expression over the one before, so no expression is said twice.
"""

from __future__ import annotations

from .functions.normal import CENTRE, MIDDLE, TAIL


class Lists:
    """Named lists by code. Methods add one and return its name."""

    def __init__(self, columns: str):
        self.steps = [f"l0 as (select code, list(time order by time) as times, {', '.join(f'list({c} order by time) as {c}' for c in columns.split())} from panel group by code)"]
        self.made = 0

    def let(self, expression: str) -> str:
        name = f"r{self.made}"
        self.steps.append(f"l{len(self.steps)} as (select *, {expression} as {name} from l{len(self.steps) - 1})")
        self.made += 1
        return name

    def map(self, expression: str, *names: str, drop: int = 0) -> str:
        """expression of values a, b, ... at the same rows, as far back as all lists go, and drop rows less."""
        n = self.let(f"greatest(0, least({', '.join(f'len({x})' for x in names)}) - {drop})")
        text = expression
        for letter, name in zip("abcdef", names):
            text = text.replace(f"${letter}", f"{name}[len({name}) - {n} + i]")
        return self.let(f"list_transform(range(1, {n} + 1), lambda i: ({text})::double)")

    def lagged(self, name: str, by: int = 1) -> str:
        """The value `by` rows earlier."""
        return self.let(f"{name}[1:len({name}) - {by}]")

    def fold(self, seed: str, rest: str, step: str) -> str:
        """seed, then step(s, the value of rest) after each; empty if seed is NULL."""
        folded = f"list_reduce(list_prepend([({seed})::double], list_transform({rest}, lambda v: [v::double])), lambda s, e: list_append(s, {step.replace('$s', 's[-1]').replace('$x', 'e[1]')}))"
        return self.let(f"case when ({seed}) is null then []::double[] else {folded} end")

    def smooth(self, x: str, n: int, k: float, skip: int = 0) -> str:
        """Seeded with the mean of n values after `skip`, then s + k (x - s)."""
        return self.fold(f"case when len({x}) >= {n + skip} then list_avg({x}[{skip + 1}:{skip + n}]) end", f"{x}[{skip + n + 1}:]", f"$s + {k!r} * ($x - $s)")

    def ema(self, x: str, n: int) -> str:
        return self.smooth(x, n, 2 / (n + 1))

    def chain(self, x: str, n: int, depth: int) -> list[str]:
        out = [self.ema(x, n)]
        while len(out) < depth:
            out.append(self.ema(out[-1], n))
        return out

    def wilder_mean(self, x: str, n: int) -> str:
        return self.smooth(x, n, 1 / n)

    def wilder_sum(self, x: str, n: int) -> str:
        return self.fold(f"case when len({x}) >= {n - 1} then list_sum({x}[1:{n - 1}]) end", f"{x}[{n}:]", f"$s - $s / {float(n)} + $x")

    def sql(self, outputs: dict[str, str]) -> tuple[str, str]:
        """(the expressions, with a table `more` of the panel's rows and a column for each output; its name)."""
        padded = ", ".join(f"list_concat(list_transform(range(len(times) - len({name})), lambda i: null::double), {name}) as {out}" for out, name in outputs.items())
        self.steps.append(f"padded as (select code, times, {padded} from l{len(self.steps) - 1})")
        self.steps.append(f"more as (select code, unnest(times) as time, {', '.join(f'unnest({o}) as {o}' for o in outputs)} from padded)")
        return ", " + ", ".join(self.steps), "more"


def averages(n: int, fast: int, slow: int, signal: int, v: float) -> tuple[str, str]:
    """The averages of c over n rows."""
    s, out = Lists("c"), {}
    e = s.chain("c", n, 6)
    window = lambda size, weight: s.let(f"list_transform(range({size}, len(c) + 1), lambda i: list_sum(list_transform(c[i - {size - 1}:i], lambda v, j: v * {weight})) / list_sum(list_transform(range(1, {size + 1}), lambda j: {weight})))")
    out["ema"] = e[0]
    out["dema"] = s.map("2 * $a - $b", *e[:2])
    out["tema"] = s.map("3 * $a - 3 * $b + $c", *e[:3])
    path = s.let("list_transform(range(1, len(c)), lambda i: abs(c[i + 1] - c[i]))")
    sums = s.let(f"list_transform(range({n}, len({path}) + 1), lambda i: list_sum({path}[i - {n - 1}:i]))")
    factor = s.map(f"pow(case when $a = 0 then 1 else least(1, abs($b - $c) / $a) end * ({2 / 3!r} - {2 / 31!r}) + {2 / 31!r}, 2)", sums, "c", s.lagged("c", n))
    pairs = s.let(f"list_transform(range(1, len({factor}) + 1), lambda i: [{factor}[i], c[len(c) - len({factor}) + i]])")
    kama = s.let(f"case when len(c) > {n} then list_reduce(list_prepend([c[{n}]], {pairs}), lambda s, e: list_append(s, s[-1] + e[1] * (e[2] - s[-1]))) else []::double[] end")
    out["kama"] = s.let(f"{kama}[2:]")
    out["t3"] = s.map(f"{(1 + v) ** 3!r} * $a - {3 * v * (1 + v) ** 2!r} * $b + {3 * v**2 * (1 + v)!r} * $c - {v**3!r} * $d", *e[2:])
    moves = s.let("list_transform(range(1, len(c)), lambda i: c[i + 1] - c[i])")
    gain, loss = (s.wilder_mean(s.let(f"list_transform({moves}, lambda v: greatest({sign}v, 0))"), n) for sign in ("", "-"))
    out["rsi"] = s.map("case when $a + $b = 0 then 0 else 100 * $a / ($a + $b) end", gain, loss)
    out["trix"] = s.map("100 * ($a / $b - 1)", e[2], s.lagged(e[2]))
    out["ma"] = window(n, "j")
    a, b = window(fast, "1"), window(slow, "1")
    out["apo"] = s.map("$a - $b", a, b)
    out["ppo"] = s.map("case when $b <> 0 then 100 * ($a - $b) / $b end", a, b)
    line = s.map("$a - $b", s.smooth("c", fast, 2 / (fast + 1), slow - fast), s.ema("c", slow))
    out["macd"] = s.map("$a", line, s.ema(line, signal))
    spread = s.let(f"list_transform(range({n}, len(c) + 1), lambda i: list_stddev_pop(c[i - {n - 1}:i]))")
    out["bBands"] = s.map("$a + 2 * $b", window(n, "1"), spread)
    return s.sql(out)


def ranges(n: int) -> tuple[str, str]:
    """Ranges and directional movement of h, l and c over n rows; balance of v."""
    s, out = Lists("h l c v"), {}
    true_range = s.map("greatest($a, $c) - least($b, $c)", "h", "l", s.lagged("c"))
    up = s.map("case when $a - $c > $d - $b and $a > $c then $a - $c else 0 end", "h", "l", s.lagged("h"), s.lagged("l"))
    down = s.map("case when $d - $b > $a - $c and $d > $b then $d - $b else 0 end", "h", "l", s.lagged("h"), s.lagged("l"))
    out["atr"] = s.wilder_mean(true_range, n)
    out["natr"] = s.map("case when $b <> 0 then 100 * $a / $b end", out["atr"], "c")
    out["plus_dm"], out["minus_dm"] = s.wilder_sum(up, n), s.wilder_sum(down, n)
    total = s.wilder_sum(true_range, n)
    for name, move in (("plus_di", out["plus_dm"]), ("minus_di", out["minus_dm"])):
        out[name] = s.map("case when $b = 0 then 0 else 100 * $a / $b end", move, total, drop=1)
    out["dx"] = s.map("case when $a + $b = 0 then 0 else 100 * abs($a - $b) / ($a + $b) end", out["plus_di"], out["minus_di"])
    out["adx"] = s.wilder_mean(out["dx"], n)
    out["adxr"] = s.map("($a + $b) / 2", out["adx"], s.lagged(out["adx"], n - 1))
    turns = s.map("$c * sign($a - $b)", "c", s.lagged("c"), "v")
    out["obv"] = s.fold("v[1]", turns, "$s + $x")
    return s.sql(out)


def weighted(span: float, alpha: float) -> tuple[str, str]:
    """Exponentially weighted moments of x (by span) and of x and y (by alpha), weights falling at every row, gaps included; NULLs weigh nothing."""

    def moments(q: float, values: str, name: str, other: str) -> str:
        weight = f"case when v is null then 0 else pow({q!r}, len({values}) - i) end"
        total = lambda e: f"list_sum(list_transform({values}, lambda v, i: {e}))"
        return f"""{name} as (select *, m1 / w1 as mx, m2 / w1 as my from (select *, {total(weight)} as w1, {total(f"pow({weight}, 2)")} as w2, {total(f"({weight}) * coalesce(v[1], 0)")} as m1, {total(f"({weight}) * coalesce(v[2], 0)")} as m2 from {other}))"""

    def spread(q: float, values: str, a: str, b: str) -> str:
        mean = {"1": "mx", "2": "my"}
        return f"list_sum(list_transform({values}, lambda v, i: case when v is null then 0 else pow({q!r}, len({values}) - i) * (v[{a}] - {mean[a]}) * (v[{b}] - {mean[b]}) end)) / w1"

    one, two = 1 - 2 / (span + 1), 1 - alpha
    several = lambda values: f"len(list_filter({values}, lambda v: v is not null)) > 1"
    unbiased = lambda values: f"(case when {several(values)} then w1 * w1 / (w1 * w1 - w2) end)"
    text = f""", xs as (select time, code, list(case when x is not null then [x, x] end) over (partition by code order by time rows between unbounded preceding and current row) as xx, list(case when x is not null and y is not null then [x, y] end) over (partition by code order by time rows between unbounded preceding and current row) as xy from panel),
{moments(one, "xx", "singles", "xs")},
single as (select time, code, xy, case when w1 > 0 then mx end as ewm_mean, {unbiased("xx")} * {spread(one, "xx", "1", "1")} as ewm_var from singles),
{moments(two, "xy", "pairs", "single")},
more as (select time, code, ewm_mean, ewm_var, sqrt(ewm_var) as ewm_std, {unbiased("xy")} * {spread(two, "xy", "1", "2")} as ewm_cov, case when {several("xy")} then {spread(two, "xy", "1", "2")} / nullif(sqrt(({spread(two, "xy", "1", "1")}) * ({spread(two, "xy", "2", "2")})), 0) end as ewm_corr from pairs)"""
    return text, "more"


def inverse_normal(p: str) -> str:
    """The inverse normal distribution, by the coefficients of functions/normal.py."""

    def ratio(x: str, both) -> str:
        up, down = (" + ".join(f"{c!r} * pow({x}, {k})" for k, c in enumerate(cs)) for cs in both)
        return f"(({up}) / ({down}))"

    r = f"sqrt(-ln(least({p}, 1 - ({p}))))"
    outer = f"case when {r} <= 5 then {ratio(f'({r} - 1.6)', MIDDLE)} else {ratio(f'({r} - 5)', TAIL)} end"
    return f"case when abs({p} - 0.5) <= 0.425 then ({p} - 0.5) * {ratio(f'(0.180625 - pow({p} - 0.5, 2))', CENTRE)} else sign({p} - 0.5) * ({outer}) end"
