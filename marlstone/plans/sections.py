"""Wide sections: operators over the rows of one time where one time may hold more rows than a task should.

Reductions are grouped aggregates, combined before the shuffle, and joined back. Ranks come from the distinct values of each section with their counts: range-sorted by time and value into parts, a place is what lies before in its part and in the section's earlier parts, so only one row for each part and section is ordered by itself. Equal values are one row there, however many they are. Quantiles are picked from the same table by place. Orders that go down to the code are sorted by (time, value, code), whose rows are all different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import correlation, finite_or_null, safe_div
from ..functions.normal import inverse_normal
from ..sources.shared import written
from .spec import Node, RequestError

#: Sections up to which their totals are sent to every task; beyond, the join shuffles both sides.
BROADCAST_SECTIONS = 200_000


def _saved(df: DataFrame, tag: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(written(df, tag))


class Sections:
    """A panel to which columns over sections are added one after another. Methods give the columns' expressions."""

    def __init__(self, df: DataFrame, fresh):
        self.df, self.fresh = _saved(df, "sections"), fresh
        self.added: dict[str, Column] = {}
        self.places: dict[tuple, tuple] = {}
        self.pending: dict[tuple, list[Column]] = {}  # totals that are asked for and not yet joined, by key
        self.asked: set[str] = set()

    def add(self, value: Column) -> Column:
        """value as a column of its own; equal expressions share one."""
        said = value._jc.toString()
        if said not in self.added:
            if any(name in said for name in self.asked):
                self.flush()
            name = self.fresh()
            self.df = self.df.withColumn(name, value)
            self.added[said] = self.added[name] = F.col(name)
        return self.added[said]

    def _keys(self, by: tuple) -> tuple[str, ...]:
        return ("time", *[self.add(b)._jc.toString() for b in by])

    def _join(self, made: DataFrame, keys, small: bool = False) -> None:
        """Joins made on the columns keys of both, null keys equal to none."""
        if small and made.limit(BROADCAST_SECTIONS + 1).count() <= BROADCAST_SECTIONS:
            made = F.broadcast(made)
        self.df = self.df.join(made, list(keys), "left")

    def totals(self, *aggregates: Column, by: tuple = ()) -> list[Column]:
        """One column for each aggregate, over the section or the section's rows of one value of `by`. All that are asked for until one is used are made together."""
        keys, out = self._keys(by), []
        for a in aggregates:
            said = f"{a._jc.toString()} {keys}"
            if said not in self.added:
                if any(name in said for name in self.asked):
                    self.flush()
                self.added[said] = F.col(self.fresh())
                name = self.added[said]._jc.toString()
                self.pending.setdefault(keys, []).append(a.alias(name))
                self.asked.add(name)
            out.append(self.added[said])
        return out

    def flush(self) -> None:
        waiting, self.pending, self.asked = self.pending, {}, set()
        for keys, aggregates in waiting.items():
            self._join(_saved(self.df.groupBy(*keys).agg(*aggregates), "section-totals"), keys, small=True)

    def _places(self, value: Column, by: tuple) -> tuple[DataFrame, list[str], str]:
        """(table, keys, name of value): for each section the distinct values with _n (rows), _before (rows of smaller values), _dense (smaller values), _all and _distinct (of the section)."""
        x, keys = self.add(value)._jc.toString(), list(self._keys(by))
        if (x, *keys) in self.places:
            return self.places[x, *keys], keys, x
        rows = self.df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
        n_parts = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = _saved(rows.repartitionByRange(n_parts, *keys, x).withColumn("_part", F.spark_partition_id()), "section-values")
        earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        section = W.partitionBy(*keys)
        zero = lambda c: F.coalesce(c, F.lit(0))
        parts = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"), F.count("*").alias("_c"))
        parts = parts.select(*keys, "_part", zero(F.sum("_s").over(earlier)).alias("_ps"), zero(F.sum("_c").over(earlier)).alias("_pc"), F.sum("_s").over(section).alias("_all"), F.sum("_c").over(section).alias("_distinct"))
        inside = W.partitionBy("_part", *keys).orderBy(x).rowsBetween(W.unboundedPreceding, -1)
        out = placed.withColumns({"_before": zero(F.sum("_n").over(inside)), "_dense": zero(F.count("_n").over(inside))}).join(parts, [*keys, "_part"])
        out = out.select(*keys, x, "_n", (F.col("_before") + F.col("_ps")).alias("_before"), (F.col("_dense") + F.col("_pc")).alias("_dense"), "_all", "_distinct")
        self.places[x, *keys] = _saved(out, "section-places")
        return self.places[x, *keys], keys, x

    def rank(self, value: Column, ascending: bool, ties: str, by: tuple = (), share: bool = False) -> Column:
        if ties == "first":
            if by:
                value = F.when(by[0].isNotNull(), value)
            place = self.order(value, ascending, by)
            return place / self.totals(F.count(value), by=by)[0] if share else place
        made, keys, x = self._places(value, by)
        n, before, dense, every, distinct = (F.col(c) for c in ("_n", "_before", "_dense", "_all", "_distinct"))
        if not ascending:
            before, dense = every - before - n, distinct - dense - 1
        rank = {"min": before + 1, "max": before + n, "average": before + (n + 1) / 2, "dense": dense + 1}[ties]
        name = self.fresh()
        self._join(made.select(*keys, x, (rank / (distinct if ties == "dense" else every) if share else rank).alias(name)), [*keys, x])
        return F.col(name)

    def order(self, value: Column, ascending: bool, by: tuple = ()) -> Column:
        """Place from 1 by value, then code, among the rows that have one."""
        x, name = self.add(value)._jc.toString(), self.fresh()
        keys = list(self._keys(by))
        order = [F.col(x).asc() if ascending else F.col(x).desc(), F.col("code").asc()]
        n_parts = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = self.df.where(F.col(x).isNotNull()).select(*keys, "code", x).repartitionByRange(n_parts, *keys, *order)
        placed = _saved(rows.withColumn("_part", F.spark_partition_id()), "section-order")
        parts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
        parts = parts.withColumn("_upto", F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
        placed = placed.withColumn(name, F.row_number().over(W.partitionBy("_part", *keys).orderBy(*order))).join(parts, [*keys, "_part"])
        self._join(_saved(placed.select("time", "code", (F.col(name) + F.col("_upto")).alias(name)), "section-places"), ["time", "code"])
        return F.col(name)

    def quantiles(self, value: Column, *qs: float) -> list[Column]:
        """Linear between the two nearest."""
        made, keys, x = self._places(value, ())
        names = [self.fresh() for _ in qs]
        at = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col(x)))
        out = []
        for q, name in zip(qs, names):
            place = (F.col("_all") - 1) * F.lit(q)
            low = F.floor(place)
            a, b, share = at(low), at(F.least(low + 1, F.col("_all") - 1)), F.max(place - low)
            out.append(F.when(share == 0, a).otherwise(a * (1 - share) + b * share).alias(name))
        self._join(_saved(made.groupBy(*keys).agg(*out), "section-quantiles"), keys, small=True)
        return [F.col(n) for n in names]


def _d(c):
    return c.cast("double")


def _moment(g):
    return lambda s, x: s.totals(g(_d(x)))[0]


def _spread(ddof, squared=False):
    return {(0, False): F.stddev_pop, (1, False): F.stddev_samp, (0, True): F.var_pop, (1, True): F.var_samp}[ddof, squared]


def _scaled(below):
    return lambda s, x: safe_div(_d(x), below(s.totals(F.sum(_d(x)), F.sum(F.abs(_d(x))), F.sum(_d(x) * _d(x)))))


def _zscore(s, x, ddof, by=()):
    mean, spread = s.totals(F.avg(_d(x)), _spread(ddof)(_d(x)), by=by)
    return safe_div(_d(x) - mean, spread)


def _median_and_mad(s, x):
    median = s.quantiles(_d(x), 0.5)[0]
    return median, s.quantiles(F.abs(_d(x) - median), 0.5)[0]


def _clamp(x, low, high):
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def _winsorize(s, x, lower, upper):
    return _clamp(_d(x), *s.quantiles(_d(x), lower, upper))


def _winsorize_mad(s, x, n, scale):
    median, far = _median_and_mad(s, x)
    return _clamp(_d(x), median - far * (n * scale), median + far * (n * scale))


def _robust(s, x, scale):
    median, far = _median_and_mad(s, x)
    return safe_div(_d(x) - median, far * scale)


def _best(up, share=False):
    def of(s, x, **p):
        place = s.order(x, up)
        limit = F.ceil(s.totals(F.count(x))[0] * F.lit(p["pct"])) if share else F.lit(p["n"])
        return F.coalesce(place <= limit, F.lit(False))

    return of


def _line(s, x, y):
    """(slope, intercept) of y on x."""
    return s.totals(F.regr_slope(_d(y), _d(x)), F.regr_intercept(_d(y), _d(x)))


def _corr(s, x, y):
    held = []
    correlation(x, y, lambda c: held.append(c) or c)  # the aggregates it is made of
    got = iter(s.totals(*held))
    return correlation(x, y, lambda c: next(got))


def _residual(s, x, y):
    slope, intercept = _line(s, x, y)
    return finite_or_null(_d(y) - intercept - slope * _d(x))


def _rank_corr(s, x, y):
    good = x.isNotNull() & y.isNotNull()
    a, b = (s.rank(F.when(good, _d(c)), True, "min") for c in (x, y))
    return _corr(s, s.add(a), s.add(b))


def _within(g):
    return lambda s, x, by, **p: F.when(by.isNotNull(), g(s, x, by, **p))


WIDE = {
    "unary.count": lambda s, x: s.totals(F.count(x))[0],
    "unary.max": lambda s, x: s.totals(F.max(x))[0],
    "unary.min": lambda s, x: s.totals(F.min(x))[0],
    "unary.mean": _moment(F.avg),
    "unary.sum": _moment(F.sum),
    "unary.skew": lambda s, x: finite_or_null(s.totals(F.skewness(_d(x)))[0]),
    "unary.kurt": lambda s, x: finite_or_null(s.totals(F.kurtosis(_d(x)))[0]) + 3,
    "unary.std": lambda s, x, ddof: s.totals(_spread(ddof)(_d(x)))[0],
    "unary.var": lambda s, x, ddof: s.totals(_spread(ddof, True)(_d(x)))[0],
    "unary.median": lambda s, x: s.quantiles(_d(x), 0.5)[0],
    "unary.quantile": lambda s, x, q: s.quantiles(_d(x), q)[0],
    "unary.mad": lambda s, x: _median_and_mad(s, x)[1],
    "unary.demean": lambda s, x: _d(x) - s.totals(F.avg(_d(x)))[0],
    "unary.zscore": _zscore,
    "unary.normalize_sum": _scaled(lambda t: t[0]),
    "unary.normalize_l1": _scaled(lambda t: t[1]),
    "unary.normalize_l2": _scaled(lambda t: F.sqrt(t[2])),
    "unary.robust_zscore": _robust,
    "unary.winsorize": _winsorize,
    "unary.winsorize_mad": _winsorize_mad,
    "unary.rank": lambda s, x, ascending, ties_method: s.rank(x, ascending, ties_method),
    "unary.rank_dense": lambda s, x, ascending: s.rank(x, ascending, "dense"),
    "unary.rank_pct": lambda s, x, ascending, ties_method: s.rank(x, ascending, ties_method, share=True),
    "unary.rank_normal": lambda s, x, ascending: inverse_normal(s.add((s.rank(x, ascending, "average") - 0.5) / s.totals(F.count(x))[0])),
    "unary.qcut": lambda s, x, q: F.floor((s.rank(x, True, "min") - 1) * q / s.totals(F.count(x))[0]),
    "unary.top_n": _best(False),
    "unary.bottom_n": _best(True),
    "unary.top_pct": _best(False, share=True),
    "unary.bottom_pct": _best(True, share=True),
    "grouped.mean": _within(lambda s, x, by: s.totals(F.avg(_d(x)), by=(by,))[0]),
    "grouped.demean": _within(lambda s, x, by: _d(x) - s.totals(F.avg(_d(x)), by=(by,))[0]),
    "grouped.zscore": _within(lambda s, x, by, ddof: _zscore(s, x, ddof, (by,))),
    "grouped.rank_pct": _within(lambda s, x, by, ascending, ties_method: s.rank(x, ascending, ties_method, (by,), share=True)),
    "binary.corr": _corr,
    "binary.cov": lambda s, x, y: s.totals(F.covar_samp(_d(x), _d(y)))[0],
    "binary.beta": lambda s, x, y: finite_or_null(_line(s, x, y)[0]),
    "binary.alpha": lambda s, x, y: finite_or_null(_line(s, x, y)[1]),
    "binary.residual": _residual,
    "binary.rank_corr": _rank_corr,
}


def in_sections(df: DataFrame, nodes: list[tuple[str, Node, list, Column | None]], fresh) -> DataFrame:
    """df with a column for each node (column to make, node, its operands, its condition). Rows outside a condition take no part, as if they had no value."""
    for _, node, *_ in nodes:
        if node.op.name not in WIDE:
            raise RequestError(f"{node.op.name} needs a whole section: run it without chunk_rows")
    sections = Sections(df, fresh)
    kept = df.columns
    made = {}
    for name, node, operands, on in nodes:
        held = None if on is None else sections.add(on)
        values = [sections.add(x if held is None or i else F.when(held, x)) for i, x in enumerate(operands)]
        value = WIDE[node.op.name](sections, *values, **dict(node.params))
        made[name] = value if held is None else F.when(held, value)
    sections.flush()
    return sections.df.withColumns(made).select(*[F.col(f"`{c}`") for c in [*kept, *made]])
