"""Factor analysis: preprocessing by date, information coefficients and group returns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import correlation, safe_div
from ..plans.request import Query, name_list
from ..plans.spec import RequestError
from ..query import execute_query


@dataclass
class FactorRequest:
    """A checked request. The query is extended by the columns that the analysis needs."""

    query: Query
    factors: list[str]
    returns: list[str]
    specs: dict[str, dict]
    n_groups: int = 5
    preprocess: bool = True
    market_value: str = "circ_mv"
    codes_query: Query | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, value: Any) -> FactorRequest:
        if isinstance(value, FactorRequest):
            return value
        keys = {"codes_query", "dataset_query", "factor_columns", "return_columns", "return_specs", "n_groups", "preprocess", "market_value_column"}
        if not isinstance(value, dict) or set(value) - keys:
            raise RequestError(f"a factor analysis takes {sorted(keys)}")
        factors, returns = (name_list(value.get(k), k) for k in ("factor_columns", "return_columns"))
        market_value = value.get("market_value_column", "circ_mv")
        if not factors or not returns:
            raise RequestError("factor_columns and return_columns may not be empty")
        query = dict(value.get("dataset_query") or {})
        listed = list(query.get("factors") or [])
        known = {x.strip() for x in listed} | {x.strip() for x in query.get("derivatives") or {}}
        query["factors"] = listed + [c for c in dict.fromkeys([*factors, *returns, market_value]) if c not in known]
        specs = value.get("return_specs")
        if specs is None:
            specs = {r: return_spec(r, (query.get("derivatives") or {}).get(r)) for r in returns}
        out = cls(Query.parse(query), factors, returns, specs, value.get("n_groups", 5), value.get("preprocess", True), market_value, Query.parse(value["codes_query"]) if value.get("codes_query") else None)
        out.check()
        return out

    def check(self) -> None:
        if set(self.specs) != set(self.returns):
            raise RequestError(f"return_specs must name {sorted(self.returns)}")
        for s in self.specs.values():
            if set(s) - {"kind", "periods"} or s.get("kind", "simple") not in ("simple", "log") or not isinstance(s.get("periods", 1), int) or s.get("periods", 1) < 1:
                raise RequestError(f"{s!r} is no return specification")
        if not isinstance(self.n_groups, int) or isinstance(self.n_groups, bool) or self.n_groups < 2:
            raise RequestError("n_groups must be at least 2")
        if not isinstance(self.preprocess, bool):
            raise RequestError("preprocess must be true or false")
        if both := set(self.factors) & set(self.returns):
            raise RequestError(f"both factor and return: {sorted(both)}")
        if self.market_value in (*self.factors, *self.returns):
            raise RequestError("the market value may be neither factor nor return")
        outputs = {*self.query.factors, *self.query.derivatives}
        made = {f"{f}_group" for f in self.factors}
        if self.preprocess and (clash := outputs & (made | {"industry"})):
            raise RequestError(f"preprocessing makes {sorted(clash)} itself")
        if not self.preprocess and (missing := made - outputs):
            raise RequestError(f"without preprocessing the query must give {sorted(missing)}")


def return_spec(name: str, tree: Any) -> dict:
    """Kind and periods of a return from its tree: a percentage change, or the log of one shift over another."""

    def shift(x):
        if isinstance(x, dict) and x.get("op") == "unary.shift" and isinstance(x.get("fields", {}).get("col"), str) and type(x.get("params", {}).get("periods")) is int:
            return x["fields"]["col"], x["params"]["periods"]

    if isinstance(tree, dict):
        periods = (tree.get("params") or {}).get("periods")
        if tree.get("op") == "unary.pct_change" and type(periods) is int and periods:
            return {"kind": "simple", "periods": abs(periods)}
        inner = (tree.get("fields") or {}).get("col")
        if tree.get("op") == "unary.log" and isinstance(inner, dict) and inner.get("op") == "binary.div":
            a, b = (shift(inner.get("fields", {}).get(k)) for k in ("left", "right"))
            if a and b and a[0] == b[0] and a[1] != b[1]:
                return {"kind": "log", "periods": abs(a[1] - b[1])}
    raise RequestError(f"the return {name!r} needs a specification")


#: A spread of residuals below this is none: standardised values were fitted exactly.
EXACT = 1e-9


def preprocess(df: DataFrame, factors: list[str], n_groups: int, market_value: str, industry: str = "industry", time: str = "time", code: str = "code") -> DataFrame:
    """Each factor becomes its neutral residual, with <factor>_group 0..n-1 beside it; dates are independent sections.

    The factor is pulled to within three median distances of its median and standardised, so is the log of the size; the residual of their regression with a mean for each industry is standardised again. Distances from each industry's means take the place of a column for each industry, and the slope is one sum over another, so all of it are aggregates over a date or a date's industries: one shuffle by date, no Python, as many industries as there are. Missing where a row lacks an input, where factor or size has no spread, with no more rows than industries, or where the fit is exact. Groups go by residual (to nine digits), then code.
    """
    section, sector = W.partitionBy(time), W.partitionBy(time, industry)
    names = {f: [f"__{k}|{f}" for k in ("y", "x", "m", "yd", "xd", "left", "n")] for f in factors}
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    size = F.col(f"`{market_value}`").cast("double")
    steps: list[dict] = [{} for _ in range(8)]
    for f, (y, x, m, yd, xd, left, n) in names.items():
        value = F.col(f"`{f}`").cast("double")
        good = finite(value) & finite(size) & F.col(industry).isNotNull()
        c = {k: F.col(f"`{k}`") for k in (y, x, m, yd, xd, left, n)}
        scaled = lambda v: safe_div(v - F.avg(v).over(section), F.stddev_pop(v).over(section))
        steps[0] |= {y: F.when(good, value), x: F.when(good, F.log(F.greatest(size, F.lit(1.0))))}
        steps[1] |= {m: F.percentile(c[y], F.lit(0.5)).over(section)}
        steps[2] |= {n: 3.0 * F.percentile(F.abs(c[y] - c[m]), F.lit(0.5)).over(section)}
        steps[3] |= {y: F.when(c[n] == 0, c[y]).otherwise(F.greatest(c[m] - c[n], F.least(c[m] + c[n], c[y]))) + 0 * c[y]}
        steps[4] |= {y: scaled(c[y]), x: scaled(c[x])}
        both = c[y].isNotNull() & c[x].isNotNull()
        steps[5] |= {yd: F.when(both, c[y] - F.avg(F.when(both, c[y])).over(sector)), xd: F.when(both, c[x] - F.avg(F.when(both, c[x])).over(sector)), n: F.count(F.when(both, 1)).over(section) - F.size(F.collect_set(F.when(both, F.col(industry))).over(section))}
        slope = F.coalesce(safe_div(F.sum(c[xd] * c[yd]).over(section), F.sum(c[xd] * c[xd]).over(section)), F.lit(0.0))
        steps[6] |= {left: F.when(c[n] > 0, c[yd] - slope * c[xd])}
        spread = F.stddev_pop(c[left]).over(section)
        steps[7] |= {left: F.when(spread > EXACT, (c[left] - F.avg(c[left]).over(section)) / spread)}
    out = df.repartition(time)
    for step in steps:
        out = out.withColumns(step)
    made, groups = {}, {}
    for f, (*_, left, _) in names.items():
        c = F.col(f"`{left}`")
        place = F.row_number().over(section.orderBy(F.round(c, 9).asc_nulls_last(), code)) - 1
        groups[f"{f}_group"] = F.when(c.isNotNull(), F.least(F.floor(place * n_groups / F.count(c).over(section)), F.lit(n_groups - 1))).cast("int")
        made[f] = c
    return out.withColumns(groups).select(*[made[f].alias(f) if f in made else F.col(f"`{f}`") for f in df.columns], *[F.col(f"`{g}`") for g in groups])


def information_coefficients(df: DataFrame, factors: list[str], returns: list[str], time: str = "time") -> DataFrame:
    """Per date, <f>_<r>_ic (Pearson) and <f>_<r>_rank_ic (Pearson of average ranks over the complete pairs): one shuffle by date, one aggregation."""
    ranks, out = {}, []
    for f in factors:
        for r in returns:
            good = F.col(f"`{f}`").isNotNull() & F.col(f"`{r}`").isNotNull()
            for side in (f, r):
                w = W.partitionBy(time, good).orderBy(F.col(f"`{side}`"))
                ranks[f"__{f}|{r}|{side}"] = F.when(good, (F.rank().over(w) + F.count(F.lit(1)).over(w)) / 2)
            out.append(correlation(F.col(f"`{f}`"), F.col(f"`{r}`")).alias(f"{f}_{r}_ic"))
            out.append(correlation(F.col(f"`__{f}|{r}|{f}`"), F.col(f"`__{f}|{r}|{r}`")).alias(f"{f}_{r}_rank_ic"))
    return df.repartition(time).withColumns(ranks).groupBy(time).agg(*out)


def group_returns(df: DataFrame, factors: list[str], returns: list[str], n_groups: int, market_value: str, time: str = "time") -> DataFrame:
    """Per date, <f>_<r>_group<g>: returns weighed by market value. A weight counts even where its return is missing; NULL unless the weights sum to more than zero."""
    w, out = F.col(f"`{market_value}`").cast("double"), []
    for f in factors:
        for r in returns:
            for g in range(n_groups):
                inside = F.col(f"`{f}_group`") == g
                total = F.sum(F.when(inside, w))
                out.append(F.when(total > 0, F.sum(F.when(inside, w * F.col(f"`{r}`").cast("double"))) / total).alias(f"{f}_{r}_group{g}"))
    return df.groupBy(time).agg(*out)


class FactorResult:
    """Lazy results of an analysis."""

    def __init__(self, request: FactorRequest, data: DataFrame):
        self.request, self.processed = request, data

    @cached_property
    def information_coefficient(self) -> DataFrame:
        return information_coefficients(self.processed, self.request.factors, self.request.returns)

    @cached_property
    def group_returns(self) -> DataFrame:
        r = self.request
        return group_returns(self.processed, r.factors, r.returns, r.n_groups, r.market_value)


def analyze_factors(request: Any, long: DataFrame | None = None, panel: DataFrame | None = None, industries: DataFrame | None = None, other: str = "other") -> FactorResult:
    """Runs an analysis; industries (code, industry) is one row per code and is looked up by code, missing ones are `other`."""
    r = FactorRequest.parse(request)
    data = execute_query(r.query, long, panel, codes_query=r.codes_query).data
    if r.preprocess:
        if industries is None:
            raise RequestError("preprocessing needs industries")
        data = data.join(industries.select("code", "industry").dropDuplicates(["code"]), "code", "left").withColumn("industry", F.coalesce("industry", F.lit(other)))
        data = preprocess(data, r.factors, r.n_groups, r.market_value)
    return FactorResult(r, data)
