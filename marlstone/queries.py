"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

Series come from `events` (code: user, time: timestamp), sections from the first event of each user and day, factor inputs from the same. NULLs are put in by rule, so that they are met everywhere. Numbers are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import series_sql
from .query import execute_query

SPAN = {"start_date": "1900-01-01", "end_date": "2199-12-31", "codes": []}

# The same expressions serve Spark and DuckDB.
COLUMNS = {
    "x": "case when e % 7 = 0 then null else val end",
    "y": "case when e % 11 = 0 then null else val * 0.5 + e % 13 end",
    "z": "cast(e % 5 as double) - 2",
    "c": "val + 10",
    "h": "val + 11 + e % 3",
    "l": "val + 9 - e % 4",
    "o": "val + 10 - (e % 5) * 0.5",
    "v": "cast(100 + e % 17 as double)",
    "b": "case when e % 5 = 0 then null else e % 3 = 0 end",
    "b2": "case when e % 6 = 0 then null else e % 2 = 0 end",
    "g": "kind",
}


def series_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as series: the event of least id of each user and time."""
    first = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "ts").agg(F.min(F.struct("event_id", "value", "event_type")).alias("s"))
    rows = first.select(F.col("ts").cast("timestamp_ntz").alias("time"), F.col("user_id").cast("string").alias("code"), F.col("s.event_id").alias("e"), F.col("s.value").alias("val"), F.col("s.event_type").alias("kind"))
    return rows.select("time", "code", *[F.expr(x).alias(n) for n, x in COLUMNS.items()])


def section_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sections: the event of least id of each user and day."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    first = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", day.alias("time")).agg(F.min(F.struct("event_id", "value", "event_type")).alias("s"))
    rows = first.select("time", F.col("user_id").cast("string").alias("code"), F.col("s.event_id").alias("e"), F.col("s.value").alias("val"), F.col("s.event_type").alias("kind"))
    return rows.select("time", "code", *[F.expr(x).alias(n) for n, x in COLUMNS.items()])


_COLS = ", ".join(f"{x} as {n}" for n, x in COLUMNS.items())
SERIES_SQL = f"panel as (select time, code, e, {_COLS} from (select ts as time, user_id::varchar as code, event_id as e, value as val, event_type as kind from events qualify row_number() over (partition by user_id, ts order by event_id) = 1))"
SECTION_SQL = f"panel as (select time, code, e, {_COLS} from (select date_trunc('day', ts)::timestamp as time, user_id::varchar as code, event_id as e, value as val, event_type as kind from events qualify row_number() over (partition by user_id, date_trunc('day', ts) order by event_id) = 1))"

ROWS = {f"w{n}": n for n in (2, 3, 5, 8)}
WINDOWS = "window s as (partition by code order by time), p as (partition by code order by time rows between unbounded preceding and current row), " + ", ".join(f"{k} as (partition by code order by time rows between {n - 1} preceding and current row)" for k, n in ROWS.items())
SECTIONS = "window t as (partition by time), tg as (partition by time, g)"


def node(family: str, op: str, fields: dict, params: dict | None = None, on: Any = None) -> dict:
    out = {"type": family, "op": op, "fields": fields, "params": params or {}}
    return out if on is None else out | {"on": on}


def _case(op: str, fields: str | dict, sql: str, **params):
    return op, fields, sql, params


def _group(family: str, cases: list) -> tuple[dict, dict]:
    """(derivatives, SQL by output) of a list of cases. fields: operand names by blanks, in the operator's order."""
    from .plans.spec import load

    derivatives, sql = {}, {}
    for op, fields, text, params in cases:
        declared = load()[op].fields
        if isinstance(fields, str):
            names = fields.split()
            fields = {f.name: names if f.many else names[i] for i, f in enumerate(declared)}
        name = op.replace(".", "_")
        while name in derivatives:
            name += "_"
        derivatives[name] = node(family, op, fields, params)
        sql[name] = text
    return derivatives, sql


#: Added before rounding: sums of short decimals often end just on a half, where the last bit decides.
NUDGE = 1.23e-8


def _rounded(c):
    return F.round(c.cast("double") + NUDGE, 6) + 0.0


def _shaped(df: DataFrame, names: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    out = []
    for n in names:
        c = F.col(f"`{n}`")
        if kinds[n] in ("boolean", "string"):
            out.append(c.alias(n))
        else:
            out.append(_rounded(c).alias(n))
    return df.select("time", "code", *out)


def _register(name: str, panel: Callable, derivatives: dict, sql: dict, source: str, windows: str, plain: set = frozenset(), ctes: str = "", table: str = "panel", chunk_rows: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = execute_query(SPAN | {"derivatives": derivatives}, panel=panel(spark, sf_dir), chunk_rows=chunk_rows).data
        return _shaped(got, list(derivatives))

    QUERIES[name] = run
    if sql is not None:
        outputs = ", ".join(f"({x}) as {n}" if n in plain else f"round(({x})::double + {NUDGE}, 6) + 0.0 as {n}" for n, x in sql.items())
        SQL[name] = f"with {source}{ctes} select time, code, {outputs} from {table} {windows}"


QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

_both = lambda e: f"case when x is not null and y is not null then {e} end"
_bb = lambda e: f"case when b is not null and b2 is not null then {e} end"

DIRECT = {
    "direct_arithmetic": [
        _case("binary.add", "x y", "x + y"),
        _case("binary.sub", "x y", "x - y"),
        _case("binary.mul", "x y", "x * y"),
        _case("binary.div", "x z", "case when z <> 0 then x / z end"),
        _case("binary.floor_div", "x z", "case when z <> 0 then floor(x / z) end"),
        _case("binary.mod", "x z", "case when z <> 0 then x - floor(x / z) * z end"),
        _case("binary.pow", {"left": "c", "right": 1.5}, "case when c >= 0 then pow(c, 1.5) end"),
        _case("binary.maximum", "x y", _both("greatest(x, y)")),
        _case("binary.minimum", "x y", _both("least(x, y)")),
        _case("binary.null_if", "z v", "nullif(z, v)"),
    ],
    "direct_comparison": [
        _case("binary.eq", "x y", "x = y"),
        _case("binary.ne", "x y", "x <> y"),
        _case("binary.ge", "x y", "x >= y"),
        _case("binary.gt", "x y", "x > y"),
        _case("binary.le", "x y", "x <= y"),
        _case("binary.lt", "x y", "x < y"),
        _case("unary.between", "x", "coalesce(x >= 20 and x < 60, false)", lower=20.0, upper=60.0, inclusive="left"),
        _case("unary.isin", "z", "coalesce(z in (-2, 1), false)", values=[-2.0, 1.0]),
        _case("unary.is_null", "x", "x is null"),
        _case("unary.not_null", "x", "x is not null"),
        _case("unary.is_finite", "x", "coalesce(isfinite(x), false)"),
    ],
    "direct_logic": [
        _case("binary.and", "b b2", _bb("b and b2")),
        _case("binary.or", "b b2", _bb("b or b2")),
        _case("binary.xor", "b b2", "b <> b2"),
        _case("multiary.and", "b b2", _bb("b and b2")),
        _case("multiary.or", "b b2", _bb("b or b2")),
        _case("unary.not", "b", "not b"),
        _case("nullary.true", "", "true"),
        _case("nullary.false", "", "false"),
        _case("unary.is_weekend", "time", "isodow(time) >= 6"),
        _case("unary.is_month_end", "time", "last_day(time) = time::date"),
        _case("unary.is_quarter_end", "time", "last_day(time) = time::date and month(time) % 3 = 0"),
        _case("unary.is_year_end", "time", "month(time) = 12 and day(time) = 31"),
    ],
    "direct_rows": [
        _case("multiary.add", "x y", "case when x is not null or y is not null then coalesce(x, 0) + coalesce(y, 0) end"),
        _case("multiary.mul", "x y", "case when x is not null or y is not null then coalesce(x, 1) * coalesce(y, 1) end"),
        _case("multiary.coalesce", "x y c", "coalesce(x, y, c)"),
        _case("multiary.count", "x y c", "(x is not null)::int + (y is not null)::int + 1"),
        _case("multiary.max", "x y", "greatest(x, y)"),
        _case("multiary.min", "x y", "least(x, y)"),
        _case("multiary.mean", "x y c", "list_avg([x, y, c])"),
        _case("multiary.var", "x y c", "list_var_samp([x, y, c])"),
        _case("multiary.std", "x y c", "list_stddev_pop([x, y, c])", ddof=0),
        _case("ternary.where", "b x y", "case when b then x when not b then y end"),
    ],
    "direct_functions": [
        _case("unary.abs", "z", "abs(z)"),
        _case("unary.acos", "z", "case when abs(z) <= 1 then acos(z) end"),
        _case("unary.asin", "z", "case when abs(z) <= 1 then asin(z) end"),
        _case("unary.atan", "x", "atan(x)"),
        _case("unary.ceil", "x", "ceil(x)"),
        _case("unary.cos", "x", "cos(x)"),
        _case("unary.exp", "z", "exp(z)"),
        _case("unary.expm1", "z", "exp(z) - 1"),
        _case("unary.floor", "x", "floor(x)"),
        _case("unary.log", "z", "case when z > 0 then ln(z) end"),
        _case("unary.log10", "z", "case when z > 0 then log10(z) end"),
        _case("unary.log1p", "z", "case when z > -1 then ln(1 + z) end"),
        _case("unary.log2", "z", "case when z > 0 then log2(z) end"),
        _case("unary.neg", "x", "-x"),
        _case("unary.round", "x", "round(x, 1)", precision=1),
        _case("unary.sign", "z", "sign(z)"),
        _case("unary.sin", "x", "sin(x)"),
        _case("unary.sqrt", "z", "case when z >= 0 then sqrt(z) end"),
        _case("unary.tan", "z", "tan(z)"),
        _case("unary.clip", "x", "case when x < 20 then 20 when x > 60 then 60 else x end", lower=20.0, upper=60.0),
        _case("unary.get", "x", "x"),
        _case("unary.replace", "z", "case when z = -2 or z = 0 then 9 else z end", old=[-2.0, 0.0], new=[0.0, 9.0]),
    ],
    "direct_calendar": [
        _case("unary.day", "time", "day(time)"),
        _case("unary.day_of_year", "time", "dayofyear(time)"),
        _case("unary.month", "time", "month(time)"),
        _case("unary.quarter", "time", "quarter(time)"),
        _case("unary.week", "time", "weekofyear(time)"),
        _case("unary.weekday", "time", "isodow(time) - 1"),
        _case("unary.year", "time", "year(time)"),
        _case("unary.cast", "x", "round(x)", dtype="long"),
        _case("binary.days_between", {"left": "time", "right": node("DIRECT", "nullary.literal", {}, {"value": "2024-02-29", "dtype": "date"})}, "date_diff('day', date '2024-02-29', time::date)"),
        _case("nullary.literal", "", "2.5", value=2.5, dtype="double"),
    ],
}
_PLAIN = {"direct_comparison", "direct_logic"}
for _name, _cases in DIRECT.items():
    _d, _s = _group("DIRECT", _cases)
    _register(_name, series_panel, _d, _s, SERIES_SQL, "", set(_s) if _name in _PLAIN else set())

_AGG = {
    "mean": "avg(x) over {w}",
    "sum": "sum(x) over {w}",
    "min": "min(x) over {w}",
    "max": "max(x) over {w}",
    "count": "count(x) over {w}",
    "std": "stddev_samp(x) over {w}",
    "var": "var_samp(x) over {w}",
    "sem": "stddev_samp(x) over {w} / sqrt(count(x) over {w})",
    "median": "quantile_cont(x, 0.5) over {w}",
}
_least = lambda w, n, e, c="x": f"case when count({c}) over {w} >= {n} then {e.format(w=w)} end"
_m2 = "(avg(x * x) over {w} - (avg(x) over {w}) * (avg(x) over {w}))"
TS = {
    "ts_rolling": [_case(f"unary.rolling_{k}", "x", _least("w5", 2, e), window=5, min_periods=2) for k, e in _AGG.items()]
    + [
        _case("unary.rolling_mean", "x", _least("w3", 3, _AGG["mean"]), window=3),
        _case("unary.rolling_quantile", "x", _least("w5", 2, "quantile_cont(x, 0.25) over {w}"), window=5, min_periods=2, q=0.25),
        _case("unary.rolling_first", "x", _least("w5", 2, "first_value(x) over {w}"), window=5, min_periods=2),
        _case("unary.rolling_last", "x", _least("w5", 2, "x"), window=5, min_periods=2),
        _case("unary.rolling_zscore", "x", _least("w5", 2, "(x - avg(x) over {w}) / nullif(stddev_samp(x) over {w}, 0)"), window=5, min_periods=2),
    ],
    "ts_rolling_shape": [
        _case("unary.rolling_prod", "x", _least("w3", 1, "product(x) over {w}"), window=3, min_periods=1),
        _case("unary.rolling_kurt", "x", _least("w8", 3, "kurtosis_pop(x) over {w} + 3"), window=8, min_periods=3),
        _case("unary.rolling_mad", "x", _least("w5", 2, "mad(x) over {w}"), window=5, min_periods=2),
        _case("unary.rolling_argmax", "x", "list_position(list(x) over w5, max(x) over w5) - 1 + case when count(x) over w5 >= 2 then 0 end", window=5, min_periods=2),
        _case("unary.rolling_argmin", "x", "list_position(list(x) over w5, min(x) over w5) - 1 + case when count(x) over w5 >= 2 then 0 end", window=5, min_periods=2),
        _case("unary.rolling_rank", "x", "case when x is not null and count(x) over w5 >= 2 then len(list_filter(list(x) over w5, lambda q: q < x)) + 1 end", window=5, min_periods=2),
        _case("unary.rolling_rank_pct", "x", "case when x is not null and count(x) over w5 >= 2 then len(list_filter(list(x) over w5, lambda q: q >= x)) / count(x) over w5 end", window=5, min_periods=2, ascending=False, ties_method="max"),
        _case("unary.decay_linear", "c", "case when count(*) over w3 = 3 then (3 * c + 2 * lag(c) over s + lag(c, 2) over s) / 6 end", window=3, min_periods=1),
    ],
    "ts_expanding": [_case(f"unary.cum_{k}", "x", _least("p", 2, _AGG[k]), min_periods=2) for k in ("count", "max", "mean", "min", "sum")]
    + [_case("unary.cum_prod", {"col": node("DIRECT", "binary.add", {"left": node("DIRECT", "binary.div", {"left": "x", "right": 1e6}), "right": 1.0})}, "product(x / 1e6 + 1) over p")]
    + [_case(f"unary.expanding_{k}", "x", _least("p", 2, _AGG[k]), min_periods=2) for k in ("std", "var", "sem", "median")]
    + [_case("unary.expanding_quantile", "x", _least("p", 2, "quantile_cont(x, 0.9) over {w}"), min_periods=2, q=0.9)],
    "ts_moves": [
        _case("unary.diff", "x", "x - lag(x, 2) over s", periods=2),
        _case("unary.pct_change", "x", "x / nullif(lag(x) over s, 0) - 1"),
        _case("unary.log_return", "c", "case when c > 0 and lag(c) over s > 0 then ln(c) - ln(lag(c) over s) end"),
        _case("unary.shift", "x", "lead(x) over s", periods=-1),
        _case("unary.ffill", "x", "last_value(x ignore nulls) over w2", limit=1),
        _case("unary.bfill", "x", "first_value(x ignore nulls) over (partition by code order by time rows between current row and unbounded following)"),
        _case("talib.mom", "c", "c - lag(c, 3) over s", time_period=3),
        _case("talib.roc", "c", "100 * (c / nullif(lag(c, 3) over s, 0) - 1)", time_period=3),
        _case("talib.rocp", "c", "c / nullif(lag(c, 3) over s, 0) - 1", time_period=3),
        _case("talib.rocr", "c", "c / nullif(lag(c, 3) over s, 0)", time_period=3),
        _case("talib.rocr100", "c", "100 * c / nullif(lag(c, 3) over s, 0)", time_period=3),
    ],
    "ts_pairs": [
        _case("binary.rolling_beta", "y x", _least("w8", 4, "regr_slope(x, y) over {w}", "x + y"), window=8, min_periods=4),
        _case("binary.rolling_alpha", "y x", _least("w8", 4, "regr_intercept(x, y) over {w}", "x + y"), window=8, min_periods=4),
        _case("binary.rolling_residual", "y x", _least("w8", 4, "x - regr_intercept(x, y) over {w} - regr_slope(x, y) over {w} * y", "x + y"), window=8, min_periods=4),
        _case("binary.rolling_corr", "y x", _least("w8", 4, "corr(x, y) over {w}", "x + y"), window=8, min_periods=4),
        _case("binary.rolling_cov", "y x", _least("w8", 4, "covar_samp(x, y) over {w}", "x + y"), window=8, min_periods=4),
        _case("binary.expanding_beta", "y x", _least("p", 4, "regr_slope(x, y) over {w}", "x + y"), min_periods=4),
        _case("binary.expanding_corr", "y x", _least("p", 4, "corr(x, y) over {w}", "x + y"), min_periods=4),
        _case("binary.expanding_cov", "y x", _least("p", 4, "covar_samp(x, y) over {w}", "x + y"), min_periods=4),
        _case("talib.correl", "h l", "case when count(*) over w5 = 5 then corr(h, l) over w5 end", time_period=5),
    ],
    "ts_flags": [
        _case("binary.cross_above", "x y", "coalesce(x > y and lag(x) over s <= lag(y) over s, false)"),
        _case("binary.cross_below", "x y", "coalesce(x < y and lag(x) over s >= lag(y) over s, false)"),
        _case("unary.changed", "b", "case when row_number() over s = 1 then true when b is null and lag(b) over s is null then true else b is distinct from lag(b) over s end"),
        _case("unary.rolling_all", "b", "coalesce(count(b) over w3 >= 2 and count(*) filter (b) over w3 = count(b) over w3, false)", window=3, min_periods=2),
        _case("unary.rolling_any", "b", "coalesce(count(b) over w3 >= 2 and count(*) filter (b) over w3 > 0, false)", window=3, min_periods=2),
    ],
    "ts_counts": [
        _case("unary.rolling_true_count", "b", "case when count(*) over w3 >= 2 then count(*) filter (b) over w3 end", window=3, min_periods=2),
        _case("unary.bars_since", "b", "row_number() over s - last_value(case when b then rn end ignore nulls) over p"),
        _case("unary.consecutive_count", "b", "count(*) filter (b) over (partition by code, isle order by time rows between unbounded preceding and current row)"),
    ],
    "ts_bars": [
        _case("talib.avgPrice", "o h l c", "(o + h + l + c) / 4"),
        _case("talib.medPrice", "h l", "(h + l) / 2"),
        _case("talib.typPrice", "h l c", "(h + l + c) / 3"),
        _case("talib.wclPrice", "h l c", "(h + l + 2 * c) / 4"),
        _case("talib.bop", "o h l c", "(c - o) / nullif(h - l, 0)"),
        _case("talib.trange", "h l c", "greatest(h, lag(c) over s) - least(l, lag(c) over s) + lag(c) over s * 0"),
        _case("talib.ad", "h l c v", "sum(coalesce(((c - l) - (h - c)) / nullif(h - l, 0) * v, 0)) over p"),
        _case("talib.sma", "c", "case when count(*) over w5 = 5 then avg(c) over w5 end", time_period=5),
        _case("talib.wma", "c", "case when count(*) over w3 = 3 then (3 * c + 2 * lag(c) over s + lag(c, 2) over s) / 6 end", time_period=3),
        _case("talib.trima", "c", "case when count(*) over w3 = 3 then (c + 2 * lag(c) over s + lag(c, 2) over s) / 4 end", time_period=3),
        _case("talib.stddev", "c", "case when count(*) over w5 = 5 then 2 * stddev_pop(c) over w5 end", time_period=5, nbdev=2.0),
        _case("talib.var", "c", "case when count(*) over w5 = 5 then var_pop(c) over w5 end", time_period=5),
        _case("talib.midPoint", "c", "case when count(*) over w5 = 5 then (max(c) over w5 + min(c) over w5) / 2 end", time_period=5),
        _case("talib.midPrice", "h l", "case when count(*) over w5 = 5 then (max(h) over w5 + min(l) over w5) / 2 end", time_period=5),
        _case("talib.willr", "h l c", "case when count(*) over w5 = 5 then -100 * (max(h) over w5 - c) / (max(h) over w5 - min(l) over w5) end", time_period=5),
    ],
    "ts_lines": [
        _case("talib.linearreg", "c", "case when count(*) over w5 = 5 then regr_intercept(c, rn) over w5 + regr_slope(c, rn) over w5 * rn end", time_period=5),
        _case("talib.linearreg_slope", "c", "case when count(*) over w5 = 5 then regr_slope(c, rn) over w5 end", time_period=5),
        _case("talib.linearreg_intercept", "c", "case when count(*) over w5 = 5 then regr_intercept(c, rn) over w5 + regr_slope(c, rn) over w5 * (rn - 4) end", time_period=5),
        _case("talib.linearreg_angle", "c", "case when count(*) over w5 = 5 then degrees(atan(regr_slope(c, rn) over w5)) end", time_period=5),
        _case("talib.tsf", "c", "case when count(*) over w5 = 5 then regr_intercept(c, rn) over w5 + regr_slope(c, rn) over w5 * (rn + 1) end", time_period=5),
        _case("talib.aroon", "h l", "case when count(*) over w5 = 5 then 100 * (4 - (5 - len(h5) + list_position(list_reverse(h5), list_max(h5)) - 1)) / 4 end", time_period=4, output="up"),
        _case("talib.aroonOsc", "h l", "case when count(*) over w5 = 5 then 100 * (list_position(list_reverse(l5), list_min(l5)) - list_position(list_reverse(h5), list_max(h5))) / 4 end", time_period=4),
        _case("talib.cci", "h l c", "case when count(*) over w5 = 5 then (tp - list_avg(tp5)) / (0.015 * list_avg(list_transform(tp5, lambda q: abs(q - list_avg(tp5))))) end", time_period=5),
        _case("talib.beta", "h l", "case when count(rh + rl) over w5 = 5 then regr_slope(rl, rh) over w5 end", time_period=5),
        _case("talib.mfi", "h l c v", "case when count(tp - ptp) over w5 = 5 then 100 * sum(case when tp > ptp then tp * v else 0 end) over w5 / nullif(sum(case when tp <> ptp then tp * v else 0 end) over w5, 0) end", time_period=5),
        _case("talib.ultOsc", "h l c", "case when count(tr) over w8 = 8 then 100 * (4 * sum(bp) over w3 / sum(tr) over w3 + 2 * sum(bp) over w5 / sum(tr) over w5 + sum(bp) over w8 / sum(tr) over w8) / 7 end", period1=3, period2=5, period3=8),
    ],
}
_MORE = ", more as (select *, row_number() over (partition by code order by time) as rn, sum(case when not b then 1 else 0 end) over (partition by code order by time rows between unbounded preceding and current row) as isle, (h + l + c) / 3 as tp, lag((h + l + c) / 3) over (partition by code order by time) as ptp, h / nullif(lag(h) over (partition by code order by time), 0) - 1 as rh, l / nullif(lag(l) over (partition by code order by time), 0) - 1 as rl, c - least(l, lag(c) over (partition by code order by time)) + 0 * lag(c) over (partition by code order by time) as bp, greatest(h, lag(c) over (partition by code order by time)) - least(l, lag(c) over (partition by code order by time)) + 0 * lag(c) over (partition by code order by time) as tr, list(h) over v5 as h5, list(l) over v5 as l5, list((h + l + c) / 3) over v5 as tp5 from panel window v5 as (partition by code order by time rows between 4 preceding and current row))"
for _name, _cases in TS.items():
    _d, _s = _group("TS", _cases)
    _wide = _name in ("ts_counts", "ts_lines")
    _register(_name, series_panel, _d, _s, SERIES_SQL, WINDOWS, set(_s) if _name == "ts_flags" else set(), _MORE if _wide else "", "more" if _wide else "panel")

_rk = lambda part, extra="": f"case when x is not null then {{}} over (partition by {part}, x is null order by x{extra}) end"
CS = {
    "cs_reductions": [
        _case("unary.count", "x", "count(x) over t"),
        _case("unary.max", "x", "max(x) over t"),
        _case("unary.mean", "x", "avg(x) over t"),
        _case("unary.median", "x", "quantile_cont(x, 0.5) over t"),
        _case("unary.min", "x", "min(x) over t"),
        _case("unary.sum", "x", "sum(x) over t"),
        _case("unary.std", "x", "stddev_samp(x) over t"),
        _case("unary.var", "x", "var_pop(x) over t", ddof=0),
        _case("unary.quantile", "x", "quantile_cont(x, 0.2) over t", q=0.2),
        _case("unary.mad", "x", "mad(x) over t"),
        _case("unary.kurt", "x", "case when var_pop(x) over t > 0 then kurtosis_pop(x) over t + 3 end"),
    ],
    "cs_scaling": [
        _case("unary.demean", "x", "x - avg(x) over t"),
        _case("unary.zscore", "x", "(x - avg(x) over t) / nullif(stddev_samp(x) over t, 0)"),
        _case("unary.normalize_sum", "x", "x / nullif(sum(x) over t, 0)"),
        _case("unary.normalize_l1", "x", "x / nullif(sum(abs(x)) over t, 0)"),
        _case("unary.normalize_l2", "x", "x / nullif(sqrt(sum(x * x) over t), 0)"),
        _case("unary.robust_zscore", "x", "(x - quantile_cont(x, 0.5) over t) / nullif(1.4826 * mad(x) over t, 0)"),
        _case("unary.winsorize", "x", "case when x is not null then greatest(quantile_cont(x, 0.1) over t, least(quantile_cont(x, 0.9) over t, x)) end", lower=0.1, upper=0.9),
        _case("unary.winsorize_mad", "x", "case when x is not null then greatest(quantile_cont(x, 0.5) over t - 1.4826 * mad(x) over t, least(quantile_cont(x, 0.5) over t + 1.4826 * mad(x) over t, x)) end", n=1.0),
        _case("grouped.mean", "x g", "avg(x) over tg"),
        _case("grouped.demean", "x g", "x - avg(x) over tg"),
        _case("grouped.zscore", "x g", "(x - avg(x) over tg) / nullif(stddev_samp(x) over tg, 0)"),
    ],
    "cs_ranks": [
        _case("unary.rank", "x", "case when x is not null then rank() over (partition by time, x is null order by x desc) end", ascending=False),
        _case("unary.rank_dense", "x", "case when x is not null then dense_rank() over (partition by time, x is null order by x) end"),
        _case("unary.rank_pct", "x", "case when x is not null then rank() over (partition by time, x is null order by x) / count(x) over t end"),
        _case("unary.qcut", "x", "case when x is not null then floor((rank() over (partition by time, x is null order by x) - 1) * 4 / count(x) over t) end", q=4),
        _case("grouped.rank_pct", "x g", "case when x is not null then rank() over (partition by time, g, x is null order by x) / count(x) over tg end"),
    ],
    "cs_flags": [
        _case("unary.top_n", "x", "coalesce(x is not null and row_number() over (partition by time order by x desc nulls last, code) <= 5, false)", n=5),
        _case("unary.bottom_n", "x", "coalesce(x is not null and row_number() over (partition by time order by x nulls last, code) <= 5, false)", n=5),
        _case("unary.top_pct", "x", "coalesce(x is not null and row_number() over (partition by time order by x desc nulls last, code) <= ceil(count(x) over t * 0.3::double), false)", pct=0.3),
        _case("unary.bottom_pct", "x", "coalesce(x is not null and row_number() over (partition by time order by x nulls last, code) <= ceil(count(x) over t * 0.3::double), false)", pct=0.3),
    ],
    "cs_pairs": [
        _case("binary.corr", "y x", "case when not isnan(corr(x, y) over t) then corr(x, y) over t end"),
        _case("binary.cov", "y x", "covar_samp(x, y) over t"),
        _case("binary.beta", "y x", "regr_slope(x, y) over t"),
        _case("binary.alpha", "y x", "regr_intercept(x, y) over t"),
        _case("binary.residual", "y x", "x - regr_intercept(x, y) over t - regr_slope(x, y) over t * y"),
        _case("binary.rank_corr", "y x", "corr(rx, ry) over t"),
    ],
}
_RANKED = ", more as (select *, case when x is not null and y is not null then rank() over (partition by time, x is null or y is null order by x) end as rx, case when x is not null and y is not null then rank() over (partition by time, x is null or y is null order by y) end as ry from panel)"
for _name, _cases in CS.items():
    _d, _s = _group("CS", _cases)
    _register(_name, section_panel, _d, _s, SECTION_SQL, SECTIONS, set(_s) if _name == "cs_flags" else set(), _RANKED if _name == "cs_pairs" else "", "more" if _name == "cs_pairs" else "panel")


# Shapes from moments, where the other engine's function corrects for bias.
def _skew(x: str, w: str) -> str:
    mean, square, cube = f"avg({x}) over {w}", f"avg({x} * {x}) over {w}", f"avg({x} * {x} * {x}) over {w}"
    return f"({cube} - 3 * ({mean}) * ({square}) + 2 * pow({mean}, 3)) / nullif(pow({square} - pow({mean}, 2), 1.5), 0)"


_register("cs_skew", section_panel, *_group("CS", [_case("unary.skew", "x", f"case when count(x) over t > 2 then {_skew('x', 't')} when count(x) over t = 2 then 0 end")]), SECTION_SQL, SECTIONS)
_register("ts_rolling_skew", series_panel, *_group("TS", [_case("unary.rolling_skew", "x", _least("w8", 3, _skew("x", "{w}")), window=8, min_periods=3)]), SERIES_SQL, WINDOWS)

# Masks: the section or series of the rows where a BOOL holds.
_ON = {"on": node("DIRECT", "unary.cast", {"col": "b"}, {"dtype": "bool"})}
_register(
    "masked",
    series_panel,
    {"mean": node("TS", "unary.rolling_mean", {"col": "c"}, {"window": 3, "min_periods": 2}) | _ON, "before": node("TS", "unary.shift", {"col": "c"}, {"periods": 1}) | _ON, "total": node("TS", "unary.cum_sum", {"col": "x"}) | _ON},
    {"mean": "case when b then case when count(c) over m3 >= 2 then avg(c) over m3 end end", "before": "case when b then lag(c) over m end", "total": "case when b then sum(x) over mp end"},
    SERIES_SQL,
    "window m as (partition by code, coalesce(b, false) order by time), m3 as (partition by code, coalesce(b, false) order by time rows between 2 preceding and current row), mp as (partition by code, coalesce(b, false) order by time rows between unbounded preceding and current row)",
)

# The flagship: momentum times volume ratio, and volatility, over one series layout.
FLAGSHIP = {
    "return_1": node("TS", "unary.pct_change", {"col": "c"}, {"periods": 1}),
    "momentum": node("TS", "unary.pct_change", {"col": "c"}, {"periods": 8}),
    "volume_short": node("TS", "unary.rolling_mean", {"col": "v"}, {"window": 3, "min_periods": 3}),
    "volume_long": node("TS", "unary.rolling_mean", {"col": "v"}, {"window": 8, "min_periods": 8}),
    "volume_ratio": node("DIRECT", "binary.div", {"left": "volume_short", "right": "volume_long"}),
    "signal": node("DIRECT", "binary.mul", {"left": "momentum", "right": "volume_ratio"}),
    "volatility": node("TS", "unary.rolling_std", {"col": "return_1"}, {"window": 8, "min_periods": 8}),
}
_register(
    "flagship",
    series_panel,
    FLAGSHIP,
    {
        "return_1": "r",
        "momentum": "m",
        "volume_short": "v3",
        "volume_long": "v8",
        "volume_ratio": "v3 / v8",
        "signal": "m * v3 / v8",
        "volatility": "case when count(r) over w8 >= 8 then stddev_samp(r) over w8 end",
    },
    SERIES_SQL,
    WINDOWS,
    ctes=", more as (select *, c / nullif(lag(c) over s, 0) - 1 as r, c / nullif(lag(c, 8) over s, 0) - 1 as m, case when count(v) over w3 = 3 then avg(v) over w3 end as v3, case when count(v) over w8 = 8 then avg(v) over w8 end as v8 from panel " + WINDOWS + ")",
    table="more",
)

# Series first, then sections of what they gave, then series again: three layers, a shuffle each.
_register(
    "layers",
    section_panel,
    {
        "fast": node("TS", "unary.rolling_mean", {"col": "c"}, {"window": 3, "min_periods": 1}),
        "place": node("CS", "unary.rank_pct", {"col": "fast"}),
        "drift": node("TS", "unary.diff", {"col": "place"}, {"periods": 1}),
        "good": node("DIRECT", "binary.gt", {"left": "drift", "right": 0}),
    },
    {"fast": "fast", "place": "place", "drift": "place - lag(place) over s", "good": "case when place - lag(place) over s > 0 then true when place - lag(place) over s <= 0 then false end"},
    SECTION_SQL,
    WINDOWS,
    {"good"},
    ctes=", f as (select *, avg(c) over w3 as fast from panel " + WINDOWS + "), more as (select *, rank() over (partition by time order by fast) / count(*) over (partition by time) as place from f)",
    table="more",
)


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter over a derived flag; NULL is false."""
    d = {"rise": node("TS", "unary.pct_change", {"col": "x"}, {"periods": 1}), "up": node("DIRECT", "binary.gt", {"left": "rise", "right": 0})}
    return _shaped(execute_query(SPAN | {"factors": ["x"], "derivatives": d, "filters": ["up"]}, panel=series_panel(spark, sf_dir)).data, ["x", "rise", "up"])


QUERIES["filtered"] = filtered
SQL["filtered"] = f"with {SERIES_SQL}, r as (select time, code, x, x / nullif(lag(x) over (partition by code order by time), 0) - 1 as rise from panel) select time, code, round(x + {NUDGE}, 6) + 0.0 as x, round(rise + {NUDGE}, 6) + 0.0 as rise, true as up from r where rise > 0"

# Recursive ones are folds over a code's list of values.
for _name, _cases, (_ctes, _table) in (
    (
        "ts_recursive_averages",
        [_case(f"talib.{k}", "c", k, time_period=5) for k in ("ema", "dema", "tema", "kama", "t3", "rsi", "trix")]
        + [_case("talib.ma", "c", "ma", time_period=5, ma_type=2), _case("talib.apo", "c", "apo", fast_period=3, slow_period=6), _case("talib.ppo", "c", "ppo", fast_period=3, slow_period=6), _case("talib.macd", "c", "macd", fast_period=3, slow_period=6, signal_period=3), _case("talib.bBands", "c", "bBands", time_period=5, output="upper")],
        series_sql.averages(5, 3, 6, 3, 0.7),
    ),
    ("ts_recursive_ranges", [_case(f"talib.{k}", "h l c", k, time_period=5) for k in ("atr", "natr", "adx", "adxr", "dx", "plus_di", "minus_di")] + [_case(f"talib.{k}", "h l", k, time_period=5) for k in ("plus_dm", "minus_dm")] + [_case("talib.obv", "c v", "obv")], series_sql.ranges(5)),
    ("ts_weighted", [_case(f"unary.ewm_{k}", "x", f"ewm_{k}", span=5.0) for k in ("mean", "std", "var")] + [_case(f"binary.ewm_{k}", "x y", f"ewm_{k}", alpha=0.3) for k in ("cov", "corr")], series_sql.weighted(5.0, 0.3)),
):
    _register(_name, series_panel, *_group("TS", _cases), SERIES_SQL, "", ctes=_ctes, table=_table)
_d, _s = _group("TS", [_case("unary.expanding_rank", "x", "case when x is not null then len(list_filter(list(x) over p, lambda q: q < x)) + 1 end"), _case("unary.expanding_rank_pct", "x", "case when x is not null then len(list_filter(list(x) over p, lambda q: q <= x)) / count(x) over p end", ties_method="max")])
_register("ts_expanding_ranks", series_panel, _d, _s, SERIES_SQL, WINDOWS)
_register(
    "cs_neutral",
    section_panel,
    {"by_group": node("CS", "controls.neutralize_by", {"target": "x", "controls": ["g"]}, {"intercept": True}), "by_number": node("CS", "controls.neutralize_by", {"target": "x", "controls": ["v"]}, {"intercept": True}), "score": node("CS", "unary.rank_normal", {"col": "x"})},
    {
        "by_group": "case when count(x) over t <= len(list_distinct(list(g) filter (x is not null) over t)) then x - avg(x) over t else x - avg(x) over tg end",
        "by_number": "case when count(x) over t <= 2 or var_pop(case when x is not null then v end) over t = 0 then x - avg(x) over t else x - regr_intercept(x, v) over t - regr_slope(x, v) over t * v end",
        "score": series_sql.inverse_normal("((rank() over (partition by time, x is null order by x) + (count(*) over (partition by time, x) - 1) / 2.0 - 0.5) / count(x) over t)").join(["case when x is not null then ", " end"]),
    },
    SECTION_SQL,
    SECTIONS,
)

#: Rows of a chunk where series and sections are dealt in pieces; the results are those of whole ones.
CHUNK_ROWS = 500_000
_LONG = [c for k in ("ts_rolling", "ts_pairs", "ts_expanding") for c in TS[k] if not c[0].startswith(("unary.rolling_first", "unary.rolling_last", "unary.expanding_median", "unary.expanding_quantile", "talib."))]
_register("long_series", series_panel, *_group("TS", _LONG + TS["ts_moves"][:3]), SERIES_SQL, WINDOWS, chunk_rows=CHUNK_ROWS)
_ctes, _table = series_sql.weighted(5.0, 0.3)
_register("long_series_weighted", series_panel, *_group("TS", [_case(f"unary.ewm_{k}", "x", f"ewm_{k}", span=5.0) for k in ("mean", "std", "var")] + [_case(f"binary.ewm_{k}", "x y", f"ewm_{k}", alpha=0.3) for k in ("cov", "corr")]), SERIES_SQL, "", ctes=_ctes, table=_table, chunk_rows=CHUNK_ROWS)
for _name, _kinds in (("wide_values", ("cs_reductions", "cs_scaling")), ("wide_ranks", ("cs_ranks", "cs_flags"))):
    _d, _s = _group("CS", [c for k in _kinds for c in CS[k]])
    _register(_name, section_panel, _d, _s, SECTION_SQL, SECTIONS, {n for n in _s if "top_" in n or "bottom_" in n}, chunk_rows=CHUNK_ROWS)
