"""Requests, operators and compilation: worked examples, NULL rules, masks and plans."""

import datetime as dt
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from marlstone import queries as Q
from marlstone.functions.normal import inverse_normal
from marlstone.plans.request import Query, parse_node
from marlstone.plans.spec import RequestError, load
from marlstone.query import execute_query

N = None
SPAN = {"start_date": "2024-01-01", "end_date": "2024-12-31", "codes": []}


def ts(op, fields, on=None, **params):
    out = {"type": "TS", "op": op, "fields": fields if isinstance(fields, dict) and "op" not in fields else {"col": fields}, "params": params}
    return out | {"on": on} if on is not None else out


def cs(op, fields, on=None, **params):
    return ts(op, fields, on, **params) | {"type": "CS"}


def direct(op, fields, **params):
    return ts(op, fields, **params) | {"type": "DIRECT"}


def panel(spark, columns, by="series"):
    """One code (series) or one time (section) with the given columns."""
    n = len(next(iter(columns.values())))
    kind = lambda v: next(("boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "double" for x in v if x is not None), "double")
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(i if by == "series" else 0), "a" if by == "series" else f"k{i:03d}", *[float(v[i]) if kind(v) == "double" and v[i] is not None else v[i] for v in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "time timestamp_ntz, code string, " + ", ".join(f"`{c}` {kind(v)}" for c, v in columns.items()))


def run(df, **derivatives):
    rows = execute_query(SPAN | {"derivatives": derivatives}, panel=df).data.orderBy("time", "code").collect()
    return {k: [r[k] for r in rows] for k in derivatives}


def same(got, want, digits=2e-5):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        if w is None or isinstance(w, bool):
            assert g is w, (got, want)
        else:
            assert g is not None and abs(g - w) <= digits * max(1e-3, abs(w)), (got, want)


# Printed results of worked examples, for series S, P, R, G, B, pairs L and Q, sections X, O, Y, Z and bars K.
SERIES = {
    "S": [1, 2, 4, 3, 5, 7, 6, 8],
    "R": [1, 2, 2, 3, 2, 4, 4, 5],
    "L": [1.0, 2.5, 2.0, 4.0, 3.5, 5.0, 4.5, 6.0],
    "Q": [1.5, 2.0, 2.5, 3.0, 4.0, 4.5, 5.0, 5.5],
    "B": [False, True, True, False, True, True, True, False],
    "G": [1, N, N, 4, N, 6, N, N],
}
EXAMPLES = [
    (ts("unary.rolling_mean", "S", window=3), [N, N, 2.33333, 3, 4, 5, 6, 7]),
    (ts("unary.rolling_mean", "S", window=4, min_periods=2), [N, 1.5, 2.33333, 2.5, 3.5, 4.75, 5.25, 6.5]),
    (ts("unary.rolling_kurt", "S", window=4, min_periods=2), [N, N, 1.5, 1.64, 1.64, 1.84571, 1.84571, 1.64]),
    (ts("unary.rolling_argmax", "S", window=4, min_periods=2), [N, 1, 2, 2, 3, 3, 2, 3]),
    (ts("unary.rolling_rank", "R", window=3, min_periods=2), [N, 2, 2, 3, 1, 3, 2, 3]),
    (ts("unary.rolling_rank", "R", window=3, min_periods=2, ties_method="average"), [N, 2, 2.5, 3, 1.5, 3, 2.5, 3]),
    (ts("unary.rolling_rank", "R", window=3, min_periods=2, ascending=False), [N, 1, 1, 1, 2, 1, 1, 1]),
    (ts("unary.ffill", "G", limit=1), [1, 1, N, 4, 4, 6, 6, N]),
    (ts("unary.bfill", "G", limit=1), [1, N, 4, 4, 6, 6, N, N]),
    (ts("unary.rolling_all", "B", window=3), [False, False, False, False, False, False, True, False]),
    (ts("unary.ewm_mean", "S", com=1.0), [1, 1.66667, 3, 3, 4.03226, 5.53968, 5.77165, 6.8902]),
    (ts("unary.ewm_mean", "S", half_life=2.0), [1, 1.58579, 2.67962, 2.80474, 3.58579, 4.72864, 5.13712, 6.03154]),
    (ts("unary.ewm_mean", "S", span=3.0, adjust=False), [1, 1.5, 2.75, 2.875, 3.9375, 5.46875, 5.73438, 6.86719]),
    (ts("binary.cross_above", {"left": "L", "right": "Q"}), [False, True, False, True, False, True, False, True]),
]


def test_series_examples(spark):
    got = run(panel(spark, SERIES), **{f"d{i}": node for i, (node, _) in enumerate(EXAMPLES)})
    for i, (_, want) in enumerate(EXAMPLES):
        same(got[f"d{i}"], want)


def test_short_examples(spark):
    got = run(panel(spark, {"x": [1, N, 4, 3, 5], "t": [True, N, True, True, False]}), decay=ts("unary.decay_linear", "x", window=3, min_periods=2), run=ts("unary.consecutive_count", "t"))
    same(got["decay"], [N, N, 3.25, 3.4, 4.16667])
    same(got["run"], [1, 1, 2, 3, 0])
    got = run(panel(spark, {"x": [1, N, 3, N, 5, 6]}), a=ts("unary.ewm_var", "x", span=3.0), b=ts("unary.ewm_var", "x", span=3.0, ignore_na=True))
    same(got["a"], [N, N, 2, 2, 3.14286, 1.97884])
    same(got["b"], [N, N, 2, 2, 3.71429, 3.42857])
    same(run(panel(spark, {"c": [1, N, 2, 3], "v": [10, 20, 30, 40]}), o=ts("talib.obv", {"close": "c", "volume": "v"}))["o"], [10, 30, 30, 70])


BARS = [10.0, 10.5, 10.2, 10.8, 11.1, 10.9, 11.4, 11.8, 11.5, 12.0, 12.3, 12.1]
HLC = {"high": "h", "low": "l", "close": "c"}
TAILS = [
    (ts("talib.ad", HLC | {"volume": "v"}), [-1177.27, -1340.91, -1481.82]),
    (ts("talib.adx", HLC, time_period=3), [54.5529, 59.3433, 50.4964]),
    (ts("talib.apo", "c", fast_period=2, slow_period=4, ma_type=1), [0.207297, 0.245492, 0.134333]),
    (ts("talib.macd", "c", fast_period=2, slow_period=4, signal_period=2), [0.207153, 0.245444, 0.134317]),
    (ts("talib.macd", "c", fast_period=3, slow_period=6, signal_period=3, output="signal"), [0.314383, 0.326664, 0.292643]),
    (ts("talib.aroon", {"high": "h", "low": "l"}, time_period=5, output="down"), [20, 0, 0]),
    (ts("talib.aroonOsc", {"high": "h", "low": "l"}, time_period=3), [100, 66.6667, 66.6667]),
    (ts("talib.bBands", "c", time_period=3, ma_type=1, output="upper"), [12.1518, 12.6804, 12.3097]),
    (ts("talib.beta", {"high": "h", "low": "l"}, time_period=5), [1.10162, 1.10071, 1.09836]),
    (ts("talib.plus_di", HLC, time_period=5), [28.4351, 28.191, 22.3293]),
    (ts("talib.plus_dm", {"high": "h", "low": "l"}, time_period=3), [0.947371, 0.931581, 0.621054]),
    (ts("talib.obv", {"close": "c", "volume": "v"}), [6450, 8250, 6700]),
    (ts("talib.rsi", "c", time_period=5), [78.0913, 81.507, 72.1349]),
    (ts("talib.t3", "c", time_period=2, vfactor=0.3), [11.7202, 11.9904, 12.0867]),
    (ts("talib.ma", "c", time_period=2, ma_type=8), [11.9171, 12.2516, 12.23]),
    (ts("talib.ultOsc", HLC, period1=3, period2=5, period3=7), [45.5544, 45.4545, 45.4545]),
    (ts("talib.mfi", HLC | {"volume": "v"}, time_period=3), [73.2065, 74.7401, 69.4018]),
]


def test_indicator_examples(spark):
    v = [1000, 1200, 900, 1300, 1400, 1100, 1500, 1600, 1250, 1700, 1800, 1550]
    df = panel(spark, {"c": BARS, "h": [x + 0.6 for x in BARS], "l": [x - 0.5 for x in BARS], "v": v})
    got = run(df, **{f"d{i}": node for i, (node, _) in enumerate(TAILS)})
    for i, (_, want) in enumerate(TAILS):
        same(got[f"d{i}"][-3:], want)


def test_section_examples(spark):
    x = panel(spark, {"x": [1, 2, 2, 4, 8], "o": [1, 2, 3, 4, 100], "y": [1, 2, 3, 4, 5], "z": [2.1, 3.8, 6.2, 7.9, 10.1], "g": ["s"] * 5}, "section")
    got = run(
        x,
        qcut=cs("unary.qcut", "x", q=4),
        normal=cs("unary.rank_normal", "x"),
        kurt=cs("unary.kurt", "x"),
        skew=cs("unary.skew", "x"),
        dense=cs("grouped.rank_pct", {"col": "x", "by": "g"}, ties_method="dense"),
        average=cs("unary.rank_pct", "x", ties_method="average"),
        wins=cs("unary.winsorize", "o", lower=0.1, upper=0.9),
    )
    same(got["qcut"], [0, 0, 0, 2, 3])
    same(got["normal"], [-1.28155, -0.253347, -0.253347, 0.524401, 1.28155])
    same(got["kurt"], [2.51036] * 5)
    same(got["skew"], [1.00388] * 5)
    same(got["dense"], [0.25, 0.5, 0.5, 0.75, 1])
    same(got["average"], [0.2, 0.5, 0.5, 0.8, 1])
    assert got["wins"][0] == pytest.approx(1.4)
    both = panel(spark, {"t": [2, 4, 3, 7, 5, 9], "i": ["bank", "bank", "tech", "tech", "retail", "retail"], "s": [10, 12, 8, 11, 9, 13]}, "section")
    same(run(both, n=cs("controls.neutralize_by", {"target": "t", "controls": ["i", "s"]}))["n"], [0.103448, -0.103448, -0.344828, 0.344828, 0.206897, -0.206897])
    one = panel(spark, {"t": [1, 2.2, 2.8, 4.1, 4.9], "s": [8, 9, 10, 11, 12]}, "section")
    same(run(one, n=cs("controls.neutralize_by", {"target": "t", "controls": ["s"]}, intercept=False))["n"], [-1.5051, -0.618235, -0.331373, 0.65549, 1.14235])


def test_null_rules(spark):
    df = panel(spark, {"x": [1.0, N, 0.0, -4.0], "p": [True, N, False, True], "q": [N, False, False, True]})
    got = run(
        df,
        both=direct("binary.and", {"left": "p", "right": "q"}),
        either=direct("binary.or", {"left": "p", "right": "q"}),
        where=direct("ternary.where", {"condition": "p", "if_true": 1, "if_false": 2}),
        div=direct("binary.div", {"left": 1, "right": "x"}),
        root=direct("unary.sqrt", "x"),
        inside=direct("unary.isin", "x", values=[None, 1.0]),
        cast=direct("unary.cast", direct("binary.add", {"left": "x", "right": 0.5}), dtype="int"),
        days=direct("binary.days_between", {"left": direct("nullary.literal", {}, value="2024-01-01", dtype="date"), "right": direct("nullary.literal", {}, value="2024-01-03", dtype="date")}),
        mod=direct("binary.mod", {"left": 5, "right": -3}),
        down=direct("unary.round", direct("nullary.literal", {}, value=-2.5, dtype="double")),
    )
    same(got["both"], [N, N, False, True])
    same(got["either"], [N, N, False, True])
    same(got["where"], [1, N, 2, 1])
    same(got["div"], [1, N, N, -0.25])
    same(got["root"], [1, N, 0, N])
    same(got["inside"], [True, True, False, False])
    same(got["cast"], [2, N, 1, -4])
    same(got["days"], [-2] * 4)
    same(got["mod"], [-1] * 4)
    same(got["down"], [-3] * 4)


def test_mask_is_a_recomputation_of_the_rows_inside(spark):
    rng = np.random.default_rng(4)
    n = 60
    x, m = rng.normal(size=n).tolist(), [None if v < 0.1 else bool(v < 0.6) for v in rng.random(n)]
    df = panel(spark, {"x": x, "m": m})
    flag = direct("unary.cast", "m", dtype="bool")
    nodes = {"a": ts("unary.rolling_std", "x", window=4, min_periods=2), "b": ts("talib.ema", "x", time_period=3), "c": ts("unary.rolling_rank", "x", window=5, min_periods=1), "d": ts("unary.bars_since", direct("binary.gt", {"left": "x", "right": 0}))}
    got = run(df, **{k: v | {"on": flag} for k, v in nodes.items()})
    part = run(df.where("m"), **nodes)
    for k in nodes:
        assert [g for g, keep in zip(got[k], m) if not keep] == [None] * sum(not v for v in m)
        same([g for g, keep in zip(got[k], m) if keep], part[k], 1e-9)


def test_rows_and_partitions_in_any_order(spark):
    rng = np.random.default_rng(8)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(i), c, float(rng.normal())) for c in "abc" for i in range(30)]
    rng.shuffle(rows)
    nodes = {"a": ts("unary.rolling_mean", "x", window=3), "b": cs("unary.rank", "a"), "c": ts("unary.ewm_mean", "b", span=4.0), "d": cs("unary.zscore", "c")}
    results = []
    for parts in (1, 7):
        df = spark.createDataFrame([(t.item() if hasattr(t, "item") else t, str(c), float(x)) for t, c, x in rows], "time timestamp_ntz, code string, x double").repartition(parts)
        results.append(run(df, **nodes))
    for k in nodes:
        same(results[0][k], results[1][k], 1e-9)


def test_one_shuffle_per_change_of_key(spark):
    df = panel(spark, SERIES)
    wide = execute_query(SPAN | {"derivatives": {f"d{i}": n for i, (n, _) in enumerate(EXAMPLES[:10])}}, panel=df).data
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    layered = execute_query(SPAN | {"derivatives": {"a": ts("unary.diff", "S"), "b": cs("unary.rank", "a"), "c": ts("unary.shift", "b"), "z": ts("unary.rolling_mean", "S", window=2), "y": cs("unary.zscore", "S")}}, panel=df).data
    layered.collect()
    physical = layered._jdf.queryExecution().executedPlan().toString()
    assert layered._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 3
    assert physical.split("== Initial Plan ==")[-1].count("Exchange") == 3


def test_equal_trees_are_computed_once(spark):
    def plan(mean):
        df = execute_query(SPAN | {"derivatives": {"a": mean, "b": direct("binary.add", {"left": mean, "right": 1}), "c": ts("unary.diff", mean)}}, panel=panel(spark, SERIES)).data
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert plan(ts("unary.cum_mean", "S")).count("avg(") == 1
    kernel = next(line for line in plan(ts("unary.rolling_mean", "S", window=3)).splitlines() if "MapInArrow" in line)
    assert kernel.count("__") == 2  # the input as it goes in and the one result


def test_no_spread_is_no_error(spark):
    flat = panel(spark, {"x": [2, 2, 2, 2, 3], "y": [1, 2, N, 4, 5]})
    two = {"left": "x", "right": "y"}
    got = run(flat, a=ts("binary.rolling_corr", two, window=3, min_periods=2), b=ts("binary.rolling_beta", two, window=3, min_periods=2), c=cs("binary.corr", two), d=cs("binary.rank_corr", two), e=ts("talib.correl", {"high": "x", "low": "y"}, time_period=2), f=ts("unary.rolling_skew", "x", window=3), g=ts("unary.rolling_kurt", "x", window=3), h=cs("unary.zscore", "x"), i=cs("unary.kurt", "x"), j=ts("binary.expanding_corr", two), k=ts("talib.beta", {"high": "x", "low": "x"}, time_period=2), l=ts("binary.rolling_residual", two, window=3, min_periods=2))
    same(got["a"], [N, N, N, N, 1])
    same(got["e"], [N, N, N, N, 1])
    assert got["c"] == got["d"] == got["h"] == got["i"] == [None] * 5 and got["j"][:4] == [None] * 4
    assert got["f"][2] is None and got["g"][2] is None


def test_inverse_normal(spark):
    ps = [1e-12, 1e-5, 0.01, 0.07, 0.3, 0.5, 0.8, 0.975, 1 - 1e-7]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(inverse_normal(F.col("p"))).collect()
    for p, r in zip(ps, got):
        assert r[0] == pytest.approx(statistics.NormalDist().inv_cdf(p), abs=1e-9)


def test_recursive_series_against_pandas(spark):
    x = np.cumsum(np.random.default_rng(1).normal(size=80)) + 50
    got = run(panel(spark, {"x": x.tolist()}), ema=ts("talib.ema", "x", time_period=7), rank=ts("unary.expanding_rank", "x", ties_method="max"))
    seeded = pd.Series(np.concatenate([[x[:7].mean()], x[7:]])).ewm(span=7, adjust=False).mean()
    same(got["ema"], [N] * 6 + seeded.tolist(), 1e-9)
    assert got["rank"] == [float((x[: i + 1] <= v).sum()) for i, v in enumerate(x)]


def test_all_operators_are_there():
    ops = load().values()
    assert [sum(o.family == f for o in ops) for f in ("DIRECT", "TS", "CS")] == [75, 116, 40]
    used = {o for q in (Q.DIRECT, Q.TS, Q.CS) for cases in q.values() for o, *_ in cases}
    assert len(used) > 150


@pytest.mark.parametrize(
    "bad",
    [
        {"x": ts("unary.nothing", "S")},
        {"x": ts("unary.rolling_mean", "S", window=3, min_periods=4)},
        {"x": ts("unary.rolling_mean", "S", window=0)},
        {"x": ts("unary.rolling_mean", "S", window=3.0)},
        {"x": ts("unary.rolling_mean", "S", window=3, other=1)},
        {"x": ts("unary.rolling_mean", {"col": "S", "more": "S"}, window=3)},
        {"x": ts("unary.ewm_mean", "S", com=1.0, span=3.0)},
        {"x": ts("unary.ewm_mean", "S")},
        {"x": ts("talib.macd", "S", fast_period=5, slow_period=5)},
        {"x": ts("talib.ma", "S", time_period=3, ma_type=7)},
        {"x": ts("talib.ultOsc", {"high": "S", "low": "S", "close": "S"}, period1=7, period2=7, period3=9)},
        {"x": direct("unary.between", "S", lower=2.0, upper=1.0)},
        {"x": direct("unary.clip", "S")},
        {"x": direct("unary.clip", "S", lower=float("nan"))},
        {"x": direct("unary.replace", "S", old=[1], new=[1, 2])},
        {"x": direct("unary.isin", "S", values=[])},
        {"x": direct("nullary.literal", {}, value=None)},
        {"x": direct("nullary.literal", {}, value="2024-01-01T00:00:00+01:00", dtype="timestamp")},
        {"x": direct("nullary.literal", {}, value="2024-13-01", dtype="date")},
        {"x": direct("unary.not", direct("binary.add", {"left": "S", "right": 1}))},
        {"x": direct("binary.and", {"left": 1, "right": True})},
        {"x": direct("unary.abs", "S") | {"on": True}},
        {"x": direct("unary.abs", "S") | {"type": "TS"}},
        {"x": ts("unary.diff", "S", on=direct("unary.abs", "S"))},
        {"x": ts("unary.diff", "S", on="nowhere")},
        {"x": ts("unary.diff", "S", on="y"), "y": direct("unary.abs", "S")},
        {"x": direct("unary.not", "y"), "y": direct("unary.abs", "S")},
        {"x": direct("unary.abs", "y"), "y": direct("unary.abs", "x")},
        {"x": direct("unary.abs", "x")},
        {"time": direct("unary.abs", "S")},
        {" ": direct("unary.abs", "S")},
        {"x": direct("multiary.add", {"cols": []})},
        {},
    ],
)
def test_bad_requests(bad):
    with pytest.raises(RequestError):
        Query.parse(SPAN | {"derivatives": bad})


def test_bad_queries():
    for bad in ({"factors": ["time"]}, {"factors": ["a", "a"]}, {"factors": ["a"], "filters": ["a"]}, {"factors": ["a"], "start_date": "2025-01-01"}, {"factors": ["a"], "end_date": "20240101"}, {"factors": ["a"], "more": 1}, {"factors": ["a"], "lookback": "-1D"}, {"factors": ["x"], "derivatives": {"x": direct("unary.abs", "y")}}):
        with pytest.raises(RequestError):
            Query.parse(SPAN | bad)
    q = Query.parse(SPAN | {"factors": ["b"], "derivatives": {"x": direct("binary.add", {"left": "c", "right": "a"})}})
    assert q.source_factors() == ["b", "a", "c"]
    assert parse_node(direct("nullary.literal", {}, value=True)).output == "BOOL" and parse_node(direct("unary.cast", "a", dtype="bool")).output == "BOOL"


def test_kernel_columns_of_any_name(spark):
    df = panel(spark, {"__0": [1, 2, 3, 4], "a b": [2, 4, 6, 8]})
    got = run(df, **{"out col": ts("talib.ema", "__0", time_period=2), "s": ts("unary.diff", "a b")})
    same(got["out col"], [N, 1.5, 2.5, 3.5])
    assert math.isclose(got["s"][1], 2)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, name):
    df = Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    if name in Q.SQL:
        n, differences = compare(df, duck("/root/testdata/sf0.001"), Q.SQL[name])
        assert not differences and n
    else:
        assert df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("decay", [{"span": 5.0}, {"alpha": 0.3}, {"half_life": 3.0, "adjust": False}, {"com": 0.7, "ignore_na": True}])
def test_one_weighted_value_has_no_spread(spark, decay):
    """However long ago: its weight squared less the squared weight is nothing, not what rounding leaves."""
    got = run(panel(spark, {"x": [22.9] + [N] * 40 + [30.0]}), std=ts("unary.ewm_std", "x", **decay), cov=ts("binary.ewm_cov", {"left": "x", "right": "x"}, **decay))
    for k in ("std", "cov"):
        assert got[k][:-1] == [N] * 41 and got[k][-1] > 0


def test_a_join_before_does_not_break_series_up(spark):
    """Spark may turn the codes' join to a broadcast while it runs, and reads the panel's shuffle then as it was written: a part of each code in each task."""
    rows = spark.range(0, 240, 1, 4).select((F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(days=F.floor(F.col("id") / 6).cast("int"))).alias("time"), F.concat((F.col("id") % 6).cast("string"), F.lit(".SZ")).alias("code"), F.col("id").cast("double").alias("x"))
    some = SPAN | {"factors": ["x"], "derivatives": {"high": direct("binary.gt", {"left": "x", "right": 234.0})}, "filters": ["high"]}
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = execute_query(SPAN | {"derivatives": {"mean": ts("unary.rolling_mean", "x", window=3, min_periods=1)}}, panel=rows, codes_query=some).data.toPandas()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = rows.where("code <> '0.SZ'").toPandas().sort_values(["code", "time"])
    want["mean"] = want.groupby("code")["x"].transform(lambda x: x.rolling(3, min_periods=1).mean())
    got = got.sort_values(["code", "time"])
    assert len(got) == len(want) == 200 and np.allclose(got["mean"], want["mean"])
