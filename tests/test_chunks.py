"""Series in chunks give the rows of whole series, wherever the chunks' boundaries fall; scans against plain loops and pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_engine import SPAN, cs, direct, same, ts

from marlstone.functions import scan
from marlstone.functions.windows import Rows
from marlstone.plans import chunks
from marlstone.plans.spec import RequestError
from marlstone.query import execute_query

SIZES = [1, 3, 0, 700, 2, 40]


@pytest.mark.parametrize("size", [SIZES, [5], [], [0, 0, 2]])
def test_scans_by_a_loop(size):
    rng = np.random.default_rng(3)
    rows = Rows(np.cumsum(size))
    a, b, start = rng.normal(size=rows.n), rng.normal(size=rows.n), rng.normal(size=len(size))
    a[rng.random(rows.n) < 0.1] = 0
    got, before = scan.solve(rows, (a, b), start)
    high, lower = scan.solve(rows, (scan.MAX, b), start)
    for i, (s, e) in enumerate(zip(rows.starts, rows.ends)):
        y = m = start[i]
        for t in range(s, e):
            assert before[t] == pytest.approx(y) and lower[t] == m
            y, m = a[t] * y + b[t], max(m, b[t])
            assert got[t] == pytest.approx(y, rel=1e-9, abs=1e-9) and high[t] == m
        whole = scan.total(rows, (a, b), i)
        assert whole[0] * start[i] + whole[1] == pytest.approx(y, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("ignore_na", [True, False])
@pytest.mark.parametrize("bias", [True, False])
def test_weighted_moments_against_pandas(adjust, ignore_na, bias):
    rng = np.random.default_rng(7)
    size = [1, 2, 60, 300, 5]
    rows = Rows(np.cumsum(size))
    x, y = rng.normal(size=rows.n) + 1e6, rng.normal(size=rows.n)
    x[rng.random(rows.n) < 0.3], y[rng.random(rows.n) < 0.2] = np.nan, np.nan
    x[70:90] = 3.5
    for weight in ({"com": 2.0}, {"span": 7.0}, {"half_life": 1.5}, {"alpha": 0.4}, {"alpha": 1.0}):
        p = {"com": None, "span": None, "half_life": None, "alpha": None} | weight | {"min_periods": 2, "adjust": adjust, "ignore_na": ignore_na, "bias": bias}
        with np.errstate(all="ignore"):
            got = [scan.run(rows, g) for g in (scan.ewm_mean(x, p), scan.ewm_std(x, p), scan.ewm_cov(x, y, p), scan.ewm_corr(x, y, p))]
        for s, e in zip(rows.starts, rows.ends):
            a, b = pd.Series(x[s:e]), pd.Series(y[s:e])
            e_ = lambda v: v.ewm(com=p["com"], span=p["span"], halflife=p["half_life"], alpha=p["alpha"], min_periods=2, adjust=adjust, ignore_na=ignore_na)
            for g, want in zip(got, (e_(a).mean(), e_(a).std(bias=bias), e_(a).cov(b, bias=bias), e_(a).corr(b))):
                assert np.allclose(g[s:e], want.replace([np.inf, -np.inf], np.nan), rtol=1e-6, atol=1e-6, equal_nan=True)


def panel_of(spark, sizes, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for c, n in enumerate(sizes):
        x = np.cumsum(rng.normal(size=n)) + 50
        for i in range(n):
            rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), f"c{c}", None if rng.random() < 0.1 else float(x[i]), float(x[i] + rng.random()), float(x[i] - rng.random()), float(rng.integers(1, 9)), bool(rng.random() < 0.7)))
    rng.shuffle(rows)
    rows = [(*r[:2], *[None if v is None else float(v) for v in r[2:6]], bool(r[6])) for r in rows]
    return spark.createDataFrame(rows, "time timestamp_ntz, code string, x double, h double, l double, v double, m boolean")


HLC = {"high": "h", "low": "l", "close": "x"}
NODES = {
    "mean": ts("unary.rolling_mean", "x", window=9, min_periods=2),
    "std": ts("unary.rolling_std", "x", window=30, min_periods=2),
    "top": ts("unary.rolling_argmax", "x", window=64, min_periods=1),
    "rank": ts("unary.rolling_rank_pct", "x", window=20, min_periods=1),
    "mad": ts("unary.rolling_mad", "x", window=11, min_periods=1),
    "corr": ts("binary.rolling_corr", {"left": "x", "right": "v"}, window=40, min_periods=3),
    "line": ts("talib.linearreg", "h", time_period=12),
    "mfi": ts("talib.mfi", {"high": "h", "low": "l", "close": "x", "volume": "v"}, time_period=5),
    "aroon": ts("talib.aroonOsc", {"high": "h", "low": "l"}, time_period=25),
    "diff": ts("unary.diff", "x", periods=3),
    "ret": ts("unary.pct_change", "h", periods=1),
    "roc": ts("talib.roc", "h", time_period=7),
    "ewm": ts("unary.ewm_mean", "x", span=50.0, min_periods=3),
    "ewv": ts("unary.ewm_var", "x", half_life=9.0, adjust=False),
    "ewc": ts("binary.ewm_corr", {"left": "x", "right": "h"}, alpha=0.05, ignore_na=True),
    "ema": ts("talib.ema", "x", time_period=90),
    "tema": ts("talib.tema", "x", time_period=8),
    "trix": ts("talib.trix", "x", time_period=6),
    "rsi": ts("talib.rsi", "x", time_period=14),
    "atr": ts("talib.atr", HLC, time_period=14),
    "obv": ts("talib.obv", {"close": "x", "volume": "v"}),
    "masked": ts("unary.ewm_mean", "x", on=direct("unary.cast", "m", dtype="bool"), com=4.0),
    **{k: ts(f"unary.cum_{k}", "x", min_periods=2) for k in ("sum", "count", "max", "min")},
    "cmean": ts("unary.cum_mean", "x"),
    **{f"e{k}": ts(f"unary.expanding_{k}", "x", min_periods=2) for k in ("std", "var", "sem")},
    **{f"p{k}": ts(f"binary.expanding_{k}", {"left": "x", "right": "v"}, min_periods=3) for k in ("beta", "corr", "cov")},
}


@pytest.mark.parametrize("chunk_rows", [60, 100_000])
def test_chunks_give_the_rows_of_whole_series(spark, chunk_rows):
    df = panel_of(spark, [1, 900, 3, 60, 250, 2]).cache()
    got = {}
    for size in (None, chunk_rows):
        rows = execute_query(SPAN | {"derivatives": NODES}, panel=df, chunk_rows=size).data.orderBy("code", "time").collect()
        got[size] = {k: [r[k] for r in rows] for k in NODES}
    for k in NODES:
        wrong = [i for i, (g, w) in enumerate(zip(got[chunk_rows][k], got[None][k])) if (g is None) != (w is None) or g is not None and abs(g - w) > 1e-7 * max(1e-3, abs(w))]
        assert not wrong, (k, wrong[:9])


def test_layers_in_chunks(spark):
    df = panel_of(spark, [200, 150])
    layers = {"a": ts("unary.ewm_mean", "h", span=9.0), "b": cs("unary.rank_pct", "a"), "c": ts("unary.rolling_sum", "b", window=7), "d": ts("unary.cum_sum", "c")}
    one, two = (execute_query(SPAN | {"derivatives": layers}, panel=df, chunk_rows=n).data.orderBy("code", "time").collect() for n in (None, 45))
    for k in layers:
        same([r[k] for r in two], [r[k] for r in one], 1e-9)


def test_a_hot_code_is_spread_evenly(spark):
    """A code with most of all rows: no chunk holds twice the median, halo and all."""
    df = spark.range(60_000).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("time"), F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 997)).alias("code"), F.rand(1).alias("x"))
    placed, n = chunks._parts(df, 4000)
    pieces = chunks._pieces(placed)
    assert n == 15 and len(pieces["hot"]) >= 12
    sizes = sorted(r["count"] for r in chunks._with_halo(placed, pieces, 200).repartitionById(n, "_chunk").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == n and sizes[-1] < 2 * sizes[n // 2]
    got = execute_query(SPAN | {"start_date": "1970-01-01", "derivatives": {"s": ts("unary.cum_sum", "x"), "e": ts("talib.ema", "x", time_period=200)}}, panel=df, chunk_rows=4000).data
    last = got.where("code = 'hot'").orderBy(F.desc("time")).first()
    x = np.array([r.x for r in df.where("code = 'hot'").orderBy("time").select("x").collect()])
    assert last.s == pytest.approx(x.sum()) and last.e == pytest.approx(pd.Series(np.concatenate([[x[:200].mean()], x[200:]])).ewm(span=200, adjust=False).mean().iloc[-1])


def test_what_needs_a_whole_history_is_refused(spark):
    df = panel_of(spark, [20])
    for node in (ts("unary.expanding_median", "x"), ts("talib.kama", "x", time_period=3), ts("unary.rolling_mean", "x", on=direct("unary.cast", "m", dtype="bool"), window=3)):
        with pytest.raises(RequestError):
            execute_query(SPAN | {"derivatives": {"d": node}}, panel=df, chunk_rows=10).data
    empty = execute_query(SPAN | {"derivatives": {"d": ts("unary.ewm_mean", "x", com=1.0)}}, panel=df.limit(0), chunk_rows=10).data
    assert empty.count() == 0


def test_one_weighted_value_has_no_spread_in_chunks(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(i), c, 22.9 if i == first else None) for c, first in (("a", 0), ("b", 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, code string, x double")
    nodes = {f"d{i}": ts("unary.ewm_var", "x", **p) for i, p in enumerate(({"span": 5.0}, {"half_life": 3.0, "adjust": False}))}
    got = execute_query(SPAN | {"derivatives": nodes}, panel=df, chunk_rows=7).data
    assert got.count() == 80 and got.where("d0 is not null or d1 is not null").count() == 0


def test_a_finished_chunk_goes_on_in_slices(spark, monkeypatch):
    df = spark.range(200).select((F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("time"), F.lit("a").alias("code"), F.col("id").cast("double").alias("x"))
    passes, usual = [], type(df).mapInArrow

    def noted(self, function, schema):
        passes.append((self, function))
        return usual(self, function, schema)

    monkeypatch.setattr(type(df), "mapInArrow", noted)
    execute_query(SPAN | {"derivatives": {"d": ts("unary.rolling_mean", "x", window=3)}}, panel=df, chunk_rows=1000).data
    monkeypatch.setattr(chunks, "OUT_ROWS", 50, raising=False)
    dealt, finish = passes[-1]
    sizes = [b.num_rows for b in finish(dealt.toArrow().to_batches())]
    assert sum(sizes) == 200 and max(sizes) == 50


@pytest.mark.parametrize("chunk_rows", [None, 2])
def test_equal_values_have_no_weighted_correlation(spark, chunk_rows):
    """A spread of zero gives NULL, not 0: (0.7 y + y) / 1.7 is off by a rounding for y = 11.695 and 27.31, not for 14.695."""
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(i), str(y), x, None if x is None else z) for y in (11.695, 14.695, 27.31) for i, (x, z) in enumerate([(21.39, y), (5.39, y), (None, y), (22.87, y + 1)])]
    df = spark.createDataFrame(rows, "time timestamp_ntz, code string, x double, y double")
    nodes = {k: ts("binary.ewm_corr", {"left": a, "right": b}, alpha=0.3) for k, a, b in (("d", "x", "y"), ("e", "y", "x"))}
    got = execute_query(SPAN | {"derivatives": nodes}, panel=df, chunk_rows=chunk_rows).data.orderBy("code", "time").collect()
    for k in nodes:
        assert [r[k] is None for r in got] == [True, True, True, False] * 3
