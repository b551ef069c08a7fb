"""Factor analysis, backtests, optimisation, sensitivity, worker transforms, storage and streaming."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from marlstone import app_queries as Q
from marlstone.apps import backtest as B
from marlstone.apps import factor as A
from marlstone.apps import optimize as O
from marlstone.apps import search as S
from marlstone.apps import workers as K
from marlstone.plans.request import Query, parse_lookback
from marlstone.plans.spec import RequestError
from marlstone.query import execute_query
from marlstone.sources import panel as P
from marlstone.streaming.ingest import stream_into

DAYS = [d for d in (dt.datetime(2024, 1, 1) + dt.timedelta(i) for i in range(40)) if d.weekday() < 5]
CODES = ["000001.SZ", "600000.SH", "600036.SH"]


def noop(name):
    args = ", ".join(["context", "message", "indicator"][: B.CALLBACKS[name]])
    return f"def {name}({args}):\n    return None"


def callbacks(**own):
    return {n: own.get(n, noop(n)) for n in B.CALLBACKS}


@pytest.fixture(scope="module")
def market(spark):
    rows = []
    for k, c in enumerate(CODES):
        close = 10.0 + k
        for i, d in enumerate(DAYS):
            before, close = close, round(close * (1 + 0.01 * math.sin(i * (k + 1))), 3)
            rows.append((d, c, before, max(before, close) + 0.1, min(before, close) - 0.1, close, before, float(1000 + 10 * i), 1.0 + i * 0.01))
    return spark.createDataFrame(rows, "time timestamp_ntz, code string, open double, high double, low double, close double, pre_close double, vol double, adj_factor double").cache()


def request(**more):
    return {"dataset_query": {"start_date": "2024-01-08", "end_date": "2024-02-09", "lookback": "7D", "codes": CODES, "factors": ["close"], "derivatives": {"r": {"type": "TS", "op": "unary.pct_change", "fields": {"col": "close"}, "params": {"periods": 1}}}}, "callbacks": callbacks(), "config": {"cash": 100000}} | more


def test_messages(spark, market):
    m = B.build_messages(market.withColumn("code", B.exchange_code(F.col("code"))).withColumns({"up_limit": F.lit(None).cast("double"), "down_limit": F.lit(12.0)}), spread=0.01)
    rows = m.where("symbol = '600000.XSHG'").orderBy("timestamp").collect()
    assert len(rows) == 2 * len(DAYS) and rows[0].timestamp.hour == 9 and rows[0].timestamp.minute == 30 and rows[1].timestamp.hour == 15
    assert rows[0].symbolSource == "XSHG" and rows[0].lastPrice == 11.0 and rows[0].bidPrice == [10.945] and rows[0].offerPrice == [11.055] and rows[0].bidQty == [10**9]
    assert rows[0].upLimitPrice == 12.1 and rows[0].downLimitPrice == 12.0
    q = B.build_messages(market.withColumn("code", B.exchange_code(F.col("code"))).withColumns({"up_limit": F.lit(None).cast("double"), "down_limit": F.lit(None).cast("double")}), "qfq")
    last = q.where("symbol = '600000.XSHG'").orderBy(F.col("timestamp").desc()).first()
    assert last.lastPrice == pytest.approx(market.where("code = '600000.SH'").orderBy(F.col("time").desc()).first().close)
    with pytest.raises(RequestError):
        B.build_messages(market, "both")


BUY = """def onSnapshot(context, message, indicator):
    if context.now.hour != 9:
        return
    last = context.last(False)
    context.state["rows"] = len(last)
    assert (context.history()["time"] < context.now.normalize()).all()
    for symbol in sorted(message["symbol"]):
        context.order_target_value(symbol, context.get_param("value"), "hold")"""


def test_backtest(spark, market):
    r = B.run_backtest(request(callbacks=callbacks(onSnapshot=BUY), params={"value": 20000.0}, config={"cash": 100000, "commission": 0.001, "syntheticSpread": 0.002}), panel=market)
    assert r.error is None
    trades, days = r.trade_details.toPandas(), r.daily_portfolios.orderBy("tradeDate").toPandas()
    first = trades[trades.tradeTime == trades.tradeTime.min()]
    assert set(first.symbol) == {"000001.XSHE", "600000.XSHG", "600036.XSHG"} and (first.quantity % 100 == 0).all()
    assert len(days) == len([d for d in DAYS if dt.datetime(2024, 1, 8) <= d <= dt.datetime(2024, 2, 9)])
    sign = np.where(trades.side == "buy", 1, -1)
    assert days.cash.iloc[-1] == pytest.approx(100000 - (sign * trades.amount).sum() - trades.fee.sum())
    assert days.totalFee.iloc[-1] == pytest.approx(trades.fee.sum()) and (trades.fee >= 5).all()
    assert ((1 + days.ratio).cumprod() - days.netValue).abs().max() < 1e-9
    s = r.return_summary
    v = days.netValue.to_numpy()
    assert s["totalReturn"] == pytest.approx(v[-1] - 1) and s["annualReturn"] == pytest.approx(v[-1] ** (250 / len(v)) - 1)
    assert s["annualVolatility"] == pytest.approx((v[1:] / v[:-1] - 1).std() * math.sqrt(250)) and s["sharpeRatio"] == pytest.approx((s["annualReturn"] - 0.04) / s["annualVolatility"])
    assert r.context == {"rows": 3} and r.daily_trading_statistics.count() == trades.tradeTime.dt.date.nunique() and r.daily_positions.count() > 0


def test_orders_are_refused_for_good_reasons():
    messages = pd.DataFrame([{"symbol": "A", "timestamp": pd.Timestamp("2024-01-02 09:30"), "lastPrice": 10.0, "upLimitPrice": 10.0, "downLimitPrice": 9.0, "bidPrice": [9.99], "offerPrice": [10.01]}])
    seen = []

    def snap(ctx, m, i):
        ctx.order_target("A", 100)
        for bad in (-1, 1.5, None):
            with pytest.raises(ValueError):
                ctx.order_target("A", bad)
        with pytest.raises(ValueError):
            ctx.order_target("B", 1)

    f = {n: (lambda *a: None) for n in B.CALLBACKS} | {"onSnapshot": snap, "onOrder": lambda c, e: seen.append(e["status"])}
    empty = pd.DataFrame({"time": pd.to_datetime([]), "code": []})
    rows = B.simulate(messages, empty, empty, f, B.check_config({"cash": 1000}), {})
    assert seen == ["rejected: price above the limit"] and not [r for r in rows if r["kind"] == "trade"]


@pytest.mark.parametrize(
    "more",
    [
        {"callbacks": {}},
        {"callbacks": None},
        {"callbacks": callbacks() | {"onBar": "def onBar(context):\n    pass"}},
        {"callbacks": callbacks() | {"onBar": "x = 1"}},
        {"config": {"benchmark": "000300.SH"}},
        {"config": {"cash": 0}},
        {"config": {"syntheticSpread": 1}},
        {"config": {"startDate": "2024-01-01"}},
        {"adj": "both"},
        {"annual_trading_days": 0},
        {"unknown": 1},
        {"dataset_query": {"start_date": "2024-01-08", "end_date": "2024-02-09", "codes": [], "factors": ["close"]}},
        {"dataset_query": {"start_date": "2024-01-08", "end_date": "2024-02-09", "codes": ["X"], "factors": ["close"]}},
    ],
)
def test_bad_backtests(more):
    with pytest.raises(RequestError):
        B.BacktestRequest.parse(request(**more))


def test_failure_is_a_row(spark, market):
    r = B.run_backtest(request(callbacks=callbacks(onBar="def onBar(context, message, indicator):\n    raise KeyError('no')")), panel=market)
    assert r.error == "KeyError: 'no'" and r.daily_portfolios.count() == 0


def test_walk_forward():
    w = O.walk_forward(dt.date(2026, 1, 31), dt.date(2026, 4, 30), "1M", "1M")
    assert [str(x.holding_start) for x in w] == ["2026-01-31", "2026-02-28", "2026-03-31", "2026-04-30"]
    assert [str(x.holding_end) for x in w] == ["2026-02-27", "2026-03-30", "2026-04-29", "2026-04-30"]
    assert w[0].training_start == dt.date(2025, 12, 31) and w[0].training_end == dt.date(2026, 1, 30)
    assert O.shift(dt.date(2024, 2, 29), "1Y") == dt.date(2025, 2, 28) and O.shift(dt.date(2024, 1, 1), "2W", -1) == dt.date(2023, 12, 18)


@pytest.mark.parametrize("name", list(S.ALGORITHMS))
def test_searches(name):
    grid = S.Grid({"a": list(range(15)), "b": [0.1 * k for k in range(12)]})
    calls = []

    def score(i):
        calls.append(i)
        p = grid.params(i)
        return None if p["a"] == 3 else -((p["a"] - 9) ** 2) - (10 * p["b"] - 4) ** 2

    s = S.search(name, grid, score, 20, 7)
    assert len(calls) == len(set(calls)) == 20 == len(s.evaluated) and s.initial_index == calls[0]
    assert s.selected_index in s.evaluated and s.score == max(x for x in (score(i) for i in s.evaluated) if x is not None)
    again = S.search(name, grid, score, 20, 7)
    assert again == s
    small = S.Grid({"a": [1, 2], "b": [3, 4]})
    assert sorted(S.search(name, small, float, 10, 1).evaluated) == [0, 1, 2, 3]


def test_twenty_algorithms():
    assert len(S.ALGORITHMS) == 20


def test_optimize(spark, market):
    out = O.optimize_backtest(
        request(callbacks=callbacks(onSnapshot=BUY), params={"value": 20000.0}) | {"parameter_space": {"value": [0, 10000, 30000]}, "algorithms": ["random_search", "hill_climb"], "start_date": "2024-01-22", "end_date": "2024-02-09", "lookback_period": "2W", "holding_period": "2W", "evaluation_budget": 2, "seed": 3},
        panel=market,
    ).toPandas()
    assert set(out.algorithm) == {"random_search", "hill_climb"} and set(out.window) == {1, 2} and (out.evaluation_count == 2).all()
    for _, path in out.groupby(["algorithm", "repetition"]):
        path = path.sort_values("time")
        assert ((1 + path.daily_return).cumprod() - path.path_net_value).abs().max() < 1e-9
    assert {"value"} == set(json.loads(out.selected_params[0]))


@pytest.mark.parametrize("more", [{"seed": -1}, {"evaluation_budget": 1}, {"algorithms": ["magic"]}, {"parameter_space": {"other": [1, 2]}}, {"parameter_space": {"value": [1, 1]}}, {"lookback_period": "1Q"}])
def test_bad_optimisations(more):
    good = request(params={"value": 1}) | {"parameter_space": {"value": [1, 2]}, "algorithms": ["halton"], "start_date": "2024-01-22", "end_date": "2024-02-09", "lookback_period": "2W", "holding_period": "2W"}
    assert O.OptimizationRequest.parse(good).budget == 12
    with pytest.raises(RequestError):
        O.OptimizationRequest.parse(good | more)


def test_sensitivity(spark, market):
    base = request(callbacks=callbacks(onSnapshot=BUY), params={"value": 20000.0}, config={"cash": 100000, "commission": 0.0})
    out = O.analyze_sensitivity(base | {"analysis_type": "fee_analysis", "cases": [{"params": {"value": 20000.0}, "commission": c} for c in (0.0, 0.01)]}, panel=market).toPandas().sort_values("case_index")
    assert list(out.status) == ["SUCCESS"] * 2 and out.total_fee.iloc[0] == 0 and out.total_fee.iloc[1] > 0 and out.total_return.iloc[1] < out.total_return.iloc[0]
    bad = O.analyze_sensitivity(base | {"analysis_type": "sensitivity", "cases": [{"params": {"value": -5.0}, "commission": 0.0}, {"params": {"value": 1000.0}, "commission": 0.0}]}, panel=market).toPandas().sort_values("case_index")
    assert list(bad.status) == ["FAILURE", "SUCCESS"] and "target value" in bad.error.iloc[0]
    for cases in ([], [{"params": {"value": "x"}, "commission": 0.0}], [{"params": {"value": 20000.0}, "commission": 0.0}] * 2, [{"params": {}, "commission": 0.0}]):
        with pytest.raises(RequestError):
            O.check_cases(B.BacktestRequest.parse(base), "sensitivity", cases)


def test_factor_analysis(spark):
    rng = np.random.default_rng(0)
    rows = [(d, f"{c:06d}.SZ", float(rng.normal()), float(rng.normal()), float(np.exp(rng.normal(8, 1)))) for d in DAYS[:4] for c in range(30)]
    rows[3] = (*rows[3][:2], None, *rows[3][3:])
    panel = spark.createDataFrame(rows, "time timestamp_ntz, code string, f double, ret double, circ_mv double")
    industries = spark.createDataFrame([(f"{c:06d}.SZ", "abc"[c % 3]) for c in range(29)], "code string, industry string")
    q = {"start_date": "2024-01-01", "end_date": "2024-01-31", "codes": [], "factors": ["f"]}
    r = A.analyze_factors({"dataset_query": q, "factor_columns": ["f"], "return_columns": ["ret"], "return_specs": {"ret": {"kind": "simple", "periods": 1}}, "n_groups": 5}, panel=panel, industries=industries)
    got = r.processed.toPandas()
    assert got.f.isna().sum() == 1 and got.groupby("time").f_group.value_counts().max() <= 6
    day = got[(got.time == got.time.max()) & got.f.notna()]
    z = np.log(day.circ_mv.astype(float))
    assert abs(np.corrcoef(day.f.astype(float), z)[0, 1]) < 1e-9 and day.f.astype(float).std(ddof=0) == pytest.approx(1)
    ic = r.information_coefficient.where(F.col("time") == F.lit(day.time.iloc[0])).first()
    assert ic.f_ret_ic == pytest.approx(np.corrcoef(day.f.astype(float), day.ret)[0, 1])
    assert ic.f_ret_rank_ic == pytest.approx(np.corrcoef(day.f.astype(float).rank(), day.ret.rank())[0, 1])
    g = r.group_returns.where(F.col("time") == F.lit(day.time.iloc[0])).first()
    part = day[day.f_group == 2]
    assert g.f_ret_group2 == pytest.approx((part.ret * part.circ_mv).sum() / part.circ_mv.sum())


def test_return_specs_are_found():
    shift = lambda n: {"type": "TS", "op": "unary.shift", "fields": {"col": "close"}, "params": {"periods": n}}
    log = {"op": "unary.log", "fields": {"col": {"op": "binary.div", "fields": {"left": shift(-6), "right": shift(-1)}}}}
    assert A.return_spec("r", log) == {"kind": "log", "periods": 5}
    assert A.return_spec("r", {"op": "unary.pct_change", "params": {"periods": -2}}) == {"kind": "simple", "periods": 2}
    with pytest.raises(RequestError):
        A.return_spec("r", None)


LONG = [
    ("2024-01-01", "A.SZ", "close", 1.0),
    ("2024-01-02", "A.SZ", "close", 2.0),
    ("2024-01-02", "B.SZ", "close", 5.0),
    ("2024-01-04", "A.SZ", "close", 3.0),
    ("2024-01-03", "A.SZ", "roe_ttm", 7.0),
    ("2024-01-02", "A.SZ", "weight_X", 0.5),
    ("2024-01-04", "A.SZ", "is_st", 1.0),
]


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(dt.datetime.fromisoformat(t), c, f, v) for t, c, f, v in LONG], P.LONG)


def test_panel(spark, long):
    q = {"start_date": "2024-01-02", "end_date": "2024-01-04", "lookback": "1D", "codes": [], "factors": ["close", "roe_ttm", "weight_X", "is_st", "none"]}
    r = execute_query(q, long)
    got = [tuple(x) for x in r.data.orderBy("time", "code").collect()]
    day = lambda n: dt.datetime(2024, 1, n)
    assert got == [
        (day(2), "A.SZ", 2.0, None, 0.5, 0.0, None),
        (day(2), "B.SZ", 5.0, None, 0.0, 0.0, None),
        (day(4), "A.SZ", 3.0, 7.0, 0.5, 1.0, None),
        (day(4), "B.SZ", None, None, 0.0, 0.0, None),
    ]
    assert r.source_data.count() == 6  # three trading days, two codes
    only = execute_query(q, long, codes_query={"start_date": "2024-01-02", "end_date": "2024-01-02", "codes": [], "factors": ["close"], "derivatives": {"big": {"type": "DIRECT", "op": "binary.gt", "fields": {"left": "close", "right": 3}, "params": {}}}, "filters": ["big"]})
    assert {x.code for x in only.data.collect()} == {"B.SZ"}
    with pytest.raises(RequestError):
        execute_query(q, long, known={"close"})
    assert execute_query(q, long.limit(0)).data.count() == 0


def test_core_table_and_stream(spark, long, tmp_path):
    store = P.CoreTable(spark, str(tmp_path / "core"), {"close", "roe_ttm", "weight_X", "is_st"})
    store.append(long, 1)
    store.append(long.where("factor = 'close'").withColumn("value", F.lit(9.0)).limit(1), 2)
    bad = spark.createDataFrame([(dt.datetime(2024, 1, 1), "A.SZ", "close", float("nan"))], P.LONG)
    store.append(bad, 3)
    got = store.read(["close"], dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    assert got.count() == 4 and got.where("value = 9").count() == 1
    with pytest.raises(ValueError):
        store.append(long.withColumn("factor", F.lit("new")), 4)
    long.where("code = 'B.SZ'").withColumn("value", F.lit(6.0)).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(P.LONG).parquet(str(tmp_path / "in"))
    q = stream_into(source, store, str(tmp_path / "ck"), first_sequence=10)
    q.awaitTermination(60)
    assert [r.value for r in store.read(["close"]).where("code = 'B.SZ'").collect()] == [6.0]
    assert K.date_watermark(store.read(), ["close", "is_st"]) == dt.date(2024, 1, 4) and K.date_watermark(store.read(), ["close", "vol"]) is None
    assert {r.code: r.next_date for r in K.code_watermarks(store.read(), ["close"]).collect()} == {"A.SZ": dt.date(2024, 1, 5), "B.SZ": dt.date(2024, 1, 3)}


def test_financial_flows(spark):
    rows = [("A", "20221231", "20230401", 100.0), ("A", "20230331", "20230430", 30.0), ("A", "20230630", "20230830", 70.0), ("A", "20220331", "20220430", 20.0), ("A", "20220331", "20230501", 21.0), ("A", "20220501", "20220601", 5.0)]
    df = spark.createDataFrame(rows, "ts_code string, end_date string, f_ann_date string, rev double")
    out = {r.end_date: r for r in K.flows(K.with_quarter(df.where("f_ann_date <> '20230501'")), ["rev"]).collect()}
    assert out["20221231"].rev_ttm == 100 and out["20230331"].rev_ttm == 30 + 100 - 20 and out["20230331"].rev_1 == 30 and out["20230331"].rev_2 is None and out["20230630"].rev_ttm is None
    assert {r.f_ann_date for r in K.first_reports(K.with_quarter(df)).collect()} == {"20220430", "20230401", "20230430", "20230830"}
    stored = K.WORKERS["income"](df).collect()
    assert {r.factor for r in stored} >= {"rev_ttm", "rev_1", "rev_4"}


def test_workers(spark, tmp_path):
    raw = spark.createDataFrame([("A", "20240102", 1.0, None), ("A", "20240102", 2.0, 3.0)], "ts_code string, trade_date string, close double, vol double")
    store = P.CoreTable(spark, str(tmp_path / "core"))
    fails = iter([True, False])

    def fetch():
        if next(fails):
            raise ConnectionError("away")
        return raw

    result = K.run_worker("daily", fetch, store, 1)
    assert result.status == "success" and [a.status for a in result.attempts] == ["failure", "success"] and json.loads(result.to_json())["worker"] == "daily"
    assert sorted((r.factor, r.value) for r in store.read().collect()) == [("close", 2.0), ("vol", 3.0)]
    assert len(K.WORKERS) == 14
    d = spark.createDataFrame([("A", dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3), dt.date(2024, 1, k)) for k in (5, 6)] + [("B", dt.date(2024, 1, 1), None, None, None)], "symbol string, endDate date, recordDate date, exDate date, annDate date")
    assert [r.annDate for r in K.clean_dividends(d).collect()] == [dt.date(2024, 1, 6)]
    P.append_dimension(d.where("symbol = 'A'"), str(tmp_path / "dim"), ["symbol", "recordDate", "exDate"], ["recordDate", "exDate"])
    assert spark.read.parquet(str(tmp_path / "dim")).count() == 1
    with pytest.raises(ValueError):
        P.append_dimension(d, str(tmp_path / "dim"), ["symbol"], ["recordDate"])


def test_lookbacks():
    assert parse_lookback("60D") == parse_lookback("P60D") == dt.timedelta(60) and parse_lookback("P2W") == dt.timedelta(14) and parse_lookback("12:30:00") == dt.timedelta(hours=12, minutes=30)
    for bad in ("soon", "-5D", 5, ""):
        with pytest.raises(RequestError):
            parse_lookback(bad)
    assert Query.parse({"start_date": "2024-01-01", "end_date": "2024-01-02", "codes": [], "factors": ["a"]}).source_factors() == ["a"]


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, name):
    df = Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    if name in Q.SQL:
        n, differences = compare(df, duck("/root/testdata/sf0.001"), Q.SQL[name])
        assert not differences and n
    else:
        assert df.count() > 0


def test_index_weights_of_several_indices(spark):
    rows = [("000300.SH", "a", "20240102", 1.5), ("000905.SH", "a", "20240102", 0.5), ("000905.SH", "b", "20240102", 0.25), (None, "c", "20240102", 1.0)]
    df = spark.createDataFrame(rows, "index_code string, con_code string, trade_date string, weight double")
    got = sorted((r.code, r.factor, r.value) for r in K.WORKERS["index-weight"](df).collect())
    assert got == [("a", "weight_000300SH", 1.5), ("a", "weight_000905SH", 0.5), ("b", "weight_000905SH", 0.25)]


def test_searches_advance_in_rounds():
    grid = S.Grid({"a": list(range(30)), "b": [0, 1, 2]})
    names, rounds = list(S.ALGORITHMS), []
    score = lambda i: -abs(i - 40.0)

    def evaluate(asked):
        rounds.append(len(asked))
        return {(k, i): score(i) for k, i in asked}

    found = S.together({n: S.steps(n, grid, 12, 3) for n in names}, evaluate)
    assert len(rounds) == 12 and rounds[0] == len(names)
    assert all(found[n] == S.search(n, grid, score, 12, 3) for n in names)


def test_callbacks_left_out_do_nothing_and_engine_statistics(spark):

    request = Q._backtest_request([]) | {"callbacks": {"onSnapshot": Q._TREND, "onBar": None}}
    r = Q.run_backtest(request, panel=Q._small_limits(Q.market_panel(spark, "/root/testdata/sf0.001")))
    stat = {x.name: x.value for x in r.engine_stat.collect()}
    assert r.error is None and stat["trades"] == r.trade_details.count() and stat["orders"] == stat["trades"] + stat["rejected"] == r.orders.count() and stat["snapshots"] == 2 * stat["days"] > 0


def test_a_run_reads_a_day_at_a_time(spark, market, monkeypatch):
    """The stored form gives the rows of the form in memory and never holds more than a day's messages or section."""
    dips = {"dip": {"type": "DIRECT", "op": "binary.lt", "fields": {"left": "r", "right": 0}, "params": {}}}
    q = request()["dataset_query"]
    prepared = B.prepare_backtest(request(dataset_query=q | {"derivatives": q["derivatives"] | dips, "filters": ["dip"]}), panel=market)
    held = prepared.panel.toPandas().sort_values(["time", "code"])
    kept = held["__kept"].to_numpy(dtype=bool)
    assert 0 < kept.sum() < len(held)
    held = held.drop(columns="__kept")
    messages, panel = (B.DayTable(p) for p in prepared.files)
    read, sizes = B.DayTable.read, []

    def counted(self, first, last, columns=None):
        out = read(self, first, last, columns)
        if columns != ["__day"]:
            sizes.append(len(out))
        return out

    seen: list = []

    def snap(ctx, m, i):
        for filtered in (False, True):
            last = ctx.last(filtered)
            seen.append((ctx.now, filtered, sorted(last.code), last.time.max()))
        if ctx.now.hour == 9:
            for s in sorted(m["symbol"]):
                ctx.order_target_value(s, 5000.0 if s in set(last.code) else 0.0, "t")
        assert len(ctx.message) == len(m) and ctx.message[m["symbol"].iloc[0]]["offer"] == m["offerPrice"].iloc[0][0]

    f = {n: (lambda *a: None) for n in B.CALLBACKS} | {"onSnapshot": snap}
    whole = B.simulate(prepared.messages.toPandas(), held[[*held.columns]], held[kept], f, B.check_config({"cash": 20000, "commission": 0.001}), {})
    by_memory, seen = seen, []
    stored = B.StoredPanel(panel, list(held.columns))
    assert stored.dates(pd.Timestamp("2024-01-12")) == B.HeldPanel(held, held[kept]).dates(pd.Timestamp("2024-01-12"))
    for filtered, start, end in ((True, None, None), (False, dt.date(2024, 1, 9), None), (False, None, dt.date(2024, 1, 10)), (True, dt.date(2024, 1, 9), dt.date(2024, 1, 20))):
        a, b = (p.rows(filtered, pd.Timestamp("2024-01-17"), start, end) for p in (stored, B.HeldPanel(held, held[kept])))
        assert a[["time", "code", "close"]].values.tolist() == b[["time", "code", "close"]].values.tolist()
    monkeypatch.setattr(B.DayTable, "read", counted)
    frames = (B._frame(messages.read(d, d)) for d in messages.days())
    got = list(B.run_days(frames, stored, f, B.check_config({"cash": 20000, "commission": 0.001}), {}))
    assert pd.DataFrame(got).equals(pd.DataFrame(whole)) and seen == by_memory
    assert max(sizes) == 2 * len(CODES)


def test_a_log_is_a_list(monkeypatch):
    monkeypatch.setattr(B.Log, "LOT", 4)
    log, want = B.Log(), []
    for i in range(11):
        log.append(i)
        want.append(i)
        assert list(log) == want and len(log) == len(want) and log[-1] == i and log[0] == 0 and len(log._tail) < 4
    assert log[2:9:3] == want[2:9:3] and 7 in log and log[-11] == 0
    with pytest.raises(IndexError):
        log[11]


def test_a_run_that_fails_late_gives_one_row(spark, market):
    late = "def onBar(context, message, indicator):\n    if len(context.trade_dates()) > 5:\n        raise KeyError('late')"
    prepared = B.prepare_backtest(request(callbacks=callbacks(onBar=late)), panel=market)
    assert [(r.kind, r.error) for r in prepared.run_many([{"run": 0}]).collect()] == [("error", "KeyError: 'late'")]
