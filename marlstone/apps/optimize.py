"""Walk-forward optimisation and sensitivity analysis of backtests."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from calendar import monthrange
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from ..plans.request import parse_date
from ..plans.spec import RequestError
from .backtest import BacktestRequest, Prepared, check_config, prepare_backtest, summary
from .search import ALGORITHMS, Grid, steps, together

MAX_COMBINATIONS, MAX_CASES = 100_000, 100


def parse_period(value: Any, where: str) -> str:
    m = re.fullmatch(r"\s*([1-9]\d*)\s*([DWMYdwmy])\s*", value) if isinstance(value, str) else None
    if not m:
        raise RequestError(f"{where} must be like 30D, 2W, 6M or 1Y")
    return m[1] + m[2].upper()


def shift(day: dt.date, period: str, times: int = 1) -> dt.date:
    """day moved by `times` periods; the day of month is clamped to the month's length."""
    n, unit = int(period[:-1]) * times, period[-1]
    if unit in "DW":
        return day + dt.timedelta(days=n * (7 if unit == "W" else 1))
    months = day.year * 12 + day.month - 1 + n * (12 if unit == "Y" else 1)
    year, month = months // 12, months % 12 + 1
    return dt.date(year, month, min(day.day, monthrange(year, month)[1]))


@dataclass(frozen=True)
class Window:
    number: int
    training_start: dt.date
    training_end: dt.date
    holding_start: dt.date
    holding_end: dt.date


def walk_forward(start: dt.date, end: dt.date, lookback: str, holding: str) -> list[Window]:
    """Holding windows one after another, each start counted from the first so that month ends don't drift; training ends the day before."""
    out: list[Window] = []
    at = start
    while at <= end:
        following = shift(start, holding, len(out) + 1)
        out.append(Window(len(out) + 1, shift(at, lookback, -1), at - dt.timedelta(1), at, min(end, following - dt.timedelta(1))))
        at = following
    return out


@dataclass
class OptimizationRequest:
    backtest: BacktestRequest
    grid: Grid
    algorithms: list[str]
    windows: list[Window]
    repetitions: int = 1
    budget: int = 12
    seed: int = 20260815

    KEYS = ("parameter_space", "algorithms", "start_date", "end_date", "lookback_period", "holding_period", "repetitions", "evaluation_budget", "seed")

    @classmethod
    def parse(cls, value: Any) -> OptimizationRequest:
        backtest = BacktestRequest.parse(value, cls.KEYS)
        space = value.get("parameter_space")
        if not isinstance(space, dict) or not space:
            raise RequestError("parameter_space must name values")
        for name, values in space.items():
            if not isinstance(values, list) or not 2 <= len(values) <= 100 or any(isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) for v in values) or len(set(map(float, values))) < len(values):
                raise RequestError(f"parameter_space {name!r} must be 2 to 100 different finite numbers")
            if name not in backtest.params:
                raise RequestError(f"params have no {name!r}")
        grid = Grid(space)
        if grid.size > MAX_COMBINATIONS:
            raise RequestError(f"more than {MAX_COMBINATIONS} combinations")
        algorithms = value.get("algorithms")
        if not isinstance(algorithms, list) or not algorithms or set(algorithms) - set(ALGORITHMS) or len(set(algorithms)) < len(algorithms):
            raise RequestError(f"algorithms must be some of {list(ALGORITHMS)}, each once")
        start, end = parse_date(value.get("start_date"), "start_date"), parse_date(value.get("end_date"), "end_date")
        if start > end:
            raise RequestError("start_date lies after end_date")
        windows = walk_forward(start, end, parse_period(value.get("lookback_period"), "lookback_period"), parse_period(value.get("holding_period"), "holding_period"))
        numbers = {}
        for key, default, low, high in (("repetitions", 1, 1, 100), ("evaluation_budget", 12, 2, 100), ("seed", 20260815, 0, 2**31 - 1)):
            n = numbers[key] = value.get(key, default)
            if type(n) is not int or not low <= n <= high:
                raise RequestError(f"{key} must be a whole number from {low} to {high}")
        return cls(backtest, grid, algorithms, windows, numbers["repetitions"], numbers["evaluation_budget"], numbers["seed"])


def _net_values(rows: DataFrame) -> dict[int, tuple[list, str | None]]:
    """Daily (date, net value, total fee, ratio) and error by run: one number a day and run comes to the driver, as a search must see its scores."""
    out: dict[int, tuple[list, str | None]] = {}
    for r in rows.where("kind in ('portfolio', 'error')").select("run", "kind", "time", "net_value", "total_fee", "ratio", "error").collect():
        days, error = out.setdefault(r["run"], ([], None))
        if r["kind"] == "error":
            out[r["run"]] = (days, r["error"])
        else:
            days.append((r["time"].date(), r["net_value"], r["total_fee"], r["ratio"]))
    for days, _ in out.values():
        days.sort()
    return out


RESULT = "time date, window_net_value double, daily_return double, path_net_value double, algorithm string, repetition int, window int, training_start date, training_end date, holding_start date, holding_end date, training_sharpe double, evaluation_count int, initial_params string, selected_params string"


def optimize_backtest(request: Any, long: DataFrame | None = None, panel: DataFrame | None = None) -> DataFrame:
    """Per algorithm and repetition the chained out-of-sample path: in each window parameters are chosen by training Sharpe ratio and then held.

    Training scores are cached by (window, candidate) over all algorithms. The whole data span is prepared once. All searches advance in rounds: what they propose in a round is one parallel job, and so are all holding runs.
    """
    r = OptimizationRequest.parse(request)
    return _optimize(r, prepare_backtest(r.backtest, long, panel))


def _optimize(r: OptimizationRequest, prepared: Prepared) -> DataFrame:
    b, scores = r.backtest, {}

    def run_params(index: int) -> dict:
        return b.params | r.grid.params(index)

    def score(asked: list) -> dict:
        new = list(dict.fromkeys((k[2], i) for k, i in asked if (k[2].number, i) not in scores))
        got = _net_values(prepared.run_many([{"run": n, "params": run_params(i), "start": w.training_start, "end": w.training_end} for n, (w, i) in enumerate(new)], ("portfolio",))) if new else {}
        for n, (w, i) in enumerate(new):
            days, error = got.get(n, ([], "no result"))
            values = np.array([d[1] for d in days], dtype=float)
            scores[w.number, i] = None if error or not len(values) else summary(values, b.annual_trading_days, b.risk_free_rate)["sharpeRatio"]
        return {(k, i): scores[k[2].number, i] for k, i in asked}

    searches = {(name, rep, w): steps(name, r.grid, r.budget, r.seed + 1_000_003 * a + 1009 * rep + w.number) for a, name in enumerate(r.algorithms) for rep in range(1, r.repetitions + 1) for w in r.windows}
    found = together(searches, score)
    chosen = {k: found[k] for k in searches}
    plan = list(chosen)
    held = _net_values(prepared.run_many([{"run": n, "params": run_params(chosen[k].selected_index), "start": k[2].holding_start, "end": k[2].holding_end} for n, k in enumerate(plan)], ("portfolio",)))
    rows, paths = [], {}
    for n, (name, rep, w) in enumerate(plan):
        s = chosen[name, rep, w]
        days, error = held.get(n, ([], "no result"))
        if error:
            raise RuntimeError(f"{name}, window {w.number}: {error}")
        base = paths.get((name, rep), 1.0)
        before = 1.0
        for day, value, _, _ in days:
            rows.append((day, value, value / before - 1, base * value, name, rep, w.number, w.training_start, w.training_end, w.holding_start, w.holding_end, s.score if math.isfinite(s.score) else None, len(s.evaluated), json.dumps(r.grid.params(s.initial_index), sort_keys=True), json.dumps(r.grid.params(s.selected_index), sort_keys=True)))
            before = value
        paths[name, rep] = base * before
    return prepared.messages.sparkSession.createDataFrame(rows, RESULT)


CASE = "case_index long, analysis_type string, params string, commission double, status string, error string, total_return double, cagr double, sharpe double, sortino double, volatility double, max_drawdown double, win_rate double, calmar double, total_fee double"


def sortino(returns: np.ndarray, annual_days: int, risk_free: float) -> float | None:
    excess = returns - ((1 + risk_free) ** (1 / annual_days) - 1)
    downside = math.sqrt((np.minimum(excess, 0) ** 2).sum() / len(excess)) if len(excess) else 0
    return float(excess.mean() / downside * math.sqrt(annual_days)) if downside else None


def check_cases(b: BacktestRequest, kind: Any, cases: Any) -> list[dict]:
    if kind not in ("fee_analysis", "sensitivity"):
        raise RequestError("analysis_type must be fee_analysis or sensitivity")
    if not isinstance(cases, list) or not 1 <= len(cases) <= MAX_CASES:
        raise RequestError(f"cases must be 1 to {MAX_CASES}")
    seen = set()
    for i, c in enumerate(cases, 1):
        if not isinstance(c, dict) or set(c) != {"params", "commission"} or not isinstance(c["params"], dict):
            raise RequestError(f"case {i} must have params and commission")
        if isinstance(c["commission"], bool) or not isinstance(c["commission"], (int, float)) or not 0 <= c["commission"] <= 1:
            raise RequestError(f"case {i}: commission must lie in 0..1")
        if set(c["params"]) != set(b.params):
            raise RequestError(f"case {i} must give the parameters of the backtest")
        for k, v in c["params"].items():
            base, number = b.params[k], lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
            if v is not None and not isinstance(v, (str, int, float, bool)) or isinstance(v, float) and not math.isfinite(v):
                raise RequestError(f"case {i}: {k} must be a simple value")
            if base is not None and v is not None and not (number(base) and number(v)) and type(base) is not type(v):
                raise RequestError(f"case {i}: {k} changes its type")
        same = c["params"] == b.params if kind == "fee_analysis" else c["commission"] == b.config["commission"]
        if not same:
            raise RequestError(f"case {i}: {kind} may only change {'the commission' if kind == 'fee_analysis' else 'params'}")
        key = json.dumps(c, sort_keys=True)
        if key in seen:
            raise RequestError(f"case {i} repeats another")
        seen.add(key)
    return cases


def analyze_sensitivity(request: Any, long: DataFrame | None = None, panel: DataFrame | None = None) -> DataFrame:
    """One row per case, SUCCESS with figures or FAILURE with the error; all cases run side by side over data prepared once."""
    b = BacktestRequest.parse(request, ("analysis_type", "cases"))
    kind, cases = request.get("analysis_type"), check_cases(b, request.get("analysis_type"), request.get("cases"))
    prepared = prepare_backtest(b, long, panel)
    got = _net_values(prepared.run_many([{"run": i, "params": c["params"], "config": check_config(b.config | {"commission": c["commission"]})} for i, c in enumerate(cases)], ("portfolio",)))
    rows = []
    for i, c in enumerate(cases):
        days, error = got.get(i, ([], "no result"))
        values = np.array([d[1] for d in days], dtype=float)
        if not error and (not len(values) or not (values > 0).all()):
            error = "the net values are not all positive"
        head = (i, kind, json.dumps(c["params"], sort_keys=True), float(c["commission"]))
        if error:
            rows.append((*head, "FAILURE", error, *[None] * 9))
            continue
        s = summary(values, b.annual_trading_days, b.risk_free_rate)
        returns = np.array([d[3] or 0.0 for d in days], dtype=float)
        rows.append((*head, "SUCCESS", None, s["totalReturn"], s["annualReturn"], s["sharpeRatio"], sortino(returns, b.annual_trading_days, b.risk_free_rate), s["annualVolatility"], -abs(s["maxDrawdown"]), s["dailyWinningRate"], s["drawdownRatio"], float(days[-1][2])))
    return prepared.messages.sparkSession.createDataFrame(rows, CASE)
