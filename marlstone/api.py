"""The entry points in one place."""

from .apps.backtest import BacktestRequest, BacktestResult, run_backtest
from .apps.factor import FactorRequest, FactorResult, analyze_factors
from .apps.optimize import OptimizationRequest, analyze_sensitivity, optimize_backtest, walk_forward
from .apps.workers import WORKERS, run_worker
from .plans.request import Query
from .plans.spec import OPERATORS, RequestError, operator
from .query import QueryResult, execute_query
from .sources.panel import CoreTable, build_panel
from .streaming.ingest import stream_into

analyze_backtest_sensitivity = analyze_sensitivity

__all__ = [
    "BacktestRequest",
    "BacktestResult",
    "CoreTable",
    "FactorRequest",
    "FactorResult",
    "OPERATORS",
    "OptimizationRequest",
    "Query",
    "QueryResult",
    "RequestError",
    "WORKERS",
    "analyze_backtest_sensitivity",
    "analyze_factors",
    "analyze_sensitivity",
    "build_panel",
    "execute_query",
    "operator",
    "optimize_backtest",
    "run_backtest",
    "run_worker",
    "stream_into",
    "walk_forward",
]
