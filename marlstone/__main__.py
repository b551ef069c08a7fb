"""python -m marlstone: queries, analyses and workers from JSON requests and Parquet tables."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("query", "run a factor query"), ("factor", "run a factor analysis"), ("backtest", "run a backtest"), ("optimize", "run a walk-forward optimisation"), ("sensitivity", "run a sensitivity analysis")):
        c = sub.add_parser(name, help=text)
        c.add_argument("request", help="JSON file")
        table = c.add_mutually_exclusive_group(required=True)
        table.add_argument("--long", help="Parquet of time, code, factor, value")
        table.add_argument("--panel", help="Parquet of time, code and factor columns")
        c.add_argument("--out", required=True, help="folder for Parquet results")
        if name == "factor":
            c.add_argument("--industries", help="Parquet of code, industry")
    c = sub.add_parser("worker", help="append a provider's rows to the long table")
    c.add_argument("name")
    c.add_argument("raw", help="Parquet of the provider's rows")
    c.add_argument("table", help="folder of the long table")
    c.add_argument("--sequence", type=int, required=True, help="ingest number; larger ones win")
    sub.add_parser("workers", help="list the workers")
    c = sub.add_parser("message", help="deliver a message")
    c.add_argument("path")
    c.add_argument("--channel", default="console")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from .apps.messages import read_message, send_message
    from .apps.workers import WORKERS, run_worker
    from .plans.spec import RequestError

    if a.command == "workers":
        print("\n".join(sorted(WORKERS)))
        return 0
    try:
        if a.command == "message":
            result = send_message(read_message(a.path), a.channel)
            print(json.dumps(result))
            return int(result["status"] != "SUCCESS")
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if a.command == "worker":
            from .sources.panel import CoreTable

            result = run_worker(a.name, lambda: spark.read.parquet(a.raw), CoreTable(spark, a.table), a.sequence)
            print(result.to_json())
            return int(result.status != "success")
        with open(a.request, encoding="utf-8") as f:
            request = json.load(f)
        request = request.get("dataset_query", request) if a.command == "query" else request
        tables = {"long": spark.read.parquet(a.long)} if a.long else {"panel": spark.read.parquet(a.panel)}
        for name, df in results(a, request, tables, spark).items():
            df.write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/{name}")
        return 0
    except RequestError as e:
        print(e, file=sys.stderr)
        return 2


def results(a: argparse.Namespace, request: dict, tables: dict, spark) -> dict:
    from .apps.backtest import run_backtest
    from .apps.factor import analyze_factors
    from .apps.optimize import analyze_sensitivity, optimize_backtest
    from .query import execute_query

    if a.command == "query":
        return {"data": execute_query(request, **tables).data}
    if a.command == "factor":
        r = analyze_factors(request, **tables, industries=spark.read.parquet(a.industries) if a.industries else None)
        return {"processed": r.processed, "information_coefficient": r.information_coefficient, "group_returns": r.group_returns}
    if a.command == "backtest":
        r = run_backtest(request, **tables)
        return {n: getattr(r, n) for n in ("trade_details", "daily_positions", "daily_portfolios", "daily_trading_statistics", "orders")}
    return {"result": (optimize_backtest if a.command == "optimize" else analyze_sensitivity)(request, **tables)}


if __name__ == "__main__":
    sys.exit(main())
