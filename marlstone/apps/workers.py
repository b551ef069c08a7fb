"""Ingestion transforms: raw rows of market-data providers to the long table. Fetching itself is left to whoever has access; these take DataFrames."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.panel import CoreTable, clean_long

# Names of stored factors.
DAILY = ("open", "high", "low", "close", "pre_close", "change", "pct_chg", "vol", "amount")
LIMITS = ("up_limit", "down_limit")
QUARTERS = {"0331": 1, "0630": 2, "0930": 3, "1231": 4}


def to_long(df: DataFrame, factors: Iterable[str], time: str = "trade_date", code: str = "ts_code", pattern: str = "yyyyMMdd") -> DataFrame:
    """Wide provider rows as long rows: dates parsed, factors unpivoted, what can't be stored left out, of equal keys one row (the largest value) kept."""
    kinds = dict(df.dtypes)
    t = F.to_timestamp_ntz(F.col(time), F.lit(pattern)) if kinds[time] == "string" else F.col(time).cast("timestamp_ntz")
    present = [f for f in factors if f in df.columns]
    wide = df.select(t.alias("time"), F.col(code).alias("code"), *[F.col(f"`{f}`").try_cast("double").alias(f) for f in present])
    long = wide.unpivot(["time", "code"], present, "factor", "value")
    return clean_long(long).groupBy("time", "code", "factor").agg(F.max("value").alias("value"))


def adjusted(df: DataFrame, prices: Iterable[str] = ("open", "high", "low", "close", "pre_close")) -> DataFrame:
    """Back-adjusted prices <p>_hfq from prices and adj_factor, and pct_chg_hfq by code and date."""
    out = df.withColumns({f"{p}_hfq": F.col(p) * F.col("adj_factor") for p in prices if p in df.columns})
    before = F.lag("close_hfq").over(W.partitionBy("ts_code").orderBy("trade_date"))
    return out.withColumn("pct_chg_hfq", F.when(before != 0, (F.col("close_hfq") / before - 1) * 100))


def suspended_flag(names: DataFrame, days: DataFrame) -> DataFrame:
    """is_st rows (1) for the trading days in each period (ts_code, start_date, end_date) of a special-treatment name."""
    hit = days.join(names, (F.col("day") >= F.col("start_date")) & (F.col("day") <= F.coalesce("end_date", F.lit(dt.date(9999, 12, 31)))))
    return hit.select(F.col("day").cast("timestamp_ntz").alias("time"), F.col("ts_code").alias("code"), F.lit("is_st").alias("factor"), F.lit(1.0).alias("value")).distinct()


def index_weights(df: DataFrame, index: str | None = None) -> DataFrame:
    """Members of indices (index_code, con_code, trade_date, weight) as factors weight_<INDEX>, dots left out: one factor an index_code, or that of `index` alone."""
    rows = df.where(F.col("index_code") == index if index else F.col("index_code").isNotNull())
    name = F.concat(F.lit("weight_"), F.replace("index_code", F.lit("."), F.lit("")))
    return clean_long(rows.select(F.to_timestamp_ntz("trade_date", F.lit("yyyyMMdd")).alias("time"), F.col("con_code").alias("code"), name.alias("factor"), F.col("weight").cast("double").alias("value")))


def first_reports(df: DataFrame, announced: str = "f_ann_date", period: str = "end_date", code: str = "ts_code", tie: str | None = None) -> DataFrame:
    """Reports that were news: in order of announcement (later rows of a day by `tie`) only those of a later period than all before, and of several on one day the last."""
    order = [F.col(announced), *([F.col(tie)] if tie else []), F.col(period)]
    before = F.max(period).over(W.partitionBy(code).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    news = df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(period) > F.col("_before"))).drop("_before")
    last = F.row_number().over(W.partitionBy(code, announced).orderBy(F.col(period).desc()))
    return news.withColumn("_last", last).where("_last = 1").drop("_last")


def with_quarter(df: DataFrame, period: str = "end_date") -> DataFrame:
    """end_type 1..4 from the report's end date (yyyymmdd); other dates are left out."""
    kind = F.lit(None).cast("int")
    for ending, n in QUARTERS.items():
        kind = F.when(F.substring(period, 5, 4) == ending, n).otherwise(kind)
    return df.withColumn("end_type", kind).where("end_type is not null")


def flows(df: DataFrame, factors: Iterable[str], code: str = "ts_code", announced: str = "f_ann_date", period: str = "end_date") -> DataFrame:
    """Cumulated report items as <f>_1.._4 (the item in reports of that quarter) and <f>_ttm: the item, plus last year's annual one, less last year's of the same quarter."""
    factors = [f for f in factors if f in df.columns]
    year = F.year(F.to_date(period, "yyyyMMdd"))
    rows = df.withColumn("_year", year)
    # Last year's figures by quarter: the first report of each, as one small row per code and year.
    first = F.row_number().over(W.partitionBy(code, "_year", "end_type").orderBy(period, announced))
    once = rows.withColumn("_first", first).where("_first = 1")
    pick = lambda f, q: F.max(F.when(F.col("end_type") == q, F.struct(F.col(f).cast("double").alias("v"))))["v"]
    past = once.groupBy(F.col(code).alias("_code"), (F.col("_year") + 1).alias("_next")).agg(*[pick(f, q).alias(f"_{f}_{q}") for f in factors for q in (1, 2, 3, 4)])
    out = rows.join(past, (F.col(code) == F.col("_code")) & (F.col("_year") == F.col("_next")), "left")
    made = {}
    for f in factors:
        value = F.col(f).cast("double")
        same = F.lit(None).cast("double")
        for q in (1, 2, 3, 4):
            made[f"{f}_{q}"] = F.when(F.col("end_type") == q, value)
            same = F.when(F.col("end_type") == q, F.col(f"_{f}_{q}")).otherwise(same)
        made[f"{f}_ttm"] = F.when(F.col("end_type") == 4, value).otherwise(value + F.col(f"_{f}_4") - same)
    return out.withColumns(made).drop("_year", "_code", "_next", *[f"_{f}_{q}" for f in factors for q in (1, 2, 3, 4)])


def clean_dividends(df: DataFrame, key: tuple = ("symbol", "recordDate", "exDate"), needed: tuple = ("endDate", "recordDate", "exDate")) -> DataFrame:
    """Rows with all needed dates; of equal keys the one announced last."""
    for c in needed:
        df = df.where(F.col(c).isNotNull())
    order = [F.col(c).desc_nulls_last() for c in ("annDate", "impAnnDate") if c in df.columns] + [F.col("endDate").desc()]
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def date_watermark(long: DataFrame, factors: list[str], codes: list[str] | None = None) -> dt.date | None:
    """The latest day that all factors have reached: it is fetched again, as its batch may have been cut short. None if a factor has no rows."""
    rows = long.where(F.col("factor").isin(factors))
    if codes is not None:
        rows = rows.where(F.col("code").isin(codes))
    got = {r[0]: r[1] for r in rows.groupBy("factor").agg(F.max("time")).collect()}  # one row a factor
    return min(got.values()).date() if set(got) == set(factors) and got else None


def code_watermarks(long: DataFrame, factors: list[str]) -> DataFrame:
    """(code, next_date): the day after each code's latest row."""
    return long.where(F.col("factor").isin(factors)).groupBy("code").agg(F.date_add(F.max("time").cast("date"), 1).alias("next_date"))


@dataclass
class Attempt:
    number: int
    started_at: str
    finished_at: str
    status: str
    error: str | None = None


@dataclass
class WorkerResult:
    """What a worker run did, as JSON for whoever schedules it."""

    worker: str
    job_id: str
    workflow: str = "ingest"
    schema_version: int = 1
    status: str = "running"
    started_at: str = ""
    finished_at: str = ""
    duration_seconds: float = 0.0
    metrics: dict = field(default_factory=dict)
    attempts: list[Attempt] = field(default_factory=list)
    error: dict | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)


# Workers: what each stores, and how its raw rows become long rows. The names.
WORKERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "daily": lambda df: to_long(df, DAILY),
    "fund-daily": lambda df: to_long(df, DAILY),
    "fund-adj-factor": lambda df: to_long(df, ["adj_factor"]),
    "limit": lambda df: to_long(df, LIMITS),
    "daily-basic": lambda df: to_long(df, [c for c in df.columns if c not in ("ts_code", "trade_date", "close")]),
    "adj-factor": lambda df: to_long(df, ["adj_factor"]),
    "hfq": lambda df: to_long(adjusted(df), [f"{c}_hfq" for c in ("open", "high", "low", "close", "pre_close", "pct_chg")]),
    "st": lambda df: to_long(df.withColumn("is_st", F.lit(1.0)), ["is_st"]),
    "balance-sheet": lambda df: _reports(df, True),
    "income": lambda df: _reports(df, True),
    "cashflow": lambda df: _reports(df, True),
    "fina-indicator": lambda df: _reports(df, False, "ann_date"),
    "dividend": clean_dividends,
    "index-weight": index_weights,
}
_KEYS = ("ts_code", "end_date", "f_ann_date", "ann_date", "end_type", "report_type", "comp_type")


def _reports(df: DataFrame, cumulated: bool, announced: str = "f_ann_date") -> DataFrame:
    news = first_reports(with_quarter(df), announced)
    items = [c for c in df.columns if c not in _KEYS]
    if not cumulated:
        return to_long(news, items, announced)
    return to_long(flows(news, items, announced=announced), [f"{c}_{s}" for c in items for s in ("ttm", 1, 2, 3, 4)], announced)


def run_worker(name: str, raw: Callable[[], DataFrame], store: CoreTable, sequence: int, job_id: str = "local", attempts: int = 3) -> WorkerResult:
    """Fetches, transforms and appends, again after a failure; the result tells each attempt."""
    if name not in WORKERS:
        raise KeyError(f"no worker {name!r}; there are {sorted(WORKERS)}")
    now = lambda: dt.datetime.now(dt.timezone.utc).isoformat()
    out, began = WorkerResult(name, job_id, started_at=now()), time.monotonic()
    for n in range(1, attempts + 1):
        started = now()
        try:
            rows = WORKERS[name](raw())
            store.append(rows, sequence)
            out.attempts.append(Attempt(n, started, now(), "success"))
            out.status, out.error = "success", None
            break
        except Exception as e:  # recorded, and tried again
            out.attempts.append(Attempt(n, started, now(), "failure", str(e)[:500]))
            out.status, out.error = "failure", {"type": type(e).__name__, "message": str(e)[:500]}
    out.finished_at, out.duration_seconds = now(), round(time.monotonic() - began, 3)
    return out
