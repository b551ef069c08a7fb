"""The stored long table and the dense panel that queries work on."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG = T.StructType([T.StructField("time", T.TimestampNTZType()), T.StructField("code", T.StringType()), T.StructField("factor", T.StringType()), T.StructField("value", T.DoubleType())])


def _span(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    t = F.col("time")
    return df.where((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end + dt.timedelta(1)).cast("timestamp_ntz")))


def universe(long: DataFrame, start: dt.date, end: dt.date, codes: list[str] | None = None, price: str = "close") -> DataFrame:
    """(time, code, selected): trading days (days with a price row of anyone) by codes (those given, else all with a price row). Both sides are distinct lists: days of a few decades, codes of a market."""
    spark = long.sparkSession
    priced = _span(long.where(F.col("factor") == price), start, end)
    days = priced.select(F.date_trunc("day", "time").cast("timestamp_ntz").alias("time")).distinct()
    members = spark.createDataFrame([(c,) for c in codes], "code string") if codes else priced.select("code").distinct()
    return days.crossJoin(members).withColumn("selected", F.lit(True))


def wide(long: DataFrame, factors: list[str]) -> DataFrame:
    """Pivot with the factor list given, so no extra pass looks for it; missing factors become NULL columns."""
    out = long.groupBy("time", "code").pivot("factor", factors).agg(F.first("value", ignorenulls=True)) if factors else long.select("time", "code").distinct()
    return out.select("time", "code", *[F.col(f"`{f}`").cast("double").alias(f) for f in factors])


def fill_constant(df: DataFrame, columns: Iterable[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(value)) for c in columns}) if columns else df


def fill_observed(df: DataFrame, columns: Iterable[str], value: float = 0.0, by: str = "time") -> DataFrame:
    """Fills a column only in groups that hold some value of it."""
    w = W.partitionBy(by)
    return df.withColumns({c: F.when(F.max(F.col(f"`{c}`").isNotNull()).over(w), F.coalesce(F.col(f"`{c}`"), F.lit(value))) for c in columns}) if columns else df


def forward_fill(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    w = W.partitionBy("code").orderBy("time").rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns({c: F.last(F.col(f"`{c}`"), ignorenulls=True).over(w) for c in columns}) if columns else df


def financial(factor: str) -> bool:
    """Report items: trailing sums and single quarters."""
    return factor.endswith(("_ttm", "_1", "_2", "_3", "_4"))


def build_panel(long: DataFrame, factors: list[str], start: dt.date, end: dt.date, codes: list[str] | None = None, is_financial: Callable[[str], bool] = financial) -> DataFrame:
    """The dense panel (time, code, one double per factor) of trading days by codes.

    Rows off the calendar (announcements on a holiday) take part in forward filling and are dropped after. is_st is 0 where missing; weight_* is 0 for codes left out on a day with weights, then carried forward; report items are carried forward.
    """
    days = universe(long, start, end, codes)
    events = _span(long.where(F.col("factor").isin(factors)), start, end)
    if codes:
        events = events.where(F.col("code").isin(codes))
    timeline = days.unionByName(events.select("time", "code", F.lit(False).alias("selected"))).groupBy("time", "code").agg(F.max("selected").alias("selected"))
    panel = timeline.join(wide(events, factors), ["time", "code"], "left")
    weights = [f for f in factors if f.startswith("weight_")]
    panel = fill_constant(panel, [f for f in factors if f == "is_st"])
    panel = fill_observed(panel, weights)
    panel = forward_fill(panel, [*weights, *[f for f in factors if is_financial(f) and f not in weights]])
    return panel.where("selected").select("time", "code", *[F.col(f"`{f}`") for f in factors])


def latest(long: DataFrame, sequence: str = "sequence") -> DataFrame:
    """One row per (time, code, factor): the one with the largest ingest sequence."""
    w = W.partitionBy("time", "code", "factor").orderBy(F.col(sequence).desc())
    return long.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select("time", "code", "factor", "value")


def clean_long(df: DataFrame) -> DataFrame:
    """Rows that may be stored: keys known, value finite."""
    v = F.col("value")
    return df.where(F.col("time").isNotNull() & F.col("code").isNotNull() & F.col("factor").isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select([F.col(f.name).cast(f.dataType) for f in LONG.fields])


class CoreTable:
    """The long table as Parquet, partitioned by factor and month, each file sorted by code and time; later appends win."""

    def __init__(self, spark: SparkSession, path: str, factors: Iterable[str] | None = None):
        self.spark, self.path, self.factors = spark, path, None if factors is None else set(factors)

    def append(self, df: DataFrame, sequence: int) -> None:
        """Adds rows under an ingest sequence number. Factors outside the declared list are refused."""
        df = clean_long(df)
        if self.factors is not None:
            unknown = [r[0] for r in df.select("factor").distinct().where(~F.col("factor").isin(*self.factors)).limit(20).collect()]
            if unknown:
                raise ValueError(f"unknown factors {unknown}")
        out = df.withColumn("sequence", F.lit(sequence).cast("long")).withColumn("month", F.date_format("time", "yyyy-MM"))
        # The month spreads a factor; the number of rows in a partition folder is bounded by codes times days of a month.
        out.repartition("factor", "month").sortWithinPartitions("code", "time").write.mode("append").partitionBy("factor", "month").parquet(self.path)

    def read(self, factors: Iterable[str] | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """Rows by factor and span: both prune partitions; the latest sequence of a key counts."""
        df = self.spark.read.schema("time timestamp_ntz, code string, value double, sequence long, factor string, month string").parquet(self.path)
        if factors is not None:
            df = df.where(F.col("factor").isin(*factors))
        if start is not None:
            df = df.where((F.col("month") >= start.strftime("%Y-%m")) & (F.col("time") >= F.lit(start).cast("timestamp_ntz")))
        if end is not None:
            df = df.where((F.col("month") <= end.strftime("%Y-%m")) & (F.col("time") < F.lit(end + dt.timedelta(1)).cast("timestamp_ntz")))
        return latest(df)


def append_dimension(df: DataFrame, path: str, key: list[str], required: list[str]) -> None:
    """Appends dimension rows (such as dividends): rows without a required column are refused, of equal keys in the batch the last by all columns stays."""
    if df.where(~_all_there(required)).limit(1).count():
        raise ValueError(f"{required} may not be null")
    w = W.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in df.columns if c not in key])
    df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank").write.mode("append").parquet(path)


def _all_there(columns: list[str]):
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull()
    return good


def write_result(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A result as Parquet, on any store that Spark writes to."""
    df.write.mode(mode).parquet(path)
