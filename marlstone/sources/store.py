"""The long table with snapshots: sorted runs, a manifest for each version, merge on read of what is young, compaction as a job, and a ledger of ingested days.

A run is one append: Parquet by factor and month, keys unique, sorted by code and time. The manifest of a version lists the live parts (factor, month, run, sequence, rows) and the ledger's chunks; it is written under another name and renamed to its number, so a version is there whole or not at all, and of two writers that build on the same version one is refused. Readers keep the version they began with: files are never changed, and compaction only adds.

A month with one run is read as it lies, without a window or shuffle. Only months with several runs are merged, by the latest sequence of each key. Days that an ingest has committed are recorded in the same version as their rows, so an ingest that stops between chunks goes on at its first gap, and nothing is written twice.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .panel import clean_long, latest

ROW = "time timestamp_ntz, code string, value double, sequence long, run string, factor string, month string"
#: Days of a chunk, which is fetched, written and committed at once.
CHUNK_DAYS = 50


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


@dataclass(frozen=True)
class Part:
    factor: str
    month: str
    run: str
    sequence: int
    rows: int
    merged: bool = False


@dataclass
class Manifest:
    """A version of the table. chunks: (worker, first day, last day, rows)."""

    version: int = 0
    parts: list[Part] = field(default_factory=list)
    chunks: list[tuple] = field(default_factory=list)

    def months(self, factors=None, start: dt.date | None = None, end: dt.date | None = None) -> dict[tuple[str, str], list[Part]]:
        """Live parts by factor and month, those of a span alone."""
        out: dict[tuple[str, str], list[Part]] = {}
        for p in self.parts:
            if (factors is None or p.factor in factors) and (start is None or p.month >= start.strftime("%Y-%m")) and (end is None or p.month <= end.strftime("%Y-%m")):
                out.setdefault((p.factor, p.month), []).append(p)
        return out


class SnapshotTable:
    """The long table at a path of any store that renames without overwriting."""

    def __init__(self, spark: SparkSession, path: str, factors: Iterable[str] | None = None):
        self.spark, self.path, self.factors = spark, path.rstrip("/"), None if factors is None else set(factors)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        self._text = jvm.org.apache.commons.io.IOUtils.toString

    # Manifests.
    def versions(self) -> list[int]:
        where = self._path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, the latest if none is named; version 0 is empty."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return Manifest()
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version:012d}.json"))
        try:
            said = json.loads(self._text(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(version, [Part(*p) for p in said["parts"]], [tuple(c) for c in said["chunks"]])

    def commit(self, base: Manifest, parts: list[Part], chunks: list[tuple]) -> Manifest:
        """The version after base; Conflict if there is one already."""
        made = Manifest(base.version + 1, parts, chunks)
        final = self._path(f"{self.path}/manifests/{made.version:012d}.json")
        draft = self._path(f"{self.path}/manifests/{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"parts": [[p.factor, p.month, p.run, p.sequence, p.rows, p.merged] for p in parts], "chunks": chunks}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {made.version} of {self.path} is there already")
        return made

    # Rows.
    def _write(self, df: DataFrame) -> list[Part]:
        """A run of rows (time, code, factor, value, sequence, month) with unique keys; its parts, with the rows that can be read back."""
        run = uuid.uuid4().hex
        # Half a run's months may be one: the code spreads a month over tasks, each of which writes a sorted file.
        out = df.repartition("factor", "month", F.pmod(F.xxhash64("code"), F.lit(8))).sortWithinPartitions("factor", "month", "code", "time")
        where = f"{self.path}/runs/run={run}"
        out.write.partitionBy("factor", "month").parquet(where)
        written = self.spark.read.schema("sequence long, factor string, month string").parquet(where).groupBy("factor", "month").agg(F.max("sequence").alias("s"), F.count("*").alias("n"))
        return [Part(r["factor"], r["month"], run, r["s"], r["n"]) for r in written.collect()]

    def append(self, df: DataFrame, sequence: int, chunk: tuple[str, dt.date, dt.date] | None = None) -> Manifest:
        """Adds long rows under a sequence; later sequences win, and one that is there already is replaced: as a whole, or key by key in months that were compacted since. Rows without a key or finite value don't count; of equal keys one stays. Factors outside the declared list are refused. chunk: the worker and days that the ledger gets in the same version."""
        base = self.manifest()
        df = clean_long(df)
        if self.factors is not None:
            unknown = [r[0] for r in df.select("factor").distinct().where(~F.col("factor").isin(*self.factors)).limit(20).collect()]
            if unknown:
                raise ValueError(f"unknown factors {unknown}")
        parts = self._write(latest(df.withColumn("sequence", F.lit(sequence).cast("long"))).withColumns({"sequence": F.lit(sequence).cast("long"), "month": F.date_format("time", "yyyy-MM")}))
        chunks = base.chunks + ([(chunk[0], str(chunk[1]), str(chunk[2]), sum(p.rows for p in parts))] if chunk else [])
        return self.commit(base, [p for p in base.parts if p.sequence != sequence or p.merged] + parts, chunks)

    def _files(self, parts: list[Part]) -> DataFrame:
        paths = [f"{self.path}/runs/run={p.run}/factor={self._escaped(p.factor)}/month={p.month}" for p in parts]
        if not paths:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).option("basePath", f"{self.path}/runs").parquet(*paths)

    def _merged(self, parts: list[Part]) -> DataFrame:
        """Rows of parts that share months: of each key the latest sequence, of one sequence what came after a compaction."""
        own = self._files([p for p in parts if not p.merged]).withColumn("_own", F.lit(1)).unionByName(self._files([p for p in parts if p.merged]).withColumn("_own", F.lit(0)))
        order = W.partitionBy("factor", "time", "code").orderBy(F.desc("sequence"), F.desc("_own"))
        return own.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("time", "code", "factor", "value", "sequence", "month")

    def read(self, factors: Iterable[str] | None = None, start: dt.date | None = None, end: dt.date | None = None, version: int | None = None) -> DataFrame:
        """time, code, factor, value of a version (the latest if none is named), by factor and span."""
        months = self.manifest(version).months(None if factors is None else set(factors), start, end)
        columns = ["time", "code", "factor", "value"]
        out = self._files([p[0] for p in months.values() if len(p) == 1]).select(*columns)
        if young := [x for p in months.values() if len(p) > 1 for x in p]:
            out = out.unionByName(self._merged(young).select(*columns))
        if start is not None:
            out = out.where(F.col("time") >= F.lit(start).cast("timestamp_ntz"))
        return out if end is None else out.where(F.col("time") < F.lit(end + dt.timedelta(1)).cast("timestamp_ntz"))

    def compact(self, least_runs: int = 2) -> Manifest:
        """Months with at least so many runs become one run each, in a new version. Appends that another writer commits meanwhile are refused or refuse this one; neither is lost half-way."""
        base = self.manifest()
        many = {k: p for k, p in base.months().items() if len(p) >= max(2, least_runs)}
        if not many:
            return base
        old = [x for p in many.values() for x in p]
        # A part's sequence is the latest of all it was made from, even where none of that one's rows is left.
        made = [Part(p.factor, p.month, p.run, max(x.sequence for x in many[p.factor, p.month]), p.rows, True) for p in self._write(self._merged(old))]
        return self.commit(base, [p for p in base.parts if p not in set(old)] + made, base.chunks)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Runs that none of the last `keep` versions names are deleted, older versions with them; the runs' names. Not to be run beside a writer."""
        versions = self.versions()
        live = {p.run for v in versions[-keep:] for p in self.manifest(v).parts}
        where = self._path(f"{self.path}/runs")
        runs = [s.getPath() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        gone = [r for r in runs if r.getName().removeprefix("run=") not in live]
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:012d}.json"), False)
        for r in gone:
            self._fs.delete(r, True)
        return [r.getName().removeprefix("run=") for r in gone]

    # The ledger.
    def gaps(self, worker: str, start: dt.date, end: dt.date) -> list[tuple[dt.date, dt.date]]:
        """Stretches of days from start to end that no committed chunk of the worker covers, by an anti-join of days."""
        span = lambda a, b: F.explode(F.sequence(F.lit(a).cast("date"), F.lit(b).cast("date"))).alias("day")
        wanted = self.spark.range(1).select(span(start, end))
        done = [(dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for w, a, b, _ in self.manifest().chunks if w == worker]
        covered = self.spark.createDataFrame(done, "a date, b date").select(F.explode(F.sequence("a", "b")).alias("day"))
        missing = wanted.join(covered, "day", "left_anti")
        isle = F.date_sub("day", F.row_number().over(W.orderBy("day")).cast("int"))  # some thousands of days
        return [(r["a"], r["b"]) for r in missing.withColumn("isle", isle).groupBy("isle").agg(F.min("day").alias("a"), F.max("day").alias("b")).orderBy("a").collect()]

    def ingest(self, worker: str, fetch: Callable[[dt.date, dt.date], DataFrame], start: dt.date, end: dt.date, days: int = CHUNK_DAYS) -> int:
        """Fetches what the ledger lacks between two days in chunks of at most so many, each committed with its rows; the number of chunks. An unbroken ingest and one that was stopped and called again end with the same rows."""
        n = 0
        for a, b in self.gaps(worker, start, end):
            while a <= b:
                last = min(b, a + dt.timedelta(days - 1))
                self.append(fetch(a, last), self._next(), (worker, a, last))
                a, n = last + dt.timedelta(1), n + 1
        return n

    def _next(self) -> int:
        return max((p.sequence for p in self.manifest().parts), default=0) + 1
