"""Tables that driver and executors share as files, and lists of a task that outgrow its memory."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group of a table that is read by days.
ROW_GROUP = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A folder of our own only where that is unset and the master is local; on a cluster that would be a folder of one machine, so it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, tag: str, options: dict | None = None) -> str:
    """Writes df as Parquet into the shared folder; the path with its scheme, as Spark resolves it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(there).toString()


def written_by_day(df: DataFrame, tag: str, time: str, then: str) -> str:
    """Writes df in order of its times, and of `then` among equal ones, for DayTable: row groups are small, and __day is the day's number."""
    ordered = df.withColumn("__day", F.unix_date(F.to_date(time))).repartitionByRange(time, then).sortWithinPartitions(time, then)
    return written(ordered, tag, {"parquet.block.size": str(ROW_GROUP)})


def _located(path: str):
    """(file system, path there) of a path with its scheme."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


class DayTable:
    """A table of written_by_day, read inside a task a stretch of days at a time: of each file only the row groups that such days stand in."""

    def __init__(self, path: str):
        from pyarrow import fs
        from pyarrow import parquet as pq

        self._system, where = _located(path)
        self._groups = []  # (file, row group, its first day, its last day), in order
        for f in sorted(i.path for i in self._system.get_file_info(fs.FileSelector(where)) if i.base_name.startswith("part-")):
            with pq.ParquetFile(f, filesystem=self._system) as file:
                self.schema, about = file.schema_arrow, file.metadata
                place = next(k for k in range(about.num_columns) if about.schema.column(k).path == "__day")
                for g in range(file.num_row_groups):
                    seen = about.row_group(g).column(place).statistics
                    self._groups.append((f, g, seen.min, seen.max))

    def read(self, first: int, last: int, columns: list[str] | None = None):
        """The rows of the days from first to last, in order, as Arrow."""
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import parquet as pq

        wanted = columns if columns is None else list(dict.fromkeys([*columns, "__day"]))
        out = []
        for f in dict.fromkeys(g[0] for g in self._groups if g[2] <= last and g[3] >= first):
            with pq.ParquetFile(f, filesystem=self._system) as file:
                for _, g, low, high in (x for x in self._groups if x[0] == f and x[2] <= last and x[3] >= first):
                    got = file.read_row_group(g, columns=wanted, use_threads=False)
                    if low < first or high > last:
                        got = got.filter(pc.and_(pc.greater_equal(got.column("__day"), first), pc.less_equal(got.column("__day"), last)))
                    out.append(got if columns is None else got.select(columns))
        if out:
            return pa.concat_tables(out)
        none = self.schema.empty_table()
        return none if columns is None else none.select(columns)

    def days(self) -> list[int]:
        """The days that there are rows of."""
        out: set[int] = set()
        for _, _, low, high in self._groups:
            out |= {low, high} if high - low < 2 else set(self.read(low, high, ["__day"]).column(0).unique().to_pylist())
        return sorted(out)
