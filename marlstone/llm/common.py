"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words by ASCII white space; bytes.split() in Python splits at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. A folder of our own is set only where that is unset and the master is local, as in tests; on a cluster that would be a folder of one machine, so it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="marlstone-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def saved(df: DataFrame, tag: str, narrow: bool = False) -> DataFrame:
    """df, written once as Parquet in the shared folder and reread: cuts the lineage and survives lost executors. narrow: rows of a few numbers and far fewer than the input's, so a sixth of the shuffle partitions writes them, which spares the store thousands of tiny files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    (_fewer(df) if narrow else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fewer(df: DataFrame) -> DataFrame:
    return df.coalesce(max(2, -(-n_parts(df.sparkSession) // 6)))


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder, for narrow tables between iterations."""
    shared_dir(df.sparkSession)
    return _fewer(df).checkpoint(eager=True)


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once however often f's expression names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the white-space words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


#: What lies between words of digits, letters a-z and characters beyond ASCII, in lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """Words of a text in ASCII lower case between SEPARATORS; null and wordless texts give an empty array."""

    def inner(ws):
        head = F.when(F.get(ws, F.lit(0)) == "", 1).otherwise(0)
        tail = F.when((F.size(ws) > 1) & (F.element_at(ws, -1) == ""), 1).otherwise(0)
        return F.slice(ws, head + 1, F.size(ws) - head - tail)

    return let(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), inner)


def row_keys(doc_id: str, text: str) -> list[Column]:
    """_key and _key2: two hashes of id and text, which tell rows apart, those without an id too."""
    return [F.xxhash64(doc_id, F.coalesce(text, F.lit(""))).alias("_key"), F.xxhash64(F.lit(9), text, doc_id).alias("_key2")]


def n_parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Running sums add up blocks of so many values, then blocks of blocks.
FAN, LEVELS = 32, 3


def running_sums(values: Column, levels: int = LEVELS) -> Column:
    """Running sums of an array of longs, each with its own value in it. Blocks of FAN values are summed first and the blocks' sums run the same way, so the work stays near FAN a value for FAN^(levels + 1) values and more."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    if levels == 0:
        return let(values, lambda g: F.transform(g, lambda _, i: total(F.slice(g, F.lit(1), i + 1))))

    def blocked(g):
        block = lambda i: F.floor(i / FAN).cast("int")
        sums = F.transform(F.sequence(F.lit(0), block(F.size(g) - 1)), lambda b: total(F.slice(g, b * FAN + 1, F.lit(FAN))))
        return let(
            running_sums(sums, levels - 1),
            lambda upto: F.transform(g, lambda _, i: F.when(i >= FAN, F.get(upto, block(i) - 1)).otherwise(F.lit(0).cast("long")) + total(F.slice(g, block(i) * FAN + 1, i % FAN + 1))),
        )

    return let(values, lambda g: F.when(F.size(g) > FAN, blocked(g)).otherwise(F.transform(g, lambda _, i: total(F.slice(g, F.lit(1), i + 1)))))


def match_starts(pieces: Column, matches: Column) -> Column:
    """Code-point start of each match, from the pieces that split() leaves around them."""
    return running_sums(F.transform(matches, lambda m, i: (F.char_length(F.get(pieces, i)) + F.when(i > 0, F.char_length(F.get(matches, i - 1))).otherwise(0)).cast("long")))


def ordered_sums(df: DataFrame, order: list[str], values: list[str], tag: str) -> DataFrame:
    """df with _before_<v> for each of values: its sum over the rows that come before in the order, from a range sort and the partitions' sums. Only one row a partition meets in one task."""
    placed = saved(df.repartitionByRange(n_parts(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()), tag)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_all_{v}") for v in values]).select("_part", *[zero(F.sum(f"_all_{v}").over(before)).alias(f"_upto_{v}") for v in values])
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = placed.withColumns({f"_before_{v}": zero(F.sum(v).over(within)) for v in values}).join(F.broadcast(parts), "_part")
    return out.withColumns({f"_before_{v}": F.col(f"_before_{v}") + F.col(f"_upto_{v}") for v in values}).drop("_part", *[f"_upto_{v}" for v in values])


def runs(ends, most: int):
    """Runs [a, z) of rows that hold at most `most` together, or of one row; ends: what is held up to each row, from 0 on."""
    a = 0
    while a < len(ends) - 1:
        z = max(a + 1, int(ends.searchsorted(ends[a] + most, "right")) - 1)
        yield a, z
        a = z


def each(column):
    """The values of an Arrow column one by one: a batch of long texts is never held twice."""
    return (v.as_py() for v in column)


def hash_sample(df: DataFrame, by: list[str], rows: int, total: int) -> DataFrame:
    """About `rows` of the `total` rows of df: those with the smallest share of hash values, the same at every run; twice as many are never exceeded. Tasks pass on only what is chosen."""
    if total <= rows:
        return df
    share = F.pmod(F.xxhash64(F.lit("sample"), *by), F.lit(1 << 31))
    return df.where(share < int((1 << 31) * rows / total)).limit(2 * rows)


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """df, sent to every task if it has at most so many rows; beyond, a join shuffles both sides. df is counted, so it should be a written table or cheap."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
