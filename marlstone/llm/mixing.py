"""Mixing sources to target weights: hash-random order, range buckets, distributed prefix sums, exact cuts.

Sizes and ids alone are shuffled, never texts. A source of any size is spread over hash-range buckets; only one sum a bucket is ordered by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, ordered_sums, saved, table

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = "mix-1"
#: About so many documents to a bucket, which one task orders.
BUCKET_ROWS = 4_000


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) with a column target: all sizes shared by weight, none above `most` times its source's size, the excess reshared by weight until none is above.

    Sources are ordered by code point, null last, and weigh `weights`, repeating. The fixed point in closed form: sources in order of most*size/weight are at their cap up to the first whose fair share of the rest fits. Both orders are range sorts with partition sums, so sources may be as many as host names.
    """
    s = sizes.withColumns({"_none": F.col("source").isNull(), "_one": F.lit(1).cast("long")})
    s = ordered_sums(s, ["_none", "source"], ["_one"], "op8-sources")
    s = s.withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_before__one") % len(weights)).cast("int")))
    s = s.withColumn("_cap", (F.col("source_size") * most).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    s = ordered_sums(s, ["_ratio", "_none", "source"], ["_cap", "_w"], "op8-levels")
    every = s.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    level = (F.lit(float(every["size"] or 0)) - F.col("_before__cap")) / (F.lit(every["w"] or 1.0) - F.col("_before__w"))
    s = s.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    # The first that fits gives the level for itself and all after it.
    place = F.struct("_ratio", "_none", F.coalesce("source", F.lit("")).alias("source"))
    first = s.where("_fits").agg(F.min(F.struct(place.alias("place"), "_level"))).first()[0]  # one row
    if first is None:
        return s.select("source", "source_size", F.col("_cap").alias("target"))
    at = F.struct(F.lit(first["place"]["_ratio"]).alias("_ratio"), F.lit(first["place"]["_none"]).alias("_none"), F.lit(first["place"]["source"]).alias("source"))
    return s.select("source", "source_size", F.when(place >= at, F.lit(first["_level"]) * F.col("_w")).otherwise(F.col("_cap")).alias("target"))


def mix(sized: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """sized (doc_id, source, size, and any other columns) with source_size, target and taken added.

    Every document is taken whole for each full epoch of its source; the last, partial epoch goes through the source in the order of a seeded hash of doc_id and is cut at the exact word of the budget (the target rounded down), so a document on the cut is taken in part. Rows with equal doc_id are ordered by size, those without one by a hash of their size; equal rows are interchangeable. Sources of size zero take nothing. A column named as one added is replaced.
    """
    sized = sized.drop("source_size", "target", "taken", "_key", "_bucket", "_upto", "_within")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    totals = saved(totals, "op8-totals", narrow=True)
    most_docs = totals.agg(F.max("_docs")).first()[0] or 0
    buckets = max(1, -(-most_docs // bucket_rows))
    goal = targets(totals.select("source", "source_size"), weights, most)
    # Uniform keys: equal key ranges are equal shares of a source, so no sampling is needed to cut them.
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("size").cast("string")))))
    keyed = sized.withColumn("_key", key).withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int"))
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    upto = sums.select(
        F.col("source").alias("_s"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_upto"),
    )
    goal = goal.select(F.col("source").alias("_g"), "source_size", "target")
    upto = upto.join(goal, F.col("_s").eqNullSafe(F.col("_g"))).drop("_g")
    within = W.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size")
    placed = keyed.withColumn("_within", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    out = placed.join(upto, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    budget = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - full * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_upto") - F.col("_within")))
    return out.withColumn("taken", (full * F.col("size") + part).cast("long")).drop("_key", "_bucket", "_within", "_s", "_b", "_upto")


def word_count(text):
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    # Three passes need the sizes: counted once, written once.
    return mix(saved(sized, "op8-sizes")).select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = {
    "op8_source_mix": f"""with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select source, source_size, {MOST_EPOCHS} * source_size::double as cap, [1.0, 2.0, 3.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from totals),
levels as (
  select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
    / (sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0)) as level from weighed),
chosen as (select first(level order by cap / w, source nulls last) as level from levels where level * w <= cap),
goals as (select source, source_size, case when cap / w < coalesce((select min(cap / w) from levels where level * w <= cap), 1e300) then cap else chosen.level * w end as target from levels, chosen),
keyed as (select sized.*, md5('{SEED}:' || coalesce(doc_id::varchar, 'null:' || size)) as k from sized),
placed as (select keyed.*, source_size, target, coalesce(sum(size) over (partition by keyed.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as upto
  from keyed join goals on keyed.source is not distinct from goals.source),
cut as (select *, case when source_size > 0 then floor(floor(target) / source_size) else 0 end as full_epochs from placed)
select doc_id, size, source_size, target, (full_epochs * size + greatest(0, least(size, floor(target) - full_epochs * source_size - upto)))::bigint as taken, source from cut"""
}
