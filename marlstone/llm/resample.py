"""Importance resampling towards a target distribution: hashed n-gram features, a gain for each bucket, Gumbel keys, the highest drawn.

Features are made by Arrow kernels in batches of whole texts: lower case, split, flatten and dictionary-encode; shifted dictionary indices are the n-grams, and each distinct pair of an n-gram and a word after it is hashed once. The corpus is read twice, for counts and for weights; what is shuffled are bucket counts (a row for each bucket and task) and narrow rows of ids and scores. The draw is a range sort with partition sums.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SEPARATORS, UPPER, ordered_sums, runs, saved, table

N_GRAM, BUCKETS, SEED = 3, 10_000, "42"
MIN_WORDS, PERCENT = 20, 5
#: Bytes of text that the kernels take at once; a longer text is taken by itself.
KERNEL_BYTES = 4 << 20


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, the distinct keys)."""
    coded = pc.dictionary_encode(pa.array(keys))
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()


def _portions(batches, place: int):
    """Batches cut so that the texts in column `place` hold KERNEL_BYTES at most."""
    for b in batches:
        sizes = pc.binary_length(b.column(place)).fill_null(0).to_numpy(zero_copy_only=False)
        for a, z in runs(np.append(0, np.cumsum(sizes, dtype=np.int64)), KERNEL_BYTES):
            yield b.slice(a, z - a)


def grams(texts: pa.Array, n_gram: int = N_GRAM):
    """For each length from 1 to n_gram the CRC-32 of all n-grams of the texts in order and where each text's begin (one more: the end). A null text has none."""
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    parts = pc.split_pattern_regex(low, SEPARATORS)
    flat, text = pc.list_flatten(parts), pc.list_parent_indices(parts)
    good = pc.not_equal(flat, "")
    text = pc.filter(text, good).to_numpy()
    coded = pc.dictionary_encode(pc.filter(flat, good))
    word = coded.indices.to_numpy().astype(np.int64)
    heads = [w.encode() for w in coded.dictionary.to_pylist()]
    tails = [b" " + w for w in heads]
    state, number = np.array([crc32(w) for w in heads], dtype=np.int64), word
    edges = np.arange(len(texts) + 1)
    for n in range(1, n_gram + 1):
        if n > 1:
            # An n-gram is the one before it, shifted, and the word that follows in the same text.
            inside = np.nonzero(text[: len(text) - n + 1] == text[n - 1 :])[0]
            back = inside if n == 2 else np.searchsorted(places, inside)
            number, pairs = _distinct(number[back] * len(heads) + word[inside + n - 1])
            before, after = np.divmod(pairs, max(1, len(heads)))
            state = np.fromiter(map(crc32, map(tails.__getitem__, after.tolist()), state[before].tolist()), np.int64, len(pairs))
        else:
            inside = np.arange(len(text))
        places = inside
        yield state.take(number), np.searchsorted(text[places], edges)


def bucket_counts(texts: DataFrame, text: str = "text", n_gram: int = N_GRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count) of the features of all rows, repeats included."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in _portions(batches, 0):
            for hashes, _ in grams(b.column(0), n_gram):
                total += np.bincount(hashes % buckets, minlength=buckets)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "count"])

    return texts.select(F.col(text).alias("_text")).mapInArrow(count, "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", n_gram: int = N_GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: floor of 1000 times the log of its smoothed share in target over that in docs."""
    counts = [np.zeros(buckets), np.zeros(buckets)]
    for c, side in zip(counts, (docs, target)):
        for r in bucket_counts(side, text, n_gram, buckets).collect():  # a row for each bucket
            c[r["bucket"]] = r["count"]
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, keep: list[str], text: str = "text", n_gram: int = N_GRAM) -> DataFrame:
    """The columns of docs named in keep with n_words, n_features and weight, the sum of the features' gains."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    made = ["n_words", "n_features", "weight"]
    own = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*[own.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in made]])

    def of(batches):
        gain = shared.value
        for b in _portions(batches, len(keep)):
            n_words, n_features, weight = np.zeros((3, b.num_rows), np.int64)
            for n, (hashes, at) in enumerate(grams(b.column(len(keep)), n_gram)):
                upto = np.append(0, np.cumsum(gain.take(hashes % len(gain))))
                weight += upto[at[1:]] - upto[at[:-1]]
                n_features += np.diff(at)
                if n == 0:
                    n_words = np.diff(at)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, (n_words, n_features, weight))], schema.names)

    return own.mapInArrow(of, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", n_gram: int = N_GRAM, buckets: int = BUCKETS) -> DataFrame:
    """The columns of docs named in keep (the id alone if None) with n_features, weight, score and rank, for every row.

    Of the N rows with at least min_words words floor(percent * N / 100) are drawn: those of the highest score, which is the weight and a Gumbel number from the sha-256 of `seed:id`; ties go to the smaller id, null last. rank counts the drawn from 1, others have null. A null text is empty (no features, weight 0); a null id hashes as an empty one. Rows with equal ids are told apart by their weights; equal rows are interchangeable and may be drawn in part. An empty table gives no rows, an empty target leaves all gains to the corpus. Columns named like one made are not kept.
    """
    made = ("n_words", "n_features", "weight", "score", "rank")
    keep = [c for c in (keep or [doc_id]) if c not in made]
    gain = gains(docs, target, text, n_gram, buckets)
    weighed = weigh(docs.withColumn("_id", F.col(doc_id)), gain, ["_id", *keep], text, n_gram)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    # The last column tells equal rows apart, so that many of them are still spread by the sort.
    scored = saved(weighed.withColumns({"score": F.col("weight") + luck, "_tie": F.monotonically_increasing_id()}), "op12-scores")
    able = scored.where(F.col("n_words") >= min_words).withColumns({"_down": -F.col("score"), "_none": F.col("_id").isNull(), "_one": F.lit(1).cast("long")})
    drawn = percent * able.count() // 100
    placed = ordered_sums(able, ["_down", "_none", "_id", "_tie"], ["_one"], "op12-order")
    rank = F.when(F.col("_before__one") < drawn, F.col("_before__one") + 1).cast("long")
    out = [*keep, "n_features", "weight", "score", "rank"]
    return placed.withColumn("rank", rank).select(*out).unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")).select(*out))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")


def _crc_table() -> list[int]:
    """The table of the reflected polynomial EDB88320, by its rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


def _sql() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = "list_concat(ws, list_concat(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))"
    return f"""with docs as materialized (select row_number() over () as r, doc_id, {words} as ws from documents),
features as materialized (select r, unnest({runs}) as g from docs),
wanted as materialized (select unnest({runs}) as g from (select {words} as ws from benchmark)),
hexed as (select g, strlen(g) as size, hex(encode(g)) as x from (select g from features union select g from wanted)),
coded as materialized (
  select g, xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, size + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, ({_crc_table()})[xor(c & 255, b) + 1]))) % {BUCKETS} as bucket from hexed),
in_docs as (select bucket, count(*) as s from features join coded using (g) group by bucket),
in_target as (select bucket, count(*) as t from wanted join coded using (g) group by bucket),
gained as materialized (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select sum(s) from in_docs)::double + {BUCKETS}) / ((coalesce(s, 0) + 1)::double * (coalesce((select sum(t) from in_target), 0)::double + {BUCKETS}))))::bigint as gain
  from (select distinct bucket from coded) left join in_docs using (bucket) left join in_target using (bucket)),
weights as (select r, count(*) as n, sum(gain)::bigint as weight from features join coded using (g) join gained using (bucket) group by r),
scored as materialized (
  select r, doc_id, len(ws) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
  from docs left join weights using (r)),
ranked as (select r, row_number() over (order by score desc, doc_id nulls last) as rank, count(*) over () as able from scored where n_words >= {MIN_WORDS})
select doc_id, n_features, weight, score, case when rank <= {PERCENT} * able // 100 then rank end as rank from scored left join ranked using (r)"""


SQL = {"op12_importance_resampling": _sql()}
