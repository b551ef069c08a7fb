"""The corpus pipeline: documents in, a clean and mixed corpus out, in five stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import saved, shared_dir, table
from marlstone.llm.decontaminate import contamination, row_keys
from marlstone.llm.lines import dedup_lines
from marlstone.llm.mixing import mix, word_count
from marlstone.llm.simhash import keyed, near_copies
from marlstone.llm.toxicity import score, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model is trained on labelled rows of docs. Rows are scored one by one, so repeated and null ids need no rule."""
    docs = docs.select(*COLUMNS)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, keep=COLUMNS).where(F.col("score") < 0.5).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, later copies of repeated line runs cut from its text; n_chars is counted anew where lines went."""
    out = dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8) the document with the smallest doc_id, rows without an id last; of rows that share id and text one."""
    keep = near_copies(docs.select(*COLUMNS)).select("first._d", "first._h").distinct()
    return keyed(docs.select(*COLUMNS)).dropDuplicates(["_d", "_h"]).join(keep, ["_d", "_h"], "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is near a benchmark item. Rows are told apart by id and text, so no row goes for what another holds."""
    bad = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keys=True).select("_key", "_key2").distinct()
    own = docs.select(*COLUMNS, *row_keys("doc_id", "text"))
    return own.join(bad, ["_key", "_key2"], "left_anti").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, target and taken words of every document that is left."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(saved(sized, "mix-sizes")).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]
#: The trained model and the fingerprints can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the table documents, each result written as Parquet in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
