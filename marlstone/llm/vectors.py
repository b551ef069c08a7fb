"""Embedding near-dedup: exact cosine links within a label by PCA-ordered tiled comparison.

Vectors are normalised and rotated to the principal axes, so most of a product comes from the leading coordinates. Each label is cut into slabs along the first axis and these into tiles along the second. Tiles meet in the cells of a grid over both axes, as wide as a link reaches, and a pair is compared only if the boxes of their leading coordinates come close enough for a link; inside, the leading products are accumulated first, the rest is bounded by the product of the suffix norms (Cauchy-Schwarz), and only pairs whose bound reaches the threshold are finished, with the original components in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, saved, table
from .graph import components, forest

#: The rotation is fitted on about so many vectors (never twice as many), chosen by hash. It decides the speed, never the result.
PCA_SAMPLE = 4096
TILE_ROWS = 2048
BOX_DIMS = 4
LEADS = (8, 24)
SLACK = 1e-9


def rotation(sample: np.ndarray) -> np.ndarray:
    """Columns: principal axes, the most spread first."""
    if len(sample) < 2:
        return np.eye(sample.shape[1] if sample.ndim == 2 else 1)
    return np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1))[1][:, ::-1]


def close_pairs(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, threshold: float, same: bool, leads=LEADS):
    """Index pairs (i, j) with x[i].y[j] >= threshold for unit rows x, y and their rotated forms px, py; for one tile against itself i < j only."""
    d = x.shape[1]
    cuts = [c for c in leads if c < d]
    alive = None
    lead = np.zeros((len(x), len(y)))
    done = 0
    if cuts:
        c = cuts[0]
        lead = px[:, :c] @ py[:, :c].T
        sx, sy = np.sqrt(np.maximum(0, 1 - (px[:, :c] ** 2).sum(1))), np.sqrt(np.maximum(0, 1 - (py[:, :c] ** 2).sum(1)))
        alive = np.nonzero(lead + np.outer(sx, sy) >= threshold - SLACK)
        part, done = lead[alive], c
    else:
        alive = np.nonzero(np.ones_like(lead, dtype=bool))
    i, j = alive
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
        if done:
            part = part[keep]
    out_i, out_j = [], []
    for at in range(0, len(i), 1 << 17):
        a, b = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
        p, k = (part[at : at + (1 << 17)] if done else np.zeros(len(a))), done
        for c in cuts[1:]:
            p = p + np.einsum("ij,ij->i", px[a, k:c], py[b, k:c])
            sx, sy = np.sqrt(np.maximum(0, 1 - (px[a, :c] ** 2).sum(1))), np.sqrt(np.maximum(0, 1 - (py[b, :c] ** 2).sum(1)))
            keep = p + sx * sy >= threshold - SLACK
            a, b, p, k = a[keep], b[keep], p[keep], c
        hit = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
        out_i.append(a[hit])
        out_j.append(b[hit])
    empty = np.zeros(0, dtype=int)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (empty, empty)


def _matrix(raw: bytes, d: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(-1, d)


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, they have the same length and their cosine in double precision is at least `threshold`. Null, empty, zero vectors and those with a null or non-finite component link with nothing, nor do rows without a label. Rows whose label and components are equal are compared once and counted each; copies are never expanded into pairs. A row with a null vec_id keeps component_id null, no links and kept false. Rows that share a vec_id and differ in their components are vectors of their own.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0)
    good = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    # Copies collapse to one class with a number of its own; a hot vector is combined before the shuffle.
    name = lambda t: t.withColumns({"h1": F.xxhash64("label", "e"), "h2": F.xxhash64(F.lit(1), "e", "label")})
    reps = saved(name(good.groupBy("label", "e").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))).withColumn("rep", F.monotonically_increasing_id()), "op3-reps")
    sizes = {r["d"]: r["n"] for r in reps.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).collect()}  # one row per vector length
    parts = []
    for d, n_rows in sorted(sizes.items()):
        here = reps.where(F.size("e") == d)
        sample = hash_sample(here, ["rep"], PCA_SAMPLE, n_rows).orderBy("rep").select("e").toPandas()
        x = np.array(sample["e"].tolist(), dtype=float).reshape(-1, d)
        x /= np.abs(x).max(1, keepdims=True)
        parts.append(_links(here, rotation(x / np.linalg.norm(x, axis=1, keepdims=True)), d, threshold, tile_rows))
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
        found = saved(found, "op3-links", narrow=True)
    else:
        found = spark.createDataFrame([], "rep long, links long, root long")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    classes = (
        reps.select("rep", "h1", "h2", "n", "least")
        .join(linked, "rep", "left")
        .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .select("h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    )
    classes = saved(classes, "op3-classes", narrow=True)
    smallest = saved(classes.groupBy("c").agg(F.min("least").alias("component_id")), "op3-smallest", narrow=True)
    classes = saved(classes.join(smallest, "c").select("h1", "h2", "n_links", "component_id"), "op3-named", narrow=True)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    # Rows without links anywhere are kept from meeting in one hash: each has its own.
    keyed = name(own.withColumn("_ok", usable)).withColumns({c: F.when(F.col("_ok"), F.col(c)).otherwise(F.xxhash64(F.lit(c), "vec_id")) for c in ("h1", "h2")}).select("vec_id", "h1", "h2")
    return keyed.join(classes, ["h1", "h2"], "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def _links(reps: DataFrame, axes: np.ndarray, d: int, threshold: float, tile_rows: int) -> DataFrame:
    """(rep, links, root) by tile pair: links counts linked vectors, copies included; root is the least rep linked to within the pair."""
    box = min(BOX_DIMS, d)
    reach2 = 2 - 2 * threshold + 1e-9
    reach = math.sqrt(max(reach2, 1e-4))

    def blocks(batches):
        for pdf in batches:
            for (lab, _), g in pdf.groupby(["label", "_slab"], sort=True):
                x = np.array(g["e"].tolist(), dtype=float).reshape(len(g), d)
                x /= np.abs(x).max(1, keepdims=True)  # before the norm, so that it can't overflow
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                p = x @ axes
                o = np.argsort(p[:, min(1, d - 1)], kind="stable")
                for at in range(0, len(o), tile_rows):
                    t = o[at : at + tile_rows]
                    lo, hi = p[t, :box].min(0), p[t, :box].max(0)
                    yield pd.DataFrame({"label": [lab], "tile": [int(g["rep"].iloc[t].min())], "ids": [g["rep"].to_numpy()[t].tobytes()], "n": [g["n"].to_numpy()[t].tobytes()], "x": [x[t].tobytes()], "lo": [lo.tolist()], "hi": [hi.tolist()]})

    # Each label is range-sorted by slab and second axis, whatever its size: a hot one simply fills more partitions.
    along = lambda k: F.aggregate(F.zip_with("e", F.array(*[F.lit(float(v)) for v in axes[:, k]]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scale = F.array_max(F.transform("e", F.abs))  # before the norm, so that it can't overflow
    norm = scale * F.sqrt(F.aggregate(F.transform("e", lambda v: v / scale), F.lit(0.0), lambda s, v: s + v * v))
    n = reps.count()
    ordered = reps.select("label", "e", "rep", "n", F.floor(along(0) / norm / reach).alias("_slab"), (along(min(1, d - 1)) / norm).alias("_p"))
    ordered = ordered.repartitionByRange(max(1, math.ceil(n / (tile_rows * 4))), "label", "_slab", "_p").sortWithinPartitions("label", "_slab", "_p").drop("_p")
    tiles = saved(ordered.mapInPandas(blocks, "label string, tile long, ids binary, n binary, x binary, lo array<double>, hi array<double>"), "op3-tiles")
    # Tiles that may link share a cell of the grid: one side enters the cells of its box, the other those within reach of it.
    cells = lambda k, by: F.sequence(F.floor((F.get("lo", F.lit(k)) - by) / reach), F.floor((F.get("hi", F.lit(k)) + by) / reach))
    entered = lambda by: tiles.select("label", "tile", "lo", "hi", F.explode(cells(0, by)).alias("c1")).select("label", "tile", "lo", "hi", "c1", F.explode(cells(min(1, d - 1), by)).alias("c2"))
    b = entered(reach * (1 + 1e-9)).select("label", "c1", "c2", *[F.col(c).alias(f"{c}2") for c in ("tile", "lo", "hi")])
    gap2 = F.aggregate(F.zip_with(F.zip_with("lo", "hi2", lambda u, v: u - v), F.zip_with("lo2", "hi", lambda u, v: u - v), lambda u, v: F.greatest(u, v, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v * v)
    near = saved(entered(0.0).join(b, ["label", "c1", "c2"]).where((F.col("tile") <= F.col("tile2")) & (gap2 <= reach2)).select("tile", "tile2").distinct(), "op3-near", narrow=True)
    right = tiles.select(*[F.col(c).alias(f"{c}2") for c in ("tile", "ids", "n", "x")])
    pairs = near.join(tiles.select("tile", "ids", "n", "x"), "tile").join(right, "tile2")

    def compare(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                same = r.tile == r.tile2
                ids, ids2, x, y = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.ids2, dtype=np.int64), _matrix(r.x, d), _matrix(r.x2, d)
                w, w2 = np.frombuffer(r.n, dtype=np.int64), np.frombuffer(r.n2, dtype=np.int64)
                i, j = close_pairs(x, y, x @ axes, y @ axes, threshold, same)
                if same:
                    links, every, jj = np.bincount(i, w[j], len(x)) + np.bincount(j, w[i], len(x)), ids, j
                else:
                    links = np.concatenate([np.bincount(i, w2[j], len(x)), np.bincount(j, w[i], len(y))])
                    every, jj = np.concatenate([ids, ids2]), j + len(x)
                o = np.argsort(every, kind="stable")  # local roots are then least ids
                rank = np.empty(len(o), dtype=np.int64)
                rank[o] = np.arange(len(o))
                root = every[o][forest(len(o), rank[i], rank[jj])][rank]
                hit = links > 0
                if hit.any():
                    yield pd.DataFrame({"rep": every[hit], "links": links[hit].astype(np.int64), "root": root[hit]})

    return pairs.repartition(F.col("tile"), F.col("tile2")).mapInPandas(compare, "rep long, links long, root long")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


SQL = {
    "op3_embedding_near_dedup": """with recursive good as (
  select vec_id, label, list_transform(embedding, lambda v: v::double) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0),
links as (
  select a.vec_id as u, b.vec_id as v from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, v) as (select vec_id, vec_id from good union select r.u, l.v from reach r join links l on r.v = l.u),
least as (select u, min(v) as c from reach group by u),
counts as (select u, count(*) as n from links group by u)
select vec_id, coalesce(n, 0) as n_links, coalesce(c, vec_id) as component_id, vec_id = coalesce(c, vec_id) as kept
from embeddings left join least on least.u = vec_id left join counts on counts.u = vec_id"""
}
