"""SimHash near-dedup: 64-bit fingerprints, and exact pairs within a Hamming radius by vantage-point trees.

A small tree is built from a bounded sample of fingerprints and sent to every task. Each fingerprint is dealt to its home leaf and, by triangle bounds, to those leaves across a boundary in which a partner may live; each leaf (a shard) is searched by itself, and splits further by vantage points of its own while it is large.

simhash_groups links by fingerprints alone. near_copies links by the similarity of shingle sets: the tree is searched at a radius that nearly all pairs of that similarity lie within, and every link is verified on the sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_below, each, hash_sample, saved, table
from .graph import components, forest

SEED, SHINGLE, RADIUS = 42, 3, 2
#: The tree is fitted on about so many distinct fingerprints (never twice as many), chosen by hash; it decides the work, never the result.
TREE_SAMPLE = 65_536
LEAF_ROWS = 4096
BRUTE = 1 << 24

#: near_copies: words of a shingle, least similarity, radius among the first 64 bits, which the tree searches, and among all 128. Sets of similarity 0.8 differ in about 15 % of the bits, 9.7 of 64 with a deviation of 2.9 and 19.4 of 128 with 4.1.
NEAR_SHINGLE, NEAR_SIMILARITY, NEAR_RADIUS, NEAR_WIDE = 5, 0.8, 16, 32
#: Pairs that the first links leave apart are held against 1024 bits before their sets are joined: 155 differ at similarity 0.8, with a deviation of 11.5; at 0.65 it is 215.
NEAR_WORDS, NEAR_WIDEST = 16, 194
#: Rounds in which vertices propose their closest candidate in another component, before all pairs that are left.
NEAR_ROUNDS = 3
#: Fingerprints to a leaf of near_copies and to a chunk of its guests: what a task compares.
NEAR_LEAF = 65_536
BROADCAST_KEYS = 2_000_000
NOBODY = (1 << 63) - 1


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash over word shingles, repeats included. Fewer words than a shingle: the whole sequence is one; no word: zero."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    if len(ws) < size:
        grams = [b" ".join(ws)]
    elif size == 3:
        grams = [b"%b %b %b" % g for g in zip(ws, ws[1:], ws[2:])]
    else:
        grams = [b" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, seed) for g in grams), dtype=np.uint64, count=len(grams))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per row of docs, fp the fingerprint's bits as a long. A null text has no words."""

    def of(batches):
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in each(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, "doc_id long, fp long")


def apart(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


def vantage(fps: np.ndarray, radius: int, tries: int = 8) -> tuple[int, int]:
    """A vantage point and its median distance, of a few candidates the one with the fewest fingerprints near the boundary."""
    best = None
    for c in fps[np.linspace(0, len(fps) - 1, min(tries, len(fps))).astype(int)]:
        d = apart(fps, c)
        m = int(np.median(d))
        inner = int((d <= m).sum())
        if inner == len(d):
            m -= 1
            inner = int((d <= m).sum())
        cost = int((np.abs(d - m) <= radius).sum()) + 2 * abs(inner - len(d) // 2)
        if best is None or cost < best[0]:
            best = (cost, int(c), m)
    return best[1], best[2]


def plant(sample: np.ndarray, total: int, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS) -> list:
    """Nodes [point, median, inner child, outer child], a leaf None; the root is node 0. total: fingerprints that the sample stands for."""
    nodes: list = [None]
    todo = [(0, np.sort(sample))]
    while todo:
        at, fps = todo.pop()
        if len(fps) < 32 or len(fps) * total / max(1, len(sample)) <= leaf_rows:
            continue
        point, m = vantage(fps, radius)
        d = apart(fps, np.uint64(point))
        inner, outer = fps[d <= m], fps[d > m]
        if not len(inner) or not len(outer):
            continue
        nodes[at] = [point, m, len(nodes), len(nodes) + 1]
        nodes += [None, None]
        todo += [(nodes[at][2], inner), (nodes[at][3], outer)]
    return nodes


def route(nodes: list, fps: np.ndarray, radius: int = RADIUS, guests: bool = False):
    """(leaf, row, at home) of every shard that a fingerprint has to be in; guests have no home there.

    A pair that a node parts has one member inside: that one visits the outer side if a partner may be there, and from then on goes wherever the triangle bound allows.
    """
    out = []
    todo = [(0, np.arange(len(fps)), np.full(len(fps), not guests))]
    while todo:
        at, idx, home = todo.pop()
        if not len(idx):
            continue
        if nodes[at] is None:
            out.append((np.full(len(idx), at), idx, home))
            continue
        point, m, inner, outer = nodes[at]
        d = apart(fps[idx], np.uint64(point))
        go_in = np.where(home, d <= m, d <= m + radius)
        go_out = d > m - radius
        todo.append((inner, idx[go_in], home[go_in]))
        todo.append((outer, idx[go_out], home[go_out] & (d[go_out] > m)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, dtype=int)] * 2 + [np.zeros(0, dtype=bool)]


def search(home: np.ndarray, guests: np.ndarray, radius: int = RADIUS, brute: int = BRUTE):
    """Index pairs (i, j) with home[i] and guests[j] within the radius: blocks, or a further vantage point while there is too much for one."""
    out_i, out_j = [], []
    todo = [(np.arange(len(home)), np.arange(len(guests)))]
    while todo:
        h, g = todo.pop()
        if not len(h) or not len(g):
            continue
        if len(h) * len(g) > brute and len(h) > 256:
            point, m = vantage(home[h[:: max(1, len(h) // 4096)]], radius)
            dh = apart(home[h], np.uint64(point))
            if 0 < (dh <= m).sum() < len(h):
                dg = apart(guests[g], np.uint64(point))
                todo += [(h[dh <= m], g[dg <= m + radius]), (h[dh > m], g[dg > m - radius])]
                continue
        step = max(1, (1 << 22) // max(1, len(g)))
        for at in range(0, len(h), step):
            i, j = np.nonzero(np.bitwise_count(home[h[at : at + step], None] ^ guests[g][None, :]) <= radius)
            out_i.append(h[at + i])
            out_j.append(g[j])
    empty = np.zeros(0, dtype=int)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (empty, empty)


def near_groups(fps: DataFrame, radius: int = RADIUS, tree_sample: int = TREE_SAMPLE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(fp, component_id) for every distinct fp of fps (doc_id, fp): component_id is the smallest doc_id that is reachable by links of at most `radius` differing bits.

    Equal fingerprints are one vertex, so groups of copies cost one row. A leaf gives a spanning forest of its links, never all pairs. Fingerprints of rows without a doc_id link as well; a component of such rows alone has component_id null.
    """
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "op7-classes", narrow=True)
    total = classes.count()
    sample = np.array([r[0] for r in hash_sample(classes.select("fp"), ["fp"], tree_sample, total).collect()], dtype=np.int64).view(np.uint64)
    nodes = plant(sample, total, radius, leaf_rows)

    def deal(batches):
        for pdf in batches:
            v = pdf["fp"].to_numpy().view(np.uint64)
            leaf, row, home = route(nodes, v, radius)
            yield pd.DataFrame({"leaf": leaf.astype(np.int32), "fp": v[row].view(np.int64), "home": home})

    def within(pdf):
        pdf = pdf.sort_values("fp")
        v, home = pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
        at = np.nonzero(home)[0]
        i, j = search(v[at], v, radius)
        root = forest(len(v), at[i], j)
        moved = root != np.arange(len(v))
        return pd.DataFrame({"u": v[moved].view(np.int64), "v": v[root[moved]].view(np.int64)})

    links = saved(classes.select("fp").mapInPandas(deal, "leaf int, fp long, home boolean").groupBy("leaf").applyInPandas(within, "u long, v long"), "op7-links", narrow=True)
    found = components(links).withColumnRenamed("id", "fp")
    named = classes.join(found, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    return named.join(least, "c").select("fp", "component_id")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, **options) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows keep a row each. A row with a null doc_id takes the component of its links, null if they have no id either. Other columns are not carried.
    """
    fps = saved(fingerprints(docs, doc_id, text, size), "op7-fingerprints")
    groups = near_groups(fps, radius, **options)
    return fps.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, size: int = NEAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text's words, in ASCII lower case between white space: sorted 64-bit names, and other 64 bits of each. Fewer words than a shingle: the whole sequence is one; no word: none."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(b" ".join(ws[i : i + size])) for i in range(max(1, len(ws) - size + 1))])
    two = np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2)
    names, at = np.unique(two[:, 0], return_index=True)
    return names, two[at, 1]


def majority(h: np.ndarray) -> int:
    """64 bits, as a signed number: 1 where more than half of the hashes have it."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(np.ascontiguousarray(h[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def widest(names: np.ndarray, words: int = NEAR_WORDS) -> bytes:
    """64 * words bits of SimHash from shingle names, each word by a hash of its own."""
    out = []
    for k in range(words):
        x = (names ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(x ^ (x >> np.uint64(29))))
    return np.array(out, dtype=np.int64).tobytes()


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _d and _h, which tell rows apart: the id (null: the largest long) and a hash of the text."""
    return docs.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})


def close(home: dict, guests: dict, similarity: float, radius: int, wide: int, cells: int = 1 << 18):
    """Blocks (i, j, distance) of candidate pairs between arrays v, n, fp, fp2: within the radii, of sizes that allow the similarity, not the same vertex."""
    step = max(1, cells // max(1, len(guests["fp"])))
    for at in range(0, len(home["fp"]), step):
        i, j = np.nonzero(np.bitwise_count(home["fp"][at : at + step, None] ^ guests["fp"][None, :]) <= radius)
        i += at
        d = np.bitwise_count(home["fp"][i] ^ guests["fp"][j]).astype(np.int16) + np.bitwise_count(home["fp2"][i] ^ guests["fp2"][j])
        a, b = home["n"][i], guests["n"][j]
        ok = (d <= wide) & (np.minimum(a, b) >= np.maximum(a, b) * similarity - 1e-9) & (home["v"][i] != guests["v"][j])
        yield i[ok], j[ok], d[ok]


def near_links(vertices: DataFrame, texts: DataFrame, size: int, similarity: float, radius: int, wide: int, leaf_rows: int) -> DataFrame:
    """(u, v): verified links that span every group of vertices (v, n, fp, fp2); texts (v, text) holds a text of each.

    Sets of that similarity differ in size by a factor of 1 / similarity at most, so fingerprints are dealt by the band of their size and by leaf, and visit the next band. Each vertex proposes its closest candidate and its least; what these leave apart is proposed in full. Links are verified on the shingle sets.
    """
    spark = vertices.sparkSession
    vertices = vertices.where("n > 0").withColumn("band", F.floor(F.log("n") / (math.log(1 / similarity) * (1 + 1e-9))).cast("int"))
    bands = {r["band"]: r["n"] for r in vertices.groupBy("band").agg(F.count("*").alias("n")).collect()}  # some 60 rows
    most = max(bands.values(), default=0)
    sample = np.array([r[0] for r in hash_sample(vertices.select("fp"), ["fp"], TREE_SAMPLE, sum(bands.values())).collect()], dtype=np.int64).view(np.uint64)
    nodes = plant(sample, most, radius, leaf_rows)
    chunks = {b: max(1, -(-(n + bands.get(b - 1, 0)) // leaf_rows)) for b, n in bands.items()}

    def deal(batches):
        """Homes go to every chunk of their leaf's guests, guests (homes too, as each other's) to one."""
        for b in batches:
            pdf = b.to_pandas()
            fp, band = pdf["fp"].to_numpy().view(np.uint64), pdf["band"].to_numpy()
            chunk = (pdf["v"].to_numpy().view(np.uint64) % np.uint64(1 << 20)).astype(np.int64)
            of = lambda bs: np.array([chunks.get(x, 0) for x in bs], dtype=np.int64)
            parts = []
            leaf, row, home = route(nodes, fp, radius)
            many = of(band[row])
            parts.append((band[row], leaf, chunk[row] % many, row, np.zeros(len(row), dtype=bool)))
            at = np.nonzero(home)[0]
            times = many[at]
            rep = np.repeat(at, times)
            parts.append((band[row[rep]], leaf[rep], np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times), row[rep], np.ones(len(rep), dtype=bool)))
            up = np.nonzero(of(band + 1))[0]  # the next band has somebody to visit
            leaf, row, _ = route(nodes, fp[up], radius, guests=True)
            row = up[row]
            parts.append((band[row] + 1, leaf, chunk[row] % np.maximum(1, of(band[row] + 1)), row, np.zeros(len(row), dtype=bool)))
            band_, leaf, chunk_, row, home = (np.concatenate(x) for x in zip(*parts))
            cols = {"band": band_.astype(np.int32), "leaf": leaf.astype(np.int32), "chunk": chunk_.astype(np.int32), "home": home}
            rest = [pa.array(pdf[c].to_numpy()[row]) for c in ("v", "n", "fp", "fp2", "c")]
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in cols.values()], *rest, b.column("bits").take(pa.array(row))], [*cols, "v", "n", "fp", "fp2", "c", "bits"])

    def shards(of: DataFrame):
        return of.select("v", "n", "fp", "fp2", "band", "c", "bits").mapInArrow(deal, "band int, leaf int, chunk int, home boolean, v long, n int, fp long, fp2 long, c long, bits binary").groupBy("band", "leaf", "chunk")

    def sides(t):
        pdf = t.to_pandas().sort_values("v")
        cols = lambda p: {"bits": p["bits"].tolist(), "v": p["v"].to_numpy(), "n": p["n"].to_numpy(), "c": p["c"].to_numpy(), "fp": p["fp"].to_numpy().view(np.uint64), "fp2": p["fp2"].to_numpy().view(np.uint64)}
        return cols(pdf[pdf["home"]]), cols(pdf[~pdf["home"]])

    def propose(t):
        home, guests = sides(t)
        u, v, met = [], [], np.zeros(len(guests["v"]), dtype=bool)
        for i, j, d in close(home, guests, similarity, radius, wide):
            met[j] = True
            for order in (np.lexsort((j, i)), np.lexsort((j, d, i))):  # least, closest
                at = order[np.unique(i[order], return_index=True)[1]]
                u.append(home["v"][i[at]])
                v.append(guests["v"][j[at]])
        u.append(guests["v"][met])  # vertices that have a candidate at all
        v.append(guests["v"][met])
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    def apart_pairs(t, closest):
        """Candidates in different components, all or for each vertex the closest one by the widest print."""
        home, guests = sides(t)
        u, v = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        of_home, of_guests = (np.frombuffer(b"".join(x["bits"]), dtype=np.uint64).reshape(-1, NEAR_WORDS) for x in (home, guests))
        for i, j, _ in close(home, guests, similarity, radius, wide):
            other = home["c"][i] != guests["c"][j]
            i, j = i[other], j[other]
            d = np.bitwise_count(of_home[i] ^ of_guests[j]).sum(1, dtype=np.int64)
            if closest:
                order = np.lexsort((j, d, i))
                at = order[np.unique(i[order], return_index=True)[1]]
                i, j, d = i[at], j[at], d[at]
            near = d <= NEAR_WIDEST
            u.append(home["v"][i[near]])
            v.append(guests["v"][j[near]])
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    def closest_apart(t):
        return apart_pairs(t, True)

    def all_apart(t):
        return apart_pairs(t, False)

    def sets(batches):
        for b in batches:
            for v, t in zip(b.column("v").to_pylist(), each(b.column("text"))):
                names = shingle_hashes(t, size)[0]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()), pa.array([names.view(np.int64)], pa.list_(pa.int64())), pa.array([widest(names)], pa.binary())], ["v", "sh", "bits"])

    def verified(pairs, tag):
        pairs = saved(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), f"near-{tag}-pairs", narrow=True)
        a, b = own_sets.select(F.col("v").alias("u"), F.col("sh").alias("a")), own_sets.select("v", F.col("sh").alias("b"))
        both = F.size(F.array_intersect("a", "b"))
        return saved(pairs.join(a, "u").join(b, "v").where(both >= (F.size("a") + F.size("b") - both) * similarity - 1e-9).select("u", "v"), f"near-{tag}-links", narrow=True)

    proposed = saved(shards(vertices.withColumns({"c": F.col("v"), "bits": F.lit(None).cast("binary")})).applyInArrow(propose, "u long, v long").distinct(), "near-proposed", narrow=True)
    touched = saved(proposed.select("u").union(proposed.select("v")).distinct().withColumnRenamed("u", "v"), "near-touched", narrow=True)
    own_sets = saved(texts.join(broadcast_below(touched, BROADCAST_KEYS), "v", "left_semi").mapInArrow(sets, "v long, sh array<long>, bits binary"), "near-sets")
    links = verified(proposed, "first")
    prints = saved(vertices.join(own_sets.select("v", "bits"), "v"), "near-wide")
    # Closest pairs join most of a group, so few are left to be compared in full.
    for k in range(NEAR_ROUNDS + 1):
        named = prints.join(components(links).withColumnRenamed("id", "v"), "v", "left").withColumn("c", F.coalesce("component", "v")).drop("component")
        propose_again = closest_apart if k < NEAR_ROUNDS else all_apart
        rest = shards(saved(named, f"near-named{k}")).applyInArrow(propose_again, "u long, v long")
        links = links.union(verified(rest, f"rest{k}"))
    return links


def near_copies(docs: DataFrame, size: int = NEAR_SHINGLE, similarity: float = NEAR_SIMILARITY, radius: int = NEAR_RADIUS, wide: int = NEAR_WIDE, leaf_rows: int = NEAR_LEAF) -> DataFrame:
    """(_d, _h, first): for each key of keyed(docs) the least key (struct _d, _h) that is reachable by links of shingle sets with a Jaccard similarity of at least `similarity`.

    Links are searched by SimHash: of 128 bits at most `wide` differ, of the first 64 at most `radius`; a pair beyond is not found. Texts with equal sets, those without words too, are one vertex.
    """
    texts = keyed(docs).select("_d", "_h", "text")

    def of(batches):
        for b in batches:
            v, n, fp, fp2 = [], [], [], []
            for t in each(b.column(2)):
                names, other = shingle_hashes(t, size)
                v.append(xxhash.xxh64_intdigest(names.tobytes()) - (1 << 63))
                n.append(len(names))
                fp.append(majority(names))
                fp2.append(majority(other))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(v, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(fp2, pa.int64())], ["_d", "_h", "v", "n", "fp", "fp2"])

    own = saved(texts.mapInArrow(of, "_d long, _h long, v long, n int, fp long, fp2 long"), "near-prints")
    classes = saved(own.groupBy("v").agg(F.min(F.struct("_d", "_h")).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2")), "near-classes", narrow=True)
    reps = broadcast_below(classes.where("n > 0").select("v", "least._d", "least._h"), BROADCAST_KEYS)
    one = texts.join(reps, ["_d", "_h"]).select("v", "text")
    repeats = own.groupBy("_d", "_h").agg(F.count("*").alias("k")).where("k > 1").select("_d", "_h")
    repeats = saved(classes.where("n > 0").select("v", "least._d", "least._h").join(repeats, ["_d", "_h"], "left_semi").select("v"), "near-repeats", narrow=True)
    # A row that repeats gives its set once.
    one = one.join(broadcast_below(repeats, BROADCAST_KEYS), "v", "left_anti").union(one.join(broadcast_below(repeats, BROADCAST_KEYS), "v", "left_semi").dropDuplicates(["v"]))
    links = near_links(classes.select("v", "n", "fp", "fp2"), one, size, similarity, radius, wide, leaf_rows)
    joined = classes.join(components(links).withColumnRenamed("id", "v"), "v", "left").select("v", F.coalesce("component", "v").alias("c"), "least")
    joined = saved(joined, "near-joined", narrow=True)
    first = saved(joined.groupBy("c").agg(F.min("least").alias("first")), "near-first", narrow=True)
    first = saved(joined.join(first, "c").select("v", "first"), "near-found", narrow=True)
    return own.select("_d", "_h", "v").join(first, "v").select("_d", "_h", "first")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
