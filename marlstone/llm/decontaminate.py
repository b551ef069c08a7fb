"""Benchmark decontamination: SimHashes of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

Only DataFrame functions. A window that is similar enough to an item shares whole shingles with it, so windows are laid out only where a shingle of the benchmark stands, for the items that hold it. Each gets a SimHash of its shingles, rolled from one start to the next: one shingle comes in, one goes out. A window and such an item meet in a block of eight bits that differs in at most radius/8 bits (the shingles choose, the blocks filter), and candidates within the radius are verified by the weighted Jaccard similarity of their shingles, repeats counted. What a window shares with an item is a running sum over its starts: an occurrence counts from the start that leaves fewer than the item's number of its like before it, up to its own place. So the work is linear in texts and windows, however long the items are.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_below, let, plain_words, row_keys, saved, table

SHINGLE, SIMILARITY = 5, 0.8
#: Windows of similarity 0.8 differ from their item in about 10 of 64 bits, with a deviation of 3: the radius lies four deviations beyond. A wider radius than that of its blocks alone would choose little by itself: eight bits with up to two flips let through 37 of 256 values; the items that a window meets come from its shingles.
RADIUS, BLOCKS = 23, 8
#: Rows up to which a side is sent to every task; beyond it the join shuffles. Benchmark grams take 24 bytes, block entries 40, items about 200. Seeds (16 bytes each) are counted one by one, for a document may have many.
BROADCAST_GRAMS, BROADCAST_DOCS, BROADCAST_SEEDS = 2_000_000, 100_000, 1_000_000


def _rolling(ws: Column, k: int, stride: int = 1) -> Column:
    """Hashes of the k words at every stride-th place."""
    roll = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k, F.lit(stride)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(ws) >= k, let(ws, roll)).otherwise(F.array().cast("array<bigint>"))


#: Bits of a counter, three to a long (longer windows: two): no sum reaches a long's sign.
LANE, LONG_LANE = 21, 31
#: Windows that one chain of rolled counters goes through at least and at most.
CHAIN = (256, 4096)


def _packed(g: Column, j: Column, lane: int) -> Column:
    """The j-th group of bits of a hash, each in a counter of its own: the product puts a copy of the group at each counter, shifted so that one bit of each meets the mask."""
    per = 63 // lane
    bits = F.call_function("shiftrightunsigned", g, j * per).bitwiseAND(F.lit((1 << per) - 1).cast("long"))
    return (bits * F.lit(sum(1 << (lane - 1) * i for i in range(per))).cast("long")).bitwiseAND(F.lit(sum(1 << lane * i for i in range(per))).cast("long"))


def rolled_prints(hashes: Column, first: Column, last: Column, size: Column, lane: int = LANE) -> Column:
    """SimHashes of the windows of `size` hashes that start at first to last: a bit is 1 if more than half of the hashes have it. Counters are carried from a window to the next, in chains of bounded length."""
    per = 63 // lane
    lanes = -(-64 // per)
    zero = F.lit(0).cast("long")

    def fingerprint(n, size):
        # Adding what lacks to the top bit sets it where the counter is large enough.
        lack = (F.lit(1 << (lane - 1)) - F.floor(size / 2) - 1) * F.lit(sum(1 << lane * i for i in range(per))).cast("long")
        top = lambda v: F.call_function("shiftrightunsigned", v + lack, F.lit(lane - 1))
        near = lambda y: sum((F.call_function("shiftrightunsigned", y, F.lit(lane * i)).bitwiseAND(F.lit(1).cast("long")) * F.lit(1 << i).cast("long") for i in range(1, per)), y.bitwiseAND(F.lit(1).cast("long")))
        parts = F.transform(n, lambda v, j: F.call_function("shiftleft", let(top(v), near), j * per))
        return F.aggregate(parts, zero, lambda s, x: s.bitwiseOR(x))

    def chain(h, at, end, size):
        start = F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda j: F.aggregate(F.slice(h, at + 1, size), zero, lambda s, g: s + _packed(g, j, lane)))
        step = lambda n, i: F.transform(n, lambda v, j: v + _packed(F.get(h, i + size - 1), j, lane) - _packed(F.get(h, i - 1), j, lane))
        begin = let(start, lambda n: F.struct(n.alias("n"), F.array(fingerprint(n, size)).alias("out")))
        more = lambda st, i: let(step(st["n"], i), lambda n: F.struct(n.alias("n"), F.concat(st["out"], F.array(fingerprint(n, size))).alias("out")))
        rest = F.when(end > at, F.sequence(at + 1, end)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rest, begin, more, lambda st: st["out"])

    def chains(x):
        step = F.greatest(F.lit(CHAIN[0]), F.least(F.lit(CHAIN[1]), x["size"]))
        return F.flatten(F.transform(F.sequence(x["a"], x["b"], step), lambda at: chain(x["h"], at, F.least(x["b"], at + step - 1), x["size"])))

    return let(F.struct(hashes.alias("h"), first.cast("int").alias("a"), last.cast("int").alias("b"), size.cast("int").alias("size")), chains)


def contamination(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, keys: bool = False) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: for each document and item (doc_id, text; item_id, text) the most similar item-sized window, the first of equals, where it reaches `similarity`.

    Words are runs of letters and digits in lower case. A window has as many words as the item, or is the whole text where that is shorter; similarity is the sum of smaller over the sum of larger shingle counts, shingles being `shingle` words long, or the whole item if it is shorter. Null and empty texts match nothing. Rows that share doc_id and text are one document; items that share item_id are tried each. keys: with the row_keys of the document.
    """
    entries = saved(items.select("item_id", plain_words(F.col("text")).alias("_ws")).where(F.size("_ws") > 0).select("item_id", F.size("_ws").alias("l"), F.least(F.lit(shingle), F.size("_ws")).alias("k"), "_ws", F.monotonically_increasing_id().alias("item")), "op9-items", narrow=True)
    shapes = sorted((r["k"], r["most"]) for r in entries.groupBy("k").agg(F.max("l").alias("most")).collect())  # at most `shingle` rows
    own = docs.select("doc_id", "text", *row_keys("doc_id", "text"))
    key = ["_key", "_key2"]
    wide = 1 << (LANE - 1)
    parts = [_matches(own, key, entries.where((F.col("k") == k) & ((F.col("l") >= wide) == long)), k, similarity, radius, long) for k, most in shapes for long in ([False, True] if most >= wide else [False])]
    if not parts:
        return docs.sparkSession.createDataFrame([], ("_key long, _key2 long, " if keys else "") + f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start_word int, n_words int, similarity double")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    best = out.groupBy("doc_id", *key, "item_id", "item").agg(F.max(F.struct("similarity", (-F.col("s")).alias("s"), "l")).alias("b"))
    best = best.groupBy("doc_id", *key, "item_id").agg(F.max("b").alias("b"))
    return best.select(*(key if keys else []), "doc_id", "item_id", (-F.col("b.s")).alias("start_word"), F.col("b.l").alias("n_words"), F.col("b.similarity").alias("similarity"))


def _seeds(own: DataFrame, key: list[str], items: DataFrame, grams: DataFrame, k: int, similarity: float) -> DataFrame:
    """key, doc_id, n (words) and _seeds (item, l, p) of the documents in which shingles of the benchmark stand, at every stride-th place."""
    # Of the m shingles of a similar window at least b = 2ms / (1 + s) are the item's, so the others part them into runs, the longest of at least b / (m - b + 1): looking at every stride-th place meets it.
    # A text shorter than the item is one window of w < m shingles, of which s(w + m) / (1 + s) are the item's: the least run over all w counts.
    m = F.size("sh")
    shared = lambda w: F.ceil((w + m) * F.lit(similarity) / (1 + similarity) - 1e-9)
    runs = F.transform(F.sequence(F.greatest(F.lit(1), F.ceil(m * similarity - 1e-9).cast("int")), m), lambda w: F.ceil(shared(w) / (w - shared(w) + 1)))
    stride = items.agg(F.min(F.array_min(runs)).alias("s")).first()["s"] or 1
    with_size = let(plain_words(F.col("text")), lambda ws: F.transform(_rolling(ws, k, int(stride)), lambda g: F.struct(g.alias("g"), F.size(ws).alias("n"))))
    places = own.select("doc_id", *key, F.posexplode(with_size).alias("p", "_x")).select("doc_id", *key, (F.col("p") * int(stride)).alias("p"), F.col("_x.g").alias("g"), F.col("_x.n").alias("n"))
    seeds = places.join(broadcast_below(grams, BROADCAST_GRAMS), "g").select("doc_id", *key, "item", "l", "p", "n")
    return saved(seeds.groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.max("n").alias("n"), F.collect_set(F.struct("item", "l", "p")).alias("_seeds")), "op9-seeds", narrow=True)


def _near(own: DataFrame, key: list[str], seeds: DataFrame, k: int) -> DataFrame:
    """seeds with _roll, all shingle hashes of the document."""
    few = (seeds.agg(F.sum(F.size("_seeds"))).first()[0] or 0) <= BROADCAST_SEEDS
    return own.select(*key, "text").join(F.broadcast(seeds) if few else seeds, key).dropDuplicates(key).withColumn("_roll", _rolling(plain_words(F.col("text")), k)).drop("text")


def candidates(own: DataFrame, key: list[str], entries: DataFrame, k: int, similarity: float, radius: int, long: bool):
    """(items, windows, pairs) for items of one k; long: items of 2^20 words and more, which need wider counters. windows: key, l, s, fp. pairs: key, l, s, item within the radius."""
    items, windows, pairs, _, _ = _candidates(own, key, entries, k, similarity, radius, long)
    return items, windows, pairs


def _candidates(own, key, entries, k, similarity, radius, long):
    lane = LONG_LANE if long else LANE
    items = entries.select("item_id", "item", "l", _rolling(F.col("_ws"), k).alias("sh"))
    seeds = _seeds(own, key, items, items.select("item", "l", F.explode("sh").alias("g")).distinct(), k, similarity)
    near = _near(own, key, seeds, k)
    # All windows of those lengths that cover a seed; the whole text where it is shorter, but has shingles enough to be similar. Along the seeds of a length both ends grow.
    fits = F.filter("_seeds", lambda x: F.col("n") - k + 1 >= (x["l"] - k + 1) * similarity - 1e-9)
    whole = lambda x: x["l"] > F.col("n")
    lo = lambda x: F.when(whole(x), 0).otherwise(F.greatest(F.lit(0), x["p"] - x["l"] + k))
    hi = lambda x: F.when(whole(x), 0).otherwise(F.greatest(F.lit(0), F.least(x["p"], F.col("n") - x["l"])))

    def stretches(*of):
        """Starts that are laid out, as stretches (of, a, b)."""
        spans = F.array_sort(F.array_distinct(F.transform(fits, lambda x: F.struct(*[x[c].alias(c) for c in of], lo(x).alias("a"), hi(x).alias("b")))))
        other = lambda x, y: x["l"] != y["l"] if of == ("l",) else (x["l"] != y["l"]) | (x["item"] != y["item"])

        def merged(v):
            begins = F.filter(v, lambda r, i: (i == 0) | other(F.get(v, i - 1), r) | (F.get(v, i - 1)["b"] + 1 < r["a"]))
            ends = F.filter(v, lambda r, i: (i == F.size(v) - 1) | other(F.get(v, i + 1), r) | (F.get(v, i + 1)["a"] > r["b"] + 1))
            return F.zip_with(begins, ends, lambda x, y: F.struct(*[x[c].alias(c) for c in of], x["a"].alias("a"), y["b"].alias("b")))

        return let(spans, merged)

    laid = near.select(*key, "n", "_roll", F.explode(stretches("l")).alias("x"))
    prints = rolled_prints(F.col("_roll"), F.col("x.a"), F.col("x.b"), F.least(F.col("x.l"), F.col("n")) - k + 1, lane)
    windows = saved(laid.select(*key, F.col("x.l").alias("l"), F.col("x.a").alias("a"), F.posexplode(prints).alias("i", "fp")).select(*key, "l", (F.col("a") + F.col("i")).alias("s"), "fp"), "op9-windows", narrow=True)
    meant = seeds.select(*key, F.explode(stretches("item", "l")).alias("x")).select(*key, F.col("x.item").alias("item"), F.col("x.l").alias("l"), F.explode(F.sequence("x.a", "x.b")).alias("s"))
    of_items = items.select("item", F.get(rolled_prints(F.col("sh"), F.lit(0), F.lit(0), F.size("sh"), lane), F.lit(0)).alias("item_fp"))
    # Within the radius some block differs in at most radius // BLOCKS bits: the item's side is entered under every such value.
    width = 64 // BLOCKS
    flips = [sum(1 << b for b in c) for n in range(radius // BLOCKS + 1) for c in itertools.combinations(range(width), n)]
    block = lambda c, b: F.shiftrightunsigned(c, width * b).bitwiseAND((1 << width) - 1)
    blocks = lambda c: F.explode(F.array(*[F.struct(F.lit(b).alias("b"), block(c, b).alias("v")) for b in range(BLOCKS)])).alias("e")
    index = of_items.select("item", "item_fp", blocks(F.col("item_fp"))).select("item", "item_fp", F.col("e.b").alias("b"), F.explode(F.array(*[F.col("e.v").bitwiseXOR(F.lit(f).cast("long")) for f in flips])).alias("v"))
    probes = meant.join(windows, [*key, "l", "s"]).select(*key, "l", "s", "fp", "item", blocks(F.col("fp"))).select(*key, "l", "s", "fp", "item", F.col("e.b").alias("b"), F.col("e.v").alias("v"))
    pairs = probes.join(broadcast_below(index, BROADCAST_GRAMS), ["item", "b", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*key, "l", "s", "item").distinct()
    return items, windows, pairs, seeds, near


def _matches(own: DataFrame, key: list[str], entries: DataFrame, k: int, similarity: float, radius: int, long: bool) -> DataFrame:
    """The similar windows for items of one k; long as for candidates."""
    items, _, pairs, seeds, near = _candidates(own, key, entries, k, similarity, radius, long)
    pairs = saved(pairs, "op9-pairs", narrow=True)
    theirs = items.select("item", F.explode("sh").alias("g")).groupBy("item", "g").agg(F.count("*").alias("c"))
    met = pairs.select(*key, "item").distinct()
    places = near.join(met.select(*key).distinct(), key, "left_semi").select(*key, F.size("_roll").alias("n_sh"), F.posexplode("_roll").alias("p", "g"))
    wanted = met.join(theirs, "item").join(items.select("item", (F.col("l") - k + 1).alias("m")), "item")
    # Places of one shingle in one document, in order: the one `c` places back has to be left behind.
    like = places.join(wanted, [*key, "g"]).groupBy(*key, "item", "g").agg(F.first("c").alias("c"), F.first(F.least("m", "n_sh")).alias("w"), F.array_sort(F.collect_list("p")).alias("ps"))
    since = F.transform("ps", lambda p, i: F.struct(F.greatest(F.lit(0), p - F.col("w") + 1, F.when(i >= F.col("c"), F.get("ps", (i - F.col("c")).cast("int")) + 1).otherwise(0)).cast("int").alias("a"), p.alias("b")))
    spans = like.select(*key, "item", F.explode(since).alias("x")).where("x.a <= x.b")
    turns = spans.select(*key, "item", F.explode(F.array(F.struct(F.col("x.a").alias("s"), F.lit(1).alias("d")), F.struct((F.col("x.b") + 1).alias("s"), F.lit(-1).alias("d")))).alias("e")).select(*key, "item", "e.s", "e.d")
    turns = turns.groupBy(*key, "item", "s").agg(F.sum("d").alias("d")).withColumn("asked", F.lit(0))
    order = W.partitionBy(*key, "item").orderBy("s", "asked").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = turns.unionByName(pairs.select(*key, "item", "s", F.lit(0).cast("long").alias("d"), F.lit(1).alias("asked"))).withColumn("_both", F.sum("d").over(order)).where("asked = 1")
    checked = both.join(items.select("item", "item_id", "l"), "item").join(seeds.select("doc_id", *key, "n"), key)
    size = F.least("l", "n") - k + 1
    checked = checked.withColumn("similarity", F.col("_both") / (size + F.col("l") - k + 1 - F.col("_both"))).where(F.col("similarity") >= similarity)
    return checked.select("doc_id", *key, "item_id", "item", (size + k - 1).alias("l"), "s", "similarity")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def sql(similarity: float = SIMILARITY, k: int = SHINGLE) -> str:
    """Every item-sized window that shares a shingle with an item, compared outright."""
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""with docs as (select doc_id, {words} as ws from documents),
items as (select item_id, ws, len(ws) as l, least({k}, len(ws)) as k, len(ws) - least({k}, len(ws)) + 1 as m from (select item_id, {words} as ws from benchmark) where len(ws) > 0),
ks as (select distinct k from items),
dg as (select doc_id, k, p, len(ws) as n, array_to_string(ws[p + 1:p + k], ' ') as g from docs, ks, unnest(range(len(ws) - k + 1)) as u(p)),
ig as (select item_id, l, k, m, array_to_string(ws[t + 1:t + k], ' ') as g from items, unnest(range(m)) as u(t)),
starts as (select distinct doc_id, item_id, l, dg.k, m, s from dg join ig on dg.g = ig.g and dg.k = ig.k, unnest(range(greatest(0, p - l + dg.k), least(p, n - l) + 1)) as u(s)),
win as (select doc_id, item_id, l, m, s, dg.g, count(*) as c from starts join dg using (doc_id, k) where dg.p between s and s + m - 1 group by all),
ic as (select item_id, g, count(*) as c from ig group by all),
same as (select doc_id, item_id, l, m, s, sum(least(win.c, ic.c)) as b from win join ic using (item_id, g) group by all),
good as (select doc_id, item_id, l, s, b / (2 * m - b) as j from same where b / (2 * m - b) >= {similarity})
select doc_id, item_id, s::int as start_word, l::int as n_words, j as similarity from good qualify row_number() over (partition by doc_id, item_id order by j desc, s) = 1"""


SQL = {"op9_benchmark_decontamination": sql()}
