"""Substring dedup: every word inside a 35-word window that also starts elsewhere is removed.

Three steps. (1) Confirm recurring passages. Every window picks an anchor, the 8-word gram in it of least hash; equal windows pick equal anchors, and the windows of a text that share one are a stretch. Stretches are counted by anchor and digest, so all copies of a text, however many, are one row; of those that share an anchor with a different stretch the windows are counted by anchor and digest, 128 bits. What recurs, merged where windows overlap, are the passages: one row a distinct stretch. (2) Compile them into Aho-Corasick automata, sharded by the documents that need them: a shard is a bucket of documents and each passage that may occur in one of them, once. (3) Stream the shard's documents, whole texts, through its automata, which locate every occurrence. A hot passage is in many shards, so no group of a hot phrase meets in one task.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_below, each, n_parts, saved, table

WINDOW, GRAM = 35, 8
#: Stretches to a shard, about.
SHARD_ROWS = 20_000
#: Keys of documents (24 bytes each) that are sent to every task; beyond it the texts are shuffled to find them.
BROADCAST_KEYS = 1_000_000
#: Words of patterns to one automaton; a node takes some 50 bytes.
AUTOMATON_WORDS = 1_000_000
#: Rows that share id and text are spread over buckets by so many.
REPEATS = 64
NOBODY = (1 << 63) - 1
PRIME = np.uint64(0x9E3779B185EBCA87)
NOBODY = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(ws: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in ws), dtype=np.uint64, count=len(ws))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words."""
    g = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for j in range(k):
        g = g * PRIME + h[j : j + len(g)]
    return _mixed(g)


def anchors(ws: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """(anchor hash, digest of the words, first window, last window) of each stretch of window starts that share an anchor."""
    if len(ws) < window:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    h = word_hashes(ws)
    g = gram_hashes(h, gram)
    span = window - gram + 1
    pos = np.empty(len(ws) - window + 1, dtype=np.int64)
    for at in range(0, len(pos), 1 << 16):
        n = min(1 << 16, len(pos) - at)
        pos[at : at + n] = np.lib.stride_tricks.sliding_window_view(g[at : at + n + span - 1], span).argmin(1) + np.arange(at, at + n)
    first = np.nonzero(np.append(True, pos[1:] != pos[:-1]))[0]
    last = np.append(first[1:], len(pos)) - 1
    raw, digest = h.tobytes(), xxhash.xxh3_64_intdigest
    own = np.fromiter((digest(raw[8 * a : 8 * (b + window)]) for a, b in zip(first.tolist(), last.tolist())), dtype=np.uint64, count=len(first))
    return g[pos[first]], own, first.astype(np.int32), last.astype(np.int32)


def window_digests(ws: list[bytes], window: int = WINDOW) -> np.ndarray:
    """64-bit digests, as longs, of all windows."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(b" ".join(ws[s : s + window])) for s in range(len(ws) - window + 1)), dtype=np.uint64).view(np.int64)


def merged(spans) -> list[tuple[int, int]]:
    """Sorted [start, end) spans, joined where they meet."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Automaton:
    """Word sequences as patterns. Words become characters by a dictionary of the patterns' words; all others are one character that no pattern has."""

    def __init__(self):
        self.letters: dict[bytes, str] = {}
        self.trie, self.size = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0

    def add(self, ws: list[bytes]) -> None:
        letters, out = self.letters, []
        for w in ws:
            c = letters.get(w)
            if c is None:
                n = len(letters) + 1
                c = letters[w] = chr(n if n < 0xD800 else n + 0x800)  # surrogates are no characters
            out.append(c)
        if self.trie.add_word("".join(out), len(out)):
            self.size += len(out)

    def spans(self, ws: list[bytes]) -> list[tuple[int, int]]:
        """Merged [start, end) that matches cover."""
        get = self.letters.get
        return merged({(end - n + 1, end + 1) for end, n in self.trie.iter("".join([get(w, "\0") for w in ws]))})


def automata(patterns, most_words: int = AUTOMATON_WORDS):
    """Compiled automata, of about most_words words each, that hold all patterns."""
    auto = Automaton()
    for p in patterns:
        auto.add(p.split(b" "))
        if auto.size >= most_words:
            auto.trie.make_automaton()
            yield auto
            auto = Automaton()
    if auto.size:
        auto.trie.make_automaton()
        yield auto


def locate(texts: list[bytes], patterns, most_words: int = AUTOMATON_WORDS) -> list[list[tuple[int, int]]]:
    """For each text the merged word spans [start, end) in which a pattern stands. One automaton at a time is in memory."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    for auto in automata(patterns, most_words):
        for i, t in enumerate(texts):
            found[i] += auto.spans(t.split())
    return [merged(f) for f in found]


def cut_out(texts: list[bytes], spans, window: int = WINDOW):
    """Columns text, n_words, n_removed."""
    kept, n, gone = [], [], []
    for t, rs in zip(texts, spans):
        ws = t.split()
        n.append(len(ws))
        left, at = [], 0
        for a, b in rs:
            left += ws[at:a]
            at = b
        left += ws[at:]
        gone.append(len(ws) - len(left))
        kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
    return [pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())]


def stretches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs (d, h, t) -> (d, h, anchor, own, a, b): the stretches of every text whose anchor stands in another stretch too; anchor and own, the digest of its words, name a stretch."""

    def pick(batches):
        for b in batches:
            d, h, out = b.column("d").to_numpy(), b.column("h").to_numpy(), []
            for t in each(b.column("t")):
                out.append(anchors(t.encode("utf-8", "surrogatepass").split(), window, gram))
            n = [len(x[0]) for x in out]
            cat = lambda i, kind: np.concatenate([x[i] for x in out]) if out else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(d, n)), pa.array(np.repeat(h, n)), pa.array(cat(0, np.uint64).view(np.int64)), pa.array(cat(1, np.uint64).view(np.int64)), pa.array(cat(2, np.int32)), pa.array(cat(3, np.int32))],
                ["d", "h", "anchor", "own", "a", "b"],
            )

    picked = saved(docs.select("d", "h", "t").mapInArrow(pick, "d long, h long, anchor long, own long, a int, b int"), "op4-anchors")
    # Written, so that both sides of the join are plain exchanges and a hot anchor's partition can be split.
    recurring = saved(picked.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "op4-recurring", narrow=True)
    return saved(picked.join(recurring, "anchor"), "op4-around")


def recurring_passages(docs: DataFrame, around: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, own, passages): for each distinct stretch what recurs of it, an array of passages, words joined by one space. docs (d, h, t) holds each (d, h) once; stretches without a recurring window are left out."""
    name = ["anchor", "own"]
    distinct = saved(around.groupBy(*name).agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "a", "b")).alias("rep")), "op4-distinct")
    mixed = saved(distinct.groupBy("anchor").agg(F.count("*").alias("_k")).where("_k > 1").select("anchor", F.lit(True).alias("mixed")), "op4-mixed", narrow=True)
    flagged = distinct.join(mixed, "anchor", "left").select(*name, "n", F.coalesce("mixed", F.lit(False)).alias("mixed"), "rep")
    wanted = flagged.groupBy("rep.d", "rep.h").agg(F.collect_list(F.struct("rep.a", "rep.b", *name, "n", "mixed")).alias("of"))

    def read(batches):
        for b in batches:
            for t, of in zip(each(b.column("t")), each(b.column("of"))):
                ws = t.encode("utf-8", "surrogatepass").split()
                texts = [b" ".join(ws[x["a"] : x["b"] + window]) for x in of]
                yield pa.RecordBatch.from_arrays([*[pa.array([x[c] for x in of], k) for c, k in (("anchor", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("mixed", pa.bool_()))], pa.array(texts, pa.binary())], [*name, "n", "mixed", "text"])

    def windows(batches):
        for b in batches:
            for anchor, own, n, t in zip(b.column("anchor").to_pylist(), b.column("own").to_pylist(), b.column("n").to_pylist(), each(b.column("text"))):
                w = window_digests(t.split(b" "), window)
                k = len(w)
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * k, pa.int64()), pa.array([own] * k, pa.int64()), pa.array(w), pa.array([n] * k, pa.int64()), pa.array(np.arange(k), pa.int32())], [*name, "w", "n", "s"])

    def passages(batches):
        for b in batches:
            anchor, own, out = b.column("anchor"), b.column("own"), []
            for t, starts in zip(each(b.column("text")), each(b.column("starts"))):
                if starts is None:
                    out.append([t])
                else:
                    ws = t.split(b" ")
                    out.append([b" ".join(ws[x:y]) for x, y in merged((s, s + window) for s in starts)])
            yield pa.RecordBatch.from_arrays([anchor, own, pa.array(out, pa.list_(pa.binary()))], [*name, "passages"])

    keys = broadcast_below(saved(distinct.select("rep.d", "rep.h").distinct(), "op4-readers", narrow=True), BROADCAST_KEYS)
    texts = saved(docs.join(keys, ["d", "h"], "left_semi").join(wanted, ["d", "h"]).select("t", "of").mapInArrow(read, "anchor long, own long, n long, mixed boolean, text binary"), "op4-stretches")
    # Equal windows have equal anchors, so anchor and digest name a window. All windows count; those of a stretch that stands twice recur anyway and need no answer.
    wins = saved(texts.where("mixed").drop("mixed").mapInArrow(windows, "anchor long, own long, w long, n long, s int"), "op4-windows")
    again = saved(wins.groupBy("anchor", "w").agg(F.sum("n").alias("n")).where("n > 1").drop("n"), "op4-again")
    starts = wins.where("n = 1").select(*name, "w", "s").join(again, ["anchor", "w"]).groupBy(*name).agg(F.collect_set("s").alias("starts"))
    plain, found = texts.where("not mixed or n > 1").select(*name, "text", F.lit(None).cast("array<int>").alias("starts")), texts.where("mixed and n = 1").join(starts, name).select(*name, "text", "starts")
    return plain.union(found).mapInArrow(passages, "anchor long, own long, passages array<binary>")


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard_rows: int = SHARD_ROWS, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, text, n_words, n_removed for each row of docs: text is what is left, its words joined by one space.

    Words are split at ASCII white space and compared unchanged. Each window is judged on the input, so all copies go, the first one too. A null text has no words. Repeated rows are documents of their own, whose windows repeat each other. Other columns are not carried.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    own = own.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)).alias("d"), F.xxhash64("t").alias("h"), "t")
    key = ["d", "h"]
    # Rows that share id and text: each counts, one is read for all, and they are dealt to several buckets.
    repeats = saved(own.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / REPEATS).cast("int").alias("spread")), "op4-repeats", narrow=True)
    once = own.join(broadcast_below(repeats, BROADCAST_KEYS), key, "left_anti").select(*key, "t").union(own.join(broadcast_below(repeats, BROADCAST_KEYS), key, "left_semi").select(*key, "t").dropDuplicates(key))
    around = stretches(own, window, gram)
    found = recurring_passages(once, around, window)
    spread = lambda t: t.join(broadcast_below(repeats, BROADCAST_KEYS), key, "left").withColumn("spread", F.coalesce("spread", F.lit(1)))
    buckets = max(4 * n_parts(docs.sparkSession), -(-around.count() // shard_rows))
    bucket = lambda salt: F.pmod(F.xxhash64(*key, salt), F.lit(buckets)).alias("bucket")
    needs = spread(around).select("anchor", "own", *key, F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt")).select(bucket(F.col("salt")), "anchor", "own").distinct()
    patterns = needs.join(found, ["anchor", "own"]).select("bucket", "passages")
    has = saved(around.select(*key).distinct(), "op4-has", narrow=True)
    dealt = spread(own.join(broadcast_below(has, BROADCAST_KEYS), key, "left_semi")).select("doc_id", "t", bucket(F.pmod(F.monotonically_increasing_id(), F.col("spread")).cast("int")))

    def stream(rows, passages):
        ids, texts = rows.column("doc_id").combine_chunks(), [t.encode("utf-8", "surrogatepass") for t in each(rows.column("t"))]
        spans = locate(texts, (p for ps in each(passages.column("passages")) for p in ps), most_words)
        return pa.Table.from_arrays([ids, *cut_out(texts, spans)], ["doc_id", "text", "n_words", "n_removed"])

    def pass_on(batches):
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in each(b.column("t"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cut_out(texts, [[]] * len(texts))], ["doc_id", "text", "n_words", "n_removed"])

    schema = T.StructType([own.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = dealt.groupBy("bucket").cogroup(patterns.groupBy("bucket")).applyInArrow(stream, schema)
    return out.union(own.join(broadcast_below(has, BROADCAST_KEYS), key, "left_anti").select("doc_id", "t").mapInArrow(pass_on, schema))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op4_substring_dedup": f"""with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
wins as (select doc_id, p, md5(array_to_string(ws[p + 1:p + {WINDOW}], ' ')) as w from docs, unnest(range(len(ws) - {WINDOW} + 1)) as u(p)),
twice as (select w from wins group by w having count(*) > 1),
starts as (select doc_id, list(p) as ps from wins join twice using (w) group by doc_id),
marked as (select docs.doc_id, ws, list_distinct(flatten(list_transform(coalesce(ps, []), lambda p: range(p, p + {WINDOW})))) as gone from docs left join starts using (doc_id)),
words as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from docs),
cut as (select distinct doc_id, unnest(gone) + 1 as i from marked),
kept as (select words.doc_id, count(*) as n_kept, string_agg(w, ' ' order by words.i) as t from words left join cut on cut.doc_id = words.doc_id and cut.i = words.i where cut.i is null group by words.doc_id)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n_kept, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from docs left join kept using (doc_id)"""
}
