"""Ranked search, importance resampling and BPE against plain versions, and on hard rows."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from oracle import duck
from pyspark.sql import functions as F

from marlstone.llm import bpe, resample, search

DOCS = "doc_id long, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BYTES_50K = public_tokenizers.path("byte_bpe_50k.json")

HARD = [
    (1, None),
    (2, ""),
    (2, "Alpha beta GAMMA; alpha"),
    (2, "Alpha beta GAMMA; alpha"),
    (None, "alpha beta gamma alpha"),
    (None, "alpha beta gamma alpha"),
    (None, "!!! ... \t\n"),
    (3, "ÄLPHA älpha \x00alpha\x7fbeta 𝄞 beta"),
    (4, "delta " * 30_000 + "omega"),
    (5, "x" * 200_000 + " alpha"),
]


def words(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def ranked(docs, items, top=10):
    """The contract in plain Python, row by row."""
    counts = [(d, Counter(words(t))) for d, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            n, s = sum(c.values()), 0
            for t in set(words(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for _, x in counts) + 1)))
                s += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_all)))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("query_terms", [200_000, 3])
def test_search_hard_rows(spark, query_terms):
    items = [(1, "alpha beta"), (1, "delta omega"), (2, None), (3, ""), (None, "ALPHA alpha älpha"), (4, "nowhere"), (5, "delta " * 5000)]
    docs = spark.createDataFrame(HARD, DOCS).repartition(3).withColumns({"score": F.lit(1), "rank": F.lit("x"), "item": F.lit(0), "_doc": F.lit(0)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"terms": F.lit(1), "doc_id": F.lit(9)})
    assert found(search.search(docs, asked, query_terms=query_terms)) == ranked(HARD, items)
    none = spark.createDataFrame([], DOCS)
    assert search.search(none, asked).count() == 0
    assert search.search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_search_of_many_ties(spark):
    rng = random.Random(3)
    docs = [(rng.randrange(300), " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 2, 5])))) for _ in range(500)]
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(3))) for i in range(12)]
    got = found(search.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, "item_id long, text string")))
    assert got == ranked(docs, items)


def test_best_positions_stop_early_and_lose_nothing():
    rng = np.random.default_rng(7)
    for trial in range(30):
        n, n_terms, k = 3000, 12, 10
        impacts = rng.integers(0, 50 if trial % 2 else 1_000_000, (n_terms, n)) * (rng.random((n_terms, n)) < 0.3)
        impacts[:, : 2 * k] = impacts.max()  # some documents stand out in every list, by ties
        terms, docs = np.nonzero(impacts)
        shard = search.Shard(n, n_terms, docs, terms, impacts[terms, docs])
        asked = np.arange(n_terms)
        trace = []
        got, scores = shard.top(asked, shard.laid(asked), k, trace=trace)
        total = impacts.sum(0)
        want = np.lexsort((np.arange(n), -total))[:k]
        assert got.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
        assert trace[0][1] < len(docs) / 4 and trace[0][2] < n  # places read, documents met
        floor = int(total[want][4])
        some, _ = shard.top(asked, shard.laid(asked), k, floor=floor)
        assert set(want[total[want] >= floor].tolist()) <= set(some.tolist())


def test_groups_of_items_bound_the_terms():
    items = [np.array(x) for x in ([1, 2], [2, 3], [4], [1, 2, 3, 4, 5, 6], [6])]
    got = list(search._groups(items, 3))
    assert [(a, b) for a, b, _ in got] == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert got[0][2].tolist() == [1, 2, 3]


def features(text):
    ws = words(text)
    return [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def drawn(docs, target, percent=5, least=20):
    bucket = lambda g: crc32(g.encode()) % 10_000
    s, t = Counter(bucket(g) for _, x in docs for g in features(x)), Counter(bucket(g) for x in target for g in features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s | t}
    out = []
    for d, x in docs:
        w = sum(gain[bucket(g)] for g in features(x))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(features(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x)) >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    able = [(*r[:4], i if i <= percent * len(able) // 100 else None) for i, r in enumerate(able, 1)]
    return sorted(able + [(*r[:4], None) for r in out if not r[4]], key=repr)


def taken(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resampling_hard_rows(spark, percent):
    rng = random.Random(11)
    more = [(rng.choice([None, 7, 8, i]), " ".join(rng.choice(["Alpha", "beta", "gamma", "Ünï", "x1"]) for _ in range(rng.choice([19, 20, 21, 60])))) for i in range(60)]
    docs = HARD + more + [(9, "beta gamma " * 15)] * 40
    target = ["alpha beta alpha beta", None, "", "x1 x1 x1"]
    df = spark.createDataFrame(docs, DOCS).repartition(3).withColumns({c: F.lit("y") for c in ("weight", "rank", "_tie", "_one", "n_words")})
    got = taken(resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, keep=["doc_id", "weight"]))
    assert got == drawn(docs, target, percent)
    none = spark.createDataFrame([], DOCS)
    assert resample.resample(none, none).count() == 0
    assert taken(resample.resample(df, none)) == drawn(docs, [])


def test_grams_of_slices_and_odd_letters():
    texts = ["İ K Å \x85 \xa0a", None, "", "a b c d", "𝄞𝄞 é"] * 30
    for part in (pa.array(texts), pa.array(texts).slice(7, 60)):
        want = [crc32(g.encode()) for n in (1, 2, 3) for t in part.to_pylist() for g in features(t) if g.count(" ") == n - 1]
        assert [int(h) for hashes, _ in resample.grams(part) for h in hashes] == want


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES_50K)


ODD = [
    "it's I'LL we've  'tis ''s",
    "a  b   c\n\n\td \n e \r\n",
    "   ",
    "  x　 y z \x85\x1c\x1d\x1e\x1f ᠎​﻿",
    "<|endoftext|>",
    "a <|endoftext|><|endoftext|> b <|endoftext |> <|endoftext|",
    "x1½²Ⅷ٣ 漢字かな 𝄞𝒳 é İ",
    "\U0001fae8 \U0001f1e9\U0001f1ea � \x00\x01",
    "1" * 5000 + "a" * 5000 + " " * 5000 + "!" * 5000,
    "new letters Ɤ\U0001e4d0x \U00011f02\U00010d4a1",
]


def encoded(docs, tokenizer):
    return sorted(((d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in docs), key=repr)


@pytest.mark.parametrize("block_words", [bpe.BLOCK_WORDS, 7])
def test_bpe_hard_rows(spark, tokenizer, block_words):
    docs = HARD + list(enumerate(ODD)) + [(None, ODD[1])] * 3
    df = spark.createDataFrame(docs, DOCS).repartition(3).withColumns({c: F.lit("y") for c in ("ids", "_block", "_words", "other", "decoded")})
    ids = bpe.encode(df, BYTES_50K, keep=["doc_id", "ids", "other", "_words"], block_words=block_words)
    assert ids.columns == ["doc_id", "other", "ids"]
    assert sorted(((r.doc_id, r.ids) for r in ids.collect()), key=repr) == encoded(docs, tokenizer)
    back = bpe.decode(ids, BYTES_50K)
    assert Counter(r.decoded for r in back.collect()) == Counter(t or "" for _, t in docs)
    none = bpe.encode(spark.createDataFrame([], DOCS), BYTES_50K)
    assert none.count() == 0 and bpe.decode(none, BYTES_50K).count() == 0


def test_decode_of_any_ids(spark, tokenizer):
    rng = random.Random(2)
    lists = [[rng.randrange(50_257) for _ in range(rng.choice([0, 1, 7, 300]))] for _ in range(60)] + [[50_256, 50_256, 10], [60_000, 5, -1]]
    got = bpe.decode(spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(99, None)], "n int, ids array<int>"), BYTES_50K).collect()
    want = [tokenizer.decode([i for i in x if 0 <= i < 50_257], skip_special_tokens=False) for x in lists]
    assert [r.decoded for r in sorted(got)] == [*want, None]


def test_words_of_every_known_character(spark, tokenizer):
    """The JVM's classes agree with the library's on each character that the JVM knows; texts with others go to the library. U+FEFF, which UTF-32 would drop as a mark here, is among ODD."""
    points = spark.range(0x110000).where("not id between 55296 and 57343 and id <> 65279").select(F.col("id").cast("int").alias("c"))
    as_text = F.expr("decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32')")
    texts = points.select("c", as_text.alias("x")).where(~F.col("x").rlike(bpe.UNKNOWN))
    split = texts.select("c", *[F.size(bpe.split_words(F.concat(F.lit(p), "x"), [])).alias(n) for p, n in (("a", "letter"), ("1", "digit"), ("!", "other"))]).toPandas()
    size = lambda t: len(tokenizer.pre_tokenizer.pre_tokenize_str(t))
    wrong = [hex(c) for c, a, b, o in split.itertuples(index=False) if (size("a" + chr(c)), size("1" + chr(c)), size("!" + chr(c))) != (a, b, o)]
    assert len(split) > 270_000 and not wrong


def test_bpe_digests(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in bpe.op13_bpe(spark, sf).collect()}
    for d, t in duck(sf).execute("select doc_id, text from documents").fetchall():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        assert got[d] == (d, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(tokenizer.decode(ids, skip_special_tokens=False).encode()))
