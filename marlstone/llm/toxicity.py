"""Toxicity by multiple-instance learning: a document is toxic if some sentence is.

Sentence probabilities from word weights are combined by noisy-or, 1 - prod(1 - p), and trained from document labels alone; afterwards the sentences that carry a document's score are located.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each, hash_sample, table

SENTENCE_END = re.compile(r"[.!?\n]+")
TOKEN = re.compile(r"[^\W_]+")
#: The model is fitted on about so many labelled rows (never twice as many), chosen by hash; both labels get half, if there are enough. Everything else sees all rows.
TRAIN_ROWS = 4000
#: And on at most so many bytes of text, half for each label: rows are taken in the order of the hash while they fit.
TRAIN_BYTES = 16_000_000
MIN_DOCS = 4
STEMS = (4, 5, 6, 7)


def sentences(text: str | None):
    """(start, end, sentence) by code points; blank ones are left out."""
    text = text or ""
    at = 0
    for m in SENTENCE_END.finditer(text):
        if text[at : m.start()].strip():
            yield at, m.start(), text[at : m.start()]
        at = m.end()
    if text[at:].strip():
        yield at, len(text), text[at:]


def features(word: str):
    """A word and its beginnings: stems carry over to forms that training never saw."""
    yield word
    for k in STEMS:
        if len(word) > k:
            yield word[:k] + "*"


class Model:
    """Feature weights and bias of a sentence's logit, a sum over its distinct words."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def word(self, w: str) -> float:
        if len(self.known) >= 100_000:  # a cache, so its bound changes no score
            self.known.clear()
        get = self.weights.get
        u = self.known[w] = sum(get(f, 0.0) for f in features(w))
        return u

    def score(self, text: str | None, least: float = 0.5):
        """(score, sentences at or above `least`, start and end of the worst sentence or None). A text without sentences scores 0."""
        known, word, safe, n, worst = self.known, self.word, 0.0, 0, (-1e9, None, None)
        text = text or ""
        low = text.lower()
        if len(low) != len(text):  # a few letters change length with case; positions refer to the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        limit = math.log(least / (1 - least))
        for a, b, s in sentences(low):
            z = self.bias
            for w in set(TOKEN.findall(s)):
                z += known[w] if w in known else word(w)
            safe += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))  # -log(1 - p)
            n += z >= limit
            if z > worst[0]:
                worst = (z, a, b)
        return 1 - math.exp(-safe), n, worst[1], worst[2]


def fit(texts: list[str], labels: list[int], min_docs: int = MIN_DOCS, rounds: int = 250, rate: float = 0.15, ridge: float = 2e-5, lasso: float = 3e-4) -> Model:
    """Full-batch Adam on the noisy-or likelihood, each label weighing half. Features in fewer than min_docs documents are left out; lasso keeps the rest to those that pay. Without both labels the model scores everything 0."""
    if not len(texts) or len(set(labels)) < 2:
        return Model({}, -60.0)
    y = np.array(labels, dtype=float)
    word_id: dict[str, int] = {}
    sent_doc, sizes, ids = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        for _, _, s in sentences(t.lower()):
            found = set(TOKEN.findall(s))
            ids.extend(word_id.setdefault(w, len(word_id)) for w in sorted(found))
            sizes.append(len(found))
            sent_doc.append(d)
    sent_doc, cols = np.frombuffer(sent_doc, dtype=np.int32), np.frombuffer(ids, dtype=np.int32)
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), np.frombuffer(sizes, dtype=np.int32))
    n_s, n_v = len(sent_doc), len(word_id)
    feature_id: dict[str, int] = {}
    of_word, of_feature = array("i"), array("i")
    for w, i in word_id.items():
        for f in features(w):
            of_word.append(i)
            of_feature.append(feature_id.setdefault(f, len(feature_id)))
    of_word, of_feature = np.frombuffer(of_word, dtype=np.int32), np.frombuffer(of_feature, dtype=np.int32)
    # Documents by feature: each (document, feature) once.
    starts = np.searchsorted(of_word, np.arange(n_v + 1))
    pair = np.unique(sent_doc[rows].astype(np.int64) * n_v + cols)
    docs_, words_ = pair // n_v, pair % n_v
    n_f = starts[words_ + 1] - starts[words_]
    each_ = np.repeat(starts[words_] - np.append(0, np.cumsum(n_f)[:-1]), n_f) + np.arange(n_f.sum())
    seen = np.zeros(len(feature_id), dtype=np.int64)
    of_pair = np.repeat(docs_, n_f)
    for d in np.split(of_feature[each_], np.searchsorted(of_pair, np.arange(1, len(texts)))):
        seen[np.unique(d)] += 1
    good = seen >= min_docs
    number = np.cumsum(good) - 1
    keep = good[of_feature]
    of_word, of_feature, n_w = of_word[keep], number[of_feature[keep]], int(good.sum())
    names = [f for f, i in feature_id.items() if good[i]]
    del of_pair, each_, pair, docs_, words_, feature_id
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    theta = np.zeros(n_w + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        u = np.bincount(of_word, theta[of_feature], n_v)
        z = np.bincount(rows, u[cols], n_s) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        safe = np.bincount(sent_doc, np.logaddexp(0, z), len(y))
        q = np.maximum(np.exp(-safe), 1e-12)  # probability of no toxic sentence
        pull = np.where(y == 1, q / np.maximum(1 - q, 1e-9), -1.0) * weight
        gz = pull[sent_doc] * p
        gu = np.bincount(cols, gz[rows], n_v)
        g = -np.append(np.bincount(of_feature, gu[of_word], n_w), gz.sum())
        g[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta -= step * (m / (1 - 0.9**t))
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(0, np.abs(theta[:-1]) - np.minimum(step[:-1], 1e3) * lasso)
    return Model({f: float(theta[i]) for i, f in enumerate(names) if abs(theta[i]) > 1e-3}, float(theta[-1]))


def held_out(doc_id: str | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def fitting(rows, budget: int) -> list[tuple]:
    """Of rows (doc_id, mark, size, ...) those that fit the budget of bytes, taken in the order given; one that doesn't is passed over."""
    out, spent = [], 0
    for r in rows:
        if spent + r[2] <= budget:
            spent += r[2]
            out.append((r[0], r[1]))
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, **options) -> Model:
    """A model from rows of docs (doc_id, text) with a label toxic of 0 or 1, held-out rows (crc32 of the id as text, mod 5, is 0) left out; about `rows` of them and at most `most_bytes` bytes of text. Of rows that share an id one is taken, the one of least hash; an id with both labels counts for both."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).select("doc_id", "toxic").distinct()
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # The bounded choice comes first: ids, then sizes, then the texts of those that fit.
    of = lambda label: hash_sample(known.where(F.col("toxic") == label), ["doc_id"], rows // 2, count.get(label, 0))
    chosen = of(1).union(of(0))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    sizes = texts.select("doc_id", "mark", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("mark", "size")).alias("m"))
    sizes = sizes.select("doc_id", "m.mark", "m.size", "toxic", F.xxhash64(F.lit("order"), "doc_id").alias("place")).orderBy("place", "doc_id").collect()
    picked = [(*r, label) for label in (0, 1) for r in fitting([x for x in sizes if x["toxic"] == label], most_bytes // 2)]
    wanted = docs.sparkSession.createDataFrame(picked, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, toxic int")
    rows_ = texts.join(F.broadcast(wanted), ["doc_id", "mark"]).dropDuplicates(["doc_id", "toxic"]).select(F.col("doc_id").cast("string").alias("id"), "text", "toxic")

    def learn(batches):
        """The bounded sample in one task, which spares the driver the memory; the weights come back."""
        parts = [b.to_pandas() for b in batches]
        got = pd.concat(parts).sort_values(["id", "toxic", "text"]) if parts else pd.DataFrame({"text": [], "toxic": []})
        model = fit(got["text"].tolist(), got["toxic"].astype(int).tolist(), **options)
        names = sorted(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array(["", *names], pa.string()), pa.array([model.bias, *[model.weights[n] for n in names]], pa.float64())], ["name", "weight"])

    learned = {r["name"]: r["weight"] for r in rows_.coalesce(1).mapInArrow(learn, "name string, weight double").collect()}
    bias = learned.pop("", -60.0)
    return Model(learned, bias)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs named in keep (doc_id alone if None) with score, n_offending, worst_start, worst_end for each row.

    The whole text is read; nulls count as empty and score 0. worst_* span the sentence that weighs most, null without one. Columns of docs that have one of these names are not kept.
    """
    made = {"score": "double", "n_offending": "long", "worst_start": "long", "worst_end": "long"}
    keep = [c for c in (keep or [doc_id]) if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    own = docs.select(*keep, F.col(text).alias("_text"))

    def of(batches):
        m = Model(*shared.value)
        for b in batches:
            got = [m.score(t) for t in each(b.column(len(keep)))]
            arrays = [pa.array([min(1.0, max(0.0, float(g[0]))) for g in got], pa.float64())]
            arrays += [pa.array([None if g[i] is None else int(g[i]) for g in got], pa.int64()) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *arrays], [*keep, *made])

    schema = T.StructType([own.schema[c] for c in keep] + [T.StructField(c, T.DoubleType() if t == "double" else T.LongType()) for c, t in made.items()])
    return own.mapInArrow(of, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_end")
