"""Ranked lexical search: the Best Position Algorithm over impact lists.

A document's score for an item is the sum of its impacts in the lists of the item's terms. Documents are dealt out in shards; a shard holds, for each term, the list of its own documents by falling impact, with direct access from a document to its place in every list. Lists are read from the top, side by side. Each document met is looked up in all lists of the item at once, which marks its places there as seen. The first place of each list that is not yet seen bounds what an unseen document can get from it, and that place lies at or below the last one read. When the sum of the bounds is strictly below the k-th score, no unseen document can enter, not even by a tie.

Statistics (N, L, df) are of all documents. Only the index of the terms that items ask for is kept: numbers, no texts. A frequent term's list is spread over all shards, so no list is hot.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, UPPER, each, plain_words, saved, table

TOP = 10
#: Items go in blocks of about so many (item, term) rows: what the driver and every task hold of the query set.
QUERY_TERMS = 200_000
#: Most documents and postings in a shard, and most terms whose direct accesses are laid out at once (a matrix of terms by documents).
SHARD_ROWS, SHARD_POSTINGS, LAID_TERMS = 4096, 4_000_000, 4096
#: Places read from each list in the first round; every round reads twice as many.
FIRST_READ = 16
# Fixed values of the contract's scores.
SCALE, BASE, SLOPE, WEIGHT = 1_000_000_000, 100, 90, 8

#: Byte by byte: A-Z to lower case, what separates terms to a blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in their order; null has none."""
    return (text or "").encode().translate(_TERM_BYTES).split()


class Shard:
    """Impact lists of some documents, numbered 0 to n - 1 in the order in which ties are settled."""

    def __init__(self, n: int, n_terms: int, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        order = np.lexsort((docs, -impacts, terms))
        self.n, self.docs, self.impacts = n, docs[order], impacts[order]
        self.first = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def laid(self, terms: np.ndarray) -> np.ndarray:
        """Direct access: for each of terms and each document where its posting stands, -1 if nowhere."""
        where = np.full((len(terms), self.n), -1, np.int32)
        for row, t in zip(where, terms):
            a, b = self.first[t], self.first[t + 1]
            row[self.docs[a:b]] = np.arange(a, b, dtype=np.int32)
        return where

    def top(self, terms: np.ndarray, where: np.ndarray, k: int, floor: int = 0, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best by score and number, score above 0; those below floor may be missing. where has a row for each of terms. trace gets (rounds, places read, documents met)."""
        there = self.first[terms + 1] > self.first[terms]
        where, start, end = where[there], self.first[terms][there], self.first[terms + 1][there]
        size = end - start
        met, score = np.zeros(self.n, bool), np.zeros(self.n, np.int64)
        none = np.zeros(0, np.int64)
        if not len(size):
            return none, none
        longest = int(size.max())
        seen = np.zeros((len(size), longest + 1), bool)  # the last column stays unseen
        depth, step, rounds, least = 0, FIRST_READ, 0, 1
        while depth < longest:
            places = start[:, None] + np.arange(depth, min(depth + step, longest))
            docs = self.docs[places[places < end[:, None]]]
            fresh = np.unique(docs[~met[docs]])
            met[fresh] = True
            at = where[:, fresh]
            rows, columns = np.nonzero(at >= 0)
            found = at[rows, columns]
            score[fresh] = np.bincount(columns, self.impacts[found], len(fresh)).astype(np.int64)  # sums stay far below 2^53
            seen[rows, found - start[rows]] = True
            depth, step, rounds = depth + step, step * 2, rounds + 1
            best = seen.argmin(1)  # contiguous seen places of each list
            bound = int(self.impacts[np.minimum(start + best, end - 1)][best < size].sum())
            have = score[met]
            kth = int(np.partition(have, len(have) - k)[len(have) - k]) if len(have) >= k else 0
            least = max(kth, floor, 1)
            if bound < least:
                break
        if trace is not None:
            trace.append((rounds, int(np.minimum(size, depth).sum()), int(met.sum())))
        docs = np.nonzero(met & (score >= least))[0]
        docs = docs[np.lexsort((docs, -score[docs]))][:k]
        return docs, score[docs]


def _count(docs: DataFrame, doc_id: str, text: str, numbers) -> DataFrame:
    """_doc, n (terms with repeats) and the counts of the numbered terms for each row of docs."""
    own = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    schema = T.StructType([own.schema["_doc"], *T.StructType.fromDDL("n long, terms array<int>, counts array<int>").fields])

    def count(batches):
        number = numbers.value.get
        for b in batches:
            sizes, ends, terms, counts = [], [0], [], []
            for t in each(b.column(1)):
                ws = terms_of(t)
                for w, c in Counter(ws).items():
                    if (i := number(w)) is not None:
                        terms.append(i)
                        counts.append(c)
                sizes.append(len(ws))
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *lists], schema.names)

    return own.mapInArrow(count, schema)


def _shards(batches):
    """Tables of SHARD_ROWS rows and SHARD_POSTINGS postings at most (one row may have more), ordered by document, null last."""
    held, rows, postings = [], 0, 0

    def made():
        got = pa.Table.from_batches(held)
        return got.take(pc.sort_indices(got, [("_doc", "ascending")], null_placement="at_end")).combine_chunks()

    for b in batches:
        sizes = pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False)
        a = 0
        for i, s in enumerate(sizes):
            if rows and (rows == SHARD_ROWS or postings + s > SHARD_POSTINGS):
                if i > a:
                    held.append(b.slice(a, i - a))
                yield made()
                held, rows, postings, a = [], 0, 0, i
            rows, postings = rows + 1, postings + int(s)
        if len(sizes) > a:
            held.append(b.slice(a))
    if held:
        yield made()


def _groups(items: list[np.ndarray], most: int):
    """Neighbouring items whose terms together are at most `most` (one item may have more): (first, end, their terms)."""
    a, have = 0, set()
    for i, terms in enumerate(items):
        new = have | set(terms.tolist())
        if i > a and len(new) > most:
            yield a, i, np.array(sorted(have))
            a, new = i, set(terms.tolist())
        have = new
    if items:
        yield a, len(items), np.array(sorted(have), dtype=np.int64)


def _search_block(docs: DataFrame, items: list, doc_id: str, text: str, top: int) -> DataFrame:
    """(item, score, _doc): for each of items (number, terms) the best of each task's documents, the overall best among them."""
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    asked = [(i, np.array(sorted(number.setdefault(t.encode(), len(number)) for t in terms), dtype=np.int64)) for i, terms in items]
    counted = saved(_count(docs, doc_id, text, spark.sparkContext.broadcast(number)), "op11-counts")
    held = counted.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    n_docs, n_all = held["docs"], max(1, held["all"])
    df = counted.select(F.explode("terms").alias("t")).groupBy("t").count()
    weight = F.floor(F.lit(1000) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("count") + 1).cast("double"))).cast("long")
    weights = np.zeros(len(number), np.int64)
    for r in df.select("t", weight.alias("w")).toLocalIterator():  # a number for each term of the block
        weights[r["t"]] = r["w"]
    wide = "decimal(38,0)"
    m = F.expr(f"cast({BASE - SLOPE} + (cast({SLOPE} as {wide}) * n * {n_docs}) div {n_all} as bigint)")
    index = counted.where(F.size("terms") > 0).select("_doc", m.alias("m"), "terms", "counts")
    shared = spark.sparkContext.broadcast(([i for i, _ in asked], [t for _, t in asked], weights))
    schema = T.StructType([*T.StructType.fromDDL("item long, score long").fields, counted.schema["_doc"]])

    id_type = to_arrow_type(counted.schema["_doc"].dataType)

    def rank(batches):
        names, asked, weights = shared.value
        best: list[list] = [[] for _ in names]  # (-score, id is null, id)
        groups = list(_groups(asked, LAID_TERMS))
        for got in _shards(batches):
            lists = got.column("terms").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            rows = np.repeat(np.arange(len(got)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            terms, counts = (pc.list_flatten(got.column(c)).to_numpy().astype(np.int64) for c in ("terms", "counts"))
            lengths = got.column("m").to_numpy()[rows]
            shard = Shard(len(got), len(weights), rows, terms, weights[terms] * (SCALE * counts // (1000 * counts + WEIGHT * lengths)))
            ids = got.column("_doc")
            for a, b, laid in groups:
                where = shard.laid(laid)
                for i in range(a, b):
                    floor = -best[i][-1][0] if len(best[i]) == top else 0
                    found, scores = shard.top(asked[i], where[np.searchsorted(laid, asked[i])], top, floor)
                    new = [(-s, (d := ids[x].as_py()) is None, d) for x, s in zip(found.tolist(), scores.tolist())]
                    if new:
                        best[i] = sorted(best[i] + new, key=lambda r: r if not r[1] else r[:2] + (0,))[:top]
        flat = [(n, -s, d) for n, rows in zip(names, best) for s, _, d in rows]
        columns = zip(*flat) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), id_type))], schema.names)

    return index.mapInArrow(rank, schema)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items the `top` rows of docs that score highest, scores above 0, equal scores by ascending doc_id, null last.

    A null text has no terms; an item without terms has no rows, nor has anything where docs is empty. Rows are told apart: rows of docs with equal ids are ranked each by itself, and so are rows of items, so equal rows of items give equal rows. Columns beyond id and text are not looked at. Items go in blocks of about query_terms terms, each against all documents; an item longer than that is a block's own.
    """
    asked = saved(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("_item_id"), F.array_distinct(plain_words(F.col(text))).alias("terms")), "op11-items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // query_terms))
    found = None
    for b in range(blocks):
        some = asked.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)).select("item", "terms")
        got = _search_block(docs, [(r["item"], r["terms"]) for r in some.toLocalIterator()], doc_id, text, top)
        found = got if found is None else found.unionByName(got)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("_doc"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(asked.select("item", "_item_id"), "item").select(F.col("_item_id").alias("item_id"), "rank", F.col("_doc").alias("doc_id"), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = {
    "op11_lexical_search": f"""with docs as materialized (select row_number() over () as r, doc_id, {_TERMS} as ws from documents),
items as materialized (select row_number() over () as i, item_id, list_distinct({_TERMS}) as ts from benchmark),
totals as (select count(*) filter (len(ws) > 0) as n_docs, sum(len(ws))::bigint as n_all from docs),
wanted as materialized (select i, item_id, unnest(ts) as term from items),
postings as materialized (select r, term, count(*) as tf from (select r, unnest(ws) as term from docs) where term in (select term from wanted) group by r, term),
weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from postings, totals group by term, n_docs),
lengths as (select r, doc_id, {BASE - SLOPE} + (({SLOPE} * len(ws)::bigint * n_docs) // n_all) as m from docs, totals where len(ws) > 0),
scored as (
  select i, item_id, doc_id, r, sum(w * (({SCALE} * tf) // (1000 * tf + {WEIGHT} * m)))::bigint as score
  from wanted join weights using (term) join postings using (term) join lengths using (r) group by all),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= {TOP}"""
}
