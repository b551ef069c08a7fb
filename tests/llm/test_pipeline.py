"""Each stage of the pipeline against a plain version of it, on its predecessor's rows; and hard rows through all of them."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline as C
from marlstone.llm import decontaminate, mixing, toxicity
from oracle import norm
from test_operators import DOCS, HARD, brute_lines, grouped

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first stage and after each, as run() hands them on."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, f in C.STAGES:
        f(spark, docs, SF).write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out, folder


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_toxicity(spark, stages):
    out, _ = stages
    model = toxicity.train(out["documents"], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {i: r for i, r in rows(out["documents"]).items() if model.score(r.text)[0] < 0.5}
    assert rows(out["toxicity"]) == want and len(want) < out["documents"].count()


def test_line_dedup(stages):
    out, _ = stages
    before = rows(out["toxicity"])
    want = brute_lines([(r.doc_id, r.text) for r in before.values()], 2)
    got = rows(out["line_dedup"])
    assert {i: r.text for i, r in got.items()} == want
    for i, r in got.items():
        assert r.n_chars == (len(r.text) if r.text != before[i].text else before[i].n_chars) and (r.lang, r.source) == (before[i].lang, before[i].source)


def test_simhash(stages):
    """Near duplicates on word shingles take five words and a similarity of 0.8."""
    out, _ = stages
    before = sorted(rows(out["line_dedup"]).values(), key=lambda r: r.doc_id)
    sets = [words_of(r.text) for r in before]
    root = grouped(len(before), lambda i, j: near(sets[i], sets[j]))
    assert rows(out["simhash_near_dedup"]) == {r.doc_id: r for i, r in enumerate(before) if root[i] == i}


def stage_tables(folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/{name}/*.parquet')")
    con.execute(f"create view benchmark as select * from read_parquet('{SF}/benchmark.parquet')")
    return con


def test_decontamination(stages):
    out, folder = stages
    con = stage_tables(folder, "simhash_near_dedup")
    bad = {r[0] for r in con.execute(f"select distinct doc_id from ({decontaminate.sql()})").fetchall()}
    before = rows(out["simhash_near_dedup"])
    assert rows(out["decontamination"]) == {i: r for i, r in before.items() if i not in bad} and bad


def test_mixing(stages):
    out, folder = stages
    con = stage_tables(folder, "decontamination")
    want = con.execute(f"select doc_id, source, size, source_size, target, taken from ({mixing.SQL['op8_source_mix']})").fetchall()
    assert out["source_mix"].columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert sorted(map(norm, map(tuple, out["source_mix"].collect()))) == sorted(map(norm, want))


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, C.run(spark, SF).collect())) == sorted(map(tuple, stages[0]["source_mix"].collect()))
    assert C.ORACLE_SQL is None and [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "source_mix"]


def test_hard_rows_and_extra_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(HARD, DOCS).withColumns({"score": F.lit("x"), "n_removed": F.lit(1), "size": F.lit(2), "taken": F.lit("y")})
    for k, (_, f) in enumerate(C.STAGES):
        docs = f(spark, docs, SF)
        assert docs.columns == (C.COLUMNS if k < 4 else ["doc_id", "source", "size", "source_size", "target", "taken"])
    got = docs.collect()
    assert {r.doc_id for r in got} == {1, 3, 4, 5, 6, 7, None}  # empty texts are one group, copies too
    for _, f in C.STAGES:
        assert f(spark, spark.createDataFrame([], DOCS), SF).count() == 0


def words_of(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def near(a, b):
    return a == b or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9)


@pytest.mark.parametrize("leaf_rows", [40, 65_536])
def test_near_copies_by_shingle_similarity(spark, leaf_rows):
    """Every pair of similarity 0.8 that lies within the radius links, and no pair below it; leaves of a few rows find the same."""
    import random

    from marlstone.llm.simhash import NEAR_RADIUS, NEAR_WIDE, majority, near_copies, shingle_hashes

    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(rng.choice([3, 30, 120, 400]))]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randrange(0, max(1, len(t) // 25) + 1)):
                t[rng.randrange(len(t))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    texts += ["", None, "  "]
    sets = [words_of(t) for t in texts]
    prints = [tuple(map(majority, shingle_hashes(t))) for t in texts]
    apart = lambda i, j: [((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(prints[i], prints[j])]
    found = lambda i, j: apart(i, j)[0] <= NEAR_RADIUS and sum(apart(i, j)) <= NEAR_WIDE
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and near(sets[i], sets[j])]
    close = [found(i, j) for i, j in pairs if len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j])]
    print("pairs", len(pairs), "found", sum(found(i, j) for i, j in pairs), "below 0.9", len(close), sum(close))
    assert sum(found(i, j) for i, j in pairs) > 0.98 * len(pairs) and sum(apart(i, j)[0] > 2 for i, j in pairs) > 50
    root = grouped(len(texts), lambda i, j: near(sets[i], sets[j]) and (not sets[i] or found(i, j)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r._d: r.first._d for r in near_copies(df, leaf_rows=leaf_rows).collect()}
    assert got == dict(enumerate(root))
    kept = C.simhash_near_dedup(spark, df.selectExpr("doc_id", "text", "'en' as lang", "'a' as source", "1L as n_chars"), SF)
    assert {r.doc_id for r in kept.collect()} == set(root)


def test_near_copies_of_many_repeated_rows(spark):
    from marlstone.llm.simhash import near_copies

    base = [f"w{i}" for i in range(100)]
    texts = [(None, " ".join(base))] * 50 + [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(1, 99)]
    got = near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(got) == 148 and {r.first._d for r in got} == {1}


def test_rows_without_or_with_equal_ids_are_told_apart(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    other, third = "some clean words that stand in no benchmark at all", "and quite another text of clean words again here"
    make = lambda rows: spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    got = C.decontamination(spark, make([(None, leak), (None, other), (5, leak), (5, third)]), SF).collect()
    assert {(r.doc_id, r.text) for r in got} == {(None, other), (5, third)}
    got = C.simhash_near_dedup(spark, make([(None, leak), (None, leak), (3, leak), (None, other), (None, other), (4, third), (4, third)]), SF).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted([(3, leak), (-1, other), (4, third)])
