"""Each operator against brute force or its SQL on the smallest tables, and on rows that are hard: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, graph, licenses, lines, mixing, passages, registry, secrets, simhash, toxicity, vectors, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

HARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (2, "", "en", "a", 0),
    (None, "same words here again\nand more of them", "en", "b", 5),
    (3, "token = 'abcdefghijkl' x AKIA" + "B" * 16 + " y " + "0f" * 12, "en", "b", 1),
    (4, "é𝄞 password: hunter2hunter2 𝄞 secret=short api-key = none", "en", None, 1),
    (5, "wörd " * 4000, "de", "b", 1),
    (6, "Licensed under CC BY 4.0. All rights reserved.\nall  Rights-reserved", "en", "c", 1),
    (7, "one two three four five six seven eight nine ten", "en", "c", 1),
    (8, "one two three four five six seven eight nine ten", "en", "c", 1),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    n, differences = compare(registry.QUERIES[name](spark, SF), duck(SF), registry.SQL[name])
    assert not differences and n


def base_spans(text):
    text = text or ""
    found = []
    for kind, p, group, least in (("assign", secrets.ASSIGN, 1, 12), ("access", secrets.ACCESS, 0, 18), ("hex", secrets.HEX, 0, 16)):
        found += [(m.start(), ["assign", "access", "hex"].index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if len(m[group]) >= least]
    return [x[2] for x in sorted(found)]


def test_secrets_hard_rows(spark, hard, empty):
    got = secrets.scan_secrets(hard.withColumnRenamed("lang", "secret_spans")).collect()
    assert len(got) == len(HARD)
    for r in got:
        assert [f"{secrets.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.secret_spans if s.kind < 3] == base_spans(r.text)
    assert secrets.scan_secrets(empty).count() == 0


def test_many_matches_keep_their_places(spark):
    text = " ".join("%020x" % (i * 7919) for i in range(500))
    got = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().secret_spans
    assert [f"hex:{s.start}:{s.end}" for s in got if s.kind == 2] == base_spans(text)


def test_entropy_windows_by_brute_force(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    cases = ["".join(rng.choice(letters[: rng.choice([4, 16, 64])]) for _ in range(rng.choice([20, 21, 45, 70]))) for _ in range(40)]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", secrets.entropy_windows(F.col("c"), F.lit(3.77)).alias("out")).collect()
    for r in rows:
        covered = set()
        for i in range(len(r.c) - 19):
            w = r.c[i : i + 20]
            if -sum(w.count(x) / 20 * math.log2(w.count(x) / 20) for x in set(w)) >= 3.77:
                covered |= set(range(i, i + 20))
        assert set().union(*[range(s.a, s.b) for s in r.out]) == covered if r.out else not covered


def test_licenses_hard_rows(spark, hard, empty):
    got = {r.doc_id: r for r in licenses.scan_licenses(hard).collect()}
    assert len(licenses.scan_licenses(hard).collect()) == len(HARD) and licenses.scan_licenses(empty).count() == 0
    assert (got[1].n_words, got[2].n_words, got[1].score) == (0, 0, 0.0)
    six = got[6]
    assert (six.n_words, six.n_base, six.first_word, six.last_word) == (12, 3, 2, 9)
    assert six.base_labels == "cc-by,reserved" and "cc-by-4.0" in six.labels.split(",")


def test_licenses_tolerate_an_inserted_word(spark):
    text = "x " * 50 + "This work is also licensed under the GNU General Public License, version 3. " + "y " * 10
    got = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, "licensed under the moon")], "doc_id long, text string"), min_cover=0.6).collect()
    by = {r.doc_id: r for r in got}
    assert "gpl-3.0" in by[1].labels and by[2].labels == "" and by[2].score == 0


def links(x, threshold):
    good = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in x]
    return lambda i, j: good[i] and good[j] and len(x[i]) == len(x[j]) and float(np.dot(x[i], x[j])) / math.sqrt(float(np.dot(x[i], x[i])) * float(np.dot(x[j], x[j]))) >= threshold


def grouped(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12))
    x = [(centres[rng.integers(30)] + rng.normal(size=12) * rng.choice([0, 0.02, 0.1])).tolist() for _ in range(300)]
    x += [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 0.0], [2.0, 0.0], [1e200] * 12, [2e200] * 12]
    label = [int(v) if v < 2 else None for v in rng.integers(0, 3, len(x) - 4)] + [0, 0, 1, 1]
    df = spark.createDataFrame([(i, v, k, "e") for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int, rep string")
    got = {r.vec_id: r for r in vectors.link_vectors(df, tile_rows=32).collect()}
    big = [None if v is None else [c / 1e200 if c and abs(c) > 1e100 else c for c in v] for v in x]
    near = links(big, 0.98)
    linked = lambda i, j: label[i] is not None and label[i] == label[j] and near(i, j)
    want = grouped(len(x), linked)
    for i in range(len(x)):
        assert got[i].component_id == want[i] and got[i].kept == (want[i] == i)
        assert got[i].n_links == sum(linked(i, j) for j in range(len(x)) if j != i)
    assert vectors.link_vectors(df.limit(0)).count() == 0


def test_vectors_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in vectors.link_vectors(df).collect())
    assert got == [(-1, 0, -1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def brute_passages(texts, window):
    ws = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for w in ws:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_by_brute_force(spark, seed):
    rng = random.Random(seed)
    common = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.choice([20, 40, 70]))) for _ in range(5)]
    texts = [None, "", "short", "loop " * 90, "x y \x1cz"]
    for _ in range(40):
        texts.append(" \n".join(rng.choice(common) if rng.random() < 0.4 else " ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(60))) for _ in range(5)))
    texts += [texts[9], common[1][:-5]]
    df = spark.createDataFrame([(i if i % 11 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, h int")
    got = sorted((r.n_words, r.n_removed, r.text) for r in passages.dedup_passages(df, shard_rows=30, most_words=200).collect())
    assert got == sorted(brute_passages(texts, 35))
    assert passages.dedup_passages(df.limit(0)).count() == 0


def test_passages_of_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(None, long)] * 200 + [(7, long + " end")] * 2 + [(8, "a few words"), (8, "a few words"), (9, " ".join(f"v{i}" for i in range(80)))]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.text) for r in passages.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), shard_rows=10).collect())
    assert got == [(-1, 80, 80, "")] * 200 + [(7, 81, 81, "")] * 2 + [(8, 3, 0, "a few words")] * 2 + [(9, 80, 0, rows[-1][1])]


def test_passages_small_automata():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcde") for _ in range(60)).encode() for _ in range(20)]
    patterns = [b" ".join(t.split()[k : k + 6]) for t in texts[:10] for k in (3, 20, 41)]
    want = []
    for t in texts:
        ws = t.split()
        want.append(passages.merged({(i, i + 6) for i in range(len(ws) - 5) if b" ".join(ws[i : i + 6]) in patterns}))
    assert passages.locate(texts, patterns) == want == passages.locate(texts, patterns, most_words=20)
    assert len(list(passages.automata(patterns, 20))) > 3 and passages.locate([], []) == []


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX", "<p>é</p>", "q"), (2, None, "<p>é</p>", "q"), (3, "u", None, None), (4, "u", "", "z"), (5, "u", "x" * 200_000, "z"), (None, "u", "<p>é</p>", "z"), (None, "u", "lone", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    archives = warc.write_archives(df, f"file://{tmp_path}/w", archive_bytes=70_000)
    got = sorted(((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect()), key=repr)
    want = [(1, 9, "response", None), (2, 9, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 200_000, "response", None), (-1, 9, "revisit", 1), (-1, 4, "response", None)]
    assert got == sorted(want, key=repr)
    files = [f for f in os.listdir(tmp_path / "w") if not f.startswith(".")]
    assert all(f.endswith(".warc.zst") for f in files)
    assert all(warc.parse(raw)["fields"]["warc-type"] for f in files for raw in warc.records(f"{tmp_path}/w/{f}"))
    at_least = warc.read_archives(warc.write_archives(df, f"file://{tmp_path}/w2", min_bytes=10)).collect()
    assert all(r.record_type == "response" for r in at_least)
    assert warc.read_archives(warc.write_archives(df.limit(0), f"file://{tmp_path}/w3")).count() == 0
    good = (tmp_path / "w" / files[0]).read_bytes()
    (tmp_path / "bad.warc.zst").write_bytes(good[:-3])
    with pytest.raises(Exception):
        list(warc.records(str(tmp_path / "bad.warc.zst")))


def test_toxicity_held_out(spark):
    from ranking import auc

    sf = "/root/testdata/sf0.1"
    out = toxicity.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.toxic).mean() > 0.96
    assert out[out.toxic == 1].predicted.mean() > 0.8 and out[out.toxic == 0].predicted.mean() < 0.02
    assert auc(out.score, out.toxic) > 0.95


def test_toxicity_hard_rows(spark, hard, empty):
    model = toxicity.fit(["you idiot. fine day", "fine day. a word", "an idiot here", "a day of words"] * 5, [1, 0, 1, 0] * 5)
    got = toxicity.score(hard, model, keep=["doc_id", "source"]).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
    assert model.score("Well. You IDIOT! Bye.")[0] > 0.5 and model.score("a fine day")[0] < 0.5 and model.score(None)[0] == 0
    assert model.score("Well. You IDIOT! Bye.")[2:] == (5, 15)
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.train(hard, spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing.score("anything at all")[0] < 1e-9
    assert toxicity.held_out(7) == (zlib.crc32(b"7") % 5 == 0)


def brute_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_by_brute_force(spark, hard):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(hard.select((1000 + hard.doc_id).alias("doc_id"), "text"))
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    root = grouped(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    least = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r] = min(least.get(r, 1 << 62), ids[i])
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in simhash.simhash_groups(docs).collect())
    assert got == sorted((ids[i] or -1 if ids[i] != 0 else -1, f"{fps[i]:016x}", least.get(root[i], None) or -1) for i in range(len(rows)))
    assert simhash.simhash_groups(hard.limit(0)).count() == 0


def test_vantage_points_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) for _ in range(3)] + [np.arange(200, dtype=np.uint64)]))
    want = {(min(a, b), max(a, b)) for a in range(len(fps)) for b in np.nonzero(np.bitwise_count(fps[a] ^ fps) <= 2)[0] if a != b}
    nodes = simhash.plant(fps[::3], len(fps), leaf_rows=20)
    assert len(nodes) > 30
    leaf, row, home = simhash.route(nodes, fps)
    assert np.bincount(row[home], minlength=len(fps)).tolist() == [1] * len(fps)
    found = set()
    for x in np.unique(leaf):
        idx, at_home = row[leaf == x], home[leaf == x]
        i, j = simhash.search(fps[idx[at_home]], fps[idx], brute=2000)
        found |= {(min(a, b), max(a, b)) for a, b in zip(idx[at_home][i], idx[j]) if a != b}
    assert found == want
    df = spark.createDataFrame([(int(i), int(v)) for i, v in enumerate(fps.view(np.int64))], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.near_groups(df, leaf_rows=64).collect()}
    root = list(range(len(fps)))
    for a, b in sorted(want):
        ra, rb = root[a], root[b]
        if ra != rb:
            root = [min(ra, rb) if r == max(ra, rb) else r for r in root]
    assert [got[int(v)] for v in fps.view(np.int64)] == root


def test_components_chain_star_and_hot_vertex(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200), (7, 3)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(60))
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mix_hard_rows(spark, hard, empty):
    sized = hard.select("doc_id", "source", mixing.word_count(hard.text).alias("size"), hard.lang.alias("target"))
    got = mixing.mix(sized, bucket_rows=2).collect()
    assert len(got) == len(HARD)
    total, taken = sum(r.size for r in got), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    for target, took, size in taken.values():
        assert took == math.floor(target) and target <= 3 * size + 1e-6
    assert abs(sum(t[0] for t in taken.values()) - total) < 1e-6
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(sized, bucket_rows=2).collect()), key=repr)
    assert mixing.mix(sized.limit(0)).count() == 0


def water_fill(sizes, weights, most):
    capped = set()
    while True:
        rest = sum(sizes) - sum(most * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        goal = [most * s if i in capped else rest * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and goal[i] > most * sizes[i] + 1e-9}
        if not over:
            return goal
        capped |= over


def test_targets_by_resharing(spark):
    rng = random.Random(2)
    for n in (1, 2, 5, 13):
        sizes = [rng.choice([0, 1, 10, 1000, 10**6]) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, source_size long")
        got = [r.target for r in mixing.targets(df).orderBy("source").collect()]
        assert got == pytest.approx(water_fill(sizes, [(1, 2, 3)[i % 3] for i in range(n)], 3))


def test_contamination_hard_rows(spark, hard, empty):
    item = " ".join(f"w{i}" for i in range(30))
    changed = item.replace("w0 ", "other ")  # one shingle of 26 differs
    far = item.replace("w15", "other")
    docs = spark.createDataFrame([(1, f"a b {item} c", 1), (2, f"A {changed.upper()}!", 1), (3, far, 1), (4, None, 1), (5, "w1 w2", 1), (None, item, 1), (6, f"{item} {item}", 1), (6, f"{item} {item}", 1), (7, "tiny thing", 1)], "doc_id long, text string, item int")
    items = spark.createDataFrame([(10, item), (10, item), (11, None), (12, ""), (13, "Tiny, thing")], "item_id long, text string")
    got = sorted(((r.doc_id or -1, r.item_id, r.start_word, round(r.similarity, 3)) for r in decontaminate.contamination(docs, items).collect()))
    assert got == [(-1, 10, 0, 1.0), (1, 10, 2, 1.0), (2, 10, 1, 0.926), (6, 10, 0, 1.0), (7, 13, 0, 1.0)]
    assert decontaminate.contamination(hard.limit(0), items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0


def brute_lines(rows, m, long=lines.MIN_CHARS):
    cut = [[(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    first, out = set(), {}
    for i in order:
        gone = set()
        for n in {1, m}:
            for k in range(len(cut[i]) - n + 1):
                win = tuple(x for _, x in cut[i][k : k + n])
                if win in first and (n == m or len(win[0]) >= long):
                    gone |= {at for at, _ in cut[i][k : k + n]}
                first.add(win)
        out[rows[i][0]] = "\n".join(x for at, x in enumerate((rows[i][1] or "").split("\n")) if at not in gone)
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_lines_by_brute_force(spark, m):
    rng = random.Random(m)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "d d", f"u{i}", "a line of some length"]) for _ in range(rng.randrange(14)))) for i in range(60)]
    rows += [(60, rows[5][1]), (61, "\n".join("ab"[k % 2] for k in range(40))), (62, ""), (63, "x\r\ny")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, line string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df, min_lines=m, min_chars=20).collect()}
    assert got == brute_lines(rows, m, 20)


def runs_of(df, m):
    later = lines.later_suffixes(lines.repeated_suffixes(lines.line_table(df), m))
    return lines.later_runs(later, df)


def test_lines_hard_rows(spark, hard, empty):
    out = lines.dedup_lines(hard, min_lines=1)
    assert out.columns == [*hard.columns, "n_lines", "n_removed"] and out.count() == len(HARD)
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text is None and by[7].text == HARD[8][1] and by[8].text == ""
    assert lines.dedup_lines(empty).count() == 0
    runs = runs_of(spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd"), (2, "x\na\nb\nc\nd")], "doc_id long, text string"), 2)
    assert [(r.d, r.line, r.n_lines, r.first_d, r.first_line) for r in runs.collect()] == [(2, 1, 4, 1, 0)]


def test_lines_maximal_runs_of_2_to_100_lines(spark):
    rng = random.Random(4)
    sources = [[f"s{i}.{k}" for k in range(120)] for i in range(6)]
    texts, want = list(sources), []
    for n in [2, 3, 4, 7, 8, 31, 32, 33, 64, 65, 99, 100]:
        i, at, lead = rng.randrange(6), rng.randrange(20), rng.randrange(4)
        texts.append([f"u{n}.{k}" for k in range(lead)] + sources[i][at : at + n] + [f"v{n}"])
        want.append((len(texts) - 1, lead, n, i, at))
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [depth for depth, _ in lines.repeated_suffixes(lines.line_table(df), 2)] == [1, 2, 4, 8, 16, 32, 64]
    assert sorted((r.d, r.line, r.n_lines, r.first_d, r.first_line) for r in runs_of(df, 2).collect()) == want
    # Random lines: every run is a copy of an earlier place, ends where the texts differ, and together they cover what brute force removes.
    texts = [[rng.choice("abcd") for _ in range(rng.randrange(60))] for _ in range(40)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for m in (2, 3):
        covered = set()
        for r in runs_of(df, m).collect():
            a, b = texts[r.d][r.line :], texts[r.first_d][r.first_line :]
            assert (r.first_d, r.first_line) < (r.d, r.line) and a[: r.n_lines] == b[: r.n_lines]
            assert a[r.n_lines : r.n_lines + 1] != b[r.n_lines : r.n_lines + 1] or not b[r.n_lines :] or not a[r.n_lines :]
            covered |= {(r.d, k) for k in range(r.line, r.line + r.n_lines)} if r.n_lines >= m else set()
        kept = brute_lines([(i, "\n".join(t)) for i, t in enumerate(texts)], m)
        assert all("\n".join(x for k, x in enumerate(t) if (i, k) not in covered) == kept[i] for i, t in enumerate(texts))


def test_digest_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in passages.op4_substring_dedup(spark, SF).collect()}
    want = brute_passages([d.text for d in docs], 35)
    for d, (n, gone, kept) in zip(docs, want):
        assert (got[d.doc_id].n_words, got[d.doc_id].n_removed, got[d.doc_id].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_contamination_of_texts_shorter_than_the_item(spark):
    ws = [f"w{i}" for i in range(50)]
    items = spark.createDataFrame([(1, " ".join(ws))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(ws[2:])), (2, " ".join(ws[:45])), (3, " ".join(ws[:38])), (4, " ".join(ws))], "doc_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.n_words, round(r.similarity, 4)) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(1, 0, 48, round(44 / 46, 4)), (2, 0, 45, round(41 / 46, 4)), (4, 0, 50, 1.0)]


def test_contamination_of_many_repeats_and_of_very_long_items(spark):
    item = " ".join(f"w{i}" for i in range(50))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.range(1600).selectExpr("cast(null as long) as doc_id", f"'{item}' as text")
    assert [(r.item_id, r.start_word, r.similarity) for r in decontaminate.contamination(docs, items).collect()] == [(1, 0, 1.0)]
    long = " ".join(f"w{i}" for i in range(66_000))
    items = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    docs = spark.createDataFrame([(7, long + " end"), (8, item)], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start_word, r.similarity) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(7, 1, 0, 1.0), (7, 2, 0, 1.0), (8, 1, 0, 1.0)]


def test_secrets_in_very_long_candidates(spark):
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    image = "".join(rng.choice(letters) for _ in range(1_000_000))
    many = " ".join("%016x" % (i * 7919 + (1 << 60)) for i in range(1_000_000))
    rows = [(1, image), (2, "a/" * 50_000 + "b1"), (3, "a/" * 50_000 + "B1"), (4, many)]
    got = {r.doc_id: r.secret_spans for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hot = [s for s in got[1] if s.kind == 4]
    filler = [i for m in re.finditer(secrets.FILLER, image) for i in range(m.start() - 19, m.end())]
    assert len(filler) >= 2 * 23  # chance puts some there
    bits = lambda w: -sum(w.count(x) / 20 * math.log2(w.count(x) / 20) for x in set(w))
    warm = lambda i: 0 <= i <= 999_980 and i not in touched and bits(image[i : i + 20]) >= 3.77
    touched = set(filler)
    for i in [*range(0, 999_980, 991), *filler]:
        assert any(s.start <= i < s.end for s in hot) == any(warm(j) for j in range(i - 19, i + 1))
    assert got[2] == [] and got[3] == [] and len(got[4]) == 1_000_000
    assert [(s.start, s.end) for s in got[4][-2:]] == [(16_999_966, 16_999_982), (16_999_983, 16_999_999)]


def test_filler_hides_no_key(spark):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.sample(letters, n))
    rows = [(1, key(40) + "xxxx" + key(40)), (2, key(25) + "Sample" + key(10)), (3, "example" + key(10) + "dummy"), (4, "say " + key(30) + "XXXX" + key(5) + "0123456789" + key(22) + " end"), (5, "xxxx" * 30 + "1")]
    got = {r.doc_id: [(s.start, s.end) for s in r.secret_spans] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(0, 40), (44, 84)], 2: [(0, 25)], 3: [], 4: [(4, 34), (53, 75)], 5: []}


@pytest.mark.parametrize("path, plain", [("a/b/c/word-with-1", True), ("/ab/cd/1", True), ("aaaaaaaaaaaaaaaaa//b1", False), ("//aaaaaaaaaaaaaaaab/1", False), ("a/b/C/1", False), ("/1", False), ("aaaa1/b", False)])
def test_paths_of_plain_words(path, plain):
    rule, unless = secrets.ALLOW[3]
    assert bool(re.search(rule, path) and not re.search(unless, path)) == plain == bool(re.search(r"^/?([a-z]+/)+[a-z0-9_-]*$", path))


def test_licenses_in_very_long_texts(spark):
    rows = [(1, "word zip " * 500_000 + "Licensed under the MIT License."), (2, "cc by x " * 500_000)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].labels, got[1].score, got[1].n_base) == (1_000_005, "mit", 1.0, 0)
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].last_word) == (1_500_000, 500_000, 0, 1_499_997)


def test_licenses_with_a_clashing_extra_column(spark, hard):
    assert licenses.scan_licenses(hard.withColumnRenamed("source", "labels").withColumnRenamed("lang", "h")).count() == len(HARD)


def test_running_sums(spark):
    from pyspark.sql import functions as F

    from marlstone.llm.common import running_sums

    for n in (0, 1, 31, 32, 33, 1024, 1025, 40_000):
        got = spark.range(1).select(running_sums(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: i.cast("long"))).alias("x")).first().x
        assert got == np.cumsum(np.arange(n + 1)).tolist()


def test_contamination_meets_few_of_many_items(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("bcdfgh") + str(rng.randrange(900)) for _ in range(30)) for _ in range(10_000)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) + " " + texts[i * 7] + " tail") for i in range(300)], "doc_id long, text string")
    from pyspark.sql import functions as F

    from marlstone.llm.common import plain_words

    entries = items.select("item_id", plain_words(F.col("text")).alias("_ws"), F.lit(30).alias("l"), F.lit(5).alias("k"), F.col("item_id").alias("item"))
    own = docs.select("doc_id", "text", *decontaminate.row_keys("doc_id", "text"))
    _, windows, pairs = decontaminate.candidates(own, ["_key", "_key2"], entries, 5, 0.8, decontaminate.RADIUS, False)
    assert 300 <= pairs.count() <= windows.count() < 300 * 60  # all pairs would be 10,000 a window
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contamination(docs, items).collect()) == [(i, i * 7) for i in range(300)]


def near_items(rng, sizes):
    """Items, and a document for each with a window of it whose words were changed at the edges and inside, repeated shingles among them."""
    items, docs = [], []
    for i in range(1000):
        n = rng.choice(sizes)
        pool = [f"{rng.choice('abcdefgh')}{rng.randrange(40 if rng.random() < 0.7 else 2)}" for _ in range(n)]
        ws = (pool[: max(5, n // 3)] * 3)[:n] if rng.random() < 0.2 else pool
        near, n = list(ws), len(ws)
        for _ in range(rng.randrange(1, max(2, n // 12) + 1)):
            at = rng.choice([0, n - 1, rng.randrange(n)])
            near[at] = f"new{rng.randrange(10**6)}"
        cut = rng.randrange(2) if n > 8 else 0
        items.append((i, " ".join(ws)))
        docs.append((i, " ".join([f"p{rng.randrange(10**6)}" for _ in range(rng.randrange(9))] + near[cut:] + [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(9))])))
    return items, docs


@pytest.mark.parametrize("sizes", [range(5, 16), range(16, 101)])
def test_contamination_recall_near_the_threshold(spark, sizes):
    """Against every item-sized window compared outright: similarities from 0.8 on, most below 0.9."""
    import duckdb
    import pandas as pd

    items, docs = near_items(random.Random(len(sizes)), sizes)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = {(d, i): (s, round(j, 6)) for d, i, s, _, j in con.execute(decontaminate.sql()).fetchall()}
    got = {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 6)) for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    close = [k for k, (_, j) in want.items() if j < 0.85]
    print("pairs", len(want), "of 0.80 to 0.85", len(close), "found", len(want.keys() & got.keys()), "short", len(sizes))
    assert len(want) > 60 and len(close) > 8 and want == {k: v for k, v in got.items() if k in want}


def test_vectors_that_share_an_id(spark):
    rows = [(2, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.001], 1), (4, [0.0, 1.0], 1), (5, [-0.0, 1.0], 1), (6, [0.0, 0.0], 1), (None, None, None)]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(-1, 0, -1, False), (2, 1, 2, True), (2, 2, 2, True), (3, 1, 2, False), (4, 2, 2, False), (5, 2, 2, False), (6, 0, 6, True)]


def test_archive_paths():
    assert warc.uri("file:/a/b") == "file:///a/b" == warc.uri("file:///a/b") and warc.uri("/a/b") == "/a/b"
    assert warc.uri("s3a://bucket/a") == "s3://bucket/a" and warc.uri("hdfs://n:8020/a") == "hdfs://n:8020/a"


def plain_noisy_or(weights, bias, text):
    """Score and the worst sentence's place, said outright: a sentence's logit sums the weights of its distinct words and their beginnings."""
    safe, worst, at = 1.0, None, 0
    pieces = re.split(r"([.!?\n]+)", (text or "").lower())
    for k, piece in enumerate(pieces):
        if k % 2 == 0 and piece.strip():
            z = bias
            for w in set(re.findall(r"[^\W_]+", piece)):
                z += sum(weights.get(f, 0.0) for f in [w, *[w[:n] + "*" for n in (4, 5, 6, 7) if len(w) > n]])
            safe *= 1 - 1 / (1 + math.exp(-z))
            if worst is None or z > worst[0]:
                worst = (z, at, at + len(piece))
        at += len(piece)
    return 1 - safe, worst and worst[1:]


def test_toxicity_by_a_plain_scorer(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        s, where = plain_noisy_or(model.weights, model.bias, r.text)
        g = got[r.doc_id]
        assert abs(g.score - s) < 1e-9 and ((g.worst_start, g.worst_end) == where if where else g.worst_start is None)


def test_toxicity_training_is_bounded(spark):
    assert toxicity.fitting([(1, 0, 5), (2, 0, 9), (3, 0, 4)], 10) == [(1, 0), (3, 0)]
    docs = spark.createDataFrame([(i, ("you idiot. " if i % 2 else "a fine day. ") * (2 if i < 100 else 200_000)) for i in range(104)] + [(1, "other text")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(104)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, most_bytes=20_000)
    assert model.score("you idiot")[0] > 0.5 > model.score("a fine day")[0]


def test_scores_and_groups_with_clashing_extra_columns(spark, hard):
    renamed = hard.withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id")
    assert simhash.simhash_groups(renamed).count() == len(HARD)
    model = toxicity.Model({"idiot": 9.0}, -4.0)
    assert toxicity.score(hard.withColumnRenamed("lang", "score").withColumnRenamed("source", "_text2"), model, keep=["doc_id", "score"]).count() == len(HARD)


def test_targets_of_many_sources(spark):
    sizes = [(i * 7919) % 100_003 for i in range(20_000)]
    df = spark.createDataFrame([(f"host{i:05d}", s) for i, s in enumerate(sizes)] + [(None, 5)], "source string, source_size long")
    from pyspark.sql import functions as F

    got = [r.target for r in mixing.targets(df).orderBy(F.col("source").asc_nulls_last()).collect()]
    want = water_fill([*sizes, 5], [(1, 2, 3)[i % 3] for i in range(len(sizes) + 1)], 3)
    assert got == pytest.approx(want)


def test_licenses_of_rows_that_share_or_lack_an_id(spark):
    mit = max((t for label, t in licenses.TEMPLATES if label == "mit"), key=len)
    words = mit.split()
    for ids in ([None] * 3, [7] * 3, [1, 2, 3]):
        rows = [(i, t) for i, t in zip(ids, (" ".join(words[:26]), " ".join(words[26:]), "nothing here at all"))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        alone = [licenses.scan_licenses(df.where(F.col("text") == t)).first() for _, t in rows]
        together = {r.n_words: r for r in licenses.scan_licenses(df).collect()}
        assert [together[r.n_words] for r in alone] == alone
        assert together[4].labels == "" and together[4].score == 0.0
    twice = spark.createDataFrame([(None, mit)] * 2 + [(None, "x")], "doc_id long, text string")
    assert sorted((r.labels, r.score) for r in licenses.scan_licenses(twice).collect()) == [("", 0.0), ("mit", 1.0), ("mit", 1.0)]


@pytest.mark.parametrize("period", [["x"], ["x", "y", "x", "z"]])
def test_lines_of_one_repeated_block(spark, period):
    """A document of one block over and over: its first copy stays, one run holds the rest, and nothing grows with the square of its lines."""
    n = 2_000
    text = "\n".join((period * n)[:n])
    df = spark.createDataFrame([(1, text), (2, "u\nx\nv")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(df).collect()}
    p = len(period)
    whole = brute_lines([(1, "\n".join((period * 99)[: 8 * p])), (2, "u\nx\nv")], 2)  # any length keeps the same lines
    assert got == {1: (whole[1], n - len(whole[1].split("\n"))), 2: ("u\nx\nv", 0)}
    long = max(runs_of(df, 2).collect(), key=lambda r: r.n_lines)
    assert (long.d, long.line, long.n_lines, long.first_line) == (1, p, n - p, 0)
    assert runs_of(df, 2).count() <= 3 * p
    assert time.time() - began < 300


def test_contamination_of_long_items_in_longer_texts(spark):
    """Items of 200 to 20,000 words, each with a word in a hundred changed, inside a longer text: found where they lie, in time that grows with their words."""
    rng = random.Random(8)
    items, docs, want = [], [], {}
    for i, n in enumerate((200, 2_000, 20_000)):
        ws = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
        near = [f"new{k}" if k % 100 == 50 else w for k, w in enumerate(ws)]
        lead = rng.randrange(5, 40)
        items.append((i, " ".join(ws)))
        docs.append((i, " ".join([*(f"p{k}" for k in range(lead)), *near, *(f"q{k}" for k in range(300))])))
        lost = 5 * (n // 100)  # shingles that hold a changed word
        want[i] = (i, lead, (n - 4 - lost) / (n - 4 + lost))
    began = time.time()
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.item_id, r.start_word, pytest.approx(r.similarity)) for r in got} == want
    assert time.time() - began < 150
