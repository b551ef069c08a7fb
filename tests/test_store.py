"""The long table with snapshots: merges, versions, compaction, conflicts and an ingest that stops."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.sources import panel as P
from marlstone.sources.store import Conflict, SnapshotTable

DAY = dt.datetime(2024, 1, 30)


def long(spark, rows):
    return spark.createDataFrame([(DAY + dt.timedelta(d), c, f, v) for d, c, f, v in rows], P.LONG)


def rows(df):
    return sorted((r.time.day, r.time.month, r.code, r.factor, r.value) for r in df.collect())


def test_later_sequences_win_and_versions_stay(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), {"close", "a/b=c"})
    assert t.read().count() == 0 and t.manifest().version == 0
    t.append(long(spark, [(0, "A", "close", 1.0), (0, "A", "close", 1.0), (3, "A", "close", 2.0), (0, "B", "a/b=c", 5.0), (0, None, "close", 1.0), (1, "A", "close", float("nan"))]), 5)
    t.append(long(spark, [(0, "A", "close", 9.0), (1, "A", "close", 4.0)]), 7)
    t.append(long(spark, [(0, "A", "close", 8.0), (3, "A", "close", 8.5)]), 6)  # late, so it loses to 7 and wins over 5
    want = [(2, 2, "A", "close", 8.5), (30, 1, "A", "close", 9.0), (30, 1, "B", "a/b=c", 5.0), (31, 1, "A", "close", 4.0)]
    assert rows(t.read()) == want
    assert rows(t.read(version=1)) == [(2, 2, "A", "close", 2.0), (30, 1, "A", "close", 1.0), (30, 1, "B", "a/b=c", 5.0)]
    t.append(long(spark, [(3, "A", "close", 3.5)]), 6)  # a sequence is replaced as a whole
    assert rows(t.read(["close"], dt.date(2024, 2, 1))) == [(2, 2, "A", "close", 3.5)]
    assert rows(t.read(end=dt.date(2024, 1, 30))) == [(30, 1, "A", "close", 9.0), (30, 1, "B", "a/b=c", 5.0)]
    with pytest.raises(ValueError):
        t.append(long(spark, [(0, "A", "new", 1.0)]), 9)
    assert t.manifest().version == 4


def test_compacted_months_are_read_without_a_shuffle(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    for s in range(4):
        t.append(long(spark, [(d, c, "close", float(100 * s + d)) for d in range(s, 6) for c in "AB"]), s)
    before = t.read()
    want = rows(before)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan(before)
    made = t.compact()
    assert made.version == 5 and all(len(p) == 1 for p in made.months().values())
    after = t.read()
    assert rows(after) == want == rows(before)  # the reader of version 4 still has its files
    assert "Window" not in plan(after) and "Exchange" not in plan(after)
    t.append(long(spark, [(5, "A", "close", -1.0)]), 2)  # older than what the month was compacted from
    assert rows(t.read()) == want
    t.append(long(spark, [(4, "A", "close", -3.0)]), 3)  # the sequence that the compacted months carry, once more
    assert rows(t.read()) == sorted([r for r in want if r[:3] != (3, 2, "A")] + [(3, 2, "A", "close", -3.0)])
    t.append(long(spark, [(5, "A", "close", -1.0)]), 9)
    assert (4, 2, "A", "close", -1.0) in rows(t.read()) and len(rows(t.read())) == len(want) and t.compact().version == 9
    assert t.compact().version == 9  # nothing left to do
    kept = rows(t.read())
    assert len(t.vacuum(keep=1)) >= 4 and rows(t.read()) == kept and t.versions() == [9]


def test_of_two_writers_on_one_version_one_is_refused(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.append(long(spark, [(0, "A", "close", 1.0)]), 1)
    base = t.manifest()
    t.append(long(spark, [(1, "A", "close", 2.0)]), 2)
    with pytest.raises(Conflict):
        t.commit(base, [], [])
    assert len(rows(t.read())) == 2 and not [n for n in (tmp_path / "t" / "manifests").iterdir() if n.suffix == ".draft"]


def test_a_stopped_ingest_goes_on_at_its_first_gap(spark, tmp_path):
    start, end = dt.date(2024, 1, 1), dt.date(2024, 3, 10)

    def fetch(a, b):
        asked.append((a, b))
        if len(asked) == stop:
            raise ConnectionError("away")
        days = [(dt.datetime(2024, 1, 1) + dt.timedelta((a - start).days + i), "A", "close", float((a - start).days + i)) for i in range((b - a).days + 1)]
        return spark.createDataFrame(days, P.LONG)

    asked, stop = [], None
    whole = SnapshotTable(spark, str(tmp_path / "whole"))
    assert whole.ingest("daily", fetch, start, end, days=20) == 4 and whole.gaps("daily", start, end) == []
    asked, stop = [], 3
    broken = SnapshotTable(spark, str(tmp_path / "broken"))
    with pytest.raises(ConnectionError):
        broken.ingest("daily", fetch, start, end, days=20)
    assert broken.gaps("daily", start, end) == [(dt.date(2024, 2, 10), end)] and broken.gaps("other", start, end) == [(start, end)]
    asked, stop = [], None
    assert broken.ingest("daily", fetch, start, end, days=20) == 2 and asked[0][0] == dt.date(2024, 2, 10)
    assert rows(broken.read()) == rows(whole.read()) and len(rows(whole.read())) == 70
    assert broken.ingest("daily", fetch, start, end) == 0
    assert broken.ingest("daily", fetch, dt.date(2023, 12, 30), dt.date(2024, 3, 12)) == 2 and asked[-2:] == [(dt.date(2023, 12, 30), dt.date(2023, 12, 31)), (dt.date(2024, 3, 11), dt.date(2024, 3, 12))]
    assert [c[3] for c in broken.manifest().chunks] == [20, 20, 20, 10, 2, 2]
