"""Wide sections give the rows of whole ones, with ties, gaps, conditions and one time that holds half of all rows."""

import datetime as dt

import numpy as np
import pytest
from test_engine import SPAN, cs, direct

from marlstone.plans import sections
from marlstone.plans.spec import RequestError, load
from marlstone.query import execute_query

PARAMS = {
    "unary.quantile": {"q": 0.3}, "unary.qcut": {"q": 4}, "unary.top_n": {"n": 5}, "unary.bottom_n": {"n": 3}, "unary.top_pct": {"pct": 0.3}, "unary.bottom_pct": {"pct": 0.2},
    "unary.winsorize": {"lower": 0.1, "upper": 0.9}, "unary.winsorize_mad": {"n": 1.0}, "unary.rank": {"ties_method": "average"}, "unary.rank_pct": {"ties_method": "dense", "ascending": False}, "grouped.rank_pct": {"ties_method": "max"},
}


def nodes():
    out = {}
    for name in sections.WIDE:
        fields = [f.name for f in load()[name].fields]
        out[name.replace(".", "_")] = cs(name, dict(zip(fields, ("x", "g" if "by" in fields else "y"))), **PARAMS.get(name, {}))
    for ties in ("min", "max", "first"):
        for up in (True, False):
            out[f"rank_{ties}_{up}"] = cs("unary.rank", "x", ties_method=ties, ascending=up)
    out["first_pct"] = cs("grouped.rank_pct", {"col": "x", "by": "g"}, ties_method="first")
    out["masked"] = cs("unary.rank_pct", "x", on=direct("unary.cast", "m", dtype="bool"))
    out["masked_sum"] = cs("unary.sum", "x", on=direct("unary.cast", "m", dtype="bool"))
    return out


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    rows = []
    for day, n in ((0, 400), (1, 30), (2, 1), (3, 2), (4, 60)):
        for i in range(n):
            x = None if rng.random() < 0.1 or day == 3 else float(rng.integers(0, 12)) if rng.random() < 0.7 else float(np.round(rng.normal(), 3))
            rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(day), f"k{i:03d}", x, None if rng.random() < 0.1 else float(np.round(rng.normal(), 3)), ["a", "b", None][rng.integers(0, 3)], bool(rng.random() < 0.6)))
    return spark.createDataFrame(rows, "time timestamp_ntz, code string, x double, y double, g string, m boolean").repartition(3).cache()


@pytest.mark.parametrize("half", [0, 1])
def test_wide_sections_give_the_rows_of_whole_ones(panel, half):
    some = dict(list(nodes().items())[half::2])
    one, two = (execute_query(SPAN | {"derivatives": some}, panel=panel, chunk_rows=n).data.orderBy("time", "code").collect() for n in (None, 50))
    assert len(one) == len(two) == 493
    for k in some:
        wrong = [(a.time, a.code, a[k], b[k]) for a, b in zip(one, two) if (a[k] is None) != (b[k] is None) or a[k] is not None and abs(float(a[k]) - float(b[k])) > 1e-8 * max(1, abs(float(a[k])))]
        assert not wrong, (k, wrong[:5])


def test_no_section_meets_in_one_task(panel):
    d = {"r": cs("unary.rank", "x"), "q": cs("unary.median", "x"), "f": cs("unary.top_n", "y", n=2)}
    df = execute_query(SPAN | {"derivatives": d}, panel=panel, chunk_rows=50).data
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "RepartitionByExpression" not in plan
    assert df.count() == 493


def test_dense_controls_are_refused_and_empty_is_empty(panel):
    with pytest.raises(RequestError):
        execute_query(SPAN | {"derivatives": {"d": cs("controls.neutralize_by", {"target": "x", "controls": ["y"]})}}, panel=panel, chunk_rows=50).data
    assert execute_query(SPAN | {"derivatives": {"d": cs("unary.rank", "x"), "e": cs("unary.median", "x"), "f": cs("unary.top_n", "x", n=2)}}, panel=panel.limit(0), chunk_rows=50).data.count() == 0
