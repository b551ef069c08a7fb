"""Messages and the command line."""

import datetime as dt
import json

import pytest

from marlstone.__main__ import main
from marlstone.apps import messages as M
from marlstone.apps.workers import WorkerResult
from marlstone.plans.spec import RequestError


def test_messages(tmp_path, capsys):
    m = M.Message("t", [{"type": "text", "text": "hello"}, {"type": "image", "source": "a.png"}, {"type": "special", "channel": "console", "format": "x", "payload": {"k": 1}}])
    M.write_message(str(tmp_path / "d" / "m.json"), m)
    assert M.read_message(str(tmp_path / "d" / "m.json")) == m
    assert main(["message", str(tmp_path / "d" / "m.json")]) == 0
    assert "hello" in capsys.readouterr().out
    M.channel("broken")(lambda m: 1 / 0)
    assert M.send_message(m, "broken")["status"] == "FAILURE"
    with pytest.raises(RequestError):
        M.send_message(m, "nowhere")
    for bad in ([], [{"type": "text"}], [{"type": "text", "text": ""}], [{"type": "video"}], [{"type": "text", "text": "a", "more": 1}], [{"type": "special", "channel": "Bad Name", "format": "x", "payload": {}}]):
        with pytest.raises(RequestError):
            M.Message("t", bad)
    with pytest.raises(RequestError):
        M.Message.from_json("{}")


def test_run_message():
    rs = [WorkerResult("daily", "j", status="success", metrics={"rows_written": 12}), WorkerResult("limit", "j", status="failure", error={"type": "E", "message": "boom"}), WorkerResult("st", "other", status="success")]
    m = M.run_message(rs, ["stock-daily", "limit", "st"], "j").metadata
    assert m["status"] == "PARTIAL" and m["selected_workers"] == ["daily", "limit", "st"] and m["succeeded_workers"] == ["daily"] and m["missing_workers"] == ["st"] and m["rows_written"] == 12
    assert M.run_message(rs, ["daily"], "j").metadata["status"] == "SUCCESS" and M.run_message([], ["daily"], "j").metadata["status"] == "FAILURE"


def test_query_command(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d), "A.SZ", "close", float(d)) for d in (1, 2, 3)]
    spark.createDataFrame(rows, "time timestamp_ntz, code string, factor string, value double").write.parquet(str(tmp_path / "long"))
    node = {"type": "TS", "op": "unary.diff", "fields": {"col": "close"}, "params": {}}
    request = {"dataset_query": {"start_date": "2024-01-01", "end_date": "2024-01-03", "codes": [], "derivatives": {"d": node}}}
    (tmp_path / "r.json").write_text(json.dumps(request))
    assert main(["query", str(tmp_path / "r.json"), "--long", str(tmp_path / "long"), "--out", str(tmp_path / "out")]) == 0
    assert sorted((r.time.day, r.d) for r in spark.read.parquet(str(tmp_path / "out/data")).collect()) == [(1, None), (2, 1.0), (3, 1.0)]
    (tmp_path / "bad.json").write_text("{}")
    assert main(["query", str(tmp_path / "bad.json"), "--long", str(tmp_path / "long"), "--out", str(tmp_path / "o2")]) == 2
    assert main(["workers"]) == 0
