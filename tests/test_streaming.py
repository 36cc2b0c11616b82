import json
import os

from folioscope.streaming import journal as J

EVENTS = "document string, event_id string, target string, before string, after string, kind string, batch string, created_at string"


def event(n, target, before, after, kind="edit", batch=None, doc="d"):
    return {"document": doc, "event_id": f"e{n:03d}", "target": target, "before": before, "after": after, "kind": kind, "batch": batch, "created_at": f"2024-01-01T00:{n:02d}:00"}


LOG = [
    event(1, "a", None, "1"), event(2, "b", None, "2", batch="x"), event(3, "c", None, "3", batch="x"), event(3, "c", None, "3", batch="x"),
    event(4, "a", "9", "no"), event(5, "", None, None, kind="undo"), event(6, "", None, None, kind="undo"), event(7, "", None, None, kind="undo"), event(8, "a", None, "5"),
]


def test_projection_rules():
    values, results = {}, []
    results = J.project(values, [], set(), LOG)
    assert [r["result"] for r in results] == ["applied"] * 3 + ["replayed", "conflict", "undone 2", "undone 1", "nothing to undo", "applied"]
    assert values == {"a": "5", "b": None, "c": None}


def run(query):
    query.awaitTermination(120)
    assert not query.isActive


def test_streaming_projection_equals_batch_and_survives_restart(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    for i in range(0, 6, 3):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, LOG[i : i + 3])))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files come in order of their times

    def start():
        events = J.stream(spark, str(source), EVENTS)
        return J.projection(events).writeStream.format("json").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()

    run(start())
    (source / "9.json").write_text("\n".join(map(json.dumps, LOG[6:])))
    run(start())  # the state comes back from the checkpoint
    streamed = sorted((r.event_id, r.result) for r in spark.read.json(out).collect())
    batch = J.projected(spark.createDataFrame(LOG, EVENTS))
    assert streamed == sorted((r.event_id, r.result) for r in batch.collect())


def test_once_and_sessions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"event_id": f"e{i % 4}", "user": "u", "ts": f"2024-01-01 00:0{i % 4}:00"} for i in range(8)] + [{"event_id": "z", "user": "u", "ts": "2024-01-02 00:00:00"}, {"event_id": "zz", "user": "u", "ts": "2024-01-03 00:00:00"}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    read = lambda: J.stream(spark, str(tmp_path / "in"), "event_id string, user string, ts timestamp")
    q = J.once(read(), "ts", "1 hour").writeStream.format("memory").queryName("once_q").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run(q)
    assert spark.table("once_q").count() == 6
    q = J.sessions(read(), "ts", "30 minutes", "1 hour", "user").writeStream.format("memory").queryName("sess_q").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run(q)
    assert {r.n for r in spark.table("sess_q").collect()} >= {8}


def test_append_sink_writes_a_batch_once(spark, tmp_path):
    write = J.append_to(str(tmp_path / "sink"))
    df = spark.createDataFrame([("a",)], "x string")
    write(df, 0)
    write(df, 0)
    write(df, 1)
    assert spark.read.json(str(tmp_path / "sink")).count() == 2


def test_breaker_and_workers(spark):
    rows = [("e", i, ok) for i, ok in enumerate([True, False, True, False, False, True, False])] + [("f", 1, False), ("f", 2, True), ("f", 3, False)]
    out = {(r.engine, r.o): r.skipped for r in J.breaker(spark.createDataFrame(rows, "engine string, o int, ok boolean"), "engine", "o").collect()}
    assert out == {**{("e", i): i > 4 for i in range(7)}, **{("f", i): False for i in (1, 2, 3)}}
    assert [J.workers(8, 4, 1000, 900, 300), J.workers(8, 9, 100, 900, 300), J.workers(2, 9, 9000, 9000, 300)] == [3, 1, 2]
