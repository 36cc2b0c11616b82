"""Streams: review journals with undo and idempotent replay, sessions, pages, samples.

State is kept per document or key in Spark's state store, so a query restarts where its checkpoint left it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.sources.readers import EVENT


def stream(spark: SparkSession, path: str, schema: str = EVENT, files_per_trigger: int = 1) -> DataFrame:
    """Files of JSON lines as they come, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def once(events: DataFrame, time: str, delay: str, key: str = "event_id") -> DataFrame:
    """Each event once, however often it is replayed within the delay."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, time: str, gap: str, delay: str, *by: str) -> DataFrame:
    """Sessions of events no further apart than the gap: start, end and number of events."""
    at = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return at.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(*by, "w.start", "w.end", "n")


def project(values: dict[str, str | None], stack: list, seen: set[str], rows: list[dict]) -> list[dict]:
    """Applies events in order to the values of one document; returns what became of each.

    An event id seen before is skipped; an event whose ``before`` is not the current value is a conflict and changes
    nothing; ``undo`` takes back the step on top of the stack, where neighbouring events of one batch are one step.
    """
    out = []
    for e in rows:
        if e["event_id"] in seen:
            out.append({**e, "result": "replayed"})
            continue
        seen.add(e["event_id"])
        if e["kind"] == "undo":
            if not stack:
                out.append({**e, "result": "nothing to undo"})
                continue
            _, changes = stack.pop()
            for target, before in reversed(changes):
                values[target] = before
            out.append({**e, "result": f"undone {len(changes)}"})
            continue
        now = values.get(e["target"])
        if e["before"] is not None and e["before"] != now:
            out.append({**e, "result": "conflict"})
            continue
        values[e["target"]] = e["after"]
        if stack and e["batch"] and stack[-1][0] == e["batch"]:
            stack[-1][1].append((e["target"], now))
        else:
            stack.append((e["batch"], [(e["target"], now)]))
        out.append({**e, "result": "applied"})
    return out


COLUMNS = ["event_id", "target", "before", "after", "kind", "batch"]
_OUT = "document string, event_id string, target string, before string, after string, kind string, batch string, result string, state string"


def projection(events: DataFrame) -> DataFrame:
    """Streaming twin of ``project`` over (document, event_id, target, before, after, kind, batch, created_at).

    Within a micro-batch the events of a document are taken by (created_at, event_id).
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, stack, seen = json.loads(state.get[0]) if state.exists else ({}, [], [])
        seen = set(seen)
        rows = pd.concat(list(batches)).sort_values(["created_at", "event_id"])
        rows = rows[COLUMNS].astype(object).where(rows[COLUMNS].notna(), None)
        out = pd.DataFrame(project(values, stack, seen, rows.to_dict("records")), columns=[*COLUMNS, "result"])
        state.update((json.dumps([values, stack, sorted(seen)]),))
        out.insert(0, "document", key[0])
        out["state"] = json.dumps(values, sort_keys=True)
        yield out

    return events.groupBy("document").applyInPandasWithState(run, _OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def projected(events: DataFrame) -> DataFrame:
    """The batch form of ``projection``. The events of one document must fit one task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["created_at", "event_id"])[COLUMNS].astype(object)
        values: dict = {}
        out = pd.DataFrame(project(values, [], set(), rows.where(rows.notna(), None).to_dict("records")), columns=[*COLUMNS, "result"])
        out.insert(0, "document", key[0])
        out["state"] = json.dumps(values, sort_keys=True)
        return out

    return events.groupBy("document").applyInPandas(run, _OUT)


def append_to(path: str):
    """A foreachBatch sink that appends each micro-batch once: its folder is named by the batch and overwritten."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return write


#: So many failures in a row switch an engine off (fixed value).
FAILURES = 2


def breaker(calls: DataFrame, by: str, order: str, failures: int = FAILURES) -> DataFrame:
    """Adds ``skipped``: calls of an engine once ``failures`` calls in a row have failed; an answer starts the count again."""
    from pyspark.sql import Window

    whole = Window.partitionBy(by).orderBy(order)
    answered = calls.withColumn("__run", F.sum(F.col("ok").cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    row = Window.partitionBy(by, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = answered.withColumn("__off", F.sum((~F.col("ok")).cast("int")).over(row) >= failures)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("skipped", F.coalesce(F.max("__off").over(before), F.lit(False))).drop("__run", "__off")


def breaking(calls: DataFrame, by: str, order: str, failures: int = FAILURES) -> DataFrame:
    """Streaming twin of ``breaker`` over (by, order, ok): the state of an engine is its failures in a row and whether it is off."""
    kinds = dict(calls.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row, off = state.get if state.exists else (0, False)
        calls_ = pd.concat(list(batches)).sort_values(order)
        skipped = []
        for ok in calls_["ok"]:
            skipped.append(off)
            if not off:
                row = 0 if ok else row + 1
                off = row >= failures
        state.update((row, off))
        yield pd.DataFrame({by: calls_[by], order: calls_[order], "ok": calls_["ok"], "skipped": skipped})

    out = f"{by} {kinds[by]}, {order} {kinds[order]}, ok boolean, skipped boolean"
    return calls.select(by, order, "ok").groupBy(by).applyInPandasWithState(run, out, "row int, off boolean", "append", GroupStateTimeout.NoTimeout)


def allowed_workers(requested: Column, maximum: Column, limit_mb: Column, available_mb: Column, each_mb: Column) -> Column:
    """How many workers the memory allows, one at least."""
    return F.greatest(F.lit(1), F.least(requested, maximum, F.floor(F.least(limit_mb, available_mb) / each_mb))).cast("int")


def workers(requested: int, maximum: int, limit_mb: float, available_mb: float, each_mb: float) -> int:
    """How many workers the memory allows, one at least."""
    return max(1, min(requested, maximum, int(min(limit_mb, available_mb) // each_mb)))
