"""Runs of jobs: the first of a job does the work, later ones get its result, until the job's time to live is over.

runs(doc_id, run_id, created_at, result) → doc_id, run_id, created_at, first_run, first_at, result and replayed. A job
begins with a run and holds every later run of its doc_id that is created at most the time to live after it; the next
one begins a new job. Each run is given the run that began its job, with that run's result.

On a stream the job is state of its doc_id with a timer that ends it when the watermark is past its time; whether a run
belongs to it is decided by the run's own time, so results don't depend on when the timer fires. Runs of a micro-batch
are taken in order of time; one that comes later than runs created after it joins the job that stands. A table goes
through in one sorted pass that carries a job from batch to batch: of a doc_id in very many rows no more is held than one.

A null doc_id is a job of its own, as any other; a run without a time is left out, as a watermark would; repeated runs
are runs of their own; ties of time are in the order of run_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cloakwork.config import DEFAULT, EngineConfig

_OWN = ("doc_id", "run_id", "created_at", "result")
_JOB = "first_run long, first_at timestamp, result string"


def _schema(runs: DataFrame) -> str:
    return f"doc_id {runs.schema['doc_id'].dataType.simpleString()}, run_id long, created_at timestamp, first_run long, first_at timestamp, result string, replayed boolean"


def _ordered(runs: DataFrame) -> DataFrame:
    return runs.select("doc_id", F.col("run_id").cast("long").alias("run_id"), F.col("created_at").cast("timestamp").alias("created_at"), F.col("result").cast("string").alias("result"))


def job_starts(times: np.ndarray, ttl: int, open_until: int | None) -> np.ndarray:
    """For each of ascending times, where its job begins among them; -1: in the job that is open until open_until."""
    out = np.full(len(times), -1, np.int64)
    at = 0 if open_until is None else int(np.searchsorted(times, open_until, "right"))
    while at < len(times):
        end = int(np.searchsorted(times, times[at] + ttl, "right"))
        out[at:end] = at
        at = end
    return out


class JobState(StatefulProcessor):
    """The open job of a doc_id: first_run, first_at and result, and a timer at its end."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _JOB)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.job.get() if self.job.exists() else None
        now = before = tuple(held) if held else None
        for pdf in rows:
            pdf = pdf.sort_values(["created_at", "run_id"], kind="stable", ignore_index=True)
            times = pdf["created_at"].astype("datetime64[us]").astype("int64").to_numpy()
            begins = job_starts(times, self.ttl_ms * 1000, None if now is None else int(pd.Timestamp(now[1]).value) // 1000 + self.ttl_ms * 1000)
            first = pdf.iloc[np.maximum(begins, 0)].reset_index(drop=True)
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "run_id": pdf["run_id"], "created_at": pdf["created_at"], "first_run": first["run_id"], "first_at": first["created_at"], "result": first["result"], "replayed": begins != np.arange(len(pdf))})
            if (old := begins < 0).any():
                out.loc[old, "first_run"], out.loc[old, "result"] = now[0], now[2]
                out.loc[old, "first_at"] = pd.Timestamp(now[1])
            if len(begins) and begins[-1] >= 0:
                last = pdf.iloc[begins[-1]]
                now = (int(last["run_id"]), last["created_at"].to_pydatetime(), last["result"])
            yield out
        if now != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.job.update(now)
            self.handle.registerTimer(int(pd.Timestamp(now[1]).timestamp() * 1000) + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_runs(runs: DataFrame, config: EngineConfig = DEFAULT, late_seconds: int = 60) -> DataFrame:
    """A stream of runs → the same stream with each run's job. Needs the RocksDB state store, which has timers."""
    timed = _ordered(runs).where("created_at IS NOT NULL").withWatermark("created_at", f"{late_seconds} seconds")
    return timed.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=JobState(config.ttl_seconds), outputStructType=_schema(runs), outputMode="Append", timeMode="EventTime"
    )


def runs_of_table(runs: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The same for a table: partitioned by doc_id, sorted by time, one pass."""
    ttl = config.ttl_seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job: tuple | None = None  # doc_id, first_run, first_at in microseconds, result
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, run_id, result = (batch.column(c) for c in ("doc_id", "run_id", "result"))
            times = batch.column("created_at").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy()
            codes = doc.dictionary_encode().indices.fill_null(-1).to_numpy()
            groups = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            begins = np.empty(len(times), np.int64)
            for a, b in zip(groups.tolist(), [*groups[1:].tolist(), len(times)]):
                same = job is not None and a == 0 and doc[0].as_py() == job[0]
                part = job_starts(times[a:b], ttl, job[2] + ttl if same else None)
                begins[a:b] = np.where(part < 0, -1, part + a)
            first = pa.array(begins, mask=begins < 0)
            held = job or (None, None, None, None)
            picked = lambda column, old: pc.if_else(pc.is_null(first), pa.scalar(old, column.type), column.take(first))  # noqa: B023, E731
            first_at = picked(pa.array(times), held[2])
            columns = [doc, run_id, batch.column("created_at"), picked(run_id, held[1]), first_at.cast(pa.timestamp("us", "UTC")), picked(result, held[3]), pa.array(begins != np.arange(len(times)))]
            k = int(begins[-1])
            job = (doc[-1].as_py(), *((run_id[k].as_py(), int(times[k]), result[k].as_py()) if k >= 0 else held[1:]))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "run_id", "created_at", "first_run", "first_at", "result", "replayed"])

    sorted_runs = _ordered(runs).where("created_at IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id", "created_at", "run_id")
    return sorted_runs.mapInArrow(run, _schema(runs))
