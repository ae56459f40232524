"""Job runs: an append-only audit. A run is one row when it starts and one when it ends; the last row counts."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from .. import schemas
from ..operators.ranking import first_per_group
from .store import TicketStore


class JobRun:
    def __init__(self, store: TicketStore, job_type: str):
        self.store, self.job_type = store, job_type
        self.id, self.started = uuid.uuid4().hex, datetime.now(timezone.utc)
        self.tickets_processed = 0

    def log(self, status: str, error: str | None = None) -> None:
        finished = None if status == "running" else datetime.now(timezone.utc)
        row = (self.id, self.job_type, status, self.tickets_processed, error, self.started, finished)
        self.store.append("job_runs", self.store.spark.createDataFrame([row], schemas.JOB_RUNS))


@contextmanager
def job_run(store: TicketStore, job_type: str):
    """Logs a run around a block; set ``tickets_processed`` on the run inside it."""
    run = JobRun(store, job_type)
    run.log("running")
    try:
        yield run
    except Exception as error:
        run.tickets_processed = 0
        run.log("failed", str(error))
        raise
    run.log("success")


def current_runs(log: DataFrame) -> DataFrame:
    """One row per run: its end if it has one."""
    return first_per_group(log, ["id"], [F.col("finished_at").desc_nulls_last()])


def latest_jobs(log: DataFrame) -> DataFrame:
    """The run of each type that started last.

    Every row of a run has its start, so the latest runs are found first and only their rows are looked at.
    """
    newest = first_per_group(log.select("id", "job_type", "started_at"), ["job_type"], [F.col("started_at").desc(), F.col("id")])
    return current_runs(log.join(newest.select("id", "job_type"), ["id", "job_type"], "left_semi"))


def dead_letter_message(error: Column, payload: Column) -> Column:
    return F.concat(error, F.lit(" | payload: "), F.substring(payload, 1, V.PAYLOAD_CHARS))


def dead_letters(bad_rows: DataFrame, as_of: Column, error: str = "error", payload: str = "payload") -> DataFrame:
    """Rejected stream payloads as failed job runs."""
    message = dead_letter_message(F.col(error), F.col(payload))
    return bad_rows.select(
        F.md5(F.col(payload)).alias("id"),
        F.lit("webhook").alias("job_type"),
        F.lit("failed").alias("status"),
        F.lit(0).alias("tickets_processed"),
        message.alias("error_message"),
        as_of.alias("started_at"),
        as_of.alias("finished_at"),
    )
