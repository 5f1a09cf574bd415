"""The trace of a run: one row a stage with rows, seconds and status. Rows are counted by the actions that run anyway."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, position int, stage string, status string, started double, seconds double, rows long, error string, metrics map<string,double>"


@dataclass
class Stage:
    name: str
    started: float
    seconds: float = 0.0
    status: str = "running"
    error: str | None = None
    observation: Observation | None = None
    metrics: dict[str, float] = field(default_factory=dict)

    def observed(self, df: DataFrame) -> DataFrame:
        """The same table, whose first action that reads it to its end leaves the number of rows here."""
        self.observation = Observation(f"{self.name}-{uuid.uuid4().hex[:8]}")
        return df.observe(self.observation, F.count(F.lit(1)).alias("rows"))

    @property
    def rows(self) -> int | None:
        """Rows that went by; none as long as no action has read the table to its end, or Spark's listeners have not yet heard of it."""
        if self.observation is None or self.observation._jo is None or not self.observation._jo.future().isCompleted():
            return None
        return self.observation.get["rows"]


class Trace:
    """Stages of one run, in the order in which they begin."""

    def __init__(self, spark: SparkSession, run_id: str | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.run_id, self.clock = spark, run_id or uuid.uuid4().hex, clock
        self.stages: list[Stage] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[Stage]:
        """Times what runs inside. An error is noted and goes on."""
        one = Stage(name, self.clock())
        self.stages.append(one)
        try:
            yield one
            one.status = "completed"
        except Exception as e:
            one.status, one.error = "failed", f"{type(e).__name__}: {e}"[:1000]
            raise
        finally:
            one.seconds = self.clock() - one.started

    def table(self) -> DataFrame:
        """The trace: a row a stage. Waits for Spark's listeners, which hear of actions a little later."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        rows = [(self.run_id, i, s.name, s.status, s.started, s.seconds, s.rows, s.error, {k: float(v) for k, v in s.metrics.items()}) for i, s in enumerate(self.stages)]
        return self.spark.createDataFrame(rows, SCHEMA)

    def write(self, folder: str) -> None:
        """Adds the trace to a log table, which trace_summary() reads."""
        self.table().coalesce(1).write.mode("append").parquet(folder)


def trace_summary(log: DataFrame) -> DataFrame:
    """(run_id, stages, failed, seconds, success_rate, status): a row a run of a log table; success_rate in percent."""
    failed = F.count(F.when(F.col("status") == "failed", 1))
    out = log.groupBy("run_id").agg(F.count("*").alias("stages"), failed.alias("failed"), F.sum("seconds").alias("seconds"))
    rate = 100.0 * (F.col("stages") - F.col("failed")) / F.col("stages")
    return out.withColumns({"success_rate": rate, "status": F.when(F.col("failed") == 0, "completed").otherwise("completed_with_errors")})


def stage_statistics(log: DataFrame) -> DataFrame:
    """(stage, runs, failed, mean_seconds, longest_seconds, rows_per_second) over all runs of a log table."""
    failed = F.count(F.when(F.col("status") == "failed", 1))
    speed = F.try_divide(F.sum("rows").cast("double"), F.sum(F.when(F.col("rows").isNotNull(), F.col("seconds"))))
    return log.groupBy("stage").agg(F.count("*").alias("runs"), failed.alias("failed"), F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("longest_seconds"), speed.alias("rows_per_second"))
