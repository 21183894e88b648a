"""Snapshots of a running program: the whole state of a superstep, committed by a marker."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..types import KernelSpec
from .fixpoint import Result, Schedule, Stop, finished, iterate, most_rounds, schedule_at


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def save(state: DataFrame, folder: str, epoch: int) -> None:
    """Write epoch ``epoch``; Spark's _SUCCESS file commits it."""
    state.write.mode("overwrite").parquet(f"{folder}/epoch-{epoch:06d}")


def epochs(spark: SparkSession, folder: str) -> list[int]:
    """Committed epochs, ascending."""
    fs, where = _fs(spark, folder)
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where)]
    done = [p for p in found if fs.exists(_fs(spark, f"{p}/_SUCCESS")[1])]
    return sorted(int(m[1]) for p in done if (m := re.search(r"epoch-(\d+)$", str(p))))


def restore(spark: SparkSession, folder: str, epoch: int | None = None) -> tuple[DataFrame, int]:
    """The state of an epoch, the last committed one unless told."""
    done = epochs(spark, folder)
    if not done or (epoch is not None and epoch not in done):
        raise FileNotFoundError(f"no committed epoch {'' if epoch is None else epoch} in {folder}")
    epoch = done[-1] if epoch is None else epoch
    return spark.read.parquet(f"{folder}/epoch-{epoch:06d}"), epoch


def remove_unfinished(spark: SparkSession, folder: str) -> int:
    """Delete epochs without their marker; how many there were."""
    fs, where = _fs(spark, folder)
    done, gone = set(epochs(spark, folder)), 0
    for status in fs.listStatus(where) if fs.exists(where) else []:
        m = re.search(r"epoch-(\d+)$", str(status.getPath()))
        if m and int(m[1]) not in done:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone


def iterate_with_snapshots(
    spec: KernelSpec, state: DataFrame, edges: DataFrame, folder: str, every: int = 5, schedule: Schedule | None = None, stop: Stop | None = None, epoch: int = 0
) -> Result:
    """As `iterate`, saving the state after every ``every`` rounds and at the end."""
    schedule, stop = schedule or Schedule(), stop or Stop()
    vertices = state.count()
    left, rounds, history = most_rounds(spec, stop, vertices), 0, []
    while True:
        part = iterate(spec, state, edges, schedule_at(schedule, stop, rounds, vertices), Stop(stop.rule, stop.epsilon, min(every, left)))
        rounds, left = rounds + part.rounds, left - part.rounds
        history += [m | {"round": m["round"] + rounds - part.rounds} for m in part.metrics[bool(history) :]]
        save(part.state, folder, epoch := epoch + 1)
        state = part.state
        if part.settled or left <= 0:
            return finished(spec, stop, Result(state, rounds, part.settled, history))
