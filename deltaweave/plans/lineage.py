"""Cutting lineage between supersteps with tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def scratch(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset, a local master (as in tests) gets a temporary folder; a cluster has no folder that all
    its machines see unless told, so that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` once and return what reads it back, with aggregates taken in the same job."""
    path = f"{scratch(df.sparkSession)}/table-{uuid.uuid4().hex}"
    found: dict = {}
    if metrics:
        seen = Observation()
        df.observe(seen, *[c.alias(name) for name, c in metrics.items()]).write.parquet(path)
        found = seen.get
    else:
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out, found


@contextmanager
def fixed_plans(spark: SparkSession, parts: int) -> Iterator[None]:
    """Inside, plans are made once, shuffle to ``parts`` partitions and merge what lies that way already: for many small stages in one job."""
    mine = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k) for k in mine}
    try:
        for k, v in mine.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Rows of a part that one task groups where nearly all keys differ.
PART_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of so many rows dealt by keys into parts of bounded size, for grouping by them; keys that hardly repeat gain nothing from grouping
    before the shuffle."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS)), *keys)


def is_cut(df: DataFrame, columns: list[str]) -> bool:
    """Whether ``df`` just reads a table that ``cut`` made, with these columns."""
    return getattr(df, "_scratch", None) is not None and df.columns == columns


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def drop(*frames: DataFrame) -> None:
    """Delete the files behind tables that ``cut`` made and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete all tables of this application: results that were returned but not written read from some of them."""
    _delete(spark, scratch(spark))
