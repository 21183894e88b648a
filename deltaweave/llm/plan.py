"""Plan helpers: reading tables, sizing and dealing partitions, cutting lineage, hot keys, components."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import lineage
from ..plans.lineage import drop

__all__ = ["BATCH_BYTES", "BLOCK_BYTES", "block_of", "bounded_batches", "bucketed", "components", "cut", "dealt_blocks", "drop", "findable", "partitions", "shuffles_removed", "table", "with_hot_keys", "with_rank"]

#: Bytes of stored text that one group or one task of a text stage should hold.
BLOCK_BYTES = 24 << 20
#: Rows of one key that a task may hold in any case; more make the key a hot one if it also has a thousandth of all rows.
HOT_ROWS = 250
#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20


def findable(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package wherever the driver was started.

    On other machines the package is installed or shipped, and the extra path does no harm.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    findable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Let batches for Python workers hold about ``BATCH_BYTES`` (from Spark 4.1 on), unless the session has a bound of its own.

    Spark's bound is 64 MB; the executor holds a batch while it is filled and sent, and the worker while it is used. The setting stays,
    since a plan runs after its operator has returned. It changes no result: operators cut or join batches themselves.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def partitions(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many partitions to deal ``df`` to: by the summed sizes of what it reads, without running it.

    Only leaves of the plan count, since estimates of joins are products. A leaf whose size Spark does not know
    (rows of an RDD) counts as many partitions as it has.
    """
    spark = df.sparkSession
    findable(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known, unknown = 0, 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        size = int(leaf.stats().sizeInBytes())
        if size < 1 << 62:
            known += size
        elif leaf.nodeName().endswith("ExistingRDD") or leaf.getClass().getSimpleName() == "LogicalRDD":
            unknown += leaf.rdd().getNumPartitions()
    return max(least, -(-known // block_bytes), unknown)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files, so lost executors cost no recomputation."""
    return lineage.cut(df)[0]


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go as soon as it has ended (from Spark 4.1 on), not when the driver's garbage is next collected.

    Tables that ``cut`` makes are complete by then, so nothing reads these files any more.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def block_of(column: str | Column, blocks: int) -> Column:
    """A block number that depends on the value alone."""
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _times(x: Column, factor: int) -> Column:
    """The product of two numbers of 32 bits, modulo 2**32, without overflow of 64 bits."""
    low, high = factor & 0xFFFF, factor >> 16
    return (x * low + F.shiftleft((x * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def _turned(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.shiftright(x, 32 - bits))


def seat(block: Column) -> Column:
    """The int whose hash, as Spark deals rows by it, is the block number: block b of n lands in partition b of n.

    Murmur3 of one int is a chain of invertible steps; this walks them backwards.
    """
    wrap = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    steps = (
        lambda x: x.bitwiseXOR(F.shiftright(x, 16)),
        lambda x: _times(x, pow(0xC2B2AE35, -1, 1 << 32)),
        lambda x: x.bitwiseXOR(F.shiftright(x, 13)).bitwiseXOR(F.shiftright(x, 26)),
        lambda x: _times(x, pow(0x85EBCA6B, -1, 1 << 32)),
        lambda x: x.bitwiseXOR(F.shiftright(x, 16)).bitwiseXOR(F.lit(4)),
        lambda x: _times(wrap(x + ((1 << 32) - 0xE6546B64)), pow(5, -1, 1 << 32)),
        lambda x: _turned(x, 19).bitwiseXOR(F.lit(42)),
        lambda x: _times(x, pow(0x1B873593, -1, 1 << 32)),
        lambda x: _turned(x, 17),
        lambda x: _times(x, pow(0xCC9E2D51, -1, 1 << 32)),
        lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int"),
    )
    held = F.array(block.cast("long"))
    for step in steps:  # each names its operand once, so the expression does not double at every step
        held = F.transform(held, step)
    return held[0]


def dealt_blocks(df: DataFrame, blocks: int, block: Column, name: str = "_block") -> DataFrame:
    """``df`` with a column ``name`` that names the block, and every block in a partition of its own."""
    return df.withColumn(name, seat(block)).repartition(blocks, name)


def bucketed(column: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder`` (false for null)."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def with_rank(df: DataFrame, value: Column, edges: list[float], name: str) -> DataFrame:
    """``df`` with a column ``name``: how many of the sorted ``edges`` are not above the value; 0 for null.

    By the JVM's binary search (nested SQL conditions would grow with a power of the edges' logarithm).
    """
    if not edges:
        return df.withColumn(name, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    search = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="_value", outputCol="_rank", handleInvalid="keep")
    ranked = search.transform(df.withColumn("_value", value.cast("double")))
    return ranked.withColumn(name, F.when(F.col("_value").isNull(), 0).otherwise(F.col("_rank")).cast("int")).drop("_value", "_rank")


def with_hot_keys(rows: DataFrame, values: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``values``, which has one row per key and the number ``count`` of rows that have it.

    Keys of more than a thousandth of all ``total`` rows (and of ``HOT_ROWS``) are at most a thousand: their values
    are broadcast, so their rows stay where they are. The others are joined by a shuffle.
    """
    limit = max(HOT_ROWS, total // 1000)
    hot = F.broadcast(values.where(F.col(count) > limit))
    rest = rows.join(F.broadcast(values.where(F.col(count) > limit).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(values.where(F.col(count) <= limit), keys))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (id, component) per vertex that has an edge
    to another one; ``component`` is the smallest id of its component.

    Alternating large-star and small-star rounds; every round is two aggregations and two joins
    over the remaining edges, which shrink to one star per component. The centre of a large star is a hot key.
    Nothing is collected but a count and a checksum per round.
    """

    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        out, facts = lineage.cut(df, n=F.count(F.lit(1)), s=F.sum(F.xxhash64("a", "b") % (1 << 31)))
        return out, (facts["n"], facts["s"])

    now, facts = settled(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    for _ in range(max_rounds):
        if not facts[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = (
            with_hot_keys(both.where("b > a"), least, ["a"], "n", 2 * facts[0])
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after, found = settled(small)
        drop(now)
        now, before, facts = after, facts, found
        if facts == before:
            out = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
            out._scratch = now._scratch
            return out
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
