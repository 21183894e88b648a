"""Graphs derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _followers(spark: SparkSession, sf_dir: str, steps: int) -> DataFrame:
    by_nation = Window.partitionBy("c_nationkey").orderBy("o_orderdate", "o_orderkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("o_custkey").alias("src"), F.lead("o_custkey", steps).over(by_nation).alias("dst"), (1 + F.col("o_orderkey") % 97).cast("double").alias("weight"))
        .where("dst is not null and src <> dst")
        .groupBy("src", "dst")
        .agg(F.min("weight").alias("weight"))
    )


def handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the customer of an order to that of the next order in the same nation."""
    return _followers(spark, sf_dir, 1)


def handoff_changes(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    """A batch of changes of `handoff`, by a rule on the ids; its ``edges``, where they are at hand, are not made again."""
    edges = handoff(spark, sf_dir) if edges is None else edges
    k = (F.col("src") * 31 + F.col("dst")) % 50
    kind = F.when(k == 0, "R").when(k == 1, "I").when(k == 2, "D")
    weight = F.when(k == 1, F.col("weight") * 2).when(k == 2, F.col("weight") * 0.5).otherwise(F.col("weight"))
    old = edges.select(kind.alias("type"), "src", "dst", weight.alias("weight")).where("type is not null")
    new = (
        _followers(spark, sf_dir, 2).where("(src * 31 + dst) % 20 = 3").join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select(F.lit("A").alias("type"), "src", "dst", "weight")
    )
    return old.unionByName(new).select((F.col("src") * 1_000_000 + F.col("dst")).alias("seq"), "type", "src", "dst", "weight")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a customer's nation to a supplier's, by the quantity ordered."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    bought = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "src")
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "dst", "l_quantity")
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("src", "dst")
        .agg(F.sum("l_quantity").alias("weight"))
    )


def busy_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of `trade` above their source's mean weight."""
    mean = F.avg("weight").over(Window.partitionBy("src"))
    return trade(spark, sf_dir).withColumn("mean", mean).where("weight > mean").drop("mean")


PART_OFFSET = 1_000_000_000


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From supplier to part, by the number of line items; part ids are offset."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART_OFFSET).alias("dst"))
    return dealt(lines, lines.count(), "src", "dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a type of event to the type of the same user's next event, by count; types are numbered by name."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    after = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = events.select("event_type", F.lead("event_type").over(after).alias("next")).where("next is not null").groupBy("event_type", "next").agg(F.count("*").cast("double").alias("weight"))
    names = events.select("event_type").distinct().withColumn("k", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long"))
    return (
        pairs.join(names.select("event_type", F.col("k").alias("src")), "event_type")
        .join(names.select(F.col("event_type").alias("next"), F.col("k").alias("dst")), "next")
        .select("src", "dst", "weight")
    )
