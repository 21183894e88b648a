"""Critical edges, comparison of results, error statistics, histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import INFINITY, shortest_path
from .fixpoint import run, vertices_of


def shortest_path_edges(edges: DataFrame, distances: DataFrame) -> DataFrame:
    """(src, dst) of the edges on some shortest path, from distances (id, value)."""
    reached = distances.where(F.col("value") < INFINITY)
    s = reached.select(F.col("id").alias("src"), F.col("value").alias("vs"))
    d = reached.select(F.col("id").alias("dst"), F.col("value").alias("vd"))
    return edges.join(s, "src").join(d, "dst").where("vd = vs + weight").select("src", "dst").distinct()


def widest_path_edges(edges: DataFrame, widths: DataFrame) -> DataFrame:
    """(src, dst) of the edges from reached vertices whose weight is the width of their target."""
    s = widths.where(F.col("value") > 0).select(F.col("id").alias("src"))
    d = widths.select(F.col("id").alias("dst"), F.col("value").alias("vd"))
    return edges.join(s, "src", "left_semi").join(d, "dst").where("vd = weight").select("src", "dst").distinct()


def rebuild_distances(edges: DataFrame, critical: DataFrame, source: int) -> DataFrame:
    """Distances of all vertices over the critical edges alone: equal to those over all edges."""
    only = edges.join(critical, ["src", "dst"], "left_semi")
    start = edges.sparkSession.range(source, source + 1)
    return run(shortest_path(source), only, vertices_of(edges, start)).state.select("id", "value")


def compare(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row on two results (id, value): how many differ by more than the tolerance, the sum and maximum of
    differences, how many are infinite on one side only, and how many ids only one side has."""
    both = left.select("id", F.col("value").alias("l")).join(right.select("id", F.col("value").alias("r")), "id", "full_outer")
    alone = F.col("l").isNull() | F.col("r").isNull()
    li, ri = F.abs("l") == INFINITY, F.abs("r") == INFINITY
    gap = F.when(~alone & ~li & ~ri, F.abs(F.col("l") - F.col("r")))
    return both.agg(
        F.count_if(gap > tolerance).alias("n_different"),
        F.coalesce(F.sum(gap), F.lit(0.0)).alias("sum_difference"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_difference"),
        F.count_if(~alone & (li != ri)).alias("n_infinite_on_one_side"),
        F.count_if(alone).alias("n_on_one_side"),
    )


def error_statistics(left: DataFrame, right: DataFrame, field: str = "value") -> DataFrame:
    """One row: least, largest and mean difference and root of the mean square, over common ids."""
    gap = F.col("l") - F.col("r")
    return left.select("id", F.col(field).alias("l")).join(right.select("id", F.col(field).alias("r")), "id").agg(
        F.min(gap).alias("min_error"), F.max(gap).alias("max_error"), F.avg(gap).alias("mean_error"), F.sqrt(F.avg(gap * gap)).alias("rms_error")
    )


def different_neighbours(left: DataFrame, right: DataFrame) -> DataFrame:
    """(dst, src, side) of in-neighbour pairs that only one list has."""
    l, r = left.select("dst", "src").distinct(), right.select("dst", "src").distinct()
    return l.exceptAll(r).withColumn("side", F.lit("left")).union(r.exceptAll(l).withColumn("side", F.lit("right")))


def log_histogram(df: DataFrame, column: str, base: float = 1.1) -> DataFrame:
    """(bucket, n) of positive values by floor(log_base)."""
    return df.where(F.col(column) > 0).groupBy(F.floor(F.log(column) / math.log(base)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
