"""Shapes of a graph: degrees, neighbours, inversion, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import dealt


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, links): out-edges of a vertex as a sorted array of (end, weight)."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("end"), "weight"))).alias("links"))


def edges_of(lists: DataFrame) -> DataFrame:
    """Edges from adjacency lists (id, links)."""
    return lists.select(F.col("id").alias("src"), F.explode("links").alias("l")).select("src", F.col("l.end").alias("dst"), F.col("l.weight").alias("weight"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def in_neighbours(edges: DataFrame) -> DataFrame:
    """(id, sources): sorted in-neighbours."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("sources"))


def invert(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def symmetrise(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Both directions of every edge once, with the least weight; a known number of ``rows`` bounds what a task groups."""
    both = edges.select("src", "dst", "weight").union(invert(edges).select("src", "dst", "weight"))
    return (both if rows is None else dealt(both, 2 * rows, "src", "dst")).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def normalise(edges: DataFrame, scale: float = 1.0) -> DataFrame:
    """Weights divided by their sum over the source, times ``scale``."""
    whole = F.sum("weight").over(Window.partitionBy("src"))
    return edges.select("src", "dst", (F.col("weight") / whole * scale).alias("weight"))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def with_loops(edges: DataFrame, vertices: DataFrame, weight: float) -> DataFrame:
    """A loop of the given weight on each of the vertices, in place of any it has."""
    ids = vertices.select("id").distinct()
    kept = edges.select("src", "dst", "weight").join(ids.select(F.col("id").alias("src"), F.col("id").alias("dst")), ["src", "dst"], "left_anti")
    return kept.unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(weight).alias("weight")))
