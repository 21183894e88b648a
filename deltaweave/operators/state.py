"""Point and merge operators on state tables and remembered contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


def upsert(state: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows put in place of those with the same key, or added; fields that are null keep what was there."""
    fields = [c for c in state.columns if c != key]
    new = rows.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields if c in rows.columns])
    given = set(rows.columns)
    return state.join(new, key, "full_outer").select(
        key, *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in given else F.col(c) for c in fields]
    )


def get(state: DataFrame, ids: DataFrame, *fields: str) -> DataFrame:
    """The rows (or some fields) of given ids."""
    found = state.join(ids.select("id").distinct(), "id", "left_semi")
    return found.select("id", *fields) if fields else found


def contains(state: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, present) for every asked id."""
    return ids.select("id").distinct().join(state.select("id").distinct().withColumn("p", F.lit(True)), "id", "left").select(
        "id", F.coalesce("p", F.lit(False)).alias("present")
    )


def accumulate(state: DataFrame, arrivals: DataFrame, combine: str, field: str = "delta") -> DataFrame:
    """Fold arrivals (id, v) into a field of the state; arrivals of unknown ids are dropped."""
    folded = arrivals.groupBy("id").agg(_FOLD[combine]("v").alias("_v"))
    old = F.col(field)
    merged = old + F.coalesce("_v", F.lit(0)) if combine == "sum" else (F.least if combine == "min" else F.greatest)(old, F.col("_v"))
    joined = state.join(folded, "id", "left")
    return joined.select(*[merged.alias(field) if c == field else F.col(c) for c in state.columns])


def remember(contributions: DataFrame, arrivals: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """What each vertex (dst) last got from each in-neighbour (src): new ones overwrite, removed pairs go."""
    kept = contributions.join(arrivals.select("dst", "src"), ["dst", "src"], "left_anti").select("dst", "src", "contrib")
    out = kept.unionByName(arrivals.select("dst", "src", "contrib"))
    return out if removed is None else out.join(removed.select("dst", "src"), ["dst", "src"], "left_anti")


def best_contributions(contributions: DataFrame, combine: str) -> DataFrame:
    """(id, value, best_from): the best contribution and its sender; ties go to the smaller sender."""
    if combine == "min":
        best = F.min(F.struct(F.col("contrib"), F.col("src"))).alias("b")
        value, sender = F.col("b.contrib"), F.col("b.src")
    else:
        best = F.max(F.struct(F.col("contrib"), (-F.col("src")).alias("src"))).alias("b")
        value, sender = F.col("b.contrib"), -F.col("b.src")
    return contributions.groupBy(F.col("dst").alias("id")).agg(best).select("id", value.alias("value"), sender.alias("best_from"))


def contributions_of(spec, edges: DataFrame, state: DataFrame) -> DataFrame:
    """What every edge carries for the values of its source (selective programs): dst, src, contrib."""
    values = state.where(F.col("value") != spec.nothing).select(F.col("id").alias("src"), F.col("value").alias("v"))
    return edges.join(values, "src").select("dst", "src", spec.message(F.col("v"), F.col("weight"), F.lit(1.0)).alias("contrib"))
