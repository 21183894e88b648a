"""Selective programs with remembered contributions: values may get worse when what they rest on does.

Every vertex keeps what each in-neighbour last sent (dst, src, contrib), and its value is the best of its seed and
these. A change of an edge replaces or removes one contribution; targets whose contributions changed fold again,
and those whose value moved, for better or worse, send anew. Vertices on a cycle that has lost all support from outside
climb round by round and never settle; that is an error here, and `incremental.update` is the operator for such changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop
from ..types import KernelSpec
from .fixpoint import vertices_of
from .incremental import apply_changes, latest_changes
from .state import best_contributions, contributions_of, remember


@dataclass
class Remembered:
    """State (id, value, best_from) and contributions (dst, src, contrib); best_from is null where the seed counts."""

    state: DataFrame
    contributions: DataFrame
    rounds: int = 0


def _folded(spec: KernelSpec, ids: DataFrame, contributions: DataFrame) -> DataFrame:
    """(id, value, best_from) of some vertices, from their seeds and all that is remembered for them."""
    seed = spec.seed(F.col("id")).cast(spec.dtype)
    best = best_contributions(contributions.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi"), spec.combine)
    joined = ids.join(best.select("id", F.col("value").alias("got"), F.col("best_from").alias("sender")), "id", "left").withColumn("seed", seed)
    by_sender = F.coalesce(spec.better(F.col("got"), F.col("seed")), F.lit(False))
    return joined.select("id", F.when(by_sender, F.col("got")).otherwise(F.col("seed")).alias("value"), F.when(by_sender, F.col("sender")).alias("best_from"))


def remembered(spec: KernelSpec, edges: DataFrame, result: DataFrame) -> Remembered:
    """What a settled result (id, value) on ``edges`` rests on."""
    contributions, _ = cut(contributions_of(spec, edges, result))
    state, _ = cut(_folded(spec, vertices_of(edges, result.select("id")), contributions))
    return Remembered(state, contributions)


def update_remembered(spec: KernelSpec, edges: DataFrame, changes: DataFrame, before: Remembered, max_rounds: int = 1000) -> tuple[DataFrame, Remembered]:
    """New edges and the result on them, by replacing contributions until no value moves."""
    merged, _ = cut(apply_changes(edges, changes))
    touched = latest_changes(changes).select("src", "dst")
    fresh = contributions_of(spec, merged.join(touched, ["src", "dst"], "left_semi"), before.state)
    gone = touched.join(merged.select("src", "dst"), ["src", "dst"], "left_anti")
    held, _ = cut(remember(before.contributions, fresh, gone))
    state = before.state
    asked, facts = cut(touched.select(F.col("dst").alias("id")).union(vertices_of(merged).join(state, "id", "left_anti")).distinct(), n=F.count(F.lit(1)))
    rounds = 0
    while facts["n"]:
        if rounds == max_rounds:
            raise RuntimeError(f"{spec.name} did not settle in {max_rounds} rounds: a cycle may have lost its support")
        rounds += 1
        folded, _ = cut(_folded(spec, asked, held))
        old = state.select("id", F.col("value").alias("was"))
        moved, _ = cut(folded.join(old, "id", "left").where(F.col("was").isNull() | (F.col("was") != F.col("value"))).select("id", "value"))
        state, _ = cut(state.join(folded.select("id"), "id", "left_anti").unionByName(folded))
        sent = merged.join(moved.select(F.col("id").alias("src")), "src", "left_semi")
        # a sender that has nothing any more takes its contributions back
        silent = sent.join(moved.where(F.col("value") == spec.nothing).select(F.col("id").alias("src")), "src", "left_semi").select("dst", "src")
        after, _ = cut(remember(held, contributions_of(spec, sent, moved), silent))
        asked, facts = cut(sent.select(F.col("dst").alias("id")).distinct(), n=F.count(F.lit(1)))
        drop(held, moved)
        held = after
    return merged, Remembered(state, held, rounds)
