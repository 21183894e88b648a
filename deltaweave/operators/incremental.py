"""Results of an evolving graph: apply a batch of edge changes and go on from earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop
from ..types import CHANGE_TYPES, KernelSpec
from .fixpoint import Result, Schedule, Stop, iterate, messages, prepare_edges, vertices_of


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of every edge, by seq; an unknown type is an error when the plan runs."""
    last = Window.partitionBy("src", "dst").orderBy(F.desc("seq"))
    known = F.col("type").isin(*CHANGE_TYPES)
    kind = F.when(known, F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown change type: "), F.coalesce("type", F.lit("null")))))
    return (
        changes.select("seq", kind.alias("type"), "src", "dst", "weight")
        .withColumn("nth", F.row_number().over(last))
        .where("nth = 1")
        .select("src", "dst", "type", F.col("weight").alias("new_weight"))
    )


def apply_changes(edges: DataFrame, changes: DataFrame, missing: str = "ignore") -> DataFrame:
    """Edges after the changes. A adds (or overwrites), R removes, I and D set the weight.

    ``missing``: what R, I and D of an edge that is not there do: 'ignore' or 'error'.
    """
    joined = edges.select("src", "dst", "weight").join(latest_changes(changes), ["src", "dst"], "full_outer")
    absent = F.col("weight").isNull() & F.col("type").isin("R", "I", "D")
    if missing == "error":
        joined = joined.withColumn("type", F.when(absent, F.raise_error(F.lit("change of an edge that is not there"))).otherwise(F.col("type")))
    elif missing != "ignore":
        raise ValueError(f"missing must be ignore or error, not {missing!r}")
    return joined.where(F.col("type").isNull() | ((F.col("type") != "R") & ~absent)).select(
        "src", "dst", F.when(F.col("type").isNull(), F.col("weight")).otherwise(F.col("new_weight")).alias("weight")
    )


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes that can only improve a least-cost result (A, D) and those that can worsen it (R, I)."""
    return changes.where(F.col("type").isin("A", "D")), changes.where(F.col("type").isin("R", "I"))


def _tight(spec: KernelSpec, edges: DataFrame, state: DataFrame) -> DataFrame:
    """Edges that carry exactly the value of their target."""
    sources = state.where(F.col("value") != spec.nothing).select(F.col("id").alias("src"), F.col("value").alias("vs"))
    targets = state.where(F.col("value") != spec.nothing).select(F.col("id").alias("dst"), F.col("value").alias("vd"))
    carried = spec.message(F.col("vs"), F.col("weight"), F.lit(1.0))
    return edges.join(sources, "src").join(targets, "dst").where(carried == F.col("vd")).select("src", "dst", "weight")


#: Frontiers of a closure that are kept apart before they are put together.
FRONTIERS = 8


def _closure(start: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Ids that can be reached from ``start`` (id) along edges, itself included.

    A round writes its frontier alone; frontiers are put together in levels, so a row is rewritten a few times at most.
    """
    count = F.count(F.lit(1))
    frontier, facts = cut(start.select("id").distinct(), n=count)
    levels: list[list[DataFrame]] = [[frontier]]

    def reached() -> DataFrame:
        found = [df for level in levels for df in level]
        out = found[0]
        for df in found[1:]:
            out = out.union(df)
        return out

    for _ in range(max_rounds):
        if not facts["n"]:
            return reached()
        found = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(reached(), "id", "left_anti")
        frontier, facts = cut(found, n=count)
        if not facts["n"]:
            continue
        levels[0].append(frontier)
        at = 0
        while len(levels[at]) >= FRONTIERS:
            whole = levels[at][0]
            for df in levels[at][1:]:
                whole = whole.union(df)
            merged, _ = cut(whole)
            drop(*[df for df in levels[at] if df is not frontier])
            levels[at] = []
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1].append(merged)
            at += 1
    raise RuntimeError("closure did not settle")


def repair_state(spec: KernelSpec, old_edges: DataFrame, new_edges: DataFrame, prior: DataFrame) -> DataFrame:
    """A state (id, delta, value) from which a selective program reaches the fixpoint of the new graph.

    Values that may have lost their support are deleted and derived again: targets of edges that were
    tight and are not any more, with all that hangs on them by tight edges, lose their values, unless
    their seed or a tight edge from outside still gives the same value (then they, and what they
    support in turn, stay). Pending are the vertices that kept a value and have a new, changed or
    reset target, so the loop starts from them alone.
    """
    seeds = vertices_of(new_edges, prior).withColumn("seed", spec.seed(F.col("id")).cast(spec.dtype))
    known, _ = cut(
        seeds.join(prior.select("id", "value"), "id", "left").select("id", "seed", F.coalesce("value", spec.nothing).alias("value"))
    )
    tight_old, _ = cut(_tight(spec, old_edges, known))
    tight_new, _ = cut(_tight(spec, new_edges, known))
    lost = tight_old.select("src", "dst").exceptAll(tight_new.select("src", "dst")).select(F.col("dst").alias("id"))
    suspects = _closure(lost, tight_old)
    supported_now = (
        suspects.join(known, "id").where("value = seed").select("id").union(
            tight_new.join(suspects.select(F.col("id").alias("dst")), "dst", "left_semi")
            .join(suspects.select(F.col("id").alias("src")), "src", "left_anti")
            .select(F.col("dst").alias("id"))
        )
    )
    inside = tight_new.join(suspects.select(F.col("id").alias("src")), "src", "left_semi").join(
        suspects.select(F.col("id").alias("dst")), "dst", "left_semi"
    )
    supported = _closure(supported_now, inside)
    reset = suspects.join(supported, "id", "left_anti")
    best = F.least if spec.combine == "min" else F.greatest
    changed = new_edges.select("src", "dst", "weight").exceptAll(old_edges.select("src", "dst", "weight")).select("src", "dst")
    to_reset = new_edges.join(reset.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    senders = changed.union(to_reset).select(F.col("src").alias("id")).distinct()
    marked = (
        known.join(reset.withColumn("reset", F.lit(True)), "id", "left")
        .join(senders.withColumn("sends", F.lit(True)), "id", "left")
        .withColumn("kept", F.when(F.col("reset"), spec.nothing).otherwise(best("value", "seed")))
    )
    # a vertex that sends again is pending because its value is put back to the identity and its delta is the value
    ready = marked.select(
        "id", F.col("kept").alias("_kept"), "seed", F.coalesce("reset", F.lit(False)).alias("reset"), F.coalesce("sends", F.lit(False)).alias("sends")
    )
    out, _ = cut(
        ready.select(
            "id",
            F.when(F.col("reset"), best("_kept", "seed")).otherwise(F.col("_kept")).alias("delta"),
            F.when(F.col("reset") | F.col("sends"), spec.nothing).otherwise(F.col("_kept")).alias("value"),
        )
    )
    for done in (tight_old, tight_new):
        drop(done)
    return out


def residual_state(spec: KernelSpec, new_edges: DataFrame, prior: DataFrame) -> DataFrame:
    """A state from which an accumulative program reaches the new fixpoint exactly: the earlier values,
    and as deltas what the new graph makes of them less the values themselves."""
    held = prepare_edges(spec, new_edges)
    values = vertices_of(new_edges, prior).join(prior.select("id", "value"), "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))
    flow = messages(spec, values.select("id", F.col("value").alias("delta")), held)
    out, _ = cut(
        values.join(flow, "id", "left").select(
            "id", (spec.seed(F.col("id")).cast(spec.dtype) + F.coalesce("message", F.lit(0.0)) - F.col("value")).alias("delta"), "value"
        )
    )
    held.unpersist()
    return out


def update(
    spec: KernelSpec,
    edges: DataFrame,
    changes: DataFrame,
    prior: DataFrame,
    schedule: Schedule | None = None,
    stop: Stop | None = None,
    missing: str = "ignore",
) -> tuple[DataFrame, Result]:
    """New edges and the result on them, from the result on ``edges`` (id, value)."""
    merged, _ = cut(apply_changes(edges, changes, missing))
    start = repair_state(spec, edges, merged, prior) if spec.selective else residual_state(spec, merged, prior)
    held = prepare_edges(spec, merged)
    try:
        return merged, iterate(spec, start, held, schedule, stop)
    finally:
        held.unpersist()
