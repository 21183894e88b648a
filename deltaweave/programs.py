"""Programs by runner name, run from files to files.

The names are those of the vertex programs in `functions.kernels`, and three that are no vertex programs here:
``MinSpanTree`` (least in-edge of every vertex), ``Simrank`` (over a pair graph) and ``GenGraph`` (a random graph).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.kernels import RUNNERS, kernel
from .operators.fixpoint import Result, Schedule, Stop, min_in_edge, run, simrank_pairs
from .operators.incremental import update
from .sources import generate, text

#: Programs whose graphs have weights.
WEIGHTED = {"Jacobi", "MarkovChain", "Adsorption", "ShortestPath", "WidestPath", "MinSpanTree"}
NAMES = sorted([*RUNNERS, "MinSpanTree", "Simrank", "GenGraph"])


@dataclass
class Job:
    """What to run, on which folders, and how."""

    runner: str
    graph_dir: str = "subgraphs"
    result_dir: str = "result"
    init_dir: str = ""
    delta_prefix: str = ""
    log_dir: str = ""
    shards: int = 10
    num_nodes: int = 100
    portion: float = 1.0
    priority_diff: bool = False
    priority_degree: bool = False
    weight_alpha: float = 1.0
    termcheck: str = "delta"
    termcheck_threshold: float = 1e-9
    max_iterations: int | None = None
    graph_source: int = 0
    adsorption_starts: int = 100
    adsorption_damping: float = 0.1
    katz_source: int = 0
    katz_beta: float = 0.1
    seed: int = 1


def spec_of(job: Job):
    """The vertex program of a job with the parameters that it takes."""
    parameters = {
        "ShortestPath": {"source": job.graph_source},
        "WidestPath": {"source": job.graph_source},
        "Adsorption": {"starts": job.adsorption_starts, "damping": job.adsorption_damping},
        "Katz": {"source": job.katz_source, "beta": job.katz_beta},
    }
    return kernel(job.runner, **parameters.get(job.runner, {}))


def _none(frame: DataFrame) -> Result:
    return Result(frame, 0, True, [])


def execute(spark: SparkSession, job: Job) -> Result:
    """Read the graph, go on from earlier results and changes where they are named, write the result in parts."""
    if job.runner not in NAMES:
        raise KeyError(f"no runner {job.runner!r}; there are {', '.join(NAMES)}")
    seconds, began = {}, time.time()

    def lap(phase: str) -> None:
        nonlocal began
        seconds[phase], began = time.time() - began, time.time()

    if job.runner == "GenGraph":
        edges = generate.log_normal_graph(spark, job.num_nodes, seed=job.seed)
        text.write_graph(edges, spark.range(job.num_nodes), job.graph_dir, True, job.shards)
        lap("dump")
        return _none(edges)
    if job.runner == "Simrank":
        result = _none(simrank_pairs(text.read_pairs(spark, job.graph_dir), rounds=job.max_iterations or 5, least=1e-4))
        lap("compute")
        named = result.state.select(F.col("a").alias("key"), F.concat(F.concat_ws("_", "a", "b"), F.lit("\t0:"), F.col("value").cast("string")).alias("line"))
        text._write(named, F.col("key"), job.result_dir, job.shards)
        lap("dump")
    else:
        edges, vertices = text.read_graph(spark, job.graph_dir, job.runner in WEIGHTED)
        lap("load")
        if job.runner == "MinSpanTree":
            result = _none(min_in_edge(edges).withColumn("delta", F.col("value")))
        else:
            spec = spec_of(job)
            schedule = Schedule(job.portion, "difference" if job.priority_diff else "value", job.weight_alpha, job.priority_degree) if job.portion < 1 else None
            stop = Stop(job.termcheck, job.termcheck_threshold, job.max_iterations)
            before = text.read_result(spark, job.init_dir, spec.dtype) if job.init_dir else None
            if job.delta_prefix:
                changes = text.read_changes(spark, job.delta_prefix + "*")
                lap("load_changes")
                if before is None:
                    before = run(spec, edges, vertices, schedule=schedule, stop=stop).state
                result = update(spec, edges, changes, before, schedule, stop)[1]
            else:
                result = run(spec, edges, vertices, before, schedule, stop)
        lap("compute")
        text.write_result(result.state, job.result_dir, job.shards)
        lap("dump")
    if job.log_dir:
        text.write_log(result, seconds, job.log_dir, spark)
    return result
