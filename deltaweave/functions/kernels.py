"""The vertex programs, by runner name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..types import KernelSpec

INFINITY = float("inf")


def pagerank(damping: float = 0.8) -> KernelSpec:
    """v = (1 - damping) + damping * sum of v / out-degree over in-edges; mass of dangling vertices is lost."""
    return KernelSpec("Pagerank", "sum", lambda k: F.lit(1 - damping), lambda d, w, n: d * damping / n, 0.0, True)


def jacobi(constant: float = 0.2) -> KernelSpec:
    """v = constant - sum of w * v; edges to itself must have been dropped."""
    return KernelSpec("Jacobi", "sum", lambda k: F.lit(constant), lambda d, w, n: -w * d, 0.0)


def markov_chain() -> KernelSpec:
    """Mass 1 in every vertex moves along row-normalised weights; it never settles, so give a number of rounds."""
    return KernelSpec("MarkovChain", "sum", lambda k: F.lit(1.0), lambda d, w, n: w * d, 0.0)


def adsorption(starts: int = 100, damping: float = 0.1, amount: float = 10.0) -> KernelSpec:
    return KernelSpec("Adsorption", "sum", lambda k: F.when(k < starts, amount).otherwise(0.0), lambda d, w, n: w * d * damping, 0.0)


def katz(source: int = 0, beta: float = 0.1, amount: float = 1e6) -> KernelSpec:
    """Settles only if beta times the largest eigenvalue of the graph is below 1."""
    return KernelSpec("Katz", "sum", lambda k: F.when(k == source, amount).otherwise(0.0), lambda d, w, n: d * beta, 0.0)


def shortest_path(source: int = 0) -> KernelSpec:
    return KernelSpec("ShortestPath", "min", lambda k: F.when(k == source, 0.0).otherwise(INFINITY), lambda d, w, n: d + w, INFINITY)


def widest_path(source: int = 0) -> KernelSpec:
    """Unreached vertices have width 0, the source has infinity."""
    return KernelSpec("WidestPath", "max", lambda k: F.when(k == source, INFINITY).otherwise(0.0), lambda d, w, n: F.least(d, w), 0.0)


def max_label() -> KernelSpec:
    """The largest id among the vertices that reach a vertex, itself included."""
    return KernelSpec("ConComp", "max", lambda k: k.cast("long"), lambda d, w, n: d, -(1 << 63), dtype="long")


def min_label() -> KernelSpec:
    return KernelSpec("ConCompMin", "min", lambda k: k.cast("long"), lambda d, w, n: d, (1 << 63) - 1, dtype="long")


RUNNERS: dict[str, Callable[..., KernelSpec]] = {
    "Pagerank": pagerank,
    "Jacobi": jacobi,
    "MarkovChain": markov_chain,
    "Adsorption": adsorption,
    "Katz": katz,
    "ShortestPath": shortest_path,
    "WidestPath": widest_path,
    "ConComp": max_label,
    "ConCompMin": min_label,
}


def kernel(runner: str, **parameters) -> KernelSpec:
    """The program registered under a runner name."""
    if runner not in RUNNERS:
        raise KeyError(f"no runner {runner!r}; there are {', '.join(sorted(RUNNERS))}")
    return RUNNERS[runner](**parameters)
