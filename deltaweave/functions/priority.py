"""Priorities of pending vertices: the larger, the sooner.

Scheduling decides only how fast a fixpoint is reached. The four published formulas favour large
values; for programs that look for the least value ``eager`` gives the order that helps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import KernelSpec


def priority(spec: KernelSpec, policy: str = "value", alpha: float = 1.0, degree: Column | None = None) -> Column:
    """Over columns delta and value. Policies: 'value', 'difference', 'eager'; ``degree`` multiplies."""
    delta, value = F.col("delta"), F.col("value")
    if policy == "value":
        if spec.selective:
            out = F.when(spec.better(delta, value), delta).otherwise(alpha * delta)
        else:
            out = F.when(delta < 0, value).otherwise(alpha * value)
    elif policy == "difference":
        out = delta - value if spec.selective else delta
    elif policy == "eager":
        out = F.abs(delta) if not spec.selective else (delta if spec.combine == "max" else -delta)
    else:
        raise ValueError(f"no policy {policy!r}")
    return out if degree is None else out * degree
