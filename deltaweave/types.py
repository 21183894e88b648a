"""Schemas of the tables that the engine works on, and the specification of a vertex program."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_long, _double = T.LongType(), T.DoubleType()

VERTICES = T.StructType([T.StructField("id", _long)])
EDGES = T.StructType([T.StructField("src", _long), T.StructField("dst", _long), T.StructField("weight", _double)])
STATE = T.StructType([T.StructField("id", _long), T.StructField("delta", _double), T.StructField("value", _double)])
CHANGES = T.StructType(
    [T.StructField("seq", _long), T.StructField("type", T.StringType()), T.StructField("src", _long), T.StructField("dst", _long), T.StructField("weight", _double)]
)
CONTRIBUTIONS = T.StructType([T.StructField("dst", _long), T.StructField("src", _long), T.StructField("contrib", _double)])

#: Kinds of edge changes: add, remove, increase and decrease of the weight.
CHANGE_TYPES = ("A", "R", "I", "D")


@dataclass(frozen=True)
class KernelSpec:
    """A vertex program made of Column functions, so that all of it stays inside Catalyst.

    ``combine`` is 'sum' for accumulative programs (the value is the sum of all deltas) and 'min' or
    'max' for selective ones (the value is the best delta). ``seed`` gives a vertex's first
    delta from its id; ``message`` what an edge carries for a source's delta, its weight and the
    source's out-degree. ``identity`` is the value of a vertex that nothing has reached. ``dtype`` is the SQL type of
    values, deltas and messages ('double', or 'long' for labels, which doubles hold up to 2**53 only). ``before``, if given, makes the
    delta that a vertex works with from its delta and value, before it is folded and sent.
    """

    name: str
    combine: str
    seed: Callable[[Column], Column]
    message: Callable[[Column, Column, Column], Column]
    identity: float
    needs_degree: bool = False
    dtype: str = "double"
    before: Callable[[Column, Column], Column] | None = None

    def __post_init__(self):
        if self.combine not in ("sum", "min", "max"):
            raise ValueError(f"combine must be sum, min or max, not {self.combine!r}")

    @property
    def nothing(self) -> Column:
        """The identity as a column of the program's type."""
        return F.lit(self.identity).cast(self.dtype)

    @property
    def selective(self) -> bool:
        return self.combine != "sum"

    def better(self, a: Column, b: Column) -> Column:
        """Whether ``a`` would replace ``b``."""
        return a < b if self.combine == "min" else a > b
