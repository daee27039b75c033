"""Bucket ladders: ordered conditions that turn a number into a label and a rank."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TESTS = {
    "<=": lambda x, edge: x <= edge,
    "<": lambda x, edge: x < edge,
    "=": lambda x, edge: x == edge,
}


@dataclass(frozen=True)
class Ladder:
    """First matching step wins; what matches none, nulls included, gets ``other``."""

    steps: tuple[tuple[str, float, str], ...]
    other: str

    def _chain(self, x: Column, values: Sequence, other) -> Column:
        out = F
        for (test, edge, _), value in zip(self.steps, values):
            out = out.when(_TESTS[test](x, edge), F.lit(value))
        return out.otherwise(F.lit(other))

    def label(self, x: Column) -> Column:
        return self._chain(x, [name for _, _, name in self.steps], self.other)

    def rank(self, x: Column) -> Column:
        return self._chain(x, range(len(self.steps)), len(self.steps))


def cut(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed intervals between the edges; null outside them."""
    out = F
    for low, high, name in zip(edges, edges[1:], labels):
        out = out.when((x > low) & (x <= high), F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def level(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed steps without outer bounds; null stays null."""
    out = F
    for edge, name in zip(edges, labels):
        out = out.when(x <= edge, F.lit(name))
    return out.when(x > edges[-1], F.lit(labels[-1]))


def position(x: Column, names: Sequence[str]) -> Column:
    """Place of a value in a listed order, from 1; 0 when not listed."""
    return F.array_position(F.array(*[F.lit(n) for n in names]), x).cast("int")
