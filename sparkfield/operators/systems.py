"""Equation systems: each equation is an expression that should be zero; a row is one problem."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkfield.functions.expr import Expr
from sparkfield.operators import graph
from sparkfield.operators.grid import Grid
from sparkfield.plans.compile import column


@dataclass(frozen=True)
class System:
    equations: tuple[Expr, ...] = ()
    unknowns: tuple[str, ...] = ()
    parameters: Mapping[str, float] | None = None
    grid: Grid | None = None
    tolerance: float = 1e-6
    max_iterations: int = 1000

    def add_equation(self, e: Expr) -> System:
        return replace(self, equations=(*self.equations, e))

    def with_unknowns(self, *names: str) -> System:
        return replace(self, unknowns=tuple(names))

    def with_parameter(self, name: str, value: float) -> System:
        return replace(self, parameters={**(self.parameters or {}), name: value})

    def with_grid(self, grid: Grid) -> System:
        return replace(self, grid=grid)

    @property
    def is_well_posed(self) -> bool:
        """As many equations as unknowns, and some."""
        return len(self.equations) == len(self.unknowns) > 0

    def residuals(self) -> list[Column]:
        """One column per equation over a row's parameters and guesses."""
        return [column(e, self.parameters) for e in self.equations]

    def dependencies(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Unknown i is taken as defined by equation i; other names count as dependencies too."""
        return graph.from_definitions(spark, dict(zip(self.unknowns, self.equations, strict=False)))

    def solve_order(self, spark: SparkSession) -> list[str] | None:
        """Unknowns, dependents first; None if they depend on each other in a circle."""
        nodes, edges = self.dependencies(spark)
        edges = edges.where("var <> dep")
        levels, acyclic = graph.topological_levels(nodes, edges)
        if not acyclic:
            return None
        # a system's unknowns are plan-time names, so their order is small
        return [r.var for r in levels.join(nodes, "var").orderBy("level", "ord").collect()]

    def __str__(self):
        lines = [f"System: {len(self.equations)} equations, {len(self.unknowns)} unknowns ({', '.join(self.unknowns)})"]
        lines += [f"  {i}: {e} = 0" for i, e in enumerate(self.equations)]
        lines += [f"  {k} = {v:g}" for k, v in (self.parameters or {}).items()]
        return "\n".join(lines)


def residual_norm(residuals: Sequence[Column]) -> Column:
    """L2 norm; infinite if a residual is missing."""
    total = F.lit(0.0)
    for r in residuals:
        total = total + r * r
    return F.coalesce(F.sqrt(total), F.lit(float("inf")))


def describe_result(unknowns: Sequence[str]) -> Column:
    """A result row as text."""
    parts = [F.concat(F.lit(f"{u}="), F.coalesce(F.format_string("%.6f", F.col(u)), F.lit("-"))) for u in unknowns]
    return F.concat(F.col("status"), F.lit(" after "), F.col("iterations").cast("string"), F.lit(": "), F.concat_ws(", ", *parts))
