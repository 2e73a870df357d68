"""Views over streams: a streaming table can back the base of a view that is asked at one grain."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..engine import Engine
from ..errors import SemanticError


def stream_query(engine: Engine, view: str, dimensions=(), metrics=(), where: str | None = None) -> DataFrame:
    """A streaming DataFrame of the request, to be written in complete or update mode; snapshots, windows and several grains are refused."""
    plan = engine.plan(view, dimensions, metrics, (), where)
    if len(plan.groups) != 1 or plan.windows or plan.groups[0].snapshots:
        raise SemanticError("a stream answers aggregates of one grain only")
    return engine.query(view, dimensions, metrics, (), where)
