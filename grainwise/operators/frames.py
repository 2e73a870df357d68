"""Plans as lazy DataFrames: scans, joins, filters, aggregation by grain, snapshots, windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aggregates
from ..model import Order, WindowSpec
from ..plans import text
from ..plans.planner import Group, Plan


def joined(spark: SparkSession, group: Group) -> DataFrame:
    """The root and its LEFT JOINs, filtered; Catalyst pushes filters and columns into the scans."""
    alias, table = group.root
    df = spark.table(table).alias(alias)
    for j in group.joins:
        on = reduce(SparkColumn.__and__, (F.expr(a) == F.expr(b) for a, b in j.on))
        df = df.join(spark.table(j.table).alias(j.alias), on, "left")
    return df.where(F.expr(group.where)) if group.where else df


def ordering(column: SparkColumn, order: Order, reverse: bool = False) -> SparkColumn:
    """NULLS are placed as declared, also when the direction is reversed."""
    down = order.descending != reverse
    if order.nulls_first:
        return column.desc_nulls_first() if down else column.asc_nulls_first()
    return column.desc_nulls_last() if down else column.asc_nulls_last()


def aggregated(spark: SparkSession, group: Group) -> DataFrame:
    df = joined(spark, group)
    if group.snapshots:
        return _snapshot(df, group)
    dims = [F.expr(d.expr).alias(d.name) for d in group.dimensions]
    metrics = [F.expr(m.expr).alias(m.name) for m in group.metrics]
    return df.groupBy(*dims).agg(*metrics)


def _snapshot(df: DataFrame, group: Group) -> DataFrame:
    """Aggregates twice: by the dimensions and the places in time, then over the places that count.

    The first step is combined before the shuffle, so ranking sees one row for each place
    instead of each row of the tables.  Without anything to partition by, the place that
    counts is a maximum, not a ranking of all places in one task.
    """
    dims = [F.expr(d.expr).alias(f"_d{i}") for i, d in enumerate(group.dimensions)]
    at = {d.name: f"_d{i}" for i, d in enumerate(group.dimensions)}
    orders = [F.expr(e).alias(f"_o{i}_{j}") for i, shot in enumerate(group.snapshots) for j, (e, _) in enumerate(shot.order)]
    calls = [(name.lower(), m.expr[a:b]) for m in group.metrics for name, a, b in [next(iter(text.calls(m.expr)))]]
    inner = []
    for i, (name, value) in enumerate(calls):
        x = F.expr(value)
        inner += [F.sum(x).alias(f"_v{i}"), F.count(x).alias(f"_n{i}")] if name == "avg" else [getattr(F, name)(x).alias(f"_v{i}")]
    places = [f"_d{i}" for i in range(len(dims))] + [f"_o{i}_{j}" for i, shot in enumerate(group.snapshots) for j in range(len(shot.order))]
    pre = df.groupBy(*dims, *orders).agg(*inner)
    chosen: dict[str, SparkColumn] = {}
    for i, shot in enumerate(group.snapshots):
        keys = [F.col(at[name]) for name in shot.partition]
        flag = f"_first{i}"
        downs = {o.descending for _, o in shot.order}
        if not keys and len(downs) == 1:
            down = not downs.pop()  # the last place of the declared order
            place = F.struct(*(x for j, (_, o) in enumerate(shot.order) for x in (_null_rank(F.col(f"_o{i}_{j}"), o, down), F.col(f"_o{i}_{j}"))))
            best = pre.agg((F.max if down else F.min)(place).alias(f"_best{i}"))
            pre = pre.crossJoin(F.broadcast(best)).withColumn(flag, place.eqNullSafe(F.col(f"_best{i}"))).drop(f"_best{i}")  # one row
        else:
            window = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(*(ordering(F.col(f"_o{i}_{j}"), o, reverse=True) for j, (_, o) in enumerate(shot.order)))
            pre = pre.withColumn(flag, F.rank().over(window) == 1)
        chosen |= {name: F.col(flag) for name in shot.metrics}
    whole = df.select(*(F.expr(m.expr).alias(m.name) for m in group.metrics)).schema  # avg keeps its own type
    outputs = []
    for i, (m, (name, _)) in enumerate(zip(group.metrics, calls, strict=True)):
        counts = lambda c, m=m: F.when(chosen[m.name], F.col(c)) if m.name in chosen else F.col(c)
        if name == "avg":
            value = F.try_divide(F.sum(counts(f"_v{i}")), F.sum(counts(f"_n{i}")))
        elif name == "count":
            value = F.coalesce(F.sum(counts(f"_v{i}")), F.lit(0))
        else:
            value = getattr(F, name)(counts(f"_v{i}"))
        outputs.append(value.cast(whole[m.name].dataType).alias(m.name))
    return pre.groupBy(*(F.col(p).alias(d.name) for p, d in zip(places, group.dimensions, strict=False))).agg(*outputs)


def _null_rank(column: SparkColumn, order: Order, down: bool) -> SparkColumn:
    """Where NULLs stand: a number that goes before the value in comparisons."""
    first = order.nulls_first == down
    return F.when(column.isNull(), F.lit(int(first))).otherwise(F.lit(int(not first)))


def combined(spark: SparkSession, plan: Plan) -> DataFrame:
    """Grains meet in NULL-safe FULL OUTER JOINs on the dimensions; without dimensions each grain is one row."""
    frames = [aggregated(spark, g) for g in plan.groups]
    out, dims = frames[0], list(plan.dimensions)
    for other in frames[1:]:
        if not dims:
            out = out.crossJoin(other)  # one row each
            continue
        renamed = other.select(*(F.col(f"`{d}`").alias(f"_r{i}") for i, d in enumerate(dims)), *(c for c in other.columns if c not in dims), F.lit(True).alias("_there"))
        on = reduce(SparkColumn.__and__, (F.col(f"`{d}`").eqNullSafe(F.col(f"_r{i}")) for i, d in enumerate(dims)))
        both = out.join(renamed, on, "full_outer")
        out = both.select(*(F.coalesce(F.col(f"`{d}`"), F.col(f"_r{i}")).alias(d) for i, d in enumerate(dims)), *(c for c in both.columns if c not in dims and not c.startswith("_r") and c != "_there"))
    return out


def window_column(spec: WindowSpec) -> str:
    """The window function over the aggregated columns, as SQL."""
    quoted = lambda n: f"`{n}`"
    parts = []
    if spec.partition:
        parts.append("PARTITION BY " + ", ".join(map(quoted, spec.partition)))
    if spec.order:
        parts.append("ORDER BY " + ", ".join(f"{quoted(o.key)} {'DESC' if o.descending else 'ASC'} NULLS {'FIRST' if o.nulls_first else 'LAST'}" for o in spec.order))
    if spec.frame:
        parts.append(spec.frame)
    arguments = "" if spec.function.lower() in NO_ARGUMENT else ", ".join([quoted(spec.metric), *spec.extra])
    function = aggregates.RENAMED.get(spec.function.lower(), spec.function)
    return f"{function}({arguments}) OVER ({' '.join(parts)})"


# Ranking functions, which take no argument.
NO_ARGUMENT = frozenset({"row_number", "rank", "dense_rank", "percent_rank", "cume_dist"})


def frame(spark: SparkSession, plan: Plan) -> DataFrame:
    if plan.materialized:
        mat, names = plan.materialized
        return spark.table(mat.table).select(*(F.col(f"`{n}`") for n in names))
    if plan.rows is not None:
        df = joined(spark, plan.rows).select(*(F.expr(c.expr).alias(c.name) for c in (*plan.rows.dimensions, *plan.rows.metrics)))
        return df.distinct() if plan.distinct else df
    df = combined(spark, plan)
    dims = [F.col(f"`{d}`") for d in plan.dimensions]
    df = df.select(*dims, *(F.expr(c.expr).alias(c.name) for c in plan.outputs))
    if plan.windows:
        df = df.select(*dims, *(F.expr(window_column(spec)).alias(name) for name, spec in plan.windows))
    return df
