"""From a request to a plan: which tables to join, at which grain to aggregate, what to refuse.

A plan is plain data; ``operators.frames`` makes a lazy DataFrame of it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import combinations

from .. import errors
from ..functions import aggregates
from ..model import Definition, Materialization, Member, Metric, Order, WindowSpec, bare, key, last, parts
from . import text
from .graph import Graph, fact_names, facts_in


@dataclass(frozen=True)
class Join:
    alias: str
    table: str
    on: tuple[tuple[str, str], ...]  # equal qualified columns


@dataclass(frozen=True)
class Column:
    name: str
    expr: str


@dataclass(frozen=True)
class Snapshot:
    """Only rows at the last place of ``order`` count, within the asked dimensions that the metric is additive by; ties all do."""

    order: tuple[tuple[str, Order], ...]  # (expression, declared order)
    partition: tuple[str, ...]  # names of dimension columns
    metrics: tuple[str, ...]


@dataclass(frozen=True)
class Group:
    """One aggregation at one grain."""

    root: tuple[str, str]  # alias, table
    joins: tuple[Join, ...]
    where: str | None
    dimensions: tuple[Column, ...]
    metrics: tuple[Column, ...]
    snapshots: tuple[Snapshot, ...] = ()


@dataclass(frozen=True)
class Plan:
    groups: tuple[Group, ...] = ()
    dimensions: tuple[str, ...] = ()
    outputs: tuple[Column, ...] = ()  # over dimension and metric columns
    windows: tuple[tuple[str, WindowSpec], ...] = ()
    rows: Group | None = None  # row-level request; ``metrics`` are facts
    distinct: bool = False
    materialized: tuple[Materialization, tuple[str, ...]] | None = None


@dataclass(frozen=True)
class Request:
    dimensions: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    facts: tuple[str, ...] = ()
    where: str | None = None


@dataclass
class Planner:
    view: Definition
    graph: Graph = field(init=False)

    def __post_init__(self):
        self.graph = Graph(self.view)
        self.facts = fact_names(self.view)
        self.metrics = {key(m.name): m for m in self.view.metrics}
        self.expanded: dict[str, str] = {}

    # names

    def table_of(self, m: Member) -> str:
        return key(m.table) if m.table else self.graph.root

    def _wildcards(self, asked: tuple[str, ...], items: tuple[Member, ...], what: str) -> list[str]:
        out: list[str] = []
        for name in asked:
            if name.strip() == "*":
                raise errors.ParseError(f"a bare * is no {what}; write table.*")
            if name.strip().endswith(".*"):
                alias = key(name.strip()[:-2])
                if alias not in self.graph.aliases:
                    raise errors.ParseError(f"{name}: no table {alias}")
                out += [f"{alias}.{bare(m.name)}" if m.table else m.name for m in items if not m.private and (self.table_of(m) == alias if m.table or alias == self.graph.root else False)]
            else:
                out.append(name)
        if any(n.strip().endswith(".*") for n in asked):
            out = list({last(n): n for n in reversed(out)}.values())[::-1]
        return out

    def find(self, name: str, items: tuple[Member, ...]) -> Member | None:
        want = key(name)
        for m in items:
            if key(m.name) == want or f"{key(m.table or self.view.base)}.{key(m.name)}" == want:
                return m
        return None

    def _resolve(self, asked: list[str], items: tuple[Member, ...], missing: type, what: str) -> list[Member]:
        out: list[Member] = []
        for name in asked:
            m = self.find(name, items)
            if m is None:
                near = min(items, key=lambda x: _distance(key(x.name), key(name)), default=None)
                hint = f"; did you mean {near.name}?" if near and _distance(key(near.name), key(name)) <= 3 else ""
                raise missing(f"view '{self.view.name}' has no {what} '{name}'{hint}")
            if m in out:
                raise errors.DuplicateMember(f"{what} '{name}' is asked for twice")
            if m.private:
                raise errors.PrivateMember(f"{what} '{name}' is private")
            out.append(m)
        return out

    def _dimension(self, name: str) -> Member | None:
        return self.find(name, self.view.dimensions) or self.find(last(name), self.view.dimensions)

    # expressions

    def inline(self, expr: str, own: Member | None = None) -> str:
        """Facts replaced by their expressions, in parentheses."""

        def by(ref: str) -> str | None:
            f = self.facts.get(key(ref))
            if f is None or f is own:
                return None
            return f"({self.inline(f.expr, f)})"

        return text.replace(expr, by)

    def tables_in(self, expr: str, own: Member | None = None) -> set[str]:
        """Tables that an expression reads: those it qualifies and those of its facts."""
        out = {head for x in text.references(expr) if len(parts(x)) > 1 and (head := key(x).split(".")[0]) in self.graph.aliases}
        for f in facts_in(expr, self.facts):
            if f is not own:
                out |= {self.table_of(f)} | self.tables_in(f.expr, f)
        return out

    def member_tables(self, m: Member) -> set[str]:
        return {self.table_of(m)} | self.tables_in(m.expr, m)

    def base_metrics(self, m: Metric) -> list[Metric]:
        """The metrics of tables that a metric is made of, in declared order."""
        if m.window:
            return self.base_metrics(self.metrics[last(m.window.metric)])
        if not m.derived:
            return [m]
        found = {key(b.name) for x in text.references(m.expr) for b in self.base_metrics(self.metrics[last(x)])}
        return [b for b in self.view.metrics if key(b.name) in found]

    def composed(self, m: Metric) -> str:
        """A derived metric over base metric columns."""
        return text.replace(m.expr, lambda x: f"({self.composed(n)})" if (n := self.metrics[last(x)]).derived else f"`{_column(n)}`") if m.derived else f"`{_column(m)}`"

    # where

    def _where(self, clause: str | None) -> tuple[str | None, list[Member]]:
        if clause is None or not clause.strip():
            return None, []
        used: list[Member] = []

        def by(ref: str) -> str | None:
            m = self.find(ref, self.view.dimensions) or self.find(ref, self.view.facts)
            if m is None:
                if self.find(ref, self.view.metrics):
                    raise errors.WhereReferencesMetric(f"the filter names the metric '{ref}'")
                return None
            if m.private:
                raise errors.PrivateMember(f"fact '{ref}' is private")
            used.append(m)
            return f"({self.inline(m.expr, m)})"

        return text.replace(text.without_comments(clause), by), used

    # joins

    def _joins(self, root: str, tables: set[str], roles: dict[str, str]) -> tuple[Join, ...]:
        """LEFT JOINs from root to every table needed, on the way included; role-played tables under an alias of their role."""
        order, pairs = [root], []
        for t in sorted(tables, key=lambda t: list(self.graph.aliases).index(t)):
            path = self.graph.path(root, t) or []
            for a, b in zip(path, path[1:], strict=False):
                if b not in order:
                    order.append(b)
                    pairs.append((a, b))
        out = []
        for a, b in pairs:
            forward = self.graph.between(a, b)
            if len(forward) > 1 and b in roles:
                forward = [r for r in forward if key(r.name) == roles[b]]
            backward = self.graph.between(b, a)
            r = (forward or backward)[0]
            alias = f"{b}__{roles[b]}" if b in roles else b
            left = f"{a}__{roles[a]}" if a in roles else a
            mine, theirs = (r.columns, self.graph.references(r)) if forward else (self.graph.references(r), r.columns)
            out.append(Join(alias, self.graph.aliases[b].table, tuple((f"{left}.`{bare(x)}`", f"{alias}.`{bare(y)}`") for x, y in zip(mine, theirs, strict=True))))
        return tuple(out)

    def _roles(self, dims: list[Member], metrics: list[Metric], used: list[Member], facts: list[Member]) -> dict[str, str]:
        """For each role-played table that is needed, the relationship that the metrics name."""
        named = {key(u) for m in metrics for b in self.base_metrics(m) for u in b.using}
        roles = {}
        for t in self.graph.aliases:
            choices = self.graph.role_played(t)
            if choices:
                chosen = [key(r.name) for r in choices if key(r.name) in named]
                if len(chosen) == 1:
                    roles[t] = chosen[0]
                needing = [m for m in (*dims, *used, *facts) if any(t in (self.graph.path(self.graph.root, x) or []) for x in self.member_tables(m))]
                if needing and len(chosen) != 1:
                    raise errors.AmbiguousPath(f"'{needing[0].name}' can be reached by {', '.join(r.name for r in choices)}; ask for one metric USING one of them")
        return roles

    def _rewrite(self, expr: str, roles: dict[str, str]) -> str:
        def by(ref: str) -> str | None:
            names = parts(ref)
            head = key(ref).split(".")[0]
            return f'{head}__{roles[head]}."{names[1]}"' if len(names) > 1 and head in roles else None

        return text.spark_sql(text.replace(expr, by)) if roles else text.spark_sql(expr)

    def present(self, table: str) -> str | None:
        """A test that a joined row of a table is there, by its primary key."""
        pk = self.graph.aliases[table].primary_key
        return f"{table}.`{bare(pk[0])}` IS NOT NULL" if pk else None

    # plans

    def plan(self, request: Request) -> Plan:
        if request.facts and request.metrics:
            raise errors.FactsMetricsExclusion("facts are row-level; ask for them or for metrics")
        if not (request.dimensions or request.metrics or request.facts):
            raise errors.EmptyRequest("ask for dimensions, metrics or facts")
        view = self.view
        dims = self._resolve(self._wildcards(request.dimensions, view.dimensions, "dimension"), view.dimensions, errors.UnknownDimension, "dimension")
        if request.facts:
            return self._row_plan(dims, self._resolve(self._wildcards(request.facts, view.facts, "fact"), view.facts, errors.UnknownFact, "fact"), request.where)
        metrics = self._resolve(self._wildcards(request.metrics, view.metrics, "metric"), view.metrics, errors.UnknownMetric, "metric")
        where, used = self._where(request.where)
        names = [bare(d.name) for d in dims]
        if where is None and (mat := self._materialization(dims, metrics)):
            return Plan(materialized=(mat, tuple([*names, *(bare(m.name) for m in metrics)])))
        windows = [m for m in metrics if m.window]
        if windows and len(windows) < len(metrics):
            raise errors.WindowAggregateMixing("window metrics can't be asked for with aggregate metrics")
        self._window_dimensions(windows, dims)
        asked = {key(d.name) for d in dims}
        bases = list({key(b.name): b for m in metrics for b in self.base_metrics(m)}.values())
        snap = {key(b.name): b for b in bases if b.non_additive and any(last(o.key) not in asked for o in b.non_additive)}
        for m in metrics:
            if key(m.name) not in snap and any(key(b.name) in snap for b in self.base_metrics(m)):
                raise errors.SemiAdditiveDependency(f"metric '{m.name}' is built on a snapshot")
        places = {k: [d for o in b.non_additive if last(o.key) not in asked and (d := self._dimension(o.key))] for k, b in snap.items()}
        extra = [d for ds in places.values() for d in ds]
        self._fan_traps(bases, dims, used)
        for k, ds in places.items():
            self._fan_traps([snap[k]], ds, [])
        roles = self._roles([*dims, *extra], metrics, used, [])
        columns = tuple(Column(bare(d.name), self._rewrite(self.inline(d.expr, d), roles)) for d in dims)
        where = self._rewrite(where, roles) if where else None
        needed = set().union(*(self.member_tables(d) for d in (*dims, *used))) if (dims or used) else set()
        if not metrics:
            return Plan(rows=self._rows(dims, [], where, needed, roles), distinct=True, dimensions=tuple(names), outputs=tuple(Column(n, f"`{n}`") for n in names))
        groups = []
        for anchor, own in self._anchors(bases, dims, used, metrics, snap, roles).items():
            tables = needed | set().union(*(self.member_tables(m) for b in own for m in (b, *places.get(key(b.name), ())))) - {anchor}
            made, shots = [], []
            for b in own:
                expr, t = self.inline(b.expr, b), self.table_of(b)
                if t != anchor:
                    test = self.present(t)
                    if test is None and _counts_rows(expr):
                        raise errors.CountStarRequiresKey(f"metric '{b.name}' counts rows of {t}, which has no primary key")
                    expr = aggregates.guarded(expr, test) if test else expr
                made.append(Column(_column(b), aggregates.to_spark(self._rewrite(expr, roles))))
            sets: dict[tuple, list[str]] = {}
            for b in own:
                if key(b.name) in snap:
                    order = tuple((self._rewrite(self.inline(d.expr, d), roles), o) for o in b.non_additive if (d := self._dimension(o.key)))
                    left_out = {last(o.key) for o in b.non_additive}
                    partition = tuple(c.name for c, d in zip(columns, dims, strict=True) if key(d.name) not in left_out)
                    sets.setdefault((order, partition), []).append(_column(b))
            if sets:
                for b in own:
                    if not _decomposable(b.expr):
                        raise errors.SemiAdditiveUnsupported(f"metric '{b.name}' must be one plain SUM, COUNT, AVG, MIN or MAX next to a snapshot")
                shots = [Snapshot(order, partition, tuple(ms)) for (order, partition), ms in sets.items()]
            groups.append(Group((anchor, self.graph.aliases[anchor].table), self._joins(anchor, tables, roles), where, columns, tuple(made), tuple(shots)))
        if windows:
            inner = {key(self.metrics[last(m.window.metric)].name) for m in windows}
            outputs = tuple(Column(f"in_{k}", self.composed(self.metrics[k])) for k in sorted(inner))
            return Plan(tuple(groups), tuple(names), outputs, tuple((bare(m.name), self._spec(m.window, dims)) for m in windows))
        return Plan(tuple(groups), tuple(names), tuple(Column(bare(m.name), text.spark_sql(self.composed(m))) for m in metrics))

    def _spec(self, spec: WindowSpec, dims: list[Member]) -> WindowSpec:
        plain = lambda n: bare(self.find(n, self.view.dimensions).name)
        left = {key(plain(d)) for d in spec.excluding or ()}
        partition = tuple(plain(d) for d in spec.partition) if spec.partition is not None else tuple(bare(d.name) for d in dims if key(d.name) not in left) if spec.excluding is not None else ()
        return replace(spec, metric="in_" + key(self.metrics[last(spec.metric)].name), partition=partition, order=tuple(replace(o, key=plain(o.key)) for o in spec.order))

    def _window_dimensions(self, windows: list[Metric], dims: list[Member]) -> None:
        asked = {key(d.name) for d in dims}
        for m in windows:
            w = m.window
            for d in (*(w.excluding or ()), *(w.partition or ()), *(o.key for o in w.order)):
                if last(d) not in asked:
                    raise errors.WindowRequiredDimension(f"window metric '{m.name}' needs dimension '{d}'")

    def _materialization(self, dims: list[Member], metrics: list[Metric]) -> Materialization | None:
        if any(m.window or any(b.non_additive for b in self.base_metrics(m)) for m in metrics):
            return None
        want = {key(d.name) for d in dims}, {key(m.name) for m in metrics}
        ends = lambda names: {last(n) for n in names}
        return next((m for m in self.view.materializations if (ends(m.dimensions), ends(m.metrics)) == want), None)

    def _fenced(self, m: Member) -> set[str]:
        """The tables that a member brings into a grain; one without a table means whatever the base has of that name."""
        return self.member_tables(m) if m.table else self.tables_in(m.expr, m)

    def _fan_traps(self, bases: list[Metric], dims: list[Member], used: list[Member]) -> None:
        for b in bases:
            grain = self.table_of(b)
            for d in dims:
                for t in self._fenced(d):
                    if self.graph.fans(grain, t):
                        kind = errors.FanTrap if t == self.table_of(d) else errors.FactFanTrap
                        raise kind(f"metric '{b.name}' of {grain} would be inflated by dimension '{d.name}' of {t}")
            for w in used:
                for t in self._fenced(w):
                    if self.graph.fans(grain, t):
                        raise errors.WhereFanTrap(f"metric '{b.name}' of {grain} would be inflated by filter member '{w.name}' of {t}")
            for t in self.tables_in(b.expr, b):
                if self.graph.fans(grain, t):
                    raise errors.FactFanTrap(f"metric '{b.name}' of {grain} reads {t}, which fans")

    def _anchors(self, bases: list[Metric], dims: list[Member], used: list[Member], metrics: list[Metric], snap: dict[str, Metric], roles: dict[str, str]) -> dict[str, list[Metric]]:
        """Metrics by the table that their query starts from: the base, unless some grain would be inflated by it or by another."""
        root = self.graph.root
        grains = {self.table_of(b) for b in bases}
        above = [b for b in bases if self.table_of(b) != root and self._above(self.table_of(b))]
        crossed = next(((a, b) for a, b in combinations(sorted(grains), 2) if self.graph.fans(a, b) or self.graph.fans(b, a)), None)
        if not above and crossed is None:
            return {root: bases}
        if why := self._not_apart(dims, used, metrics, bases, snap, roles, len(grains)):
            if above:
                raise errors.RootGrainFanTrap(f"metric '{above[0].name}' of {self.table_of(above[0])} would be repeated for each row of {root}, and can't be asked apart: {why}")
            raise errors.MetricFanTrap(f"metrics of {crossed[0]} and {crossed[1]} would inflate each other, and can't be asked apart: {why}")
        out: dict[str, list[Metric]] = {}
        for b in bases:
            out.setdefault(self.table_of(b), []).append(b)
        return out

    def _not_apart(self, dims: list[Member], used: list[Member], metrics: list[Metric], bases: list[Metric], snap: dict[str, Metric], roles: dict[str, str], grains: int) -> str | None:
        """Why a request can't be split by grain: names that only the base table gives a meaning, or roles that a grain can't keep."""
        for what, members in (("dimension", dims), ("filter member", used)):
            for m in members:
                if m.table is None:
                    return f"{what} '{m.name}' names no table"
        if snap and roles and any(t in roles for d in dims for t in self.member_tables(d)):
            return "a snapshot keeps no role of a table"
        if grains > 1 and any(m.window for m in metrics):
            return f"window metric '{next(m.name for m in metrics if m.window)}' has one grain"
        threaded = {r for r in roles.values()}
        for b in bases:
            for u in b.using:
                if key(u) not in threaded:
                    return f"'{b.name}' uses {u}, which leads to a table that plays no role here"
        return None

    def _above(self, table: str) -> bool:
        """Rows of the table are repeated by a query that starts from the base."""
        return self.graph.fans(table, self.graph.root)

    # row-level requests

    def _row_plan(self, dims: list[Member], facts: list[Member], clause: str | None) -> Plan:
        where, used = self._where(clause)
        members = [*dims, *facts, *used]
        tables = sorted(set().union(*(self.member_tables(m) for m in members)))
        for a, b in combinations(tables, 2):
            if self.graph.fans(a, b) and self.graph.fans(b, a):
                raise errors.FactPathViolation(f"tables {a} and {b} share no row: each fans from the other")
        roles = self._roles(dims, [], used, facts)
        group = self._rows(dims, facts, self._rewrite(where, roles) if where else None, set(tables), roles)
        names = [*(bare(d.name) for d in dims), *(bare(f.name) for f in facts)]
        return Plan(rows=group, dimensions=tuple(bare(d.name) for d in dims), outputs=tuple(Column(n, f"`{n}`") for n in names))

    def _rows(self, dims: list[Member], facts: list[Member], where: str | None, tables: set[str], roles: dict[str, str]) -> Group:
        root = self.graph.root
        own = {self.table_of(m) for m in (*dims, *facts)}
        if len(own) == 1 and (t := next(iter(own))) != root and self.graph.fans(root, t) and (test := self.present(t)):
            where = f"({where}) AND ({test})" if where else test
        cols = lambda ms: tuple(Column(bare(m.name), self._rewrite(self.inline(m.expr, m), roles)) for m in ms)
        return Group((root, self.graph.aliases[root].table), self._joins(root, tables, roles), where, cols(dims), cols(facts))


def _column(m: Metric) -> str:
    return f"m_{key(m.name)}"


def _counts_rows(expr: str) -> bool:
    return any(name.lower() in aggregates.NAMES and not text.references(expr[a:b]) for name, a, b in text.calls(expr))


def _decomposable(expr: str) -> bool:
    found = list(text.calls(expr.strip()))
    if not found:
        return False
    name, a, b = found[0]
    whole = expr.strip()
    return name.lower() in ("sum", "count", "avg", "min", "max") and whole.lower().startswith(name.lower()) and b == len(whole) - 1 and whole[a:b].strip() != "*" and not whole[a:b].strip().lower().startswith("distinct")


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
