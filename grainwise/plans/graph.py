"""The relationship graph of a view: paths, directions in which rows multiply, and definition checks."""

from __future__ import annotations

from collections import defaultdict, deque
from graphlib import CycleError as _Cycle
from graphlib import TopologicalSorter

from .. import errors
from ..functions import aggregates
from ..model import Definition, Relationship, key, last
from . import text


class Graph:
    """Tables as nodes, relationships as edges from the many to the one side."""

    def __init__(self, view: Definition):
        self.view, self.aliases = view, {key(t.alias): t for t in view.tables}
        self.edges = list(view.relationships)
        self.near: dict[str, list[str]] = defaultdict(list)
        for r in self.edges:
            a, b = key(r.source), key(r.target)
            self.near[a].append(b)
            self.near[b].append(a)
        self.root = key(view.base)

    def between(self, a: str, b: str) -> list[Relationship]:
        """Relationships from a to b."""
        return [r for r in self.edges if (key(r.source), key(r.target)) == (a, b)]

    def references(self, r: Relationship) -> tuple[str, ...]:
        return r.references or self.aliases[key(r.target)].primary_key

    def one_to_one(self, r: Relationship) -> bool:
        """The pointing columns are themselves a key, so no two rows point to one row."""
        t = self.aliases[key(r.source)]
        own = {key(c) for c in r.columns}
        return any(k and {key(c) for c in k} == own for k in (t.primary_key, *t.unique))

    def path(self, a: str, b: str) -> list[str] | None:
        """The tables from a to b, both included, by the fewest relationships in declared order."""
        before: dict[str, str | None] = {a: None}
        queue = deque([a])
        while queue:
            x = queue.popleft()
            if x == b:
                out = [x]
                while (x := before[x]) is not None:
                    out.append(x)
                return out[::-1]
            for y in self.near[x]:
                if y not in before:
                    before[y] = x
                    queue.append(y)
        return None

    def step_fans(self, a: str, b: str) -> bool:
        """Whether a row of a may meet several rows of b."""
        if self.between(a, b):
            return False
        return not all(self.one_to_one(r) for r in self.between(b, a))

    def fans(self, a: str, b: str) -> bool:
        """Whether a row of a may meet several rows of b along the path; unconnected tables count as fanning."""
        path = self.path(a, b)
        return path is None or any(self.step_fans(x, y) for x, y in zip(path, path[1:], strict=False))

    def role_played(self, table: str) -> list[Relationship]:
        """The named relationships by which one source plays several roles with this table."""
        by = defaultdict(list)
        for r in self.edges:
            if key(r.target) == table:
                by[key(r.source)].append(r)
        return next((rs for rs in by.values() if len(rs) > 1), [])


def ordered(needs: dict[str, list[str]], what: str) -> list[str]:
    """Names so that each follows what it needs."""
    try:
        return list(TopologicalSorter(needs).static_order())
    except _Cycle as e:
        raise errors.CycleError(f"{what} form a cycle: {' -> '.join(map(str, e.args[1]))}") from None


#: Definitions that are built on each other, at most.
DEPTH = 64


def _nested(needs: dict[str, list[str]], what: str, bad) -> None:
    """Refuses cycles, and chains of more than DEPTH."""
    depth: dict[str, int] = {}
    for name in ordered(needs, what):
        depth[name] = 1 + max((depth.get(n, 0) for n in needs.get(name, ()) if n in needs), default=0) if name in needs else 0
    deepest = max(depth.values(), default=0)
    if deepest > DEPTH:
        raise bad(f"{what} are nested {deepest} deep; at most {DEPTH} are")


def validate(view: Definition) -> None:
    """Refuses a definition that contradicts itself; physical tables are not looked at."""
    bad = lambda m: errors.DefinitionError(f"view '{view.name}': {m}")
    if not view.tables:
        raise bad("it has no tables")
    aliases = [key(t.alias) for t in view.tables]
    if len(set(aliases)) < len(aliases):
        raise bad("two tables share an alias")
    names = [key(m.name) for m in (*view.dimensions, *view.metrics, *view.facts)]
    if again := {n for n in names if names.count(n) > 1}:
        raise bad(f"the name {sorted(again)[0]} is given twice")
    graph = Graph(view)
    seen = set()
    for r in view.relationships:
        for a in (r.source, r.target):
            if key(a) not in graph.aliases:
                raise bad(f"relationship {r.name or ''} names the unknown table {a}")
        if key(r.source) == key(r.target):
            raise bad(f"relationship {r.name or ''} points from {r.source} to itself")
        if r.name and key(r.name) in seen:
            raise bad(f"two relationships are named {r.name}")
        seen.add(key(r.name or ""))
        target = graph.aliases[key(r.target)]
        if not target.primary_key and not target.unique:
            raise bad(f"table {r.target} needs a PRIMARY KEY or UNIQUE, as {r.source} refers to it")
        refs = {key(c) for c in graph.references(r)}
        if not any({key(c) for c in k} == refs for k in (target.primary_key, *target.unique) if k):
            raise bad(f"columns {', '.join(graph.references(r))} are no key of {r.target}")
        if len(r.columns) != len(graph.references(r)):
            raise bad(f"relationship {r.name or ''} has {len(r.columns)} columns for {len(graph.references(r))}")
    ordered({a: [key(r.target) for r in view.relationships if key(r.source) == a] for a in aliases}, "relationships")
    for a in aliases:
        if a == graph.root:
            continue
        inbound = [r for r in view.relationships if key(r.target) == a]
        if len({key(r.source) for r in inbound}) > 1:
            raise bad(f"table {a} is reached from several tables; declare it again under another alias")
        if len(inbound) > 1 and (any(not r.name for r in inbound) or len({key(r.name) for r in inbound}) < len(inbound)):
            raise bad(f"relationships to {a} that play several roles need different names")
        if graph.path(graph.root, a) is None:
            raise bad(f"table {a} is not connected to {view.base}")
    members = (*view.dimensions, *view.facts, *view.metrics)
    for m in members:
        if m.table and key(m.table) not in graph.aliases:
            raise bad(f"{m.name} names the unknown table {m.table}")
        if not m.expr.strip():
            raise bad(f"{m.name} has no expression")
        if missing := aggregates.unsupported(m.expr):
            raise bad(f"{m.name}: Spark has no aggregate {missing}")
    facts = fact_names(view)
    for f in view.facts:
        if aggregates.has_aggregate(f.expr):
            raise bad(f"fact {f.name} aggregates; facts are row-level")
    _nested({key(f.name): [key(g.name) for g in facts_in(f.expr, facts) if g is not f] for f in view.facts}, "facts", bad)
    metrics = {key(m.name): m for m in view.metrics}
    relationship_names = {key(r.name): r for r in view.relationships if r.name}
    dims = {key(d.name) for d in view.dimensions}
    for m in view.metrics:
        for u in m.using:
            if key(u) not in relationship_names:
                raise bad(f"metric {m.name} uses the unknown relationship {u}")
        for o in m.non_additive:
            if last(o.key) not in dims:
                raise bad(f"metric {m.name} is non-additive by the unknown dimension {o.key}")
        if m.derived:
            if aggregates.has_aggregate(m.expr):
                raise bad(f"derived metric {m.name} aggregates; only metrics of a table do")
            unknown = [x for x in text.references(m.expr) if key(x) not in metrics and last(x) not in metrics]
            if unknown:
                raise bad(f"derived metric {m.name} names the unknown metric {unknown[0]}")
            for x in text.references(m.expr):
                if metrics[last(x)].window:
                    raise bad(f"derived metric {m.name} is built on the window metric {x}")
        elif m.window:
            inner = metrics.get(last(m.window.metric))
            if inner is None or inner.window:
                raise bad(f"window metric {m.name} needs a metric without window, not {m.window.metric}")
            if m.non_additive:
                raise bad(f"window metric {m.name} can't be non-additive")
            for d in (*(m.window.partition or ()), *(m.window.excluding or ()), *(o.key for o in m.window.order)):
                if last(d) not in dims:
                    raise bad(f"window metric {m.name} names the unknown dimension {d}")
        elif not aggregates.has_aggregate(m.expr):
            raise bad(f"metric {m.name} does not aggregate")
    _nested({key(m.name): [last(x) for x in text.references(m.expr)] for m in view.metrics if m.derived}, "derived metrics", bad)
    own = {(key(m.table or view.base), key(m.name)) for m in members}
    for m in members:
        for x in text.references(m.expr):
            names = key(x).split(".")
            if len(names) == 2 and names[0] in graph.aliases and m.table and names[0] != key(m.table) and (names[0], names[1]) not in own:
                raise bad(f"{m.name} of {m.table} reads column {x} of another table; declare a fact there")
    for mat in view.materializations:
        for d in mat.dimensions:
            if last(d) not in dims:
                raise bad(f"materialization {mat.name} names the unknown dimension {d}")
        for d in mat.metrics:
            if last(d) not in metrics:
                raise bad(f"materialization {mat.name} names the unknown metric {d}")


def fact_names(view: Definition) -> dict[str, object]:
    """Facts by bare name and by table.name."""
    out = {}
    for f in view.facts:
        out[key(f.name)] = f
        out[f"{key(f.table or view.base)}.{key(f.name)}"] = f
    return out


def facts_in(expr: str, facts: dict) -> list:
    return list({id(f): f for x in text.references(expr) if (f := facts.get(key(x))) is not None}.values())
