"""What a semantic view is: tables, relationships, row-level facts, dimensions, metrics, materializations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Table:
    alias: str
    table: str
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    comment: str | None = None
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relationship:
    """Rows of ``source`` point to at most one row of ``target``."""

    name: str | None
    source: str
    columns: tuple[str, ...]
    target: str
    references: tuple[str, ...] = ()


@dataclass(frozen=True)
class Member:
    name: str
    expr: str
    table: str | None = None
    comment: str | None = None
    synonyms: tuple[str, ...] = ()
    is_filter: bool = False
    private: bool = False


@dataclass(frozen=True)
class Order:
    key: str
    descending: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class WindowSpec:
    """FUNC(metric, extra...) OVER (...): partition by ``partition``, or by all asked dimensions but ``excluding``."""

    function: str
    metric: str
    extra: tuple[str, ...] = ()
    partition: tuple[str, ...] | None = None
    excluding: tuple[str, ...] | None = None
    order: tuple[Order, ...] = ()
    frame: str | None = None


@dataclass(frozen=True)
class Metric(Member):
    using: tuple[str, ...] = ()
    non_additive: tuple[Order, ...] = ()
    window: WindowSpec | None = None

    @property
    def derived(self) -> bool:
        return self.table is None and self.window is None


@dataclass(frozen=True)
class Materialization:
    name: str
    table: str
    dimensions: tuple[str, ...]
    metrics: tuple[str, ...]


@dataclass(frozen=True)
class Definition:
    """A view; the first table is its base."""

    name: str
    tables: tuple[Table, ...]
    relationships: tuple[Relationship, ...] = ()
    facts: tuple[Member, ...] = ()
    dimensions: tuple[Member, ...] = ()
    metrics: tuple[Metric, ...] = ()
    materializations: tuple[Materialization, ...] = ()
    comment: str | None = None
    schema: str = "main"
    database: str = "spark_catalog"
    created_on: str = field(default="", compare=False)

    @property
    def base(self) -> str:
        return self.tables[0].alias

    def table(self, alias: str) -> Table:
        return next(t for t in self.tables if key(t.alias) == key(alias))


def parts(name: str) -> list[str]:
    """The parts of a dotted name, without their quotes; a dot inside quotes separates nothing."""
    return [p[1:-1].replace('""', '"') if p[:1] in ('"', "`") else p.strip() for p in re.findall(r'"(?:[^"]|"")*"|`[^`]*`|[^."`]+', name.strip())]


def key(name: str) -> str:
    """Names match whatever their case and quotes; a dot inside a part is none between parts."""
    return ".".join(p.lower().replace(".", "\0") for p in parts(name))


def last(name: str) -> str:
    """The key of a name's last part."""
    return key(name).rpartition(".")[2]


def bare(name: str) -> str:
    """A name without its quotes, as output columns have it."""
    found = parts(name)
    return found[0] if len(found) == 1 else name.strip().strip('"`')
