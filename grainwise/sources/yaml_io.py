"""Definitions as YAML, read and written."""

from __future__ import annotations

from ..errors import ParseError
from ..model import Definition, Materialization, Member, Metric, Relationship, Table, key
from . import ddl

#: The largest text that is read.
LIMIT = 1 << 20
_MEMBER = {"name", "expr", "table", "comment", "synonyms", "labels", "access"}
_METRIC = _MEMBER | {"using", "non_additive_by"}


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise ParseError("YAML definitions need PyYAML") from e
    return yaml


def _only(item: dict, allowed: set[str], what: str) -> dict:
    if not isinstance(item, dict):
        raise ParseError(f"a {what} is a mapping, not {item!r}")
    if extra := set(item) - allowed:
        raise ParseError(f"{what} has the unknown field {sorted(extra)[0]}")
    return item


def _identifier(value: object, what: str) -> str:
    s = str(value or "").strip()
    if not s or "--" in s or "/*" in s or (" " in s and not s.startswith('"')) or "." in s.strip('"'):
        raise ParseError(f"{what} must be one identifier, not {value!r}")
    return s


def _expr(item: dict, what: str) -> str:
    e = str(item.get("expr") or "").strip()
    if not e:
        raise ParseError(f"{what} {item.get('name')} has no expression")
    return e


def load(name: str, source: str, schema: str = "main") -> Definition:
    if len(source.encode()) > LIMIT:
        raise ParseError(f"a YAML definition has at most {LIMIT} bytes")
    yaml = _yaml()
    try:
        doc = yaml.safe_load(source)
    except yaml.YAMLError as e:
        raise ParseError(f"no YAML: {e}") from None
    doc = _only(doc, {"tables", "relationships", "facts", "dimensions", "metrics", "materializations", "comment", "name"}, "definition")

    def member(item: dict, what: str) -> Member:
        item = _only(item, _MEMBER, what)
        if not item.get("table"):
            raise ParseError(f"{what} {item.get('name')} needs a table")
        return Member(_identifier(item["name"], what), _expr(item, what), item["table"], item.get("comment"), tuple(item.get("synonyms") or ()), "filter" in [str(x).lower() for x in item.get("labels") or ()], item.get("access", "public") == "private")

    def metric(item: dict) -> Metric:
        item = _only(item, _METRIC, "metric")
        expr, table = _expr(item, "metric"), item.get("table")
        if not table and (item.get("using") or item.get("non_additive_by")):
            raise ParseError(f"metric {item['name']} without a table can't have using or non_additive_by")
        na = tuple(o for x in item.get("non_additive_by") or () for o in ddl.orders(x))
        return Metric(_identifier(item["name"], "metric"), expr, table, item.get("comment"), tuple(item.get("synonyms") or ()), False, item.get("access", "public") == "private", tuple(item.get("using") or ()), na, ddl.window_spec(expr))

    def table(item: dict) -> Table:
        item = _only(item, {"alias", "table", "primary_key", "unique", "comment", "synonyms"}, "table")
        return Table(_identifier(item.get("alias") or str(item["table"]).split(".")[-1], "alias"), item["table"], tuple(item.get("primary_key") or ()), tuple(tuple(u) for u in item.get("unique") or ()), item.get("comment"), tuple(item.get("synonyms") or ()))

    def relationship(item: dict) -> Relationship:
        item = _only(item, {"name", "from", "columns", "to", "references"}, "relationship")
        return Relationship(item.get("name"), item["from"], tuple(item["columns"]), item["to"], tuple(item.get("references") or ()))

    def materialization(item: dict) -> Materialization:
        item = _only(item, {"name", "table", "dimensions", "metrics"}, "materialization")
        return Materialization(item["name"], item["table"], tuple(item.get("dimensions") or ()), tuple(item.get("metrics") or ()))

    try:
        return Definition(
            key(name), tuple(map(table, doc.get("tables") or ())), tuple(map(relationship, doc.get("relationships") or ())),
            tuple(member(x, "fact") for x in doc.get("facts") or ()), tuple(member(x, "dimension") for x in doc.get("dimensions") or ()),
            tuple(map(metric, doc.get("metrics") or ())), tuple(map(materialization, doc.get("materializations") or ())), doc.get("comment"), schema,
        )
    except KeyError as e:
        raise ParseError(f"a field is missing: {e.args[0]}") from None


def dump(view: Definition) -> str:
    def filled(d: dict) -> dict:
        return {k: v for k, v in d.items() if v not in (None, [], (), "", False)}

    def member(m: Member) -> dict:
        return filled({"name": m.name, "table": m.table, "expr": m.expr, "comment": m.comment, "synonyms": list(m.synonyms), "labels": ["filter"] if m.is_filter else [], "access": "private" if m.private else None})

    doc = {
        "tables": [filled({"alias": t.alias, "table": t.table, "primary_key": list(t.primary_key), "unique": [list(u) for u in t.unique], "comment": t.comment, "synonyms": list(t.synonyms)}) for t in view.tables],
        "relationships": [filled({"name": r.name, "from": r.source, "columns": list(r.columns), "to": r.target, "references": list(r.references)}) for r in view.relationships],
        "facts": [member(m) for m in view.facts],
        "dimensions": [member(m) for m in view.dimensions],
        "metrics": [member(m) | filled({"using": list(m.using), "non_additive_by": [ddl.order_text(o) for o in m.non_additive]}) for m in view.metrics],
        "materializations": [filled({"name": m.name, "table": m.table, "dimensions": list(m.dimensions), "metrics": list(m.metrics)}) for m in view.materializations],
        "comment": view.comment,
    }
    return _yaml().safe_dump(filled(doc), sort_keys=False, allow_unicode=True)
