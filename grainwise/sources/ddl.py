"""The SQL-like definition language: CREATE SEMANTIC VIEW bodies, and definitions written back as such."""

from __future__ import annotations

import re

from ..errors import DefinitionError, ParseError, SemanticError
from ..model import Definition, Materialization, Member, Metric, Order, Relationship, Table, WindowSpec, bare, key, parts
from ..plans import text

CLAUSES = ("TABLES", "RELATIONSHIPS", "FACTS", "DIMENSIONS", "METRICS", "MATERIALIZATIONS")
_ID = r'(?:"(?:[^"]|"")*"|`[^`]*`|[^\W\d]\w*)'
_NAME = rf"{_ID}(?:\s*\.\s*{_ID})*"


def _inside(body: str, at: int) -> int:
    """The place after the parenthesis that closes the one at ``at``."""
    depth = 0
    for kind, t, m in text.tokens(body[at:]):
        whole = m.group(0)
        if kind in ("other", "chain"):
            depth += whole.count("(") - whole.count(")")
            if depth == 0 and t == ")":
                return at + m.end()
    raise ParseError("a parenthesis is not closed")


def stored(name: str) -> str:
    """A name as definitions keep it: without quotes, unless a dot inside it needs them."""
    plain = bare(name)
    return '"' + plain.replace('"', '""') + '"' if "." in plain else plain


def _names(inner: str) -> tuple[str, ...]:
    out = tuple(stored(x) if len(parts(x)) == 1 else x.strip() for x in text.split(inner))
    if any(not x for x in out):
        raise ParseError("an empty name in a list")
    return out


def string(literal: str) -> str:
    return text.string_value(literal)


def annotations(entry: str) -> tuple[str, dict]:
    """Cuts COMMENT, WITH SYNONYMS and LABELS off the end of an entry, in any order."""
    got: dict = {}
    patterns = {
        "comment": r"\bCOMMENT\s*=\s*('(?:[^']|'')*')\s*$",
        "synonyms": r"\bWITH\s+SYNONYMS\s*=?\s*\(((?:\s*'(?:[^']|'')*'\s*,?)*)\)\s*$",
        "labels": r"\bLABELS\s*=\s*\(\s*([\w\s,]*)\)\s*$",
    }
    while True:
        for name, pattern in patterns.items():
            m = re.search(pattern, entry, re.I)
            if m:
                if name in got:
                    raise ParseError(f"{name.upper()} is given twice")
                got[name] = m.group(1)
                entry = entry[: m.start()].rstrip()
                break
        else:
            out: dict = {"comment": string(got["comment"]) if "comment" in got else None}
            out["synonyms"] = tuple(string(s) for s in text.split(got["synonyms"])) if got.get("synonyms", "").strip() else ()
            labels = [x.strip().lower() for x in got.get("labels", "").split(",") if x.strip()]
            if any(x != "filter" for x in labels) or "labels" in got and not labels:
                raise ParseError(f"LABELS = ({got['labels']}): the one label is FILTER")
            out["is_filter"] = bool(labels)
            return entry, out


def orders(inner: str) -> tuple[Order, ...]:
    out = []
    for item in text.split(inner):
        m = re.fullmatch(rf"\s*({_NAME})(?:\s+(ASC|DESC))?(?:\s+NULLS\s+(FIRST|LAST))?\s*", item, re.I)
        if not m:
            raise ParseError(f"'{item}' is no ordering")
        down = (m.group(2) or "").lower() == "desc"
        out.append(Order(m.group(1), down, m.group(3).lower() == "first" if m.group(3) else down))
    return tuple(out)


def _table(entry: str) -> Table:
    entry, notes = annotations(entry)
    m = re.match(rf"\s*(?:({_ID})\s+AS\s+)?({_NAME})", entry, re.I)
    if not m:
        raise ParseError(f"'{entry}' is no table")
    rest, pk, unique = entry[m.end() :], (), []
    while rest.strip():
        k = re.match(r"\s*(PRIMARY\s+KEY|UNIQUE)\s*\(", rest, re.I)
        if not k:
            raise ParseError(f"'{rest.strip()}' after table {m.group(2)}")
        end = _inside(rest, k.end() - 1)
        names = _names(rest[k.end() : end - 1])
        if k.group(1).lower() == "unique":
            unique.append(names)
        elif pk:
            raise ParseError(f"two primary keys for {m.group(2)}")
        else:
            pk = names
        rest = rest[end:]
    return Table(stored(m.group(1) or parts(m.group(2))[-1]), ".".join(p if re.fullmatch(r"\w+", p) else f"`{p}`" for p in parts(m.group(2))), pk, tuple(unique), notes["comment"], notes["synonyms"])


def _relationship(entry: str) -> Relationship:
    m = re.fullmatch(rf"\s*(?:({_ID})\s+AS\s+)?({_ID})\s*\(([^()]*)\)\s*REFERENCES\s+({_ID})\s*(?:\(([^()]*)\))?\s*", entry, re.I)
    if not m:
        raise ParseError(f"'{entry}' is no relationship")
    return Relationship(bare(m.group(1)) if m.group(1) else None, bare(m.group(2)), _names(m.group(3)), bare(m.group(4)), _names(m.group(5)) if m.group(5) else ())


def _head(name: str) -> tuple[str | None, str]:
    found = [f'"{p}"' if "." in p else p for p in parts(name)]
    if len(found) > 2:
        raise ParseError(f"'{name}' has more than two parts")
    return (found[0], found[1]) if len(found) == 2 else (None, found[0])


def _member(entry: str, dimension: bool) -> Member:
    entry, notes = annotations(entry)
    m = re.match(rf"\s*(?:(PRIVATE|PUBLIC)\s+)?({_NAME})\s+AS\s+(?=\S)", entry, re.I | re.S)
    if not m:
        raise ParseError(f"'{entry}' is no member: table.name AS expression")
    private = (m.group(1) or "").lower() == "private"
    if private and dimension:
        raise ParseError(f"dimension {m.group(2)} can't be private")
    table, name = _head(m.group(2))
    return Member(name, entry[m.end() :].strip(), table, notes["comment"], notes["synonyms"], notes["is_filter"], private)


def window_spec(expr: str) -> WindowSpec | None:
    """FUNC(metric, extra...) OVER (...), or None if there is no OVER."""
    over = next((m.start() for k, t, m in text.tokens(expr) if k == "chain" and t.lower() == "over"), None)
    if over is None:
        return None
    head = re.fullmatch(rf"\s*({_NAME})\s*\((.*)\)\s*", expr[:over], re.S)
    tail = re.fullmatch(r"OVER\s*\((.*)\)\s*", expr[over:], re.I | re.S)
    if not head or not tail:
        raise ParseError(f"a window metric is FUNCTION(metric) OVER (...), not '{expr}'")
    args = text.split(head.group(2))
    inner, partition, excluding, order, frame = tail.group(1), None, None, (), None
    m = re.search(r"\b(ROWS|RANGE|GROUPS)\b.*$", inner, re.I | re.S)
    if m:
        frame, inner = m.group(0).strip(), inner[: m.start()]
    m = re.search(r"\bORDER\s+BY\b(.*)$", inner, re.I | re.S)
    if m:
        order, inner = orders(m.group(1)), inner[: m.start()]
    m = re.fullmatch(r"\s*PARTITION\s+BY\s+(EXCLUDING\s+)?(.*?)\s*", inner, re.I | re.S)
    if m:
        names = tuple(bare(x) for x in text.split(m.group(2)))
        partition, excluding = (None, names) if m.group(1) else (names, None)
    elif inner.strip():
        raise ParseError(f"'{inner.strip()}' in OVER")
    return WindowSpec(head.group(1), args[0], tuple(args[1:]), partition, excluding, order, frame)


def _metric(entry: str) -> Metric:
    entry, notes = annotations(entry)
    m = re.match(rf"\s*(?:(PRIVATE|PUBLIC)\s+)?({_NAME})\s*", entry, re.I)
    if not m:
        raise ParseError(f"'{entry}' is no metric")
    private, (table, name), rest, using, non_additive = (m.group(1) or "").lower() == "private", _head(m.group(2)), entry[m.end() :], (), ()
    while k := re.match(r"\s*(USING|NON\s+ADDITIVE\s+BY)\s*\(", rest, re.I):
        end = _inside(rest, k.end() - 1)
        if k.group(1).lower() == "using":
            using = _names(rest[k.end() : end - 1])
        else:
            non_additive = orders(rest[k.end() : end - 1])
        rest = rest[end:]
    m = re.match(r"\s*AS\s+(?=\S)", rest, re.I)
    if not m:
        raise ParseError(f"metric {name} needs AS expression")
    expr = rest[m.end() :].strip()
    if re.search(r"\bUSING\s*\(|\bNON\s+ADDITIVE\s+BY\b", "".join(t if k != "string" else " " for k, t, _ in text.tokens(expr)), re.I):
        raise ParseError(f"USING and NON ADDITIVE BY of metric {name} stand before AS")
    if table is None and (using or non_additive):
        raise ParseError(f"metric {name} without a table can't have USING or NON ADDITIVE BY")
    return Metric(name, expr, table, notes["comment"], notes["synonyms"], notes["is_filter"], private, using, non_additive, window_spec(expr))


def _materialization(entry: str) -> Materialization:
    m = re.fullmatch(rf"\s*({_ID})\s+AS\s*\((.*)\)\s*", entry, re.I | re.S)
    got: dict[str, object] = {"dimensions": (), "metrics": ()}
    for part in text.split(m.group(2)) if m else []:
        t = re.fullmatch(rf"TABLE\s+({_NAME})", part, re.I)
        k = re.fullmatch(r"(DIMENSIONS|METRICS)\s*\((.*)\)", part, re.I | re.S)
        if t:
            got["table"] = t.group(1)
        elif k:
            got[k.group(1).lower()] = _names(k.group(2)) if k.group(2).strip() else ()
        else:
            raise ParseError(f"'{part}' in materialization {m.group(1)}")
    if "table" not in got:
        raise ParseError(f"'{entry}' is no materialization: name AS (TABLE t, DIMENSIONS (...), METRICS (...))")
    return Materialization(bare(m.group(1)), got["table"], got["dimensions"], got["metrics"])


def parse_body(name: str, body: str, comment: str | None = None, schema: str = "main") -> Definition:
    """The clauses after AS, in their fixed order."""
    body = text.without_comments(body).strip().rstrip(";").strip()
    clauses: dict[str, list[str]] = {}
    at = 0
    while at < len(body):
        m = re.match(r"\s*([A-Za-z_]+)\s*(\(|=)", body[at:])
        if not m:
            if not body[at:].strip():
                break
            raise ParseError(f"a clause was expected at '{body[at:at + 30].strip()}'")
        word = m.group(1).upper()
        if word == "COMMENT" and m.group(2) == "=":
            s = re.match(r"\s*COMMENT\s*=\s*('(?:[^']|'')*')\s*$", body[at:], re.I)
            if not s:
                raise ParseError("COMMENT = '...' ends a definition")
            if comment is not None:
                raise ParseError("the view's comment is given twice")
            comment = string(s.group(1))
            break
        if word not in CLAUSES or m.group(2) != "(":
            from ..plans.planner import _distance

            near = min(CLAUSES, key=lambda c: _distance(c, word))
            raise ParseError(f"unknown clause {word}" + (f"; did you mean {near}?" if _distance(near, word) <= 3 else ""))
        if word in clauses:
            raise ParseError(f"clause {word} is given twice")
        if clauses and CLAUSES.index(word) < max(CLAUSES.index(p) for p in clauses):
            raise ParseError(f"clause {word} is out of order; the order is {', '.join(CLAUSES)}")
        start = at + m.end()
        end = _inside(body, start - 1)
        inner = body[start : end - 1].strip().rstrip(",")
        clauses[word] = text.split(inner) if inner else []
        at = end
    if "TABLES" not in clauses:
        raise ParseError("a definition starts with TABLES (...)")
    if not clauses.get("DIMENSIONS") and not clauses.get("METRICS"):
        raise ParseError("a definition needs DIMENSIONS or METRICS")
    return Definition(
        key(name), tuple(_table(e) for e in clauses["TABLES"]), tuple(_relationship(e) for e in clauses.get("RELATIONSHIPS", [])),
        tuple(_member(e, False) for e in clauses.get("FACTS", [])), tuple(_member(e, True) for e in clauses.get("DIMENSIONS", [])),
        tuple(_metric(e) for e in clauses.get("METRICS", [])), tuple(_materialization(e) for e in clauses.get("MATERIALIZATIONS", [])), comment, schema,
    )


# writing back


def quoted(name: str) -> str:
    return name if name.startswith(('"', "`")) or re.fullmatch(r"[^\W\d]\w*", name) else '"' + name.replace('"', '""') + '"'


def _notes(m) -> str:
    out = f" COMMENT = {_literal(m.comment)}" if m.comment is not None else ""
    out += f" WITH SYNONYMS = ({', '.join(map(_literal, m.synonyms))})" if m.synonyms else ""
    return out + (" LABELS = (FILTER)" if getattr(m, "is_filter", False) else "")


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def order_text(o: Order) -> str:
    return f"{o.key} {'DESC' if o.descending else 'ASC'} NULLS {'FIRST' if o.nulls_first else 'LAST'}"


def _list(names) -> str:
    return ", ".join(map(quoted, names))


def render(view: Definition, qualified: bool = False) -> str:
    """A CREATE OR REPLACE statement that defines the same view."""
    member = lambda m: f"{'PRIVATE ' if m.private else ''}{quoted(m.table) + '.' if m.table else ''}{quoted(m.name)}"
    tables = [f"{quoted(t.alias)} AS {t.table.replace('`', '"')}" + (f" PRIMARY KEY ({_list(t.primary_key)})" if t.primary_key else "") + "".join(f" UNIQUE ({_list(u)})" for u in t.unique) + _notes(t) for t in view.tables]
    relationships = [(f"{quoted(r.name)} AS " if r.name else "") + f"{quoted(r.source)} ({_list(r.columns)}) REFERENCES {quoted(r.target)}" + (f" ({_list(r.references)})" if r.references else "") for r in view.relationships]
    metrics = [member(m) + (f" USING ({_list(m.using)})" if m.using else "") + (f" NON ADDITIVE BY ({', '.join(map(order_text, m.non_additive))})" if m.non_additive else "") + f" AS {m.expr}" + _notes(m) for m in view.metrics]
    mats = [f"{quoted(m.name)} AS (TABLE {m.table}, DIMENSIONS ({_list(m.dimensions)}), METRICS ({_list(m.metrics)}))" for m in view.materializations]
    plain = lambda ms: [f"{member(m)} AS {m.expr}{_notes(m)}" for m in ms]
    clauses = zip(CLAUSES, (tables, relationships, plain(view.facts), plain(view.dimensions), metrics, mats), strict=True)
    body = "\n".join(f"{word} (\n    " + ",\n    ".join(items) + "\n)" for word, items in clauses if items)
    name = f"{quoted(view.schema)}.{quoted(view.name)}" if qualified else quoted(view.name)
    return f"CREATE OR REPLACE SEMANTIC VIEW {name} AS\n{body}" + (f"\nCOMMENT = {_literal(view.comment)}" if view.comment is not None else "")


def check_representable(view: Definition) -> None:
    """Refuses a definition that its own statement would not define again; GET_DDL could not give it back."""
    try:
        again = parse_body(view.name, render(view).split(" AS\n", 1)[1], schema=view.schema)
    except SemanticError as e:
        raise DefinitionError(f"view '{view.name}' can't be written as a statement: {e}") from None
    for field in ("tables", "relationships", "facts", "dimensions", "metrics", "materializations", "comment"):
        mine, theirs = getattr(view, field), getattr(again, field)
        if mine != theirs:
            which = next((a for a, b in zip(mine or (), theirs or (), strict=False) if a != b), mine) if field != "comment" else mine
            raise DefinitionError(f"view '{view.name}': its statement would define other {field}: {which}")
