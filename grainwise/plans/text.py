"""Lexical work on expression text: finding references, replacing them, splitting lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

_NAME = r'(?:[^\W\d]\w*|"(?:[^"]|"")*"|`[^`]*`)'
_REST = rf"""(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<chain>{_NAME}(?:\s*\.\s*{_NAME})*)(?P<call>\s*\()?|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<other>::|.)"""
#: Definitions: '' is a quote in a string; in E'...' a backslash escapes what follows it.
_TOKEN = re.compile(rf"""(?P<string>[eE]'(?:[^'\\]|\\.|'')*'|'(?:[^']|'')*'|\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)|{_REST}""", re.S)
#: Spark's statements: a backslash escapes in every string, and double quotes make strings.
_SPARK_TOKEN = re.compile(rf"""(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")|{_REST}""", re.S)

# Words that no member can be named by without quotes.
RESERVED = frozenset(
    "all and any as asc between by case cast collate cross current_date current_timestamp desc distinct else end escape exists false from full group having ilike in inner interval is join left like not null on or order over regexp right rlike select similar some symmetric then true union using when where with".split()
)
# Units of time, as they follow a number or a string, or stand before FROM.
UNITS = frozenset("century day days decade dow doy epoch hour hours isodow microsecond microseconds millisecond milliseconds minute minutes month months quarter second seconds week weeks year years".split())


def tokens(text: str, spark: bool = False) -> Iterator[tuple[str, str, re.Match]]:
    for m in (_SPARK_TOKEN if spark else _TOKEN).finditer(text):
        kind = next(k for k in ("string", "comment", "chain", "number", "space", "other") if m.group(k) is not None)
        yield kind, m.group(kind), m


def without_comments(text: str) -> str:
    """Comments become blanks of the same length."""
    return "".join(re.sub(r"[^\n]", " ", t) if k == "comment" else m.group(0) for k, t, m in tokens(text))


def _is_reference(at: int, told: list[tuple[str, str, bool]]) -> bool:
    """Whether the word at a place of (kind, text, is call) may name a member: words are keywords by where they stand, but for the reserved ones."""
    kind, word, call = told[at]
    low = word.lower()
    if kind != "chain" or call or low in RESERVED:
        return False
    if word[0] in '"`' or "." in word:
        return True
    before, after = told[at - 1] if at else ("", "", False), told[at + 1] if at + 1 < len(told) else ("", "", False)
    last, following = before[1].lower(), after[1].lower()
    if after[0] == "string" or following == "[" and low in ("array", "map"):  # DATE '...', ARRAY[...]
        return False
    if low in UNITS and (before[0] in ("number", "string") or following == "from" or last == "to"):
        return False
    pairs = {("nulls", "first"), ("nulls", "last"), ("at", "time"), ("time", "zone"), ("within", "group"), ("similar", "to"), ("ignore", "nulls"), ("respect", "nulls")}
    if (low, following) in pairs or (last, low) in pairs or low == "to" and last in UNITS:
        return False
    if low in ("leading", "trailing", "both") and (after[0] == "string" or following == "from"):
        return False
    # the type after AS or ::, of one word or several (TIMESTAMP WITH TIME ZONE)
    i = at
    while i and told[i - 1][0] == "chain" and told[i - 1][1].lower() != "as" and not told[i - 1][2]:
        i -= 1
    return not (i and told[i - 1][1].lower() in ("as", "::"))


def replace(text: str, by: Callable[[str], str | None]) -> str:
    """Replaces each reference (a name or dotted names, no keyword or function) for which ``by`` gives a text; inserted text is not read again."""
    found = list(tokens(text))
    told = [(k, t, bool(m.group("call"))) for k, t, m in found if k not in ("space", "comment")]
    out, at = [], -1
    for kind, t, m in found:
        at += kind not in ("space", "comment")
        new = by(t) if kind == "chain" and _is_reference(at, told) else None
        out.append(m.group(0) if new is None else new)
    return "".join(out)


def references(text: str) -> list[str]:
    found: list[str] = []
    replace(text, lambda t: found.append(t))
    return found


def string_value(literal: str) -> str:
    """What a string literal of a definition stands for."""
    literal = literal.strip()
    if literal[0] == "$":
        tag = literal[: literal.index("$", 1) + 1]
        return literal[len(tag) : -len(tag)]
    if literal[0] in "eE":
        known = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
        return re.sub(r"\\(.)|''", lambda m: "'" if m.group(0) == "''" else known.get(m.group(1), m.group(1)), literal[2:-1], flags=re.S)
    return literal[1:-1].replace("''", "'")


def spark_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + "'"


def spark_sql(text: str) -> str:
    """Double-quoted names become backticked ones, and strings Spark's."""
    out = []
    for kind, t, m in tokens(text):
        if kind == "string":
            out.append(spark_literal(string_value(t)))
        elif kind == "chain":
            parts = re.findall(_NAME, t)
            t = ".".join("`" + p[1:-1].replace('""', '"') + "`" if p[0] == '"' else p for p in parts)
            out.append(t + (m.group("call") or ""))
        else:
            out.append(m.group(0))
    return "".join(out)


def split(text: str, at: str = ",") -> list[str]:
    """Parts between separators that stand outside quotes and parentheses."""
    depth, parts, now = 0, [], []
    for kind, t, m in tokens(text):
        whole = m.group(0)
        depth += (whole.count("(") + whole.count("[") - whole.count(")") - whole.count("]")) * (kind in ("other", "chain"))
        if kind == "other" and t == at and depth == 0:
            parts.append("".join(now))
            now = []
        else:
            now.append(whole)
    return [p.strip() for p in [*parts, "".join(now)]]


def calls(text: str, spark: bool = False) -> Iterator[tuple[str, int, int]]:
    """(function, start of arguments, end) of each call, outermost first."""
    places = list(tokens(text, spark))
    for i, (kind, t, m) in enumerate(places):
        if kind == "chain" and m.group("call"):
            depth = 1
            for _, u, n in places[i + 1 :]:
                depth += n.group(0).endswith("(") - (u == ")")
                if depth == 0:
                    yield t, m.end(), n.start()
                    break
