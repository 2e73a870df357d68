"""Aggregate functions: which names aggregate, and what Spark calls them."""

from __future__ import annotations

import re

from ..plans import text

# Aggregate functions known by the same name in Spark.
SAME = "any_value approx_count_distinct approx_top_k array_agg avg bit_and bit_or bit_xor bool_and bool_or corr count count_if covar_pop covar_samp first last listagg max max_by mean median min min_by mode percentile_cont percentile_disc regr_avgx regr_avgy regr_count regr_intercept regr_r2 regr_slope regr_sxx regr_sxy regr_syy stddev stddev_pop stddev_samp string_agg sum var_pop var_samp variance"
# Other names, and Spark's.
RENAMED = {
    "arg_max": "max_by", "argmax": "max_by", "arg_max_null": "max_by", "arg_min": "min_by", "argmin": "min_by", "arg_min_null": "min_by",
    "countif": "count_if", "group_concat": "string_agg", "arbitrary": "any_value", "favg": "avg",
    "fsum": "sum", "sumkahan": "sum", "kahan_sum": "sum", "sum_no_overflow": "sum", "kurtosis_pop": "kurtosis",
}
#: Rewritten over their arguments.  Spark's kurtosis and skewness are those of the population;
#: here they are those of a sample.  A product is summed in logarithms, so that it needs no list.
REWRITTEN = {
    "quantile": "percentile_disc({1}) WITHIN GROUP (ORDER BY {0})",
    "quantile_disc": "percentile_disc({1}) WITHIN GROUP (ORDER BY {0})",
    "quantile_cont": "percentile_cont({1}) WITHIN GROUP (ORDER BY {0})",
    "approx_quantile": "approx_percentile({0}, {1})",
    "reservoir_quantile": "approx_percentile({0}, {1})",
    "mad": "element_at(transform(array(array_sort(collect_list({0}))), a -> transform(array(array_sort(transform(a, v -> abs(v - (get(a, cast((size(a) - 1) div 2 AS INT)) + get(a, cast(size(a) div 2 AS INT))) / 2)))), b -> (get(b, cast((size(b) - 1) div 2 AS INT)) + get(b, cast(size(b) div 2 AS INT))) / 2)[0]), 1)",
    "sem": "(stddev_pop({0}) / sqrt(count({0})))",
    "product": "(CASE WHEN count_if(({0}) = 0) > 0 THEN 0D ELSE (1 - 2 * (count_if(({0}) < 0) % 2)) * exp(sum(ln(nullif(abs({0}), 0)))) END)",
    "skewness": "(CASE WHEN count({0}) > 2 THEN sqrt(count({0}) * (count({0}) - 1D)) / (count({0}) - 2D) * skewness({0}) END)",
    "kurtosis": "(CASE WHEN count({0}) > 3 THEN (count({0}) - 1D) / ((count({0}) - 2D) * (count({0}) - 3D)) * ((count({0}) + 1D) * kurtosis({0}) + 6D) END)",
}
#: Have no counterpart that aggregates without gathering a group; refused when a view is defined.
UNSUPPORTED = frozenset({"bitstring_agg", "histogram", "histogram_exact", "entropy"})
#: Lists of a group's values, NULLs among them; an order may stand inside the call.
LISTS = frozenset({"list", "array_agg"})
ORDERED = LISTS | {"first", "last", "any_value", "arbitrary", "string_agg", "listagg", "group_concat"}
NAMES = frozenset(SAME.split()) | frozenset(RENAMED) | frozenset(REWRITTEN) | UNSUPPORTED | LISTS


def has_aggregate(expr: str) -> bool:
    return any(name.lower() in NAMES for name, _, _ in text.calls(expr))


def unsupported(expr: str) -> str | None:
    """An aggregate of the expression that Spark can't compute."""
    return next((name for name, _, _ in text.calls(expr) if name.lower() in UNSUPPORTED), None)


def _behind(expr: str, end: int, opening: str) -> tuple[int, int] | None:
    """Start and end of what stands in the parentheses of a clause like FILTER (...) right behind a call that ends at ``end``."""
    m = re.match(rf"(?i)\s*{opening}\s*\(", expr[end + 1 :])
    if m:
        for _, a, b in text.calls(expr):
            if a == end + 1 + m.end():
                return a, b
    return None


def _filtered(expr: str, end: int) -> tuple[str | None, int]:
    """The condition of a FILTER (WHERE ...) right after a call that ends at ``end``, and where that ends."""
    found = _behind(expr, end, "filter")
    if found:
        return re.sub(r"(?i)^\s*where\b", "", expr[slice(*found)]).strip(), found[1]
    return None, end


def _order_place(part: str) -> int | None:
    """Where ORDER BY starts in an argument, outside quotes and parentheses."""
    depth, words = 0, []
    for kind, t, m in text.tokens(part):
        if kind in ("other", "chain"):
            depth += m.group(0).count("(") - m.group(0).count(")")
        if kind == "chain" and depth == 0 and not m.group("call"):
            words.append((t.lower(), m.start()))
            if len(words) > 1 and words[-2][0] == "order" and words[-1][0] == "by":
                return words[-2][1]
    return None


def _orders(clause: str) -> list[tuple[str, bool, bool]]:
    """(expression, descending, nulls first) of the items of an ORDER BY; NULLs come last unless it says otherwise."""
    out = []
    for item in text.split(clause):
        m = re.fullmatch(r"(?is)(.*?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*", item)
        out.append((m.group(1).strip(), (m.group(2) or "").lower() == "desc", (m.group(3) or "").lower() == "first"))
    return out


def _list(args: list[str], clause: str | None, condition: str | None) -> str:
    """A group's values as an array with its NULLs, in the order asked for; NULL for a group without rows."""
    lead = re.match(r"(?is)\s*(distinct\s+|all\s+)?", args[0]).group(0)
    value = args[0][len(lead) :]
    keys = _orders(clause) if clause else []
    fields = ", ".join([f"({value}) AS v", *(f"({e}) AS k{i}" for i, (e, _, _) in enumerate(keys))])
    collect = "collect_set" if lead.strip().lower() == "distinct" else "collect_list"
    made = f"{collect}(struct({fields}))" + (f" FILTER (WHERE {condition})" if condition else "")
    if keys:
        test = "0"
        for i, (_, down, first) in reversed(list(enumerate(keys))):
            n, less = (-1, 1) if first else (1, -1), (1, -1) if down else (-1, 1)
            test = f"CASE WHEN l.k{i} IS NULL AND r.k{i} IS NULL THEN {test} WHEN l.k{i} IS NULL THEN {n[0]} WHEN r.k{i} IS NULL THEN {n[1]} WHEN l.k{i} < r.k{i} THEN {less[0]} WHEN l.k{i} > r.k{i} THEN {less[1]} ELSE {test} END"
        made = f"array_sort({made}, (l, r) -> {test})"
    return f"transform(nullif({made}, array()), s -> s.v)"


def _ordered(low: str, args: list[str], clause: str, condition: str | None) -> str:
    if low in ("string_agg", "listagg", "group_concat"):
        behind = f" FILTER (WHERE {condition})" if condition else ""
        items = ", ".join(f"{e} {'DESC' if down else 'ASC'} NULLS {'FIRST' if first else 'LAST'}" for e, down, first in _orders(clause))
        return f"listagg({', '.join([args[0], *(args[1:] or [chr(39) + ',' + chr(39)])])}) WITHIN GROUP (ORDER BY {items}){behind}"
    made = _list(args, clause, condition)
    return made if low in LISTS else f"element_at({made}, {-1 if low == 'last' else 1})"


def to_spark(expr: str) -> str:
    """The expression with Spark's names of aggregates; the FILTER of a rewritten one moves into its first argument."""
    out, at = [], 0
    for name, a, b in text.calls(expr):
        low = name.lower()
        if a < at:
            continue  # within a call that is rewritten already
        if low in UNSUPPORTED:
            raise ValueError(f"Spark has no aggregate {name}")
        start = expr.rindex(name, 0, a)
        args = text.split(expr[a:b])
        place = _order_place(args[-1] if low in ("string_agg", "listagg", "group_concat") else expr[a:b]) if low in ORDERED else None
        if low in LISTS or place is not None:
            condition, end = _filtered(expr, b)
            whole = expr[a:b]
            place = _order_place(whole)
            clause = re.sub(r"(?is)^order\s+by\s+", "", whole[place:]) if place is not None else None
            args = [to_spark(x) for x in text.split(whole[:place] if place is not None else whole)]
            condition = to_spark(condition) if condition else None
            out += [expr[at:start], _ordered(low, args, clause, condition) if clause else _list(args, None, condition)]
            at = end + 1
        elif low in RENAMED:
            out += [expr[at:start], RENAMED[low], "("]
            at = a
        elif low in REWRITTEN:
            args = [to_spark(x) for x in args]
            condition, end = _filtered(expr, b)
            if condition is not None:
                lead = re.match(r"(?is)(distinct\s+|all\s+)?", args[0]).group(0)
                args[0] = f"{lead}CASE WHEN {to_spark(condition)} THEN {args[0][len(lead):]} END"
            out += [expr[at:start], REWRITTEN[low].format(*args)]
            at = end + 1
    return "".join(out) + expr[at:]


#: Aggregate the value of their WITHIN GROUP (ORDER BY ...); what stands in the call is a constant.
_WITHIN = frozenset({"percentile_cont", "percentile_disc", "quantile_cont", "quantile_disc", "mode"})


def guarded(expr: str, present: str) -> str:
    """What each aggregate counts, counts only where ``present`` holds; COUNT(*) counts where it holds."""
    out, at = [], 0
    for name, a, b in text.calls(expr):
        low = name.lower()
        if low not in NAMES or a < at:
            continue
        within = _behind(expr, b, r"within\s+group") if low in _WITHIN else None
        if within:
            inner = expr[slice(*within)]
            lead = re.match(r"(?is)\s*order\s+by\s+", inner)
            body, tail = re.fullmatch(r"(?is)(.*?)((?:\s+(?:asc|desc))?(?:\s+nulls\s+(?:first|last))?\s*)", inner[lead.end() :]).groups()
            out += [expr[at : within[0]], lead.group(0), f"CASE WHEN {present} THEN {body} END", tail]
            at = within[1]
            continue
        first = text.split(expr[a:b])[0]
        lead = re.match(r"(?is)\s*(distinct\s+|all\s+)?", expr[a:b]).group(0)
        place = _order_place(first)
        body = (first if place is None else first[:place])[len(lead.lstrip()) :].strip()
        rest = expr[expr.index(body, a + len(lead)) + len(body) : b] if body else expr[a + len(lead) : b]
        value = "1" if body == "*" else body
        out += [expr[at:a], lead, f"CASE WHEN {present} THEN {value} END" if body else "", rest]
        at = b
    return "".join(out) + expr[at:]
