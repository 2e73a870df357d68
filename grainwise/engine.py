"""The engine: definitions in, lazy DataFrames out; SQL statements and introspection."""

from __future__ import annotations

import re
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from .errors import ParseError, SemanticError
from .model import Definition, Metric, bare, key, last, parts
from .operators.frames import frame
from .plans import text
from .plans.graph import validate
from .plans.planner import Plan, Planner, Request
from .sources import ddl, yaml_io
from .sources.catalog import Catalog

_S = r"\s+"
_NAME = ddl._NAME
_STRING = r"'(?:[^']|'')*'"


class Engine:
    """Semantic views over the tables and views of a Spark session."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.catalog = spark, Catalog(path)

    # definitions

    def create(self, view: Definition, replace_it: bool = False, if_not_exists: bool = False) -> bool:
        validate(view)
        ddl.check_representable(view)
        return self.catalog.create(replace(view, tables=tuple(replace(t, table=self._bound(t.table)) for t in view.tables)), replace_it, if_not_exists)

    def _bound(self, table: str) -> str:
        """A bare name of a stored table with the schema that it has now; temporary views and tables that come later stay as written."""
        if "." in table or table.startswith("`") or not self.spark.catalog.tableExists(table):
            return table
        found = self.spark.catalog.getTable(table)
        return table if found.isTemporary or not found.namespace else ".".join([*found.namespace, found.name])

    def create_from_yaml(self, name: str, source: str, **how: bool) -> bool:
        schema, short = self.catalog.split(name)
        return self.create(yaml_io.load(short, source, schema or self.catalog.search_path[0]), **how)

    def get_ddl(self, name: str, qualified: bool = False) -> str:
        return ddl.render(self.catalog.find(name), qualified)

    def read_yaml(self, name: str) -> str:
        return yaml_io.dump(self.catalog.find(name))

    # queries

    def plan(self, view: str, dimensions=(), metrics=(), facts=(), where: str | None = None, search_path: list[str] | None = None) -> Plan:
        return Planner(self.catalog.find(view, search_path)).plan(Request(tuple(dimensions), tuple(metrics), tuple(facts), where))

    def query(self, view: str, dimensions=(), metrics=(), facts=(), where: str | None = None, search_path: list[str] | None = None) -> DataFrame:
        """A lazy DataFrame: dimensions as asked, then metrics or facts as asked."""
        return frame(self.spark, self.plan(view, dimensions, metrics, facts, where, search_path))

    def explain(self, view: str, dimensions=(), metrics=(), facts=(), where: str | None = None, search_path: list[str] | None = None) -> DataFrame:
        plan = self.plan(view, dimensions, metrics, facts, where, search_path)
        lines = [f"view: {view}", f"dimensions: {', '.join(dimensions)}", f"metrics: {', '.join(metrics)}", f"facts: {', '.join(facts)}", f"materialization: {plan.materialized[0].name if plan.materialized else 'none'}"]
        for g in [*plan.groups, *([plan.rows] if plan.rows else [])]:
            lines += [f"grain {g.root[0]}: {', '.join(j.alias for j in g.joins) or 'no joins'}" + (f"; where {g.where}" if g.where else "")]
            lines += [f"  {c.name} = {c.expr}" for c in (*g.dimensions, *g.metrics)]
        plan_text = frame(self.spark, plan)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self._rows("explain_output string", [(x,) for x in [*lines, *plan_text.splitlines()]])

    # SQL

    def sql(self, statement: str) -> DataFrame:
        """Statements about semantic views; in others, which pass as they are, each semantic_view(...) becomes a view over its result."""
        plain = text.without_comments(statement).strip().rstrip(";").strip()
        for pattern, run in self._statements():
            if m := re.fullmatch(pattern, plain, re.I | re.S):
                return run(m)
        if re.match(r"\s*(CREATE|DROP|ALTER|DESC|DESCRIBE|SHOW)\s+(OR\s+REPLACE\s+|TERSE\s+|COLUMNS\s+IN\s+)?SEMANTIC\b", plain, re.I | re.S):
            raise ParseError(f"not understood: {plain[:60]}")
        made: list[str] = []
        try:
            return self.spark.sql(self._with_views(statement.strip().rstrip(";"), made))
        finally:  # the statement is analysed; the names are needed no more
            for name in made:
                self.spark.catalog.dropTempView(name)

    def _statements(self):
        yield rf"CREATE{_S}(OR{_S}REPLACE{_S})?SEMANTIC{_S}VIEW{_S}(IF{_S}NOT{_S}EXISTS{_S})?({_NAME})\s*(?:COMMENT\s*=\s*({_STRING})\s*)?(AS|FROM{_S}YAML(?:{_S}FILE)?)\b(.*)", self._create
        yield rf"DROP{_S}SEMANTIC{_S}VIEW{_S}(IF{_S}EXISTS{_S})?({_NAME})", lambda m: self._names("view_name string", [x for x in [self.catalog.drop(m.group(2), bool(m.group(1)))] if x])
        yield rf"ALTER{_S}SEMANTIC{_S}VIEW{_S}({_NAME}){_S}RENAME{_S}TO{_S}({_NAME})", lambda m: self._rows("old_name string, new_name string", [self.catalog.rename(m.group(1), m.group(2))])
        yield rf"ALTER{_S}SEMANTIC{_S}VIEW{_S}({_NAME}){_S}SET{_S}COMMENT\s*=\s*({_STRING})", lambda m: self._rows("name string, status string", [(self.catalog.comment(m.group(1), ddl.string(m.group(2))), "comment set")])
        yield rf"ALTER{_S}SEMANTIC{_S}VIEW{_S}({_NAME}){_S}UNSET{_S}COMMENT", lambda m: self._rows("name string, status string", [(self.catalog.comment(m.group(1), None), "comment unset")])
        yield rf"DESC(?:RIBE)?{_S}SEMANTIC{_S}VIEW{_S}({_NAME})", lambda m: self.describe(m.group(1))
        yield rf"SHOW{_S}(TERSE{_S})?SEMANTIC{_S}VIEWS(.*)", lambda m: self.show_views(bool(m.group(1)), m.group(2))
        yield rf"SHOW{_S}COLUMNS{_S}IN{_S}SEMANTIC{_S}VIEW{_S}({_NAME})", lambda m: self.show_columns(m.group(1))
        yield rf"SHOW{_S}SEMANTIC{_S}DIMENSIONS{_S}IN{_S}({_NAME}){_S}FOR{_S}METRIC{_S}({_NAME})(.*)", lambda m: self.show_dimensions_for(m.group(1), m.group(2), m.group(3))
        yield rf"SHOW{_S}SEMANTIC{_S}(DIMENSIONS|METRICS|FACTS|MATERIALIZATIONS)(.*)", lambda m: self.show_members(m.group(1).lower(), m.group(2))
        yield rf"SELECT{_S}GET_DDL\s*\(\s*'SEMANTIC_VIEW'\s*,\s*({_STRING})\s*(?:,\s*(true|false)\s*)?\)", lambda m: self._names("ddl string", [self.get_ddl(ddl.string(m.group(1)), (m.group(2) or "").lower() == "true")])
        yield rf"SELECT{_S}READ_YAML_FROM_SEMANTIC_VIEW\s*\(\s*({_STRING})\s*\)", lambda m: self._names("yaml string", [self.read_yaml(ddl.string(m.group(1)))])
        yield rf"SET{_S}search_path\s*(?:=|TO)\s*(.*)", self._set_path
        yield r"(?:SELECT\s+\*\s+FROM\s+)?explain_semantic_view\s*\((.*)\)", lambda m: self.explain(**self._arguments(m.group(1)))

    def _set_path(self, m: re.Match) -> DataFrame:
        self.catalog.search_path = self._path(m.group(1))
        return self._rows("key string, value string", [("search_path", ",".join(self.catalog.search_path))])

    @staticmethod
    def _path(value: str) -> list[str]:
        """Schemas in order, from 'a,b', a list of strings, or bare names."""
        inner = re.sub(r"^\s*(?:array)?\s*[\[(]|[\])]\s*$", "", value, flags=re.I)
        items = [ddl.string(x) if x[:1] in ("'", "$") else x for x in text.split(inner)]
        return [key(x) for item in items for x in item.split(",") if x.strip()]

    def _create(self, m: re.Match) -> DataFrame:
        instead, lenient, name, comment, how, body = m.groups()
        schema, short = self.catalog.split(name)
        schema = schema or self.catalog.search_path[0]
        if instead and lenient:
            raise ParseError("OR REPLACE and IF NOT EXISTS exclude each other")
        if how.upper() == "AS":
            view = ddl.parse_body(short, body, ddl.string(comment) if comment else None, schema)
        else:
            if how.upper().endswith("FILE"):
                source = "\n".join(r.value for r in self.spark.read.text(ddl.string(body), wholetext=True).limit(1).collect())
            else:
                q = re.fullmatch(r"\s*(\$\w*\$)(.*)\1\s*", body, re.S)
                if not q:
                    raise ParseError("YAML stands between $$ and $$")
                source = q.group(2)
            view = yaml_io.load(short, source, schema)
            view = replace(view, comment=ddl.string(comment)) if comment else view
        return self._names("view_name string", [short] if self.create(view, bool(instead), bool(lenient)) else [])

    def _arguments(self, inner: str) -> dict:
        args: dict = {}
        for i, part in enumerate(text.split(inner)):
            m = re.fullmatch(r"(\w+)\s*(?::=|=>)\s*(.*)", part, re.S)
            name, value = (m.group(1).lower(), m.group(2)) if m else ("view", part) if i == 0 else (None, part)
            if name not in ("view", "dimensions", "metrics", "facts", "where_clause", "search_path"):
                raise ParseError(f"unknown argument {part}")
            if name == "search_path":
                args[name] = self._path(value)
            elif name in ("view", "where_clause"):
                args["where" if name == "where_clause" else name] = ddl.string(value)
            else:
                args[name] = [ddl.string(x) for x in text.split(re.sub(r"^\s*(?:array)?\s*[\[(]|[\])]\s*$", "", value, flags=re.I)) if x]
        if "view" not in args:
            raise ParseError("semantic_view needs a view name")
        return args

    def _with_views(self, statement: str, made: list[str]) -> str:
        """The statement with each call of a registered function replaced: by a temporary view's name, or by a string."""
        for name, a, b in text.calls(statement, spark=True):
            low = name.lower()
            if low in ("semantic_view", "explain_semantic_view"):
                instead = f"_semantic_view_{uuid.uuid4().hex}"
                run = self.query if low == "semantic_view" else self.explain
                run(**self._arguments(statement[a:b])).createOrReplaceTempView(instead)
                made.append(instead)
            elif low == "get_ddl":
                args = text.split(statement[a:b])
                if len(args) not in (2, 3) or ddl.string(args[0]).upper() != "SEMANTIC_VIEW":
                    raise ParseError("GET_DDL('SEMANTIC_VIEW', 'name' [, true])")
                instead = text.spark_literal(self.get_ddl(ddl.string(args[1]), len(args) == 3 and args[2].strip().lower() == "true"))
            elif low == "read_yaml_from_semantic_view":
                instead = text.spark_literal(self.read_yaml(ddl.string(statement[a:b])))
            else:
                continue
            start = statement.rindex(name, 0, a)
            return statement[:start] + instead + self._with_views(statement[b + 1 :], made)
        return statement

    # introspection

    def _rows(self, schema: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _names(self, schema: str, names: list[str]) -> DataFrame:
        return self._rows(schema, [(n,) for n in names])

    def describe(self, name: str) -> DataFrame:
        v = self.catalog.find(name)
        rows = [("SEMANTIC_VIEW", v.name, None, "COMMENT", v.comment)] if v.comment is not None else []
        listed = lambda xs: "[" + ", ".join(f'"{x}"' for x in xs) + "]"

        def add(kind: str, item: str, parent: str | None, properties: list[tuple[str, str | None]]) -> None:
            rows.extend((kind, item, parent, p, x) for p, x in properties if x is not None)

        for t in v.tables:
            names = parts(t.table)
            add("TABLE", t.alias, None, [("BASE_TABLE_DATABASE_NAME", v.database), ("BASE_TABLE_SCHEMA_NAME", names[-2] if len(names) > 1 else v.schema), ("BASE_TABLE_NAME", names[-1]), ("PRIMARY_KEY", listed(t.primary_key) if t.primary_key else None), ("COMMENT", t.comment), ("SYNONYMS", listed(t.synonyms) if t.synonyms else None)])
        for r in v.relationships:
            add("RELATIONSHIP", r.name or "", r.source, [("TABLE", r.source), ("REF_TABLE", r.target), ("FOREIGN_KEY", listed(r.columns)), ("REF_KEY", listed(r.references or v.table(r.target).primary_key))])
        types = self._types(v)
        for kind, members in (("FACT", v.facts), ("DIMENSION", v.dimensions), ("METRIC", v.metrics)):
            for m in members:
                what = "DERIVED_METRIC" if isinstance(m, Metric) and m.derived else kind
                properties = [("TABLE", m.table or (None if kind == "METRIC" else v.base)), ("EXPRESSION", m.expr), ("DATA_TYPE", types.get(key(m.name), "")), ("COMMENT", m.comment), ("SYNONYMS", listed(m.synonyms) if m.synonyms else None)]
                if kind != "METRIC" and m.is_filter:
                    properties.append(("LABELS", listed(["FILTER"])))
                if kind != "DIMENSION":
                    properties.append(("ACCESS_MODIFIER", "PRIVATE" if m.private else "PUBLIC"))
                if isinstance(m, Metric):
                    properties += [("NON_ADDITIVE_BY", ", ".join(map(ddl.order_text, m.non_additive)) or None), ("WINDOW_SPEC", m.expr if m.window else None)]
                add(what, m.name, m.table or v.name, properties)
        for m in v.materializations:
            add("MATERIALIZATION", m.name, v.name, [("TABLE", m.table), ("DIMENSIONS", listed(m.dimensions)), ("METRICS", listed(m.metrics))])
        return self._rows("object_kind string, object_name string, parent_entity string, property string, property_value string", rows)

    def _types(self, v: Definition) -> dict[str, str]:
        """Member types, from Spark's analysis; members that can't be analysed have none."""
        out = {}
        for kind, members in (("dimensions", v.dimensions), ("metrics", v.metrics), ("facts", v.facts)):
            for m in members:
                try:
                    asked = {kind: [m.name]}
                    if isinstance(m, Metric) and m.window:
                        w = m.window
                        asked["dimensions"] = list(dict.fromkeys([*(w.partition or ()), *(w.excluding or ()), *(o.key for o in w.order)]))
                    open_view = replace(v, facts=tuple(replace(f, private=False) for f in v.facts), metrics=tuple(replace(x, private=False) for x in v.metrics), materializations=())
                    plan = Planner(open_view).plan(Request(**{k: tuple(x) for k, x in asked.items()}))
                    out[key(m.name)] = frame(self.spark, plan).schema[-1].dataType.simpleString().upper()
                except Exception as e:  # a missing table is no error of a listing
                    if isinstance(e, (KeyboardInterrupt, MemoryError)):
                        raise
        return out

    def _filters(self, rest: str) -> dict:
        m = re.fullmatch(rf"\s*(?:LIKE\s+({_STRING}))?\s*(?:IN\s+(?:(ACCOUNT)|DATABASE\s+({_NAME})|SCHEMA\s+({_NAME})|({_NAME})))?\s*(?:STARTS\s+WITH\s+({_STRING}))?\s*(?:LIMIT\s+(\d+))?\s*", rest, re.I)
        if not m:
            raise ParseError(f"not understood: {rest.strip()}; the order is LIKE, IN, STARTS WITH, LIMIT")
        like, account, database, schema, view, prefix, limit = m.groups()
        return {"like": ddl.string(like) if like else None, "database": database, "schema": key(schema) if schema else None, "view": view, "prefix": ddl.string(prefix) if prefix else None, "limit": int(limit) if limit else None}

    @staticmethod
    def _keep(rows: list[tuple], at: int, f: dict) -> list[tuple]:
        if f["like"] is not None:
            pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in f["like"])
            rows = [r for r in rows if re.fullmatch(pattern, r[at], re.I | re.S)]
        if f["prefix"] is not None:
            rows = [r for r in rows if r[at].startswith(f["prefix"])]
        return rows[: f["limit"]] if f["limit"] is not None else rows

    def _views(self, f: dict) -> list[Definition]:
        if f["view"]:
            return [self.catalog.find(f["view"])]
        return [v for (s, _), v in sorted(self.catalog.views.items()) if (f["schema"] in (None, s)) and (f["database"] is None or key(f["database"]) == key(v.database))]

    def show_views(self, terse: bool = False, rest: str = "") -> DataFrame:
        f = self._filters(rest)
        rows = self._keep([(v.created_on, v.name, "SEMANTIC_VIEW", v.database, v.schema, v.comment) for v in self._views(f)], 1, f)
        schema = "created_on string, name string, kind string, database_name string, schema_name string"
        return self._rows(schema, [r[:5] for r in rows]) if terse else self._rows(schema + ", comment string", rows)

    def show_members(self, kind: str, rest: str = "") -> DataFrame:
        f = self._filters(rest)
        rows = []
        for v in self._views(f):
            if kind == "materializations":
                rows += [(v.database, v.schema, v.name, m.name, m.table, ", ".join(m.dimensions), ", ".join(m.metrics)) for m in sorted(v.materializations, key=lambda m: m.name)]
                continue
            types = self._types(v)
            rows += [(v.database, v.schema, v.name, m.table or ("" if kind == "metrics" else v.base), m.name, types.get(key(m.name), ""), ", ".join(m.synonyms), m.comment) for m in sorted(getattr(v, kind), key=lambda m: m.name)]
        if kind == "materializations":
            return self._rows("database_name string, schema_name string, semantic_view_name string, name string, table string, dimensions string, metrics string", self._keep(rows, 3, f))
        return self._rows("database_name string, schema_name string, semantic_view_name string, table_name string, name string, data_type string, synonyms string, comment string", self._keep(rows, 4, f))

    def show_dimensions_for(self, view: str, metric: str, rest: str = "") -> DataFrame:
        """Dimensions that a query may combine with the metric; ``required`` by its window."""
        v, f = self.catalog.find(view), self._filters(rest)
        m = Planner(v).find(metric, v.metrics)
        if m is None:
            raise ParseError(f"view '{view}' has no metric '{metric}'")
        needed = {last(d) for w in [m.window] if w for d in (*(w.partition or ()), *(w.excluding or ()), *(o.key for o in w.order))}
        types, rows = self._types(v), []
        for d in sorted(v.dimensions, key=lambda d: d.name):
            planner = Planner(v)
            try:
                planner._fan_traps(planner.base_metrics(m), [d], [])
            except SemanticError:
                continue
            rows.append((d.table or v.base, d.name, types.get(key(d.name), ""), key(d.name) in needed, ", ".join(d.synonyms), d.comment))
        return self._rows("table_name string, name string, data_type string, required boolean, synonyms string, comment string", self._keep(rows, 1, f))

    def show_columns(self, view: str) -> DataFrame:
        v = self.catalog.find(view)
        types = self._types(v)
        kinds = [("DIMENSION", v.dimensions), ("FACT", v.facts), ("METRIC", [m for m in v.metrics if not m.derived]), ("DERIVED_METRIC", [m for m in v.metrics if m.derived])]
        rows = [(v.database, v.schema, v.name, bare(m.name), types.get(key(m.name), ""), kind, m.expr, m.comment) for kind, ms in sorted(kinds, key=lambda k: k[0]) for m in sorted(ms, key=lambda m: m.name) if not m.private]
        return self._rows("database_name string, schema_name string, semantic_view_name string, column_name string, data_type string, kind string, expression string, comment string", rows)
