"""The catalog of views: schema-scoped, transactional by snapshot, optionally kept as JSON."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path

from ..errors import AmbiguousView, DefinitionError, UnknownView
from ..model import Definition, key
from . import ddl

VERSION = 1


class Catalog:
    """Views by (schema, name); with a path also kept in a file, which each change, or each transaction, replaces as a whole."""

    def __init__(self, path: str | None = None, database: str = "spark_catalog"):
        self.path, self.database, self.search_path = path, database, ["main"]
        self.views: dict[tuple[str, str], Definition] = {}
        self._unchecked: set[tuple[str, str]] = set()
        self._open = 0
        if path and Path(path).exists():
            stored = json.loads(Path(path).read_text())
            if stored.get("version", 0) > VERSION:
                raise DefinitionError(f"{path} was written by a later version ({stored['version']} > {VERSION})")
            for item in stored["views"]:
                body = item["ddl"].split(" AS\n", 1)[1]
                at = (item.get("schema", "main"), item["name"])  # files without a version had one schema
                view = ddl.parse_body(item["name"], body, schema=at[0])
                self.views[at] = replace(view, created_on=item.get("created_on", ""), database=database)
                self._unchecked.add(at)

    def _save(self) -> None:
        if self.path and not self._open:
            rows = [{"schema": s, "name": n, "created_on": v.created_on, "ddl": ddl.render(v)} for (s, n), v in sorted(self.views.items())]
            beside = Path(f"{self.path}.{uuid.uuid4().hex}")
            beside.write_text(json.dumps({"version": VERSION, "views": rows}, indent=1))
            os.replace(beside, self.path)

    def split(self, name: str) -> tuple[str | None, str]:
        names = key(name).split(".")
        if len(names) > 3 or len(names) == 3 and names[0] != key(self.database):
            raise UnknownView(f"'{name}' lies in another database than {self.database}")
        return (names[-2] if len(names) > 1 else None), names[-1]

    def find(self, name: str, search_path: list[str] | None = None) -> Definition:
        """A qualified view, else the only one of that name, else the first on the search path."""
        schema, short = self.split(name)
        path = [key(s) for s in (self.search_path if search_path is None else search_path)]
        found = [s for s, n in self.views if n == short and schema in (None, s)]
        if not found:
            raise UnknownView(f"no semantic view '{name}'")
        if len(found) > 1 and not path:
            raise AmbiguousView(f"semantic view '{name}' exists in {', '.join(sorted(found))}; qualify it")
        at = found[0] if len(found) == 1 else next((s for s in path if s in found), None)
        if at is None:
            raise UnknownView(f"semantic view '{name}' exists in {', '.join(sorted(found))}, none of which is on the search path ({', '.join(path)})")
        if (at, short) in self._unchecked:
            from ..plans.graph import validate

            validate(self.views[at, short])  # a stored definition that can't be checked answers nothing
            self._unchecked.discard((at, short))
        return self.views[at, short]

    def create(self, view: Definition, replace_it: bool = False, if_not_exists: bool = False) -> bool:
        at = (view.schema, view.name)
        if at in self.views and not replace_it:
            if if_not_exists:
                return False
            raise DefinitionError(f"semantic view '{view.name}' exists")
        self.views[at] = replace(view, created_on=view.created_on or datetime.now(timezone.utc).isoformat(sep=" ", timespec="seconds"), database=self.database)
        self._save()
        return True

    def drop(self, name: str, if_exists: bool = False) -> str | None:
        try:
            view = self.find(name)
        except UnknownView:
            if if_exists:
                return None
            raise
        del self.views[view.schema, view.name]
        self._save()
        return view.name

    def rename(self, name: str, to: str) -> tuple[str, str]:
        view = self.find(name)
        schema, short = self.split(to)
        at = (schema or view.schema, short)
        if at in self.views:
            raise DefinitionError(f"semantic view '{to}' exists")
        del self.views[view.schema, view.name]
        self.views[at] = replace(view, schema=at[0], name=at[1])
        self._save()
        return view.name, short

    def comment(self, name: str, comment: str | None) -> str:
        view = self.find(name)
        self.views[view.schema, view.name] = replace(view, comment=comment)
        self._save()
        return view.name

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """All changes inside happen, or none; the file is written once, at the end."""
        before = dict(self.views)
        self._open += 1
        try:
            yield
        except BaseException:
            self.views = before
            raise
        finally:
            self._open -= 1
        self._save()
