"""Statements as text: queries with positional arguments, and changes of a table as its next state."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Text in quotes, or an argument's place.
_PLACE = re.compile(r"""('(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`)|\?""")


def _named(statement: str, arguments: list | None) -> tuple[str, dict[str, object]]:
    """The statement with its `?` named, and the arguments by those names."""
    names: list[str] = []

    def name(m: re.Match) -> str:
        if m[1]:
            return m[1]
        names.append(f"p{len(names)}")
        return f":{names[-1]}"

    text = _PLACE.sub(name, statement)
    given = list(arguments or [])
    if len(names) != len(given):
        raise ValueError(f"{len(names)} places, {len(given)} arguments")
    return text, dict(zip(names, given))


def _select(tables: dict[str, DataFrame], statement: str, arguments: dict[str, object]) -> DataFrame:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return next(iter(tables.values())).sparkSession.sql(statement, args=arguments or None)


def query(tables: dict[str, DataFrame], statement: str, arguments: list | None = None) -> DataFrame:
    """The rows of a SELECT over the tables, which it calls by name; every `?` outside quotes takes an argument."""
    return _select(tables, *_named(statement, arguments))


def _split(text: str, separator: str = ",") -> list[str]:
    """Parts between separators that aren't in quotes or brackets."""
    parts, depth, last = [], 0, 0
    for m in re.finditer(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|[()]|""" + re.escape(separator), text):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif m[0] == separator and depth == 0:
            parts.append(text[last : m.start()])
            last = m.end()
    return [p.strip() for p in [*parts, text[last:]]]


def run(tables: dict[str, DataFrame], statement: str, arguments: list | None = None) -> dict[str, DataFrame]:
    """The tables after an INSERT, UPDATE or DELETE, of which one differs; nothing is written.

    `INSERT [OR IGNORE] INTO t (columns) VALUES ... | SELECT ...` (other columns null; OR IGNORE leaves out rows whose id,
    or key, the table has), `UPDATE t SET column = expression, ... [WHERE ...]` and `DELETE FROM t [WHERE ...]`.
    """
    text, given = _named(statement.strip().rstrip(";"), arguments)
    if m := re.fullmatch(r"(?is)update\s+(\w+)\s+set\s+(.*?)(?:\s+where\s+(.*))?", text):
        name, condition = m[1], m[3] or "true"
        changed = {c.strip("` "): e for c, e in (_split(a, "=")[:1] + ["=".join(_split(a, "=")[1:])] for a in _split(m[2]))}
        if unknown := set(changed) - set(tables[name].columns):
            raise ValueError(f"no columns {sorted(unknown)}")
        kinds = dict(tables[name].dtypes)
        cells = [f"CAST(CASE WHEN {condition} THEN {changed[c]} ELSE `{c}` END AS {kinds[c]}) AS `{c}`" if c in changed else f"`{c}`" for c in tables[name].columns]
        return {**tables, name: _select(tables, f"SELECT {', '.join(cells)} FROM {name}", given)}
    if m := re.fullmatch(r"(?is)delete\s+from\s+(\w+)(?:\s+where\s+(.*))?", text):
        return {**tables, m[1]: _select(tables, f"SELECT * FROM {m[1]} WHERE NOT coalesce({m[2] or 'true'}, false)", given)}
    if m := re.fullmatch(r"(?is)insert\s+(or\s+ignore\s+)?into\s+(\w+)\s*\(([^)]*)\)\s*((?:values|select|with)\b.*)", text):
        name, columns = m[2], [c.strip("` ") for c in m[3].split(",")]
        state = tables[name]
        new = _select(tables, m[4], given).toDF(*columns)
        kinds = dict(state.dtypes)
        cells = [f"CAST({f'`{c}`' if c in columns else 'NULL'} AS {kinds[c]}) AS `{c}`" for c in state.columns]
        new = new.selectExpr(*cells)
        if m[1]:
            key = "id" if "id" in state.columns else state.columns[0]
            new = new.dropDuplicates([key]).join(state.select(key), key, "left_anti").select(*state.columns)
        return {**tables, name: state.unionByName(new)}
    raise ValueError(f"neither INSERT, UPDATE nor DELETE: {statement[:80]!r}")
