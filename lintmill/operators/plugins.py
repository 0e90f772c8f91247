"""Rules from outside: JSON rules that compile to plans, and Python visitors that run once a file.

A JSON rule names a selector and, optionally, conditions on attributes; it joins the table rules' scan.
A visitor is a function ``create(context)`` that returns handlers by node type (``Type`` or ``Type:exit``); it runs where the
file is parsed, so its rows leave the parser's task without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lintmill.functions.parser import parse
from lintmill.functions.relations import Rows
from lintmill.operators import node_rules
from lintmill.operators.fixes import Fixer, merge

#: Condition operators of JSON rules: SQL over the attribute's text.
CONDITIONS = {
    "eq": "{a} = {v}",
    "ne": "not ({a} <=> {v})",
    "in": "{a} in {v}",
    "not_in": "coalesce({a} not in {v}, true)",
    "matches": "coalesce({a} rlike {v}, false)",
    "not_matches": "not coalesce({a} rlike {v}, false)",
    "exists": "({a} is not null) = {v}",
    "lt": "cast({a} as double) < {v}",
    "gt": "cast({a} as double) > {v}",
    "same": "{a} = attrs[{v}]",
}


def _sql(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "(" + ", ".join(_sql(str(v)) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def json_rule(text: str | dict) -> node_rules.NodeRule:
    """A rule from {"name", "category", "message", "selector", "where": [{"attr", "op", "value"}], "language"}.

    Unknown operators and keys raise ValueError, so that a misspelt rule does not pass for one that finds nothing.
    """
    data = json.loads(text) if isinstance(text, str) else dict(text)
    if extra := set(data) - {"name", "category", "message", "selector", "where", "language"}:
        raise ValueError(f"unknown keys {sorted(extra)}")
    tests = []
    for c in data.get("where", []):
        if c["op"] not in CONDITIONS:
            raise ValueError(f"unknown operator {c['op']}")
        attr = c["attr"] if c["attr"] in ("slot", "parent_type", "line", "col", "depth") else f"attrs[{_sql(c['attr'])}]"
        tests.append(CONDITIONS[c["op"]].format(a=attr, v=_sql(c["value"])))
    return node_rules.NodeRule(data["name"], data.get("category", "style"), data["message"], data["selector"], " and ".join(f"({t})" for t in tests) or None, data.get("language", "all"))


def register(rule: node_rules.NodeRule) -> None:
    """Makes a rule known to the engine of this session."""
    node_rules.RULES[rule.name] = rule


class Context:
    """What a visitor sees: the file, its text, ancestors of the node at hand, and ``report``."""

    def __init__(self, path: str, source: str, options: list) -> None:
        self.path, self.source, self.options, self.fixer = path, source, options, Fixer()
        self.ancestors: list[dict] = []
        self.reports: list[tuple] = []

    def text(self, node: dict) -> str:
        return self.source[node["start"] : node["end"]]

    def report(self, node: dict, message: str, fix: tuple[int, int, str] | list[tuple[int, int, str]] | None = None) -> None:
        """``fix`` is one fix or the parts of one, as ``fixer`` makes them."""
        fix = merge(self.source, fix) if isinstance(fix, list) else fix
        self.reports.append((node["start"], node["end"], message, fix))


def _walk(node: dict, handlers: dict[str, Callable], context: Context) -> None:
    if handler := handlers.get(node["type"]) or handlers.get("*"):
        handler(node)
    context.ancestors.append(node)
    children = [v for value in node.values() for v in (value if isinstance(value, list) else (value,)) if isinstance(v, dict) and "type" in v]
    for child in sorted(children, key=lambda c: c["start"]):
        _walk(child, handlers, context)
    context.ancestors.pop()
    if handler := handlers.get(node["type"] + ":exit"):
        handler(node)


def run_visitor(files: DataFrame, name: str, create: Callable[[Context], dict[str, Callable]], options: list = ()) -> DataFrame:
    """(path, rule, message, line, col, start, end, fix) of what a visitor reports about ``files(path, language, source)``.

    A visitor that raises gives one row with its error as the message, and the other files go on.
    """
    given = list(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
        for batch in batches:
            out: list[tuple] = []
            for path, language, source in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "source")), strict=True):
                source = source or ""
                parsed = parse(source, language or "js")
                context, place = Context(path, source, given), Rows(source, parsed).place
                try:
                    _walk(parsed.program, create(context), context)
                except Exception as e:  # noqa: BLE001  a rule's own fault is reported like a finding
                    context.reports.append((0, 0, f"rule failed: {e}", None))
                for start, end, message, fix in context.reports:
                    line, col = place(start)
                    out.append((path, name, message, line, col, start, end, fix and dict(zip(("start", "end", "text"), fix, strict=True))))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "rule", "message", "line", "col", "start", "end", "fix"])

    return files.select("path", "language", "source").mapInArrow(run, "path string, rule string, message string, line int, col int, start int, end int, fix struct<start:int,end:int,text:string>")
