"""Globs and ignore patterns as regular expressions, for ``rlike`` on path columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: ``*`` stays in a segment, ``**`` crosses them, ``?`` is one character, braces are alternatives."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and (end := pattern.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_regex(p)[1:-1] for p in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def ignore_rule(line: str) -> tuple[str, bool] | None:
    """(regular expression over paths, negated) of one ignore line; None for blanks and comments.

    A pattern with a slash before its end is anchored, others hold at any depth; a trailing slash holds for what is below.
    """
    text = line.rstrip()
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text.removeprefix("\\")
    only_dirs = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    body = glob_regex(text.lstrip("/"))[1:-1]
    tail = "/.*" if only_dirs else "(?:/.*)?"
    return f"^{'' if anchored else '(?:.*/)?'}{body}{tail}$", negated


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the last pattern that matches a path ignores it."""
    out = F.lit(False)
    for rule in map(ignore_rule, lines):
        if rule:
            out = F.when(path.rlike(rule[0]), F.lit(not rule[1])).otherwise(out)
    return out


def included(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Exclusion first; no include patterns include all."""
    any_of = lambda globs: path.rlike("|".join(glob_regex(g) for g in globs))
    test = ~any_of(exclude) if exclude else F.lit(True)
    return test & any_of(include) if include else test


def last_match(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, ignored): ``patterns(ord, regex, negated)`` as a table; the last that matches a path decides.

    The pattern table is small by nature and joined by a condition; each path keeps one row by a map-side maximum.
    """
    hits = paths.join(patterns, F.expr("path rlike regex"), "left")
    last = F.max_by("negated", "ord")
    return hits.groupBy("path").agg(F.coalesce(~last, F.lit(False)).alias("ignored"))
