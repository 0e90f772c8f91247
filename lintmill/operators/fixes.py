"""Text fixes: which rules offer them, how they are applied, and the loop to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.plans.parsed import keep

#: rule -> SQL of (start, end, text) over a diagnostic's columns and attributes.
FIXES: dict[str, tuple[str, str, str]] = {
    "no-debugger": ("start", "end", "''"),
    "no-extra-semi": ("start", "end", "''"),
    "no-undef-init": ("start", "end", "attrs['id.text']"),
    "no-floating-decimal": ("start", "end", "case when attrs['raw'] like '.%' then concat('0', attrs['raw']) else concat(attrs['raw'], '0') end"),
    "no-zero-fractions": ("start", "end", "regexp_replace(attrs['raw'], '[.]0*$|(?<=[.][0-9]{1,30})0+$', '')"),
    "dot-notation": ("start", "end", "concat(attrs['object.text'], '.', attrs['property.value'])"),
    "no-var": ("start", "start + 3", "'let'"),
    "no-div-regex": ("start + 1", "start + 2", "'[=]'"),
    "new-parens": ("end", "end", "'()'"),
    "prefer-node-protocol": ("end - length(attrs['source.raw']) - 1", "end - 1", "concat(left(attrs['source.raw'], 1), 'node:', substring(attrs['source.raw'], 2))"),
}


class Fixer:
    """Verbs that make a fix (start, end, text) of a node or token, a dict with ``start`` and ``end``."""

    def remove(self, node: dict) -> tuple[int, int, str]:
        return node["start"], node["end"], ""

    def remove_range(self, start: int, end: int) -> tuple[int, int, str]:
        return start, end, ""

    def replace_text(self, node: dict, text: str) -> tuple[int, int, str]:
        return node["start"], node["end"], text

    def replace_text_range(self, start: int, end: int, text: str) -> tuple[int, int, str]:
        return start, end, text

    def insert_before(self, node: dict, text: str) -> tuple[int, int, str]:
        return node["start"], node["start"], text

    def insert_after(self, node: dict, text: str) -> tuple[int, int, str]:
        return node["end"], node["end"], text


def merge(source: str, parts: list[tuple[int, int, str]]) -> tuple[int, int, str] | None:
    """One fix of a report's parts in order of place, the text between them kept; None if there are none or two of them overlap."""
    parts = sorted(parts)
    if not parts or any(b[0] < a[1] for a, b in zip(parts, parts[1:], strict=False)):
        return None
    text = parts[0][2]
    for a, b in zip(parts, parts[1:], strict=False):
        text += source[a[1] : b[0]] + b[2]
    return parts[0][0], parts[-1][1], text


def with_fixes(diagnostics: DataFrame) -> DataFrame:
    """Adds ``fix``, a struct (start, end, text) in code points of the source; null where a rule has none."""
    arms = [f"when '{name}' then named_struct('start', cast({start} as int), 'end', cast({end} as int), 'text', {text})" for name, (start, end, text) in FIXES.items()]
    fixed = diagnostics.withColumn("fix", F.expr(f"case rule {' '.join(arms)} end"))
    return fixed.withColumn("fix", F.when(F.col("fix.text").isNotNull(), F.col("fix")))


def apply_fixes(source: Column, fixes: Column) -> Column:
    """The source with its fixes in order of start; one that begins before the end of the last applied is left for another pass."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, f: Column) -> Column:
        gap = F.substring(source, acc["at"] + 1, f["start"] - acc["at"])
        return F.when(f["start"] < acc["at"], acc).otherwise(F.struct(f["end"].alias("at"), F.concat(acc["text"], gap, f["text"]).alias("text")))

    folded = F.aggregate(F.array_sort(fixes), start, step)
    return F.concat(folded["text"], F.substring(source, folded["at"] + 1, F.length(source)))


def fix_once(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """``files`` with the fixes of ``diagnostics(path, fix)`` applied, and ``fixed``, whether a text changed."""
    per_file = diagnostics.where("fix is not null").groupBy("path").agg(F.collect_set("fix").alias("fixes"))
    joined = files.join(per_file, "path", "left")
    text = F.when(F.col("fixes").isNull(), F.col("source")).otherwise(apply_fixes(F.col("source"), F.col("fixes")))
    return joined.withColumn("new", text).select("path", "language", F.col("new").alias("source"), (F.col("new") != F.col("source")).alias("fixed"))


def fix_all(files: DataFrame, lint: Callable[[DataFrame], DataFrame], passes: int = 10) -> DataFrame:
    """Applies fixes until nothing changes, ten passes at most."""
    current = files.select("path", "language", "source")
    for _ in range(passes):
        fixed = keep(fix_once(current, lint(current)))
        current = fixed.select("path", "language", "source")
        if not fixed.where("fixed").limit(1).count():
            break
    return current
