"""What becomes of diagnostics: text lines, JSON, summaries, exit codes, quick fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.orderBy("path", "line", "col", "rule")


def text_lines(diagnostics: DataFrame) -> DataFrame:
    """(path, line, col, value): ``path:line:col: severity(rule) message``."""
    level = F.when(F.col("severity") == 2, "error").otherwise("warning")
    value = F.concat(F.col("path"), F.lit(":"), F.col("line"), F.lit(":"), F.col("col") + 1, F.lit(": "), level, F.lit("("), F.col("rule"), F.lit(") "), F.col("message"))
    return diagnostics.select("path", "line", "col", value.alias("value"))


def json_lines(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.select("path", F.to_json(F.struct("path", "rule", "severity", "message", "line", "col", "fix")).alias("value"))


def file_summary(diagnostics: DataFrame) -> DataFrame:
    """(path, errors, warnings, fixable)."""
    return diagnostics.groupBy("path").agg(F.count_if(F.col("severity") == 2).alias("errors"), F.count_if(F.col("severity") == 1).alias("warnings"), F.count_if(F.col("fix").isNotNull()).alias("fixable"))


def summary(diagnostics: DataFrame) -> DataFrame:
    """One row: problems, errors, warnings, files and the sentence a terminal shows."""
    one = diagnostics.agg(F.count("*").alias("problems"), F.count_if(F.col("severity") == 2).alias("errors"), F.count_if(F.col("severity") == 1).alias("warnings"), F.count_distinct("path").alias("files"))
    return one.withColumn("sentence", F.format_string("%d problems (%d errors, %d warnings)", "problems", "errors", "warnings"))


def by_rule(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


def utf16(diagnostics: DataFrame, files: DataFrame) -> DataFrame:
    """``diagnostics`` with ``start``, ``end`` and ``col`` in UTF-16 units, as editors count, instead of code points."""
    text = files.select("path", F.col("source").alias("u_source"))

    def wide(begin: Column, end: Column) -> Column:
        return F.length(F.regexp_replace(F.substring(F.col("u_source"), begin + 1, end - begin), r"[^\x{10000}-\x{10FFFF}]", ""))

    zero, start, end = F.lit(0), F.col("start"), F.col("end")
    moved = {"start": start + wide(zero, start), "end": end + wide(zero, end), "col": F.col("col") + F.when(start.isNull(), 0).otherwise(wide(start - F.col("col"), start))}
    return diagnostics.join(text, "path", "left").withColumns(moved).select(*diagnostics.columns)


def exit_code(diagnostics: DataFrame, any_severity: bool = False) -> int:
    """1 if there is an error (or, with ``any_severity``, any diagnostic), else 0."""
    hits = diagnostics if any_severity else diagnostics.where("severity = 2")
    return int(hits.limit(1).count() > 0)


def quick_fixes(diagnostics: DataFrame, path: str, first_line: int, last_line: int) -> DataFrame:
    """Fixes on lines that overlap a range of one file."""
    return diagnostics.where((F.col("path") == path) & F.col("line").between(first_line, last_line) & F.col("fix").isNotNull()).select("rule", "message", "fix")
