"""Suppression comments: ``eslint-disable``, ``-enable``, ``-disable-line``, ``-disable-next-line`` and the short dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = r"^\s*(?:eslint|lintmill)-(disable-next-line|disable-line|disable|enable)(?:\s+([\s\S]*?))?\s*(?:--[\s\S]*)?$"


def directives(comments: DataFrame) -> DataFrame:
    """(path, kind, line, start, rule): one row a rule named; rule is * where none is named."""
    said = comments.where(F.col("text").rlike(PATTERN)).withColumn("kind", F.regexp_extract("text", PATTERN, 1)).withColumn("names", F.regexp_extract("text", PATTERN, 2))
    names = F.filter(F.transform(F.split("names", ","), lambda x: F.regexp_replace(F.trim(x), "^.*/", "")), lambda x: x != "")
    each = F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("*"))))
    return said.select("path", "kind", F.when(F.col("kind") == "disable-next-line", F.col("end_line") + 1).otherwise(F.col("line")).alias("line"), "start", each.alias("rule"))


#: ``/* global a, b:writable */``; what follows ``--`` is a remark.
GLOBALS_PATTERN = r"^\s*globals?\s+([\s\S]*?)(?:\s--[\s\S]*)?$"


def global_comments(comments: DataFrame) -> DataFrame:
    """(path, name, known): names that block comments declare as globals; ``known`` is false for those set to off. The last word on a name holds."""
    said = comments.where(~F.lower("kind").startswith("line") & F.col("text").rlike(GLOBALS_PATTERN))
    listed = F.regexp_replace(F.regexp_extract("text", GLOBALS_PATTERN, 1), r"\s*:\s*", ":")
    each = said.select("path", "start", F.posexplode(F.split(listed, r"[,\s]+")).alias("at", "entry")).where("entry != ''")
    parts = F.split("entry", ":")
    named = each.select("path", "start", "at", parts[0].alias("name"), (F.coalesce(F.get(parts, F.lit(1)), F.lit("")) != "off").alias("known"))
    return named.groupBy("path", "name").agg(F.max_by("known", F.struct("start", "at")).alias("known"))


def suppress(diagnostics: DataFrame, said: DataFrame) -> DataFrame:
    """``diagnostics`` without those that a directive covers.

    A line directive covers its line. Otherwise the last disable or enable at or before a diagnostic's line decides, whichever
    names its rule or all. A file's directives are one array that is joined by path, so each diagnostic is decided in its own row,
    and the plan reads the diagnostics once.
    """
    per_file = said.groupBy(F.col("path").alias("s_path")).agg(F.collect_list(F.struct("line", "start", "kind", "rule")).alias("s_all"))
    joined = diagnostics.join(per_file, F.col("path") == F.col("s_path"), "left")
    named = F.filter(F.coalesce("s_all", F.array()), lambda s: (s["rule"].isin("*") | (s["rule"] == F.col("rule"))) & (s["line"] <= F.col("line")))
    exact = F.exists(named, lambda s: s["kind"].isin("disable-line", "disable-next-line") & (s["line"] == F.col("line")))
    last = F.array_max(F.filter(named, lambda s: s["kind"].isin("disable", "enable")))["kind"]
    return joined.where(~exact & (F.coalesce(last, F.lit("enable")) != "disable")).drop("s_path", "s_all")
