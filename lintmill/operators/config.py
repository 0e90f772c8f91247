"""Rule configuration: severities, presets, nearest configuration file, flat entries merged in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severity by name; severity of each category in the recommended preset.
SEVERITIES = {"off": 0, "hint": 0, "0": 0, "warn": 1, "warning": 1, "info": 1, "1": 1, "error": 2, "2": 2}
PRESET = {"correctness": 2, "suspicious": 1, "style": 0, "typescript": 1}


def severity(value: str | int | list) -> int:
    """A severity from its name, its number or the head of an option list; unknown names are errors."""
    if isinstance(value, list):
        return severity(value[0]) if value else 2
    if isinstance(value, bool):
        return 2 if value else 0
    if isinstance(value, int):
        return min(max(value, 0), 2)
    return SEVERITIES.get(value.lower(), 2)


def severity_column(value: Column) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for name, level in SEVERITIES.items():
        out = out.when(F.lower(value) == name, level)
    return out.otherwise(2)


def rule_table(spark: SparkSession, categories: dict[str, str], rules: dict[str, str | int | list] | None = None, preset: bool = True) -> DataFrame:
    """(rule, severity) of all known rules, overridden by ``rules``."""
    levels = {name: PRESET.get(category, 0) if preset else 0 for name, category in categories.items()}
    levels |= {name.rsplit("/", 1)[-1] if name not in levels else name: severity(v) for name, v in (rules or {}).items()}
    return spark.createDataFrame(sorted(levels.items()), "rule string, severity int")


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, config_dir, config): the configuration of the deepest folder above each file; null if none.

    ``configs(dir, config)``; each file is exploded into its folders, so the join is on equality.
    """
    parts = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    depths = F.sequence(F.lit(0), F.size(parts))
    above = files.select("path", F.explode(F.transform(depths, lambda d: F.array_join(F.slice(parts, 1, d), "/"))).alias("dir")).distinct()
    hits = above.join(configs, "dir", "left")
    # max_by skips rows whose order is null, so folders without a configuration don't count
    order = F.when(F.col("config").isNotNull(), F.length("dir"))
    return hits.groupBy("path").agg(F.max_by("dir", order).alias("config_dir"), F.max_by("config", order).alias("config"))


def legacy_chain(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, rules): configurations of all folders above a file merged from the outermost in, beginning at the deepest that says it is the root.

    ``configs(dir, root BOOLEAN, rules MAP<STRING,STRING>)``. An inner folder's word on a rule holds.
    """
    parts = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.array_join(F.slice(parts, 1, d), "/"))).alias("dir")).distinct()
    hits = above.join(configs.withColumn("said", F.lit(True)), "dir", "left")
    chain = F.array_sort(F.collect_list(F.when(F.col("said"), F.struct(F.length("dir").alias("at"), F.coalesce("root", F.lit(False)).alias("root"), F.map_entries(F.coalesce("rules", F.create_map().cast("map<string,string>"))).alias("e")))))
    empty = F.create_map().cast("map<string,string>")

    def step(acc: Column, x: Column) -> Column:
        new = F.map_from_entries(x["e"])
        return F.when(x["root"], new).otherwise(F.map_concat(F.map_filter(acc, lambda k, v: ~F.map_contains_key(new, k)), new))

    return hits.groupBy("path").agg(F.aggregate(chain, empty, step).alias("rules"))


def merge_flat(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, rules): entries whose regex matches a path, merged so that later ones win.

    ``entries(ord, regex, rules MAP<STRING,STRING>)``; the fold is ordered by ``ord``. Spark broadcasts the entries if
    they are under its size threshold, as a configuration is.
    """
    hits = files.select("path").join(entries, F.expr("path rlike regex"), "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("rules").isNotNull(), F.struct("ord", F.map_entries("rules").alias("e")))))
    empty = F.create_map().cast("map<string,string>")

    def step(acc: Column, x: Column) -> Column:
        new = F.map_from_entries(x["e"])
        return F.map_concat(F.map_filter(acc, lambda k, v: ~F.map_contains_key(new, k)), new)

    return hits.groupBy("path").agg(F.aggregate(ordered, empty, step).alias("rules"))
