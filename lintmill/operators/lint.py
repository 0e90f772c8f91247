"""The engine: from files and a configuration to diagnostics."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.functions.tree import File
from lintmill.operators import node_rules, structure_rules, tree_rules
from lintmill.operators.config import PRESET, severity
from lintmill.operators.directives import directives, suppress
from lintmill.operators.fixes import with_fixes
from lintmill.plans.parsed import RELATIONS, Tables, keep, parse_files

BUDGET = 200
COLUMNS = ("path", "rule", "severity", "message", "line", "col", "start", "end", "fix")


def catalog() -> dict[str, tuple[str, str]]:
    """rule -> (category, message template) of all rules."""
    found = {n: (r.category, r.message) for n, r in node_rules.RULES.items()}
    found |= {n: r[:2] for n, r in structure_rules.RULES.items()}
    return found | {n: (r.category, r.message) for n, r in tree_rules.RULES.items()}


def rule_names(pattern: str = "*") -> list[str]:
    return sorted(fnmatch.filter(catalog(), pattern))


def severities(config: dict | None = None) -> dict[str, int]:
    """Severity of each rule that is not off; ``config`` has rules by name, and preset (True by default)."""
    config = config or {}
    known = catalog()
    levels = {n: PRESET.get(c, 0) if config.get("preset", True) else 0 for n, (c, _) in known.items()}
    for name, value in config.get("rules", {}).items():
        levels[name if name in known else name.rsplit("/", 1)[-1]] = severity(value)
    return {n: s for n, s in levels.items() if s and n in known}


def options(config: dict | None = None) -> dict[str, list]:
    """What follows the severity in a rule's entry: ["error", {...}] gives [{...}]."""
    known = catalog()
    return {n if n in known else n.rsplit("/", 1)[-1]: list(v[1:]) for n, v in (config or {}).get("rules", {}).items() if isinstance(v, (list, tuple))}


def needed(names: list[str]) -> tuple[str, ...]:
    """Relations that the rules use: none of nodes where all rules run with the parser, nodes and comments for rules of one row, else all."""
    others = [n for n in names if n not in tree_rules.RULES]
    return ("comments", "errors") if not others else tuple(RELATIONS) if any(n in structure_rules.RULES for n in others) else ("nodes", "comments", "errors")


def node_types(names: list[str]) -> frozenset[str] | None:
    """Types of the nodes that the rules read; None for all."""
    others = [n for n in names if n not in tree_rules.RULES]
    return None if any(n in structure_rules.RULES for n in others) else node_rules.types_of([n for n in others if n in node_rules.RULES])


def inspector(names: list[str], given: dict[str, list] | None = None):
    """What runs the named tree rules on a file where it is parsed; None if there are none. Rules that are data travel along."""
    chosen = {n: (given or {}).get(n, []) for n in names if n in tree_rules.RULES}
    data = {n: tree_rules.RULES[n].data for n in chosen if tree_rules.RULES[n].data is not None}

    def inspect(f: File):
        if missing := [n for n in data if n not in tree_rules.RULES]:
            from lintmill.operators import rule_ir

            for n in missing:
                rule_ir.register(data[n])
        for n, own in chosen.items():
            for node, said in tree_rules.find(f, n, own):
                yield n, node["start"], node["end"], said

    return inspect if chosen else None


def template(message: Column, data: Column) -> Column:
    """``{{key}}`` replaced from a map; unknown keys stay."""
    entries = F.filter(F.map_entries(data), lambda e: F.contains(message, F.concat(F.lit("{{"), e["key"], F.lit("}}"))))
    return F.aggregate(entries, message, lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def diagnose(t: Tables, levels: dict[str, int], *, budget: int = BUDGET) -> DataFrame:
    """Diagnostics of the enabled rules: COLUMNS. At most ``budget`` of one rule a file (a feature of the report); 0 for all."""
    in_tree = [n for n in levels if n in tree_rules.RULES]
    in_rows = [n for n in levels if n in node_rules.RULES and n not in tree_rules.RULES]
    joined = [n for n in levels if n in structure_rules.RULES and n not in tree_rules.RULES]
    found = t.found.where(F.col("rule").isin(*in_tree)).select("path", "rule", "line", "col", "start", "end", "attrs") if in_tree else None
    if in_rows:
        ts = {n for n in in_rows if node_rules.RULES[n].languages == "ts"}
        part = node_rules.run_node_rules(t.nodes, in_rows).drop("node_id")
        if ts:
            typed = t.files.where(F.col("language").isin("ts", "tsx")).select("path")
            plain = part.where(~F.col("rule").isin(*ts))
            part = plain.unionByName(part.where(F.col("rule").isin(*ts)).join(typed, "path", "left_semi"))
        found = part if found is None else found.unionByName(part)
    if joined:
        part = structure_rules.run_structure_rules(t, joined).drop("node_id")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = t.nodes.where("false").select("path", F.lit("").alias("rule"), "line", "col", "start", "end", "attrs")
    known = catalog()
    message = F.element_at(F.create_map(*[F.lit(x) for n in levels for x in (n, known[n][1])]), F.col("rule")) if levels else F.lit("")
    level = F.element_at(F.create_map(*[F.lit(x) for n, s in levels.items() for x in (n, s)]), F.col("rule")) if levels else F.lit(0)
    out = with_fixes(found).withColumn("message", template(message, F.col("attrs"))).withColumn("severity", level)
    errors = t.errors.select("path", F.lit("parse-error").alias("rule"), F.lit(2).alias("severity"), "message", "line", "col", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("struct<start:int,end:int,text:string>").alias("fix"))
    out = suppress(out.select(*COLUMNS), directives(t.comments)).unionByName(errors)
    return within(out, budget)


def within(diagnostics: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` diagnostics of each rule in each file; 0 for all."""
    if not budget:
        return diagnostics
    w = W.partitionBy("path", "rule").orderBy("line", "col", "end", "message")
    return diagnostics.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= budget).drop("nth")


def lint(files: DataFrame, config: dict | None = None, *, budget: int = BUDGET) -> DataFrame:
    """Diagnostics of ``files(path, language, source)``; the parse is kept for all rules of the run.

    Where no rule runs with the parser, equal texts of a task are diagnosed once, budget included, and each of their files gets the diagnostics.
    Where a path comes with several texts, the budget is taken again by path.
    """
    levels = severities(config)
    names = list(levels)
    inspect = inspector(names, options(config))
    parsed = keep(parse_files(files, needed(names), inspect=inspect, types=node_types(names), grouped=inspect is None).parsed)
    found = diagnose(Tables(parsed, structure_rules.known_globals(config)), levels, budget=budget)
    if inspect is not None:
        return found
    each = parsed.select("path", F.explode("paths").alias("file"))
    found = found.join(each, "path").select(F.col("file").alias("path"), *COLUMNS[1:])
    return within(found, budget) if budget and _repeated(each.select("file")) else found


def _repeated(values: DataFrame) -> bool:
    """Whether a value comes twice; by hashes, so it can say so of different values too."""
    return (values.groupBy(F.xxhash64(*values.columns)).count().agg(F.max("count")).first()[0] or 0) > 1


def lint_source(spark, source: str, filename: str = "source.js", config: dict | None = None) -> DataFrame:
    from lintmill.sources.files import in_memory

    return lint(in_memory(spark, {filename: source}), config)


def fix_preview(files: DataFrame, config: dict | None = None, passes: int = 10) -> DataFrame:
    """(path, before, after) of the files that ``fix`` would change; nothing is written back."""
    after = fix(files, config, passes).select("path", F.col("source").alias("after"))
    return files.select("path", F.col("source").alias("before")).join(after, "path").where("before != after")


def fix(files: DataFrame, config: dict | None = None, passes: int = 10) -> DataFrame:
    """``files`` with all fixes of the enabled rules, to a fixpoint."""
    from lintmill.operators.fixes import fix_all

    return fix_all(files, lambda f: lint(f, config, budget=0), passes)
