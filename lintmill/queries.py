"""Registered queries over the test tables, each with the DuckDB statement that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.functions import globs
from lintmill.operators import config, report
from lintmill.operators.directives import suppress
from lintmill.operators.fixes import apply_fixes
from lintmill.operators.lint import diagnose, lint, severities, template
from lintmill.operators.node_rules import run_node_rules
from lintmill.operators.selectors import select
from lintmill.operators.structure_rules import lines
from lintmill.plans.parsed import Tables, parse_files
from lintmill.sources.files import page_scripts
from lintmill.streaming.editor import latest, settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_scripts(_t(spark, sf_dir, "pages"))


def _script_tables(spark: SparkSession, sf_dir: str, *need: str) -> Tables:
    return parse_files(_scripts(spark, sf_dir), need)


_SCRIPTS = "scripts as (select page_id, 'page/' || page_id || '/0.js' as path, regexp_extract(html, '(?is)<script\\b[^>]*>(.*?)</script\\s*>', 1) as source from pages where regexp_matches(html, '(?is)<script\\b[^>]*>(.*?)</script\\s*>'))"
_LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) + 1 as n from documents)"


# -- sources, tokens, nodes and rules on the inline scripts of pages -----------------------------


@query(f"with {_SCRIPTS} select page_id, path, source from scripts")
def script_extract(spark, sf_dir):
    return _scripts(spark, sf_dir).select("page_id", "path", "source")


@query(f"with {_SCRIPTS} select path, 'no-var' as rule, 1 as line, 0 as col, 'Unexpected var, use let or const instead.' as message from scripts where source like 'var %'")
def rule_no_var(spark, sf_dir):
    found = lint(_scripts(spark, sf_dir), {"preset": False, "rules": {"no-var": "error"}})
    return found.select("path", "rule", "line", "col", "message")


@query(f"with {_SCRIPTS} select path, cast(instr(source, 'track(') - 1 as int) as col, '''track'' is not defined.' as message from scripts where source like '%track(%'")
def rule_no_undef(spark, sf_dir):
    t = _script_tables(spark, sf_dir, "nodes", "symbols", "refs", "comments", "errors")
    return diagnose(t, severities({"preset": False, "rules": {"no-undef": 2}})).select("path", "col", "message")


@query(f"with {_SCRIPTS} select path, regexp_extract(source, '^var (\\w+)', 1) as name, cast(4 as int) as col from scripts where source like 'var %'")
def rule_no_unused_vars(spark, sf_dir):
    t = _script_tables(spark, sf_dir, "nodes", "symbols", "refs", "comments", "errors")
    found = diagnose(t, severities({"preset": False, "rules": {"no-unused-vars": 2}}))
    return found.select("path", F.regexp_extract("message", r"'(\w+)'", 1).alias("name"), "col")


@query(f"""with {_SCRIPTS} select path, regexp_extract(source, '("[^"]*")', 1) as text, cast(instr(source, '"') - 1 as int) as start, 'string' as kind from scripts where source like '%"%'""")
def token_strings(spark, sf_dir):
    return _script_tables(spark, sf_dir, "tokens").tokens.where("kind = 'string'").select("path", "text", "start", "kind")


@query(f"with {_SCRIPTS} select path, regexp_extract(source, 'track\\((\\d+)\\)', 1) as raw from scripts where regexp_matches(source, 'track\\((\\d+)\\)')")
def sel_child_attribute(spark, sf_dir):
    found = select(_script_tables(spark, sf_dir, "nodes").nodes, 'CallExpression[callee.name="track"] > Literal.arguments')
    return found.select("path", F.col("attrs")["raw"].alias("raw"))


@query(f"with {_SCRIPTS} select path, cast(instr(source, 'track') - 1 as int) as start, 'Identifier' as type from scripts where source like '%track(%'")
def sel_descendant(spark, sf_dir):
    found = select(_script_tables(spark, sf_dir, "nodes").nodes, 'ExpressionStatement Identifier[name="track"]')
    return found.select("path", "start", "type")


@query(f"with {_SCRIPTS} select path, cast(0 as int) as start, 'VariableDeclaration' as type from scripts where source like 'var %\"%' union all select path, cast(instr(source, 'track') - 1 as int), 'ExpressionStatement' from scripts where source like '%track(%'")
def sel_has_and_sibling(spark, sf_dir):
    nodes = _script_tables(spark, sf_dir, "nodes").nodes
    return select(nodes, "VariableDeclaration:has(Literal), VariableDeclaration + ExpressionStatement").select("path", "start", "type")


@query(f"with {_SCRIPTS} select 'VariableDeclaration' as type, count(*) as n from scripts where source like 'var %' group by all union all select 'CallExpression', count(*) from scripts where source like '%track(%' group by all")
def tag_histogram(spark, sf_dir):
    nodes = _script_tables(spark, sf_dir, "nodes").nodes
    return nodes.where("type in ('VariableDeclaration','CallExpression')").groupBy("type").agg(F.count("*").alias("n"))


@query()
def rules_all_on_scripts(spark, sf_dir):
    from lintmill.operators.node_rules import RULES

    return run_node_rules(_script_tables(spark, sf_dir, "nodes").nodes, list(RULES), "js").groupBy("rule").agg(F.count("*").alias("n"))


@query()
def parse_prose_never_fails(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.format_string("doc/%d.js", "doc_id").alias("path"), F.lit("js").alias("language"), F.col("text").alias("source"))
    return parse_files(docs, ("errors",)).errors.select("path", "line", "col", "message")


@query(f"with {_SCRIPTS} select path, 'let' || substr(source, 4) as source from scripts where source like 'var %'")
def fix_no_var(spark, sf_dir):
    from lintmill.operators.lint import fix

    return fix(_scripts(spark, sf_dir), {"preset": False, "rules": {"no-var": 2}}).select("path", "source")


@query(f"with {_SCRIPTS} select path || ':1:1: error(no-var) Unexpected var, use let or const instead.' as value from scripts where source like 'var %'")
def report_text(spark, sf_dir):
    return report.text_lines(lint(_scripts(spark, sf_dir), {"preset": False, "rules": {"no-var": "error"}})).select("value")


@query(f"with {_SCRIPTS} select count(*) as problems, count(*) as errors, cast(0 as bigint) as warnings, count(distinct path) as files from scripts where source like 'var %'")
def report_summary(spark, sf_dir):
    return report.summary(lint(_scripts(spark, sf_dir), {"preset": False, "rules": {"no-var": "error"}})).select("problems", "errors", "warnings", "files")


# -- lines and comments ---------------------------------------------------------------------------


def _files(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit("js").alias("language"), F.col("text").alias("source"))


@query(f"with {_LINES} select doc_id, cast(n as int) as line, cast(length(line) as int) as size from lines where length(line) > 400")
def line_max_len(spark, sf_dir):
    return lines(_files(spark, sf_dir)).where(F.length("text") > 400).select(F.col("path").alias("doc_id"), "line", F.length("text").alias("size"))


@query(f"with {_LINES} select line, count(*) as n, count(distinct doc_id) as docs from lines where line <> '' group by line having count(*) > 1")
def duplicate_lines(spark, sf_dir):
    found = lines(_files(spark, sf_dir)).where("text <> ''").groupBy(F.col("text").alias("line"))
    return found.agg(F.count("*").alias("n"), F.count_distinct("path").alias("docs")).where("n > 1")


@query(f"with {_LINES} select doc_id, count(*) as lines, cast(max(length(line)) as int) as longest, cast(sum(length(line)) as bigint) as characters from lines group by doc_id")
def line_stats(spark, sf_dir):
    found = lines(_files(spark, sf_dir)).groupBy(F.col("path").alias("doc_id"))
    return found.agg(F.count("*").alias("lines"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("characters"))


# -- paths, globs, configuration ----------------------------------------------------------------


def _paths(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^\w+://", "").alias("path"))


_PATHS = "paths as (select regexp_replace(url, '^\\w+://', '') as path from pages)"


@query(f"with {_PATHS} select path from paths where regexp_matches(path, '^[^/]*[.]example[.]com/.*$') and not regexp_matches(path, '^(?:[^/]+/)*[^/]*1[^/]*$')")
def glob_include_exclude(spark, sf_dir):
    return _paths(spark, sf_dir).where(globs.included(F.col("path"), ["*.example.com/**"], ["**/*1*"]))


@query(f"with {_PATHS}, p(ord, regex, negated) as (values (1, '^(?:.*/)?[^/]*[.]example[.]com(?:/.*)?$', false), (2, '^(?:.*/)?m[.][^/]*(?:/.*)?$', true), (3, '^(?:.*/)?[^/]*7(?:/.*)?$', false)) select path, coalesce(not arg_max(negated, ord), false) as ignored from (select distinct path from paths) left join p on regexp_matches(path, regex) group by path")
def gitignore_last_match(spark, sf_dir):
    rules = [globs.ignore_rule(x) for x in ("*.example.com", "!m.*", "*7")]
    patterns = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rules)], "ord int, regex string, negated boolean")
    return globs.last_match(_paths(spark, sf_dir).distinct(), patterns)


@query(f"with {_PATHS}, hosts as (select distinct path, regexp_extract(path, '^([^/]*)/', 1) as host from paths) select path, case when host like '%.com' then host else '' end as config_dir from hosts")
def config_nearest_ancestor(spark, sf_dir):
    paths = _paths(spark, sf_dir).distinct()
    host = F.regexp_extract("path", "^([^/]*)/", 1)
    own = paths.select(host.alias("dir")).where("dir like '%.com'").distinct().withColumn("config", F.lit("{}"))
    root = spark.createDataFrame([("", "{}")], "dir string, config string")
    return config.nearest_config(paths, own.unionByName(root)).select("path", "config_dir")


@query(f"with {_PATHS} select distinct path, case when path like '%.com/%' then 'error' else 'off' end as eqeqeq, 'warn' as no_var from paths")
def flat_config_merge(spark, sf_dir):
    entries = spark.createDataFrame([(1, ".", {"eqeqeq": "off", "no-var": "warn"}), (2, "[.]com/", {"eqeqeq": "error"})], "ord int, regex string, rules map<string,string>")
    merged = config.merge_flat(_paths(spark, sf_dir).distinct(), entries)
    return merged.select("path", F.col("rules")["eqeqeq"].alias("eqeqeq"), F.col("rules")["no-var"].alias("no_var"))


@query("select o_orderpriority, cast(case lower(split_part(o_orderpriority, '-', 1)) when '1' then 1 when '2' then 2 else 2 end as int) as severity, count(*) as n from orders group by all")
def severity_parse(spark, sf_dir):
    level = config.severity_column(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)))
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority", level.alias("severity")).agg(F.count("*").alias("n"))


# -- structural joins on a relational hierarchy ---------------------------------------------------


def _tree(spark, sf_dir):
    """region > nation > customer as nodes, a path for each region; ids are preorder places, computed by windows."""
    region, nation, customer = (_t(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    r = region.select("r_regionkey", F.lit(-1).alias("n"), F.lit(-1).cast("long").alias("c"), F.lit("Region").alias("type"), F.col("r_name").alias("name"))
    n = nation.select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("n"), F.lit(-1).cast("long").alias("c"), F.lit("Nation").alias("type"), F.col("n_name").alias("name"))
    c = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("n"), F.col("c_custkey").alias("c"), F.lit("Customer").alias("type"), F.col("c_name").alias("name"))
    rows = r.unionByName(n).unionByName(c)
    w = W.partitionBy("r_regionkey").orderBy("n", "c")
    ids = rows.withColumn("node_id", F.row_number().over(w) - 1)
    size = F.when(F.col("type") == "Region", F.max("node_id").over(W.partitionBy("r_regionkey"))).when(F.col("type") == "Nation", F.max("node_id").over(W.partitionBy("r_regionkey", "n"))).otherwise(F.col("node_id"))
    up = F.when(F.col("type") == "Nation", 0).when(F.col("type") == "Customer", F.min("node_id").over(W.partitionBy("r_regionkey", "n")))
    parent_type = F.when(F.col("type") == "Nation", "Region").when(F.col("type") == "Customer", "Nation")
    order = F.row_number().over(W.partitionBy("r_regionkey", "parent_id").orderBy("node_id")) - 1
    return ids.withColumn("last_id", size).withColumn("parent_id", up).select(F.col("r_regionkey").cast("string").alias("path"), "node_id", "parent_id", "last_id", "type", parent_type.alias("parent_type"), F.lit("body").alias("slot"), order.alias("ord"), F.create_map(F.lit("name"), F.col("name")).alias("attrs"))


@query("select c_name as name from customer join nation on c_nationkey = n_nationkey where n_name = (select min(n_name) from nation)")
def tree_child(spark, sf_dir):
    first = _t(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return select(_tree(spark, sf_dir), f'Nation[name="{first}"] > Customer').select(F.col("attrs")["name"].alias("name"))


@query("select c_name as name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name like 'A%'")
def tree_descendant(spark, sf_dir):
    return select(_tree(spark, sf_dir), "Region[name=/^A/] Customer").select(F.col("attrs")["name"].alias("name"))


@query("select n_name as name from nation where exists (select 1 from customer where c_nationkey = n_nationkey and c_name like '%7')")
def tree_has(spark, sf_dir):
    return select(_tree(spark, sf_dir), "Nation:has(Customer[name=/7$/])").select(F.col("attrs")["name"].alias("name"))


@query("select n_name as name from nation where n_nationkey not in (select min(n_nationkey) from nation group by n_regionkey)")
def tree_sibling(spark, sf_dir):
    return select(_tree(spark, sf_dir), "Nation ~ Nation").select(F.col("attrs")["name"].alias("name"))


@query("select n_name as name from nation where n_name not like '%A'")
def tree_not(spark, sf_dir):
    return select(_tree(spark, sf_dir), "Nation:not([name=/A$/])").select(F.col("attrs")["name"].alias("name"))


# -- windows and aggregates over siblings ---------------------------------------------------------


# -- directives, budgets, fixes, messages ---------------------------------------------------------


@query("with d as (select event_id, user_id, event_id as line from events), s as (select user_id, event_id as line, case when event_type = 'purchase' then 'disable' else 'enable' end as kind from events where event_type in ('purchase', 'signup')) select d.event_id from d left join s on d.user_id = s.user_id and s.line <= d.line group by d.event_id having coalesce(arg_max(s.kind, s.line), 'enable') <> 'disable'")
def directive_suppression(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    found = events.select(F.col("user_id").alias("path"), F.lit("r").alias("rule"), F.col("event_id").alias("line"), "event_id")
    kind = F.when(F.col("event_type") == "purchase", "disable").otherwise("enable")
    said = events.where("event_type in ('purchase','signup')").select(F.col("user_id").alias("path"), kind.alias("kind"), F.col("event_id").alias("line"), F.lit(0).alias("start"), F.lit("*").alias("rule"))
    return suppress(found, said).select("event_id")


@query("select doc_id, 'X' || substr(text, 4) as text from documents where length(text) > 10")
def fix_overlap_skip(spark, sf_dir):
    made = lambda a, b, t: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text"))
    fixes = F.array(made(2, 5, "skipped"), made(0, 3, "X"))  # the second in order begins before the first has ended
    return _t(spark, sf_dir, "documents").where(F.length("text") > 10).select("doc_id", apply_fixes(F.col("text"), fixes).alias("text"))


@query("select n_nationkey, '''' || n_name || ''' is not defined in {{where}}.' as message from nation")
def message_template(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey", template(F.lit("'{{name}}' is not defined in {{where}}."), F.create_map(F.lit("name"), F.col("n_name"))).alias("message"))


@query("select event_type as rule, cast(case when event_type = 'error' then 2 else 1 end as int) as severity, count(*) as n, count(distinct user_id) as files from events group by all")
def diag_by_rule(spark, sf_dir):
    level = F.when(F.col("event_type") == "error", 2).otherwise(1)
    return report.by_rule(_t(spark, sf_dir, "events").select(F.col("event_type").alias("rule"), level.alias("severity"), F.col("user_id").alias("path")))


# -- range and as-of joins ------------------------------------------------------------------------


# -- editor stream --------------------------------------------------------------------------------


def _changes(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("uri"), F.col("event_id").alias("version"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("text"), (F.col("event_type") == "logout").alias("closed"))


@query("select cast(user_id as varchar) as uri, max(event_id) as version, arg_max(props, event_id) as text from events group by user_id having arg_max(event_type, event_id) <> 'logout'")
def editor_latest_version(spark, sf_dir):
    return latest(_changes(spark, sf_dir)).select("uri", "version", "text")


@query("with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 1 hour then 0 else 1 end as opens from events), b as (select *, sum(opens) over (partition by user_id order by ts, event_id) as burst from g) select cast(user_id as varchar) as uri, max(event_id) as version, arg_max(props, event_id) as text from b group by user_id, burst")
def editor_debounce(spark, sf_dir):
    return settled(_changes(spark, sf_dir), "1 hour").select("uri", "version", "text")


# -- rules as data, visitors, places --------------------------------------------------------------


@query(f"with {_SCRIPTS} select path, 'large-track' as rule, cast(instr(source, 'track(') - 1 as int) as col from scripts where cast(regexp_extract(source, 'track\\((\\d+)\\)', 1) as int) > 100")
def rule_from_json(spark, sf_dir):
    from lintmill.operators.node_rules import RULES
    from lintmill.operators.plugins import json_rule, register

    register(json_rule({"name": "large-track", "message": "{{text}}", "selector": 'CallExpression[callee.name="track"]', "where": [{"attr": "arguments.0.value", "op": "gt", "value": 100}]}))
    try:
        return run_node_rules(_script_tables(spark, sf_dir, "nodes").nodes, ["large-track"]).select("path", "rule", "col")
    finally:
        del RULES["large-track"]


@query(f"with {_SCRIPTS} select path, cast(instr(source, 'track') - 1 as int) as col, 'call of track' as message from scripts where source like '%track(%'")
def rule_visitor(spark, sf_dir):
    from lintmill.operators.plugins import run_visitor

    def create(context):
        return {"CallExpression": lambda node: context.report(node, f"call of {node['callee'].get('name')}")}

    return run_visitor(_scripts(spark, sf_dir), "calls", create).select("path", "col", "message")


@query(f"with {_SCRIPTS} select path, cast(instr(source, 'track') - 1 as int) as at, ';' as before from scripts where source like '%;track(%'")
def token_before_offset(spark, sf_dir):
    from lintmill.operators.places import token_before

    at = _scripts(spark, sf_dir).where("source like '%;track(%'").select("path", (F.instr("source", "track") - 1).alias("offset"))
    found = token_before(_script_tables(spark, sf_dir, "tokens").tokens, at)
    return found.select("path", F.col("offset").alias("at"), F.col("token.text").alias("before"))


@query(f"with {_SCRIPTS} select path, cast(instr(source, 'track') - 1 as int) as at, 'Identifier' as type from scripts where source like '%track(%'")
def innermost_node(spark, sf_dir):
    from lintmill.operators.places import innermost

    at = _scripts(spark, sf_dir).where("source like '%track(%'").select("path", (F.instr("source", "track") - 1).alias("offset"))
    return innermost(_script_tables(spark, sf_dir, "nodes").nodes, at).select("path", F.col("offset").alias("at"), "type")


# -- generated scripts: every row of a table becomes a script, and the engine must find what its columns say -------


def _generated(spark, sf_dir, source):
    """A script for each part; ``source`` is a Column over part."""
    return _t(spark, sf_dir, "part").select(F.format_string("part/%d.ts", "p_partkey").alias("path"), F.lit("ts").alias("language"), source.alias("source"))


_PART = "'part/' || p_partkey || '.ts'"


def _family_source(names: list[str]):
    """Part k gets the example of rule k mod n: the one that breaks it if p_size is even."""
    from lintmill.operators.examples import EXAMPLES, ROW_EXAMPLES

    pairs = [(EXAMPLES.get(n) or ROW_EXAMPLES[n]) for n in names]
    bad, good = (F.array(*[F.lit(p[i]) for p in pairs]) for i in (0, 1))
    at = (F.col("p_partkey") % len(names) + 1).cast("int")
    return F.when(F.col("p_size") % 2 == 0, F.element_at(bad, at)).otherwise(F.element_at(good, at))


def _family_query(key: str, names: list[str]) -> None:
    """A query that runs a family of rules over their examples; each must be found where its example breaks it."""
    values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))

    def run(spark, sf_dir):
        scripts = _generated(spark, sf_dir, _family_source(names))
        found = lint(scripts, {"preset": False, "rules": {n: 2 for n in names}})
        own = F.element_at(F.array(*[F.lit(n) for n in names]), (F.regexp_extract("path", r"/(\d+)", 1).cast("long") % len(names) + 1).cast("int"))
        return found.where(F.col("rule") == own).select("path", "rule").distinct()

    QUERIES[key], SQL[key] = run, f"with r(i, rule) as (values {values}) select {_PART} as path, rule from part join r on p_partkey % {len(names)} = i where p_size % 2 = 0"


def _families() -> None:
    from lintmill.operators.examples import EXAMPLES, ROW_EXAMPLES
    from lintmill.operators.node_rules import RULES as rows
    from lintmill.operators.tree_rules import RULES as tree

    own = [n for n in EXAMPLES if n in tree]
    for category in ("correctness", "suspicious", "style", "typescript"):
        _family_query(f"rules_{category}", [n for n in own if tree[n].category == category])
    _family_query("rules_of_one_row", [n for n in ROW_EXAMPLES if n in rows and n not in tree])


@query(f"select {_PART} as path, cast(p_size as int) as depth from part")
def tree_node_depth(spark, sf_dir):
    """AGG-10: the deepest node of a script of p_size nested blocks."""
    source = F.concat(F.repeat(F.lit("{"), F.col("p_size") - 1), F.lit("a"), F.repeat(F.lit("}"), F.col("p_size") - 1))
    nodes = parse_files(_generated(spark, sf_dir, source), ("nodes",)).nodes
    return nodes.groupBy("path").agg(F.max("depth").alias("d")).select("path", (F.col("d") - 1).cast("int").alias("depth"))


@query(f"select {_PART} as path, cast(p_size as int) as n from part where p_size > 10")
def scope_closure(spark, sf_dir):
    """JN-04: each scope's ancestors, to any depth: a script of p_size nested blocks has a chain of so many scopes."""
    from lintmill.operators.structure_rules import scope_ancestors

    source = F.concat(F.repeat(F.lit("{let a;"), F.col("p_size")), F.repeat(F.lit("}"), F.col("p_size")))
    scripts = _generated(spark, sf_dir, source).where(F.regexp_count("source", F.lit("let")) > 10)
    t = parse_files(scripts, ("nodes", "scopes", "symbols", "refs"))
    up = scope_ancestors(t.scopes)
    return up.groupBy("path", "scope_id").agg(F.count("*").alias("n")).groupBy("path").agg(F.max("n").cast("int").alias("n"))


@query(f"select {_PART} as path, 'a' as name, cast(count(*) as bigint) as uses from part, unnest(range(p_size % 5 + 1)) group by all")
def refs_of_symbol(spark, sf_dir):
    """JN-07, JN-11: references joined to their binding."""
    source = F.concat(F.lit("let a = 1;"), F.repeat(F.lit("f(a);"), F.col("p_size") % 5 + 1))
    t = parse_files(_generated(spark, sf_dir, source), ("nodes", "symbols", "refs"))
    s = t.symbols.select("path", "symbol_id", F.col("name").alias("bound"))
    return t.refs.where("not is_init").join(s, ["path", "symbol_id"]).groupBy("path", F.col("bound").alias("name")).agg(F.count("*").alias("uses"))


@query(f"select {_PART} as path, 'x' || (p_size % 7) as name from part where p_size % 3 = 0")
def unresolved_refs(spark, sf_dir):
    """JN-08: names that no scope of the script binds."""
    name = F.concat(F.lit("x"), (F.col("p_size") % 7).cast("string"))
    source = F.concat(F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("let "), name, F.lit(" = 1; "))).otherwise(""), name, F.lit("++"))
    t = parse_files(_generated(spark, sf_dir, source), ("nodes", "symbols", "refs"))
    return t.refs.where("symbol_id is null").select("path", "name").distinct()


def _lint_query(key: str, sql: str, rule: str, source, options: list = ()) -> None:
    """A query that lints generated scripts by one rule and gives (path, n)."""

    def run(spark, sf_dir):
        found = lint(_generated(spark, sf_dir, source()), {"preset": False, "rules": {rule: [2, *options]}}, budget=0)
        return found.where(F.col("rule") == rule).groupBy("path").agg(F.count("*").alias("n"))

    QUERIES[key], SQL[key] = run, sql


_lint_query("use_before_define", f"select {_PART} as path, cast(p_size % 4 as bigint) as n from part where p_size % 4 > 0", "no-use-before-define", lambda: F.concat(F.repeat(F.lit("f(a);"), F.col("p_size") % 4), F.lit("let a = 1; f(a)")))
_lint_query("shadow_of_outer_names", f"select {_PART} as path, cast(p_size as bigint) as n from part", "no-shadow", lambda: F.concat(F.lit("let a;"), F.repeat(F.lit("{let a;"), F.col("p_size")), F.repeat(F.lit("}"), F.col("p_size"))))
_lint_query("dup_keys_keep_first", f"select {_PART} as path, cast(p_size % 6 as bigint) as n from part where p_size % 6 > 0", "no-dupe-keys", lambda: F.concat(F.lit("x = {a: 0"), F.repeat(F.lit(", a: 1"), F.col("p_size") % 6), F.lit(", b: 2}")))
_lint_query("sorted_keys_check", f"select {_PART} as path, cast(1 as bigint) as n from part where p_size % 2 = 1", "sort-keys", lambda: F.when(F.col("p_size") % 2 == 1, F.lit("x = {b: 1, a: 2, c: 3}")).otherwise("x = {a: 1, b: 2, c: 3}"))
_lint_query("last_case_is_default", f"select {_PART} as path, cast(1 as bigint) as n from part where p_size % 5 > 0", "default-case-last", lambda: F.concat(F.lit("switch (a) { default: b();"), F.repeat(F.lit("case 1: c();"), F.col("p_size") % 5), F.lit("}")))
_lint_query("default_params_right_to_left", f"select {_PART} as path, cast(p_size % 4 as bigint) as n from part where p_size % 4 > 0", "default-param-last", lambda: F.concat(F.lit("function f("), F.repeat(F.lit("b = 1, "), F.col("p_size") % 4), F.lit("c) {}")))
_lint_query("type_only_imports", f"select {_PART} as path, cast(1 as bigint) as n from part where p_size % 2 = 0", "consistent-type-imports", lambda: F.concat(F.lit("import { A } from 'a'; let b: A;"), F.when(F.col("p_size") % 2 == 1, F.lit("new A()")).otherwise("")))
_lint_query("max_classes_option", f"select {_PART} as path, cast(1 as bigint) as n from part where p_size % 5 > 2", "max-classes-per-file", lambda: F.concat(F.lit("a();"), F.repeat(F.lit("class A {}"), F.col("p_size") % 5)), [2])
_lint_query("max_params_option", f"select {_PART} as path, cast(1 as bigint) as n from part where p_size % 6 > 4", "max-params", lambda: F.concat(F.lit("function f(z"), F.repeat(F.lit(", a"), F.col("p_size") % 6), F.lit(") {}")), [{"max": 5}])
_lint_query("linebreaks_by_file", f"select {_PART} as path, cast(p_size % 3 as bigint) as n from part where p_size % 3 > 0", "linebreak-style", lambda: F.concat(F.lit("a()\n"), F.repeat(F.lit("b()\r\n"), F.col("p_size") % 3)))
_lint_query("unreachable_loops", f"select {_PART} as path, cast(1 as bigint) as n from part where p_size % 2 = 0", "no-unreachable-loop", lambda: F.concat(F.lit("while (a) { b(); "), F.when(F.col("p_size") % 2 == 0, F.lit("break")).otherwise("if (c) break"), F.lit(" }")))
_lint_query("switch_exhaustive", f"select {_PART} as path, cast(1 as bigint) as n from part where p_size % 3 < 2", "switch-exhaustiveness-check", lambda: F.concat(F.lit("declare const a: 'x' | 'y'; switch (a) { "), F.when(F.col("p_size") % 3 > 0, F.lit("case 'x': ")).otherwise(""), F.when(F.col("p_size") % 3 > 1, F.lit("case 'y': ")).otherwise(""), F.lit("}")))
_lint_query("rule_text_past_160", f"select {_PART} as path, cast(1 as bigint) as n from part where p_size % 2 = 0", "no-self-compare", lambda: F.concat(F.repeat(F.lit("abcdefgh."), F.col("p_size") + 20), F.lit("a === "), F.repeat(F.lit("abcdefgh."), F.col("p_size") + 20), F.when(F.col("p_size") % 2 == 0, F.lit("a")).otherwise("b")))


@query(f"select {_PART} as path, cast(least(p_size, 3) as bigint) as n from part")
def error_budget(spark, sf_dir):
    """RUN-08: at most three findings of a rule in a file."""
    found = lint(_generated(spark, sf_dir, F.repeat(F.lit("var a;\n"), F.col("p_size"))), {"preset": False, "rules": {"no-var": 2}}, budget=3)
    return found.groupBy("path").agg(F.count("*").alias("n"))


@query(f"select {_PART} as path, cast(p_size as bigint) as n, cast(8 * p_size - 1 as int) as last_start from part")
def comments_in_range(spark, sf_dir):
    """JN-14: comments inside a function, by the intervals of places."""
    from lintmill.operators.places import comments_inside_files

    source = F.concat(F.lit("() =>{"), F.repeat(F.lit(" /* c */"), F.col("p_size")), F.lit("}"))
    functions = ["ArrowFunctionExpression"]
    found = comments_inside_files(parse_files(_generated(spark, sf_dir, source), ("nodes", "comments"), types=frozenset(functions)), functions)
    return found.groupBy("path").agg(F.count("*").alias("n"), F.max("start").cast("int").alias("last_start"))


@query(f"select {_PART} as path, 'no-var' as rule, cast(2 as int) as line from part where p_size % 2 = 1")
def rule_ir_no_var(spark, sf_dir):
    """UDF-05: a rule that is data, run by the engine with its suppression comments."""
    from lintmill.operators import rule_ir
    from lintmill.operators.tree_rules import RULES

    name = rule_ir.register({"name": "no-var-as-data", "messages": {"m": "No var."}, "handlers": [{"selector": "VariableDeclaration", "body": [{"op": "if", "cond": {"op": "binary", "operator": "===", "left": {"op": "member", "object": {"op": "node-ref"}, "property": "kind"}, "right": {"op": "literal", "value": "var"}}, "then": [{"op": "report", "messageId": "m"}]}]}]})
    try:
        source = F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("// eslint-disable-next-line")).otherwise("// said nothing"), F.lit("\nvar a = 1"))
        return lint(_generated(spark, sf_dir, source), {"preset": False, "rules": {name: 2}}).select("path", F.lit("no-var").alias("rule"), "line")
    finally:
        del RULES[name]


@query(f"select {_PART} as path, cast(p_size % 3 as bigint) as errors from part where p_size % 3 > 0")
def invalid_regexps(spark, sf_dir):
    """FN-04: patterns read by the regular-expression reader."""
    return _regexps(spark, sf_dir, "errors")


def _regexps(spark, sf_dir, name):
    source = F.concat(F.lit("a();"), F.repeat(F.lit("new RegExp('(');"), F.col("p_size") % 3))
    found = lint(_generated(spark, sf_dir, source), {"preset": False, "rules": {"no-invalid-regexp": 2}})
    return found.groupBy("path").agg(F.count("*").alias(name))


@query(f"select {_PART} as path, 'Identifier ''a'' has already been declared.' as message from part where p_size % 3 = 0 union all select {_PART}, 'Illegal break statement.' from part where p_size % 3 = 1")
def early_errors(spark, sf_dir):
    """Early errors of scripts that declare a name twice, that jump out of nothing, and of sound ones."""
    size = F.col("p_size") % 3
    source = F.when(size == 0, F.lit("let a = 1; { let a = 2 } let a = 3")).when(size == 1, F.lit("while (a) { break } break")).otherwise(F.lit("let a = 1; a: for (;;) { break a }"))
    return lint(_generated(spark, sf_dir, source), {"preset": False, "rules": {"early-errors": 2}}).select("path", "message")


@query(f"select {_PART} as path, 'b' as name from part where p_size % 4 in (0, 2) union all select {_PART}, 'Map' from part where p_size % 4 = 3")
def global_comments(spark, sf_dir):
    """Names that a comment of the file declares or takes away, and names of an environment."""
    size = F.col("p_size") % 4
    head = F.when(size == 0, F.lit("")).when(size == 1, F.lit("/* global b, c */")).when(size == 2, F.lit("// global b")).otherwise(F.lit("/* globals b:writable, Map:off -- old */"))
    source = F.concat(head, F.lit("\nb; Map; window"))
    found = lint(_generated(spark, sf_dir, source), {"preset": False, "rules": {"no-undef": 2}, "env": {"browser": True}})
    return found.select("path", F.regexp_extract("message", "'([^']*)'", 1).alias("name"))


@query(f"select {_PART} as path, cast(3 + 3 * (p_size % 5) as int) as \"start\", cast(8 + 3 * (p_size % 5) as int) as \"end\", cast(3 + 3 * (p_size % 5) as int) as col from part")
def places_in_utf16(spark, sf_dir):
    """Places counted as editors count them: one character beyond the first plane is two units."""
    from lintmill.operators.report import utf16

    scripts = _generated(spark, sf_dir, F.concat(F.lit("'"), F.repeat(F.lit("\U0001f44d\u00e9"), F.col("p_size") % 5), F.lit("';var a")))
    return utf16(lint(scripts, {"preset": False, "rules": {"no-var": 2}}), scripts).select("path", "start", "end", "col")


@query(f"select {_PART} as path, 'var a = ' || p_size as before, 'let a = ' || p_size as after from part where p_size % 2 = 0")
def fix_preview(spark, sf_dir):
    """What fixes would change, with nothing written."""
    from lintmill.operators.lint import fix_preview as preview

    source = F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("var")).otherwise(F.lit("let")), F.lit(" a = "), F.col("p_size").cast("string"))
    return preview(_generated(spark, sf_dir, source), {"preset": False, "rules": {"no-var": 2}})


@query(
    "select 'part/' || p.p_partkey || '.ts' as path, case when q.p_partkey is not null then 'part/' || q.p_partkey || '.ts' end as target, "
    "case when q.p_partkey is not null then q.p_size % 3 = 0 end as found, case when q.p_size % 3 = 0 then 'const' end as kind from part p left join part q on q.p_partkey = p.p_partkey - 1"
)
def import_join(spark, sf_dir):
    """JN-19, SRC-13: a name that the file before is asked for, which every third size exports."""
    from lintmill.operators.modules import join_imports

    before = F.format_string("import { x0 as y } from '../part/./%d'; ", F.col("p_partkey") - 1)
    scripts = _generated(spark, sf_dir, F.concat(before, F.format_string("export const x%d = 1, [z] = y;", F.col("p_size") % 3)))
    return join_imports(parse_files(scripts, ("nodes", "symbols", "scopes"))).select("path", "target", "found", "kind")


_families()
