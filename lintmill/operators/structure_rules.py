"""Rules that need more than one row: joins of references and bindings, windows over siblings, comments and lines.

Each rule is a function of ``Tables`` that gives (path, rule, node_id, line, col, start, end, attrs).
Joins are within a file, on the path with an id, so tables partitioned by path need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.operators.directives import global_comments
from lintmill.operators.selectors import FUNCTIONS, attribute, select
from lintmill.plans.parsed import Tables
from lintmill.plans.parsed import keep as kept

RULES: dict[str, tuple[str, str, Callable[[Tables], DataFrame]]] = {}
OUT = ("path", "rule", "node_id", "line", "col", "start", "end", "attrs")

# Names every script knows, names that must not be bound, loop nodes.
GLOBALS = (
    "Array ArrayBuffer Atomics BigInt BigInt64Array BigUint64Array Boolean DataView Date Error EvalError Float32Array Float64Array Function Infinity Int16Array Int32Array Int8Array Intl JSON Map Math NaN Number Object Promise Proxy RangeError ReferenceError Reflect RegExp Set SharedArrayBuffer String Symbol SyntaxError TypeError URIError Uint16Array Uint32Array Uint8Array Uint8ClampedArray WeakMap WeakRef WeakSet AggregateError FinalizationRegistry "
    "decodeURI decodeURIComponent encodeURI encodeURIComponent escape eval globalThis isFinite isNaN parseFloat parseInt undefined unescape arguments"
).split()
# Names that came with a version of the language, names that an environment adds.
SINCE = {
    2015: "Map Set WeakMap WeakSet Promise Proxy Reflect Symbol ArrayBuffer DataView Float32Array Float64Array Int8Array Int16Array Int32Array Uint8Array Uint16Array Uint32Array Uint8ClampedArray".split(),
    2017: ["Atomics", "SharedArrayBuffer"],
    2020: ["BigInt", "BigInt64Array", "BigUint64Array", "globalThis"],
    2021: ["AggregateError", "FinalizationRegistry", "WeakRef"],
}
ENVIRONMENTS = {
    "browser": "window document navigator location history console fetch localStorage sessionStorage setTimeout clearTimeout setInterval clearInterval alert confirm prompt URL URLSearchParams Event EventTarget CustomEvent HTMLElement Element Node XMLHttpRequest WebSocket Worker Blob File FormData Headers Request Response AbortController AbortSignal TextEncoder TextDecoder requestAnimationFrame cancelAnimationFrame queueMicrotask structuredClone performance crypto self".split(),
    "node": "process Buffer global console require module exports __dirname __filename setTimeout clearTimeout setInterval clearInterval setImmediate clearImmediate queueMicrotask structuredClone fetch URL URLSearchParams TextEncoder TextDecoder AbortController AbortSignal performance".split(),
    "commonjs": "require module exports".split(),
    "worker": "self postMessage importScripts onmessage console fetch setTimeout clearTimeout setInterval clearInterval".split(),
    "jest": "describe it test expect beforeAll beforeEach afterAll afterEach jest".split(),
    "mocha": "describe it before beforeEach after afterEach".split(),
}


def known_globals(config: dict | None = None) -> list[str]:
    """Built-in names of ``ecmaVersion`` (6 and 2015 are the same; all by default), and of each ``env``, and ``globals``, less those set to off."""
    config = config or {}
    version = config.get("ecmaVersion", "latest")
    year = 9999 if not isinstance(version, int) else version if version >= 2015 else version + 2009
    found = set(GLOBALS) - {n for since, names in SINCE.items() if since > year for n in names}
    for name, on in config.get("env", {}).items():
        found |= set(ENVIRONMENTS.get(name, ())) if on else set()
    for name, value in config.get("globals", {}).items():
        found = found - {name} if value == "off" else found | {name}
    return sorted(found)


READ_ONLY = [g for g in GLOBALS if g != "arguments"]
RESTRICTED = ("undefined", "NaN", "Infinity", "arguments", "eval")
LOOPS = ("ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoWhileStatement")
JUMPS = ("ReturnStatement", "ThrowStatement", "BreakStatement", "ContinueStatement")
LONE = ("Property", "MethodDefinition", "PropertyDefinition")


def rule(name: str, category: str, message: str):
    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        RULES[name] = (category, message, lambda t: _out(f(t), name))
        return f

    return keep


def _out(df: DataFrame, name: str) -> DataFrame:
    has = set(df.columns)
    columns = {"rule": F.lit(name), "node_id": F.col("node_id") if "node_id" in has else F.lit(None).cast("int"), "attrs": F.col("attrs") if "attrs" in has else F.create_map(F.lit("name"), F.col("name")) if "name" in has else F.create_map().cast("map<string,string>")}
    return df.select(*[columns.get(c, F.col(c)).alias(c) for c in OUT])


def _bound(t: Tables) -> DataFrame:
    """Write references with their binding, (path, ..., s_kind)."""
    s = t.symbols.select("path", "symbol_id", F.col("kind").alias("s_kind"), F.col("scope_id").alias("s_scope"), F.col("start").alias("s_start"))
    return t.refs.where(F.col("symbol_id").isNotNull()).join(s, ["path", "symbol_id"])


def _writes(t: Tables, *kinds: str) -> DataFrame:
    return _bound(t).where(F.col("is_write") & ~F.col("is_init") & F.col("s_kind").isin(*kinds))


@rule("no-undef", "correctness", "'{{name}}' is not defined.")
def no_undef(t: Tables) -> DataFrame:
    typeof = select(t.nodes, 'UnaryExpression[operator="typeof"] > Identifier').select("path", "node_id")
    free = t.refs.where(F.col("symbol_id").isNull()).join(typeof, ["path", "node_id"], "left_anti")
    return free.join(global_comments(t.comments), ["path", "name"], "left").where(~F.coalesce("known", F.col("name").isin(*(t.globals if t.globals is not None else GLOBALS)))).drop("known")


@rule("no-unused-vars", "correctness", "'{{name}}' is defined but never used.")
def no_unused_vars(t: Tables) -> DataFrame:
    read = t.refs.where("is_read and symbol_id is not null").select("path", "symbol_id").distinct()
    exported = t.nodes.where("type like 'Export%'").select(F.col("path").alias("e_path"), F.col("start").alias("e_start"), F.col("end").alias("e_end"), "depth")
    shown = t.symbols.where("scope_id = 0").join(exported, (F.col("path") == F.col("e_path")) & (F.col("start") >= F.col("e_start")) & (F.col("end") <= F.col("e_end")), "left_semi").select("path", "symbol_id")
    return t.symbols.where(~F.col("kind").isin("param", "catch", "function-name", "type")).where("not (kind = 'class' and scope_id > 0)").join(read, ["path", "symbol_id"], "left_anti").join(shown, ["path", "symbol_id"], "left_anti")


@rule("no-const-assign", "correctness", "'{{name}}' is constant.")
def no_const_assign(t: Tables) -> DataFrame:
    return _writes(t, "const")


@rule("no-func-assign", "correctness", "'{{name}}' is a function.")
def no_func_assign(t: Tables) -> DataFrame:
    return _writes(t, "function", "function-name")


@rule("no-class-assign", "correctness", "'{{name}}' is a class.")
def no_class_assign(t: Tables) -> DataFrame:
    return _writes(t, "class")


@rule("no-ex-assign", "correctness", "Do not assign to the exception parameter.")
def no_ex_assign(t: Tables) -> DataFrame:
    return _writes(t, "catch")


@rule("no-import-assign", "correctness", "'{{name}}' is read-only.")
def no_import_assign(t: Tables) -> DataFrame:
    return _writes(t, "import")


@rule("no-param-reassign", "suspicious", "Assignment to function parameter '{{name}}'.")
def no_param_reassign(t: Tables) -> DataFrame:
    return _writes(t, "param")


@rule("no-global-assign", "style", "Read-only global '{{name}}' should not be modified.")
def no_global_assign(t: Tables) -> DataFrame:
    return t.refs.where(F.col("symbol_id").isNull() & F.col("is_write") & F.col("name").isin(*READ_ONLY))


@rule("prefer-const", "style", "'{{name}}' is never reassigned. Use 'const' instead.")
def prefer_const(t: Tables) -> DataFrame:
    again = t.refs.where("is_write and not is_init and symbol_id is not null").select("path", "symbol_id")
    return t.symbols.where("kind = 'let' and has_init").join(again, ["path", "symbol_id"], "left_anti")


@rule("no-unassigned-vars", "correctness", "'{{name}}' is always 'undefined' because it's never assigned.")
def no_unassigned_vars(t: Tables) -> DataFrame:
    use = t.refs.where("symbol_id is not null").groupBy("path", "symbol_id").agg(F.max("is_write").alias("written"), F.max("is_read").alias("read"))
    return t.symbols.where("kind in ('let','var') and not has_init").join(use.where("read and not written"), ["path", "symbol_id"], "left_semi")


@rule("no-redeclare", "suspicious", "'{{name}}' is already defined.")
def no_redeclare(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "scope_id", "name").orderBy("start")
    return t.symbols.where("kind in ('var','function','param','let','const','class')").withColumn("nth", F.row_number().over(w)).where("nth > 1 and kind <> 'param'")


@rule("no-dupe-args", "correctness", "Duplicate param '{{name}}'.")
def no_dupe_args(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "scope_id", "name").orderBy("start")
    return t.symbols.where("kind = 'param'").withColumn("nth", F.row_number().over(w)).where("nth > 1")


@rule("no-shadow-restricted-names", "correctness", "Shadowing of global property '{{name}}'.")
def no_shadow_restricted_names(t: Tables) -> DataFrame:
    return t.symbols.where(F.col("name").isin(*RESTRICTED))


def scope_ancestors(scopes: DataFrame) -> DataFrame:
    """(path, scope_id, above): every strict ancestor of each scope, by doubling the parent join."""
    closure = kept(scopes.where("parent_scope is not null").select("path", "scope_id", F.col("parent_scope").alias("above"), F.lit(1).alias("up")))
    reach = 1  # paths of up to so many steps are known; each round doubles them, and each is found once, at its own length
    while (closure.agg(F.max("up")).first()[0] or 0) == reach:
        far = closure.where(F.col("up") == reach).select("path", F.col("scope_id").alias("from"), F.col("above").alias("scope_id"))
        onward = far.join(closure, ["path", "scope_id"]).select("path", F.col("from").alias("scope_id"), "above", (F.col("up") + reach).alias("up"))
        closure = kept(closure.unionByName(onward))
        reach *= 2
    closure = closure.select("path", "scope_id", "above")
    return closure


@rule("no-shadow", "suspicious", "'{{name}}' is already declared in the upper scope.")
def no_shadow(t: Tables) -> DataFrame:
    outer = t.symbols.where("kind <> 'type'").select("path", "name", F.col("scope_id").alias("above"), F.col("start").alias("o_start"), F.col("kind").alias("o_kind")).distinct()
    inner = t.symbols.where("kind not in ('type','function-name')").where("not (kind = 'class' and scope_id > 0)")
    pairs = inner.join(scope_ancestors(t.scopes), ["path", "scope_id"]).join(outer, ["path", "name", "above"]).where("o_start < start or o_kind = 'function'")
    return pairs.dropDuplicates(["path", "symbol_id"])


@rule("no-use-before-define", "correctness", "'{{name}}' was used before it was defined.")
def no_use_before_define(t: Tables) -> DataFrame:
    return _bound(t).where("start < s_start and not is_init and s_kind in ('var','let','const','class','function')")


@rule("prefer-rest-params", "correctness", "Use the rest parameters instead of 'arguments'.")
def prefer_rest_params(t: Tables) -> DataFrame:
    members = select(t.nodes, 'MemberExpression[computed="false"] > Identifier.object[name="arguments"]').select("path", "node_id")
    return t.refs.where("symbol_id is null and name = 'arguments'").join(members, ["path", "node_id"], "left_anti")


def no_restricted_globals(t: Tables, names: tuple[str, ...]) -> DataFrame:
    """References to the named globals; an option of the caller, so not in the table of rules."""
    return _out(t.refs.where(F.col("symbol_id").isNull() & F.col("name").isin(*names)), "no-restricted-globals")


def _key() -> Column:
    return F.coalesce(attribute("key.name"), attribute("key.value"))


def _members(t: Tables) -> DataFrame:
    own = t.nodes.where(F.col("type").isin(*LONE) & F.col("slot").isin("properties", "body") & (F.coalesce(attribute("computed"), F.lit("false")) == "false"))
    return own.withColumn("key", _key()).withColumn("static", F.coalesce(attribute("static"), F.lit("false"))).withColumn("kind", F.coalesce(attribute("kind"), F.lit("init"))).withColumn("name", F.col("key")).where(F.col("key").isNotNull())


def _twice(members: DataFrame) -> DataFrame:
    """Later members of one key that clash: a getter and a setter go together, all else does not."""
    w = W.partitionBy("path", "parent_id", "key", "static").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.collect_set("kind").over(w)
    clash = F.when(F.col("kind") == "get", F.exists(earlier, lambda k: k != "set")).when(F.col("kind") == "set", F.exists(earlier, lambda k: k != "get")).otherwise(F.size(earlier) > 0)
    return members.withColumn("clash", clash).where("clash")


@rule("no-dupe-keys", "correctness", "Duplicate key '{{name}}'.")
def no_dupe_keys(t: Tables) -> DataFrame:
    return _twice(_members(t).where("type = 'Property' and parent_type = 'ObjectExpression'")).drop("attrs")


@rule("no-dupe-class-members", "correctness", "Duplicate name '{{name}}'.")
def no_dupe_class_members(t: Tables) -> DataFrame:
    return _twice(_members(t).where("parent_type = 'ClassBody' and type <> 'Property'").where("coalesce(attrs['value.type'], '') <> 'TSEmptyBodyFunctionExpression'")).drop("attrs")


@rule("accessor-pairs", "correctness", "Getter is not present.")
def accessor_pairs(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "parent_id", "key", "static")
    return _members(t).withColumn("gets", F.max(F.col("kind") == "get").over(w)).where("kind = 'set' and not gets").drop("attrs")


@rule("grouped-accessor-pairs", "style", "Accessor pair should be grouped.")
def grouped_accessor_pairs(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "parent_id", "key", "static").orderBy("ord")
    pairs = _members(t).where("kind in ('get','set')")
    return pairs.withColumn("before", F.lag("ord").over(w)).where("before is not null and ord > before + 1").drop("attrs")


@rule("sort-keys", "style", "Expected object keys to be in ascending order.")
def sort_keys(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "parent_id").orderBy("ord")
    return _members(t).where("parent_type = 'ObjectExpression'").withColumn("before", F.lag("key").over(w)).where("before > key").drop("attrs")


@rule("sort-vars", "style", "Variables within the same declaration block should be sorted alphabetically.")
def sort_vars(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "parent_id").orderBy("ord")
    named = t.nodes.where("type = 'VariableDeclarator'").withColumn("name", attribute("id.name")).where("name is not null")
    return named.withColumn("before", F.lag("name").over(w)).where("before > name").drop("attrs")


@rule("no-duplicate-case", "correctness", "Duplicate case label.")
def no_duplicate_case(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "parent_id", "label").orderBy("ord")
    return t.nodes.where("type = 'SwitchCase'").withColumn("label", attribute("test.text")).where("label is not null").withColumn("nth", F.row_number().over(w)).where("nth > 1")


@rule("no-duplicate-imports", "correctness", "'{{source.value}}' import is duplicated.")
def no_duplicate_imports(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "source").orderBy("start")
    return t.nodes.where("type = 'ImportDeclaration'").withColumn("source", attribute("source.value")).withColumn("nth", F.row_number().over(w)).where("nth > 1")


@rule("no-duplicate-enum-values", "typescript", "Duplicate enum member value {{initializer.raw}}.")
def no_duplicate_enum_values(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "parent_id", "value").orderBy("ord")
    return t.nodes.where("type = 'TSEnumMember'").withColumn("value", attribute("initializer.raw")).where("value is not null").withColumn("nth", F.row_number().over(w)).where("nth > 1")


@rule("default-case", "style", "Expected a default case.")
def default_case(t: Tables) -> DataFrame:
    default = t.nodes.where(F.col("type") == "SwitchCase").where(attribute("test.type").isNull()).select("path", F.col("parent_id").alias("node_id"))
    return t.nodes.where("type = 'SwitchStatement' and coalesce(attrs['cases.length'], '0') <> '0'").join(default, ["path", "node_id"], "left_anti")


@rule("default-case-last", "style", "Default clause should be the last clause.")
def default_case_last(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "parent_id")
    return t.nodes.where("type = 'SwitchCase'").withColumn("last", F.max("ord").over(w)).where(attribute("test.type").isNull() & (F.col("ord") < F.col("last")))


@rule("default-param-last", "style", "Default parameters should be last.")
def default_param_last(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "parent_id").orderBy("ord").rowsBetween(1, W.unboundedFollowing)
    params = t.nodes.where(F.col("slot") == "params").where(F.col("parent_type").isin(*FUNCTIONS))
    return params.withColumn("plain_after", F.max((~F.col("type").isin("AssignmentPattern", "RestElement")).cast("int")).over(w)).where("type = 'AssignmentPattern' and plain_after = 1")


@rule("max-classes-per-file", "style", "File has too many classes. Maximum allowed is 1.")
def max_classes_per_file(t: Tables) -> DataFrame:
    w = W.partitionBy("path").orderBy("start")
    return t.nodes.where("type in ('ClassDeclaration','ClassExpression')").withColumn("nth", F.row_number().over(w)).where("nth = 2")


def nearest(nodes: DataFrame, what: DataFrame, stops: Column) -> DataFrame:
    """``what`` with the nearest strict ancestor that satisfies ``stops``: a_type, a_id, a_slot, a_parent_type, a_attrs; null if none."""
    above = nodes.where(stops).select(F.col("path").alias("a_path"), F.col("node_id").alias("a_id"), F.col("last_id").alias("a_last"), F.struct("depth", F.col("node_id").alias("a_id"), F.col("type").alias("a_type"), F.col("slot").alias("a_slot"), F.col("parent_type").alias("a_parent_type"), F.col("parent_id").alias("a_parent")).alias("a"))
    joined = what.join(above, (F.col("path") == F.col("a_path")) & (F.col("node_id") > F.col("a_id")) & (F.col("node_id") <= F.col("a_last")), "left")
    keys = [c for c in what.columns if c != "attrs"]
    found = joined.groupBy(*keys).agg(F.max("a").alias("a"), F.first("attrs").alias("attrs"))
    return found.select(*keys, "attrs", "a.a_id", "a.a_type", "a.a_slot", "a.a_parent_type", "a.a_parent")


def _boundary() -> Column:
    return F.col("type").isin(*FUNCTIONS)


@rule("no-await-in-loop", "correctness", "Unexpected `await` inside a loop.")
def no_await_in_loop(t: Tables) -> DataFrame:
    stops = _boundary() | F.col("type").isin(*LOOPS)
    found = nearest(t.nodes, t.nodes.where("type = 'AwaitExpression'"), stops)
    return found.where(F.col("a_type").isin(*LOOPS) & ~((F.col("slot") == "right") & F.col("parent_type").isin("ForOfStatement", "ForInStatement")))


@rule("no-constructor-return", "correctness", "Unexpected return statement in constructor.")
def no_constructor_return(t: Tables) -> DataFrame:
    found = nearest(t.nodes, t.nodes.where("type = 'ReturnStatement' and attrs['argument.type'] is not null"), _boundary())
    makers = t.nodes.where("type = 'MethodDefinition' and attrs['kind'] = 'constructor'").select("path", F.col("node_id").alias("a_parent"))
    return found.join(makers, ["path", "a_parent"], "left_semi")


@rule("no-setter-return", "correctness", "Setter cannot return a value.")
def no_setter_return(t: Tables) -> DataFrame:
    found = nearest(t.nodes, t.nodes.where("type = 'ReturnStatement' and attrs['argument.type'] is not null"), _boundary())
    setters = t.nodes.where("type in ('MethodDefinition','Property') and attrs['kind'] = 'set'").select("path", F.col("node_id").alias("a_parent"))
    return found.join(setters, ["path", "a_parent"], "left_semi")


@rule("no-promise-executor-return", "correctness", "Return values from promise executor functions cannot be read.")
def no_promise_executor_return(t: Tables) -> DataFrame:
    found = nearest(t.nodes, t.nodes.where("type = 'ReturnStatement' and attrs['argument.type'] is not null"), _boundary())
    made = t.nodes.where("type = 'NewExpression' and attrs['callee.name'] = 'Promise'").select("path", F.col("node_id").alias("a_parent"))
    return found.where("a_slot = 'arguments'").join(made, ["path", "a_parent"], "left_semi")


@rule("no-loop-func", "correctness", "Function declared in a loop contains unsafe references to outer variables.")
def no_loop_func(t: Tables) -> DataFrame:
    made = nearest(t.nodes, t.nodes.where(_boundary()), _boundary() | F.col("type").isin(*LOOPS)).where(F.col("a_type").isin(*LOOPS)).select("path", "node_id", "line", "col", "start", "end")
    inside = _bound(t).where("s_kind in ('let','var')").select("path", "symbol_id", F.col("start").alias("r_start"), "s_start")
    changed = t.refs.where("is_write and not is_init and symbol_id is not null").select("path", "symbol_id").distinct()
    outer = inside.join(changed, ["path", "symbol_id"]).withColumnRenamed("path", "r_path")
    return made.join(outer, (F.col("path") == F.col("r_path")) & (F.col("r_start") > F.col("start")) & (F.col("r_start") < F.col("end")) & ~((F.col("s_start") >= F.col("start")) & (F.col("s_start") < F.col("end"))), "left_semi")


@rule("no-unsafe-finally", "correctness", "Unsafe usage of {{text}} in finally.")
def no_unsafe_finally(t: Tables) -> DataFrame:
    stops = _boundary() | (F.col("slot") == "finalizer") | F.col("type").isin("ClassBody")
    jumps = t.nodes.where("type in ('ReturnStatement','ThrowStatement')")
    return nearest(t.nodes, jumps, stops).where("a_slot = 'finalizer'")


@rule("require-yield", "correctness", "This generator function does not have 'yield'.")
def require_yield(t: Tables) -> DataFrame:
    yields = nearest(t.nodes, t.nodes.where("type = 'YieldExpression'"), _boundary()).select("path", F.col("a_id").alias("node_id"))
    return t.nodes.where(_boundary() & (attribute("generator") == "true") & (F.coalesce(attribute("body.body.length"), F.lit("1")) != "0")).join(yields, ["path", "node_id"], "left_anti")


@rule("require-await", "typescript", "Async function has no 'await' expression.")
def require_await(t: Tables) -> DataFrame:
    waits = nearest(t.nodes, t.nodes.where("type = 'AwaitExpression' or (type = 'ForOfStatement' and attrs['await'] = 'true')"), _boundary()).select("path", F.col("a_id").alias("node_id"))
    return t.nodes.where(_boundary() & (attribute("async") == "true") & (attribute("generator") == "false") & (F.coalesce(attribute("body.body.length"), F.lit("1")) != "0")).join(waits, ["path", "node_id"], "left_anti")


@rule("getter-return", "correctness", "Expected to return a value in getter.")
def getter_return(t: Tables) -> DataFrame:
    gives = nearest(t.nodes, t.nodes.where("type = 'ReturnStatement' and attrs['argument.type'] is not null or type = 'ThrowStatement'"), _boundary()).select("path", F.col("a_id").alias("f_id"))
    getters = t.nodes.where("type in ('MethodDefinition','Property') and attrs['kind'] = 'get'").select("path", F.col("node_id").alias("g_id"))
    bodies = t.nodes.where("type = 'FunctionExpression' and slot = 'value'").select("path", F.col("parent_id").alias("g_id"), F.col("node_id").alias("f_id"), "node_id", "line", "col", "start", "end")
    return bodies.join(getters, ["path", "g_id"], "left_semi").join(gives, ["path", "f_id"], "left_anti")


@rule("constructor-super", "correctness", "Expected to call 'super()'.")
def constructor_super(t: Tables) -> DataFrame:
    calls = nearest(t.nodes, t.nodes.where("type = 'CallExpression' and attrs['callee.type'] = 'Super'"), F.col("type") == "MethodDefinition").select("path", F.col("a_id").alias("node_id"))
    derived = t.nodes.where("type in ('ClassDeclaration','ClassExpression') and attrs['superClass.type'] is not null and coalesce(attrs['superClass.raw'], '') <> 'null'").select("path", F.col("node_id").alias("c_id"))
    bodies = t.nodes.where("type = 'ClassBody'").select("path", F.col("parent_id").alias("c_id"), F.col("node_id").alias("b_id")).join(derived, ["path", "c_id"], "left_semi")
    makers = t.nodes.where("type = 'MethodDefinition' and attrs['kind'] = 'constructor' and attrs['value.body.type'] is not null").withColumn("b_id", F.col("parent_id"))
    return makers.join(bodies.select("path", "b_id"), ["path", "b_id"], "left_semi").join(calls, ["path", "node_id"], "left_anti")


@rule("no-useless-constructor", "typescript", "Useless constructor.")
def no_useless_constructor(t: Tables) -> DataFrame:
    empty = t.nodes.where("type = 'BlockStatement' and parent_type = 'FunctionExpression' and attrs['body.length'] = '0'").select("path", F.col("parent_id").alias("f_id"))
    plain = t.nodes.where("type = 'FunctionExpression' and slot = 'value'").where("attrs['params.0.type'] is null or attrs['params.0.type'] <> 'TSParameterProperty'").select("path", F.col("node_id").alias("f_id"), F.col("parent_id").alias("node_id")).join(empty, ["path", "f_id"], "left_semi")
    derived = t.nodes.where("type in ('ClassDeclaration','ClassExpression') and attrs['superClass.type'] is not null").select("path", F.col("node_id").alias("c_id"))
    kept = t.nodes.where("type = 'ClassBody'").select("path", F.col("node_id").alias("b_id"), F.col("parent_id").alias("c_id")).join(derived, ["path", "c_id"], "left_anti").select("path", "b_id")
    makers = t.nodes.where("type = 'MethodDefinition' and attrs['kind'] = 'constructor'").withColumn("b_id", F.col("parent_id"))
    return makers.join(plain.select("path", "node_id"), ["path", "node_id"], "left_semi").join(kept, ["path", "b_id"], "left_semi")


@rule("no-unreachable", "correctness", "Unreachable code.")
def no_unreachable(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "parent_id", "slot").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    listed = t.nodes.where("(slot = 'body' and parent_type in ('BlockStatement','Program','StaticBlock')) or (slot = 'consequent' and parent_type = 'SwitchCase')")
    after = listed.withColumn("jumps", F.sum(F.col("type").isin(*JUMPS).cast("int")).over(w))
    return after.where("jumps = 1").where("type not in ('FunctionDeclaration','EmptyStatement')").where("not (type = 'VariableDeclaration' and attrs['kind'] = 'var' and attrs['declarations.0.init.type'] is null)").withColumn("nth", F.row_number().over(W.partitionBy("path", "parent_id", "slot").orderBy("ord"))).where("nth = 1")


@rule("no-fallthrough", "correctness", "Expected a 'break' statement before 'case'.")
def no_fallthrough(t: Tables) -> DataFrame:
    ends = t.nodes.where("parent_type = 'SwitchCase' and slot = 'consequent'").groupBy("path", F.col("parent_id").alias("node_id")).agg(F.max_by("type", "ord").alias("last_type"), F.max("end").alias("c_end"))
    cases = t.nodes.where("type = 'SwitchCase'").join(ends, ["path", "node_id"], "left")
    w = W.partitionBy("path", "parent_id").orderBy("ord")
    gaps = cases.withColumn("before", F.lag("last_type").over(w)).withColumn("gap", F.lag("c_end").over(w)).where(F.col("before").isNotNull() & ~F.col("before").isin(*JUMPS, "BlockStatement", "IfStatement", "TryStatement", "SwitchStatement"))
    said = t.comments.where(F.lower("text").rlike(r"falls?\s?through")).select(F.col("path").alias("s_path"), F.col("start").alias("s_start"))
    return gaps.join(said, (F.col("path") == F.col("s_path")) & (F.col("s_start") >= F.col("gap")) & (F.col("s_start") < F.col("start")), "left_anti")


def _without_comment(t: Tables, nodes: DataFrame) -> DataFrame:
    said = t.comments.select(F.col("path").alias("s_path"), F.col("start").alias("s_start"))
    return nodes.join(said, (F.col("path") == F.col("s_path")) & (F.col("s_start") >= F.col("start")) & (F.col("s_start") < F.col("end")), "left_anti")


@rule("no-empty", "correctness", "Empty block statement.")
def no_empty(t: Tables) -> DataFrame:
    blocks = t.nodes.where(~F.col("parent_type").isin(*FUNCTIONS)).where("(type = 'BlockStatement' and attrs['body.length'] = '0') or (type = 'SwitchStatement' and attrs['cases.length'] = '0')")
    return _without_comment(t, blocks)


@rule("no-empty-function", "style", "Unexpected empty function.")
def no_empty_function(t: Tables) -> DataFrame:
    return _without_comment(t, t.nodes.where(F.col("parent_type").isin(*FUNCTIONS)).where("type = 'BlockStatement' and slot = 'body' and attrs['body.length'] = '0'"))


@rule("no-empty-static-block", "correctness", "Unexpected empty static block.")
def no_empty_static_block(t: Tables) -> DataFrame:
    return _without_comment(t, t.nodes.where("type = 'StaticBlock' and attrs['body.length'] = '0'"))


@rule("no-lonely-if", "style", "Unexpected if as the only statement in an else block.")
def no_lonely_if(t: Tables) -> DataFrame:
    return select(t.nodes, 'IfStatement > BlockStatement.alternate[body.length="1"] > IfStatement')


@rule("no-else-return", "style", "Unnecessary 'else' after 'return'.")
def no_else_return(t: Tables) -> DataFrame:
    returns = t.nodes.where("type = 'ReturnStatement' and parent_type = 'IfStatement' and slot = 'consequent'").select("path", F.col("parent_id").alias("i_id"))
    w = W.partitionBy("path", "parent_id")
    last = t.nodes.where("parent_type = 'BlockStatement' and slot = 'body'").withColumn("last", F.max("ord").over(w)).where("ord = last and type = 'ReturnStatement'").select("path", F.col("parent_id").alias("node_id"))
    block = t.nodes.where("type = 'BlockStatement' and parent_type = 'IfStatement' and slot = 'consequent'").join(last, ["path", "node_id"], "left_semi").select("path", F.col("parent_id").alias("i_id"))
    done = returns.unionByName(block)
    other = t.nodes.where("parent_type = 'IfStatement' and slot = 'alternate'").withColumn("i_id", F.col("parent_id"))
    return other.join(done, ["path", "i_id"], "left_semi")


@rule("no-useless-catch", "correctness", "Unnecessary catch clause.")
def no_useless_catch(t: Tables) -> DataFrame:
    first = t.nodes.where("type = 'ThrowStatement' and slot = 'body' and ord = 0").select("path", F.col("parent_id").alias("b_id"), attribute("argument.name").alias("thrown"))
    bodies = t.nodes.where("type = 'BlockStatement' and parent_type = 'CatchClause'").select("path", F.col("node_id").alias("b_id"), F.col("parent_id").alias("node_id")).join(first, ["path", "b_id"]).select("path", "node_id", "thrown")
    return t.nodes.where("type = 'CatchClause' and attrs['param.name'] is not null").join(bodies, ["path", "node_id"]).where("thrown = attrs['param.name']")


@rule("no-unused-labels", "suspicious", "'{{label.name}}:' is defined but never used.")
def no_unused_labels(t: Tables) -> DataFrame:
    uses = t.nodes.where("type in ('BreakStatement','ContinueStatement') and attrs['label.name'] is not null").select(F.col("path").alias("u_path"), F.col("node_id").alias("u_id"), attribute("label.name").alias("used"))
    return t.nodes.where("type = 'LabeledStatement'").join(uses, (F.col("path") == F.col("u_path")) & (F.col("u_id") > F.col("node_id")) & (F.col("u_id") <= F.col("last_id")) & (F.col("used") == attribute("label.name")), "left_anti")


@rule("no-label-var", "correctness", "Found identifier with same name as label.")
def no_label_var(t: Tables) -> DataFrame:
    names = t.symbols.select("path", F.col("name").alias("bound")).distinct()
    return t.nodes.where("type = 'LabeledStatement'").withColumn("bound", attribute("label.name")).join(names, ["path", "bound"], "left_semi")


@rule("no-unused-private-class-members", "correctness", "'{{name}}' is defined but never used.")
def no_unused_private_class_members(t: Tables) -> DataFrame:
    uses = t.nodes.where("type = 'PrivateIdentifier' and slot <> 'key'").select("path", attribute("name").alias("name")).distinct()
    return t.nodes.where("type = 'PrivateIdentifier' and slot = 'key'").withColumn("name", attribute("name")).join(uses, ["path", "name"], "left_anti").drop("attrs")


@rule("for-direction", "correctness", "The update clause in this loop moves the variable in the wrong direction.")
def for_direction(t: Tables) -> DataFrame:
    up, down = "attrs['test.operator'] in ('<','<=')", "attrs['test.operator'] in ('>','>=')"
    return t.nodes.where(f"type = 'ForStatement' and attrs['test.left.name'] = attrs['update.argument.name'] and (({up} and attrs['update.operator'] = '--') or ({down} and attrs['update.operator'] = '++'))")


@rule("max-depth", "style", "Blocks are nested too deeply. Maximum allowed is 4.")
def max_depth(t: Tables) -> DataFrame:
    kinds = ("IfStatement", "SwitchStatement", "TryStatement", *LOOPS)
    deep = t.nodes.where(F.col("type").isin(*kinds) & ~((F.col("parent_type") == "IfStatement") & (F.col("slot") == "alternate")))
    above = deep.select(F.col("path").alias("a_path"), F.col("node_id").alias("a_id"), F.col("last_id").alias("a_last"))
    keys = ("path", "node_id", "line", "col", "start", "end")
    return deep.join(above, (F.col("path") == F.col("a_path")) & (F.col("node_id") > F.col("a_id")) & (F.col("node_id") <= F.col("a_last"))).groupBy(*keys).agg(F.count("*").alias("levels")).where("levels >= 4")


@rule("max-statements", "style", "Function has too many statements. Maximum allowed is 10.")
def max_statements(t: Tables) -> DataFrame:
    own = nearest(t.nodes, t.nodes.where("slot in ('body','consequent') and parent_type in ('BlockStatement','SwitchCase')"), _boundary()).groupBy("path", F.col("a_id").alias("node_id")).agg(F.count("*").alias("statements")).where("statements > 10 and node_id is not null")
    return t.nodes.join(own, ["path", "node_id"], "left_semi")


@rule("complexity", "style", "Function has too high a complexity. Maximum allowed is 20.")
def complexity(t: Tables) -> DataFrame:
    branches = t.nodes.where(F.col("type").isin("IfStatement", "ConditionalExpression", "LogicalExpression", "CatchClause", *LOOPS) | ((F.col("type") == "SwitchCase") & attribute("test.type").isNotNull()))
    own = nearest(t.nodes, branches, _boundary()).groupBy("path", F.col("a_id").alias("node_id")).agg((F.count("*") + 1).alias("paths")).where("paths > 20 and node_id is not null")
    return t.nodes.join(own, ["path", "node_id"], "left_semi")


@rule("no-inner-declarations", "suspicious", "Move function declaration to function body root.")
def no_inner_declarations(t: Tables) -> DataFrame:
    blocks = t.nodes.where("type = 'BlockStatement'").where(~F.col("parent_type").isin(*FUNCTIONS)).select("path", F.col("node_id").alias("b_id"))
    return t.nodes.where("type = 'FunctionDeclaration' and parent_type = 'BlockStatement'").withColumn("b_id", F.col("parent_id")).join(blocks, ["path", "b_id"], "left_semi")


@rule("no-unused-expressions", "suspicious", "Expected an assignment or function call and instead saw an expression.")
def no_unused_expressions(t: Tables) -> DataFrame:
    return t.nodes.where("type = 'ExpressionStatement' and attrs['directive'] is null and attrs['expression.type'] in ('Identifier','Literal','BinaryExpression','MemberExpression','TemplateLiteral','ConditionalExpression','LogicalExpression','ArrowFunctionExpression','FunctionExpression','ObjectExpression','ArrayExpression','ThisExpression') or type = 'ExpressionStatement' and attrs['expression.type'] = 'UnaryExpression' and attrs['expression.operator'] not in ('delete','void')")


@rule("adjacent-overload-signatures", "typescript", "All {{name}} signatures should be adjacent.")
def adjacent_overload_signatures(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "parent_id", "name").orderBy("ord")
    named = t.nodes.where("type in ('TSMethodSignature','MethodDefinition') and slot = 'body'").withColumn("name", _key())
    return named.where("name is not null").withColumn("before", F.lag("ord").over(w)).where("before is not null and ord > before + 1").drop("attrs")


@rule("no-duplicate-type-constituents", "typescript", "Union type constituent is duplicated.")
def no_duplicate_type_constituents(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "parent_id", "said").orderBy("ord")
    return t.nodes.where("parent_type in ('TSUnionType','TSIntersectionType')").withColumn("said", attribute("text")).withColumn("nth", F.row_number().over(w)).where("nth > 1 and said is not null")


@rule("no-redundant-type-constituents", "typescript", "'{{text}}' overrides all other types in this union type.")
def no_redundant_type_constituents(t: Tables) -> DataFrame:
    return t.nodes.where("parent_type = 'TSUnionType' and type in ('TSAnyKeyword','TSUnknownKeyword','TSNeverKeyword') or parent_type = 'TSIntersectionType' and type in ('TSAnyKeyword','TSNeverKeyword','TSUnknownKeyword')")


@rule("sort-type-constituents", "typescript", "Union type constituents must be sorted.")
def sort_type_constituents(t: Tables) -> DataFrame:
    w = W.partitionBy("path", "parent_id").orderBy("ord")
    return t.nodes.where("parent_type in ('TSUnionType','TSIntersectionType')").withColumn("said", F.lower(attribute("text"))).withColumn("before", F.lag("said").over(w)).where("before > said")


# -- comments and lines -----------------------------------------------------------------------


@rule("no-warning-comments", "suspicious", "Unexpected 'todo' comment.")
def no_warning_comments(t: Tables) -> DataFrame:
    return t.comments.where(F.lower(F.trim("text")).rlike(r"^[*\s]*(todo|fixme|xxx)\b"))


@rule("no-inline-comments", "style", "Unexpected comment inline with code.")
def no_inline_comments(t: Tables) -> DataFrame:
    code = t.tokens.select("path", "line").distinct()
    return t.comments.join(code, ["path", "line"], "left_semi")


@rule("capitalized-comments", "style", "Comments should not begin with a lowercase character.")
def capitalized_comments(t: Tables) -> DataFrame:
    return t.comments.where(F.trim("text").rlike(r"^\p{Ll}") & ~F.trim("text").rlike(r"^(?:eslint|jshint|jslint|istanbul|global|globals|exported|jscs|ts-|https?:)"))


@rule("ban-ts-comment", "typescript", "Do not use '@ts-' comments because they alter compilation errors.")
def ban_ts_comment(t: Tables) -> DataFrame:
    return t.comments.where(F.col("text").rlike(r"^/*\s*@ts-(?:ignore|nocheck)|^/*\s*@ts-expect-error\s*$"))


@rule("ban-tslint-comment", "typescript", "tslint comment detected.")
def ban_tslint_comment(t: Tables) -> DataFrame:
    return t.comments.where(F.col("text").rlike(r"^\s*tslint:(?:enable|disable)"))


@rule("prefer-ts-expect-error", "typescript", "Use '@ts-expect-error' instead of '@ts-ignore'.")
def prefer_ts_expect_error(t: Tables) -> DataFrame:
    return t.comments.where(F.col("text").rlike(r"^/*\s*@ts-ignore"))


@rule("triple-slash-reference", "typescript", "Do not use a triple slash reference.")
def triple_slash_reference(t: Tables) -> DataFrame:
    return t.comments.where("kind = 'Line'").where(F.col("text").rlike(r"^/\s*<reference\s+(?:path|types|lib)="))


def lines(files: DataFrame) -> DataFrame:
    """(path, line from 1, text, start) of every line, with or without a carriage return at its end."""
    cut = files.select("path", F.posexplode(F.split("source", "\n")).alias("i", "text"), "source")
    return cut.select("path", (F.col("i") + 1).alias("line"), "text")


def _line_hits(t: Tables, test: Column, place: Column) -> DataFrame:
    hit = lines(t.files).where(test)
    return hit.select("path", "line", place.cast("int").alias("col"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))


@rule("no-tabs", "style", "Unexpected tab character.")
def no_tabs(t: Tables) -> DataFrame:
    return _line_hits(t, F.instr("text", "\t") > 0, F.instr("text", "\t") - 1)


@rule("no-trailing-spaces", "style", "Trailing spaces not allowed.")
def no_trailing_spaces(t: Tables) -> DataFrame:
    return _line_hits(t, F.col("text").rlike(r"[ \t]+\r?$"), F.length(F.regexp_replace("text", r"[ \t]+\r?$", "")))


@rule("no-irregular-whitespace", "correctness", "Irregular whitespace not allowed.")
def no_irregular_whitespace(t: Tables) -> DataFrame:
    odd = r"[\u000B\u000C \u0085 ᠎ -​  　﻿]"
    return _line_hits(t, F.col("text").rlike(odd), F.expr(f"regexp_instr(text, '{odd}')") - 1)


@rule("linebreak-style", "style", "Expected linebreaks to be 'LF' but found 'CRLF'.")
def linebreak_style(t: Tables) -> DataFrame:
    return _line_hits(t, F.col("text").endswith("\r"), F.length("text") - 1)


@rule("max-len", "style", "This line is too long. Maximum allowed is 80.")
def max_len(t: Tables) -> DataFrame:
    return _line_hits(t, F.length("text") > 80, F.lit(0))


@rule("max-lines", "style", "File has too many lines. Maximum allowed is 300.")
def max_lines(t: Tables) -> DataFrame:
    return _line_hits(t, F.col("line") == 301, F.lit(0))


@rule("unicode-bom", "style", "Unexpected Unicode BOM.")
def unicode_bom(t: Tables) -> DataFrame:
    return _line_hits(t, (F.col("line") == 1) & F.col("text").startswith("﻿"), F.lit(0))


def run_structure_rules(t: Tables, names: list[str]) -> DataFrame | None:
    out = None
    for n in names:
        part = RULES[n][2](t)
        out = part if out is None else out.unionByName(part)
    return out
