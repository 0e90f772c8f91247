"""Rules that run with the parser, rules as data, regular expressions, control flow, types, deep sources."""

import json

import pytest
from lintmill.functions.regexes import analyse
from lintmill.functions.tree import NEXT, File, Types, leaves, truth
from lintmill.operators import lint, node_rules, rule_ir, tree_rules
from lintmill.operators.examples import EXAMPLES, ROW_EXAMPLES
from lintmill.operators.selectors import match_tree
from lintmill.plans.parsed import Tables, keep, parse_files, parse_source
from lintmill.sources.files import in_memory


def _found(name, source, options=(), language="ts"):
    f = File("a", source, language)
    assert f.parsed.error is None, (name, source, f.parsed.error)
    return list(tree_rules.find(f, name, list(options)))


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_pairs(name):
    bad, good = EXAMPLES[name]
    assert _found(name, bad), "finds nothing in what breaks it"
    assert not _found(name, good), "finds something in what does not"


def test_every_tree_rule_has_a_pair():
    optional = {"no-restricted-properties", "no-restricted-imports", "no-restricted-syntax", "no-restricted-types", "id-match"}
    assert set(tree_rules.RULES) - set(EXAMPLES) <= optional | {n for n in tree_rules.RULES if tree_rules.RULES[n].data}


def test_options():
    assert _found("no-restricted-properties", "a.b", [{"object": "a", "property": "b"}]) and not _found("no-restricted-properties", "a.c", [{"object": "a", "property": "b"}])
    assert _found("no-restricted-imports", "import 'a'", [{"paths": ["a"]}]) and _found("no-restricted-imports", "import 'b/c'", [{"patterns": ["b/*"]}])
    assert _found("no-restricted-syntax", "with (a) b", ["WithStatement"], "js")
    assert _found("no-restricted-types", "let a: Foo", [{"types": {"Foo": "no"}}])
    assert _found("id-match", "let a_b = 1", ["^[a-z]+$"]) and not _found("id-match", "let ab = 1", ["^[a-z]+$"])
    assert not _found("max-params", "function f(a, b, c, d) {}", [4]) and _found("max-params", "function f(a, b) {}", [{"max": 1}])
    assert not _found("eqeqeq", "a == null", ["always", {"null": "ignore"}]) and not _found("no-console", "console.warn(1)", [{"allow": ["warn"]}])
    assert not _found("operator-assignment", "a = a + b", ["never"]) and _found("operator-assignment", "a += b", ["never"])


def test_rows_pairs(spark):
    names = [n for n in ROW_EXAMPLES if n in node_rules.RULES]
    assert len(names) >= 48
    sources = {f"{n}/{side}.ts": ROW_EXAMPLES[n][i] for n in names for i, side in enumerate(("bad", "good"))}
    t = Tables(keep(parse_files(in_memory(spark, sources), ("nodes", "errors")).parsed))
    hits = {(r["path"], r["rule"]) for r in node_rules.run_node_rules(t.nodes, names).select("path", "rule").distinct().collect()}
    assert [n for n in names if (f"{n}/bad.ts", n) not in hits] == []
    assert [n for n in names if (f"{n}/good.ts", n) in hits] == []


def test_lint_parses_once_and_suppresses_over_partitions(spark):
    sources = {f"{i}.js": "a == b // eslint-disable-line\nvar c = 1\nconsole.log(1)\n/* eslint-disable no-undef */ d()\n/* eslint-enable no-undef */ e()" for i in range(40)}
    config = {"preset": False, "rules": {"eqeqeq": 2, "no-var": 2, "no-undef": 2, "no-console": [1, {"allow": ["log"]}]}}
    out = lint.lint(in_memory(spark, sources).repartition(7), config)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    got = sorted((r["path"], r["rule"], r["line"]) for r in out.collect())
    assert len(got) == 40 * 3 and {x[1:] for x in got} == {("no-var", 2), ("no-undef", 3), ("no-undef", 5)}


def test_control_flow():
    def ways(source):
        return leaves(File("a", "function f() {" + source + "}").by_type["FunctionDeclaration"][0]["body"])

    assert ways("while (true) { a() }") == set()
    assert ways("while (true) { if (a) break }") == {NEXT}
    assert ways("for (;;) { return 1 }") == {"return"}
    assert ways("if (a) return; else throw b") == {"return", "throw"}
    assert ways("try { return 1 } finally { a() }") == {"return"}
    assert ways("try { a() } finally { return 1 }") == {"return"}
    assert ways("switch (a) { case 1: return; default: throw b }") == {"return", "throw"}
    assert ways("switch (a) { case 1: return }") == {"return", NEXT}
    assert ways("x: { if (a) break x; return }") == {"return", NEXT}
    assert ways("do { continue } while (true)") == set()


def test_truth_folds():
    value = lambda s: truth(File("a", s).program["body"][0]["expression"])
    assert [value(s) for s in ("(1)", "(0)", "(a)", "(!0)", "(a && false)", "(a || 1)", "(a, 0)", "(void a)", "([])", "(`a${b}`)", "(0n)", "(2n)")] == [True, False, None, True, False, True, False, False, True, True, False, True]


def test_types_of_one_file():
    f = File("a.ts", "enum E { A } type U = 'x' | 'y'; declare const u: U; const n = 1 + 2; const s = `a${n}`; async function p() { return 1 } const q = p(); const e = E.A; class C { m(): string { return '' } } const c = new C().m(); const l = [1, 2]; const [z] = l;", "ts")
    t = Types(f)
    got = {d["id"]["name"]: t.of(d["id"]) for d in f.each("VariableDeclarator") if d["id"]["type"] == "Identifier"}
    assert got["u"] == ("union", ("literal", "string", "x"), ("literal", "string", "y"))
    assert (got["n"], got["s"], got["e"], got["c"], got["l"]) == ("number", "string", ("enum", "E"), "string", ("array", "number"))
    assert got["q"][0] == "promise"


def test_regular_expressions():
    errors = {"[": True, "(": True, "a)": True, "*": True, "a{2,1}": True, "[b-a]": True, "(?<a>b)(?<a>c)": True, "(?<a>b)|(?<a>c)": False, r"\k<a>(?<a>b)": False, "(?<=a)b": False, "[a-z]+": False}
    assert {p: analyse(p, "").error is not None for p in errors} == errors
    assert analyse("a", "gg").error and analyse("a", "z").error and analyse(r"\q", "u").error and not analyse(r"\q", "").error
    assert analyse(r"(a)|\1b", "").useless == [("\\1", "is in another alternative")]
    assert analyse(r"(?!(a))\1", "").useless == [("\\1", "refers to a group in a negative lookaround")]
    assert analyse(r"(a\1)", "").useless == [("\\1", "is within that group")]
    assert analyse(r"(a)\1", "").useless == []
    assert analyse("[\\u0041\\u0301]", "").misleading == ["combined character"] and analyse("[👶🏻]", "u").misleading == ["modified Emoji"]


def test_rules_as_data():
    rule = {
        "name": "no-new-as-data", "messages": {"m": "Do not use 'new {{what}}'."},
        "handlers": [{"selector": "NewExpression", "body": [{"op": "if", "cond": {"op": "node-tag-equals", "estreeType": "ExpressionStatement", "node": {"op": "parent-node"}}, "then": [{"op": "report", "messageId": "m", "data": {"what": {"op": "source-text-of", "node": {"op": "node-callee"}}}}]}]}],
    }
    found = rule_ir.run_rule(rule_ir.read_rule(json.dumps(rule)), File("a", "new A(); b = new C()"))
    assert found == [(0, 7, "m", {"what": "A"})]
    for bad in ({"name": "x"}, {**rule, "handlers": [{"selector": "A", "body": [{"op": "nothing"}]}]}, {**rule, "handlers": [{"body": []}]}):
        with pytest.raises(rule_ir.RuleError):
            rule_ir.read_rule(bad)
    assert len(rule_ir.EXPRESSIONS) >= 128


#: op -> (arguments, source, selector of the node at hand, what the expression gives)
OPS = {
    "node-main-child": ({}, "a(b)", "CallExpression", "type:Identifier"), "node-secondary-child": ({}, "a + b", "BinaryExpression", "type:Identifier"), "node-args-length-zero": ({}, "a()", "CallExpression", True), "node-operator-equals": ({"operator": "+"}, "a + b", "BinaryExpression", True),
    "conditional-test": ({}, "a ? b : c", "ConditionalExpression", "type:Identifier"), "node-is-computed": ({}, "a[b]", "MemberExpression", True), "node-first-arg": ({}, "a(1)", "CallExpression", "type:Literal"), "node-arg-at": ({"index": 1}, "a(1, b)", "CallExpression", "type:Identifier"), "node-in-bool-ctx": ({}, "if (a) b()", "IfStatement > Identifier.test", True),
    "node-is-boolean-call": ({}, "Boolean(a)", "CallExpression", True), "node-elements-has-null": ({}, "[1,,2]", "ArrayExpression", True), "node-tag-in-set": ({"types": ["Literal"]}, "1", "Literal", True), "node-prop-name-equals": ({"value": "b"}, "a.b", "MemberExpression", True), "node-prop-name-in-set": ({"values": ["b"]}, "a['b']", "MemberExpression", True),
    "node-has-static-string-value": ({}, "`a`", "TemplateLiteral", True), "node-static-string-starts-with": ({"value": "ja"}, "'java'", "Literal", True), "node-static-string-starts-with-i": ({"value": "JA"}, "'java'", "Literal", True), "node-raw-has-octal-escape": ({}, r"'\01'", "Literal", True), "node-literal-value-equals": ({"value": 1}, "1", "Literal", True),
    "node-raw-starts-with": ({"value": "0"}, "01", "Literal", True), "node-raw-ends-with": ({"value": "."}, "1.", "Literal", True), "node-raw-contains": ({"value": "b"}, "abc", "Identifier", True), "node-raw-char-equals": ({"index": 1, "value": "b"}, "abc", "Identifier", True), "node-is-function": ({}, "() => 1", "ArrowFunctionExpression", True),
    "node-is-loop": ({}, "while (a) b()", "WhileStatement", True), "node-body-length-zero": ({}, "function f() {}", "FunctionDeclaration", True), "is-method-call": ({"object": "a", "method": "b"}, "a.b()", "CallExpression", True), "is-member-expression": ({"object": "a", "property": "b"}, "a.b", "MemberExpression", True), "is-new-expression": ({"name": "A"}, "new A()", "NewExpression", True),
    "is-call-expression": ({"name": "a", "args": 1}, "a(1)", "CallExpression", True), "is-call-or-new-expression": ({"name": "A"}, "new A()", "NewExpression", True), "is-node-matches": ({"values": ["a.b"]}, "a.b", "MemberExpression", True), "node-string-value-equals": ({"value": "a"}, "'a'", "Literal", True), "node-args-count-equals": ({"value": 2}, "a(1, 2)", "CallExpression", True),
    "node-body-stmt-at": ({"index": 1}, "function f() { a(); return }", "FunctionDeclaration", "type:ReturnStatement"), "node-body-stmt-count": ({}, "function f() { a(); b() }", "FunctionDeclaration", 2), "node-has-finalizer": ({}, "try {} finally {}", "TryStatement", True), "node-params-count-equals": ({"value": 1}, "a => a", "ArrowFunctionExpression", True),
    "node-is-empty-array-expression": ({}, "[]", "ArrayExpression", True), "node-is-empty-object-expression": ({}, "({})", "ObjectExpression", True), "node-is-negative-one": ({}, "-1", "UnaryExpression", True), "node-is-last-switch-case": ({}, "switch (a) { default: }", "SwitchCase", True), "node-has-duplicate-prev-case-test": ({}, "switch (a) { case 1: case 1: }", "SwitchCase:last-child", True),
    "node-raw-contains-linebreak": ({}, "`a\nb`", "TemplateLiteral", True), "is-start-of-expression-statement": ({}, "a.b()", "MemberExpression", True), "has-comments-inside-node": ({}, "a(/* b */)", "CallExpression", True), "has-comments-before-args": ({}, "a(/* b */ c)", "CallExpression", True), "node-is-optional": ({}, "a?.b", "MemberExpression", True),
    "node-non-spread-args-count": ({}, "a(b, ...c)", "CallExpression", 1), "node-main-token-text": ({}, "a + b", "BinaryExpression", "+"), "node-eslint-type-name": ({}, "a", "Identifier", "Identifier"), "is-global-reference": ({}, "a", "Identifier", True), "name-has-no-user-binding": ({"name": "a"}, "b", "Identifier", True),
    "node-nearest-function-ancestor": ({}, "() => a", "Identifier", "type:ArrowFunctionExpression"), "is-constructor-method": ({}, "class A { constructor() {} }", "MethodDefinition", True), "is-generator-function-or-method": ({}, "class A { *b() {} }", "MethodDefinition", True), "node-subtree-contains-tag": ({"type": "YieldExpression"}, "function* f() { yield }", "FunctionDeclaration", True),
    "loop-has-iteration-back-edge": ({}, "while (a) break", "WhileStatement", False), "node-reachable": ({}, "function f() { return; a() }", "ExpressionStatement", False), "node-is-inside-finally-before-sentinel": ({}, "function f() { try {} finally { return } }", "ReturnStatement", True), "await-is-in-loop": ({}, "async () => { for (;;) await a }", "AwaitExpression", True),
    "arguments-ref-is-restable-violation": ({}, "function f() { return arguments }", "Identifier[name=arguments]", True), "switch-case-exit-reachable": ({}, "switch (a) { case 1: break }", "SwitchCase", False), "switch-case-has-consequent": ({}, "switch (a) { case 1: b() }", "SwitchCase", True), "could-be-error": ({}, "throw a", "ThrowStatement > Identifier", True),
    "source-text-of": ({}, "a.b", "MemberExpression", "a.b"), "args-text-of": ({}, "a(1, 2)", "CallExpression", "1, 2"), "node-not-none": ({}, "a", "Identifier", True), "node-span-end": ({}, "a.b", "MemberExpression", 3), "node-fn-head-span-end": ({}, "function f(a) {}", "FunctionDeclaration", 10), "needs-preceding-semicolon": ({}, "a\n[b]", "MemberExpression", False),
}


@pytest.mark.parametrize("op", sorted(OPS))
def test_ir_operations(op):
    args, source, selector, wanted = OPS[op]
    f = File("a", source)
    assert f.parsed.error is None
    run = rule_ir.Run({"messages": {}}, f, [])
    run.node = match_tree(f, selector)[-1]
    got = run.value({"op": op, **args})
    assert (f"type:{got['type']}" if isinstance(got, dict) else got) == wanted


def test_ir_tokens_and_templates():
    f = File("a", "a (b,\nc)")
    run = rule_ir.Run({"messages": {}}, f, [])
    run.node = match_tree(f, "CallExpression")[0]
    first, last, penultimate = ({"op": o} for o in ("token-of-node", "token-of-node-last", "token-of-node-penultimate"))
    value = run.value
    assert [value(t).text for t in (first, last, penultimate, {"op": "token-after", "token": first}, {"op": "token-before", "token": last})] == ["a", ")", "c", "(", "c"]
    assert value({"op": "token-has-newline-before", "token": penultimate}) and value({"op": "token-tag-equals", "token": last, "value": ")"})
    assert value({"op": "token-has-space-between", "left": first, "right": {"op": "token-after", "token": first}}) and not value({"op": "tokens-same-line", "left": first, "right": last})
    assert value({"op": "token-start", "token": {"op": "token-after-matching-punct", "start": 0, "punct": ","}}) == 4 and value({"op": "token-end", "token": first}) == 1
    text = {"op": "template-string", "parts": ["<", {"op": "source-text-range", "start": 0, "end": 1}, {"op": "ternary", "cond": {"op": "literal", "value": False}, "then": "x", "else": ">"}]}
    assert value(text) == "<a>"
    both = {"op": "binary", "operator": "&&", "left": {"op": "unary", "operator": "!", "argument": {"op": "node-is-loop"}}, "right": {"op": "binary", "operator": ">", "left": {"op": "node-non-spread-args-count"}, "right": {"op": "literal", "value": 1}}}
    assert value(both) is True


def test_deep_sources_do_not_fail():
    for source, kind in (("x = " + "+".join(["a"] * 20_000), "Identifier"), ("[" * 5_000 + "]" * 5_000, "ArrayExpression"), ("if (a) {} " + "else if (b) {} " * 2_000, "IfStatement"), ("a" + ".b()" * 5_000, "CallExpression")):
        out = parse_source(source, "js", frozenset(("nodes", "errors", "refs")))
        assert out["errors"] == [] and sum(n["type"] == kind for n in out["nodes"]) >= 2_000
