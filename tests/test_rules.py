"""Each rule on a source that breaks it and one that does not; engine, directives, fixes, reports."""

import pytest
from lintmill.operators import config, lint, node_rules, report, structure_rules
from lintmill.operators.directives import directives, suppress
from lintmill.operators.selectors import SelectorError, parse_selector, select
from lintmill.plans.parsed import Tables, keep, parse_files
from lintmill.sources.files import in_memory

#: rule -> (breaks it, does not)
CASES = {
    "no-debugger": ("debugger", "debug()"), "no-var": ("var a", "let a"), "eqeqeq": ("a == b", "a === b"), "no-with": ("with (a) b", "a.b"), "no-alert": ("alert(1)", "a.alert(1)"), "no-eval": ("eval(a)", "a.eval(b)"),
    "no-console": ("console.log(1)", "log(1)"), "no-new-func": ("new Function('a')", "new Func()"), "no-ternary": ("a ? b : c", "a || b"), "no-nested-ternary": ("a ? b : c ? d : e", "a ? b : c"), "no-void": ("void 0", "a"),
    "no-self-compare": ("a.b === a.b", "a.b === a.c"), "no-self-assign": ("a = a", "a = b"), "use-isnan": ("a === NaN", "isNaN(a)"), "valid-typeof": ("typeof a === 'strnig'", "typeof a === 'string'"), "no-sparse-arrays": ("[1,,2]", "[1,2]"),
    "no-template-curly-in-string": ("'${a}'", "`${a}`"), "no-octal": ("x = 071", "x = 71"), "no-floating-decimal": ("x = .5", "x = 0.5"), "no-multi-str": ("x = 'a\\\nb'", "x = 'ab'"), "no-cond-assign": ("if (a = b) c", "if ((a = b)) c"),
    "no-constant-condition": ("if (true) a", "if (b) a"), "no-unsafe-negation": ("!a in b", "!(a in b)"), "no-async-promise-executor": ("new Promise(async () => 1)", "new Promise(() => 1)"), "no-case-declarations": ("switch (a) { case 1: let b }", "switch (a) { case 1: { let b } }"),
    "no-empty-pattern": ("var {} = a", "var {b} = a"), "radix": ("parseInt(a)", "parseInt(a, 10)"), "no-throw-literal": ("throw 'a'", "throw new Error('a')"), "no-useless-concat": ("'a' + 'b'", "'a' + b"), "dot-notation": ("a['b']", "a['b-c']"), "yoda": ("1 === a", "a === 1"),
    "no-multi-assign": ("a = b = c", "a = b"), "no-return-assign": ("function f() { return a = b }", "function f() { return (a = b) }"), "no-new": ("new A()", "a = new A()"), "prefer-template": ("a + 'b'", "a + b"), "no-unneeded-ternary": ("a ? true : false", "a ? 1 : 2"),
    "no-proto": ("a.__proto__", "a.proto"), "no-labels": ("a: while (1) {}", "while (1) {}"), "no-plusplus": ("a++", "a += 1"), "no-bitwise": ("a & b", "a && b"), "max-params": ("function f(a, b, c, d) {}", "function f(a, b, c) {}"), "new-parens": ("new A", "new A()"), "object-shorthand": ("x = {a: a}", "x = {a}"),
    "prefer-object-spread": ("Object.assign({}, a)", "Object.assign(a, b)"), "no-prototype-builtins": ("a.hasOwnProperty(b)", "Object.hasOwn(a, b)"), "no-extend-native": ("Array.prototype.x = 1", "A.prototype.x = 1"), "no-implied-eval": ("setTimeout('a')", "setTimeout(a)"), "no-zero-fractions": ("x = 1.0", "x = 1.5"),
    "no-undef": ("a()", "let a; a()"), "no-unused-vars": ("let a = 1", "let a = 1; b(a)"), "no-const-assign": ("const a = 1; a = 2", "let a = 1; a = 2"), "no-func-assign": ("function f() {} f = 1", "let f; f = 1"), "no-class-assign": ("class A {} A = 1", "class A {}"), "no-ex-assign": ("try {} catch (e) { e = 1 }", "try {} catch (e) { f = e }"),
    "no-import-assign": ("import a from 'b'; a = 1", "import a from 'b'; c = a"), "no-param-reassign": ("function f(a) { a = 1 }", "function f(a) { b = a }"), "no-global-assign": ("Array = 1", "a = 1"), "prefer-const": ("let a = 1; b(a)", "let a = 1; a = 2"), "no-redeclare": ("var a; var a", "var a; let b"), "no-shadow": ("let a; { let a }", "let a; { let b }"),
    "no-dupe-args": ("function f(a, a) {}", "function f(a, b) {}"), "no-shadow-restricted-names": ("let undefined", "let a"), "no-use-before-define": ("a(); let a", "let a; a()"), "prefer-rest-params": ("function f() { g(arguments) }", "function f(...a) { g(a) }"), "no-unassigned-vars": ("let a; b(a)", "let a = 1; b(a)"),
    "no-dupe-keys": ("x = {a: 1, a: 2}", "x = {get a() {}, set a(b) {}}"), "no-dupe-class-members": ("class A { a() {} a() {} }", "class A { a() {} static a() {} }"), "accessor-pairs": ("x = {set a(b) {}}", "x = {get a() {}, set a(b) {}}"), "sort-keys": ("x = {b: 1, a: 2}", "x = {a: 1, b: 2}"), "sort-vars": ("let b, a", "let a, b"),
    "no-duplicate-case": ("switch (a) { case 1: case 1: }", "switch (a) { case 1: case 2: }"), "no-duplicate-imports": ("import 'a'; import 'a'", "import 'a'; import 'b'"), "default-case": ("switch (a) { case 1: }", "switch (a) { default: }"), "default-case-last": ("switch (a) { default: case 1: }", "switch (a) { case 1: default: }"),
    "default-param-last": ("function f(a = 1, b) {}", "function f(a, b = 1) {}"), "max-classes-per-file": ("class A {} class B {}", "class A {}"), "no-await-in-loop": ("async () => { while (1) await a }", "async () => { await a; while (1) { async () => { await b } } }"), "no-constructor-return": ("class A { constructor() { return 1 } }", "class A { constructor() { (() => { return 1 })() } }"),
    "no-setter-return": ("x = {set a(b) { return 1 }}", "x = {get a() { return 1 }}"), "no-promise-executor-return": ("new Promise(() => { return 1 })", "new A(() => { return 1 })"), "require-yield": ("function* f() { a() }", "function* f() { yield a }"), "require-await": ("async function f() { a() }", "async function f() { await a }"), "getter-return": ("x = {get a() { b() }}", "x = {get a() { return b }}"),
    "constructor-super": ("class A extends B { constructor() { c() } }", "class A extends B { constructor() { super() } }"), "no-unreachable": ("function f() { return; a() }", "function f() { a(); return }"), "no-fallthrough": ("switch (a) { case 1: b(); case 2: }", "switch (a) { case 1: b(); /* falls through */ case 2: }"), "no-empty": ("if (a) {}", "if (a) { /* b */ }"), "no-empty-function": ("function f() {}", "function f() { /* a */ }"),
    "no-lonely-if": ("if (a) {} else { if (b) {} }", "if (a) {} else if (b) {}"), "no-else-return": ("function f() { if (a) { return b } else { c() } }", "function f() { if (a) { b() } else { c() } }"), "no-useless-catch": ("try { a() } catch (e) { throw e }", "try { a() } catch (e) { b(e) }"), "no-unused-labels": ("a: while (1) {}", "a: while (1) break a"), "for-direction": ("for (let i = 0; i < 9; i--) {}", "for (let i = 0; i < 9; i++) {}"),
    "no-unused-expressions": ("a + b", "a()"), "no-undef-init": ("let a = undefined", "let a"), "no-useless-call": ("f.call(null)", "a.f.call(a)"), "no-warning-comments": ("// TODO x", "// done"), "no-inline-comments": ("a() // b", "// b\na()"), "max-len": ("x = '" + "a" * 90 + "'", "x = 1"), "no-tabs": ("\ta()", "a()"), "no-unsafe-finally": ("function f() { try {} finally { return 1 } }", "function f() { try { return 1 } finally {} }"), "no-loop-func": ("let a; for (;;) { a = 1; f(() => a) }", "for (;;) { let a = 1; f(() => a) }"),
    "no-unused-private-class-members": ("class A { #a = 1 }", "class A { #a = 1; b() { return this.#a } }"), "grouped-accessor-pairs": ("x = {get a() {}, b: 1, set a(c) {}}", "x = {get a() {}, set a(c) {}, b: 1}"), "no-unsafe-optional-chaining": ("(a?.b).c", "a?.b.c"), "linebreak-style": ("a()\r\nb()", "a()\nb()"), "complexity": ("function f() { " + "if (a) b(); " * 21 + "}", "function f() { if (a) b() }"), "max-depth": ("if (a) { if (a) { if (a) { if (a) { if (a) {} } } } }", "if (a) { if (a) {} }"),
    "no-explicit-any": ("let a: any", "let a: string"), "no-non-null-assertion": ("a!.b", "a.b"), "no-namespace": ("namespace A {}", "let a"), "no-empty-interface": ("interface A {}", "interface A { b: string }"), "array-type": ("let a: Array<string>", "let a: string[]"), "consistent-type-definitions": ("type A = { b: string }", "type A = string"), "no-inferrable-types": ("let a: number = 1", "let a: number = b"), "no-duplicate-enum-values": ("enum A { B = 1, C = 1 }", "enum A { B = 1, C = 2 }"),
    "prefer-as-const": ("let a = 'b' as 'b'", "let a = 'b' as const"), "no-duplicate-type-constituents": ("type A = B | B", "type A = B | C"), "no-redundant-type-constituents": ("type A = any | B", "type A = B | C"), "prefer-enum-initializers": ("enum A { B }", "enum A { B = 1 }"), "ban-ts-comment": ("// @ts-ignore", "// note"), "no-wrapper-object-types": ("let a: String", "let a: string"), "no-useless-constructor": ("class A { constructor() {} }", "class A { constructor() { a() } }"),
}


@pytest.fixture(scope="module")
def tables(spark):
    sources = {f"{n}/{side}.ts": c[i] for n, c in CASES.items() for i, side in enumerate(("bad", "good"))}
    t = parse_files(in_memory(spark, sources))
    return Tables(keep(t.parsed))




def test_cases_parse(tables):
    assert tables.errors.count() == 0


def test_rules_of_one_row(tables):
    names = [n for n in CASES if n in node_rules.RULES]
    hits = {(r["path"], r["rule"]) for r in node_rules.run_node_rules(tables.nodes, names).select("path", "rule").distinct().collect()}
    assert [n for n in names if (f"{n}/bad.ts", n) not in hits] == []
    assert [n for n in names if (f"{n}/good.ts", n) in hits] == []


@pytest.mark.parametrize("name", sorted(n for n in CASES if n in structure_rules.RULES))
def test_rules_of_many_rows(tables, name):
    hits = {r["path"] for r in structure_rules.RULES[name][2](tables).where(f"path like '{name}/%'").select("path").collect()}
    assert hits == {f"{name}/bad.ts"}


def test_every_rule_has_a_plan(tables):
    assert len(lint.catalog()) >= 230
    for n in structure_rules.RULES:
        assert tuple(structure_rules.RULES[n][2](tables).columns) == structure_rules.OUT


def test_engine(spark):
    files = in_memory(spark, {"a.js": "var a = 1;\ndebugger;\n// eslint-disable-next-line no-var -- why\nvar b;\nvar c; // eslint-disable-line\n/* eslint-disable eqeqeq */\na == b;\n/* eslint-enable */\na == c;", "b.js": "let (", "c.ts": "let x: any;"})
    found = lint.lint(files, {"preset": False, "rules": {"no-var": "error", "no-debugger": 1, "eqeqeq": ["warn", "always"], "ts/no-explicit-any": 2}})
    rows = {(r["path"], r["rule"], r["line"], r["severity"]) for r in found.collect()}
    assert rows == {("a.js", "no-var", 1, 2), ("a.js", "no-debugger", 2, 1), ("a.js", "eqeqeq", 9, 1), ("b.js", "parse-error", 1, 2), ("c.ts", "no-explicit-any", 1, 2)}
    assert report.exit_code(found) == 1 and report.exit_code(found.where("severity = 1")) == 0
    assert report.summary(found).first()["sentence"] == "5 problems (3 errors, 2 warnings)"
    assert "a.js:2:1: warning(no-debugger) Unexpected 'debugger' statement." in {r["value"] for r in report.text_lines(found).collect()}


def test_budget(spark):
    files = in_memory(spark, {"a.js": "debugger;" * 30})
    assert lint.lint(files, {"preset": False, "rules": {"no-debugger": 2}}, budget=7).count() == 7


def test_fixes(spark):
    files = in_memory(spark, {"a.js": "var a = .5;; debugger; x = new A; y = b['c'];"})
    names = ("no-var", "no-floating-decimal", "no-extra-semi", "no-debugger", "new-parens", "dot-notation")
    fixed = lint.fix(files, {"preset": False, "rules": dict.fromkeys(names, 2)}).first()["source"]
    assert fixed == "let a = 0.5;  x = new A(); y = b.c;"


def test_selectors(spark):
    source = "function f(a) { if (a) { return g(a, 1) } } class B { m() { return 2 } } x = [1, 2, 3];"
    nodes = parse_files(in_memory(spark, {"a.js": source}), ("nodes",)).nodes
    count = lambda s: select(nodes, s).count()
    assert count("ReturnStatement") == 2
    assert count("FunctionDeclaration ReturnStatement") == 1
    assert count("ReturnStatement > CallExpression > Literal") == 1
    assert count("BlockStatement:has(IfStatement)") == 1
    assert count(":function:not(FunctionDeclaration)") == 1
    assert count("ArrayExpression > Literal:first-child, ArrayExpression > Literal:nth-child(3)") == 2
    assert count("ArrayExpression > Literal:last-child[value=3]") == 1
    assert count("Literal ~ Literal") == 2 and count("Literal + Literal") == 2
    assert count("Literal[value>=2]") == 3
    assert count("Identifier[name=/^[fg]$/]") == 2
    assert count(":matches(ClassDeclaration, IfStatement)") == 2
    assert count("ClassBody ReturnStatement:not(IfStatement ReturnStatement)") == 1
    assert count("*") == nodes.count()
    for bad in ("A >", "[", ":what", "A:nope(B)", ""):
        with pytest.raises(SelectorError):
            parse_selector(bad)


def test_long_texts_are_whole(spark):
    long = "a" * 100 + "." + "b" * 100
    word = "w" * 2500
    cases = {
        "no-self-compare": f"{long} === {long}", "no-self-assign": f"{long} = {long}", "no-duplicate-case": f"switch (x) {{ case {long}: case {long}: }}", "arrow-parens": f"f = a => {{ g('{word}') }}", "no-duplicate-type-constituents": f"type A = {long} | {long}",
        "no-useless-rename": f"import {{ {'c' * 170} as {'c' * 170} }} from 'd'", "no-script-url": f"x = 'javascript:{word}'", "no-template-curly-in-string": f"x = '{word}${{a}}'", "no-import-type-side-effects": f"import {{ type {'T' * 170} }} from 'd'",
    }
    sources = in_memory(spark, {f"{n}.ts": s for n, s in cases.items()})
    found = {(r["path"], r["rule"]) for r in lint.lint(sources, {"preset": False, "rules": dict.fromkeys(cases, 2)}).collect()}
    assert {(f"{n}.ts", n) for n in cases} <= found
    fixed = lint.fix(in_memory(spark, {"a.js": f"x = {long}['y']"}), {"preset": False, "rules": {"dot-notation": 2}}).collect()
    assert [r["source"].replace(" ", "") for r in fixed] == [f"x={long}.y"]


def test_directive_order(spark):
    comments = spark.createDataFrame([("a", "Block", " eslint-disable x, p/y ", 0, 1, 1), ("a", "Block", "eslint-enable x", 50, 5, 5), ("a", "Line", " lintmill-disable-next-line", 80, 8, 8)], "path string, kind string, text string, start int, line int, end_line int")
    found = spark.createDataFrame([("a", "x", 3), ("a", "y", 3), ("a", "z", 3), ("a", "x", 6), ("a", "y", 6), ("a", "z", 9), ("b", "x", 3)], "path string, rule string, line int")
    assert {tuple(r) for r in suppress(found, directives(comments)).collect()} == {("a", "z", 3), ("a", "x", 6), ("b", "x", 3)}


def test_severities():
    assert [config.severity(x) for x in ("off", "warn", "error", "hint", "odd", 0, 1, 7, ["warn"], [])] == [0, 1, 2, 0, 2, 0, 1, 2, 1, 2]
    assert lint.severities({"preset": False, "rules": {"no-var": "off", "plugin/eqeqeq": "warn"}}) == {"eqeqeq": 1}
