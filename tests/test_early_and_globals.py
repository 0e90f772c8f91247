import pytest

from lintmill.functions.early import early
from lintmill.functions.parser import parse
from lintmill.functions.tree import File
from lintmill.operators import fixes
from lintmill.operators.config import legacy_chain
from lintmill.operators.lint import fix_preview, lint
from lintmill.operators.report import utf16
from lintmill.sources.files import in_memory

BAD = [
    "let a; let a", "const a;", "const {a};", "let a; var a", "{ let a; { var a } }", "function f(a) { let a }", "try {} catch (e) { let e }", "import a from 'b'; let a", "{ function f() {} let f }", "let let = 1",
    "if (a) let b = 1", "for (let x = 1 of a);", "break", "continue", "return 1", "a: a: 1", "a: { continue a }", "super()", "class A { f() { super() } }", "new.target",
    "class A { constructor() {} constructor() {} }", "class A { #x; #x }", "a.#x", "'use strict'; with (a) {}", "'use strict'; delete a", "'use strict'; 010", "function f(a, a) { 'use strict' }", "(a, a) => 1", "function f(a = 1) { 'use strict' }",
    "1++", "a?.b++", "({ a = 1 })", "({ __proto__: a, '__proto__': b })", "/(/", "({ get a(b) {} })", "a ?? b || c", "-a ** b", "switch (a) { default: default: }", "export { a }; export { a }; let a",
]
GOOD = [
    "let a; { let a }", "for (const a of b);", "for (;;) { break }", "a: for (;;) { continue a }", "function f() { return 1 }", "({ a = 1 } = b)", "class A extends B { constructor() { super(); new.target } }", "class A { get #x() { return 1 } set #x(v) {} f() { return #x in this } }",
    "function f(a, a) {}", "var a; var a", "function f() {} function f() {}", "function f() {} var f", "try {} catch (e) { var e }", "switch (a) { case 1: break; default: }", "({ set a(b) {}, get a() { return 1 } })", "(a ?? b) || c", "({ a() { super.b() } })", "a++; a.b--; a[0]++",
    "function f(a) { var a }", "(-a) ** b", "({ __proto__: a, __proto__() {} })", "let { a = 1 } = b", "for (var i = 0, j; i;);", "delete a.b", "class A { static { var a; let b } }",
]
TYPED = ["using x = a", "function f(x: any): asserts x is string {}", "function f(x: any): asserts x {}", "class A { accessor x = 1; accessor; static accessor y: number = 2 }", "type A = typeof import('x')", "type A = [a: string, b?: number]"]


@pytest.mark.parametrize("source", BAD)
def test_early_errors(source):
    f = File("a.js", source)
    assert early(f) or f.parsed.error


@pytest.mark.parametrize("source", GOOD)
def test_no_early_errors(source):
    f = File("a.js", source)
    assert f.parsed.error is None
    assert not early(f)


@pytest.mark.parametrize("source", TYPED)
def test_syntax(source):
    assert parse(source, "ts").error is None
    assert not early(File("a.ts", source, "ts"))


def test_typed_code_may_merge():
    source = "function f(a: string): void\nfunction f(a: number): void\nfunction f(a: any) {}\nclass A {}\ninterface A {}\nnamespace A { const a = 1 }\ndeclare const b: number"
    assert not early(File("a.ts", source, "ts"))


def test_globals(spark):
    files = in_memory(spark, {"a.js": "/* global b, c:writable, Map:off */ a; b; c; Map; Set", "b.js": "a; b; window; Promise"})
    config = {"preset": False, "rules": {"no-undef": 2}}

    def names(more):
        return sorted((r.path, r.message.split("'")[1]) for r in lint(files, config | more).collect())

    assert names({}) == [("a.js", "Map"), ("a.js", "a"), ("b.js", "a"), ("b.js", "b"), ("b.js", "window")]
    assert names({"env": {"browser": True}, "globals": {"a": "readonly"}}) == [("a.js", "Map"), ("b.js", "b")]
    assert names({"ecmaVersion": 5, "globals": {"a": True, "b": False, "window": True}}) == [("a.js", "Map"), ("a.js", "Set"), ("b.js", "Promise")]


def test_utf16(spark):
    files = in_memory(spark, {"a.js": "'👍é';\n'👍'; var a"})
    config = {"preset": False, "rules": {"no-var": 2}}
    r = utf16(lint(files, config), files).collect()
    assert [(x.start, x.end, x.col) for x in r] == [(13, 18, 6)]


def test_fix_verbs_and_preview(spark):
    fixer = fixes.Fixer()
    node = {"start": 2, "end": 4}
    assert fixes.merge("abcdef", [fixer.insert_after(node, ")"), fixer.insert_before(node, "(")]) == (2, 4, "(cd)")
    assert fixes.merge("abcdef", [fixer.remove(node), fixer.replace_text_range(3, 5, "x")]) is None
    assert fixes.merge("abcdef", []) is None
    files = in_memory(spark, {"a.js": "var a = 1", "b.js": "let b = 1"})
    assert [tuple(r) for r in fix_preview(files, {"preset": False, "rules": {"no-var": 2}}).collect()] == [("a.js", "var a = 1", "let a = 1")]


def test_legacy_chain(spark):
    files = spark.createDataFrame([("a/b/c.js",), ("a/d.js",), ("e.js",)], "path string")
    configs = spark.createDataFrame([("", False, {"x": "0", "y": "0"}), ("a", True, {"x": "1"}), ("a/b", False, {"z": "2"})], "dir string, root boolean, rules map<string,string>")
    assert {r.path: r.rules for r in legacy_chain(files, configs).collect()} == {"a/b/c.js": {"x": "1", "z": "2"}, "a/d.js": {"x": "1"}, "e.js": {"x": "0", "y": "0"}}
