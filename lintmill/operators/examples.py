"""For each rule a source that breaks it and one that does not: tests and registered queries run the engine on them."""

#: rule -> (breaks it, does not)
EXAMPLES: dict[str, tuple[str, str]] = {
    # control flow, scopes and options
    "array-callback-return": ("a.map(function (x) { b(x) })", "a.map(function (x) { return b(x) })"), "no-constant-binary-expression": ("({}) || a", "a || {}"), "no-this-before-super": ("class A extends B { constructor() { this.a = 1; super() } }", "class A extends B { constructor() { super(); this.a = 1 } }"),
    "no-unexpected-multiline": ("let a = b\n(c || d).e()", "let a = b;\n(c || d).e()"), "no-unreachable-loop": ("while (a) { b(); break }", "while (a) { if (b) break }"), "preserve-caught-error": ("try { a() } catch (e) { throw new Error('x') }", "try { a() } catch (e) { throw new Error('x', { cause: e }) }"),
    "no-invalid-regexp": ("new RegExp('[')", "new RegExp('[a]')"), "no-misleading-character-class": ("/[👍]/", "/[👍]/u"), "no-useless-backreference": (r"/\1(a)/", r"/(a)\1/"), "no-dupe-else-if": ("if (a) b(); else if (a) c()", "if (a) b(); else if (d) c()"),
    "consistent-return": ("function f(a) { if (a) return 1; return }", "function f(a) { if (a) return 1; return 2 }"), "no-useless-return": ("function f() { a(); return }", "function f() { if (a) return; b() }"), "no-useless-assignment": ("function f() { let a = 1; a = 2; return a }", "function f() { let a = 1; b(a); a = 2; return a }"),
    "no-unmodified-loop-condition": ("let a = 1; while (a) { b() }", "let a = 1; while (a) { a = b() }"), "require-atomic-updates": ("let a = 0; async function f() { a = a + await b() }", "let a = 0; async function f() { a = await b() }"),
    "no-restricted-globals": ("event", "e.event"), "no-restricted-exports": ("export { a as then }; let a", "export { a }; let a"), "consistent-this": ("let self = this", "let that = this"), "id-denylist": ("let data = 1", "let x = 1"), "init-declarations": ("let a", "let a = 1"),
    "logical-assignment-operators": ("a = a || b", "a ||= b"), "operator-assignment": ("a = a + b", "a += b"), "no-extra-bind": ("(() => a).bind(b)", "(function () { this.a }).bind(b)"), "no-extra-label": ("a: while (b) { break a }", "a: while (b) { while (c) { break a } }"), "template-tag-spacing": ("a `b`", "a`b`"),
    "vars-on-top": ("a(); var b", "var b; a()"), "block-scoped-var": ("function f() { if (a) { var b = 1 } c(b) }", "function f() { if (a) { var b = 1; c(b) } }"), "class-methods-use-this": ("class A { b() { c() } }", "class A { b() { this.c() } }"), "func-name-matching": ("let a = function b() {}", "let a = function a() {}"),
    "max-lines-per-function": ("function f() {" + "\na()" * 60 + "}", "function f() { a() }"), "max-nested-callbacks": ("a(() => " * 11 + "b" + ")" * 11, "a(() => b)"), "no-implicit-globals": ("var a = 1", "let a = 1"), "no-invalid-this": ("function f() { this.a }", "class A { f() { this.a } }"), "no-magic-numbers": ("a(42)", "const b = 42; a(b)"),
    "no-useless-escape": (r"'\d'", r"'\n'"), "one-var": ("let a; let b", "let a, b"), "prefer-arrow-callback": ("a(function () { return b })", "a(() => b)"), "prefer-destructuring": ("let a = b.a", "let { a } = b"), "prefer-named-capture-group": ("/(a)/", "/(?<b>a)/"), "sort-imports": ("import b from 'b'; import a from 'a'", "import a from 'a'; import b from 'b'"),
    "early-errors": ("const a", "const a = 1"),
    "strict": ("function f() { a() }", "function f() { 'use strict'; a() }"), "prefer-promise-reject-errors": ("Promise.reject('a')", "Promise.reject(new Error('a'))"),
    # typescript
    "class-literal-property-style": ("class A { get b() { return 1 } }", "class A { readonly b = 1 }"), "consistent-generic-constructors": ("let a: Map<string, number> = new Map()", "let a = new Map<string, number>()"), "consistent-type-imports": ("import { A } from 'a'; let b: A", "import type { A } from 'a'; let b: A"),
    "no-extraneous-class": ("class A { static b = 1 }", "class A { b = 1 }"), "no-mixed-enums": ("enum A { B = 1, C = 'c' }", "enum A { B = 1, C = 2 }"), "no-invalid-void-type": ("let a: void", "function f(): void {}"), "no-unnecessary-parameter-property-assignment": ("class A { constructor(private b: string) { this.b = b } }", "class A { constructor(private b: string) { this.c = b } }"),
    "no-unnecessary-qualifier": ("enum A { B = 1, C = A.B }", "enum A { B = 1, C = B }"), "no-unnecessary-template-expression": ("let a = `${'b'}`", "let a = `${b}c`"), "no-unnecessary-type-arguments": ("function f<T = number>() {} f<number>()", "function f<T = number>() {} f<string>()"), "no-unsafe-declaration-merging": ("interface A {} class A {}", "interface A {} class B {}"),
    "non-nullable-type-assertion-style": ("declare const a: string | null; let b = a as string", "declare const a: string | null; let b = a!"), "prefer-for-of": ("for (let i = 0; i < a.length; i++) { b(a[i]) }", "for (let i = 0; i < a.length; i++) { b(i, a[i]) }"), "prefer-find": ("[1, 2].filter(x => x > 1)[0]", "[1, 2].find(x => x > 1)"),
    "prefer-includes": ("[1, 2].indexOf(a) !== -1", "[1, 2].includes(a)"), "prefer-regexp-exec": ("'abc'.match(/a/)", "/a/.exec('abc')"), "prefer-string-starts-ends-with": ("let a = 'abc'; a[0] === 'a'", "let a = 'abc'; a.startsWith('a')"), "prefer-readonly": ("class A { private b = 1 }", "class A { private readonly b = 1 }"),
    "prefer-optional-chain": ("a && a.b", "a?.b"), "prefer-nullish-coalescing": ("declare const a: string | null; a || 'b'", "declare const a: string | null; a ?? 'b'"), "prefer-return-this-type": ("class A { b(): A { return this } }", "class A { b(): this { return this } }"),
    "related-getter-setter-pairs": ("interface A { get b(): string; set b(c: number) }", "interface A { get b(): string; set b(c: string) }"), "use-unknown-in-catch-callback-variable": ("Promise.resolve().catch(e => a(e))", "Promise.resolve().catch((e: unknown) => a(e))"), "return-await": ("async function f() { try { return Promise.resolve(1) } catch (e) { a(e) } }", "async function f() { return Promise.resolve(1) }"),
    "await-thenable": ("async function f() { await 12 }", "async function f() { await Promise.resolve(12) }"), "no-floating-promises": ("async function f() {} f()", "async function f() {} void f()"), "no-misused-promises": ("async function f() { return 1 } if (f()) {}", "async function f() { if (await f()) {} }"), "no-for-in-array": ("for (const i in [1, 2]) {}", "for (const i of [1, 2]) {}"),
    "no-base-to-string": ("'' + {}", "'' + 1"), "no-unsafe-argument": ("declare const a: any; function f(b: string) {} f(a)", "declare const a: string; function f(b: string) {} f(a)"), "no-unsafe-assignment": ("declare const a: any; const b = a", "declare const a: string; const b = a"), "no-unsafe-call": ("declare const a: any; a()", "declare const a: () => void; a()"),
    "no-unsafe-member-access": ("declare const a: any; a.b", "declare const a: { b: string }; a.b"), "no-unsafe-return": ("declare const a: any; function f() { return a }", "declare const a: string; function f() { return a }"), "no-unsafe-unary-minus": ("declare const a: string; -a", "declare const a: number; -a"), "no-unsafe-enum-comparison": ("enum A { B } A.B === 1", "enum A { B } A.B === A.B"),
    "no-unsafe-type-assertion": ("declare const a: any; let b = a as string", "declare const a: string; let b = a as string"), "no-unnecessary-boolean-literal-compare": ("declare const a: boolean; a === true", "declare const a: boolean; a"), "no-unnecessary-condition": ("const a = [1]; if (a) {}", "declare const a: boolean; if (a) {}"),
    "no-unnecessary-type-assertion": ("declare const a: string; let b = a!", "declare const a: string | null; let b = a!"), "no-unnecessary-type-conversion": ("String('a')", "String(1)"), "no-unnecessary-type-parameters": ("function f<T>(a: T): void {}", "function f<T>(a: T): T { return a }"), "no-meaningless-void-operator": ("void (() => {})()", "void a()"),
    "no-confusing-void-expression": ("function f(): void {} const a = f()", "function f(): void {} f()"), "only-throw-error": ("throw 'a'", "throw new Error('a')"), "promise-function-async": ("function f() { return Promise.resolve(1) }", "async function f() { return Promise.resolve(1) }"), "require-array-sort-compare": ("[3, 1].sort()", "[3, 1].sort((a, b) => a - b)"),
    "restrict-plus-operands": ("1 + 'a'", "1 + 2"), "restrict-template-expressions": ("`${[1]}`", "`${'a'}`"), "strict-boolean-expressions": ("declare const a: boolean | null; if (a) {}", "declare const a: boolean; if (a) {}"), "switch-exhaustiveness-check": ("declare const a: 'x' | 'y'; switch (a) { case 'x': }", "declare const a: 'x' | 'y'; switch (a) { case 'x': case 'y': }"),
    "unbound-method": ("class A { b() {} } const c = new A(); const d = c.b", "class A { b() {} } const c = new A(); c.b()"), "prefer-readonly-parameter-types": ("function f(a: string[]) {}", "function f(a: readonly string[]) {}"),
    "no-loss-of-precision": ("x = 9007199254740993", "x = 9007199254740991"), "no-non-null-asserted-optional-chain": ("a?.b!", "a?.b"),
    # limits
    "max-params": ("function f(a, b, c, d) {}", "function f(a, b, c) {}"), "max-depth": ("if (a) { if (a) { if (a) { if (a) { if (a) {} } } } }", "if (a) { if (a) {} }"), "complexity": ("function f() { " + "if (a) b(); " * 21 + "}", "function f() { if (a) b() }"), "max-lines": ("a()\n" * 301, "a()"), "max-statements": ("function f() { " + "a(); " * 11 + "}", "function f() { a() }"),
    "max-classes-per-file": ("class A {} class B {}", "class A {}"), "id-length": ("let a = 1", "let ab = 1"), "no-console": ("console.log(1)", "log(1)"), "no-plusplus": ("a++", "a += 1"), "eqeqeq": ("a == b", "a === b"),
}

#: Rules of one row that had no pair before.
ROW_EXAMPLES: dict[str, tuple[str, str]] = {
    "no-buffer-constructor": ("new Buffer(1)", "Buffer.alloc(1)"), "no-compare-neg-zero": ("a === -0", "a === 0"), "no-extra-semi": ("a();;", "a();"), "no-invalid-remove-event-listener": ("a.removeEventListener('b', () => c)", "a.removeEventListener('b', c)"), 
    "no-negated-in-lhs": ("!a in b", "a in b"), "no-new-native-nonconstructor": ("new Symbol()", "Symbol()"), "no-new-statics": ("new Promise.all(a)", "Promise.all(a)"), "no-new-symbol": ("new Symbol()", "Symbol()"), "no-obj-calls": ("Math()", "Math.abs(1)"), "no-useless-rename": ("import { a as a } from 'b'", "import { a as c } from 'b'"),
    "prefer-exponentiation-operator": ("Math.pow(a, b)", "a ** b"), "no-control-regex": (r"/\x1f/", "/a/"), "no-delete-var": ("delete a", "delete a.b"), "no-empty-character-class": ("/a[]/", "/a[b]/"), "no-new-wrappers": ("new String('a')", "String('a')"), "no-nonoctal-decimal-escape": (r"'\8'", "'8'"), "no-object-constructor": ("new Object()", "x = {}"),
    "no-octal-escape": (r"'\251'", "'a'"), "no-process-exit": ("process.exit(1)", "exit(1)"), "no-regex-spaces": ("/a  b/", "/a b/"), "no-script-url": ("a = 'javascript:b'", "a = 'b'"), "no-sequences": ("a, b", "a; b"), "no-undefined": ("a = undefined", "a = null"), "avoid-new": ("new Promise(a)", "Promise.all(a)"),
    "no-array-constructor": ("Array(1, 2)", "[1, 2]"), "no-caller": ("arguments.callee", "arguments.length"), "no-confusing-arrow": ("a => 1 ? 2 : 3", "a => { return 1 ? 2 : 3 }"), "no-continue": ("while (a) continue", "while (a) b()"), "no-div-regex": ("/=a/", "/a/"), "no-eq-null": ("a == null", "a === null"), "no-extra-boolean-cast": ("if (!!a) {}", "if (a) {}"),
    "no-iterator": ("a.__iterator__", "a.iterator"), "no-negated-condition": ("if (!a) b(); else c()", "if (a) b(); else c()"), "no-new-object": ("new Object()", "x = {}"), "no-new-require": ("new require('a')", "require('a')"), "no-path-concat": ("__dirname + 'a'", "path.join(a)"), "no-process-env": ("process.env.A", "env.A"),
    "no-this-assignment": ("let a = this", "let a = b"), "no-useless-computed-key": ("x = {['a']: 1}", "x = {a: 1}"), "prefer-object-has-own": ("Object.prototype.hasOwnProperty.call(a, b)", "Object.hasOwn(a, b)"), "prefer-regex-literals": ("new RegExp('a')", "/a/"), "prefer-spread": ("f.apply(null, a)", "f(...a)"), "symbol-description": ("Symbol()", "Symbol('a')"),
    "no-extra-non-null-assertion": ("a!!.b", "a!.b"), "no-require-imports": ("import a = require('b')", "import a from 'b'"), "no-this-alias": ("const a = this", "const a = b"), "no-dynamic-delete": ("delete a[b]", "delete a.b"), "no-unnecessary-type-constraint": ("function f<T extends any>() {}", "function f<T>() {}"),
    "no-unsafe-function-type": ("let a: Function", "let a: () => void"), "prefer-literal-enum-member": ("enum A { B = a() }", "enum A { B = 1 }"), "prefer-namespace-keyword": ("module A {}", "namespace A {}"), "throw-new-error": ("throw Error('a')", "throw new Error('a')"), "no-array-for-each": ("a.forEach(b)", "for (const c of a) b(c)"), "error-message": ("new Error()", "new Error('a')"),
    "prefer-node-protocol": ("import a from 'fs'", "import a from 'node:fs'"), "require-unicode-regexp": ("/a/", "/a/u"),
}
