"""A recursive-descent parser to ESTree-shaped nodes: ECMAScript 2022, common TypeScript, JSX elements.

A node is a dict with type, start, end and its fields; ``parse`` never raises for bad input: it gives
the statements read so far and the error.
"""

from __future__ import annotations

import sys

from dataclasses import dataclass, field

from lintmill.functions.lexer import Comment, Lexer, ScriptError, Token, cooked, number_value

Node = dict

# Binary operators by strength.
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
UNARY = {"!", "~", "+", "-", "typeof", "void", "delete"}
TS_KEYWORDS = {"any": "TSAnyKeyword", "unknown": "TSUnknownKeyword", "never": "TSNeverKeyword", "string": "TSStringKeyword", "number": "TSNumberKeyword", "boolean": "TSBooleanKeyword", "object": "TSObjectKeyword", "symbol": "TSSymbolKeyword", "bigint": "TSBigIntKeyword", "void": "TSVoidKeyword", "undefined": "TSUndefinedKeyword", "null": "TSNullKeyword"}
MODIFIERS = {"public", "private", "protected", "readonly", "abstract", "override", "declare", "static"}


@dataclass
class Parsed:
    program: Node
    tokens: list[Token]
    comments: list[Comment]
    error: ScriptError | None = None
    starts: list[int] = field(default_factory=list)


class Parser:
    def __init__(self, source: str, ts: bool = False, jsx: bool = True) -> None:
        self.lexer, self.source, self.ts, self.jsx = Lexer(source), source, ts, jsx
        self.tokens: list[Token] = []
        self.last_end = 0
        self.no_arrow: set[int] = set()
        self.no_in = False
        self.token = self.lexer.next()

    # -- tokens ---------------------------------------------------------------------------

    def fail(self, message: str = "") -> ScriptError:
        return ScriptError(message or (f"Unexpected token {self.token.text}" if self.token.kind != "end" else "Unexpected end of input"), self.token.start)

    def advance(self) -> Token:
        t = self.token
        self.tokens.append(t)
        self.last_end = t.end
        self.lexer.at = t.end
        self.token = self.lexer.next()
        return t

    def mark(self) -> tuple:
        return self.token, self.lexer.at, len(self.tokens), self.last_end

    def reset(self, mark: tuple) -> None:
        self.token, self.lexer.at, n, self.last_end = mark
        del self.tokens[n:]

    def peek(self) -> Token:
        at = self.lexer.at
        self.lexer.at = self.token.end
        try:
            return self.lexer.next()
        except ScriptError:
            return Token("end", "", self.token.end, self.token.end, False)
        finally:
            self.lexer.at = at

    def is_(self, *texts: str) -> bool:
        return self.token.kind in ("punct", "keyword") and self.token.text in texts

    def word(self, *texts: str) -> bool:
        return self.token.kind == "name" and self.token.text in texts

    def eat(self, text: str) -> bool:
        if self.is_(text):
            self.advance()
            return True
        return False

    def expect(self, text: str) -> Token:
        if not self.is_(text):
            raise self.fail()
        return self.advance()

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.is_("}") or self.token.kind == "end" or self.token.after_newline):
            raise self.fail()

    def node(self, kind: str, start: int, /, **fields: object) -> Node:
        return {"type": kind, "start": start, "end": self.last_end, **fields}

    # -- statements -----------------------------------------------------------------------

    def program(self) -> tuple[Node, ScriptError | None]:
        body: list[Node] = []
        error = None
        try:
            while self.token.kind != "end":
                body.append(self.statement())
        except ScriptError as e:
            error = e
        except RecursionError:
            error = ScriptError("Nesting too deep", self.token.start)
        self.directives(body)
        module = any(s["type"].startswith(("Import", "Export")) for s in body)
        return {"type": "Program", "start": 0, "end": len(self.source), "sourceType": "module" if module else "script", "body": body}, error

    def directives(self, body: list[Node]) -> None:
        for s in body:
            e = s.get("expression")
            if s["type"] != "ExpressionStatement" or e["type"] != "Literal" or e.get("literal") != "string" or e.get("parenthesized"):
                break
            s["directive"] = e["raw"][1:-1]

    def block(self) -> Node:
        start = self.expect("{").start
        body = []
        while not self.is_("}"):
            body.append(self.statement())
        self.advance()
        return self.node("BlockStatement", start, body=body)

    def function_body(self) -> Node:
        body, no_in, self.no_in = None, self.no_in, False
        body = self.block()
        self.no_in = no_in
        self.directives(body["body"])
        return body

    def paren(self) -> Node:
        self.expect("(")
        e = self.expression()
        self.expect(")")
        return e

    def statement(self) -> Node:
        t = self.token
        start, text = t.start, t.text
        if t.kind == "punct":
            if text == "{":
                return self.block()
            if text == ";":
                self.advance()
                return self.node("EmptyStatement", start)
            if text == "@":
                decorators = self.decorators()
                s = self.statement()
                target = s.get("declaration") or s
                target["decorators"] = decorators
                return s
        if t.kind == "keyword":
            method = getattr(self, f"{text}_statement", None)
            if text == "import" and self.peek().text in ("(", "."):
                method = None
            if text == "enum" or (text == "const" and self.ts and self.peek().text == "enum"):
                return self.ts_enum(start)
            if method:
                return method(start)
        if t.kind == "name":
            after = self.peek()
            if text == "let" and (after.kind in ("name",) or after.text in ("[", "{")):
                return self.var_statement(start)
            if text == "using" and after.kind == "name" and not after.after_newline and after.text not in ("of", "in", "instanceof"):
                return self.var_statement(start)
            if text == "async" and after.text == "function" and not after.after_newline:
                return self.function(start, declaration=True)
            if after.text == ":" and after.kind == "punct":
                label = self.identifier()
                self.advance()
                return self.node("LabeledStatement", start, label=label, body=self.statement()) | {"end": self.last_end}
            if self.ts and (s := self.ts_statement(start, text, after)):
                return s
        e = self.expression()
        self.semicolon()
        return self.node("ExpressionStatement", start, expression=e)

    def var_statement(self, start: int) -> Node:
        s = self.variables(start)
        self.semicolon()
        return s | {"end": self.last_end}

    const_statement = var_statement

    def variables(self, start: int) -> Node:
        kind = self.advance().text
        out = []
        while True:
            at = self.token.start
            target = self.binding_target()
            if self.ts and self.is_("!"):
                self.advance()
                target["definite"] = True
            if self.ts and self.is_(":"):
                target["typeAnnotation"] = self.type_annotation()
                target["end"] = self.last_end
            init = self.assignment() if self.eat("=") else None
            out.append(self.node("VariableDeclarator", at, id=target, init=init))
            if not self.eat(","):
                break
        return self.node("VariableDeclaration", start, kind=kind, declarations=out)

    def function_statement(self, start: int) -> Node:
        return self.function(start, declaration=True)

    def class_statement(self, start: int) -> Node:
        return self.class_(start, declaration=True)

    def if_statement(self, start: int) -> Node:
        self.advance()
        test, consequent = self.paren(), self.statement()
        alternate = self.statement() if self.eat("else") else None
        return self.node("IfStatement", start, test=test, consequent=consequent, alternate=alternate)

    def while_statement(self, start: int) -> Node:
        self.advance()
        test = self.paren()
        body = self.statement()
        return self.node("WhileStatement", start, test=test, body=body)

    def do_statement(self, start: int) -> Node:
        self.advance()
        body = self.statement()
        self.expect("while")
        test = self.paren()
        self.eat(";")
        return self.node("DoWhileStatement", start, body=body, test=test)

    def for_statement(self, start: int) -> Node:
        self.advance()
        waits = self.word("await")
        if waits:
            self.advance()
        self.expect("(")
        init, at = None, self.token.start
        no_in, self.no_in = self.no_in, True
        try:
            if self.is_("var", "const") or (self.word("let") and self.peek().text != "of" and self.peek().text != "in"):
                init = self.variables(at)
            elif not self.is_(";"):
                init = self.expression()
        finally:
            self.no_in = no_in
        if init is not None and (self.is_("in") or self.word("of")):
            kind = "ForInStatement" if self.advance().text == "in" else "ForOfStatement"
            if init["type"] != "VariableDeclaration":
                init = self.to_pattern(init)
            right = self.expression() if kind == "ForInStatement" else self.assignment()
            self.expect(")")
            body = self.statement()
            more = {"await": waits} if kind == "ForOfStatement" else {}
            return self.node(kind, start, left=init, right=right, body=body, **more)
        self.expect(";")
        test = None if self.is_(";") else self.expression()
        self.expect(";")
        update = None if self.is_(")") else self.expression()
        self.expect(")")
        body = self.statement()
        return self.node("ForStatement", start, init=init, test=test, update=update, body=body)

    def return_statement(self, start: int) -> Node:
        self.advance()
        argument = None if self.is_(";", "}") or self.token.kind == "end" or self.token.after_newline else self.expression()
        self.semicolon()
        return self.node("ReturnStatement", start, argument=argument)

    def throw_statement(self, start: int) -> Node:
        self.advance()
        if self.token.after_newline:
            raise self.fail("Illegal newline after throw")
        argument = self.expression()
        self.semicolon()
        return self.node("ThrowStatement", start, argument=argument)

    def _jump(self, start: int, kind: str) -> Node:
        self.advance()
        label = self.identifier() if self.token.kind == "name" and not self.token.after_newline else None
        self.semicolon()
        return self.node(kind, start, label=label)

    def break_statement(self, start: int) -> Node:
        return self._jump(start, "BreakStatement")

    def continue_statement(self, start: int) -> Node:
        return self._jump(start, "ContinueStatement")

    def debugger_statement(self, start: int) -> Node:
        self.advance()
        self.semicolon()
        return self.node("DebuggerStatement", start)

    def with_statement(self, start: int) -> Node:
        self.advance()
        subject, body = self.paren(), self.statement()
        return self.node("WithStatement", start, object=subject, body=body)

    def switch_statement(self, start: int) -> Node:
        self.advance()
        subject = self.paren()
        self.expect("{")
        cases = []
        while not self.is_("}"):
            at = self.token.start
            test = None
            if self.eat("case"):
                test = self.expression()
            else:
                self.expect("default")
            self.expect(":")
            body = []
            while not self.is_("case", "default", "}"):
                body.append(self.statement())
            cases.append(self.node("SwitchCase", at, test=test, consequent=body))
        self.advance()
        return self.node("SwitchStatement", start, discriminant=subject, cases=cases)

    def try_statement(self, start: int) -> Node:
        self.advance()
        block, handler, finalizer = self.block(), None, None
        if self.is_("catch"):
            at = self.advance().start
            param = None
            if self.eat("("):
                param = self.binding_target()
                if self.ts and self.is_(":"):
                    param["typeAnnotation"] = self.type_annotation()
                self.expect(")")
            handler = self.node("CatchClause", at, param=param, body=self.block()) | {"end": self.last_end}
        if self.eat("finally"):
            finalizer = self.block()
        if handler is None and finalizer is None:
            raise self.fail("Missing catch or finally")
        return self.node("TryStatement", start, block=block, handler=handler, finalizer=finalizer)

    def module_name(self) -> Node:
        if self.token.kind in ("name", "keyword"):
            return self.identifier(any_word=True)
        if self.token.kind == "string":
            return self.literal()
        raise self.fail()

    def import_statement(self, start: int) -> Node:
        self.advance()
        kind = "value"
        if self.word("type") and self.peek().text not in ("from", ",") and self.peek().kind != "string":
            self.advance()
            kind = "type"
        specifiers = []
        if self.token.kind != "string":
            if self.token.kind == "name":
                at = self.token.start
                local = self.identifier()
                if self.ts and self.eat("="):
                    reference = self.expression()
                    self.semicolon()
                    return self.node("TSImportEqualsDeclaration", start, id=local, moduleReference=reference)
                specifiers.append(self.node("ImportDefaultSpecifier", at, local=local))
                self.eat(",")
            if self.is_("*"):
                at = self.advance().start
                self.advance()
                specifiers.append(self.node("ImportNamespaceSpecifier", at, local=self.identifier()) | {"end": self.last_end})
            elif self.eat("{"):
                while not self.is_("}"):
                    at = self.token.start
                    if self.word("type") and self.peek().text not in (",", "}", "as"):
                        self.advance()
                    imported = self.module_name()
                    local = self.identifier() if self.word("as") and self.advance() else dict(imported)
                    specifiers.append(self.node("ImportSpecifier", at, imported=imported, local=local))
                    if not self.eat(","):
                        break
                self.expect("}")
            if not self.word("from"):
                raise self.fail()
            self.advance()
        source = self.literal()
        if self.is_("with") or self.word("assert"):
            self.advance()
            self.primary()
        self.semicolon()
        return self.node("ImportDeclaration", start, specifiers=specifiers, source=source, importKind=kind)

    def export_statement(self, start: int) -> Node:
        self.advance()
        if self.eat("*"):
            exported = None
            if self.word("as"):
                self.advance()
                exported = self.module_name()
            self.advance()
            source = self.literal()
            self.semicolon()
            return self.node("ExportAllDeclaration", start, exported=exported, source=source)
        if self.eat("default"):
            at = self.token.start
            if self.is_("function") or (self.word("async") and self.peek().text == "function"):
                d = self.function(at, declaration=True)
            elif self.is_("class"):
                d = self.class_(at, declaration=True)
            elif self.ts and self.word("interface", "abstract"):
                d = self.statement()
            else:
                d = self.assignment()
                self.semicolon()
            return self.node("ExportDefaultDeclaration", start, declaration=d)
        if self.ts and self.eat("="):
            e = self.expression()
            self.semicolon()
            return self.node("TSExportAssignment", start, expression=e)
        if self.word("type") and self.peek().text == "{":
            self.advance()
        if self.eat("{"):
            specifiers, source = [], None
            while not self.is_("}"):
                at = self.token.start
                local = self.module_name()
                exported = self.module_name() if self.word("as") and self.advance() else dict(local)
                specifiers.append(self.node("ExportSpecifier", at, local=local, exported=exported))
                if not self.eat(","):
                    break
            self.expect("}")
            if self.word("from"):
                self.advance()
                source = self.literal()
            self.semicolon()
            return self.node("ExportNamedDeclaration", start, declaration=None, specifiers=specifiers, source=source)
        d = self.statement()
        return self.node("ExportNamedDeclaration", start, declaration=d, specifiers=[], source=None)

    # -- functions and classes ------------------------------------------------------------

    def function(self, start: int, declaration: bool) -> Node:
        is_async = self.word("async")
        if is_async:
            self.advance()
        self.expect("function")
        generator = self.eat("*")
        name = self.identifier() if self.token.kind == "name" else None
        return self.function_rest(start, "FunctionDeclaration" if declaration else "FunctionExpression", name, is_async, generator)

    def function_rest(self, start: int, kind: str, name: Node | None, is_async: bool, generator: bool) -> Node:
        more = {}
        if self.ts and self.is_("<"):
            more["typeParameters"] = self.type_parameters()
        params = self.params()
        if self.ts and self.is_(":"):
            more["returnType"] = self.type_annotation()
        body = None
        if self.is_("{"):
            body = self.function_body()
        elif self.ts:
            self.semicolon()
            kind = "TSDeclareFunction" if kind == "FunctionDeclaration" else "TSEmptyBodyFunctionExpression"
        else:
            raise self.fail()
        return self.node(kind, start, id=name, generator=generator, expression=False, params=params, body=body, **{"async": is_async}, **more)

    def params(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.is_(")"):
            out.append(self.param())
            if not self.eat(","):
                break
        self.expect(")")
        return out

    def param(self) -> Node:
        start = self.token.start
        decorators = self.decorators()
        modifiers = []
        while self.ts and self.word("public", "private", "protected", "readonly", "override") and self.peek().text not in (",", ")", ":", "=", "?"):
            modifiers.append(self.advance().text)
        p = self.binding_element()
        if modifiers:
            access = next((m for m in modifiers if m in ("public", "private", "protected")), None)
            p = self.node("TSParameterProperty", start, parameter=p, accessibility=access, readonly="readonly" in modifiers)
        if decorators:
            p["decorators"] = decorators
        return p

    def binding_element(self) -> Node:
        start = self.token.start
        if self.eat("..."):
            e = self.node("RestElement", start, argument=self.binding_target())
            self.annotate(e)
            return e
        target = self.binding_target()
        if self.ts and self.is_("?"):
            self.advance()
            target["optional"] = True
        self.annotate(target)
        if self.eat("="):
            right = self.assignment()
            return self.node("AssignmentPattern", start, left=target, right=right)
        return target

    def annotate(self, target: Node) -> None:
        if self.ts and self.is_(":"):
            target["typeAnnotation"] = self.type_annotation()
        target["end"] = self.last_end

    def binding_target(self) -> Node:
        start = self.token.start
        if self.eat("["):
            elements: list[Node | None] = []
            while not self.is_("]"):
                if self.is_(","):
                    self.advance()
                    elements.append(None)
                    continue
                elements.append(self.binding_element())
                if not self.is_("]"):
                    self.expect(",")
            self.advance()
            return self.node("ArrayPattern", start, elements=elements)
        if self.eat("{"):
            properties = []
            while not self.is_("}"):
                at = self.token.start
                if self.is_("..."):
                    properties.append(self.binding_element())
                else:
                    key, computed = self.property_key()
                    if self.eat(":"):
                        value, shorthand = self.binding_element(), False
                    else:
                        value, shorthand = dict(key), True
                        if self.eat("="):
                            right = self.assignment()
                            value = self.node("AssignmentPattern", at, left=value, right=right)
                    properties.append(self.node("Property", at, key=key, value=value, kind="init", computed=computed, method=False, shorthand=shorthand))
                if not self.eat(","):
                    break
            self.expect("}")
            return self.node("ObjectPattern", start, properties=properties)
        if self.is_("this"):
            self.advance()
            return self.node("Identifier", start, name="this")
        return self.identifier()

    def decorators(self) -> list[Node]:
        out = []
        while self.is_("@"):
            at = self.advance().start
            out.append(self.node("Decorator", at, expression=self.subscripts(self.primary(), at, calls=True)) | {"end": self.last_end})
        return out

    def class_(self, start: int, declaration: bool) -> Node:
        self.expect("class")
        name = self.identifier() if self.token.kind == "name" and self.token.text != "implements" else None
        more = {}
        if self.ts and self.is_("<"):
            more["typeParameters"] = self.type_parameters()
        parent = None
        if self.eat("extends"):
            parent = self.subscripts(self.primary(), self.token.start, calls=True)
            if self.ts and self.is_("<"):
                more["superTypeArguments"] = self.type_arguments()
        if self.ts and self.word("implements"):
            self.advance()
            more["implements"] = [self.type_()]
            while self.eat(","):
                more["implements"].append(self.type_())
        at = self.expect("{").start
        members = []
        while not self.is_("}"):
            if not self.eat(";"):
                members.append(self.member())
        self.advance()
        body = self.node("ClassBody", at, body=members)
        return self.node("ClassDeclaration" if declaration else "ClassExpression", start, id=name, superClass=parent, body=body, **more)

    def _is_modifier(self) -> bool:
        after = self.peek()
        return after.text not in ("(", "=", ";", "}", ",", ":", "?", "!", "<") and after.kind != "end" and not (after.after_newline and self.token.text not in ("static", "public", "private", "protected", "async"))

    def member(self) -> Node:
        start = self.token.start
        decorators = self.decorators()
        flags: set[str] = set()
        while self.token.kind == "name" and ((self.ts and self.token.text in MODIFIERS) or self.token.text == "static") and self._is_modifier():
            if self.token.text == "static" and self.peek().text == "{":
                self.advance()
                self.advance()
                body = []
                while not self.is_("}"):
                    body.append(self.statement())
                self.advance()
                return self.node("StaticBlock", start, body=body)
            flags.add(self.advance().text)
        is_async = generator = False
        kind = "method"
        accessor = self.word("accessor") and self._is_modifier() and not self.peek().after_newline and bool(self.advance())
        if self.word("async") and self._is_modifier() and not self.peek().after_newline:
            self.advance()
            is_async = True
        if self.eat("*"):
            generator = True
        if self.word("get", "set") and self._is_modifier():
            kind = self.advance().text
        if self.ts and self.is_("[") and (index := self.index_signature(start)):
            return index
        key, computed = self.property_key()
        common = {"key": key, "computed": computed, "static": "static" in flags}
        if decorators:
            common["decorators"] = decorators
        if self.ts:
            common |= {"accessibility": next((f for f in ("public", "private", "protected") if f in flags), None), "readonly": "readonly" in flags, "abstract": "abstract" in flags, "override": "override" in flags, "declare": "declare" in flags}
            common["optional"] = self.eat("?")
            if self.is_("!"):
                self.advance()
        if self.is_("(", "<"):
            if kind == "method" and not computed and key.get("name") == "constructor" and "static" not in flags:
                kind = "constructor"
            value = self.function_rest(self.token.start, "FunctionExpression", None, is_async, generator)
            return self.node("MethodDefinition", start, value=value, kind=kind, **common)
        if self.ts and self.is_(":"):
            common["typeAnnotation"] = self.type_annotation()
        value = self.assignment() if self.eat("=") else None
        self.semicolon()
        return self.node("AccessorProperty" if accessor else "PropertyDefinition", start, value=value, **common)

    def property_key(self) -> tuple[Node, bool]:
        if self.eat("["):
            key = self.assignment()
            self.expect("]")
            return key, True
        if self.token.kind in ("string", "number"):
            return self.literal(), False
        if self.token.kind == "private":
            t = self.advance()
            return self.node("PrivateIdentifier", t.start, name=t.text[1:]), False
        return self.identifier(any_word=True), False

    def identifier(self, any_word: bool = False) -> Node:
        t = self.token
        if t.kind != "name" and not (any_word and t.kind == "keyword"):
            raise self.fail()
        self.advance()
        return self.node("Identifier", t.start, name=cooked(t.text) if "\\" in t.text else t.text)

    # -- expressions ----------------------------------------------------------------------

    def expression(self) -> Node:
        start = self.token.start
        e = self.assignment()
        if self.is_(","):
            parts = [e]
            while self.eat(","):
                parts.append(self.assignment())
            return self.node("SequenceExpression", start, expressions=parts)
        return e

    def assignment(self) -> Node:
        start = self.token.start
        if self.word("yield") and not self.peek().text == "=>":
            return self.yield_(start)
        if arrow := self.arrow(start):
            return arrow
        left = self.conditional()
        if self.token.kind == "punct" and self.token.text in ASSIGN:
            operator = self.token.text
            if operator == "=":
                left = self.to_pattern(left)
            elif left["type"] not in ("Identifier", "MemberExpression", "TSNonNullExpression", "TSAsExpression"):
                raise self.fail("Invalid assignment target")
            self.advance()
            right = self.assignment()
            return self.node("AssignmentExpression", start, operator=operator, left=left, right=right)
        return left

    def yield_(self, start: int) -> Node:
        self.advance()
        delegate = not self.token.after_newline and self.eat("*")
        empty = self.token.kind == "end" or self.token.after_newline or self.is_(")", "]", "}", ",", ";", ":", "in")
        argument = None if empty and not delegate else self.assignment()
        return self.node("YieldExpression", start, delegate=delegate, argument=argument)

    def arrow(self, start: int) -> Node | None:
        t = self.token
        is_async = self.word("async") and not self.peek().after_newline
        if is_async:
            after = self.peek()
            if after.kind != "name" and after.text not in ("(", "<"):
                is_async = False
        if not (t.kind == "name" or self.is_("(") or (self.ts and self.is_("<"))) or start in self.no_arrow:
            return None
        if t.kind == "name" and not is_async and self.peek().text != "=>":
            return None
        mark = self.mark()
        try:
            if is_async:
                self.advance()
            more = {}
            if self.is_("(", "<"):
                if self.is_("<"):
                    more["typeParameters"] = self.type_parameters()
                params = self.params()
                if self.ts and self.is_(":"):
                    more["returnType"] = self.type_annotation()
            else:
                params = [self.identifier()]
            if not self.is_("=>") or self.token.after_newline:
                raise self.fail()
        except ScriptError:
            self.reset(mark)
            self.no_arrow.add(start)
            return None
        self.advance()
        if self.is_("{"):
            body, expression = self.function_body(), False
        else:
            body, expression = self.assignment(), True
        return self.node("ArrowFunctionExpression", start, id=None, generator=False, params=params, body=body, expression=expression, **{"async": is_async}, **more)

    def to_pattern(self, e: Node) -> Node:
        kind = e["type"]
        if kind in ("Identifier", "MemberExpression", "ArrayPattern", "ObjectPattern", "AssignmentPattern", "RestElement", "TSNonNullExpression", "TSAsExpression"):
            return e
        if kind == "ArrayExpression":
            return e | {"type": "ArrayPattern", "elements": [x and self.to_pattern(x) for x in e["elements"]]}
        if kind == "ObjectExpression":
            return e | {"type": "ObjectPattern", "properties": [self.to_pattern(p) if p["type"] == "SpreadElement" else p | {"value": self.to_pattern(p["value"])} for p in e["properties"]]}
        if kind == "SpreadElement":
            return e | {"type": "RestElement", "argument": self.to_pattern(e["argument"])}
        if kind == "AssignmentExpression" and e["operator"] == "=":
            return {"type": "AssignmentPattern", "start": e["start"], "end": e["end"], "left": e["left"], "right": e["right"]}
        raise self.fail("Invalid assignment target")

    def conditional(self) -> Node:
        start = self.token.start
        test = self.binary(0)
        if not self.is_("?"):
            return test
        self.advance()
        no_in, self.no_in = self.no_in, False
        consequent = self.assignment()
        self.no_in = no_in
        self.expect(":")
        alternate = self.assignment()
        return self.node("ConditionalExpression", start, test=test, consequent=consequent, alternate=alternate)

    def binary(self, least: int) -> Node:
        start = self.token.start
        if self.token.kind == "private":
            t = self.advance()
            left = self.node("PrivateIdentifier", t.start, name=t.text[1:])
        else:
            left = self.unary()
        while True:
            operator = self.token.text
            if self.ts and self.word("as", "satisfies") and not self.token.after_newline and least < 8:
                kind = "TSAsExpression" if self.advance().text == "as" else "TSSatisfiesExpression"
                if self.is_("const"):
                    at = self.advance().start
                    annotation = self.node("TSTypeReference", at, typeName=self.node("Identifier", at, name="const"))
                else:
                    annotation = self.type_()
                left = self.node(kind, start, expression=left, typeAnnotation=annotation)
                continue
            if self.token.kind not in ("punct", "keyword") or operator not in BINARY or (operator == "in" and self.no_in):
                return left
            strength = BINARY[operator]
            if strength <= least:
                return left
            self.advance()
            right = self.binary(strength - 1 if operator == "**" else strength)
            kind = "LogicalExpression" if operator in ("&&", "||", "??") else "BinaryExpression"
            left = self.node(kind, start, operator=operator, left=left, right=right)

    def unary(self) -> Node:
        t = self.token
        if t.kind in ("punct", "keyword") and t.text in UNARY:
            self.advance()
            argument = self.unary()
            return self.node("UnaryExpression", t.start, operator=t.text, prefix=True, argument=argument)
        if self.is_("++", "--"):
            self.advance()
            argument = self.unary()
            return self.node("UpdateExpression", t.start, operator=t.text, prefix=True, argument=argument)
        if self.word("await"):
            after = self.peek()
            if not after.after_newline and (after.kind in ("name", "string", "number", "template", "private") or after.text in ("(", "[", "{", "new", "function", "this", "class", "import", "super", "null", "true", "false", "!", "+", "-")):
                self.advance()
                argument = self.unary()
                return self.node("AwaitExpression", t.start, argument=argument)
        if self.ts and not self.jsx and self.is_("<"):
            self.advance()
            annotation = self.type_()
            self.expect(">")
            e = self.unary()
            return self.node("TSTypeAssertion", t.start, typeAnnotation=annotation, expression=e)
        e = self.subscripts(self.primary(), t.start, calls=True)
        if self.is_("++", "--") and not self.token.after_newline:
            operator = self.advance().text
            return self.node("UpdateExpression", t.start, operator=operator, prefix=False, argument=e)
        return e

    def subscripts(self, e: Node, start: int, calls: bool) -> Node:
        chain = False
        while True:
            optional = False
            if self.is_("?.") and calls:
                self.advance()
                chain = optional = True
                if not self.is_("(", "[") and self.token.kind != "template":
                    e = self.node("MemberExpression", start, object=e, property=self.member_name(), computed=False, optional=True) | {"end": self.last_end}
                    continue
            if not optional and self.eat("."):
                e = self.node("MemberExpression", start, object=e, property=self.member_name(), computed=False, optional=False) | {"end": self.last_end}
            elif self.eat("["):
                no_in, self.no_in = self.no_in, False
                key = self.expression()
                self.no_in = no_in
                self.expect("]")
                e = self.node("MemberExpression", start, object=e, property=key, computed=True, optional=optional)
            elif calls and self.is_("("):
                arguments = self.arguments()
                e = self.node("CallExpression", start, callee=e, arguments=arguments, optional=optional)
            elif self.token.kind == "template":
                quasi = self.template()
                e = self.node("TaggedTemplateExpression", start, tag=e, quasi=quasi)
            elif self.ts and self.is_("!") and not self.token.after_newline:
                self.advance()
                e = self.node("TSNonNullExpression", start, expression=e)
            elif self.ts and self.is_("<") and calls and (made := self.generic_call(e, start)):
                e = made
            else:
                return self.node("ChainExpression", start, expression=e) if chain else e

    def generic_call(self, e: Node, start: int) -> Node | None:
        mark = self.mark()
        try:
            types = self.type_arguments()
            if not self.is_("(") and self.token.kind != "template":
                raise self.fail()
        except ScriptError:
            self.reset(mark)
            return None
        if self.token.kind == "template":
            return self.node("TaggedTemplateExpression", start, tag=e, typeArguments=types, quasi=self.template()) | {"end": self.last_end}
        arguments = self.arguments()
        return self.node("CallExpression", start, callee=e, typeArguments=types, arguments=arguments, optional=False)

    def member_name(self) -> Node:
        if self.token.kind == "private":
            t = self.advance()
            return self.node("PrivateIdentifier", t.start, name=t.text[1:])
        return self.identifier(any_word=True)

    def arguments(self) -> list[Node]:
        self.expect("(")
        no_in, self.no_in = self.no_in, False
        out = []
        while not self.is_(")"):
            out.append(self.spread())
            if not self.eat(","):
                break
        self.no_in = no_in
        self.expect(")")
        return out

    def spread(self) -> Node:
        start = self.token.start
        if self.eat("..."):
            argument = self.assignment()
            return self.node("SpreadElement", start, argument=argument)
        return self.assignment()

    def literal(self) -> Node:
        t = self.advance()
        if t.kind == "string":
            return self.node("Literal", t.start, literal="string", value=cooked(t.text[1:-1]), raw=t.text)
        if t.kind == "number":
            if t.text.endswith("n"):
                return self.node("Literal", t.start, literal="bigint", value=t.text.replace("_", "")[:-1], raw=t.text, bigint=t.text.replace("_", "")[:-1])
            return self.node("Literal", t.start, literal="number", value=number_value(t.text), raw=t.text)
        raise ScriptError(f"Unexpected token {t.text}", t.start)

    def primary(self) -> Node:
        t = self.token
        start = t.start
        if t.kind in ("number", "string"):
            return self.literal()
        if t.kind == "template":
            return self.template()
        if t.kind == "name":
            if t.text == "async" and self.peek().text == "function" and not self.peek().after_newline:
                return self.function(start, declaration=False)
            return self.identifier()
        if t.kind == "keyword":
            if t.text in ("true", "false", "null"):
                self.advance()
                return self.node("Literal", start, literal="null" if t.text == "null" else "boolean", value={"true": True, "false": False, "null": None}[t.text], raw=t.text)
            if t.text in ("this", "super"):
                self.advance()
                return self.node("ThisExpression" if t.text == "this" else "Super", start)
            if t.text == "function":
                return self.function(start, declaration=False)
            if t.text == "class":
                return self.class_(start, declaration=False)
            if t.text == "new":
                return self.new(start)
            if t.text == "import":
                self.advance()
                meta = self.node("Identifier", start, name="import")
                if self.eat("."):
                    return self.node("MetaProperty", start, meta=meta, property=self.identifier(any_word=True)) | {"end": self.last_end}
                args = self.arguments()
                return self.node("ImportExpression", start, source=args[0] if args else None)
            raise self.fail()
        if self.is_("("):
            self.advance()
            no_in, self.no_in = self.no_in, False
            e = self.expression()
            self.no_in = no_in
            self.expect(")")
            return e | {"parenthesized": True}
        if self.is_("["):
            return self.array(start)
        if self.is_("{"):
            return self.object(start)
        if self.is_("/", "/="):
            self.token = self.lexer.regex_at(start, t.after_newline)
            raw = self.advance().text
            body, _, flags = raw[1:].rpartition("/")
            return self.node("Literal", start, literal="regex", value=raw, raw=raw, regex_pattern=body, regex_flags=flags)
        if self.is_("<") and self.jsx:
            return self.jsx_element()
        if self.is_("@"):
            decorators = self.decorators()
            return self.class_(self.token.start, declaration=False) | {"decorators": decorators}
        raise self.fail()

    def new(self, start: int) -> Node:
        self.advance()
        if self.eat("."):
            meta = self.node("Identifier", start, name="new")
            return self.node("MetaProperty", start, meta=meta, property=self.identifier()) | {"end": self.last_end}
        at = self.token.start
        callee = self.subscripts(self.primary(), at, calls=False)
        more = {"typeArguments": self.type_arguments()} if self.ts and self.is_("<") else {}
        has_parens = self.is_("(")
        arguments = self.arguments() if has_parens else []
        return self.node("NewExpression", start, callee=callee, arguments=arguments, hasParens=has_parens, **more)

    def array(self, start: int) -> Node:
        self.advance()
        no_in, self.no_in = self.no_in, False
        elements: list[Node | None] = []
        while not self.is_("]"):
            if self.is_(","):
                self.advance()
                elements.append(None)
                continue
            elements.append(self.spread())
            if not self.is_("]"):
                self.expect(",")
        self.no_in = no_in
        self.advance()
        return self.node("ArrayExpression", start, elements=elements)

    def object(self, start: int) -> Node:
        self.advance()
        no_in, self.no_in = self.no_in, False
        properties = []
        while not self.is_("}"):
            properties.append(self.property())
            if not self.eat(","):
                break
        self.no_in = no_in
        self.expect("}")
        return self.node("ObjectExpression", start, properties=properties)

    def property(self) -> Node:
        start = self.token.start
        if self.is_("..."):
            return self.spread()
        is_async = generator = False
        kind = "init"
        ends = ("(", ":", ",", "}", "=")
        if self.word("async") and self.peek().text not in ends:
            self.advance()
            is_async = True
        if self.eat("*"):
            generator = True
        if self.word("get", "set") and self.peek().text not in ends:
            kind = self.advance().text
        key, computed = self.property_key()
        if self.is_("(", "<"):
            value = self.function_rest(self.token.start, "FunctionExpression", None, is_async, generator)
            return self.node("Property", start, key=key, value=value, kind=kind, computed=computed, method=kind == "init", shorthand=False)
        if self.eat(":"):
            value = self.assignment()
            return self.node("Property", start, key=key, value=value, kind="init", computed=computed, method=False, shorthand=False)
        if key["type"] != "Identifier" or computed:
            raise self.fail()
        value: Node = dict(key)
        if self.eat("="):  # only good if this becomes a pattern
            right = self.assignment()
            value = self.node("AssignmentPattern", start, left=value, right=right)
        return self.node("Property", start, key=key, value=value, kind="init", computed=False, method=False, shorthand=True)

    def template(self) -> Node:
        start = self.token.start
        quasis, expressions = [], []
        at = start + 1
        while True:
            raw, end, tail = self.lexer.template_part(at)
            quasis.append({"type": "TemplateElement", "start": at, "end": at + len(raw), "raw": raw, "value": cooked(raw), "tail": tail})
            self.tokens.append(Token("template", self.source[at - 1 : end], at - 1, end, False))
            self.last_end = self.lexer.at = end
            self.token = self.lexer.next()
            if tail:
                return self.node("TemplateLiteral", start, quasis=quasis, expressions=expressions) | {"end": end}
            expressions.append(self.expression())
            if not self.is_("}"):
                raise self.fail()
            at = self.token.start + 1

    # -- JSX ------------------------------------------------------------------------------

    def jsx_name(self) -> Node:
        start, name = self.token.start, self.identifier(any_word=True)["name"]
        while self.is_("-", ":", "."):
            name += self.advance().text + self.identifier(any_word=True)["name"]
        return self.node("JSXIdentifier", start, name=name)

    def jsx_element(self) -> Node:
        start = self.expect("<").start
        if self.is_(">"):
            return self.jsx_children(start, None, [])
        name, attributes = self.jsx_name(), []
        while not self.is_(">", "/"):
            at = self.token.start
            if self.eat("{"):
                self.expect("...")
                attributes.append(self.node("JSXSpreadAttribute", at, argument=self.assignment()))
                self.expect("}")
                continue
            key, value = self.jsx_name(), None
            if self.eat("="):
                if self.token.kind == "string":
                    value = self.literal()
                elif self.is_("{"):
                    v = self.advance().start
                    value = self.node("JSXExpressionContainer", v, expression=self.expression())
                    self.expect("}")
                else:
                    value = self.jsx_element()
            attributes.append(self.node("JSXAttribute", at, name=key, value=value))
        if self.eat("/"):
            self.expect(">")
            opening = self.node("JSXOpeningElement", start, name=name, attributes=attributes, selfClosing=True)
            return self.node("JSXElement", start, openingElement=opening, children=[], closingElement=None)
        return self.jsx_children(start, name, attributes)

    def jsx_children(self, start: int, name: Node | None, attributes: list[Node]) -> Node:
        end = self.token.end
        opening = {"type": "JSXOpeningElement" if name else "JSXOpeningFragment", "start": start, "end": end, "name": name, "attributes": attributes, "selfClosing": False}
        self.tokens.append(self.token)
        children: list[Node] = []
        at = end
        while True:
            stop = at
            while stop < len(self.source) and self.source[stop] not in "<{":
                stop += 1
            if stop >= len(self.source):
                raise ScriptError("Unterminated JSX", at)
            if stop > at:
                children.append({"type": "JSXText", "start": at, "end": stop, "value": self.source[at:stop], "raw": self.source[at:stop]})
            self.lexer.at = stop
            self.token = self.lexer.next()
            if self.is_("{"):
                v = self.advance().start
                inner = self.node("JSXEmptyExpression", v) if self.is_("}") else self.expression()
                if not self.is_("}"):
                    raise self.fail()
                at = self.token.end
                self.tokens.append(self.token)
                children.append({"type": "JSXExpressionContainer", "start": v, "end": at, "expression": inner})
                continue
            if self.peek().text == "/":
                v = self.advance().start
                self.advance()
                closing = self.jsx_name() if name else None
                self.expect(">")
                tail = self.node("JSXClosingElement" if name else "JSXClosingFragment", v, name=closing)
                kind = ("JSXElement", "openingElement", "closingElement") if name else ("JSXFragment", "openingFragment", "closingFragment")
                return self.node(kind[0], start, **{kind[1]: opening, "children": children, kind[2]: tail})
            child = self.jsx_element()
            children.append(child)
            at = child["end"]

    # -- TypeScript -----------------------------------------------------------------------

    def ts_statement(self, start: int, text: str, after: Token) -> Node | None:
        if after.after_newline:
            return None
        if text == "interface" and after.kind == "name":
            self.advance()
            name = self.identifier()
            more = {"typeParameters": self.type_parameters()} if self.is_("<") else {}
            extends = []
            if self.eat("extends"):
                extends.append(self.type_())
                while self.eat(","):
                    extends.append(self.type_())
            at = self.token.start
            body = self.node("TSInterfaceBody", at, body=self.type_members()) | {"end": self.last_end}
            return self.node("TSInterfaceDeclaration", start, id=name, extends=extends, body=body, **more)
        if text == "type" and after.kind == "name":
            self.advance()
            name = self.identifier()
            more = {"typeParameters": self.type_parameters()} if self.is_("<") else {}
            self.expect("=")
            annotation = self.type_()
            self.semicolon()
            return self.node("TSTypeAliasDeclaration", start, id=name, typeAnnotation=annotation, **more)
        if text in ("namespace", "module") and (after.kind in ("name", "string")):
            keyword = self.advance().text
            name = self.module_name()
            while self.eat("."):
                name = self.node("TSQualifiedName", name["start"], left=name, right=self.identifier()) | {"end": self.last_end}
            body = None
            if self.is_("{"):
                at = self.token.start
                body = self.node("TSModuleBlock", at, body=self.block()["body"]) | {"end": self.last_end}
            else:
                self.semicolon()
            return self.node("TSModuleDeclaration", start, id=name, kind=keyword, body=body)
        if text in ("declare", "abstract") and (after.kind in ("name", "keyword")):
            self.advance()
            if self.word("global") and self.peek().text == "{":
                name, at = self.identifier(), self.token.start
                body = self.node("TSModuleBlock", at, body=self.block()["body"]) | {"end": self.last_end}
                return self.node("TSModuleDeclaration", start, id=name, kind="global", body=body, declare=True)
            return self.statement() | {text: True, "start": start}
        return None

    def ts_enum(self, start: int) -> Node:
        const = self.eat("const")
        self.expect("enum")
        name = self.identifier()
        self.expect("{")
        members = []
        while not self.is_("}"):
            at = self.token.start
            key, computed = self.property_key()
            init = self.assignment() if self.eat("=") else None
            members.append(self.node("TSEnumMember", at, id=key, computed=computed, initializer=init))
            if not self.eat(","):
                break
        self.expect("}")
        return self.node("TSEnumDeclaration", start, id=name, members=members, const=const)

    def type_annotation(self) -> Node:
        start = self.expect(":").start
        return self.node("TSTypeAnnotation", start, typeAnnotation=self.type_()) | {"end": self.last_end}

    def close_angle(self) -> None:
        if self.token.kind == "punct" and self.token.text[0] == ">":
            t = self.token
            self.tokens.append(Token("punct", ">", t.start, t.start + 1, t.after_newline))
            self.last_end = self.lexer.at = t.start + 1
            self.token = self.lexer.next()
        else:
            raise self.fail()

    def type_arguments(self) -> Node:
        start = self.expect("<").start
        params = [self.type_()]
        while self.eat(","):
            params.append(self.type_())
        self.close_angle()
        return self.node("TSTypeParameterInstantiation", start, params=params)

    def type_parameters(self) -> Node:
        start = self.expect("<").start
        params = []
        while not self.is_(">"):
            at = self.token.start
            if self.is_("const", "in") or (self.word("out") and self.peek().kind == "name"):
                self.advance()
            name = self.identifier()
            constraint = self.type_() if self.eat("extends") else None
            default = self.type_() if self.eat("=") else None
            params.append(self.node("TSTypeParameter", at, name=name, constraint=constraint, default=default))
            if not self.eat(","):
                break
        self.close_angle()
        return self.node("TSTypeParameterDeclaration", start, params=params)

    def type_(self) -> Node:
        start = self.token.start
        if self.is_("new") or (self.word("abstract") and self.peek().text == "new"):
            self.word("abstract") and self.advance()
            self.advance()
            return self.function_type(start, "TSConstructorType")
        if self.is_("<"):
            return self.function_type(start, "TSFunctionType")
        if self.is_("("):
            mark = self.mark()
            try:
                return self.function_type(start, "TSFunctionType")
            except ScriptError:
                self.reset(mark)
        if self.word("asserts") and self.peek().kind in ("name", "keyword") and not self.peek().after_newline and self.peek().text not in ("is", "extends"):
            self.advance()
            name = self.type_()
            if name["type"] == "TSTypePredicate":
                return name | {"start": start, "asserts": True}
            return self.node("TSTypePredicate", start, parameterName=name, typeAnnotation=None, asserts=True)
        t = self.union_type()
        if self.word("is") and not self.token.after_newline:
            self.advance()
            return self.node("TSTypePredicate", start, parameterName=t, typeAnnotation=self.type_()) | {"end": self.last_end}
        if self.is_("extends") and not self.token.after_newline:
            self.advance()
            extends = self.union_type()
            if self.eat("?"):
                yes = self.type_()
                self.expect(":")
                no = self.type_()
                return self.node("TSConditionalType", start, checkType=t, extendsType=extends, trueType=yes, falseType=no)
            raise self.fail()
        return t

    def function_type(self, start: int, kind: str) -> Node:
        more = {"typeParameters": self.type_parameters()} if self.is_("<") else {}
        params = self.params()
        at = self.expect("=>").start
        result = self.node("TSTypeAnnotation", at, typeAnnotation=self.type_()) | {"end": self.last_end}
        return self.node(kind, start, params=params, returnType=result, **more)

    def union_type(self) -> Node:
        return self._joined("|", "TSUnionType", lambda: self._joined("&", "TSIntersectionType", self.postfix_type))

    def _joined(self, mark: str, kind: str, part) -> Node:
        start = self.token.start
        self.eat(mark)
        types = [part()]
        while self.eat(mark):
            types.append(part())
        return self.node(kind, start, types=types) if len(types) > 1 else types[0]

    def postfix_type(self) -> Node:
        start = self.token.start
        if self.word("keyof", "unique", "readonly", "infer") and self.peek().text not in (",", ">", ")", ";", "=", "|", "&", "["):
            operator = self.advance().text
            if operator == "infer":
                return self.node("TSInferType", start, typeParameter=self.identifier()) | {"end": self.last_end}
            return self.node("TSTypeOperator", start, operator=operator, typeAnnotation=self.postfix_type()) | {"end": self.last_end}
        t = self.simple_type()
        while self.is_("[") and not self.token.after_newline:
            self.advance()
            if self.eat("]"):
                t = self.node("TSArrayType", start, elementType=t)
            else:
                index = self.type_()
                self.expect("]")
                t = self.node("TSIndexedAccessType", start, objectType=t, indexType=index)
        return t

    def simple_type(self) -> Node:
        t = self.token
        start = t.start
        if t.kind in ("string", "number"):
            return self.node("TSLiteralType", start, literal=self.literal()) | {"end": self.last_end}
        if self.is_("-") and self.peek().kind == "number":
            self.advance()
            return self.node("TSLiteralType", start, literal=self.literal()) | {"end": self.last_end}
        if t.kind == "template":
            return self.node("TSTemplateLiteralType", start, literal=self.template()) | {"end": self.last_end}
        if self.is_("true", "false"):
            return self.node("TSLiteralType", start, literal=self.primary()) | {"end": self.last_end}
        if self.is_("this"):
            self.advance()
            return self.node("TSThisType", start)
        if t.text in TS_KEYWORDS and t.kind in ("name", "keyword") and self.peek().text != ".":
            self.advance()
            return self.node(TS_KEYWORDS[t.text], start)
        if self.is_("typeof"):
            self.advance()
            name = self.simple_type() if self.is_("import") else self.entity()
            return self.node("TSTypeQuery", start, exprName=name)
        if self.is_("import"):
            self.advance()
            self.expect("(")
            argument = self.type_()
            self.expect(")")
            qualifier = self.entity() if self.eat(".") else None
            return self.node("TSImportType", start, argument=argument, qualifier=qualifier)
        if self.eat("("):
            inner = self.type_()
            self.expect(")")
            return inner
        if self.eat("["):
            types = []
            while not self.is_("]"):
                at = self.token.start
                if self.eat("..."):
                    types.append(self.node("TSRestType", at, typeAnnotation=self.type_()) | {"end": self.last_end})
                else:
                    e = self.type_()
                    if self.eat("?"):
                        e = self.node("TSOptionalType", at, typeAnnotation=e)
                    if self.eat(":"):
                        e = self.node("TSNamedTupleMember", at, label=e, elementType=self.type_()) | {"end": self.last_end}
                    types.append(e)
                if not self.eat(","):
                    break
            self.expect("]")
            return self.node("TSTupleType", start, elementTypes=types)
        if self.is_("{"):
            return self.node("TSTypeLiteral", start, members=self.type_members()) | {"end": self.last_end}
        name = self.entity()
        more = {"typeArguments": self.type_arguments()} if self.is_("<") and not self.token.after_newline else {}
        return self.node("TSTypeReference", start, typeName=name, **more)

    def entity(self) -> Node:
        name = self.identifier(any_word=True)
        while self.eat("."):
            name = self.node("TSQualifiedName", name["start"], left=name, right=self.identifier(any_word=True)) | {"end": self.last_end}
        return name

    def index_signature(self, start: int) -> Node | None:
        mark = self.mark()
        try:
            self.expect("[")
            parameter = self.identifier()
            self.annotate(parameter)
            if "typeAnnotation" not in parameter:
                raise self.fail()
            self.expect("]")
            annotation = self.type_annotation() if self.is_(":") else None
            self.eat(",") or self.semicolon()
            return self.node("TSIndexSignature", start, parameters=[parameter], typeAnnotation=annotation)
        except ScriptError:
            self.reset(mark)
            return None

    def type_members(self) -> list[Node]:
        self.expect("{")
        out = []
        while not self.is_("}"):
            start = self.token.start
            readonly = False
            if self.is_("-", "+"):
                self.advance()
            if self.word("readonly") and self._is_modifier():
                self.advance()
                readonly = True
            if self.is_("["):
                index = self.index_signature(start) or self.mapped_type(start)
                if index:
                    out.append(index)
                    continue
            if self.is_("(", "<"):
                member = self.signature(start, "TSCallSignatureDeclaration", {})
            elif self.is_("new") and self.peek().text in ("(", "<"):
                self.advance()
                member = self.signature(start, "TSConstructSignatureDeclaration", {})
            else:
                kind = "method"
                if self.word("get", "set") and self._is_modifier():
                    kind = self.advance().text
                key, computed = self.property_key()
                optional = self.eat("?")
                if self.is_("(", "<"):
                    member = self.signature(start, "TSMethodSignature", {"key": key, "computed": computed, "optional": optional, "kind": kind})
                else:
                    annotation = self.type_annotation() if self.is_(":") else None
                    member = self.node("TSPropertySignature", start, key=key, computed=computed, optional=optional, readonly=readonly, typeAnnotation=annotation)
            out.append(member)
            if not self.eat(","):
                self.semicolon()
        self.advance()
        return out

    def mapped_type(self, start: int) -> Node | None:
        mark = self.mark()
        try:
            self.expect("[")
            key = self.identifier()
            self.expect("in")
            constraint = self.type_()
            name = self.type_() if self.word("as") and self.advance() else None
            self.expect("]")
            if self.is_("-", "+"):
                self.advance()
            self.eat("?")
            annotation = self.type_annotation() if self.is_(":") else None
            self.eat(";")
            return self.node("TSMappedType", start, key=key, constraint=constraint, nameType=name, typeAnnotation=annotation)
        except ScriptError:
            self.reset(mark)
            return None

    def signature(self, start: int, kind: str, more: dict) -> Node:
        if self.is_("<"):
            more["typeParameters"] = self.type_parameters()
        params = self.params()
        result = self.type_annotation() if self.is_(":") else None
        return self.node(kind, start, params=params, returnType=result, **more)


def parse(source: str, language: str = "js") -> Parsed:
    """Nodes, tokens and comments of one source; language is js, jsx, ts or tsx.

    Reading goes as deep as the source does: Python's own frames are on the heap, so only the limit on their number is raised.
    """
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 400_000, 12 * len(source)))
    starts = [0]
    for i, c in enumerate(source):
        if c in "\n\u2028\u2029" or (c == "\r" and source[i + 1 : i + 2] != "\n"):
            starts.append(i + 1)
    empty = {"type": "Program", "start": 0, "end": len(source), "sourceType": "script", "body": []}
    try:
        parser = Parser(source, ts=language in ("ts", "tsx"), jsx=language != "ts")
    except ScriptError as e:
        return Parsed(empty, [], [], e, starts)
    program, error = parser.program()
    return Parsed(program, parser.tokens, sorted(parser.lexer.comments, key=lambda c: c.start), error, starts)
