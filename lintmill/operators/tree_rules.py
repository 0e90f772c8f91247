"""Rules that look around in one file's tree: control flow, scopes, types the file says itself, regular expressions, options.

They run where the file is parsed, so their findings leave the parser's task without a shuffle. A rule is a generator over the nodes of
its types; it yields a node, or a node and the data of its message. Message wordings are fixed values.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

from lintmill.functions.early import early
from lintmill.functions.regexes import analyse
from lintmill.functions.tree import CLASSES, FUNCTIONS, LOOPS, NEXT, PRIMITIVES, RETURN, File, Types, call_of, leaves, name_of, options_of, plain, sequence, static, truth


@dataclass(frozen=True)
class TreeRule:
    name: str
    category: str
    message: str
    kinds: tuple[str, ...]
    check: Callable
    languages: str = "all"
    defaults: dict = field(default_factory=dict)
    data: dict | None = None  # the rule itself, where it is data


RULES: dict[str, TreeRule] = {}


def rule(name: str, category: str, message: str, kinds: str, languages: str = "all", **defaults):
    def keep(check: Callable) -> Callable:
        RULES[name] = TreeRule(name, category, message, tuple(kinds.split()), check, languages, defaults)
        return check

    return keep


def find(f: File, name: str, options: list = ()) -> Iterator[tuple[dict, dict]]:
    """(node, data) of each finding of one rule in a file, in order of place."""
    r = RULES[name]
    if r.languages == "ts" and f.language not in ("ts", "tsx"):
        return
    o = options_of(list(options), r.defaults)
    for node in sorted(f.each(*r.kinds), key=lambda n: (n["start"], -n["end"])):
        for found in r.check(f, node, o) or ():
            yield found if isinstance(found, tuple) else (found, {})


def types(f: File) -> Types:
    if not hasattr(f, "types"):
        f.types = Types(f)
    return f.types


_ALL = " ".join(FUNCTIONS)
_LOOPS = " ".join(LOOPS)
_CLASSES = " ".join(CLASSES)


def _body(fn: dict) -> list[dict]:
    return fn["body"]["body"] if fn["body"] is not None and fn["body"]["type"] == "BlockStatement" else []


def _returns(f: File, fn: dict) -> list[dict]:
    return f.below(fn["body"], "ReturnStatement", into=False) if fn["body"] is not None else []


def _in_condition(f: File, node: dict) -> bool:
    """Whether only the truth of an expression counts where it stands."""
    parent, slot = f.parent(node), f.slot(node)
    if parent is None:
        return False
    if parent["type"] in ("IfStatement", "WhileStatement", "DoWhileStatement", "ForStatement", "ConditionalExpression"):
        return slot == "test"
    if parent["type"] == "UnaryExpression":
        return parent["operator"] == "!"
    return parent["type"] == "LogicalExpression" and parent["operator"] != "??" and (slot == "left" or _in_condition(f, parent))


# -- correctness ---------------------------------------------------------------------------

_ARRAY_METHODS = {"every", "filter", "find", "findIndex", "findLast", "findLastIndex", "flatMap", "map", "reduce", "reduceRight", "some", "sort", "toSorted", "from"}


@rule("array-callback-return", "correctness", "Array.prototype.{{method}}() expects a return value from this function.", "FunctionExpression ArrowFunctionExpression", allowImplicit=False, checkForEach=False)
def _(f, fn, o):
    parent = f.parent(fn)
    owner, method = call_of(parent)
    if owner is None or f.slot(fn) != "arguments" or f.index(fn) != (1 if method == "from" else 0) or fn["body"]["type"] != "BlockStatement" or fn.get("generator"):
        return
    if method == "forEach" and o["checkForEach"]:
        yield from ((r, {"method": method}) for r in _returns(f, fn) if r["argument"])
    if method not in _ARRAY_METHODS or (method == "from" and name_of(owner) != "Array"):
        return
    if NEXT in leaves(fn["body"]):
        yield fn, {"method": method}
    elif not o["allowImplicit"]:
        yield from ((r, {"method": method}) for r in _returns(f, fn) if r["argument"] is None)


@rule("no-constant-binary-expression", "correctness", "Unexpected constant {{what}} on the {{side}}-hand side of a `{{operator}}` expression.", "LogicalExpression BinaryExpression")
def _(f, n, o):
    op = n["operator"]
    left = plain(n["left"])
    if n["type"] == "LogicalExpression":
        fixed = left["type"] in ("Literal", "ArrayExpression", "ObjectExpression", "TemplateLiteral", "UnaryExpression", "BinaryExpression", "NewExpression", *FUNCTIONS) and (op != "??" or not (left["type"] == "Literal" and left["value"] is None)) if op == "??" else truth(left) is not None
        if fixed:
            yield n["left"], {"what": "nullishness" if op == "??" else "truthiness", "side": "left", "operator": op}
    elif op in ("==", "!=", "===", "!=="):
        for side in ("left", "right"):
            if plain(n[side])["type"] in ("ArrayExpression", "ObjectExpression", "NewExpression", "ClassExpression", *FUNCTIONS) or (plain(n[side])["type"] == "Literal" and plain(n[side])["literal"] == "regex"):
                if op in ("===", "!=="):
                    yield n[side], {"what": "binary expression", "side": side, "operator": op}
                    return


@rule("no-this-before-super", "correctness", "'{{word}}' is not allowed before 'super()'.", "MethodDefinition")
def _(f, m, o):
    owner = f.parent(f.parent(m))
    if m["kind"] != "constructor" or not owner.get("superClass") or m["value"]["body"] is None:
        return
    calls = [c for c in f.below(m["value"]["body"], "CallExpression", into=False) if c["callee"]["type"] == "Super"]
    sure = min((c["end"] for c in calls if not f.nearest(c, "IfStatement", "ConditionalExpression", "LogicalExpression", *LOOPS, "SwitchStatement", stop=FUNCTIONS)), default=None)
    for use in f.below(m["value"]["body"], "ThisExpression", "Super", into=False):
        called = use["type"] == "Super" and f.parent(use)["type"] == "CallExpression" and f.slot(use) == "callee"
        if not called and (sure is None or use["start"] < sure):
            inside = any(c["end"] <= use["start"] and any(a is b for a in f.above(c) if a["type"] in ("BlockStatement",) for b in f.above(use)) and f.nearest(c, "BlockStatement") in [*f.above(use)] for c in calls)
            if not inside:
                yield use, {"word": "super" if use["type"] == "Super" else "this"}


@rule("no-unexpected-multiline", "correctness", "Unexpected newline between {{what}}.", "CallExpression MemberExpression TaggedTemplateExpression BinaryExpression")
def _(f, n, o):
    def breaks(before: dict, mark: str) -> bool:
        token = f.token_after(before["end"])
        while token is not None and token.text == ")" and token.start < n["end"]:
            token = f.token_after(token.end)
        return token is not None and token.text[:1] == mark and token.after_newline

    if n["type"] == "CallExpression" and not n.get("optional") and n["arguments"] and breaks(n["callee"], "("):
        yield n, {"what": "function and ( of function call"}
    elif n["type"] == "MemberExpression" and n["computed"] and not n.get("optional") and breaks(n["object"], "["):
        yield n, {"what": "object and [ of property access"}
    elif n["type"] == "TaggedTemplateExpression" and f.place(n["tag"]["end"])[0] != f.place(n["quasi"]["start"])[0]:
        yield n, {"what": "template tag and template literal"}
    elif n["type"] == "BinaryExpression" and n["operator"] == "/" and n["left"]["type"] == "BinaryExpression" and n["left"]["operator"] == "/":
        token = f.token_after(n["left"]["left"]["end"])
        if token is not None and token.after_newline and re.match(r"[gimsuyd]+$", f.text(n["right"]).split(".")[0]):
            yield n, {"what": "numerator and division operator"}


@rule("no-unreachable-loop", "correctness", "Invalid loop. Its body allows only one iteration.", _LOOPS, ignore=[])
def _(f, loop, o):
    labels, at = [], f.parent(loop)
    while at is not None and at["type"] == "LabeledStatement":
        labels.append(at["label"]["name"])
        at = f.parent(at)
    flow = leaves(loop["body"])
    if loop["type"] not in o["ignore"] and not flow & {NEXT, "continue", *(f"continue {x}" for x in labels)}:
        yield loop


@rule("preserve-caught-error", "correctness", "There is no `cause` attached to the symptom error being thrown.", "ThrowStatement", requireCatchParameter=False)
def _(f, t, o):
    made = plain(t["argument"])
    clause = f.nearest(t, "CatchClause", stop=FUNCTIONS)
    if clause is None or made["type"] not in ("NewExpression", "CallExpression") or name_of(made["callee"]) not in ("Error", "EvalError", "RangeError", "ReferenceError", "SyntaxError", "TypeError", "URIError", "AggregateError") or not f.is_global(plain(made["callee"])):
        return
    if clause["param"] is None:
        if o["requireCatchParameter"]:
            yield t
        return
    at = 2 if name_of(made["callee"]) == "AggregateError" else 1
    if any(a["type"] == "SpreadElement" for a in made["arguments"]):
        return
    given = made["arguments"][at] if len(made["arguments"]) > at else None
    if given is None or given["type"] == "ObjectExpression" and not any(p["type"] == "SpreadElement" or name_of(p) == "cause" and (clause["param"]["type"] != "Identifier" or name_of(p["value"]) == clause["param"]["name"]) for p in given["properties"]):
        yield t


def _regex(f: File, n: dict) -> tuple[str, str] | None:
    """Pattern and flags of a regular expression literal or of RegExp called with plain strings."""
    if n["type"] == "Literal":
        return (n["regex_pattern"], n["regex_flags"]) if n["literal"] == "regex" else None
    if name_of(n["callee"]) == "RegExp" and f.is_global(plain(n["callee"])) and n["arguments"]:
        pattern = static(n["arguments"][0]) if plain(n["arguments"][0])["type"] != "Literal" or plain(n["arguments"][0])["literal"] == "string" else None
        flags = static(n["arguments"][1]) if len(n["arguments"]) > 1 else ""
        return None if pattern is None or flags is None else (pattern, flags)
    return None


@rule("no-loss-of-precision", "correctness", "This number literal will lose precision at runtime.", "Literal")
def _(f, n, o):
    if n["literal"] != "number":
        return
    raw = n["raw"].replace("_", "").lower()
    if re.fullmatch(r"0[xob][0-9a-f]+|0[0-7]+", raw):
        value = int(raw if raw[1:2].isalpha() else f"0o{raw[1:]}", 0)
        if int(float(value)) != value:
            yield n
        return
    mantissa = raw.partition("e")[0]
    digits = mantissa.replace(".", "").lstrip("0").rstrip("0" if "." not in mantissa else "0")
    if digits and not (len(digits) <= 17 and Decimal(f"{float(raw):.{len(digits) - 1}e}") == Decimal(raw)):
        yield n


@rule("no-non-null-asserted-optional-chain", "typescript", "Optional chain expressions can return undefined by design: using a non-null assertion is unsafe and wrong.", "TSNonNullExpression", "ts")
def _(f, n, o):
    inner = n["expression"]
    if inner["type"] == "ChainExpression" or (inner["type"] in ("MemberExpression", "CallExpression") and any(x.get("optional") for x in [inner, *f.below(inner, "MemberExpression", "CallExpression", into=False)])):
        yield n


@rule("no-invalid-regexp", "correctness", "{{why}}.", "NewExpression CallExpression", allowConstructorFlags=[])
def _(f, n, o):
    said = _regex(f, n)
    if said:
        found = analyse(said[0], "".join(c for c in said[1] if c not in "".join(o["allowConstructorFlags"])))
        if found.error:
            yield n, {"why": found.error}


@rule("no-misleading-character-class", "correctness", "Unexpected {{what}} in character class.", "Literal NewExpression CallExpression")
def _(f, n, o):
    said = _regex(f, n)
    if said:
        yield from ((n, {"what": w}) for w in analyse(*said).misleading[:1])


@rule("no-useless-backreference", "correctness", "Backreference '{{reference}}' will be ignored. It {{why}}.", "Literal NewExpression CallExpression")
def _(f, n, o):
    said = _regex(f, n)
    if said:
        yield from ((n, {"reference": r, "why": why}) for r, why in analyse(*said).useless)


@rule("no-dupe-else-if", "correctness", "This branch can never execute. Its condition is a duplicate or covered by previous conditions in the if-else-if chain.", "IfStatement")
def _(f, n, o):
    def parts(e: dict, op: str) -> list[dict]:
        return [*parts(e["left"], op), *parts(e["right"], op)] if e["type"] == "LogicalExpression" and e["operator"] == op else [e]

    alternatives = [[tuple(t.text for t in f.tokens_in(x)) for x in parts(e, "&&")] for e in parts(n["test"], "||")]
    at = n
    while f.parent(at) is not None and f.parent(at)["type"] == "IfStatement" and f.slot(at) == "alternate":
        at = f.parent(at)
        earlier = [[tuple(t.text for t in f.tokens_in(x)) for x in parts(e, "&&")] for e in parts(at["test"], "||")]
        # an alternative is covered if an earlier test asks for no more than it
        alternatives = [a for a in alternatives if not any(set(e) <= set(a) for e in earlier)]
        if not alternatives:
            yield n["test"]
            return


@rule("consistent-return", "suspicious", "Expected {{what}}.", _ALL, treatUndefinedAsUnspecified=False)
def _(f, fn, o):
    if fn["body"] is None or fn["body"]["type"] != "BlockStatement":
        return
    given = _returns(f, fn)
    bare = lambda r: r["argument"] is None or (o["treatUndefinedAsUnspecified"] and (name_of(r["argument"]) == "undefined" or (r["argument"]["type"] == "UnaryExpression" and r["argument"]["operator"] == "void")))
    valued = [r for r in given if not bare(r)]
    if valued:
        first_bare = bare(given[0])
        for r in given:
            if bare(r) != first_bare:
                yield r, {"what": "no return value" if first_bare else "a return value"}
        if NEXT in leaves(fn["body"]) and not first_bare:
            yield fn, {"what": "to return a value at the end"}


@rule("no-useless-return", "style", "Unnecessary return statement.", "ReturnStatement")
def _(f, r, o):
    if r["argument"] is not None:
        return
    at = r
    for parent in f.above(r):
        kind, slot = parent["type"], f.slot(at)
        if kind in FUNCTIONS:
            yield r
            return
        if kind in LOOPS or (kind == "TryStatement" and (slot == "finalizer" or (parent["finalizer"] and slot != "finalizer"))):
            return
        if kind in ("BlockStatement", "SwitchCase") and slot in ("body", "consequent"):
            body = parent["body"] if kind == "BlockStatement" else parent["consequent"]
            if any(s["type"] != "EmptyStatement" and not s["type"].startswith("FunctionDecl") for s in body[f.index(at) + 1 :]):
                return
            if kind == "SwitchCase" and f.index(parent) + 1 < len(f.parent(parent)["cases"]):
                return
        at = parent


@rule("no-useless-assignment", "correctness", "This assigned value is not used in subsequent statements.", "AssignmentExpression VariableDeclarator")
def _(f, n, o):
    target, value = (n["left"], n["right"]) if n["type"] == "AssignmentExpression" else (n["id"], n["init"])
    if target["type"] != "Identifier" or value is None or (n["type"] == "AssignmentExpression" and n["operator"] != "=") or f.nearest(n, *LOOPS, "TryStatement", stop=FUNCTIONS):
        return
    symbol = f.symbol(target)
    if symbol is None or symbol["kind"] not in ("let", "var", "param") or not any(r["is_read"] for r in f.refs_of.get(symbol["symbol_id"], ())):
        return
    uses = [f.node_at(r["node_id"]) for r in f.refs_of.get(symbol["symbol_id"], ())]
    if any(f.function_of(u) is not f.function_of(n) for u in uses):
        return
    block = f.nearest(n, "BlockStatement", "Program", "SwitchCase")
    statement = n
    while f.parent(statement) is not block:
        statement = f.parent(statement)
    if statement["type"] not in ("ExpressionStatement", "VariableDeclaration"):
        return
    reads = {r["node_id"] for r in f.refs_of[symbol["symbol_id"]] if r["is_read"]}
    later = [r for r in f.refs_of[symbol["symbol_id"]] if f.node_at(r["node_id"])["start"] >= n["end"]]
    later.sort(key=lambda r: r["start"])
    if not later:
        yield target if not any(r["start"] > n["end"] for r in f.refs_of[symbol["symbol_id"]] if r["node_id"] in reads) and n["type"] == "AssignmentExpression" else target
        return
    nxt = f.node_at(later[0]["node_id"])
    owner = f.parent(nxt)
    again = owner["type"] == "AssignmentExpression" and f.slot(nxt) == "left" and owner["operator"] == "=" and f.parent(owner)["type"] == "ExpressionStatement" and f.parent(f.parent(owner)) is block
    if again and not any(r["node_id"] in reads and owner["start"] <= r["start"] < owner["end"] for r in later):
        yield target


@rule("no-unmodified-loop-condition", "correctness", "'{{name}}' is not modified in this loop.", "WhileStatement DoWhileStatement ForStatement")
def _(f, loop, o):
    test = loop["test"]
    if test is None or f.below(test, "CallExpression", "MemberExpression", "NewExpression", "TaggedTemplateExpression", "YieldExpression", "AwaitExpression") or test["type"] in ("CallExpression", "MemberExpression"):
        return
    names = [n for n in ([test] if test["type"] == "Identifier" else f.below(test, "Identifier")) if f.symbol(n)]
    changed = {s["symbol_id"] for s in map(f.symbol, names) for r in f.refs_of.get(s["symbol_id"], ()) if r["is_write"] and (loop["start"] <= r["start"] < loop["end"] and not (loop["type"] == "ForStatement" and loop["init"] and loop["init"]["start"] <= r["start"] < loop["init"]["end"]) or f.function_of(f.node_at(r["node_id"])) is not f.function_of(loop) and any(True for _ in ()))}
    if names and not any(f.symbol(n)["symbol_id"] in changed for n in names):
        yield from ((n, {"name": n["name"]}) for n in names if f.symbol(n)["kind"] not in ("const", "function", "class", "import"))


@rule("require-atomic-updates", "correctness", "Possible race condition: `{{name}}` might be assigned based on an outdated state of `{{name}}`.", "AssignmentExpression", allowProperties=False)
def _(f, n, o):
    fn = f.function_of(n)
    if fn is None or not (fn.get("async") or fn.get("generator")):
        return
    waits = [w for w in f.below(n["right"], "AwaitExpression", "YieldExpression", into=False)] + ([n["right"]] if n["right"]["type"] in ("AwaitExpression", "YieldExpression") else [])
    target = n["left"]
    if not waits:
        return
    if target["type"] == "Identifier":
        symbol = f.symbol(target)
        outer = symbol is None or f.function_of(f.node_at(symbol["node_id"])) is not fn
        read = n["operator"] != "=" or any(x["name"] == target["name"] and x["start"] < waits[0]["end"] for x in f.below(n["right"], "Identifier", into=False))
        if outer and read:
            yield n, {"name": target["name"]}


# -- suspicious and style --------------------------------------------------------------------


@rule("no-restricted-properties", "suspicious", "'{{object}}.{{property}}' is restricted from being used.{{message}}", "MemberExpression", items=[])
def _(f, n, o):
    for x in [i for i in o["items"] if isinstance(i, dict)] + ([o] if "object" in o or "property" in o else []):
        if x.get("object") in (None, name_of(n["object"])) and x.get("property") in (None, name_of(n)):
            yield n, {"object": name_of(n["object"]) or "*", "property": name_of(n) or "*", "message": f" {x['message']}" if x.get("message") else ""}


@rule("no-restricted-globals", "style", "Unexpected use of '{{name}}'.", "Identifier", items=["event", "fdescribe"])
def _(f, n, o):
    names = {i["name"] if isinstance(i, dict) else i for i in o["items"]}
    if n["name"] in names and f.rows._ids.get(id(n)) in {r["node_id"] for r in f.rows.refs if r["symbol_id"] is None and r["name"] == n["name"]}:
        yield n, {"name": n["name"]}


@rule("no-restricted-imports", "style", "'{{source}}' import is restricted from being used.", "ImportDeclaration ExportNamedDeclaration ExportAllDeclaration", paths=[], patterns=[])
def _(f, n, o):
    if n.get("source"):
        source = n["source"]["value"]
        named = [p["name"] if isinstance(p, dict) else p for p in (o["paths"] if isinstance(o["paths"], list) else [o["paths"]])]
        likes = [re.escape(p).replace(r"\*\*", ".*").replace(r"\*", "[^/]*") for p in o["patterns"] if isinstance(p, str)]
        if source in named or any(re.fullmatch(p, source) for p in likes):
            yield n, {"source": source}


@rule("no-restricted-exports", "style", "'{{name}}' is restricted from being used as an exported name.", "ExportSpecifier ExportDefaultDeclaration ExportNamedDeclaration", restrictedNamedExports=["then"])
def _(f, n, o):
    if n["type"] == "ExportSpecifier":
        names = [name_of(n["exported"]) or static(n["exported"])]
    elif n["type"] == "ExportDefaultDeclaration":
        names = ["default"]
    else:
        d = n["declaration"]
        names = [] if d is None else [name_of(v["id"]) for v in d["declarations"]] if d["type"] == "VariableDeclaration" else [name_of(d.get("id"))]
    yield from ((n, {"name": x}) for x in names if x in o["restrictedNamedExports"])


@rule("no-restricted-syntax", "style", "Using '{{selector}}' is not allowed.", "Program", items=[])
def _(f, program, o):
    from lintmill.operators.selectors import match_tree

    for item in o["items"]:
        selector = item["selector"] if isinstance(item, dict) else item
        yield from ((n, {"selector": selector}) for n in match_tree(f, selector))


@rule("consistent-this", "style", "Unexpected alias '{{name}}' for 'this'.", "VariableDeclarator AssignmentExpression", alias="that")
def _(f, n, o):
    target, value = (n["id"], n["init"]) if n["type"] == "VariableDeclarator" else (n["left"], n["right"])
    if value is not None and target["type"] == "Identifier":
        if value["type"] == "ThisExpression" and target["name"] != o["alias"]:
            yield n, {"name": target["name"]}
        elif value["type"] != "ThisExpression" and target["name"] == o["alias"]:
            yield n, {"name": target["name"]}


def _declares(f: File, n: dict) -> bool:
    symbol = f.symbol(n)
    return symbol is not None and symbol["node_id"] == f.rows._ids.get(id(n))


@rule("id-denylist", "style", "Identifier '{{name}}' is restricted.", "Identifier PrivateIdentifier", items=["data", "callback", "cb", "e", "err"])
def _(f, n, o):
    parent = f.parent(n)
    key = parent["type"] in ("Property", "MethodDefinition", "PropertyDefinition") and f.slot(n) == "key" and not parent["computed"]
    if n["name"] in o["items"] and (_declares(f, n) or key or (parent["type"] == "MemberExpression" and f.slot(n) == "property" and f.parent(parent)["type"] == "AssignmentExpression" and f.slot(parent) == "left")):
        yield n, {"name": n["name"]}


@rule("id-match", "style", "Identifier '{{name}}' does not match the pattern '{{pattern}}'.", "Identifier", pattern="^[A-Za-z$_][A-Za-z0-9$_]*$", properties=False, onlyDeclarations=False)
def _(f, n, o):
    if _declares(f, n) and not re.search(o["pattern"], n["name"]):
        yield n, {"name": n["name"], "pattern": o["pattern"]}


@rule("init-declarations", "style", "Variable '{{name}}' should {{what}} on declaration.", "VariableDeclarator", mode="always", ignoreForLoopInit=False)
def _(f, n, o):
    declaration = f.parent(n)
    loop = f.parent(declaration)
    in_loop = loop is not None and loop["type"] in LOOPS and f.slot(declaration) in ("init", "left")
    if n["id"]["type"] != "Identifier" or declaration.get("declare"):
        return
    if o["mode"] == "always" and n["init"] is None and not (in_loop and loop["type"] != "ForStatement"):
        yield n, {"name": n["id"]["name"], "what": "be initialized"}
    elif o["mode"] == "never" and n["init"] is not None and declaration["kind"] not in ("const", "using") and not (in_loop and o["ignoreForLoopInit"]):
        yield n, {"name": n["id"]["name"], "what": "not be initialized"}


@rule("logical-assignment-operators", "style", "Assignment (=) can be replaced with operator assignment ({{operator}}=).", "AssignmentExpression LogicalExpression", mode="always", enforceForIfStatements=False)
def _(f, n, o):
    if o["mode"] == "never":
        if n["type"] == "AssignmentExpression" and n["operator"] in ("&&=", "||=", "??="):
            yield n, {"operator": n["operator"][:-1]}
    elif n["type"] == "AssignmentExpression":
        right = n["right"]
        if n["operator"] == "=" and right["type"] == "LogicalExpression" and f.same(n["left"], right["left"]):
            yield n, {"operator": right["operator"]}
    elif plain(n["right"])["type"] == "AssignmentExpression" and plain(n["right"])["operator"] == "=" and f.same(n["left"], plain(n["right"])["left"]):
        yield n, {"operator": n["operator"]}


@rule("operator-assignment", "style", "Assignment (=) can be replaced with operator assignment ({{operator}}=).", "AssignmentExpression", mode="always")
def _(f, n, o):
    right = n["right"]
    if o["mode"] == "never":
        if n["operator"] not in ("=", "&&=", "||=", "??="):
            yield n, {"operator": n["operator"][:-1]}
    elif n["operator"] == "=" and right["type"] == "BinaryExpression" and n["left"]["type"] in ("Identifier", "MemberExpression") and right["operator"] in ("+", "-", "*", "/", "%", "**", "<<", ">>", ">>>", "&", "|", "^"):
        swaps = right["operator"] in ("*", "&", "|", "^")
        if f.same(n["left"], right["left"]) or (swaps and f.same(n["left"], right["right"])):
            yield n, {"operator": right["operator"]}


@rule("no-extra-bind", "style", "The function binding is unnecessary.", "CallExpression")
def _(f, n, o):
    owner, method = call_of(n)
    if method == "bind" and owner is not None and len(n["arguments"]) == 1 and n["arguments"][0]["type"] != "SpreadElement":
        fn = plain(owner)
        if fn["type"] == "ArrowFunctionExpression" or (fn["type"] == "FunctionExpression" and not _uses_this(f, fn)):
            yield n


def _uses_this(f: File, fn: dict) -> bool:
    """Whether a function's own ``this`` or ``super`` is used, arrow functions included."""
    return any(next((a for a in f.above(t) if a["type"] in ("FunctionDeclaration", "FunctionExpression", *CLASSES)), None) is fn for t in f.below(fn, "ThisExpression", "Super", "MetaProperty"))


@rule("no-extra-label", "style", "This label '{{name}}' is unnecessary.", "BreakStatement ContinueStatement")
def _(f, n, o):
    if n["label"] is not None:
        for a in f.above(n):
            if a["type"] in LOOPS or (a["type"] == "SwitchStatement" and n["type"] == "BreakStatement"):
                if f.parent(a)["type"] == "LabeledStatement" and f.parent(a)["label"]["name"] == n["label"]["name"]:
                    yield n, {"name": n["label"]["name"]}
                return


@rule("template-tag-spacing", "style", "Unexpected space between template tag and template literal.", "TaggedTemplateExpression", mode="never")
def _(f, n, o):
    spaced = n["tag"]["end"] != n["quasi"]["start"] and f.source[n["quasi"]["start"] - 1].isspace()
    if spaced == (o["mode"] == "never"):
        yield n


@rule("vars-on-top", "style", "All 'var' declarations must be at the top of the function scope.", "VariableDeclaration")
def _(f, n, o):
    if n["kind"] != "var":
        return
    block = f.parent(n)
    if block["type"] == "ExportNamedDeclaration":
        return
    top = block["type"] in ("Program", "StaticBlock") or (block["type"] == "BlockStatement" and f.parent(block)["type"] in FUNCTIONS)
    before = block["body"][: f.index(n)] if top else []
    if not top or any(not (s.get("directive") or (s["type"] == "VariableDeclaration" and s["kind"] == "var") or s["type"].startswith("Import")) for s in before):
        yield n


@rule("block-scoped-var", "suspicious", "'{{name}}' is used outside of binding context.", "VariableDeclaration")
def _(f, n, o):
    if n["kind"] != "var":
        return
    home = f.nearest(n, "BlockStatement", "Program", "SwitchStatement", *LOOPS, *FUNCTIONS, "StaticBlock")
    for s in f.declared(n):
        for r in f.refs_of.get(s["symbol_id"], ()):
            if not home["start"] <= r["start"] < home["end"]:
                yield f.node_at(r["node_id"]), {"name": s["name"]}


@rule("class-methods-use-this", "style", "Expected 'this' to be used by class {{what}}.", "MethodDefinition PropertyDefinition", exceptMethods=[], enforceForClassFields=True)
def _(f, m, o):
    fn = m["value"]
    if m["static"] or m.get("override") or fn is None or fn["type"] not in FUNCTIONS or fn["body"] is None or m.get("kind") == "constructor" or name_of(m) in o["exceptMethods"] or (m["type"] == "PropertyDefinition" and not o["enforceForClassFields"]):
        return
    own = fn if fn["type"] != "ArrowFunctionExpression" else m
    if not (_uses_this(f, fn) if own is fn else f.below(fn, "ThisExpression", "Super")):
        yield m, {"what": f"{'getter ' if m.get('kind') == 'get' else 'setter ' if m.get('kind') == 'set' else 'method '}'{name_of(m)}'"}


@rule("func-name-matching", "style", "Function name `{{function}}` should match {{what}} name `{{name}}`.", "VariableDeclarator AssignmentExpression Property PropertyDefinition", mode="always")
def _(f, n, o):
    kind = n["type"]
    target, fn = (n["id"], n["init"]) if kind == "VariableDeclarator" else (n["left"], n["right"]) if kind == "AssignmentExpression" else (n, n["value"])
    if fn is None or fn["type"] != "FunctionExpression" or not fn["id"] or (kind == "AssignmentExpression" and n["operator"] != "="):
        return
    name = name_of(target)
    if name is not None and re.fullmatch(r"[A-Za-z_$][\w$]*", name) and (fn["id"]["name"] != name) == (o["mode"] == "always"):
        yield n, {"function": fn["id"]["name"], "name": name, "what": "variable" if kind == "VariableDeclarator" else "property"}


@rule("max-lines-per-function", "style", "Function has too many lines ({{lines}}). Maximum allowed is {{max}}.", _ALL, max=50, skipComments=False, skipBlankLines=False, IIFEs=False)
def _(f, fn, o):
    first, last = f.place(fn["start"])[0], f.place(fn["end"])[0]
    lines = range(first, last + 1)
    text = f.source.split("\n")
    if o["skipBlankLines"]:
        lines = [i for i in lines if i <= len(text) and text[i - 1].strip()]
    if o["skipComments"]:
        covered = {i for c in f.comments for i in range(f.place(c.start)[0], f.place(c.end)[0] + 1)}
        coded = {f.place(t.start)[0] for t in f.tokens_in(fn)}
        lines = [i for i in lines if i not in covered or i in coded]
    if len(lines) > o["max"] and (o["IIFEs"] or not (f.parent(fn)["type"] == "CallExpression" and f.slot(fn) == "callee")):
        yield fn, {"lines": str(len(lines)), "max": str(o["max"])}


@rule("max-nested-callbacks", "style", "Too many nested callbacks ({{num}}). Maximum allowed is {{max}}.", "FunctionExpression ArrowFunctionExpression", max=10)
def _(f, fn, o):
    if f.slot(fn) != "arguments":
        return
    n = 1 + sum(a["type"] in FUNCTIONS and f.slot(a) == "arguments" for a in f.above(fn))
    if n > o["max"]:
        yield fn, {"num": str(n), "max": str(o["max"])}


@rule("no-implicit-globals", "style", "Unexpected {{what}} in the global scope, wrap in an IIFE for a local variable, assign as global property for a global variable.", "Program", lexicalBindings=False)
def _(f, program, o):
    if program["sourceType"] == "module":
        return
    for s in program["body"]:
        if s["type"] == "FunctionDeclaration" or (s["type"] == "VariableDeclaration" and s["kind"] == "var"):
            for d in [s] if s["type"] == "FunctionDeclaration" else s["declarations"]:
                yield d, {"what": "function declaration" if d is s else "'var' declaration"}
        elif o["lexicalBindings"] and (s["type"] == "ClassDeclaration" or s["type"] == "VariableDeclaration"):
            yield s, {"what": "lexical declaration"}
    for r in f.rows.refs:
        if r["symbol_id"] is None and r["is_write"] and not r["is_read"]:
            yield f.node_at(r["node_id"]), {"what": "global variable leak"}


@rule("no-invalid-this", "suspicious", "Unexpected 'this'.", "ThisExpression", capIsConstructor=True)
def _(f, n, o):
    at = n
    for a in f.above(n):
        if a["type"] in ("PropertyDefinition", "StaticBlock") and f.slot(at) in ("value", "body"):
            return
        if a["type"] in ("FunctionDeclaration", "FunctionExpression"):
            parent, slot = f.parent(a), f.slot(a)
            name = name_of(a.get("id"))
            if parent["type"] in ("MethodDefinition", "Property", "PropertyDefinition"):
                return
            if parent["type"] == "VariableDeclarator":
                name = name or name_of(parent["id"])
            if parent["type"] == "AssignmentExpression" and slot == "right":
                if parent["left"]["type"] == "MemberExpression":
                    return
                name = name or name_of(parent["left"])
            if parent["type"] == "MemberExpression" and name_of(parent) in ("call", "apply", "bind"):
                return
            if o["capIsConstructor"] and name and name[:1].isupper():
                return
            if a["params"] and name_of(a["params"][0]) == "this" or any("@this" in c.text for c in f.comments if c.end <= a["start"] and not f.source[c.end : a["start"]].strip()):
                return
            if slot == "arguments" and call_of(parent)[1] in _ARRAY_METHODS | {"forEach"} and len(parent["arguments"]) > f.index(a) + 1:
                return
            yield n
            return
        at = a
    if f.program["sourceType"] == "module":
        yield n


@rule("no-magic-numbers", "style", "No magic number: {{raw}}.", "Literal", ignore=[], ignoreArrayIndexes=False, ignoreDefaultValues=False, enforceConst=False, detectObjects=False)
def _(f, n, o):
    if n["literal"] not in ("number", "bigint"):
        return
    parent = f.parent(n)
    raw, value = n["raw"], n["value"]
    if parent["type"] == "UnaryExpression" and parent["operator"] == "-":
        raw, value, n, parent = f"-{raw}", -float(value), parent, f.parent(parent)
    if any(str(x) == raw or (isinstance(x, (int, float)) and float(x) == float(value)) for x in o["ignore"]):
        return
    kind = parent["type"]
    if kind == "VariableDeclarator":
        if o["enforceConst"] and f.parent(parent)["kind"] != "const":
            yield n, {"raw": raw}
        return
    if (kind in ("Property", "AssignmentExpression") and not o["detectObjects"] and not (kind == "AssignmentExpression" and parent["left"]["type"] == "Identifier")) or kind in ("PropertyDefinition", "TSEnumMember", "TSLiteralType", "JSXExpressionContainer", "JSXAttribute"):
        return
    if (kind == "MemberExpression" and f.slot(n) == "property" and o["ignoreArrayIndexes"]) or (kind == "AssignmentPattern" and o["ignoreDefaultValues"]) or (call_of(parent)[1] in ("parseInt",) and f.index(n) == 1):
        return
    yield n, {"raw": raw}


_ESCAPES = set("\\nrvtbfux\n\r  ") | set("0123456789")


@rule("no-useless-escape", "correctness", "Unnecessary escape character: \\{{character}}.", "Literal TemplateLiteral")
def _(f, n, o):
    if n["type"] == "Literal" and n["literal"] == "regex":
        yield from ((n, {"character": c}) for c in analyse(n["regex_pattern"], n["regex_flags"]).escapes)
    elif n["type"] == "Literal" and n["literal"] == "string" and f.parent(n)["type"] not in ("JSXAttribute", "JSXExpressionContainer"):
        for m in re.finditer(r"\\(.)", n["raw"][1:-1], re.DOTALL):
            if m.group(1) not in _ESCAPES and m.group(1) != n["raw"][0]:
                yield n, {"character": m.group(1)}
    elif n["type"] == "TemplateLiteral" and f.parent(n)["type"] != "TaggedTemplateExpression":
        for q in n["quasis"]:
            for m in re.finditer(r"\\(.)(.?)", q["raw"], re.DOTALL):
                if m.group(1) not in _ESCAPES | {"`"} and not (m.group(1) == "$" and m.group(2) in ("{", "")) and not (m.group(1) == "{" and q["raw"][max(0, m.start() - 1) : m.start()] == "$"):
                    yield n, {"character": m.group(1)}


@rule("one-var", "style", "{{what}}", "VariableDeclaration", mode="always")
def _(f, n, o):
    mode = o["mode"] if isinstance(o["mode"], str) else o["mode"].get(n["kind"], "")
    if mode == "never" and len(n["declarations"]) > 1 and not (f.parent(n)["type"] in LOOPS):
        yield n, {"what": f"Split '{n['kind']}' declarations into multiple statements."}
    elif mode in ("always", "consecutive") and f.parent(n)["type"] in ("Program", "BlockStatement", "StaticBlock"):
        before = f.parent(n)["body"][: f.index(n)]
        before = before[-1:] if mode == "consecutive" else before
        if any(s["type"] == "VariableDeclaration" and s["kind"] == n["kind"] for s in before):
            yield n, {"what": f"Combine this with the previous '{n['kind']}' statement."}


@rule("prefer-arrow-callback", "style", "Unexpected function expression.", "FunctionExpression", allowNamedFunctions=False, allowUnboundThis=True)
def _(f, fn, o):
    at = fn
    bound = call_of(f.parent(f.parent(fn)))[1] == "bind" and f.parent(fn)["type"] == "MemberExpression" if f.parent(f.parent(fn)) else False
    if bound:
        at = f.parent(f.parent(fn))
    if f.slot(at) != "arguments" or f.parent(at)["type"] not in ("CallExpression", "NewExpression") or fn["generator"] or (fn["id"] and (o["allowNamedFunctions"] or any(s["name"] == fn["id"]["name"] and f.refs_of.get(s["symbol_id"]) for s in f.rows.symbols if s["kind"] == "function-name"))):
        return
    inner = f.below(fn, "ThisExpression", "Super", "MetaProperty")
    uses = [x for x in inner if next((a for a in f.above(x) if a["type"] in ("FunctionDeclaration", "FunctionExpression")), None) is fn]
    arguments = any(r["name"] == "arguments" and r["symbol_id"] is None and next((a for a in f.above(f.node_at(r["node_id"])) if a["type"] in ("FunctionDeclaration", "FunctionExpression")), None) is fn for r in f.rows.refs)
    if not arguments and (not uses or (bound and all(u["type"] == "ThisExpression" for u in uses))):
        yield fn


@rule("prefer-destructuring", "style", "Use {{kind}} destructuring.", "VariableDeclarator AssignmentExpression", array=True, object=True)
def _(f, n, o):
    target, value = (n["id"], n["init"]) if n["type"] == "VariableDeclarator" else (n["left"], n["right"])
    if value is None or value["type"] != "MemberExpression" or value["object"]["type"] == "Super" or value["property"]["type"] == "PrivateIdentifier" or (n["type"] == "AssignmentExpression" and n["operator"] != "=") or target.get("typeAnnotation"):
        return
    if value["computed"] and value["property"]["type"] == "Literal" and value["property"]["literal"] == "number":
        if o["array"] and target["type"] == "Identifier":
            yield n, {"kind": "array"}
    elif o["object"] and target["type"] == "Identifier" and name_of(value) == target["name"] and (not value["computed"] or value["property"]["type"] == "Literal"):
        yield n, {"kind": "object"}


@rule("prefer-named-capture-group", "style", "Capture group '{{group}}' should be converted to a named or non-capturing group.", "Literal NewExpression CallExpression")
def _(f, n, o):
    said = _regex(f, n)
    if said:
        yield from ((n, {"group": g}) for g in analyse(*said).unnamed)


@rule("sort-imports", "style", "{{what}}", "Program", ignoreCase=False, ignoreDeclarationSort=False, ignoreMemberSort=False, memberSyntaxSortOrder=["none", "all", "multiple", "single"])
def _(f, program, o):
    fold = str.lower if o["ignoreCase"] else str
    last = None
    for d in (s for s in program["body"] if s["type"] == "ImportDeclaration"):
        sp = d["specifiers"]
        if not o["ignoreDeclarationSort"]:
            kind = "none" if not sp else "all" if sp[0]["type"] == "ImportNamespaceSpecifier" else "single" if len(sp) == 1 else "multiple"
            key = (o["memberSyntaxSortOrder"].index(kind), fold(sp[0]["local"]["name"]) if sp else "")
            if last is not None and key < last:
                yield d, {"what": "Imports should be sorted alphabetically." if key[0] == last[0] else "Expected another syntax order of imports."}
            last = key
        named = [x for x in sp if x["type"] == "ImportSpecifier"]
        if not o["ignoreMemberSort"]:
            for a, b in zip(named, named[1:]):
                if fold(b["local"]["name"]) < fold(a["local"]["name"]):
                    yield b, {"what": f"Member '{b['local']['name']}' of the import declaration should be sorted alphabetically."}
                    break


@rule("strict", "style", "{{what}}", f"Program {_ALL}", mode="safe")
def _(f, n, o):
    if n["type"] == "Program":
        own = [s for s in n["body"] if s.get("directive") == "use strict"]
        if n["sourceType"] == "module":
            yield from ((s, {"what": "'use strict' is unnecessary inside of modules."}) for s in own)
        elif o["mode"] == "global" and n["body"] and not own:
            yield n, {"what": "Use the global form of 'use strict'."}
        elif o["mode"] == "never":
            yield from ((s, {"what": "Strict mode is not permitted."}) for s in own)
        elif o["mode"] in ("safe", "function"):
            yield from ((s, {"what": "Use the function form of 'use strict'."}) for s in own)
    elif n["body"] is not None and n["body"]["type"] == "BlockStatement":
        own = [s for s in _body(n) if s.get("directive") == "use strict"]
        inside = f.program["sourceType"] == "module" or any(a["type"] in (*FUNCTIONS, *CLASSES) for a in f.above(n))
        if own and (o["mode"] in ("never", "global") or f.program["sourceType"] == "module" or any(a["type"] in CLASSES for a in f.above(n))):
            yield own[0], {"what": "'use strict' is unnecessary here."}
        elif not own and not inside and o["mode"] in ("safe", "function"):
            yield n, {"what": "Use the function form of 'use strict'."}


# -- typescript without types ---------------------------------------------------------------


@rule("class-literal-property-style", "typescript", "Literals should be exposed using {{how}}.", "MethodDefinition PropertyDefinition", "ts", mode="fields")
def _(f, m, o):
    fixed = lambda v: v is not None and (plain(v)["type"] in ("Literal",) or static(v) is not None)
    if o["mode"] == "fields" and m["type"] == "MethodDefinition" and m["kind"] == "get" and not m["override"]:
        body = _body(m["value"])
        if len(body) == 1 and body[0]["type"] == "ReturnStatement" and fixed(body[0]["argument"]) and not any(s["type"] == "MethodDefinition" and s["kind"] == "set" and name_of(s) == name_of(m) for s in f.parent(m)["body"]):
            yield m["key"], {"how": "readonly fields"}
    elif o["mode"] == "getters" and m["type"] == "PropertyDefinition" and m["readonly"] and not m["declare"] and fixed(m["value"]):
        yield m["key"], {"how": "getters"}


@rule("consistent-generic-constructors", "typescript", "The generic type arguments should be specified as part of the {{where}}.", "VariableDeclarator PropertyDefinition", "ts", mode="constructor")
def _(f, n, o):
    note = (n["id"] if n["type"] == "VariableDeclarator" else n).get("typeAnnotation")
    value = n["init"] if n["type"] == "VariableDeclarator" else n["value"]
    if value is None or value["type"] != "NewExpression" or value["callee"]["type"] != "Identifier":
        return
    said = note["typeAnnotation"] if note else None
    if said is not None and (said["type"] != "TSTypeReference" or name_of(said["typeName"]) != value["callee"]["name"]):
        return
    if o["mode"] == "constructor" and said is not None and said.get("typeArguments") and not value.get("typeArguments"):
        yield n, {"where": "constructor type arguments"}
    elif o["mode"] == "type-annotation" and said is None and value.get("typeArguments"):
        yield n, {"where": "type annotation"}


@rule("consistent-type-imports", "typescript", "All imports in the declaration are only used as types. Use `import type`.", "ImportDeclaration", "ts", prefer="type-imports")
def _(f, d, o):
    if o["prefer"] == "no-type-imports":
        if d.get("importKind") == "type":
            yield d
        return
    if d.get("importKind") == "type" or not d["specifiers"]:
        return
    for s in d["specifiers"]:
        symbol = f.symbol(s["local"])
        uses = [f.node_at(r["node_id"]) for r in f.refs_of.get(symbol["symbol_id"], ())] if symbol else []
        if not uses or s.get("importKind") == "type" or not all(_as_type(f, u) for u in uses):
            return
    yield d


def _as_type(f: File, use: dict) -> bool:
    at = use
    for a in f.above(use):
        if a["type"] in ("TSTypeReference", "TSTypeQuery", "TSExpressionWithTypeArguments", "TSInterfaceHeritage", "TSClassImplements"):
            return True
        if a["type"] not in ("TSQualifiedName", "MemberExpression"):
            return a["type"] in ("TSInterfaceDeclaration",) or f.slot(at) == "implements"
        at = a
    return False


@rule("no-extraneous-class", "typescript", "Unexpected class with only {{what}}.", _CLASSES, "ts", allowConstructorOnly=False, allowEmpty=False, allowStaticOnly=False, allowWithDecorator=False)
def _(f, c, o):
    body = c["body"]["body"]
    if c.get("superClass") or (o["allowWithDecorator"] and c.get("decorators")):
        return
    if not body:
        if not o["allowEmpty"]:
            yield c["id"] or c, {"what": "nothing in it"}
        return
    if any(m.get("kind") == "constructor" and any(p["type"] == "TSParameterProperty" for p in m["value"]["params"]) for m in body):
        return
    if all(m.get("kind") == "constructor" for m in body):
        if not o["allowConstructorOnly"]:
            yield c["id"] or c, {"what": "a constructor"}
    elif all(m.get("kind") == "constructor" or m.get("static") or m["type"] == "StaticBlock" for m in body) and not o["allowStaticOnly"]:
        yield c["id"] or c, {"what": "static properties"}


@rule("no-mixed-enums", "typescript", "Mixing number and string enums can be confusing.", "TSEnumDeclaration", "ts")
def _(f, e, o):
    first = None
    for whole in [d for d in f.each("TSEnumDeclaration") if d["id"]["name"] == e["id"]["name"] and d["start"] < e["start"]] + [e]:
        for m in whole["members"]:
            kind = "number" if m["initializer"] is None else types(f).base(types(f).of(m["initializer"]))
            if kind not in ("string", "number"):
                if m["initializer"] is not None and plain(m["initializer"])["type"] in ("BinaryExpression", "UnaryExpression"):
                    kind = "number"
                else:
                    return
            if first is None:
                first = kind
            elif kind != first and whole is e:
                yield m["initializer"] or m
                return


@rule("no-invalid-void-type", "typescript", "void is only valid as a return type or generic type argument.", "TSVoidKeyword", "ts", allowInGenericTypeArguments=True, allowAsThisParameter=False)
def _(f, n, o):
    parent = f.parent(n)
    if parent["type"] == "TSTypeParameterInstantiation" and o["allowInGenericTypeArguments"]:
        return
    if parent["type"] == "TSTypeAnnotation" and f.slot(parent) == "returnType":
        return
    if parent["type"] == "TSUnionType" and all(t["type"] in ("TSVoidKeyword", "TSNeverKeyword") or (t["type"] == "TSTypeReference" and t.get("typeArguments")) for t in parent["types"]):
        return
    yield n


@rule("no-restricted-types", "typescript", "Don't use `{{name}}` as a type.{{message}}", "TSTypeReference", "ts", types={})
def _(f, n, o):
    name = f.text(n["typeName"])
    said = o["types"].get(name)
    if said:
        yield n, {"name": name, "message": f" {said if isinstance(said, str) else said.get('message', '')}".rstrip() if said is not True else ""}


@rule("no-unnecessary-parameter-property-assignment", "typescript", "This assignment is unnecessary since it is already assigned by a parameter property.", "AssignmentExpression", "ts")
def _(f, n, o):
    target, value = n["left"], plain(n["right"])
    fn = f.function_of(n)
    if fn is not None and n["operator"] == "=" and target["type"] == "MemberExpression" and target["object"]["type"] == "ThisExpression" and value["type"] == "Identifier" and name_of(target) == value["name"]:
        if any(p["type"] == "TSParameterProperty" and name_of(p["parameter"].get("left", p["parameter"])) == value["name"] for p in fn["params"]):
            yield n


@rule("no-unnecessary-qualifier", "typescript", "Qualifier is unnecessary since '{{name}}' is in scope.", "TSQualifiedName MemberExpression", "ts")
def _(f, n, o):
    left, name = (n["left"], name_of(n["right"])) if n["type"] == "TSQualifiedName" else (n["object"], name_of(n))
    if left["type"] != "Identifier":
        return
    for a in f.above(n):
        if a["type"] in ("TSModuleDeclaration", "TSEnumDeclaration") and name_of(a["id"]) == left["name"]:
            members = a["members"] if a["type"] == "TSEnumDeclaration" else [d.get("declaration", d) for d in (a["body"] or {"body": []})["body"] if d["type"] == "ExportNamedDeclaration"]
            names = {name_of(m) if m["type"] == "TSEnumMember" else name_of(m.get("id")) for m in members if m} | {name_of(v["id"]) for m in members if m and m["type"] == "VariableDeclaration" for v in m["declarations"]}
            if name in names:
                yield left, {"name": name}
            return


@rule("no-unnecessary-template-expression", "typescript", "Template literal expression is unnecessary and can be simplified.", "TemplateLiteral", "ts")
def _(f, n, o):
    if f.parent(n)["type"] == "TaggedTemplateExpression":
        return
    alone = len(n["expressions"]) == 1 and not any(q["raw"] for q in n["quasis"])
    for e in n["expressions"]:
        if f.comments_between(n["start"], n["end"]):
            continue
        if (plain(e)["type"] == "Literal" and plain(e)["literal"] in ("string", "number", "boolean", "null", "bigint")) or plain(e)["type"] == "TemplateLiteral" or name_of(e) in ("undefined", "Infinity", "NaN") or (alone and types(f).is_a(e, "string")):
            yield e


@rule("no-unnecessary-type-arguments", "typescript", "This is the default value for this type parameter, so it can be omitted.", "TSTypeParameterInstantiation", "ts")
def _(f, n, o):
    owner = f.parent(n)
    name = name_of(owner.get("typeName") or owner.get("callee") or owner.get("tag") or owner.get("expression") or (owner.get("superClass") if owner["type"] in CLASSES else None))
    declared = [d for d in f.each("FunctionDeclaration", "TSInterfaceDeclaration", "TSTypeAliasDeclaration", *CLASSES) if name_of(d.get("id")) == name and d.get("typeParameters")]
    params = next((d["typeParameters"]["params"] for d in declared), [])
    i = len(n["params"]) - 1
    if 0 <= i < len(params) and params[i].get("default") is not None and f.same(params[i]["default"], n["params"][i]):
        yield n["params"][i]


@rule("no-unsafe-declaration-merging", "typescript", "Unsafe declaration merging between classes and interfaces.", "ClassDeclaration TSInterfaceDeclaration", "ts")
def _(f, n, o):
    other = "TSInterfaceDeclaration" if n["type"] == "ClassDeclaration" else "ClassDeclaration"
    home = lambda x: f.nearest(x, "Program", "BlockStatement", "TSModuleBlock")
    if n.get("id") and any(d.get("id") and d["id"]["name"] == n["id"]["name"] and home(d) is home(n) for d in f.each(other)):
        yield n["id"]


@rule("non-nullable-type-assertion-style", "typescript", "Use a ! assertion to more succinctly remove null and undefined from the type.", "TSAsExpression TSTypeAssertion", "ts")
def _(f, n, o):
    t = types(f)
    was, now = t.members(t.of(n["expression"])), t.members(t.said(n["typeAnnotation"]))
    if {"null", "undefined"} & {x for x in was if isinstance(x, str)} and "?" not in was and set(now) == set(was) - {"null", "undefined"} and now:
        yield n


@rule("prefer-for-of", "typescript", "Expected a `for-of` loop instead of a `for` loop with this simple iteration.", "ForStatement")
def _(f, n, o):
    init, test, update = n["init"], n["test"], n["update"]
    if not init or init["type"] != "VariableDeclaration" or len(init["declarations"]) != 1 or static(init["declarations"][0]["init"]) != "0" or init["declarations"][0]["id"]["type"] != "Identifier":
        return
    i = init["declarations"][0]["id"]
    if not test or test["type"] != "BinaryExpression" or test["operator"] != "<" or name_of(test["left"]) != i["name"] or test["right"]["type"] != "MemberExpression" or name_of(test["right"]) != "length":
        return
    steps = update and (update["type"] == "UpdateExpression" and update["operator"] == "++" and name_of(update["argument"]) == i["name"] or update["type"] == "AssignmentExpression" and update["operator"] == "+=" and name_of(update["left"]) == i["name"] and static(update["right"]) == "1")
    if not steps:
        return
    whole = test["right"]["object"]
    for r in f.refs_of.get(f.symbol(i)["symbol_id"], ()):
        use = f.node_at(r["node_id"])
        if test["start"] <= use["start"] < update["end"] or use is i:
            continue
        member = f.parent(use)
        if member["type"] != "MemberExpression" or f.slot(use) != "property" or not member["computed"] or not f.same(member["object"], whole) or f.parent(member)["type"] == "UpdateExpression" or (f.parent(member)["type"] == "AssignmentExpression" and f.slot(member) == "left") or (f.parent(member)["type"] == "UnaryExpression" and f.parent(member)["operator"] == "delete"):
            return
    yield n


@rule("prefer-find", "typescript", "Prefer .find(...) instead of .filter(...)[0].", "MemberExpression CallExpression", "ts")
def _(f, n, o):
    if n["type"] == "MemberExpression":
        inner = n["object"] if n["computed"] and static(n["property"]) in ("0", "-0", "0n") else None
    else:
        owner, method = call_of(n)
        inner = owner if method == "at" and n["arguments"] and static(n["arguments"][0]) == "0" else None
    owner, method = call_of(inner)
    if method == "filter" and owner is not None and types(f).base(types(f).of(owner)) in ("array", "?"):
        yield n


@rule("prefer-includes", "typescript", "Use 'includes()' method instead.", "BinaryExpression CallExpression", "ts")
def _(f, n, o):
    if n["type"] == "BinaryExpression":
        owner, method = call_of(n["left"])
        value, op = f.text(n["right"]).replace(" ", ""), n["operator"]
        if method == "indexOf" and owner is not None and types(f).base(types(f).of(owner)) in ("array", "string") and ((op in ("!==", "!=", "===", "==", ">", "<=") and value == "-1") or (op in (">=", "<") and value == "0")):
            yield n
    else:
        owner, method = call_of(n)
        said = _regex(f, plain(owner)) if method == "test" and owner is not None and plain(owner)["type"] in ("Literal", "NewExpression") else None
        if said and not said[1] and re.fullmatch(r"[\w \-]+", said[0]):
            yield n


@rule("prefer-regexp-exec", "typescript", "Use the `RegExp#exec()` method instead.", "CallExpression", "ts")
def _(f, n, o):
    owner, method = call_of(n)
    if method == "match" and owner is not None and len(n["arguments"]) == 1 and types(f).is_a(owner, "string"):
        arg = plain(n["arguments"][0])
        said = _regex(f, arg) if arg["type"] in ("Literal", "NewExpression", "CallExpression") else None
        if (said and "g" not in said[1]) or (arg["type"] == "Literal" and arg["literal"] == "string"):
            yield n


@rule("prefer-string-starts-ends-with", "typescript", "Use 'String#{{method}}' method instead.", "BinaryExpression CallExpression", "ts", allowSingleElementEquality="never")
def _(f, n, o):
    if n["type"] == "CallExpression":
        owner, method = call_of(n)
        said = _regex(f, plain(owner)) if method == "test" and owner is not None and plain(owner)["type"] == "Literal" else None
        if said and not set(said[1]) & set("im"):
            for edge, name in (("^", "startsWith"), ("$", "endsWith")):
                rest = said[0][1:] if edge == "^" and said[0][:1] == "^" else said[0][:-1] if edge == "$" and said[0][-1:] == "$" else None
                if rest and re.fullmatch(r"[\w \-]+", rest):
                    yield n, {"method": name}
        return
    if n["operator"] not in ("===", "!==", "==", "!="):
        return
    left = plain(n["left"])
    if left["type"] == "MemberExpression" and left["computed"] and types(f).is_a(left["object"], "string"):
        if static(left["property"]) == "0" and o["allowSingleElementEquality"] == "never":
            yield n, {"method": "startsWith"}
        elif re.fullmatch(re.escape(f.text(left["object"])) + r"\.length\s*-\s*1", f.text(left["property"])) and o["allowSingleElementEquality"] == "never":
            yield n, {"method": "endsWith"}
    owner, method = call_of(left)
    if owner is None or not types(f).is_a(owner, "string"):
        return
    args = left["arguments"]
    if method == "charAt" and args:
        yield n, {"method": "startsWith" if static(args[0]) == "0" else "endsWith"}
    elif method == "indexOf" and static(n["right"]) == "0":
        yield n, {"method": "startsWith"}
    elif method in ("slice", "substring") and args and (static(args[0]) == "0" and len(args) == 2 or args[0]["type"] == "UnaryExpression" and len(args) == 1):
        yield n, {"method": "startsWith" if len(args) == 2 else "endsWith"}


@rule("prefer-readonly", "typescript", "Member '{{name}}' is never reassigned; mark it as `readonly`.", "PropertyDefinition TSParameterProperty", "ts")
def _(f, m, o):
    owner = f.nearest(m, *CLASSES)
    p = m.get("parameter", m)
    name = name_of(m) if m["type"] == "PropertyDefinition" else name_of(p.get("left", p))
    private = m.get("accessibility") == "private" or (m["type"] == "PropertyDefinition" and m["key"]["type"] == "PrivateIdentifier")
    if not private or m.get("readonly") or name is None or m.get("accessor"):
        return
    for x in f.below(owner, "MemberExpression"):
        if name_of(x) != name:
            continue
        up = f.parent(x)
        written = (up["type"] == "AssignmentExpression" and f.slot(x) == "left") or up["type"] == "UpdateExpression" or (up["type"] == "UnaryExpression" and up["operator"] == "delete") or up["type"] in ("ArrayPattern", "RestElement")
        if written:
            fn = f.function_of(x)
            holder = f.parent(fn) if fn is not None else None
            if not (holder is not None and holder["type"] == "MethodDefinition" and holder["kind"] == "constructor" and not m.get("static") and up["type"] == "AssignmentExpression"):
                return
    yield m, {"name": name}


@rule("prefer-optional-chain", "typescript", "Prefer using an optional chain expression instead, as it's more concise and easier to read.", "LogicalExpression", "ts")
def _(f, n, o):
    if f.parent(n)["type"] == "LogicalExpression" and f.parent(n)["operator"] == n["operator"]:
        return
    parts, at = [], n
    while at["type"] == "LogicalExpression" and at["operator"] == n["operator"]:
        parts.append(at["right"])
        at = at["left"]
    parts = [at, *reversed(parts)]
    if n["operator"] == "&&":
        for a, b in zip(parts, parts[1:]):
            if a["type"] == "BinaryExpression" and a["operator"] in ("!=", "!==") and static(a["right"]) == "null" or (a["type"] == "BinaryExpression" and name_of(a["right"]) == "undefined" and a["operator"] in ("!=", "!==")):
                a = a["left"]
            first = plain(b["left"]) if b["type"] == "BinaryExpression" else plain(b)
            ta, tb = [t.text for t in f.tokens_in(a)], [t.text for t in f.tokens_in(first)]
            if plain(a)["type"] in ("Identifier", "MemberExpression", "CallExpression", "ThisExpression") and len(tb) > len(ta) and tb[: len(ta)] == ta and tb[len(ta)] in (".", "[", "(", "?.") and first["type"] in ("MemberExpression", "CallExpression"):
                yield n
                return
    elif n["operator"] in ("||", "??") and plain(n["right"])["type"] == "ObjectExpression" and not plain(n["right"])["properties"] and f.parent(n)["type"] == "MemberExpression" and f.slot(n) == "object":
        yield n


@rule("prefer-nullish-coalescing", "typescript", "Prefer using nullish coalescing operator (`??`) instead of a logical or (`||`), as it is a safer operator.", "LogicalExpression AssignmentExpression ConditionalExpression", "ts", ignoreConditionalTests=True)
def _(f, n, o):
    t = types(f)
    if n["type"] == "ConditionalExpression":
        test = n["test"]
        if test["type"] == "BinaryExpression" and test["operator"] in ("!=", "!==", "==", "===") and (static(test["right"]) == "null" or name_of(test["right"]) == "undefined"):
            kept = n["consequent"] if test["operator"].startswith("!") else n["alternate"]
            if f.same(test["left"], kept) and (len(test["operator"]) == 2 or len(t.members(t.of(test["left"]))) > 1):
                yield n
        return
    if n["operator"] not in ("||", "||="):
        return
    if {"null", "undefined"} & {x for x in t.members(t.of(n["left"])) if isinstance(x, str)} and not (o["ignoreConditionalTests"] and _in_condition(f, n)):
        yield n


@rule("prefer-return-this-type", "typescript", "Use `this` type instead.", "MethodDefinition", "ts")
def _(f, m, o):
    owner, note = f.nearest(m, *CLASSES), m["value"].get("returnType")
    if note and owner.get("id") and note["typeAnnotation"]["type"] == "TSTypeReference" and name_of(note["typeAnnotation"]["typeName"]) == owner["id"]["name"] and not note["typeAnnotation"].get("typeArguments"):
        given = _returns(f, m["value"]) if m["value"]["body"] else []
        if given and all(r["argument"] and plain(r["argument"])["type"] == "ThisExpression" for r in given):
            yield note["typeAnnotation"]


@rule("related-getter-setter-pairs", "typescript", "`get()` type should be assignable to its equivalent `set()` type.", "ClassBody TSInterfaceBody", "ts")
def _(f, body, o):
    t = types(f)
    for g in body["body"]:
        fn = g.get("value") or g
        if g.get("kind") == "get" and fn.get("returnType"):
            for s in body["body"]:
                sf = s.get("value") or s
                if s.get("kind") == "set" and name_of(s) == name_of(g) and sf["params"] and sf["params"][0].get("typeAnnotation"):
                    want = t.members(t.said(sf["params"][0]["typeAnnotation"]))
                    have = t.members(t.said(fn["returnType"]))
                    if "?" not in (*want, *have) and not {"any", "unknown"} & set(map(str, want)) and not all(h in want or t.base(h) in want for h in have):
                        yield fn["returnType"]["typeAnnotation"]


@rule("use-unknown-in-catch-callback-variable", "typescript", "Prefer the safe `: unknown` for a `{{method}}` callback variable.", "CallExpression", "ts")
def _(f, n, o):
    owner, method = call_of(n)
    if owner is None or (method, len(n["arguments"]) > (1 if method == "then" else 0)) not in (("catch", True), ("then", True)) or types(f).base(types(f).of(owner)) not in ("promise",):
        return
    fn = plain(n["arguments"][1 if method == "then" else 0])
    if fn["type"] in FUNCTIONS and fn["params"]:
        p = fn["params"][0]
        note = p.get("typeAnnotation") or p.get("argument", {}).get("typeAnnotation")
        if note is None or f.text(note["typeAnnotation"]) not in ("unknown", "[unknown]"):
            yield p, {"method": method}


@rule("return-await", "typescript", "{{what}}", "ReturnStatement ArrowFunctionExpression", "ts", mode="in-try-catch")
def _(f, n, o):
    value = n["argument"] if n["type"] == "ReturnStatement" else n["body"] if n["body"]["type"] != "BlockStatement" else None
    fn = f.function_of(n) if n["type"] == "ReturnStatement" else n
    if value is None or fn is None or not fn.get("async"):
        return
    at, needs = n, False
    for a in f.above(n) if n["type"] == "ReturnStatement" else ():
        if a is fn:
            break
        if a["type"] == "TryStatement":
            needs |= f.slot(at) == "block" and a["handler"] is not None or a["finalizer"] is not None and f.slot(at) in ("block", "handler")
        at = a
    awaited = plain(value)["type"] == "AwaitExpression"
    if awaited and not needs and o["mode"] in ("in-try-catch", "never") and types(f).base(types(f).of(plain(value)["argument"])) in ("promise", "?"):
        yield value, {"what": "Returning an awaited promise is not allowed in this context."}
    elif not awaited and types(f).base(types(f).of(value)) == "promise" and (needs or o["mode"] == "always") and o["mode"] != "never":
        yield value, {"what": "Returning an awaited promise is required in this context."}


# -- typescript with the types a file says ----------------------------------------------------

_LOOSE = ("any", "unknown", "?", "class", "object", "never")


@rule("await-thenable", "typescript", "Unexpected `await` of a non-Promise (non-\"Thenable\") value.", "AwaitExpression", "ts")
def _(f, n, o):
    t = types(f)
    if all(t.base(m) in (*PRIMITIVES, "array", "regexp", "enum", "fn") for m in t.members(t.of(n["argument"]))):
        yield n


@rule("no-floating-promises", "typescript", "Promises must be awaited, end with a call to .catch, end with a call to .then with a rejection handler or be explicitly marked as ignored with the `void` operator.", "ExpressionStatement", "ts", ignoreVoid=True, ignoreIIFE=False)
def _(f, n, o):
    t = types(f)

    def floats(e: dict) -> bool:
        e = plain(e)
        kind = e["type"]
        if kind == "SequenceExpression":
            return any(floats(x) for x in e["expressions"])
        if kind == "ConditionalExpression":
            return floats(e["consequent"]) or floats(e["alternate"])
        if kind == "LogicalExpression":
            return floats(e["right"]) or (e["operator"] != "&&" and floats(e["left"]))
        if kind == "UnaryExpression" and e["operator"] == "void":
            return not o["ignoreVoid"] and floats(e["argument"])
        if kind in ("AwaitExpression", "AssignmentExpression", "UnaryExpression", "YieldExpression"):
            return False
        owner, method = call_of(e)
        if owner is not None and t.base(t.of(owner)) == "promise":
            if method == "catch":
                return not e["arguments"]
            if method == "then":
                return len(e["arguments"]) < 2
            if method == "finally":
                return floats(owner)
        if kind == "CallExpression" and o["ignoreIIFE"] and plain(e["callee"])["type"] in FUNCTIONS:
            return False
        found = t.of(e)
        return any(t.base(m) == "promise" or (t.base(m) == "array" and isinstance(m, tuple) and any(t.base(x) == "promise" for x in t.members(m[1]))) for m in t.members(found))

    if floats(n["expression"]):
        yield n


@rule("no-misused-promises", "typescript", "{{what}}", "IfStatement ConditionalExpression WhileStatement DoWhileStatement ForStatement LogicalExpression UnaryExpression CallExpression SpreadElement", "ts", checksConditionals=True, checksVoidReturn=True, checksSpreads=True)
def _(f, n, o):
    t = types(f)
    kind = n["type"]
    if kind == "SpreadElement":
        if o["checksSpreads"] and t.base(t.of(n["argument"])) == "promise" and f.parent(n)["type"] == "ObjectExpression":
            yield n["argument"], {"what": "Expected a non-Promise value to be spreaded in an object."}
    elif kind == "CallExpression":
        owner, method = call_of(n)
        if o["checksVoidReturn"] and method in ("forEach", "setTimeout", "setInterval", "addEventListener") or (owner is None and method == "Promise"):
            yield from ((a, {"what": "Promise returned in function argument where a void return was expected."}) for a in n["arguments"] if plain(a)["type"] in FUNCTIONS and t.base(t.of(a)) == "fn" and t.base(t.of(a)[1]) == "promise")
        elif owner is not None and method in ("filter", "find", "some", "every", "findIndex") and o["checksConditionals"]:
            yield from ((a, {"what": "Expected a non-Promise value to be returned."}) for a in n["arguments"][:1] if plain(a)["type"] in FUNCTIONS and t.base(t.of(a)[1]) == "promise")
    elif o["checksConditionals"]:
        tests = [n["left"]] if kind == "LogicalExpression" and n["operator"] != "??" else [n["argument"]] if kind == "UnaryExpression" and n["operator"] == "!" else [n["test"]] if "test" in n and n["test"] else []
        yield from ((x, {"what": "Expected non-Promise value in a boolean conditional."}) for x in tests if t.of(x) != "?" and all(t.base(m) == "promise" for m in t.members(t.of(x))))


@rule("no-for-in-array", "typescript", "For-in loops over arrays skips holes, returns indices as strings, and may visit the prototype chain or other enumerable properties.", "ForInStatement", "ts")
def _(f, n, o):
    if types(f).is_a(n["right"], "array", "string"):
        yield n


@rule("no-base-to-string", "typescript", "'{{name}}' will use Object's default stringification format ('[object Object]') when stringified.", "TemplateLiteral BinaryExpression CallExpression", "ts")
def _(f, n, o):
    t = types(f)
    bad = lambda e: plain(e)["type"] == "ObjectExpression" or any(t.base(m) in ("object", "fn") for m in t.members(t.of(e)))
    if n["type"] == "TemplateLiteral" and f.parent(n)["type"] != "TaggedTemplateExpression":
        found = [e for e in n["expressions"] if bad(e)]
    elif n["type"] == "BinaryExpression" and n["operator"] == "+":
        found = [a for a, b in ((n["left"], n["right"]), (n["right"], n["left"])) if t.is_a(b, "string") and bad(a)]
    else:
        owner, method = call_of(n)
        found = [owner] if owner is not None and method in ("toString", "toLocaleString") and not n["arguments"] and bad(owner) else [n["arguments"][0]] if owner is None and method == "String" and n["arguments"] and f.is_global(plain(n["callee"])) and bad(n["arguments"][0]) else []
    yield from ((e, {"name": f.text(e)}) for e in found)


@rule("no-unsafe-argument", "typescript", "Unsafe argument of type `any` assigned to a parameter of type {{to}}.", "CallExpression NewExpression", "ts")
def _(f, n, o):
    t = types(f)
    symbol = f.symbol(plain(n["callee"])) if plain(n["callee"])["type"] == "Identifier" else None
    at = f.parent(f.node_at(symbol["node_id"])) if symbol else None
    params = at["params"] if at is not None and at["type"] in (*FUNCTIONS, "TSDeclareFunction") else at["init"]["params"] if at is not None and at["type"] == "VariableDeclarator" and at["init"] and at["init"]["type"] in FUNCTIONS else None
    note = f.node_at(symbol["node_id"]).get("typeAnnotation") if symbol else None
    if params is None and note and note["typeAnnotation"]["type"] == "TSFunctionType":
        params = note["typeAnnotation"]["params"]
    for i, a in enumerate(n["arguments"] if params else ()):
        p = params[min(i, len(params) - 1)]
        if i >= len(params) and p["type"] != "RestElement":
            return
        want = t.said((p if p["type"] != "AssignmentPattern" else p["left"]).get("typeAnnotation"))
        if p["type"] == "RestElement" and t.base(want) == "array" and isinstance(want, tuple):
            want = want[1]
        have = t.of(a["argument"] if a["type"] == "SpreadElement" else a)
        loose = have == "any" or (t.base(have) in ("array", "promise") and isinstance(have, tuple) and have[1] == "any" and want not in ("?",))
        if loose and want not in ("any", "unknown", "?") and not (isinstance(want, tuple) and want == have):
            yield a, {"to": f"`{t.base(want)}`"}


@rule("no-unsafe-assignment", "typescript", "Unsafe assignment of an `any` value.", "VariableDeclarator AssignmentExpression PropertyDefinition AssignmentPattern", "ts")
def _(f, n, o):
    t = types(f)
    kind = n["type"]
    target, value = (n["id"], n["init"]) if kind == "VariableDeclarator" else (n, n["value"]) if kind == "PropertyDefinition" else (n["left"], n["right"])
    if value is None or (kind == "AssignmentExpression" and n["operator"] != "=") or plain(value)["type"] in FUNCTIONS:
        return
    want, have = t.said(target.get("typeAnnotation")), t.of(value)
    if kind == "AssignmentExpression":
        want = t.of(target)
    if want in ("unknown",):
        return
    if have == "any" or (t.base(have) in ("array", "promise") and isinstance(have, tuple) and have[1] == "any" and not (isinstance(want, tuple) and want[0] == have[0] and want[1] in ("any", "unknown"))):
        yield n


@rule("no-unsafe-call", "typescript", "Unsafe call of an `any` typed value.", "CallExpression NewExpression TaggedTemplateExpression", "ts")
def _(f, n, o):
    callee = n.get("callee") or n["tag"]
    if callee["type"] != "Import" and types(f).of(callee) == "any":
        yield callee


@rule("no-unsafe-member-access", "typescript", "Unsafe member access {{property}} on an `any` value.", "MemberExpression", "ts")
def _(f, n, o):
    t = types(f)
    if t.of(n["object"]) == "any" and plain(n["object"])["type"] != "MemberExpression":
        yield n["property"], {"property": f"[{f.text(n['property'])}]" if n["computed"] else f".{f.text(n['property'])}"}
    elif n["computed"] and t.of(n["property"]) == "any":
        yield n["property"], {"property": f"[{f.text(n['property'])}]"}


@rule("no-unsafe-return", "typescript", "Unsafe return of a value of type `any`.", "ReturnStatement ArrowFunctionExpression", "ts")
def _(f, n, o):
    t = types(f)
    value = n["argument"] if n["type"] == "ReturnStatement" else n["body"] if n["body"]["type"] != "BlockStatement" else None
    fn = f.function_of(n) if n["type"] == "ReturnStatement" else n
    if value is None or fn is None:
        return
    want, have = t.said(fn.get("returnType")), t.of(value)
    if want in ("any", "unknown") or (t.base(want) == "promise" and isinstance(want, tuple) and want[1] in ("any", "unknown")):
        return
    if have == "any" or (t.base(have) in ("array", "promise") and isinstance(have, tuple) and have[1] == "any" and want != have):
        yield n if n["type"] == "ReturnStatement" else value


@rule("no-unsafe-unary-minus", "typescript", "Argument of unary negation should be assignable to number | bigint.", "UnaryExpression", "ts")
def _(f, n, o):
    t = types(f)
    if n["operator"] == "-" and any(t.base(m) not in ("number", "bigint", "any", "?", "never", "enum", "unknown") for m in t.members(t.of(n["argument"]))):
        yield n


@rule("no-unsafe-enum-comparison", "typescript", "The two values in this comparison do not have a shared enum type.", "BinaryExpression", "ts")
def _(f, n, o):
    t = types(f)
    left, right = t.of(n["left"]), t.of(n["right"])
    if n["operator"] in ("==", "===", "!=", "!==", "<", ">", "<=", ">=") and "enum" in (t.base(left), t.base(right)) and left != right and not {t.base(left), t.base(right)} & {"?", "any", "unknown", "null", "undefined"} and "union" not in (t.base(left), t.base(right)):
        yield n


@rule("no-unsafe-type-assertion", "typescript", "Unsafe assertion from `any` detected: consider using type guards or a safer assertion.", "TSAsExpression TSTypeAssertion", "ts")
def _(f, n, o):
    t = types(f)
    have, want = t.of(n["expression"]), t.said(n["typeAnnotation"])
    if f.text(n["typeAnnotation"]) == "const" or want in ("any", "unknown", "?"):
        return
    if have == "any" or have == "unknown" or (have != "?" and "?" not in t.members(have) and set(t.members(want)) < set(t.members(have))):
        yield n


@rule("no-unnecessary-boolean-literal-compare", "typescript", "This expression unnecessarily compares a boolean value to a boolean.", "BinaryExpression", "ts")
def _(f, n, o):
    if n["operator"] in ("==", "===", "!=", "!=="):
        for a, b in ((n["left"], n["right"]), (n["right"], n["left"])):
            if static(b) in ("true", "false") and plain(b)["type"] == "Literal" and plain(b)["literal"] == "boolean" and types(f).is_a(a, "boolean"):
                yield n
                return


@rule("no-unnecessary-condition", "typescript", "Unnecessary conditional, value is always {{what}}.", "IfStatement ConditionalExpression WhileStatement LogicalExpression", "ts", allowConstantLoopConditions=False)
def _(f, n, o):
    t = types(f)
    test = n["left"] if n["type"] == "LogicalExpression" else n["test"]
    if n["type"] == "WhileStatement" and o["allowConstantLoopConditions"] and static(test) == "true":
        return
    found = t.members(t.of(test))
    if "?" in found or "any" in found or "unknown" in found:
        return
    if n["type"] == "LogicalExpression" and n["operator"] == "??":
        if not {"null", "undefined", "void"} & {x for x in found if isinstance(x, str)}:
            yield test, {"what": "non-nullish"}
        return
    always = [True if t.base(m) in ("array", "object", "fn", "promise", "class", "regexp", "symbol") else False if m in ("null", "undefined", "void") else (m[2] not in ("", "0", "false", "0n")) if isinstance(m, tuple) and m[0] == "literal" else None for m in found]
    if None not in always and len(set(always)) == 1:
        yield test, {"what": "truthy" if always[0] else "falsy"}


@rule("no-unnecessary-type-assertion", "typescript", "This assertion is unnecessary since it does not change the type of the expression.", "TSAsExpression TSNonNullExpression", "ts")
def _(f, n, o):
    t = types(f)
    have = t.of(n["expression"])
    if n["type"] == "TSNonNullExpression":
        if "?" not in t.members(have) and not {"any", "unknown", "null", "undefined", "void"} & {x for x in t.members(have) if isinstance(x, str)}:
            yield n
    elif have != "?" and f.text(n["typeAnnotation"]) != "const" and t.said(n["typeAnnotation"]) == have and "?" not in str(have):
        yield n


@rule("no-unnecessary-type-conversion", "typescript", "Converting a {{kind}} to a {{kind}} has no effect.", "CallExpression UnaryExpression", "ts")
def _(f, n, o):
    t = types(f)
    if n["type"] == "UnaryExpression":
        if n["operator"] == "+" and t.is_a(n["argument"], "number"):
            yield n, {"kind": "number"}
        elif n["operator"] == "!" and n["argument"]["type"] == "UnaryExpression" and n["argument"]["operator"] == "!" and t.is_a(n["argument"]["argument"], "boolean"):
            yield n, {"kind": "boolean"}
        return
    owner, method = call_of(n)
    kinds = {"String": "string", "Number": "number", "Boolean": "boolean", "BigInt": "bigint"}
    if owner is None and method in kinds and len(n["arguments"]) == 1 and f.is_global(plain(n["callee"])) and t.is_a(n["arguments"][0], kinds[method]):
        yield n, {"kind": kinds[method]}
    elif owner is not None and method == "toString" and not n["arguments"] and t.is_a(owner, "string"):
        yield n, {"kind": "string"}


@rule("no-unnecessary-type-parameters", "typescript", "Type parameter {{name}} is used only once in the function signature.", "TSTypeParameter", "ts")
def _(f, p, o):
    owner = f.parent(f.parent(p))
    name = name_of(p["name"]) if isinstance(p["name"], dict) else p["name"]
    if owner["type"] in (*FUNCTIONS, "TSDeclareFunction", "TSFunctionType", "TSMethodSignature", "TSCallSignatureDeclaration", *CLASSES):
        uses = [r for r in f.below(owner, "TSTypeReference") if name_of(r["typeName"]) == name]
        if len(uses) < 2 and not any(f.nearest(u, "TSArrayType", "TSTypeParameterInstantiation") for u in uses):
            yield p, {"name": name}


@rule("no-meaningless-void-operator", "typescript", "void operator shouldn't be used on {{kind}}; it should convey that a return value is being ignored.", "UnaryExpression", "ts")
def _(f, n, o):
    if n["operator"] == "void" and types(f).is_a(n["argument"], "void", "undefined"):
        yield n, {"kind": str(types(f).of(n["argument"]))}


@rule("no-confusing-void-expression", "typescript", "Placing a void expression inside another expression is forbidden. Move it to its own statement instead.", "CallExpression", "ts", ignoreArrowShorthand=False, ignoreVoidOperator=False)
def _(f, n, o):
    if types(f).of(n) != "void":
        return
    parent, slot = f.parent(n), f.slot(n)
    while parent["type"] == "ChainExpression" or (parent["type"] == "LogicalExpression" and slot == "right") or (parent["type"] == "ConditionalExpression" and slot != "test"):
        slot, parent = f.slot(parent), f.parent(parent)
    if parent["type"] == "ExpressionStatement" or (parent["type"] == "ArrowFunctionExpression" and o["ignoreArrowShorthand"]) or (parent["type"] == "UnaryExpression" and parent["operator"] == "void"):
        return
    yield n


@rule("only-throw-error", "typescript", "Expected an error object to be thrown.", "ThrowStatement", "ts", allowThrowingAny=False, allowThrowingUnknown=False)
def _(f, n, o):
    t = types(f)
    found = t.of(n["argument"])
    if f.nearest(n, "CatchClause", stop=FUNCTIONS) and found == "any" and plain(n["argument"])["type"] == "Identifier":
        return
    if any(t.base(m) in (*PRIMITIVES, "array", "object", "fn", "promise", "regexp", "enum") or (t.base(m) == "any" and not o["allowThrowingAny"]) for m in t.members(found)):
        yield n


@rule("prefer-promise-reject-errors", "typescript", "Expected the Promise rejection reason to be an Error.", "CallExpression", allowEmptyReject=False)
def _(f, n, o):
    owner, method = call_of(n)
    executor = plain(n["callee"])
    is_reject = owner is not None and name_of(owner) == "Promise" and method == "reject"
    if owner is None and executor["type"] == "Identifier" and (symbol := f.symbol(executor)):
        at = f.node_at(symbol["node_id"])
        fn = f.parent(at)
        is_reject = fn is not None and fn["type"] in FUNCTIONS and f.slot(at) == "params" and f.index(at) == 1 and f.parent(fn)["type"] == "NewExpression" and name_of(f.parent(fn)["callee"]) == "Promise"
    if not is_reject:
        return
    if not n["arguments"]:
        if not o["allowEmptyReject"]:
            yield n
        return
    value = plain(n["arguments"][0])
    if value["type"] in ("Literal", "TemplateLiteral", "ObjectExpression", "ArrayExpression", "BinaryExpression", "UnaryExpression", *FUNCTIONS) or name_of(value) == "undefined" and value["type"] == "Identifier" or types(f).is_a(value, *PRIMITIVES):
        yield n


@rule("promise-function-async", "typescript", "Functions that return promises must be async.", _ALL, "ts", checkArrowFunctions=True, checkFunctionDeclarations=True, checkFunctionExpressions=True)
def _(f, fn, o):
    t = types(f)
    if fn.get("async") or fn.get("generator") or fn["body"] is None or not o["check" + {"A": "ArrowFunctions", "D": "FunctionDeclarations", "E": "FunctionExpressions"}["A" if fn["type"][0] == "A" else "D" if fn["type"].endswith("Declaration") else "E"]]:
        return
    holder = f.parent(fn)
    if holder["type"] == "MethodDefinition" and holder["kind"] != "method":
        return
    found = t._returns(fn)
    if all(t.base(m) == "promise" for m in t.members(found)):
        yield fn


@rule("require-array-sort-compare", "typescript", "Require 'compare' argument.", "CallExpression", "ts", ignoreStringArrays=True)
def _(f, n, o):
    owner, method = call_of(n)
    if owner is not None and method in ("sort", "toSorted") and not n["arguments"]:
        found = types(f).of(owner)
        if types(f).base(found) == "array" and isinstance(found, tuple) and not (o["ignoreStringArrays"] and types(f).base(found[1]) == "string"):
            yield n


@rule("restrict-plus-operands", "typescript", "Numeric '+' operations must either be both bigints or both numbers. Got `{{left}}` + `{{right}}`.", "BinaryExpression AssignmentExpression", "ts", allowAny=False, allowNumberAndString=False)
def _(f, n, o):
    if n["operator"] not in ("+", "+="):
        return
    t = types(f)
    left, right = t.base(t.of(n["left"])), t.base(t.of(n["right"]))
    if "?" in (left, right) or "union" in (left, right):
        return
    fine = left == right and left in ("number", "string", "bigint") or ("any" in (left, right) and o["allowAny"]) or ({left, right} <= {"number", "string", "bigint"} and "string" in (left, right) and o["allowNumberAndString"])
    if not fine:
        yield n, {"left": left, "right": right}


@rule("restrict-template-expressions", "typescript", "Invalid type \"{{type}}\" of template literal expression.", "TemplateLiteral", "ts", allowNumber=False, allowBoolean=False, allowAny=False, allowNullish=False, allowRegExp=False, allowArray=False, allowNever=False)
def _(f, n, o):
    t = types(f)
    if f.parent(n)["type"] == "TaggedTemplateExpression":
        return
    fine = {"string", "?", "class"} | ({"number", "bigint"} if o["allowNumber"] else set()) | ({"boolean"} if o["allowBoolean"] else set()) | ({"any"} if o["allowAny"] else set()) | ({"null", "undefined"} if o["allowNullish"] else set()) | ({"regexp"} if o["allowRegExp"] else set()) | ({"array"} if o["allowArray"] else set())
    for e in n["expressions"]:
        odd = [t.base(m) for m in t.members(t.of(e)) if t.base(m) not in fine]
        if odd:
            yield e, {"type": odd[0]}


@rule("strict-boolean-expressions", "typescript", "Unexpected {{what}} value in conditional. An explicit check is required.", "IfStatement ConditionalExpression WhileStatement DoWhileStatement ForStatement LogicalExpression UnaryExpression", "ts", allowString=True, allowNumber=True, allowNullableObject=True, allowAny=False, allowNullableBoolean=False, allowNullableString=False, allowNullableNumber=False)
def _(f, n, o):
    t = types(f)
    kind = n["type"]
    tests = [n["left"]] if kind == "LogicalExpression" and n["operator"] != "??" else [n["argument"]] if kind == "UnaryExpression" and n["operator"] == "!" else [n["test"]] if n.get("test") else []
    for e in tests:
        if plain(e)["type"] == "LogicalExpression" or (plain(e)["type"] == "UnaryExpression" and plain(e)["operator"] == "!"):
            continue
        found = t.members(t.of(e))
        if "?" in found:
            continue
        kinds = {t.base(m) for m in found}
        nullish = bool(kinds & {"null", "undefined", "void"})
        kinds -= {"null", "undefined", "void"}
        what = (
            "nullish" if not kinds
            else "any" if kinds & {"any", "unknown"} and not o["allowAny"]
            else None if kinds & {"any", "unknown"}
            else ("nullable boolean" if nullish and not o["allowNullableBoolean"] else None) if kinds == {"boolean"}
            else ("nullable string" if nullish and not o["allowNullableString"] else "string" if not o["allowString"] and not nullish else None) if kinds == {"string"}
            else ("nullable number" if nullish and not o["allowNullableNumber"] else "number" if not o["allowNumber"] and not nullish else None) if kinds <= {"number", "bigint"}
            else (None if nullish and o["allowNullableObject"] else "object") if kinds <= {"object", "array", "fn", "class", "promise", "regexp", "symbol"}
            else None
        )
        if what:
            yield e, {"what": what}


@rule("switch-exhaustiveness-check", "typescript", "Switch is not exhaustive. Cases not matched: {{missing}}", "SwitchStatement", "ts", considerDefaultExhaustiveForUnions=False)
def _(f, n, o):
    t = types(f)
    found = t.of(n["discriminant"])
    members = t.members(found)
    if t.base(found) == "enum":
        declared = t.named[found[1]]
        wanted = {f"{found[1]}.{name_of(m)}": f"{found[1]}.{name_of(m)}" for m in declared["members"]}
    elif t.base(found) == "boolean":
        wanted = {"true": "true", "false": "false"}
    elif members and all(isinstance(m, tuple) and m[0] == "literal" or m in ("null", "undefined") for m in members) and isinstance(found, tuple) and found[0] == "union":
        wanted = {m if isinstance(m, str) else m[2]: m if isinstance(m, str) else f'"{m[2]}"' if m[1] == "string" else m[2] for m in members}
    else:
        return
    if any(c["test"] is None for c in n["cases"]):
        return
    for c in n["cases"]:
        wanted.pop(f.text(c["test"]) if t.base(found) == "enum" else static(c["test"]) if static(c["test"]) is not None else name_of(c["test"]), None)
    if wanted:
        yield n["discriminant"], {"missing": " | ".join(wanted.values())}


@rule("unbound-method", "typescript", "Avoid referencing unbound methods which may cause unintentional scoping of `this`.", "MemberExpression", "ts", ignoreStatic=False)
def _(f, n, o):
    t = types(f)
    owner = t.of(n["object"])
    if t.base(owner) not in ("class", "class-itself") or owner[1] not in t.named:
        return
    parent, slot = f.parent(n), f.slot(n)
    if (parent["type"] in ("CallExpression", "TaggedTemplateExpression") and slot in ("callee", "tag")) or parent["type"] in ("MemberExpression", "UnaryExpression", "IfStatement", "BinaryExpression") and slot in ("object", "argument", "test", "left", "right") or (parent["type"] == "AssignmentExpression" and slot == "left"):
        return
    body = t.named[owner[1]].get("body")
    for m in body["body"] if isinstance(body, dict) and "body" in body else ():
        if m["type"] == "MethodDefinition" and m["kind"] == "method" and name_of(m) == name_of(n) and bool(m["static"]) == (t.base(owner) == "class-itself") and not (m["static"] and o["ignoreStatic"]):
            if not (m["value"]["params"] and name_of(m["value"]["params"][0]) == "this"):
                yield n


@rule("prefer-readonly-parameter-types", "typescript", "Parameter should be a read only type.", _ALL, "ts")
def _(f, fn, o):
    for p in fn["params"]:
        note = (p.get("parameter") or p).get("typeAnnotation")
        said = note["typeAnnotation"] if note else None
        if said is not None and (said["type"] in ("TSArrayType", "TSTupleType") or (said["type"] == "TSTypeReference" and name_of(said["typeName"]) in ("Array", "Set", "Map")) or (said["type"] == "TSTypeLiteral" and any(m["type"] == "TSPropertySignature" and not m.get("readonly") for m in said["members"]))):
            yield p


def reachable(f: File, node: dict) -> bool:
    """Whether control can come to a statement from the start of its function."""
    at = node
    for a in f.above(node):
        body = a.get("body") if a["type"] in ("BlockStatement", "Program", "StaticBlock") else a.get("consequent") if a["type"] == "SwitchCase" else None
        if isinstance(body, list) and f.slot(at) in ("body", "consequent") and NEXT not in sequence(body[: f.index(at)]):
            return False
        if a["type"] in FUNCTIONS:
            return True
        at = a
    return True


__all__ = ["RETURN", "RULES", "TreeRule", "find", "leaves", "reachable", "rule"]


# -- limits, with their options ---------------------------------------------------------------


@rule("max-params", "style", "Function has too many parameters ({{count}}). Maximum allowed is {{max}}.", _ALL + " TSDeclareFunction", max=3, countVoidThis=False)
def _(f, fn, o):
    params = [p for p in fn["params"] if o["countVoidThis"] or not (name_of(p) == "this" and f.text((p.get("typeAnnotation") or {}).get("typeAnnotation")) == "void")]
    if len(params) > o["max"]:
        yield fn, {"count": str(len(params)), "max": str(o["max"])}


@rule("max-depth", "style", "Blocks are nested too deeply ({{depth}}). Maximum allowed is {{max}}.", "IfStatement SwitchStatement TryStatement WithStatement " + _LOOPS, max=4)
def _(f, n, o):
    def counts(x: dict) -> bool:
        return x["type"] in ("SwitchStatement", "TryStatement", "WithStatement", *LOOPS) or (x["type"] == "IfStatement" and not (f.parent(x)["type"] == "IfStatement" and f.slot(x) == "alternate"))

    if counts(n):
        depth = 1
        for a in f.above(n):
            if a["type"] in (*FUNCTIONS, "StaticBlock"):
                break
            depth += counts(a)
        if depth > o["max"]:
            yield n, {"depth": str(depth), "max": str(o["max"])}


@rule("complexity", "style", "Function has a complexity of {{complexity}}. Maximum allowed is {{max}}.", _ALL, max=20)
def _(f, fn, o):
    own = f.below(fn, "IfStatement", "ConditionalExpression", "LogicalExpression", "AssignmentExpression", "CatchClause", "SwitchCase", "AssignmentPattern", *LOOPS, into=False)
    n = 1 + sum(x["type"] != "CatchClause" and (x["type"] != "AssignmentExpression" or x["operator"] in ("&&=", "||=", "??=")) and (x["type"] != "SwitchCase" or x["test"] is not None) for x in own)
    if n > o["max"]:
        yield fn, {"complexity": str(n), "max": str(o["max"])}


@rule("max-lines", "style", "File has too many lines ({{actual}}). Maximum allowed is {{max}}.", "Program", max=300, skipBlankLines=False, skipComments=False)
def _(f, program, o):
    text = f.source.split("\n")
    if text and not text[-1]:
        text.pop()
    coded = {f.place(t.start)[0] for t in f.tokens}
    covered = {i for c in f.comments for i in range(f.place(c.start)[0], f.place(c.end)[0] + 1)} - coded
    n = sum(not (o["skipBlankLines"] and not line.strip()) and not (o["skipComments"] and i in covered) for i, line in enumerate(text, 1))
    if n > o["max"]:
        yield program, {"actual": str(n), "max": str(o["max"])}


@rule("max-statements", "style", "Function has too many statements ({{count}}). Maximum allowed is {{max}}.", _ALL, max=10)
def _(f, fn, o):
    def count(body: list[dict]) -> int:
        return sum(1 + sum(count(b["body"]) for b in f.below(s, "BlockStatement", into=False) if f.parent(b)["type"] not in FUNCTIONS and f.nearest(b, "BlockStatement", stop=FUNCTIONS) in (None, f.parent(s))) for s in body)

    n = count(_body(fn))
    if n > o["max"]:
        yield fn, {"count": str(n), "max": str(o["max"])}


@rule("max-classes-per-file", "style", "File has too many classes ({{count}}). Maximum allowed is {{max}}.", "Program", max=1, ignoreExpressions=False)
def _(f, program, o):
    n = len(f.each("ClassDeclaration") if o["ignoreExpressions"] else f.each(*CLASSES))
    if n > o["max"]:
        yield program, {"count": str(n), "max": str(o["max"])}


@rule("id-length", "style", "Identifier name '{{name}}' is too {{what}}.", "Identifier", min=2, max=1 << 30, exceptions=[], properties="always")
def _(f, n, o):
    key = f.slot(n) == "key" and f.parent(n)["type"] in ("Property", "PropertyDefinition", "MethodDefinition") and not f.parent(n)["computed"] and o["properties"] == "always"
    if (_declares(f, n) or (key and f.parent(f.parent(n))["type"] != "ObjectPattern")) and n["name"] not in o["exceptions"] and not o["min"] <= len(n["name"]) <= o["max"]:
        yield n, {"name": n["name"], "what": "short" if len(n["name"]) < o["min"] else "long"}


@rule("no-console", "suspicious", "Unexpected console statement.", "MemberExpression", allow=[])
def _(f, n, o):
    if name_of(n["object"]) == "console" and n["object"]["type"] == "Identifier" and f.is_global(n["object"]) and name_of(n) not in o["allow"]:
        yield n


@rule("no-plusplus", "style", "Unary operator '{{operator}}' used.", "UpdateExpression", allowForLoopAfterthoughts=False)
def _(f, n, o):
    at = n
    while f.parent(at)["type"] == "SequenceExpression":
        at = f.parent(at)
    if not (o["allowForLoopAfterthoughts"] and f.parent(at)["type"] == "ForStatement" and f.slot(at) == "update"):
        yield n, {"operator": n["operator"]}


@rule("eqeqeq", "suspicious", "Expected '{{expected}}' and instead saw '{{operator}}'.", "BinaryExpression", mode="always", null="always")
def _(f, n, o):
    if n["operator"] not in ("==", "!="):
        return
    sides = [plain(n["left"]), plain(n["right"])]
    null = any(s["type"] == "Literal" and s["literal"] == "null" for s in sides)
    typeof = any(s["type"] == "UnaryExpression" and s["operator"] == "typeof" for s in sides)
    alike = all(s["type"] == "Literal" for s in sides) and sides[0]["literal"] == sides[1]["literal"]
    if (o["mode"] == "smart" and (null or typeof or alike)) or (null and (o["null"] == "ignore" or o["mode"] == "allow-null")):
        return
    yield n, {"expected": n["operator"] + "=", "operator": n["operator"]}


@rule("early-errors", "syntax", "{{why}}.", "Program")
def _(f, n, o):
    yield from ((node, {"why": why}) for node, why in early(f))
