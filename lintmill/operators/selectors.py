"""Tree selectors as DataFrame plans.

A selector such as ``CallExpression[callee.name="eval"]`` is a filter on one row of ``nodes``: a node's
row carries the attributes of the nodes below it. ``A > B`` with a bare type on the left
reads the parent's type from the row; other combinators are joins within a file: child on the parent
id, descendant on the interval of node ids, siblings on parent, slot and order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the class names of selectors stand for.
FUNCTIONS = ("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression")
CLASSES = {
    "function": lambda t: t.isin(*FUNCTIONS),
    "statement": lambda t: t.endswith("Statement") | t.endswith("Declaration"),
    "declaration": lambda t: t.endswith("Declaration"),
    "pattern": lambda t: t.endswith("Pattern") | t.endswith("Expression") | (t == "Identifier"),
    "expression": lambda t: t.endswith("Expression") | t.endswith("Literal") | (t == "Identifier"),
}


class SelectorError(ValueError):
    pass


@dataclass(frozen=True)
class Compound:
    """Tests of one node; ``groups`` are :not, :matches and :has with their selector lists."""

    type: str | None
    attributes: tuple[tuple[str, str | None, str | None, str], ...] = ()
    classes: tuple[str, ...] = ()
    field: str | None = None
    places: tuple[tuple[str, int], ...] = ()
    groups: tuple[tuple[str, tuple], ...] = ()


@dataclass(frozen=True)
class Joined:
    left: Compound | Joined
    combinator: str
    right: Compound


_NAME = re.compile(r"[A-Za-z_$][\w$-]*")
_ATTRIBUTE = re.compile(r"\[\s*([\w$.]+)\s*(?:(<=|>=|!=|=|<|>)\s*(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|/((?:[^/\\]|\\.)+)/(\w*)|type\((\w+)\)|([^\]\s]+))\s*)?\]")


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text.removesuffix(":exit"), 0

    def space(self) -> bool:
        start = self.at
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.at > start

    def list_(self) -> tuple:
        out = [self.complex()]
        while self.at < len(self.text) and self.text[self.at] == ",":
            self.at += 1
            out.append(self.complex())
        return tuple(out)

    def complex(self) -> Compound | Joined:
        self.space()
        left: Compound | Joined = self.compound()
        while True:
            gap = self.space()
            if self.at >= len(self.text) or self.text[self.at] in ",)":
                return left
            combinator = " "
            if self.text[self.at] in ">~+":
                combinator = self.text[self.at]
                self.at += 1
                self.space()
            elif not gap:
                raise SelectorError(f"unexpected {self.text[self.at]!r} in {self.text!r}")
            left = Joined(left, combinator, self.compound())

    def compound(self) -> Compound:
        kind, attributes, classes, field, places, groups = None, [], [], None, [], []
        start = self.at
        if self.at < len(self.text) and self.text[self.at] == "*":
            self.at += 1
        elif m := _NAME.match(self.text, self.at):
            kind, self.at = m.group(), m.end()
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "[":
                m = _ATTRIBUTE.match(self.text, self.at)
                if not m:
                    raise SelectorError(f"bad attribute in {self.text!r}")
                path, op, *values = m.groups()
                double, single, pattern, flags, of_type, bare = values
                if of_type is not None:
                    attributes.append((path, op, of_type, "type"))
                elif pattern is not None:
                    attributes.append((path, op, (f"(?{flags})" if flags else "") + pattern, "pattern"))
                else:
                    text = next((v for v in (double, single, bare) if v is not None), None)
                    attributes.append((path, op, text, "text"))
                self.at = m.end()
            elif c == ".":
                m = re.compile(r"\.([\w.]+)").match(self.text, self.at)
                field, self.at = m.group(1), m.end()
            elif c == ":":
                m = re.compile(r":([\w-]+)").match(self.text, self.at)
                name, self.at = m.group(1), m.end()
                if self.at < len(self.text) and self.text[self.at] == "(":
                    self.at += 1
                    if name in ("not", "matches", "is", "has"):
                        groups.append(("matches" if name == "is" else name, self.list_()))
                    elif name in ("nth-child", "nth-last-child"):
                        m = re.compile(r"\s*(\d+)\s*").match(self.text, self.at)
                        places.append((name, int(m.group(1))))
                        self.at = m.end()
                    else:
                        raise SelectorError(f"unknown class :{name}")
                    if self.text[self.at : self.at + 1] != ")":
                        raise SelectorError(f"missing ) in {self.text!r}")
                    self.at += 1
                elif name in ("first-child", "last-child"):
                    places.append((name, 1))
                elif name in CLASSES:
                    classes.append(name)
                else:
                    raise SelectorError(f"unknown class :{name}")
            else:
                break
        if self.at == start:
            raise SelectorError(f"empty selector in {self.text!r}")
        return Compound(kind, tuple(attributes), tuple(classes), field, tuple(places), tuple(groups))


def parse_selector(text: str) -> tuple:
    """The alternatives of a selector list."""
    reader = _Reader(text)
    out = reader.list_()
    if reader.at < len(reader.text):
        raise SelectorError(f"unexpected {reader.text[reader.at]!r} in {text!r}")
    return out


def attribute(path: str) -> Column:
    """A node's attribute as text; null where there is none."""
    if path in ("type", "slot"):
        return F.col(path)
    if path == "parent.type":
        return F.col("parent_type")
    return F.col("attrs")[path]


def _attribute_test(path: str, op: str | None, value: str | None, form: str) -> Column:
    col = attribute(path)
    present = col.isNotNull() | F.col("attrs")[f"{path}.type"].isNotNull() | F.col("attrs")[f"{path}.length"].isNotNull()
    if op is None:
        return present
    if form == "pattern":
        hit = F.coalesce(col.rlike(value), F.lit(False))
        return hit if op == "=" else ~hit
    if form == "type":
        kinds = {"string": "string", "number": "number", "boolean": "boolean"}
        return F.coalesce(F.col("attrs")["literal"] == kinds.get(value, value), F.lit(False))
    if op in ("=", "!="):
        # both sides are compared as text; a missing attribute prints as null or undefined
        same = F.coalesce(col == value, F.lit(value in ("null", "undefined")) & ~present)
        return same if op == "=" else ~same
    number, bound = col.cast("double"), F.lit(float(value))
    test = {"<": number < bound, ">": number > bound, "<=": number <= bound, ">=": number >= bound}[op]
    return F.coalesce(test, F.lit(False))


def predicate(c: Compound) -> Column:
    """The test of a node's own row; :has and joins are not part of it."""
    test = F.lit(True)
    if c.type:
        test &= F.col("type") == c.type
    for x in c.attributes:
        test &= _attribute_test(*x)
    for name in c.classes:
        test &= CLASSES[name](F.col("type"))
    if c.field:
        test &= F.col("slot") == c.field.split(".")[-1]
    for name, n in c.places:
        if name in ("first-child", "nth-child"):
            test &= (F.col("ord") == n - 1) & F.col("in_list")
        else:
            test &= (F.col("from_end") == n - 1) & F.col("in_list")
    for name, members in c.groups:
        if name != "has" and all(_simple(m) for m in members):
            any_of = F.lit(False)
            for m in members:
                any_of |= row_test(m)
            test &= any_of if name == "matches" else ~any_of
    return test


def _bare(c: Compound | Joined) -> bool:
    return isinstance(c, Compound) and not (c.attributes or c.field or c.places or c.groups)


def _simple(s: Compound | Joined) -> bool:
    """Whether one row of nodes decides the selector."""
    if isinstance(s, Joined):
        return s.combinator == ">" and _bare(s.left) and _simple(s.right)
    return all(name != "has" and all(_simple(m) for m in members) for name, members in s.groups)


def row_test(s: Compound | Joined) -> Column:
    """The Column of a selector that one row decides."""
    if isinstance(s, Compound):
        return predicate(s)
    parent = F.lit(True) if s.left.type is None else F.col("parent_type") == s.left.type
    for name in s.left.classes:
        parent &= CLASSES[name](F.col("parent_type"))
    return F.coalesce(parent, F.lit(False)) & predicate(s.right)


_KEYS = ("path", "node_id", "parent_id", "last_id", "slot", "ord")


def _with_places(nodes: DataFrame, text: str) -> DataFrame:
    if not re.search(r":(first|last|nth|nth-last)-child", text):
        return nodes
    from pyspark.sql import Window as W

    w = W.partitionBy("path", "parent_id", "slot")
    return nodes.withColumn("from_end", F.max("ord").over(w) - F.col("ord")).withColumn("in_list", F.col("slot").isin("body", "elements", "arguments", "params", "declarations", "cases", "consequent", "properties", "expressions", "specifiers", "quasis", "members", "types"))


def _matching(nodes: DataFrame, s: Compound | Joined) -> DataFrame:
    if _simple(s):
        return nodes.where(row_test(s))
    if isinstance(s, Joined):
        left = _matching(nodes, s.left).select(*[F.col(c).alias(f"l_{c}") for c in _KEYS])
        right = _matching(nodes, s.right)
        file = F.col("path") == F.col("l_path")
        on = {
            ">": file & (F.col("parent_id") == F.col("l_node_id")),
            " ": file & (F.col("node_id") > F.col("l_node_id")) & (F.col("node_id") <= F.col("l_last_id")),
            "~": file & (F.col("parent_id") == F.col("l_parent_id")) & (F.col("slot") == F.col("l_slot")) & (F.col("ord") > F.col("l_ord")),
            "+": file & (F.col("parent_id") == F.col("l_parent_id")) & (F.col("slot") == F.col("l_slot")) & (F.col("ord") == F.col("l_ord") + 1),
        }[s.combinator]
        return right.join(left, on, "left_semi")
    out = nodes.where(predicate(s))
    for name, members in s.groups:
        if name != "has" and all(_simple(m) for m in members):
            continue
        found = None
        for m in members:
            part = _matching(nodes, m).select(*[F.col(c).alias(f"m_{c}") for c in _KEYS])
            found = part if found is None else found.unionByName(part)
        file = F.col("path") == F.col("m_path")
        if name == "has":
            inside = file & (F.col("m_node_id") > F.col("node_id")) & (F.col("m_node_id") <= F.col("last_id"))
            out = out.join(found, inside, "left_semi")
        else:
            out = out.join(found, file & (F.col("node_id") == F.col("m_node_id")), "left_semi" if name == "matches" else "left_anti")
    return out


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """The rows of ``nodes`` that the selector list matches, each once."""
    columns = nodes.columns
    nodes = _with_places(nodes, selector)
    members = parse_selector(selector)
    if all(_simple(m) for m in members):
        test = F.lit(False)
        for m in members:
            test |= row_test(m)
        return nodes.where(test).select(*columns)
    out = None
    for m in members:
        part = _matching(nodes, m).select(*columns)
        out = part if out is None else out.unionByName(part)
    return out if len(members) == 1 else out.dropDuplicates(["path", "node_id"])


# -- the same selectors on one tree in memory ---------------------------------------------------

_TREE_CLASSES = {
    "function": lambda t: t in FUNCTIONS,
    "statement": lambda t: t.endswith(("Statement", "Declaration")),
    "declaration": lambda t: t.endswith("Declaration"),
    "pattern": lambda t: t.endswith(("Pattern", "Expression")) or t == "Identifier",
    "expression": lambda t: t.endswith(("Expression", "Literal")) or t == "Identifier",
}


def _tree_value(f, node: dict, path: str):
    at: object = node
    for part in path.split("."):
        if part == "parent" and isinstance(at, dict):
            at = f.parent(at)
        elif isinstance(at, list):
            at = len(at) if part == "length" else at[int(part)] if part.isdigit() and int(part) < len(at) else None
        else:
            at = at.get(part) if isinstance(at, dict) else None
        if at is None:
            return None
    return at


def _tree_attribute(f, node: dict, path: str, op: str | None, value: str | None, form: str) -> bool:
    found = _tree_value(f, node, path)
    if op is None:
        return found is not None
    text = "true" if found is True else "false" if found is False else None if found is None else str(int(found)) if isinstance(found, float) and found == int(found) else str(found)
    if form == "pattern":
        return (text is not None and re.search(value, text) is not None) == (op == "=")
    if form == "type":
        return (type(found).__name__ == {"string": "str", "boolean": "bool", "number": "int"}.get(value, value)) == (op == "=")
    if op in ("=", "!="):
        return (text == value) == (op == "=")
    try:
        a, b = float(text), float(value)
    except (TypeError, ValueError):
        return False
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def _tree_compound(f, node: dict, c: Compound) -> bool:
    if c.type not in (None, "*") and node["type"] != c.type:
        return False
    if not all(_tree_attribute(f, node, *a) for a in c.attributes) or not all(_TREE_CLASSES[k](node["type"]) for k in c.classes):
        return False
    if c.field is not None:
        at, names = node, c.field.split(".")
        for name in reversed(names):
            if at is None or f.slot(at) != name:
                return False
            at = f.parent(at)
    for name, n in c.places:
        parent = f.parent(node)
        row = parent.get(f.slot(node)) if parent is not None else None
        if not isinstance(row, list) or (f.index(node) != n - 1 if name in ("first-child", "nth-child") else f.index(node) != len(row) - n):
            return False
    for name, members in c.groups:
        if name == "has":
            hit = any(any(d is not node and _tree_test(f, d, m) for d in f.nodes if node["start"] <= d["start"] and d["end"] <= node["end"] and any(a is node for a in f.above(d))) for m in members)
        else:
            hit = any(_tree_test(f, node, m) for m in members)
        if hit == (name == "not"):
            return False
    return True


def _tree_test(f, node: dict, s: Compound | Joined) -> bool:
    if isinstance(s, Compound):
        return _tree_compound(f, node, s)
    if not _tree_test(f, node, s.right):
        return False
    parent = f.parent(node)
    if s.combinator == ">":
        return parent is not None and _tree_test(f, parent, s.left)
    if s.combinator == " ":
        return any(_tree_test(f, a, s.left) for a in f.above(node))
    row = parent.get(f.slot(node)) if parent is not None else None
    if not isinstance(row, list):
        return False
    before = row[: f.index(node)][-1:] if s.combinator == "+" else row[: f.index(node)]
    return any(isinstance(b, dict) and _tree_test(f, b, s.left) for b in before)


def match_tree(f, selector: str) -> list[dict]:
    """Nodes of a file's tree that a selector list matches, in order of place; ``:exit`` at the end of a member is ignored."""
    members = parse_selector(re.sub(r":exit\b", "", selector))
    return sorted((n for n in f.nodes if any(_tree_test(f, n, m) for m in members)), key=lambda n: (n["start"], -n["end"]))
