"""JSON rules, visitors, and questions about places."""

import pytest
from lintmill.operators import places
from lintmill.operators.node_rules import RULES, run_node_rules
from lintmill.operators.plugins import json_rule, register, run_visitor
from lintmill.operators.structure_rules import scope_ancestors
from lintmill.plans.parsed import parse_files
from lintmill.sources.files import in_memory


def test_json_rule(spark):
    made = json_rule('{"name": "no-foo-call", "message": "no {{callee.name}}", "selector": "CallExpression", "where": [{"attr": "callee.name", "op": "in", "value": ["foo", "it\'s"]}, {"attr": "arguments.length", "op": "gt", "value": 0}]}')
    register(made)
    try:
        nodes = parse_files(in_memory(spark, {"a.js": "foo(1); foo(); bar(1)"}), ("nodes",)).nodes
        assert [r["col"] for r in run_node_rules(nodes, ["no-foo-call"]).collect()] == [0]
    finally:
        del RULES["no-foo-call"]
    for bad in ({"name": "a", "message": "", "selector": "A", "where": [{"attr": "a", "op": "odd", "value": 1}]}, {"name": "a", "message": "", "selector": "A", "wher": []}):
        with pytest.raises(ValueError, match="unknown"):
            json_rule(bad)


def test_visitors(spark):
    def nested(context):  # inside the test, so that it travels to the workers by value
        def call(node):
            depth = sum(a["type"] == "CallExpression" for a in context.ancestors)
            if depth >= context.options[0]:
                context.report(node, f"nested {depth} deep: {context.text(node)}", (node["start"], node["end"], "x"))

        return {"CallExpression": call}

    def broken(context):
        return {"Program:exit": lambda node: 1 / 0}

    files = in_memory(spark, {"a.js": "f(g(h()))", "b.js": "f()"})
    rows = run_visitor(files, "nested", nested, [2]).collect()
    assert [(r["path"], r["message"], r["col"], r["fix"]["text"]) for r in rows] == [("a.js", "nested 2 deep: h()", 4, "x")]
    assert {r["message"] for r in run_visitor(files, "broken", broken).collect()} == {"rule failed: division by zero"}


def test_scopes_of_any_depth(spark):
    rows = [("p", i, i - 1 if i else None, i) for i in range(71)]
    found = scope_ancestors(spark.createDataFrame(rows, "path string, scope_id int, parent_scope int, depth int"))
    assert sorted((r["scope_id"], r["above"]) for r in found.collect()) == [(i, j) for i in range(71) for j in range(i)]


def test_places(spark):
    t = parse_files(in_memory(spark, {"a.js": "let a = 1; /* in */ { /* here */ let b = a; let a = 2 }"}))
    offsets = spark.createDataFrame([("a.js", 0), ("a.js", 5), ("a.js", 9)], "path string, offset int")
    assert {r["offset"]: r["token"] and r["token"]["text"] for r in places.token_before(t.tokens, offsets).collect()} == {0: None, 5: "a", 9: "1"}
    assert {r["offset"]: r["type"] for r in places.innermost(t.nodes, offsets).collect()} == {0: "VariableDeclaration", 5: "VariableDeclarator", 9: "VariableDeclaration"}
    block = t.nodes.where("type = 'BlockStatement'")
    assert [r["text"] for r in places.comments_inside(block, t.comments).collect()] == [" here "]
    middle = next(r for r in places.with_neighbours(t.tokens).collect() if r["text"] == "=")
    assert (middle["before"]["text"], middle["after"]["text"]) == ("a", "1")
    seen = {(r["scope_id"], r["name"]): r["symbol_id"] for r in places.variables_in_scope(t.symbols, t.scopes).collect()}
    assert seen == {(0, "a"): 0, (1, "b"): 1, (1, "a"): 2}
