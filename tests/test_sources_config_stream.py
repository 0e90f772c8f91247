"""Readers, globs, configuration, imports, the change stream, and the registry of queries."""

import datetime as dt
import re

import __spark_entry__
import pytest
from lintmill.functions import globs
from lintmill.operators import config
from lintmill.sources import files
from lintmill.streaming import editor
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("*.js", "a.js", True), ("*.js", "b/a.js", False), ("**/*.js", "b/c/a.js", True), ("**/*.js", "a.js", True), ("src/**", "src/a/b", True), ("a?.ts", "ab.ts", True), ("a?.ts", "a/.ts", False), ("*.{js,ts}", "a.ts", True), ("a.b", "axb", False)],
)
def test_globs(pattern, path, hit):
    assert bool(re.search(globs.glob_regex(pattern), path)) is hit


@pytest.mark.parametrize(
    ("lines", "path", "hit"),
    [(["*.log"], "a/b.log", True), (["/b.log"], "a/b.log", False), (["build/"], "build/x", True), (["build/"], "build", False), (["*.log", "!keep.log"], "a/keep.log", False), (["!keep.log", "*.log"], "keep.log", True), (["# note", ""], "# note", False), (["a/b"], "x/a/b", False), (["node_modules"], "x/node_modules/y", True)],
)
def test_ignore_lines(spark, lines, path, hit):
    one = spark.createDataFrame([(path,)], "path string")
    assert one.select(globs.ignored(F.col("path"), lines)).first()[0] is hit


def test_read_files(spark, tmp_path):
    for name, text in {"a.js": "﻿var a", "sub/b.ts": "let b", "sub/c.txt": "no", "node_modules/d.js": "var d", "big.js": "x" * 100}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    found = files.read_files(spark, str(tmp_path), ignore=["node_modules/"], max_bytes=50).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["language"], r["source"]) for r in found) == [("a.js", "js", "var a"), ("b.ts", "ts", "let b")]
    assert files.read_list(spark, [str(tmp_path / "a.js")]).first()["source"] == "var a"


def test_page_scripts(spark):
    pages = spark.createDataFrame([(1, '<script>var t="</p>";</script><SCRIPT type="x">b</SCRIPT>'), (2, None), (3, "none")], "page_id long, html string")
    assert [(r["path"], r["source"]) for r in files.page_scripts(pages).orderBy("path").collect()] == [("page/1/0.js", 'var t="</p>";'), ("page/1/1.js", "b")]


def test_modules_and_imports(spark):
    known = spark.createDataFrame([("src/a.ts",), ("src/lib/index.ts",), ("src/b.d.ts",), ("top.ts",)], "path string")
    wanted = spark.createDataFrame([("src/a.ts", "./lib"), ("src/a.ts", "./b"), ("src/lib/index.ts", "../a"), ("src/a.ts", "../top"), ("src/a.ts", "./none"), ("src/a.ts", "npm")], "path string, module string")
    found = {(r["path"], r["module"]): r["target"] for r in files.resolve_imports(wanted, known).collect()}
    assert found == {("src/a.ts", "./lib"): "src/lib/index.ts", ("src/a.ts", "./b"): "src/b.d.ts", ("src/lib/index.ts", "../a"): "src/a.ts", ("src/a.ts", "../top"): "top.ts", ("src/a.ts", "./none"): None}
    kinds = spark.createDataFrame([("a.mjs", ""), ("a.js", "import x from 'y'"), ("a.js", "import('x')"), ("a.js", None)], "path string, source string")
    assert [r[0] for r in kinds.select(files.is_module(F.col("path"), F.col("source"))).collect()] == [True, True, False, False]


def test_nearest_config(spark):
    paths = spark.createDataFrame([("a/b/c.js",), ("a/d.js",), ("e.js",)], "path string")
    configs = spark.createDataFrame([("a", "A"), ("a/b", "B")], "dir string, config string")
    assert {r["path"]: r["config"] for r in config.nearest_config(paths, configs).collect()} == {"a/b/c.js": "B", "a/d.js": "A", "e.js": None}


def test_flat_entries_merge_in_order(spark):
    paths = spark.createDataFrame([("a.js",), ("b.ts",)], "path string")
    entries = spark.createDataFrame([(2, "ts$", {"x": "2"}), (1, ".", {"x": "1", "y": "1"})], "ord int, regex string, rules map<string,string>")
    assert {r["path"]: r["rules"] for r in config.merge_flat(paths, entries).collect()} == {"a.js": {"x": "1", "y": "1"}, "b.ts": {"x": "2", "y": "1"}}


CHANGES = "uri string, version long, ts timestamp, text string, closed boolean"


def _at(ms):
    return dt.datetime(2026, 1, 1) + dt.timedelta(milliseconds=ms)


def test_debounce_and_latest(spark):
    changes = spark.createDataFrame([("a", 1, _at(0), "1", False), ("a", 2, _at(100), "2", False), ("a", 3, _at(900), "3", False), ("b", 1, _at(0), "x", False), ("b", 2, _at(50), None, True)], CHANGES)
    assert sorted((r["uri"], r["version"], r["closed"]) for r in editor.settled(changes).collect()) == [("a", 2, False), ("a", 3, False), ("b", 2, True)]
    assert [(r["uri"], r["text"]) for r in editor.latest(changes).collect()] == [("a", "3")]
    found = editor.lint_batch(changes.withColumn("text", F.lit("debugger")), {"preset": False, "rules": {"no-debugger": 2}}).collect()
    assert [(r["path"], r["version"]) for r in found] == [("a", 3)]


def test_stream_ends_like_a_batch(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("a.js", 1, _at(0), "debugger", False), ("a.js", 2, _at(60_000), "var x", False), ("z.js", 1, _at(200_000), "", False)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], CHANGES).coalesce(1).write.mode("append").parquet(str(source))
    seen = []
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = editor.start(stream, lambda df, _: seen.extend((r["path"], r["version"], r["rule"]) for r in df.collect()), str(tmp_path / "state"), {"preset": False, "rules": {"no-debugger": 2, "no-var": 2}}, availableNow=True)
    query.awaitTermination(240)
    assert {("a.js", 1, "no-debugger"), ("a.js", 2, "no-var")} <= set(seen)


def test_registry():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert "rule_no_var" in names


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["path", "rule", "line", "col", "message"] and found.count() > 0
