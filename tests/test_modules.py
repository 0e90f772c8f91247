"""Imports, exports, resolution of modules and the join of both."""

from lintmill.operators.modules import exports, imports, join_imports
from lintmill.plans.parsed import parse_files
from lintmill.sources import files
from pyspark.sql import functions as F

SOURCES = {
    "src/a.ts": "import d, { b as c, type T } from './lib'; import * as n from '../src/lib/'; import './none'; import { x } from 'pkg'; import s from '@s/t'; import me from './a'; import { gone } from './lib'; import fs from 'node:fs'; export default c",
    "src/lib/index.ts": "export const b = 1, { p, q: [r] } = o; export default function f() { var inner } export type T = string; export { u as v } from './w'; export * from './z'; var hidden; export class C {}; let late; export { late as 'a b' }",
    "node_modules/pkg/types/main.d.ts": "export declare const x: number",
    "src/node_modules/@types/s__t/index.d.ts": "declare const s: any; export default s",
    "other.ts": "",
}


def test_fold_path(spark):
    rows = [("a/b/../../../c", "../c"), ("a/./b//c", "a/b/c"), ("/a/../../b", "/b"), ("file:///a/b/c/d/e/f/../../../../../g", "file:///a/g"), ("../../x", "../../x"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "path string, wanted string")
    assert [r[0] for r in df.select(files.fold_path(F.col("path"))).collect()] == [r[1] for r in rows]


def test_imports_and_exports(spark):
    t = parse_files(files.in_memory(spark, SOURCES))
    found = {(r["module"], r["imported"], r["local"], r["type_only"]) for r in imports(t.nodes).where("path = 'src/a.ts'").collect()}
    assert {("./lib", "default", "d", False), ("./lib", "b", "c", False), ("../src/lib/", "*", "n", False), ("./none", None, None, False)} <= found
    told = {(r["name"], r["local"], r["module"]) for r in exports(t).where("path = 'src/lib/index.ts'").collect()}
    assert told == {("b", "b", None), ("p", "p", None), ("r", "r", None), ("default", "f", None), ("T", "T", None), ("v", "u", "./w"), ("*", None, "./z"), ("C", "C", None), ("a b", "late", None)}


def test_join(spark):
    t = parse_files(files.in_memory(spark, SOURCES))
    packages = spark.createDataFrame([("node_modules/pkg/package.json", '{"types": "./types/main.d.ts"}'), ("src/node_modules/pkg/package.json", "no json"), ("src/node_modules/q/package.json", '{"typings": "gone.d.ts"}')], "path string, content string")
    rows = {(r["module"], r["imported"]): (r["target"], r["found"]) for r in join_imports(t, packages).where("path = 'src/a.ts'").collect()}
    lib = "src/lib/index.ts"
    assert rows == {
        ("./lib", "default"): (lib, True), ("./lib", "b"): (lib, True), ("./lib", "T"): (lib, True), ("./lib", "gone"): (lib, False),
        ("../src/lib/", "*"): (lib, True), ("./none", None): (None, None), ("./a", "default"): (None, None), ("node:fs", "default"): (None, None),
        ("pkg", "x"): ("node_modules/pkg/types/main.d.ts", True), ("@s/t", "default"): ("src/node_modules/@types/s__t/index.d.ts", True),
    }
    assert join_imports(parse_files(files.in_memory(spark, SOURCES).limit(0)), packages).count() == 0


def test_read_paths(spark, tmp_path):
    for name in ("b.js", "sub/a.ts", "sub/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = files.read_paths(spark, [str(tmp_path / "b.js"), str(tmp_path / "sub")]).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in rows] == ["b.js", "a.ts"]
    assert files.read_paths(spark, []).count() == 0
