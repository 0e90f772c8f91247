"""What parsing costs: partitions, equal texts, rows that leave a task, and joins of what a parse gives."""

import pyarrow as pa
from lintmill.operators import lint as engine
from lintmill.operators import places
from lintmill.operators.lint import lint, node_types
from lintmill.plans import parsed
from lintmill.plans.parsed import parse_files, parse_source
from lintmill.sources.files import in_memory
from pyspark.sql import functions as F


def _scripts(spark, n, source):
    return spark.range(0, n, 1, 1).select(F.format_string("%d.ts", "id").alias("path"), F.lit("ts").alias("language"), source.alias("source"))


def test_few_partitions_are_dealt_out(spark):
    t = parse_files(_scripts(spark, 20_000, F.lit("a")), ("nodes",))
    used = t.parsed.groupBy(F.spark_partition_id()).count().collect()
    assert len(used) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in used) == 20_000
    assert max(r["count"] for r in used) < 20_000 / 4


def test_equal_texts_are_parsed_once(monkeypatch):
    sources = ["var a", "let b", "var a", None, "var a", ""] * 40
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(240)], "language": ["ts"] * 240, "source": sources})
    seen = []
    monkeypatch.setattr(parsed, "parse_source", lambda *a: seen.append(a[0]) or parse_source(*a))
    rows = pa.Table.from_batches(parsed._parser(frozenset(("nodes", "tokens")))(iter([batch]))).to_pylist()
    assert len(seen) == 4
    assert sorted(r["path"] for r in rows) == sorted(map(str, range(240)))
    for r in rows:
        assert r["source"] == sources[int(r["path"])]
        assert [n["type"] for n in r["nodes"]] == [n["type"] for n in parse_source(r["source"] or "", "ts")["nodes"]]
    seen.clear()
    list(parsed._parser(frozenset(("errors",)), lambda f: iter(()))(iter([batch])))
    assert len(seen) == 240  # what is inspected can depend on the path


def test_only_nodes_that_rules_read(spark):
    source = "a.b.c.d === a.b.c.e; var x; f(y === y)"
    assert node_types(["no-self-compare"]) == {"BinaryExpression"} and node_types(["no-var", "no-undef"]) is None
    whole = [n for n in parse_source(source, "ts")["nodes"] if n["type"] == "BinaryExpression"]
    assert parse_source(source, "ts", frozenset(("nodes",)), None, "", frozenset(("BinaryExpression",)))["nodes"] == whole
    assert [r["col"] for r in lint(in_memory(spark, {"a.ts": source}), {"preset": False, "rules": {"no-self-compare": 2}}).collect()] == [30]


def test_budget_on_equal_scripts(spark):
    """RUN-08 on many files of few texts in one partition."""
    found = lint(_scripts(spark, 3000, F.repeat(F.lit("var a;\n"), (F.col("id") % 7).cast("int"))), {"preset": False, "rules": {"no-var": 2}}, budget=3)
    counts = {r["path"]: r["count"] for r in found.groupBy("path").count().collect()}
    assert counts == {f"{i}.ts": min(i % 7, 3) for i in range(3000) if i % 7}


_MIXED = {"preset": False, "rules": {"no-var": 2, "no-undef": 1, "no-wrapper-object-types": 2}}


def _mixed(spark):
    texts = ["var a; var b; var c; var d", "/* eslint-disable no-var */ var a; b", "var a // eslint-disable-line\nvar b", "let x: String; y", "var (", "", "var a;\n" * 300]
    source = F.when(F.col("id") % 8 < 7, F.get(F.array(*map(F.lit, texts)), (F.col("id") % 8).cast("int")))
    return _scripts(spark, 900, source).withColumn("language", F.when(F.crc32(F.col("path").cast("binary")) % 2 == 0, "ts").otherwise("js"))


def test_equal_texts_are_diagnosed_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(engine, "keep", lambda df: kept.append(parsed.keep(df)) or kept[-1])
    for budget in (0, 2, 200):
        levels = engine.severities(_MIXED)
        alone = engine.diagnose(engine.Tables(parsed.keep(parse_files(_mixed(spark), engine.needed(list(levels)), types=node_types(list(levels))).parsed)), levels, budget=budget)
        found = lint(_mixed(spark), _MIXED, budget=budget)
        assert found.columns == alone.columns
        assert sorted(found.collect(), key=str) == sorted(alone.collect(), key=str)
        assert kept.pop().count() < 900 / 2 < found.select("path").distinct().count()


def test_budget_of_a_path_with_several_texts(spark):
    files = _scripts(spark, 600, F.concat(F.lit("var a;"), F.repeat(F.lit("\nvar a;"), (F.col("id") % 5).cast("int")))).withColumn("path", F.format_string("%d.ts", F.floor(F.regexp_extract("path", r"\d+", 0).cast("int") / 2)))
    config = {"preset": False, "rules": {"no-var": 2}}
    counts = {r["path"]: r["count"] for r in lint(files, config, budget=3).groupBy("path").count().collect()}
    assert counts == {f"{i}.ts": min(3, sum(1 + n % 5 for n in (2 * i, 2 * i + 1))) for i in range(300)}
    assert lint(files, config, budget=0).count() == sum(1 + n % 5 for n in range(600))


def test_groups_are_bounded(monkeypatch):
    monkeypatch.setattr(parsed, "LOT_BYTES", 2000)
    batch = pa.RecordBatch.from_pydict({"path": [None, *map(str, range(1, 500))], "language": ["ts", "js"] * 250, "source": ["var a", "var a", "let b", "var a", ""] * 100})
    rows = pa.Table.from_batches(parsed._grouper(frozenset(("nodes",)))(batch.slice(i, 100) for i in range(0, 500, 100))).to_pylist()
    assert len({r["path"] for r in rows}) == len(rows) == 30 and max(len(r["paths"]) for r in rows) == 30
    files = sorted(((p or "0", r["language"], r["source"]) for r in rows for p in r["paths"]), key=lambda x: int(x[0]))
    assert files == [(str(i), language, source) for i, (language, source) in enumerate(zip(batch["language"].to_pylist(), batch["source"].to_pylist(), strict=True))]
    for r in rows:
        assert [n["type"] for n in r["nodes"]] == [n["type"] for n in parse_source(r["source"], r["language"])["nodes"]]


def test_comments_are_not_broadcast(spark):
    source = "() => { /* a */ { () => { /* b */ } } } /* c */"
    files = _scripts(spark, 300, F.lit(source))
    t = parse_files(files, ("nodes", "comments"))
    joined = places.comments_inside(t.nodes.where("type = 'ArrowFunctionExpression'"), t.comments)
    inside = places.comments_inside_files(t, ["ArrowFunctionExpression"])
    key = lambda r: (r["path"], r["node_id"], r["text"], r["start"])
    assert sorted(map(key, joined.collect())) == sorted(map(key, inside.collect()))
    assert inside.count() == 3 * 300
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
