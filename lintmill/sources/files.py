"""Readers of source files; each gives (path, language, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.functions.globs import ignored, included

# File endings by language, and suffixes by which imports are resolved, in order.
ENDINGS = {"js": ("js", "mjs", "cjs"), "jsx": ("jsx",), "ts": ("ts", "mts", "cts"), "tsx": ("tsx",)}
IMPORT_SUFFIXES = ("", ".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx", ".js", "/index.js")
PACKAGE_SUFFIXES = ("/package.json", ".d.ts", "/index.d.ts", ".ts", "/index.ts", "/index.tsx")
SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script\s*>"


def language_of(path: Column) -> Column:
    """js, jsx, ts or tsx by the ending; null for others."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for language, endings in ENDINGS.items():
        out = F.when(ending.isin(*endings), F.lit(language)).otherwise(out)
    return out


def is_module(path: Column, source: Column) -> Column:
    """By the ending, or by an import or export at the beginning of a line."""
    return path.rlike(r"\.(?:mjs|mts)$|\.module\.[jt]sx?$") | F.coalesce(source.rlike(r"(?m)^\s*(?:import\b[^(.]|export\b)"), F.lit(False))


def read_files(spark: SparkSession, roots: str | list[str], *, include: list[str] = (), exclude: list[str] = (), ignore: list[str] = (), max_bytes: int = 10 << 20) -> DataFrame:
    """All script files below the roots, filtered before their content is read. Null bytes and a byte order mark are dropped.

    Larger files than ``max_bytes`` are left out, as linters do; ``max_bytes=0`` reads all.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    wanted = raw.withColumn("language", language_of(F.col("path"))).where(F.col("language").isNotNull())
    if max_bytes:
        wanted = wanted.where(F.col("length") <= max_bytes)
    if include or exclude:
        wanted = wanted.where(included(F.col("path"), list(include), list(exclude)))
    if ignore:
        wanted = wanted.where(~ignored(F.regexp_replace("path", r"^\w+:/*", ""), list(ignore)))
    return wanted.select("path", "language", strip_bom(F.col("content").cast("string")).alias("source"))


def read_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Named files, without a walk over folders."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select("path", F.coalesce(language_of(F.col("path")), F.lit("js")).alias("language"), strip_bom(F.col("content").cast("string")).alias("source"))


def in_memory(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(list(sources.items()), "path string, source string")
    return rows.select("path", F.coalesce(language_of(F.col("path")), F.lit("js")).alias("language"), strip_bom(F.col("source")).alias("source"))


def strip_bom(source: Column) -> Column:
    return F.regexp_replace(source, "^﻿", "")


def page_scripts(pages: DataFrame) -> DataFrame:
    """Inline scripts of ``pages(page_id, html)``: path ``page/<id>/<n>.js``, with page_id."""
    scripts = pages.select("page_id", F.posexplode(F.expr(f"regexp_extract_all(html, r'{SCRIPT}', 1)")).alias("n", "source"))
    return scripts.select(F.format_string("page/%d/%d.js", "page_id", "n").alias("path"), F.lit("js").alias("language"), "source", "page_id")


def fold_path(path: Column) -> Column:
    """``path`` without ``.`` and ``..`` segments, to any depth; a scheme and a leading slash stay."""
    head = F.regexp_extract(path, r"^(?:\w+:/*|/+)?", 0)
    steps = F.filter(F.split(F.substring(path, F.length(head) + 1, F.length(path)), "/"), lambda s: ~s.isin("", "."))

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = (s == "..") & F.coalesce(last != "..", F.lit(False))
        lost = (s == "..") & last.isNull() & (head != "")  # above the root
        return F.when(up, F.slice(done, 1, F.size(done) - 1)).when(lost, done).otherwise(F.concat(done, F.array(s)))

    return F.concat(head, F.array_join(F.aggregate(steps, F.expr("cast(array() as array<string>)"), step), "/"))


def package_types(packages: DataFrame) -> DataFrame:
    """(path, types): the declaration file that each ``packages(path, content)``, a package.json, names."""
    field = F.coalesce(*[F.nullif(F.get_json_object("content", f"$.{k}"), F.lit("")) for k in ("types", "typings")])
    return packages.select("path", fold_path(F.concat(F.regexp_replace("path", r"[^/]*$", ""), field)).alias("types")).where(F.col("types").isNotNull())


def resolve_imports(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(path, module, target): relative imports joined to the first file that exists among their candidates, null if none.

    With ``packages(path, content)``, the package.json files (it may be empty), names of packages are looked for too: in ``node_modules`` of the
    file's folder and each one above, the package before its ``@types``, what its package.json names before its usual entries.
    """
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    base = fold_path(F.concat(F.regexp_replace("path", r"[^/]*$", ""), F.col("module")))
    near = F.transform(F.array(*map(F.lit, IMPORT_SUFFIXES)), lambda s: F.concat("base", s))
    relative = F.col("module").rlike(r"^\.{1,2}(?:/|$)")
    known = files.select(F.col("path").alias("candidate"), F.col("path").alias("file"))
    if packages is None:
        wanted, tries = imports.where(relative), near
    else:
        flat = F.regexp_replace(F.regexp_replace("module", "^@([^/]+)/", "$1__"), "^@", "")
        steps = F.split(folder, "/")
        above = F.transform(F.sequence(F.size(steps), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
        homes = F.transform(F.array_distinct(above), lambda a: F.concat(a, F.when((a == "") & ~F.startswith("path", F.lit("/")), F.lit("")).otherwise(F.lit("/")), F.lit("node_modules/")))
        places = F.flatten(F.transform(homes, lambda h: F.array(F.concat(h, F.col("module")), F.concat(h, F.lit("@types/"), flat))))
        far = F.flatten(F.transform(places, lambda at: F.array(*[F.concat(at, F.lit(s)) for s in PACKAGE_SUFFIXES])))
        wanted = imports.where(relative | ~F.col("module").rlike("^(?:$|/|node:)"))
        tries = F.when(relative, near).otherwise(far)
        entries = package_types(packages).withColumnRenamed("path", "candidate")
        known = known.unionByName(entries.join(known.select("file"), F.col("types") == F.col("file"), "left_semi").withColumnRenamed("types", "file"))
    asked = wanted.withColumn("base", base).select("path", "module", F.posexplode(tries).alias("rank", "candidate"))
    hits = asked.join(known, "candidate", "left")
    return hits.groupBy("path", "module").agg(F.min_by("file", F.when(F.col("file").isNotNull(), F.col("rank"))).alias("target"))


def read_paths(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Files and folders as they are given: a path with a script's ending is a file, another one a folder to walk; rows in order of path."""
    ends = tuple(f".{e}" for group in ENDINGS.values() for e in group)
    single, roots = [p for p in paths if p.lower().endswith(ends)], [p for p in paths if not p.lower().endswith(ends)]
    parts = ([read_list(spark, single)] if single else []) + ([read_files(spark, roots, **options)] if roots else [])
    if not parts:
        return spark.createDataFrame([], "path string, language string, source string")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).dropDuplicates(["path"])
    return out.orderBy("path")
