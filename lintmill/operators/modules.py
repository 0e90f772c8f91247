"""What files import and export, and imports joined to the export they mean.

One hop, as a file's own declarations say it: names passed on by ``export ... from`` are exports of the file
that passes them on, and are not followed further. A file that imports itself gets no target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintmill.plans.parsed import Tables, keep
from lintmill.sources.files import resolve_imports


def _name(attrs: Column, slot: str) -> Column:
    """An identifier or, where a string stands for it, that string."""
    return F.coalesce(attrs[f"{slot}.name"], attrs[f"{slot}.value"])


def _specifiers(nodes: DataFrame, parents: list[str]) -> DataFrame:
    own = nodes.where(F.col("slot") == "specifiers").select(F.col("path").alias("in"), F.col("parent_id").alias("of"), F.col("type").alias("specifier"), F.col("attrs").alias("own"), F.col("start").alias("at"))
    return nodes.where(F.col("type").isin(parents)).join(own, (F.col("path") == F.col("in")) & (F.col("node_id") == F.col("of")), "left")


def imports(nodes: DataFrame) -> DataFrame:
    """path, module, imported (``default``, ``*`` for all, null for none), local, type_only, start."""
    kind = F.when(F.col("specifier") == "ImportDefaultSpecifier", F.lit("default")).when(F.col("specifier") == "ImportNamespaceSpecifier", F.lit("*"))
    local = F.col("own")["local.name"]
    type_only = (F.coalesce(F.col("attrs")["importKind"], F.lit("")) == "type") | (F.coalesce(F.col("own")["importKind"], F.lit("")) == "type")
    imported = F.coalesce(kind, _name(F.col("own"), "imported"), local)
    return _specifiers(nodes, ["ImportDeclaration"]).select("path", F.col("attrs")["source.value"].alias("module"), imported.alias("imported"), local.alias("local"), type_only.alias("type_only"), F.coalesce("at", "start").alias("start"))


def exports(tables: Tables) -> DataFrame:
    """path, name (``*`` for all of ``module``), local, kind of the declaration, module that it is passed on from, start."""
    nodes, attrs = tables.nodes, F.col("attrs")
    named = _specifiers(nodes, ["ExportNamedDeclaration"]).where("specifier is not null")
    exported = F.coalesce(_name(F.col("own"), "exported"), _name(F.col("own"), "local"))
    lists = named.select("path", exported.alias("name"), _name(F.col("own"), "local").alias("local"), F.lit(None).cast("string").alias("kind"), attrs["source.value"].alias("module"), F.col("at").alias("start"))
    whole = nodes.where("type = 'ExportAllDeclaration'").select("path", F.coalesce(_name(attrs, "exported"), F.lit("*")).alias("name"), F.lit(None).cast("string").alias("local"), F.lit(None).cast("string").alias("kind"), attrs["source.value"].alias("module"), "start")
    default = nodes.where("type = 'ExportDefaultDeclaration'").select("path", F.lit("default").alias("name"), F.coalesce(attrs["declaration.id.name"], attrs["declaration.name"]).alias("local"), attrs["declaration.type"].alias("kind"), F.lit(None).cast("string").alias("module"), "start")

    # names that a declaration after ``export`` binds: outermost symbols that start before the last such declaration ends
    top = tables.scopes.where("kind in ('global', 'module')").select("path", "scope_id")
    symbols = tables.symbols.join(top, ["path", "scope_id"]).select("path", "start", F.col("name"), "kind", F.lit(None).cast("int").alias("reach"))
    spans = nodes.where((F.col("type") == "ExportNamedDeclaration") & attrs["declaration.type"].isNotNull()).select("path", "start", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), F.col("end").alias("reach"))
    before = Window.partitionBy("path").orderBy("start", F.col("name").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = symbols.unionByName(spans).withColumn("until", F.last("reach", ignorenulls=True).over(before)).where("name is not null and start < until")
    declared = inside.select("path", "name", F.col("name").alias("local"), "kind", F.lit(None).cast("string").alias("module"), "start")
    return lists.unionByName(whole).unionByName(default).unionByName(declared)


def join_imports(tables: Tables, packages: DataFrame | None = None) -> DataFrame:
    """Per import: path, module, imported, local, target file (null if there is none), found, kind and module of the export it means.

    ``found`` is null without a target; importing all or nothing finds what it asks for. ``packages`` as in ``resolve_imports``.
    """
    tables = Tables(keep(tables.parsed), tables.globals)  # read for imports, exports and paths, parsed once
    wanted = imports(tables.nodes)
    targets = resolve_imports(wanted.select("path", "module").distinct(), tables.files, packages).where(~F.col("path").eqNullSafe(F.col("target")))
    told = exports(tables).where("name <> '*'").groupBy(F.col("path").alias("target"), F.col("name").alias("imported")).agg(F.min_by(F.struct("kind", "module"), "start").alias("export"))
    joined = wanted.join(targets, ["path", "module"], "left").join(told, ["target", "imported"], "left")
    whole = F.coalesce(F.col("imported") == "*", F.lit(True))
    found = F.when(F.col("target").isNotNull(), whole | F.col("export").isNotNull())
    return joined.select("path", "module", "imported", "local", "target", found.alias("found"), F.col("export.kind").alias("kind"), F.col("export.module").alias("passed_on_from"))
