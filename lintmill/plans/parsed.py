"""From sources to relations: each file is parsed once, in one Arrow pass, and every relation is an explode of the result.

``parse_files`` keeps one row a file with an array of structs for each relation; what a plan does not use
is pruned from the explodes. Few large partitions are dealt out first, for parsing costs far more than reading. Equal
texts that meet in a task are parsed once; those of all tasks can be by ``dedupe=True``, which moves hashes and not texts.
``grouped=True`` gives equal texts of a task as one row with all their paths, so what follows costs by text and not by file.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.functions.parser import parse
from lintmill.functions.relations import Rows
from lintmill.functions.tree import File

_POSITION = "start:int,end:int,line:int,col:int"
TOKEN = f"kind:string,text:string,{_POSITION},nl_before:boolean"
COMMENT = f"kind:string,text:string,{_POSITION},end_line:int"
NODE = "node_id:int,parent_id:int,type:string,parent_type:string,slot:string,ord:int,depth:int,start:int,end:int,line:int,col:int,end_line:int,end_col:int,post:int,last_id:int,attrs:map<string,string>"
SCOPE = "scope_id:int,parent_scope:int,kind:string,node_id:int,depth:int"
SYMBOL = f"symbol_id:int,scope_id:int,name:string,kind:string,node_id:int,{_POSITION},has_init:boolean"
REF = f"ref_id:int,name:string,node_id:int,scope_id:int,symbol_id:int,is_read:boolean,is_write:boolean,is_init:boolean,{_POSITION}"
ERROR = "message:string,line:int,col:int"
FOUND = "rule:string,start:int,end:int,line:int,col:int,attrs:map<string,string>"
RELATIONS = {"tokens": TOKEN, "comments": COMMENT, "nodes": NODE, "scopes": SCOPE, "symbols": SYMBOL, "refs": REF, "errors": ERROR}
COLUMNS = RELATIONS | {"found": FOUND}
SCHEMA = "path string, language string, source string, " + ", ".join(f"{k} array<struct<{v}>>" for k, v in COLUMNS.items())
#: What looks at a file where it is parsed: findings as (rule, start, end, data).
Inspect = Callable[[File], Iterator[tuple[str, int, int, dict]]]


def _arrow(kind: str) -> pa.DataType:
    plain = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    fields, depth, part = [], 0, ""
    for c in kind + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, t = part.partition(":")
            fields.append((name, plain[t]))
            part = ""
        else:
            part += c
    return pa.list_(pa.struct(fields))


_ARROW = {k: _arrow(v) for k, v in COLUMNS.items()}


def parse_source(source: str, language: str, need: frozenset[str] = frozenset(RELATIONS), inspect: Inspect | None = None, path: str = "", types: frozenset[str] | None = None) -> dict[str, list[dict]]:
    """All relations of one source as lists of dicts; bad input gives a row in ``errors`` and what came before it. ``types`` are those of the nodes to give, None for all."""
    source = source.removeprefix("﻿")
    parsed = parse(source, language)
    rows = Rows(source, parsed, attributes="nodes" in need, types=types, scopes=bool(need & {"scopes", "symbols", "refs"})) if need - {"errors", "comments"} else None
    out: dict[str, list[dict]] = {k: [] for k in COLUMNS}
    starts = parsed.starts

    def place(offset: int) -> tuple[int, int]:
        line = bisect_right(starts, offset)
        return line, offset - starts[line - 1]

    if inspect is not None:
        for rule, start, end, data in inspect(File(path, source, language, parsed)):
            line, col = place(start)
            out["found"].append({"rule": rule, "start": start, "end": end, "line": line, "col": col, "attrs": list(data.items())})
    if "tokens" in need:
        for t in parsed.tokens:
            line, col = place(t.start)
            out["tokens"].append({"kind": t.kind, "text": t.text, "start": t.start, "end": t.end, "line": line, "col": col, "nl_before": t.after_newline})
    if "comments" in need:
        for c in parsed.comments:
            line, col = place(c.start)
            out["comments"].append({"kind": c.kind, "text": c.text, "start": c.start, "end": c.end, "line": line, "col": col, "end_line": place(c.end)[0]})
    if "nodes" in need:
        out["nodes"] = rows.nodes if types is None else [n for n in rows.nodes if n["type"] in types]
        for n in out["nodes"]:
            n["attrs"] = list(n["attrs"].items())
    for name in ("scopes", "symbols", "refs"):
        if name in need:
            out[name] = getattr(rows, name)
    if parsed.error is not None:
        line, col = place(min(parsed.error.at, len(source)))
        out["errors"].append({"message": parsed.error.message, "line": line, "col": col})
    return out


#: Rows and bytes of source among which a task looks for equal texts, texts that it parses before it hands rows on, and bytes that it hands on at once.
LOT, LOT_BYTES, AT_ONCE, OUT_BYTES = 2048, 4 << 20, 64, 4 << 20


def _lots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column("source")).to_pylist()):
        if i > start and (i - start == LOT or size + (n or 0) > LOT_BYTES):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _parser(need: frozenset[str], inspect: Inspect | None = None, types: frozenset[str] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in (x for batch in batches for x in _lots(batch)):
            same: dict[tuple, list[int]] = {}  # what is inspected can depend on the path
            for i, key in enumerate(zip(*(lot.column(c).to_pylist() for c in ("source", "language", "path")), strict=True)):
                same.setdefault(key if inspect else key[:2], []).append(i)
            texts = list(same)
            for start in range(0, len(texts), AT_ONCE):
                part = texts[start : start + AT_ONCE]
                parsed = [parse_source(key[0] or "", key[1] or "js", need, inspect, key[2] if inspect else "", types) for key in part]
                columns = [pa.array([p[k] for p in parsed], _ARROW[k]) for k in COLUMNS]
                rows = [i for key in part for i in same[key]]
                of = [k for k, key in enumerate(part) for _ in same[key]]
                step = max(AT_ONCE, OUT_BYTES * len(part) // max(1, sum(c.nbytes for c in columns)))
                for at in range(0, len(rows), step):
                    files, which = lot.take(pa.array(rows[at : at + step])), pa.array(of[at : at + step])
                    yield pa.RecordBatch.from_arrays([files.column(c) for c in ("path", "language", "source")] + [c.take(which) for c in columns], ["path", "language", "source", *COLUMNS])

    return run


#: Bytes that a path counts for in a lot besides its own.
PATH_BYTES = 64


def _grouper(need: frozenset[str], types: frozenset[str] | None = None):
    """Like ``_parser``, with one row a text of a lot: ``path`` is a key made up for it, ``paths`` are its files. A lot ends with the batch by which its texts and paths pass LOT_BYTES, which bounds a group too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, given = context.partitionId() if context else 0, 0

        def rows(same: dict[tuple, list[pa.Array]]) -> Iterator[pa.RecordBatch]:
            nonlocal given
            texts = list(same)
            for start in range(0, len(texts), AT_ONCE):
                part = texts[start : start + AT_ONCE]
                parsed = [parse_source(source or "", language or "js", need, None, "", types) for source, language in part]
                paths = [pa.concat_arrays(same[key]) for key in part]
                own = [pa.array(column, pa.string()) for column in ([f"{task}:{given + i}" for i in range(len(part))], [key[1] for key in part], [key[0] for key in part])]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, paths)]), pa.int32()), pa.concat_arrays(paths))
                yield pa.RecordBatch.from_arrays([*own, *[pa.array([p[k] for p in parsed], _ARROW[k]) for k in COLUMNS], lists], ["path", "language", "source", *COLUMNS, "paths"])
                given += len(part)

        same: dict[tuple, list[pa.Array]] = {}
        size = 0
        for lot in (x for batch in batches for x in (_lots(batch) if batch.nbytes > LOT_BYTES else [batch])):
            groups = pa.Table.from_batches([lot]).group_by(["source", "language"], use_threads=False).aggregate([("path", "list")])
            for source, language, paths in zip(groups.column("source").to_pylist(), groups.column("language").to_pylist(), groups.column("path_list"), strict=True):
                if (source, language) not in same:
                    same[source, language] = []
                    size += len(source or "")
                same[source, language].append(paths.values)
            size += (pc.sum(pc.binary_length(lot.column("path"))).as_py() or 0) + PATH_BYTES * lot.num_rows
            if size > LOT_BYTES:
                yield from rows(same)
                same, size = {}, 0
        yield from rows(same)

    return run


def _spread(files: DataFrame) -> DataFrame:
    """``files`` in as many partitions as there are cores, several times over, where they come in fewer than cores."""
    spark, plan = files.sparkSession, files._jdf.queryExecution()
    cores = spark.sparkContext.defaultParallelism
    if files.isStreaming or "Exchange" in plan.executedPlan().toString() or int(str(plan.optimizedPlan().stats().sizeInBytes())) < 1 << 14:
        return files
    return files.repartition(4 * cores, "path") if plan.toRdd().getNumPartitions() < cores else files


@dataclass
class Tables:
    """The relations of a set of files; each is ``path`` with its columns."""

    parsed: DataFrame
    globals: list[str] | None = None  # names no-undef knows; None for the built-in ones

    def _relation(self, name: str) -> DataFrame:
        return self.parsed.select("path", F.explode(name).alias("r")).select("path", "r.*")

    @cached_property
    def nodes(self) -> DataFrame:
        return self._relation("nodes")

    @cached_property
    def tokens(self) -> DataFrame:
        return self._relation("tokens")

    @cached_property
    def comments(self) -> DataFrame:
        return self._relation("comments")

    @cached_property
    def scopes(self) -> DataFrame:
        return self._relation("scopes")

    @cached_property
    def symbols(self) -> DataFrame:
        return self._relation("symbols")

    @cached_property
    def refs(self) -> DataFrame:
        return self._relation("refs")

    @cached_property
    def errors(self) -> DataFrame:
        return self._relation("errors")

    @cached_property
    def found(self) -> DataFrame:
        """What the rules that ran with the parser found."""
        return self._relation("found")

    @cached_property
    def files(self) -> DataFrame:
        return self.parsed.select("path", "language", "source")


def parse_files(files: DataFrame, need: tuple[str, ...] = tuple(RELATIONS), dedupe: bool = False, inspect: Inspect | None = None, types: frozenset[str] | None = None, grouped: bool = False) -> Tables:
    """Relations of ``files(path, language, source)``.

    ``need`` names the relations to build; the others are empty. ``types`` are those of the nodes to give, None for all. With ``dedupe`` one file of each text
    is parsed and the others get its rows by a join on the content hash. With ``grouped`` equal texts of a task are one row, ``path`` is a key made up for it
    and the column ``paths`` of ``parsed`` has the files; nothing may be inspected then, for that can depend on the path.
    """
    wanted = files.select("path", F.coalesce("language", F.lit("js")).alias("language"), F.coalesce("source", F.lit("")).alias("source"))
    if grouped:
        if dedupe or inspect is not None:
            raise ValueError("grouped goes with neither dedupe nor inspect")
        return Tables(_spread(wanted).mapInArrow(_grouper(frozenset(need), types), f"{SCHEMA}, paths array<string>"))
    if not dedupe:
        return Tables(_spread(wanted).mapInArrow(_parser(frozenset(need), inspect, types), SCHEMA))
    hashed = wanted.withColumn("text_hash", F.sha2(F.concat_ws("\0", "language", "source"), 256))
    parsed = hashed.dropDuplicates(["text_hash"]).select(F.col("text_hash").alias("path"), "language", "source").mapInArrow(_parser(frozenset(need), inspect, types), SCHEMA)
    return Tables(hashed.select("path", "text_hash").join(parsed.withColumnRenamed("path", "text_hash"), "text_hash").drop("text_hash"))


def keep(df: DataFrame) -> DataFrame:
    """``df`` computed once for several uses: as Parquet below the shared checkpoint folder where one is set, else cached."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        return df.persist()
    path = f"{folder}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
