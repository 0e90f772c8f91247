"""Suffix-array deduplication: bytes covered by a long string that also starts anywhere else.

A string of ``LENGTH`` bytes that starts at two places has the same smallest hash of its inner
``GRAM``-byte strings at both. Each text is therefore cut into pieces: runs of start places whose
strings share that smallest hash, the key. Places in pieces with different keys never start equal strings.

1. Pieces are keyed by (key, digest of their bytes). A piece seen twice is repeated as a whole; copies
   meet within a task first, so they reach the shuffle once a task.
2. Where different pieces share a key, or a piece holds its key twice, their bytes are cut out of
   the text and go through an enhanced suffix array, whose maximal repeats give all other repeated strings.
   A key with more than ``hot`` pieces is taken apart: every start place goes by the digest of its
   own string, so no group has to fit one task.
3. Spans of a text are merged and removed.

Texts are named by 128 bits of content hash, so copies are worked on once. Texts travel
compressed, and twice. Null and empty texts, and those shorter than ``LENGTH``, lose nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import pieces as slices
from lintmill.llm.common import shared_path, utf8
from lintmill.llm.suffixes import maximal_repeats

LENGTH, GRAM, RUN = 200, 90, 128
#: Bytes of text hashed at once, pieces a task holds before it combines them, bytes in one suffix array.
CHUNK, HOLD, BLOCK = 2 << 20, 300_000, 500_000
_MUL = 0x9E3779B97F4A7C15
_SELF, _MANY, _DIRECT = 1, 2, 4
_SPAN, _CONTEXT, _HOT = 0, 1, 2

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 18))
        up, down = np.full(size, _MUL, dtype=np.uint64), np.full(size, pow(_MUL, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours, by doubling."""
    step = 1
    while 2 * step <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def cut_pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first start place, start places, key, holds its key twice) of all pieces."""
    empty = np.zeros(0, dtype=np.int64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    n, window = int(lengths.sum()), LENGTH - GRAM + 1
    if n < LENGTH:
        return empty, empty, empty, empty, empty.astype(bool)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * up[: n - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = _slide(h, window, np.minimum)
    owner = np.repeat(np.arange(len(texts)), lengths)
    offsets = np.cumsum(lengths) - lengths
    inside = owner[: n - LENGTH + 1] == owner[LENGTH - 1 :]
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1])
    begin = np.nonzero(new)[0]
    end = np.append(begin[1:], len(least))
    begin, end = begin[inside[begin]], end[inside[begin]]
    parts = (end - begin + RUN - 1) // RUN  # only repetitive text has longer runs
    which = np.repeat(np.arange(len(begin)), parts)
    start = begin[which] + RUN * (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts))
    stop = np.minimum(start + RUN, end[which])
    key = least[start]
    # a gram is smallest somewhere if the greatest of the minima over it equals it
    padded = np.concatenate((np.zeros(window - 1, dtype=np.uint64), least, np.zeros(window - 1, dtype=np.uint64)))
    smallest = np.nonzero(_slide(padded, window, np.maximum)[: len(h)] == h)[0]
    low, high = np.searchsorted(smallest, start), np.searchsorted(smallest, stop - 1 + window)
    times = np.zeros(len(start), dtype=np.int64)
    rows = np.arange(len(start))
    while len(rows):
        at = low[rows]
        rows = rows[at < high[rows]]
        times[rows] += h[smallest[low[rows]]] == key[rows]
        low[rows] += 1
        rows = rows[times[rows] < 2]
    text = owner[start]
    return text, start - offsets[text], stop - start, key, times > 1


def _all_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece of every text, named by the digest of its bytes."""
    for batch in batches:
        for part in slices(batch, "text", CHUNK):
            texts = utf8(part.column("text"))
            text, start, count, _, _ = cut_pieces(texts)
            names = [xxhash.xxh3_128_hexdigest(texts[t][a : a + c + LENGTH - 1]) for t, a, c in zip(text.tolist(), start.tolist(), count.tolist(), strict=True)]
            r1, r2 = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("r1", "r2"))
            columns = [pa.array(x, pa.int64()) for x in (r1, r2, start, count + LENGTH - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["name", "r1", "r2", "piece", "long"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for piece in slices(batch, "text", CHUNK):
            texts = utf8(piece.column("text"))
            text, start, count, key, twice = cut_pieces(texts)
            if not len(text):
                continue
            digest = xxhash.xxh3_64_intdigest
            digests = np.array([digest(texts[t][a : a + c + LENGTH - 1]) for t, a, c in zip(text.tolist(), start.tolist(), count.tolist(), strict=True)], dtype=np.uint64)
            r1, r2 = (piece.column(c).to_numpy(zero_copy_only=False)[text] for c in ("r1", "r2"))
            held.append((key, digests, r1, r2, (start << 16) | ((count - 1) << 8) | twice.astype(np.int64) * _SELF))
            size += len(text)
            if size > HOLD:
                yield from _combine(held)
                held, size = [], 0
    yield from _combine(held)


def _combine(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One row for each (key, digest) of this task; its other occurrences skip the meeting by key."""
    if not held:
        return
    key, digest, r1, r2, meta = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((meta, r2, r1, digest, key))
    key, digest, r1, r2, meta = key[order], digest[order], r1[order], r2[order], meta[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
    group = np.cumsum(first) - 1
    many = np.bincount(group)[group] > 1
    copy = np.zeros(len(key), dtype=bool)
    copy[1:] = ~first[1:] & (r1[1:] == r1[:-1]) & (r2[1:] == r2[:-1]) & (meta[1:] == meta[:-1])
    flagged = meta | np.where(many, np.where(first, _MANY, _DIRECT), 0)
    spread = np.where(first, key, (r1.view(np.uint64) ^ (meta.view(np.uint64) >> np.uint64(16))) * np.uint64(_MUL))
    keep = ~copy
    columns = [spread[keep].view(np.int64), digest[keep].view(np.int64), r1[keep], r2[keep], flagged[keep]]
    for at in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in columns], ["key", "digest", "r1", "r2", "meta"])


def _judged(kind: int, key: np.ndarray, r1: np.ndarray, r2: np.ndarray, meta: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(key), pa.array(r1), pa.array(r2), pa.array(meta)], ["kind", "key", "r1", "r2", "meta"])


def _judge(hot: int, pairs: bool = False):
    """For rows in order of key and digest: whole pieces that repeat, and pieces to compare; with ``pairs`` also those that only repeat themselves within."""

    def decide(key, digest, r1, r2, meta) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        new_key = np.ones(len(key), dtype=bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= digest[1:] != digest[:-1]
        group, kind = np.cumsum(new_key) - 1, np.cumsum(new) - 1
        repeated = (np.bincount(kind)[kind] > 1) | (np.bincount(kind, (meta & _MANY) > 0)[kind] > 0)
        differ = np.bincount(group, new)[group] > 1
        yield _judged(_SPAN, key[repeated], r1[repeated], r2[repeated], meta[repeated])
        compare = new & (differ | ((pairs | ~repeated) & ((meta & _SELF) > 0)))
        asks = np.where(repeated, 0, _SELF)
        yield _judged(_CONTEXT, key[compare], r1[compare], r2[compare], (meta[compare] & ~0xFF) | asks[compare])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        hot_key = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "digest", "r1", "r2", "meta")]
            direct = (cols[4] & _DIRECT) > 0
            yield _judged(_SPAN, *(cols[i][direct] for i in (0, 2, 3, 4)))
            cols = [c[~direct] for c in cols]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            while len(cols[0]):
                if hot_key is not None:  # the rest of a key that was too large to hold
                    same = cols[0] == hot_key
                    yield from _apart(*(c[same] for c in cols))
                    cols = [c[~same] for c in cols]
                    if len(cols[0]):
                        hot_key = None
                    continue
                last = int(np.searchsorted(cols[0], cols[0][-1]))
                yield from decide(*(c[:last] for c in cols))
                cols = [c[last:] for c in cols]
                if len(cols[0]) <= hot:
                    break
                hot_key = cols[0][0]
            carry = cols
        if carry is not None:
            yield from decide(*carry)

    return run


def _apart(key, digest, r1, r2, meta) -> Iterator[pa.RecordBatch]:
    many = (meta & _MANY) > 0
    yield _judged(_SPAN, key[many], r1[many], r2[many], meta[many])
    yield _judged(_HOT, key, r1, r2, meta)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a text come after it: cuts their bytes out of it. Hot rows give one row a start place."""
    name, text, packed = None, b"", False
    for batch in batches:
        out: list[tuple] = []
        z = batch.column("z")
        rows = zip(*(batch.column(c).to_pylist() for c in ("r1", "r2", "kind", "key", "meta")), strict=True)
        for i, (r1, r2, kind, key, meta) in enumerate(rows):
            if kind < 0:
                if name != (r1, r2):
                    name, text = (r1, r2), z[i].as_py()
                    packed = True
                continue
            if packed:
                text, packed = zlib.decompress(text), False
            start, count = meta >> 16, ((meta >> 8) & 0xFF) + 1
            if kind == _CONTEXT:
                out.append((kind, key, r1, r2, meta, text[start : start + count + LENGTH - 1]))
            else:
                for a in range(start, start + count):
                    d = hashlib.blake2b(text[a : a + LENGTH], digest_size=16).digest()
                    out.append((kind, int.from_bytes(d[:8], "little", signed=True), r1, r2, (a << 16) | (a - start), d))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["kind", "key", "r1", "r2", "meta", "data"])


def _spans(r1: np.ndarray, r2: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)) for x in (r1, r2, start, size)], ["r1", "r2", "start", "size"])


def _array_spans(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Spans of the asking pieces among ``rows`` (r1, r2, meta, data) that maximal repeats cover."""
    if not rows:
        return
    order, groups, owner, offsets = maximal_repeats([r[3] for r in rows], LENGTH)
    if not groups:
        return
    cover = np.zeros(len(order), dtype=np.int64)
    for length, first, last in sorted(groups):  # inner intervals are longer and come later
        cover[first : last + 1] = length
    r1, r2, meta = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
    row = owner[order]
    take = (cover > 0) & ((meta[row] & _SELF) > 0)
    # one row for each run of a piece, not one for each start place
    at = np.argsort(order[take])
    row, start, size = row[take][at], order[take][at], cover[take][at]
    reach = np.maximum.accumulate(start + size)  # pieces lie one after another, so this never reaches into the next
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    last = np.append(np.nonzero(new)[0][1:] - 1, len(row) - 1)
    row, start = row[new], start[new]
    yield _spans(r1[row], r2[row], (meta[row] >> 16) + start - offsets[row], reach[last] - start)


_PLACES = "repeat string, r1 long, r2 long, piece long, offset long, size long"


def _array_groups(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Places of all maximal repeats of ``rows`` in their pieces; a repeat is named by the digest of its bytes."""
    if not rows:
        return
    order, groups, owner, offsets = maximal_repeats([r[3] for r in rows], LENGTH)
    r1, r2, meta = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
    for length, first, last in groups:
        at = order[first : last + 1]
        row = owner[at]
        offset = at - offsets[row]
        string = rows[int(row[0])][3][int(offset[0]) : int(offset[0]) + length]
        name = pa.array([xxhash.xxh3_128_hexdigest(string)] * len(at))
        columns = [pa.array(x) for x in (r1[row], r2[row], meta[row] >> 16, offset, np.full(len(at), length, dtype=np.int64))]
        yield pa.RecordBatch.from_arrays([name, *columns], ["repeat", "r1", "r2", "piece", "offset", "size"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of kind, key and data: suffix arrays over whole keys, and equal strings of hot keys."""
    return _by_key(batches, _array_spans, lambda rows: _spans(*(np.array(x) for x in zip(*((r1, r2, meta >> 16, LENGTH) for r1, r2, meta in rows), strict=True))))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Like ``_repeats`` over pieces to compare, with every repeat apart."""
    return _by_key(batches, _array_groups, None)


def _by_key(batches: Iterator[pa.RecordBatch], array, strings) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    last_key = None
    string, waiting, seen = None, None, False
    for batch in batches:
        equal: list[tuple] = []
        for kind, key, r1, r2, meta, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "r1", "r2", "meta", "data")), strict=True):
            if kind == _HOT:
                if data != string:
                    string, waiting, seen = data, (r1, r2, meta), False
                    continue
                if not seen:
                    equal.append(waiting)
                    seen = True
                equal.append((r1, r2, meta))
                continue
            if key != last_key:
                if size > BLOCK:
                    yield from array(held)
                    held, size = [], 0
                last_key = key
            held.append((r1, r2, meta, data))
            size += len(data)
        if equal and strings is not None:
            yield strings(equal)
    yield from array(held)


_KEPT = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])))])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a text come after it: merges its spans and gives them with the bytes that are left."""
    name, packed = None, b""
    starts: list[np.ndarray] = []
    out: list[tuple] = []
    size = 0

    def finish() -> int:
        if name is None:
            return 0
        text = zlib.decompress(packed)
        spans = np.concatenate(starts) if starts else np.zeros((0, 2), dtype=np.int64)
        begins = ends = np.zeros(0, dtype=np.int64)
        if len(spans):
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            reach = np.maximum.accumulate(spans[:, 0] + spans[:, 1])
            new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
            begins, ends = spans[new, 0], reach[np.append(np.nonzero(new)[0][1:] - 1, len(reach) - 1)]
        kept = b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(text)], strict=True))
        out.append((*name, kept, begins, ends - begins))
        return len(kept)

    def flush() -> pa.RecordBatch:
        r1, r2, kept, begins, sizes = zip(*out, strict=True) if out else [()] * 5
        out.clear()
        edges = pa.array(np.cumsum([0, *map(len, begins)]), pa.int32())
        parts = [pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64), pa.int64()) for x in (begins, sizes)]
        spans = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(parts, ["start", "size"]))
        return pa.RecordBatch.from_arrays([pa.array(r1, pa.int64()), pa.array(r2, pa.int64()), pa.array(kept, pa.binary()), spans], schema=_KEPT)

    for batch in batches:
        r1, r2, start, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("r1", "r2", "start", "size"))
        z = batch.column("z")
        new = np.ones(len(r1), dtype=bool)
        new[1:] = (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])
        begins = np.nonzero(new)[0].tolist()
        for a, b in zip(begins, [*begins[1:], len(r1)], strict=True):
            if name != (int(r1[a]), int(r2[a])):
                size += finish()
                name, packed, starts = (int(r1[a]), int(r2[a])), z[a].as_py(), []
                if size > CHUNK:
                    yield flush()
                    size = 0
            spans = length[a:b] > 0
            if spans.any():
                starts.append(np.stack([start[a:b][spans], length[a:b][spans]], axis=1))
    finish()
    yield flush()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a task once, compressed."""
    seen: set[tuple] = set()
    for batch in batches:
        for piece in slices(batch, "text"):
            r1, r2 = piece.column("r1").to_pylist(), piece.column("r2").to_pylist()
            texts = utf8(piece.column("text"))
            if len(seen) > 500_000:
                seen.clear()
            fresh = [i for i, name in enumerate(zip(r1, r2, strict=True)) if not (name in seen or seen.add(name))]
            yield pa.RecordBatch.from_arrays([pa.array([r1[i] for i in fresh], pa.int64()), pa.array([r2[i] for i in fresh], pa.int64()), pa.array([zlib.compress(texts[i], 1) for i in fresh], pa.binary())], ["r1", "r2", "z"])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("r1", F.xxhash64("text")).withColumn("r2", F.xxhash64(F.lit(7), "text"))


def _met(body: DataFrame, hot: int, pairs: bool = False) -> DataFrame:
    """Pieces that have met by key: those that repeat whole, and those to compare."""
    found = body.mapInArrow(_scan, "key long, digest long, r1 long, r2 long, meta long")
    return _written(found.repartition("key").sortWithinPartitions("key", "digest").mapInArrow(_judge(hot, pairs), "kind int, key long, r1 long, r2 long, meta long"), "judged")


def _compared(packed: DataFrame, judged: DataFrame) -> DataFrame:
    """Bytes of the pieces to compare."""
    asks = judged.where(f"kind <> {_SPAN}").select("r1", "r2", "kind", "key", "meta", F.lit(None).cast("binary").alias("z"))
    wanted = packed.select("r1", "r2", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("meta"), "z").unionByName(asks)
    return wanted.repartition("r1", "r2").sortWithinPartitions("r1", "r2", "kind").mapInArrow(_contexts, "kind int, key long, r1 long, r2 long, meta long, data binary")


def _keys_together(compared: DataFrame) -> DataFrame:
    return compared.repartition("key").sortWithinPartitions("kind", "key", "data")


def _start() -> Column:
    return F.shiftright("meta", 16)


def _size() -> Column:
    return (F.shiftright("meta", 8).bitwiseAND(F.lit(0xFF)) + LENGTH).cast("long")


def _kept(named: DataFrame, hot: int) -> DataFrame:
    """Per distinct text: r1, r2, kept, spans."""
    body = named.select("r1", "r2", "text")
    judged = _met(body, hot)
    packed = body.mapInArrow(_packed, "r1 long, r2 long, z binary")
    more = _keys_together(_compared(packed, judged)).mapInArrow(_repeats, "r1 long, r2 long, start long, size long")
    whole = judged.where(f"kind = {_SPAN}").select("r1", "r2", _start().alias("start"), _size().alias("size"))
    nothing = F.lit(None).cast("binary").alias("z")
    parts = packed.select("r1", "r2", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"), "z").unionByName(whole.select("*", nothing)).unionByName(more.select("*", nothing))
    return parts.repartition("r1", "r2").sortWithinPartitions("r1", "r2", "size").mapInArrow(_removed, "r1 long, r2 long, kept binary, spans array<struct<start: long, size: long>>")


def _per_document(rows: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnsRenamed({"r1": "f1", "r2": "f2"})
    return rows.join(found, (F.col("r1") == F.col("f1")) & (F.col("r2") == F.col("f2"))).drop("r1", "r2", "f1", "f2")


def clean(docs: DataFrame, hot: int = 1500) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, kept (the remaining bytes; a cut may part a character's), spans (removed runs as start and size in bytes)."""
    named = _named(docs)
    return _per_document(named.select("doc_id", "r1", "r2"), _written(_kept(named, hot), "kept"))


def remove_repeats(docs: DataFrame, hot: int = 1500) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, taken from the kept bytes and spans of ``clean``."""
    named = _named(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["size"])
    figures = _kept(named, hot).select("r1", "r2", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    rows = named.select("doc_id", "r1", "r2", F.octet_length("text").cast("long").alias("n_bytes"))
    return _per_document(rows, _written(figures, "figures")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def repeat_groups(docs: DataFrame, hot: int = 1500) -> DataFrame:
    """All occurrences of repeated strings: repeat (names the string), doc_id, start, size in bytes; copies of a document count.

    Groups are the pieces that repeat whole and the maximal repeats among pieces of one key that differ or hold it twice.
    A repeat longer than a piece is given as the groups of its pieces, one after another; keys with more than ``hot`` pieces
    give their strings of ``LENGTH`` bytes, named apart from the others. Any two places of an equal string of ``LENGTH`` bytes
    are in a group at the same distance from its start. Rows are as many as occurrences, so nested repeats of one long text show often.
    """
    named = _named(docs)
    texts = named.select("r1", "r2", "text").dropDuplicates(["r1", "r2"])
    pieces = _written(texts.mapInArrow(_all_pieces, "name string, r1 long, r2 long, piece long, long long"), "pieces")
    data = _written(_compared(texts.mapInArrow(_packed, "r1 long, r2 long, z binary"), _met(texts, hot, pairs=True)), "compared")
    strings = data.where(f"kind = {_HOT}").select(F.lower(F.hex("data")).alias("repeat"), "r1", "r2", (_start() - F.col("meta").bitwiseAND(F.lit(0xFF))).alias("piece"), F.col("meta").bitwiseAND(F.lit(0xFF)).alias("offset"), F.lit(LENGTH).cast("long").alias("size"))
    among = _keys_together(data.where(f"kind = {_CONTEXT}")).mapInArrow(_groups, _PLACES)
    # one of equal pieces went through the array; what holds for it holds for all
    asked = among.unionByName(strings).join(pieces, ["r1", "r2", "piece"]).select("repeat", "name", "offset", "size").distinct()
    inside = asked.join(pieces, "name").select("repeat", "r1", "r2", (F.col("piece") + F.col("offset")).alias("start"), "size")
    whole = pieces.select(F.col("name").alias("repeat"), "r1", "r2", F.col("piece").alias("start"), F.col("long").alias("size"))
    found = _per_document(named.select("doc_id", "r1", "r2"), inside.unionByName(whole).distinct())
    often = found.groupBy(F.col("repeat").alias("known")).count().where("count > 1").select("known")
    return found.join(often, F.col("repeat") == F.col("known")).select("repeat", "doc_id", "start", "size")
