"""Near-duplicate texts by fuzzy keys of SimHash fingerprints, verified on word shingles.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Candidates come from
64-bit SimHash fingerprints of a text's distinct words: an edit touches one word but five shingles, so texts that share 0.8 of their
shingles differ in few of these bits (on the test tables in 9 or fewer for 99.8 % of such pairs, in 21 or more for 99 % of unlike ones). A
fingerprint has three segments; a key is the Golay codeword index of two of them, and each segment gives one or six indices. Of
up to five differing bits two segments have at most two each, and then the texts share a key; with more bits they share one with falling likelihood.

The rows of a key that are within ``radius`` bits and 1.25 in size, directly or through others, have one home, named by the smallest. Keys of more than
``whole`` rows are walked in order of size instead: the first row is a leader; rows within ``2 * radius`` bits and 1.25 ** 2 of
its size are sent to its home, those within ``radius`` bits and 1.25 of its size are done with, the others go on to the next leader. By the triangle
inequality two near rows always meet in some home, so no pair is listed. A home's
shingle sets are compared exactly; homes of more than ``block`` texts are compared block against block. Only the edges of a spanning forest leave a task.

Texts are lower-cased (A-Z) and compared as words; equal word sequences are one node, whose copies never meet again. Null and empty
texts are one node. Texts of fewer than five words have one shingle, the whole sequence. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import cut, pieces, utf8, words
from lintmill.llm.components import connected_components
from lintmill.llm.simhash import fuzzy_keys, segments

RADIUS = 9
SHINGLE = 5
SIMILARITY = 0.8
#: Words remembered by their hash between texts of a task.
MEMO = 500_000
_FACTOR = 0x9E3779B97F4A7C15


class _Words:
    """64-bit hashes of words, remembered."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, w: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > MEMO:
            known.clear()
        for x in w:
            if x not in known:
                known[x] = xxhash.xxh3_64_intdigest(x)
        return np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w))


def shingle_set(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a sequence of word hashes."""
    if not len(hashes):
        return hashes
    width = min(size, len(hashes))
    out = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : len(hashes) - width + 1 + i]) * np.uint64(_FACTOR)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def word_print(hashes: np.ndarray) -> int:
    """SimHash of the distinct words."""
    own = np.unique(hashes)
    ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view(np.int64)[0])


def _nodes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            for piece in pieces(batch, "text", 4 << 20):
                high, low, prints, sizes = [], [], [], []
                for text in utf8(piece.column("text")):
                    w = words(text)
                    whole = xxhash.xxh3_128_intdigest(b" ".join(w))
                    high.append((whole >> 64) - (1 << 63))
                    low.append((whole & (1 << 64) - 1) - (1 << 63))
                    h = memo.hashes(w)
                    prints.append(word_print(h))
                    sizes.append(len(shingle_set(h, shingle)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("row_key"), *(pa.array(c, pa.int64()) for c in (high, low, prints, sizes))], ["doc_id", "row_key", "high", "low", "fp", "n"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 4_000):
            part = batch.slice(start, 4_000)
            fps = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            near = []
            for segment in segments(fps):
                rows, index = fuzzy_keys(segment)
                own = np.full((len(fps), 24), -1, dtype=np.int64)
                own[rows, np.arange(len(rows)) - np.searchsorted(rows, rows)] = index
                near.append(own[:, :6])
            for combo in range(3):
                a, b = near[combo], near[(combo + 1) % 3]
                key = (combo << 24) | (a[:, :, None] << 12) | b[:, None, :]
                rows, i, j = np.nonzero((a[:, :, None] >= 0) & (b[:, None, :] >= 0))
                columns = [pa.array(key[rows, i, j], pa.int64())] + [part.column(c).take(pa.array(rows)) for c in ("node", "fp", "n")]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", "fp", "n"])


def _linked(node: np.ndarray, fp: np.ndarray, n: np.ndarray, radius: int, ratio: float) -> list[tuple[int, int]]:
    """(smallest member, member) of each set of rows that near ones connect; rows come in order of size."""
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius) & (n[None, :] <= n[:, None] * ratio) & (n[:, None] <= n[None, :] * ratio)
    out: list[tuple[int, int]] = []
    left = near.sum(axis=1) > 1
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        front = [root]
        while front:
            new = np.nonzero(near[front.pop()] & left)[0].tolist()
            left[new] = False
            front += new
            out += [(int(node[root]), int(node[x])) for x in new]
    return out


class _Walk:
    """Leaders of a key with more rows than one matrix holds; rows come in order of size, part by part."""

    def __init__(self, radius: int, ratio: float) -> None:
        self.radius, self.ratio, self.key = radius, ratio, None
        self.leaders: list[tuple[int, int, float]] = []  # node, fingerprint, size
        self.out: list[tuple[int, int]] = []

    def group(self, key: int, node: np.ndarray, fp: np.ndarray, n: np.ndarray) -> None:
        if key != self.key:
            self.key, self.leaders = key, []
        self.leaders = [x for x in self.leaders if n[0] <= x[2] * self.ratio**2]
        open_ = np.ones(len(node), dtype=bool)
        for leader in self.leaders:
            self._send(leader, node, fp, n, open_, 0)
        for at in range(len(node)):
            if open_[at]:
                leader = (int(node[at]), int(fp[at]), float(n[at]))
                self.leaders.append(leader)
                self._send(leader, node, fp, n, open_, at + 1)

    def _send(self, leader: tuple[int, int, float], node: np.ndarray, fp: np.ndarray, n: np.ndarray, open_: np.ndarray, start: int) -> None:
        own, print_, size = leader
        bits = np.bitwise_count(fp[start:] ^ np.uint64(print_))
        near = open_[start:] & (bits <= 2 * self.radius) & (n[start:] <= size * self.ratio**2)
        self.out += [(own, x) for x in node[start:][near].tolist()]
        open_[start:] &= ~((bits <= self.radius) & (n[start:] <= size * self.ratio))


def _homes(radius: int, ratio: float, whole: int):
    """(leader, node) from rows (key, node, fp, n) in order of key and size; a leader's own row is left to the reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, held, hot = _Walk(radius, ratio), None, None
        out: list[tuple[int, int]] = []

        def small(key: np.ndarray, node: np.ndarray, fp: np.ndarray, n: np.ndarray) -> None:
            if not len(key):
                return
            starts = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
            sizes = np.diff(np.append(starts, len(key)))
            two = starts[sizes == 2]
            close = two[(np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius) & (n[two + 1] <= n[two] * ratio)]
            out.extend(zip(node[close].tolist(), node[close + 1].tolist()))
            for a, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                out.extend(_linked(node[a : a + size], fp[a : a + size], n[a : a + size], radius, ratio))

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "fp", "n")]
            columns[2] = columns[2].view(np.uint64)
            if held is not None:
                columns = [np.concatenate((h, c)) for h, c in zip(held, columns)]
            if hot is not None:  # more of a key that is being walked
                rest = int(np.searchsorted(columns[0], hot, "right"))
                if rest:
                    walk.group(hot, *(c[:rest] for c in columns[1:]))
                columns = [c[rest:] for c in columns]
                hot = hot if not len(columns[0]) else None
            last = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            small(*(c[:last] for c in columns))
            held = [c[last:] for c in columns]
            if len(held[0]) > whole:
                hot = int(held[0][0])
                walk.group(hot, *held[1:])
                held = None
            out, walk.out = out + walk.out, []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["leader", "node"])
                out = []
        if held is not None:
            small(*held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["leader", "node"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                sets = [shingle_set(memo.hashes(words(t)), shingle).tobytes() for t in utf8(piece.column("text"))]
                yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(sets, pa.binary())], ["node", "body"])

    return run


def similar_pairs(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix: which of the sets of distinct values have that Jaccard similarity."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, number, times = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = times[number] > 1
    rank = (np.cumsum(times > 1) - 1)[number[shared]]
    owner = owner[shared]
    common = np.zeros((m, m), dtype=np.int64)
    width = 1 << 15
    order = np.argsort(rank // width, kind="stable")
    rank, owner = rank[order], owner[order]
    bounds = np.searchsorted(rank // width, np.arange(int(rank.max() // width) + 2 if len(rank) else 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        bits = np.zeros((m, width), dtype=bool)
        bits[owner[a:b], rank[a:b] % width] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for i in np.unique(owner[a:b]):
            common[i] += np.bitwise_count(packed & packed[i]).sum(axis=1, dtype=np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    return (common >= similarity * union) & (union > 0)


def _verified(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        _, first = np.unique(nodes, return_index=True)
        nodes = nodes[first]
        bodies = table.column("body").to_pylist()
        near = similar_pairs([np.frombuffer(bodies[i], dtype=np.uint64) for i in first], similarity)
        edges, reached = [], np.zeros(len(nodes), dtype=bool)
        for root in range(len(nodes)):  # a spanning forest, by breadth
            if reached[root]:
                continue
            reached[root] = True
            front = [root]
            while front:
                at = front.pop()
                new = np.nonzero(near[at] & ~reached)[0].tolist()
                reached[new] = True
                edges += [(nodes[at], nodes[x]) for x in new]
                front += new
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _row_key(docs: DataFrame) -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))))


def near_text_groups(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = 400, whole: int = 2000) -> DataFrame:
    """Per distinct (doc_id, text) of ``docs``: row_key, doc_id, group (a number).

    Rows of one group are linked by near copies, directly or through others. An empty table gives no rows.
    """
    ratio = 1 / similarity
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _row_key(docs).alias("row_key"))
    rows = cut(texts.mapInArrow(_nodes(shingle), "doc_id long, row_key string, high long, low long, fp long, n long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    nodes = cut(rows.groupBy("high", "low").agg(first.alias("first"), F.any_value("fp").alias("fp"), F.any_value("n").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    # sets of under 1 / (1 / similarity - 1) values are near copies only if equal
    keyed = nodes.where(F.col("n") >= int(1 / (ratio - 1))).select("node", "fp", "n").mapInArrow(_keys, "key long, node long, fp long, n long")
    walked = keyed.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_homes(radius, ratio, whole), "leader long, node long")
    homes = cut(walked.distinct())
    homes = homes.unionByName(homes.select("leader", F.col("leader").alias("node")).distinct())
    sized = homes.groupBy("leader").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = homes.join(sized, "leader").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.select("leader", "node", "own", other.alias("other")).select("leader", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    wanted = homes.select("node").distinct().join(nodes.select("node", F.col("first.row_key").alias("row_key")), "node")
    sets = texts.select("row_key", "text").join(wanted, "row_key").select("node", "text").mapInArrow(_sets(shingle), "node long, body binary")
    sets = cut(sets.groupBy("node").agg(F.any_value("body").alias("body")))
    edges = placed.join(sets, "node").groupBy("leader", "i", "j").applyInArrow(_verified(similarity), "u long, v long")
    labels = connected_components(edges)
    grouped = nodes.join(labels, "node", "left").select("high", "low", F.coalesce("label", "node").alias("group"))
    return rows.join(grouped, ["high", "low"]).select("row_key", "doc_id", "group")


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs(doc_id, text, ...)`` for each group of near copies; columns unchanged.

    It is the row with the smallest doc_id, null ids last, then of the smallest hash; rows alike in id and text stay once. Rows that share an id but not their
    text are told apart. Any other columns may be there, under any name.
    """
    groups = near_text_groups(docs, **options)
    kept = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")).select(F.col("first.row_key").alias("kept"))
    # the row itself travels as one struct, so no name in it can clash
    rows = docs.select(F.struct("*").alias("row"), _row_key(docs).alias("row_key"))
    return rows.join(kept, F.col("row_key") == F.col("kept"), "left_semi").dropDuplicates(["row_key"]).select("row.*")
