"""Benchmark decontamination by spaced-seed hashing.

A document overlaps an item if, somewhere on one alignment without gaps, ``window`` consecutive
words (or the whole item, if it is shorter) agree in at least ``agreement`` of their places; of items under five
words all places must agree. Words are lower-cased in A-Z.

Fixed masks choose some word places out of a short span and ignore the others. Benchmark and
document hashes of the chosen words are joined; each hit names an alignment, which is verified
around the hit. The masks below find every alignment of ten words with at most two substitutions, which any
accepted window of ten or more words contains; items of five to nine words get a mask for each
place that may differ, shorter ones their own words. Bounds that the masks do not cover are refused. So the search loses nothing that the definition accepts.

The benchmark is read in blocks of at most ``block_words`` words, each broadcast as one bounded
table and held against all documents, so a benchmark of any size works. Null and empty texts
overlap nothing; items with equal text are all reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import pieces, utf8, words

#: Places that count, for items of ten words and more.
MASKS = ("1111011", "11001111", "110110011", "11110101", "10101111")
#: Odd multipliers come from one rule; index by place.
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(64)], dtype=np.uint64)
_TABLE_BITS = 22


@dataclass(frozen=True)
class Seeds:
    """One block of the benchmark: words, item texts as word numbers, and per mask its sorted hashes."""

    vocabulary: dict[bytes, int]
    items: list[tuple[int, np.ndarray]]
    masks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # places, hashes, item numbers, item places
    tables: list[np.ndarray]
    flat: np.ndarray  # all items, parted by -1
    offsets: np.ndarray
    sizes: np.ndarray
    window: int
    agreement: float


def _masks_for(n: int) -> list[str]:
    if n >= 10:
        return list(MASKS)
    if n < 5:
        return ["1" * n]
    return ["1" * i + "0" + "1" * (n - 1 - i) for i in range(1, n - 1)] + ["0" + "1" * (n - 1), "1" * (n - 1) + "0"]


def _hash_at(ids: np.ndarray, places: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), dtype=np.uint64)
    for k, p in enumerate(places):
        h += ids[at + p].view(np.uint64) * _ODD[k]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def check_bounds(window: int, agreement: float) -> None:
    """Raises where the masks could miss an alignment that ``window`` and ``agreement`` accept."""
    for n in range(1, window + 1):
        differ = n - int(np.ceil(agreement * n - 1e-9))
        # ten words in a row with at most two that differ; a place for each of shorter items; none below five
        if differ > (0 if n < 5 else 1 if n < 10 else 3 * (n // 10) - 1):
            raise ValueError(f"the masks don't cover {differ} words that differ among {n}; raise agreement")


def build_seeds(rows: list[tuple[int, str | None]], *, window: int = 13, agreement: float = 0.8, least: int = 1) -> Seeds:
    check_bounds(window, agreement)
    vocabulary: dict[bytes, int] = {}
    items = []
    for item_id, text in rows:
        w = words((text or "").encode())
        if len(w) >= least:
            items.append((item_id, np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], dtype=np.int64)))
    found: dict[str, list[tuple[np.ndarray, int]]] = {}
    for number, (_, ids) in enumerate(items):
        for mask in _masks_for(len(ids)):
            found.setdefault(mask, []).append((ids, number))
    masks, tables = [], []
    for mask, members in sorted(found.items()):
        places = np.array([i for i, c in enumerate(mask) if c == "1"])
        hashes, numbers, starts = [], [], []
        for ids, number in members:
            n = len(ids) - len(mask) + 1
            if n > 0:
                hashes.append(_hash_at(ids, places, np.arange(n)))
                numbers.append(np.full(n, number))
                starts.append(np.arange(n))
        if not hashes:
            continue
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        masks.append((places, h[order], np.concatenate(numbers)[order], np.concatenate(starts)[order]))
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[h >> np.uint64(64 - _TABLE_BITS)] = True
        tables.append(table)
    sizes = np.array([len(ids) for _, ids in items], dtype=np.int64)
    offsets = np.cumsum(sizes + window) - sizes
    flat = np.full(int(sizes.sum()) + window * (len(items) + 1), -1, dtype=np.int64)
    for offset, (_, ids) in zip(offsets, items, strict=True):
        flat[offset : offset + len(ids)] = ids
    return Seeds(vocabulary, items, masks, tables, flat, offsets, sizes, window, agreement)


def _best_window(same: np.ndarray, width: int) -> int:
    """Agreeing words of the best window of ``width``."""
    total = np.concatenate(([0], np.cumsum(same)))
    return int((total[width:] - total[:-width]).max())


def search(seeds: Seeds, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
    """(text number, item id, first word in text, first word in item, words compared, words that agree).

    One row for each text and item that overlap: their best alignment, the first of equals.
    """
    get = seeds.vocabulary.get
    per_text = [[get(w, 0) for w in words(t)] for t in texts]
    lengths = np.array([len(x) for x in per_text], dtype=np.int64)
    pad = max(64, seeds.window)
    ids = np.zeros(int(lengths.sum()) + pad * (len(texts) + 1), dtype=np.int64)  # zeros part the texts
    starts = np.cumsum(lengths + pad) - lengths
    for s, x in zip(starts, per_text, strict=True):
        ids[s : s + len(x)] = x
    alignments: set[tuple[int, int, int]] = set()
    n = len(ids) - pad
    for (places, hashes, numbers, item_starts), table in zip(seeds.masks, seeds.tables, strict=True):
        ends = np.nonzero((ids[places[0] : places[0] + n] > 0) & (ids[places[-1] : places[-1] + n] > 0))[0]
        h = _hash_at(ids, places, ends)
        hit = table[h >> np.uint64(64 - _TABLE_BITS)]
        at, h = ends[hit], h[hit]
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        some = high > low
        at, low, many = at[some], low[some], (high - low)[some]
        rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, entry = np.repeat(at, many), np.repeat(low, many) + rank
        number, place = numbers[entry], item_starts[entry]
        # words that agree around the hit bound what a window through it can reach
        flat_at = seeds.offsets[number] + place
        agree = np.zeros(len(at), dtype=np.int64)
        for o in range(1 - seeds.window, seeds.window):
            agree += ids[at + o] == seeds.flat[flat_at + o]
        likely = agree >= seeds.agreement * np.minimum(seeds.window, seeds.sizes[number])
        at, number, place = at[likely], number[likely], place[likely]
        alignments.update(zip((np.searchsorted(starts, at, "right") - 1).tolist(), number.tolist(), (at - place).tolist(), strict=True))
    best: dict[tuple[int, int], tuple] = {}
    for k, number, shift in sorted(alignments):
        item_id, item = seeds.items[number]
        first, last = max(shift, int(starts[k])), min(shift + len(item), int(starts[k] + lengths[k]))
        width = min(seeds.window, len(item))
        if last - first < width:
            continue
        same = ids[first:last] == item[first - shift : last - shift]
        if _best_window(same, width) < seeds.agreement * width:
            continue
        row = (k, item_id, first - int(starts[k]), first - shift, last - first, int(same.sum()))
        known = best.get((k, number))
        if known is None or (row[5], -row[2]) > (known[5], -known[2]):
            best[k, number] = row
    return [best[key] for key in sorted(best)]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Rows of the benchmark, streamed to the driver in blocks of bounded size."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"].split())
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def overlaps(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, agreement: float = 0.8, least: int = 1, block_words: int = 1_000_000) -> DataFrame:
    """Per document and benchmark item that overlap: doc_id, item_id, doc_word, item_word, compared, agreeing.

    Items of one to four words are found where they stand whole (``compared`` tells them); repeated rows give repeated results.
    """
    schema = "doc_id long, item_id long, doc_word long, item_word long, compared long, agreeing long"
    out = None
    for block in _blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(build_seeds(block, window=window, agreement=agreement, least=least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch, "text", 4 << 20):
                    found = search(shared.value, utf8(piece.column("text")))
                    ids = piece.column("doc_id").to_pylist()
                    columns = list(zip(*found, strict=True)) if found else [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in columns[0]], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "item_id", "doc_word", "item_word", "compared", "agreeing"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, block_words: int = 1_000_000, least: int = 5, **options) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item of ``least`` words or more; columns unchanged, nothing shuffled.

    A word or two say nothing about where a document comes from, so shorter items remove nothing unless ``least`` is lowered.
    """
    out = docs
    for block in _blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(build_seeds(block, least=least, **options))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch, "text", 4 << 20):
                    hit = {x[0] for x in search(shared.value, utf8(piece.column("text")))}
                    yield piece.filter(pa.array([k not in hit for k in range(piece.num_rows)]))

        out = out.mapInArrow(run, docs.schema)
    return out
