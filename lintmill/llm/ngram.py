"""LM scoring by a weighted backoff automaton.

Tokens are the words of the lower-cased text and one end. The model is an absolute-discounting
backoff model: each kept n-gram is a state with arcs to the n-grams that extend it, and a failure
arc, which costs its backoff weight, to the state of its longest kept suffix. Scoring walks the
tokens once from left to right, carries the state, and adds the weights of arcs taken.

Counts cover all training rows, and every n-gram is kept (``floor`` above 0 keeps those of that share of all tokens).
No table of n-grams is gathered: each place in a text, its word and the words before it, is dealt by the word before,
so all n-grams, contexts and suffixes that a place needs are in one bucket of about ``capacity`` places, where its
cost is found and summed by text. Words that occur more than ``capacity`` times are dealt by the pair they
begin, which gives pair counts, and then by the pair they end. Only one pair's places must meet in one task,
which holds its n-grams once and 16 bytes a place. Buckets are dealt in ``turns``, each with a scan of the texts, so that no
more than a share of all places is on disk at once. Words with
a share of at least ``head`` have numbers in a broadcast table (at most 1 / head); others are named by 63 bits of
their XXH64, and their unigrams are joined. ``build`` and ``walk`` are the same automaton in one memory.

A text's tokens are whole; null and empty texts are one end token. Without training rows every
score is that of a vocabulary of no words: log10(0.5 / 0.5) = 0 per token.
"""

from __future__ import annotations

import gc
import math
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.llm.common import FOLDS, cut, fold, pieces, utf8, words

#: The end token; no word contains a newline.
END = b"\n"
#: Distinct entries that a task holds before it hands its partial counts on; tokens that it turns into places at once.
FLUSH = 400_000
#: Chunks of tokens that are dealt together. Each flush gives a row to each bucket, so small ones would make rows that grow with the square of the input.
CHUNKS = 6
DISCOUNT = 0.7
#: Costs of places are summed in these units, so sums don't depend on the order of rows.
UNIT = 2.0**-30


def tokens(text: bytes) -> list[bytes]:
    w = words(text)
    w.append(END)
    return w


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in utf8(batch.column("text")):
            counts.update(tokens(text))
            if len(counts) > FLUSH:
                yield from _emit(counts)
                counts.clear()
    yield from _emit(counts)


def _emit(counts: Counter) -> Iterator[pa.RecordBatch]:
    keys, values = list(counts), list(counts.values())
    for start in range(0, len(keys), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[start : start + 50_000], pa.binary()), pa.array(values[start : start + 50_000], pa.int64())], ["word", "n"])


@dataclass(frozen=True)
class Automaton:
    """Word numbers of the head, and arcs.

    ``arcs[state * size + word]`` is the next state; a state's number indexes ``cost`` (log10 of
    the arc into it from its own context), ``backoff`` and ``failure``. State 0 is the root.
    """

    numbers: dict[bytes, int]
    base: np.ndarray  # by word number: log10 of the smoothed unigram; number 0 stands for words outside the head
    size: int
    arcs: dict[int, int]
    cost: list[float]
    backoff: list[float]
    failure: list[int]


def build(numbers: dict[bytes, int], word_counts: np.ndarray, base: np.ndarray, codes: list[np.ndarray], counts: list[np.ndarray], total: int) -> Automaton:
    """The automaton of the kept n-grams; ``codes[k]`` are those of order k + 2 with contexts of order k + 1."""
    size = len(word_counts)
    arcs: dict[int, int] = {}
    cost, backoff, failure = [0.0], [0.0], [0]
    prob: list[float] = [1.0]
    first = [1]  # number of the first state of each order
    for w in range(1, size):
        arcs[w] = w
        cost.append(float(base[w]))
        prob.append(10.0 ** float(base[w]))
        backoff.append(0.0)
        failure.append(0)
    occurrences = np.concatenate(([total], word_counts[1:])).astype(np.float64)
    for code, count in zip(codes, counts, strict=True):
        start = len(cost)
        context_first = first[-1]
        contexts, word = code // size, code % size  # contexts count from 1 within their order
        freed: dict[int, float] = {}
        covered: dict[int, float] = {}
        for c, w, n in zip(contexts.tolist(), word.tolist(), count.tolist(), strict=True):
            context = context_first + c - 1
            lower = failure[context]
            while lower * size + w not in arcs:
                lower = failure[lower]
            suffix = arcs[lower * size + w]
            p = (n - DISCOUNT) / occurrences[context]
            freed[context] = freed.get(context, 0.0) + p
            covered[context] = covered.get(context, 0.0) + _prob(arcs, size, prob, backoff, failure, failure[context], w)
            arcs[context * size + w] = len(cost)
            cost.append(math.log10(p))
            prob.append(p)
            backoff.append(0.0)
            failure.append(suffix)
        for context, p in freed.items():
            backoff[context] = math.log10(max(1 - p, 1e-9) / max(1 - covered[context], 1e-9))
        occurrences = np.concatenate((occurrences, count.astype(np.float64)))
        first.append(start)
    return Automaton(numbers, base, size, arcs, cost, backoff, failure)


def _prob(arcs: dict[int, int], size: int, prob: list[float], backoff: list[float], failure: list[int], state: int, w: int) -> float:
    weight = 0.0
    while state * size + w not in arcs:
        weight += backoff[state]
        state = failure[state]
    return prob[arcs[state * size + w]] * 10.0**weight


def walk(a: Automaton, ids: list[int]) -> float:
    """log10 probability of a token sequence; words outside the head (0) cost their backoff here and their unigram elsewhere."""
    arcs, size, cost, backoff, failure = a.arcs, a.size, a.cost, a.backoff, a.failure
    state, total = 0, 0.0
    find = arcs.get
    for w in ids:
        if w:
            to = find(state * size + w)
            while to is None:
                total += backoff[state]
                state = failure[state]
                to = find(state * size + w)
            total += cost[to]
            state = to
        else:
            while state:
                total += backoff[state]
                state = failure[state]
    return total


def _collect_head(vocabulary: DataFrame, least: int) -> tuple[dict[bytes, int], np.ndarray]:
    """Numbers from 1 of the frequent words, the most frequent first, and their counts."""
    table = vocabulary.where(F.col("n") >= least).toPandas()
    rows = sorted(zip(map(bytes, table["word"]), table["n"].tolist(), strict=True), key=lambda r: (-r[1], r[0]))
    return {w: i + 1 for i, (w, _) in enumerate(rows)}, np.array([0, *(n for _, n in rows)], dtype=np.int64)


@dataclass(frozen=True)
class Plan:
    """What every task knows: the head, and how places are dealt."""

    numbers: dict[bytes, int]
    counts: np.ndarray  # by head number
    base: np.ndarray
    order: int
    least: int  # count from which an n-gram is kept
    capacity: int
    buckets: int
    hot: int  # head numbers up to this one occur more than ``capacity`` times
    hot_buckets: int


def _mix(*columns: np.ndarray) -> np.ndarray:
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(24)


def _pack(columns: list[np.ndarray]) -> bytes:
    """int64 columns by byte planes, compressed."""
    n = len(columns[0])
    planes = np.ascontiguousarray(np.stack(columns).view(np.uint8).reshape(len(columns), n, 8).transpose(0, 2, 1))
    return struct.pack("<qq", len(columns), n) + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpack(body: bytes) -> list[np.ndarray]:
    k, n = struct.unpack_from("<qq", body)
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(body[16:], 8 * k * n, asbytes=True), dtype=np.uint8)
    return list(np.ascontiguousarray(planes.reshape(k, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(k, n))


#: Rows of all kinds: texts and, packed for a flush, their words outside the head, places, sums, words whose backoff or unigram they need; contexts.
TEXT, RARE, PLACES, SUMS, BACKOFF, UNIGRAM, CONTEXT = range(7)
ROWS = pa.schema(
    [("kind", pa.int32()), ("p", pa.int64()), ("g", pa.int64()), ("i", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("head_base", pa.float64())]
    + [("mass", pa.float64()), ("covered", pa.float64()), ("keys", pa.list_(pa.int64())), ("body", pa.binary())]
)
ROWS_SQL = "kind int, p long, g long, i long, doc_id long, n_tokens long, n_head long, head_base double, mass double, covered double, keys array<long>, body binary"


def _key(word: bytes) -> int:
    """Name of a word outside the head: negative, 63 bits of its hash."""
    return -(xxhash.xxh64_intdigest(word, 42) >> 1) - 1


def _split(p: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns by bucket, in their order."""
    order = np.argsort(p.astype(np.uint16) if len(p) and p.max() < 1 << 16 else p, kind="stable")
    p, columns = p[order], [c[order] for c in columns]
    starts = np.nonzero(np.concatenate(([True], p[1:] != p[:-1])))[0] if len(p) else []
    for a, b in zip(starts, [*starts[1:], len(p)]):
        yield int(p[a]), [c[a:b] for c in columns]


def _chunk(plan: Plan, g: int, texts: list[tuple], number: int, turn: int, turns: int) -> tuple[list[dict], list[np.ndarray]]:
    """Some texts of a flush, numbered from ``number``. Rows of the texts and their first tokens at the first turn; bucket, columns of the places after those whose turn it is."""
    rows: list[dict] = []
    lengths = np.array([len(t[2]) for t in texts])
    word = np.fromiter((x for t in texts for x in t[2]), dtype=np.int64, count=int(lengths.sum()))
    text = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # at order 1 every token is its own start
    start = at == 0 if plan.order > 1 else np.ones(len(at), dtype=bool)
    if turn == 0:
        rows += _text_rows(plan, g, texts, number, word, text)
        base = np.rint(plan.base[np.maximum(word, 0)] / UNIT)
        rows += _sum_rows(plan, g, text[start] + number, base[start])
        rows += _words_of(plan, UNIGRAM, g, word[start & (word < 0)], text[start & (word < 0)] + number)
    later = np.nonzero(~start)[0]
    v = word[later - 1]
    cold = (_mix(v) % np.uint64(plan.buckets)).astype(np.int64)
    p = np.where((v > 0) & (v <= plan.hot), plan.buckets + (_mix(v, word[later]) % np.uint64(plan.hot_buckets)).astype(np.int64), cold)
    due = p % turns == turn
    later, p = later[due], p[due]
    train = np.array([t[1] for t in texts], dtype=np.int64)[text[later]]
    before = [np.where(at[later] >= k, word[np.maximum(later - k, 0)], 0) for k in range(1, plan.order)]
    return rows, [p, *before[:1], word[later], (text[later] + number) * 2 + train, *before[1:]]


def _places(p: np.ndarray, columns: list[np.ndarray], g: int) -> Iterator[dict]:
    """A row for each bucket, equal n-grams next to one another, for the packing and for ``_chunks``."""
    for bucket, own in _split(p, columns):
        order = np.lexsort((*own[3:4], own[1], own[0]))
        yield {"kind": PLACES, "p": bucket, "g": g, "body": _pack([c[order] for c in own])}


def _text_rows(plan: Plan, g: int, texts: list[tuple], number: int, word: np.ndarray, text: np.ndarray) -> list[dict]:
    rows: list[dict] = []
    head = np.bincount(text, word > 0, len(texts)).astype(np.int64).tolist()
    head_base = np.bincount(text, plan.base[np.maximum(word, 0)], len(texts)).tolist()
    for i, (doc_id, _, ids) in enumerate(texts):
        rows.append({"kind": TEXT, "p": (g + number + i) % plan.buckets, "g": g, "i": number + i, "doc_id": doc_id, "n_tokens": len(ids), "n_head": head[i], "head_base": head_base[i]})
    outside = np.nonzero(word < 0)[0]
    if len(outside):
        pair, first = _number(text[outside], _number(word[outside])[0])
        rows.append({"kind": RARE, "p": g % plan.buckets, "g": g, "body": _pack([word[outside][first], text[outside][first] + number, np.bincount(pair)])})
    return rows


def _sum_rows(plan: Plan, g: int, text: np.ndarray, units: np.ndarray) -> list[dict]:
    """Sums of costs by text."""
    own, number = np.unique(text, return_inverse=True)
    return [{"kind": SUMS, "p": g % plan.buckets, "g": g, "body": _pack([own, np.bincount(number, weights=units).astype(np.int64)])}] if len(own) else []


def _words_of(plan: Plan, kind: int, g: int, word: np.ndarray, text: np.ndarray) -> list[dict]:
    """Words whose cost is left to a join, with their texts."""
    return [{"kind": kind, "p": g % plan.buckets, "g": g, "body": _pack([word, text, np.ones(len(word), dtype=np.int64)])}] if len(word) else []


def _emit_places(plan: Plan, turn: int, turns: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all flushes: places of the buckets whose turn it is, the other kinds at the first turn."""
    get = plan.numbers.get

    def packed(rows) -> Iterator[pa.RecordBatch]:
        rows = iter(rows)
        while part := list(islice(rows, 1000)):
            yield from pa.Table.from_pylist(part, ROWS).to_batches()

    held: list[tuple] = []
    parts: list[list[np.ndarray]] = []
    g, size, number = 0, 0, 0

    def chunk() -> Iterator[pa.RecordBatch]:
        rows, columns = _chunk(plan, g, held, number, turn, turns)
        parts.append(columns)
        return packed(rows)

    def flush() -> Iterator[pa.RecordBatch]:
        if not sum(len(x[0]) for x in parts):
            return
        p, *columns = [np.concatenate(c) for c in zip(*parts)]
        parts.clear()
        yield from packed(_places(p, columns, g))

    for batch in batches:
        for piece in pieces(batch, "text", 4 << 20):
            for row, doc_id, train, text in zip(piece.column("row").to_pylist(), piece.column("doc_id").to_pylist(), piece.column("train").to_pylist(), utf8(piece.column("text"))):
                w = tokens(text)
                ids = [get(x) or _key(x) for x in w]
                g = row if not held and not parts else g
                held.append((doc_id, train, ids))
                size += len(ids)
                if size > min(plan.capacity, FLUSH):
                    yield from chunk()
                    number += len(held)
                    held, size = [], 0
                    if len(parts) == CHUNKS:
                        yield from flush()
                        parts, number = [], 0
    if held:
        yield from chunk()
    yield from flush()


def _number(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct values or pairs of numbers, and a place of each."""
    key = a if b is None else (a << 32) | b
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    number = np.empty(len(key), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


@dataclass(frozen=True)
class Chunk:
    """Some places of a bucket: flush, text with its mark, and the place's n-gram among those of the bucket."""

    flush: np.ndarray
    mark: np.ndarray
    gram: np.ndarray


def _chunks(plan: Plan, table: pa.Table, paired: bool) -> tuple[list[Chunk], list[np.ndarray], np.ndarray]:
    """The places of a bucket by about ``capacity``, its n-grams (v, w, words before, pair count) and how often each is in training rows.

    Equal n-grams lie next to one another in a body, so there are as many n-grams as runs; a frequent pair's places cost 16 bytes each.
    """
    places = table.filter(pc.equal(table.column("kind"), PLACES))
    names, bodies = places.column("g").to_numpy(), places.column("body")
    chunks: list[Chunk] = []
    grams: list[list[np.ndarray]] = []
    times: list[np.ndarray] = []
    held: list[list[np.ndarray]] = []
    size, seen = 0, 0
    for k in range(len(names)):
        columns = _unpack(bodies[k].as_py())
        held.append(columns if paired else [*columns, np.full(len(columns[0]), names[k])])
        size += len(columns[0])
        if size < plan.capacity and k + 1 < len(names):
            continue
        v, w, mark, *more, flush = [np.concatenate(c) for c in zip(*held)]
        held, size = [], 0
        new = np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
        for c in more:
            new[1:] |= c[1:] != c[:-1]
        starts = np.nonzero(new)[0]
        grams.append([c[starts] for c in (v, w, *more)])
        times.append(np.add.reduceat(mark & 1, starts))
        chunks.append(Chunk(flush, mark.astype(np.int32), (np.cumsum(new) - 1 + seen).astype(np.int32)))
        seen += len(starts)
    return chunks, [np.concatenate(c) for c in zip(*grams)], np.concatenate(times)


def _contexts(plan: Plan, v: np.ndarray, w: np.ndarray, p: np.ndarray, wanted: np.ndarray) -> list[dict]:
    """For each wanted word v, what its kept pairs (v, w), given once each, take away: mass, unigrams of head words, other words."""
    keep = np.isin(v, wanted)
    order = np.argsort(v[keep], kind="stable")
    v, w, p = v[keep][order], w[keep][order], p[keep][order]
    names, starts = np.unique(v, return_index=True)
    out = []
    for name, a, b in zip(names.tolist(), starts, [*starts[1:], len(v)]):
        near = w[a:b]
        out.append({"kind": CONTEXT, "p": 0, "g": name, "mass": float(p[a:b].sum()), "covered": float((10.0 ** plan.base[near[near > 0]]).sum()), "keys": near[near < 0]})
    return out


def _pair_bucket(plan: Plan, table: pa.Table) -> list[dict]:
    """Hot words: counts of the pairs (v, w), which go along with the places, now dealt by (u, v) without regard to flushes."""
    chunks, (v, w, *before), times = _chunks(plan, table, False)
    number, first = _number(_number(v)[0], _number(w)[0])
    count = np.bincount(number, weights=times).astype(np.int64)
    kept = first[count >= plan.least]
    rows = _contexts(plan, v[kept], w[kept], (count[number[kept]] - DISCOUNT) / plan.counts[v[kept]], np.unique(v))
    far = before[0] if before else np.zeros_like(v)
    bucket = (_mix(far, v) % np.uint64(plan.hot_buckets)).astype(np.int64)
    columns = [*before, count[number]]
    for c in chunks:
        rows += _places(bucket[c.gram], [v[c.gram], w[c.gram], c.mark.astype(np.int64), *(x[c.gram] for x in columns), c.flush], 0)
    return rows


def _bucket(plan: Plan, table: pa.Table, paired: bool) -> list[dict]:
    """Costs of all places of a bucket: longest kept n-gram first, else the context's backoff and the next shorter one."""
    chunks, columns, train = _chunks(plan, table, paired)
    pair = columns.pop() if paired else None
    v, w, *before = columns
    words_, (context, _) = _number(w)[0], _number(v)
    gram, first = _number(context, words_)
    seen = np.bincount(gram, weights=train)[gram] if pair is None else pair.astype(np.float64)
    of = np.bincount(context, weights=train)[context] if pair is None else plan.counts[v].astype(np.float64)
    kept = seen >= plan.least
    p = np.where(kept, seen - DISCOUNT, 1.0) / np.where(kept, of, 1.0)
    costs, found, known = np.log10(p), kept, of > 0
    rows: list[dict] = []
    if pair is None:
        once = first[kept[first]]
        rows += _contexts(plan, v[once], w[once], p[once], np.unique(v[~found & known]))
    for far in before:
        context, _ = _number(context, _number(far)[0])
        gram, first = _number(context, words_)
        seen, of = np.bincount(gram, weights=train)[gram], np.bincount(context, weights=train)[context]
        inside = far != 0
        kept = inside & (seen >= plan.least)
        longer = np.where(kept, seen - DISCOUNT, 1.0) / np.where(kept, of, 1.0)
        once = first[kept[first]]
        size = int(context.max()) + 1
        mass, covered = np.bincount(context[once], longer[once], size), np.bincount(context[once], p[once], size)
        backoff = np.where(mass > 0, np.log10(np.maximum(1 - mass, 1e-9) / np.maximum(1 - covered, 1e-9)), 0.0)
        costs = np.where(kept, np.log10(longer), costs + np.where(inside, backoff[context], 0.0))
        p = np.where(kept, longer, p)
    # n-grams without a kept pair end at the unigram; for the rest no word is looked up
    units = np.rint((costs + np.where(found, 0.0, plan.base[np.maximum(w, 0)])) / UNIT)
    rare, ask = ~found & (w < 0), ~found & known
    for c in chunks:
        names, flush = np.unique(c.flush, return_inverse=True)
        text = (c.mark >> 1).astype(np.int64)
        own, number = np.unique((flush << 32) | text, return_inverse=True)
        sums = np.bincount(number, weights=units[c.gram]).astype(np.int64)
        for f, (text_, sums_) in _split(own >> 32, [own & 0xFFFFFFFF, sums]):
            rows.append({"kind": SUMS, "p": 0, "g": int(names[f]), "body": _pack([text_, sums_])})
        for kind, which, word in ((UNIGRAM, rare, w), (BACKOFF, ask, v)):
            at = np.nonzero(which[c.gram])[0]
            for f, own_ in _split(flush[at], [word[c.gram[at]], text[at]]):
                rows += _words_of(plan, kind, int(names[f]), *own_)
    return rows


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for g, body in zip(batch.column("g").to_pylist(), batch.column("body").to_pylist()):
            keys, at, times = _unpack(body)
            for start in range(0, len(keys), 100_000):
                part = [x[start : start + 100_000] for x in (at, keys, times)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), g)), *map(pa.array, part)], ["g", "i", "key", "times"])


def _release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files behind what has been cut; it acts on the driver's collected references."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _sums(table: pa.Table) -> pa.Table:
    parts = [_unpack(x) for x in table.column("body").to_pylist()]
    text = np.concatenate([x[0] for x in parts])
    own, number = np.unique(text, return_inverse=True)
    costs = np.bincount(number, weights=np.concatenate([x[1] for x in parts])) * UNIT
    return pa.table({"g": pa.array(np.full(len(own), table.column("g")[0].as_py())), "i": pa.array(own), "cost": pa.array(costs)})


def score(docs: DataFrame, held_out_fold: int = 1, *, order: int = 3, floor: float = 0.0, head: float = 5e-7, capacity: int = 800_000, turns: int = 2) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        whole = cut(whole)  # rows must come in the same order at each scan, as they do from files
    training = whole.where(fold(F.col("doc_id")) != held_out_fold)
    vocabulary = cut(training.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    _release(spark)
    total, distinct = map(int, vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())
    bottom = total + 0.5 * (distinct + 1)
    rare_below = max(2, math.ceil(head * total))
    numbers, counts = _collect_head(vocabulary, rare_below)
    base = np.log10((counts + 0.5) / bottom)
    base[0] = 0.0
    hot = int((counts > capacity).sum())  # the most frequent words have the first numbers
    share = 1 + 1 / (FOLDS - 1)
    plan = Plan(numbers, counts, base, order, max(1, math.ceil(floor * total)), capacity, math.ceil(share * total / capacity) + 1, hot, math.ceil(share * int(counts[1 : hot + 1].sum()) / capacity) + 1)
    shared = spark.sparkContext.broadcast(plan)

    def dealt(key: tuple, table: pa.Table) -> pa.Table:
        plan = shared.value
        rest = table.filter(pc.not_equal(table.column("kind"), PLACES))
        if rest.num_rows == table.num_rows:
            return rest
        rows = _pair_bucket(plan, table) if key[0].as_py() >= plan.buckets else _bucket(plan, table, False)
        return pa.concat_tables([rest.cast(ROWS), pa.Table.from_pylist(rows, ROWS)])

    def again(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(_bucket(shared.value, table, True), ROWS)

    def emit(turn: int):
        return lambda batches: _emit_places(shared.value, turn, turns, batches)

    texts = whole.select(F.monotonically_increasing_id().alias("row"), "doc_id", (fold(F.col("doc_id")) != held_out_fold).alias("train"), "text")
    done = None
    for turn in range(turns):  # the texts are read once a turn, and a turn's places are gone from disk before the next
        part = cut(texts.mapInArrow(emit(turn), ROWS_SQL).groupBy("p").applyInArrow(dealt, ROWS_SQL))
        _release(spark)
        done = part if done is None else done.unionByName(part)
    if hot:
        done = done.where(F.col("kind") != PLACES).unionByName(cut(done.where(F.col("kind") == PLACES).groupBy("p").applyInArrow(again, ROWS_SQL)))
        _release(spark)

    known = vocabulary.where(F.col("n") < rare_below)
    named = known.select((-F.shiftrightunsigned(F.xxhash64("word"), 1) - 1).alias("key"), "n")
    unigram = (F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(bottom))

    def asked(kind: int) -> DataFrame:
        return done.where(F.col("kind") == kind).select("g", "body").mapInArrow(_asked, "g long, i long, key long, times long")

    contexts = done.where(F.col("kind") == CONTEXT)
    others = contexts.select("g", F.explode("keys").alias("key")).join(named, "key").select("g", F.lit(0.0).alias("mass"), unigram.alias("covered"))
    taken = contexts.select("g", "mass", "covered").unionByName(others).groupBy(F.col("g").alias("key")).agg(F.sum("mass").alias("mass"), F.sum("covered").alias("covered"))
    least = F.lit(1e-9)
    backoffs = taken.select("key", F.log10(F.greatest(1 - F.col("mass"), least) / F.greatest(1 - F.col("covered"), least)).alias("cost"))
    costs = (
        done.where(F.col("kind") == SUMS).select("g", "body").groupBy("g").applyInArrow(_sums, "g long, i long, cost double")
        .unionByName(asked(BACKOFF).join(backoffs, "key").select("g", "i", "cost"))
        .unionByName(asked(UNIGRAM).join(named, "key", "left").select("g", "i", F.log10(unigram).alias("cost")))
        .groupBy("g", "i").agg(F.sum("cost").alias("score"))
    )
    terms = asked(RARE).join(named, "key", "left")
    per_text = terms.groupBy("g", "i").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(unigram)).alias("term"))
    out = done.where(F.col("kind") == TEXT).select("g", "i", "doc_id", "n_tokens", "n_head", "head_base").join(costs, ["g", "i"]).join(per_text, ["g", "i"], "left")
    return out.select(
        "doc_id",
        (fold(F.col("doc_id")) == held_out_fold).alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("term", F.lit(0.0))).alias("base_score"),
        "score",
    )
