"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes hashed byte trigrams (log-scaled, inverse document frequency, unit length) and a few
style measures of its words. A truncated singular value decomposition of the labelled sample gives
the latent space; every document's vector is compared with all labelled vectors by one blocked
matrix product, and the nearest neighbours vote with their labels, weighted by cosine.

The labelled sample is bounded (``per_class`` texts of each label, those with the smallest content
hash, copies of one text counted once), so what is broadcast has a fixed size. Votes are weighted
back to the labels' frequencies over all training rows. Scores use the text alone. Null and empty
texts have a vector of style measures only and are scored like others; without any
labelled row all scores are 0.5.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lintmill.llm.common import cut, fold, fresh, pieces, utf8

TRIGRAM_BITS = 11
STYLES = 12
#: Documents handled at once, so that their dense trigram counts stay small.
ROWS = 400
#: Bytes of a text counted at once.
WINDOW = 4 << 20


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    neighbours: int
    sharpness: float


def _trigrams(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte trigrams, one row a text; long texts are counted in windows that overlap by two bytes."""
    size = 1 << TRIGRAM_BITS
    if any(len(t) > WINDOW for t in texts):
        return np.vstack([sum(_trigrams([t[a : a + WINDOW + 2]]) for a in range(0, max(1, len(t) - 2), WINDOW)) if len(t) > WINDOW else _trigrams([t]) for t in texts])
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts) + b"\0\0", dtype=np.uint8).astype(np.uint32)
    code = data[:-2] | (data[1:-1] << np.uint32(8)) | (data[2:] << np.uint32(16))
    slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(owner))
    inside = left >= 3
    return np.bincount(owner[inside] * size + slot[inside], minlength=len(texts) * size).reshape(len(texts), size).astype(np.float32)


def _style(text: bytes) -> list[float]:
    """Measures of the words and characters of one text, each between 0 and 1."""
    w = text.split()
    n, size = len(w), len(text)
    if not n:
        return [1.0] + [0.0] * (STYLES - 1)
    same = sum(map(operator.eq, w, w[1:])) / n
    distinct = len(set(w)) / n
    letters = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) / size
    upper, lower = letters[65:91].sum(), letters[97:123].sum()
    marks = letters[33:48].sum() + letters[58:65].sum() + letters[91:97].sum() + letters[123:127].sum()
    return [
        0.0,
        same,
        1 - distinct,
        upper / (upper + lower + 1e-9),
        min(1.0, 4 * marks),
        min(1.0, 8 * letters[48:58].sum()),
        min(1.0, size / n / 24),
        min(1.0, 20 * letters[124]),
        min(1.0, 20 * letters[33]),
        min(1.0, 20 * (letters[35] + letters[36] + letters[37] + letters[42])),
        min(1.0, 50 * letters[10]),
        0.3,
    ]


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _trigrams(texts), np.array([_style(t) for t in texts], dtype=np.float32)


def _weighted(counts: np.ndarray, styles: np.ndarray, idf: np.ndarray) -> np.ndarray:
    terms = np.log1p(counts) * idf
    terms /= np.maximum(np.linalg.norm(terms, axis=1, keepdims=True), 1e-9)
    return np.hstack([terms, styles])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in _small(batch):
            counts, styles = _features(utf8(piece.column("text")))
            rows = [np.concatenate([c, s]).astype(np.float32).tobytes() for c, s in zip(counts, styles, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("label"), pa.array(rows, pa.binary())], ["label", "features"])


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batch, "text", 2 << 20):
        for start in range(0, piece.num_rows, ROWS):
            yield piece.slice(start, ROWS)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = 1500, dimensions: int = 48, neighbours: int = 25, sharpness: float = 6.0) -> Model | None:
    """A model from the texts of ``docs`` outside fold 0 that ``labels(doc_id, <label>)`` marks 0 or 1; None if there are none.

    Only ids and content hashes are shuffled; the chosen texts are then picked out of a second scan by a
    broadcast of at most 2 * per_class hashes.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    hashed = docs.where(fold(F.col("doc_id")) != 0).select("doc_id", F.xxhash64("text").alias("h"))
    once = cut(hashed.join(marks, "doc_id").groupBy("h", "label").agg(F.count("*").alias("n")))
    totals = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    chosen = None
    for value in sorted(totals):  # two labels at most; a sorted limit keeps per_class rows a task
        part = once.where(F.col("label") == value).orderBy("h").limit(per_class).select(F.col("h").alias("k"), "label")
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    sample = texts.join(F.broadcast(chosen), F.col("h") == F.col("k")).dropDuplicates(["h", "label"])
    rows = sample.select("label", "text").mapInArrow(_counted, "label int, features binary").collect()
    rows = sorted((r["label"], bytes(r["features"])) for r in rows)
    labels = np.array([r[0] for r in rows], dtype=np.float32)
    matrix = np.vstack([np.frombuffer(r[1], dtype=np.float32) for r in rows])
    counts, styles = matrix[:, :-STYLES], matrix[:, -STYLES:]
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.2)
    x = _weighted(counts, styles, idf)
    basis = _svd(x, dimensions)
    share = {label: n / max(1, int((labels == label).sum())) for label, n in totals.items()}
    weights = np.array([share[int(y)] for y in labels], dtype=np.float32)
    return Model(idf, basis, _unit(x @ basis).astype(np.float32), labels, weights / weights.mean(), float((weights * labels).sum() / weights.sum()), neighbours, sharpness)


def _svd(x: np.ndarray, k: int) -> np.ndarray:
    """The first right singular vectors, by subspace iteration with a fixed start."""
    rng = np.random.default_rng(7)
    k = min(k, *x.shape)
    q = rng.standard_normal((x.shape[1], min(k + 12, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :k].astype(np.float32)


def vote(model: Model, texts: list[bytes]) -> np.ndarray:
    """Score of each text: the similarity-weighted share of label 1 among the nearest labelled texts."""
    vectors = _unit(_weighted(*_features(texts), model.idf) @ model.basis).astype(np.float32)
    similar = vectors @ model.vectors.T
    k = min(model.neighbours, similar.shape[1])
    if len(similar) and k < similar.shape[1]:
        # labelled texts as near as the k-th all stand on one side of the line: the first in the order of label and features
        kth = -np.partition(-similar, k - 1, axis=1)[:, k - 1 : k]
        rank = np.where(similar > kth, 2.0, np.where(similar == kth, 1.0, 0.0)) * similar.shape[1] - np.arange(similar.shape[1]) / similar.shape[1]
        near = np.argpartition(-rank, k - 1, axis=1)[:, :k]
    else:
        near = np.broadcast_to(np.arange(k), (len(similar), k))
    weight = np.maximum(np.take_along_axis(similar, near, axis=1), 0).astype(np.float64) ** model.sharpness * model.weights[near]
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight * model.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), model.prior)


def score(docs: DataFrame, model: Model | None, column: str = "quality_score") -> DataFrame:
    """``docs`` with a score of each row's whole ``text``; other columns pass through unchanged."""
    if model is None:
        return docs.withColumn(column, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _small(batch):
                scores = vote(shared.value, utf8(piece.column("text")))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores)], [*piece.schema.names, column])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, **options)
    scored = score(docs.select("doc_id", F.col("text").cast("string")), model, "score")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; columns unchanged."""
    model = fit(docs, labels, **options)
    own = fresh(docs, "quality_score")
    return score(docs, model, own).where(F.col(own) >= threshold).drop(own)
