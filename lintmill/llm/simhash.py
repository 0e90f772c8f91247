"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. If two fingerprints differ in
at most two bits, some segment is equal and the segment after it (cyclically, for one of the equal
ones) differs in at most one. A key is therefore an exact segment with a fuzzy hash of the next one.

The fuzzy hash uses the perfect binary Golay code (23, 12, 7): every 23-bit word has exactly one
codeword within distance 3. The keys of a word are the indices of the codewords that decode the
word itself and its 23 neighbours, one or six of them. Two words within distance 2 have a word
between them that neighbours both, hence share a key. Candidates of a key are joined and verified.

Keys with more than ``hot`` fingerprints are linked without pairs: each fingerprint of such a key
yields itself and its 64 neighbours, and all that meet in one point are within two bits of each
other. Within two bits, two fingerprints always meet in a point, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import cut, map_arrow, pieces, utf8, words
from lintmill.llm.components import connected_components

SEED = 42
#: Widths of the segments; generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code.
SEGMENTS = (22, 21, 21)
GOLAY_GENERATOR = 0b110001110101
MAX_BITS = 2

_decoder: np.ndarray | None = None


def golay_decoder() -> np.ndarray:
    """Index of the one codeword within distance 3 of each 23-bit word."""
    global _decoder
    if _decoder is None:
        codewords = np.zeros(4096, dtype=np.uint32)
        for bit in range(12):
            codewords[1 << bit : 2 << bit] = codewords[: 1 << bit] ^ np.uint32(GOLAY_GENERATOR << bit)
        one = [1 << i for i in range(23)]
        errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
        table = np.zeros(1 << 23, dtype=np.int16)
        index = np.arange(4096, dtype=np.int16)
        for e in errors:
            table[codewords ^ np.uint32(e)] = index
        _decoder = table
    return _decoder


def fuzzy_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) for all distinct codewords near each 23-bit value."""
    flips = np.array([0, *(1 << i for i in range(23))], dtype=np.uint32)
    near = np.sort(golay_decoder()[values.astype(np.uint32)[:, None] ^ flips], axis=1)
    first = np.ones(near.shape, dtype=bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    rows, cols = np.nonzero(first)
    return rows, near[rows, cols]


def segments(fingerprints: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for width in SEGMENTS:
        out.append((fingerprints >> np.uint64(at)) & np.uint64((1 << width) - 1))
        at += width
    return out


def fingerprint_batch(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """SimHash of each text over its shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        w = words(text)
        if not w:
            continue
        before = len(hashes)
        if len(w) <= shingle:
            hashes.append(digest(b" ".join(w), SEED))
        else:
            hashes.extend(digest(b" ".join(x), SEED) for x in zip(*(w[i:] for i in range(shingle))))
        counts[k] = len(hashes) - before
    out = np.zeros(len(texts), dtype=np.uint64)
    some = np.nonzero(counts)[0]
    if len(some):
        bits = np.array(hashes, dtype=np.uint64)
        starts = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
        for bit in range(64):
            ones = np.add.reduceat(((bits >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
            out[some] |= (2 * ones.astype(np.int64) > counts[some]).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text", 4 << 20):
            prints = fingerprint_batch(utf8(piece.column("text")))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            fps = batch.column("fp").slice(start, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = segments(fps)
            for combo, exact in enumerate(parts):
                rows, index = fuzzy_keys(parts[(combo + 1) % len(parts)])
                key = (np.uint64(combo) << np.uint64(40)) | (exact[rows] << np.uint64(12)) | index.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[rows].view(np.int64))], ["key", "fp"])


def links(prints: DataFrame, hot: int = 64) -> DataFrame:
    """Edges (u, v) that join the distinct fingerprints ``prints(fp)`` within two bits, up to transitive closure."""
    keyed = cut(map_arrow(prints.select("fp"), _keys, "key long, fp long"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tagged = keyed.join(sizes, "key")
    cold = tagged.where(F.col("n") <= hot).select("key", "fp")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    pairs = cold.withColumnRenamed("fp", "u").join(cold.withColumnRenamed("fp", "v"), "key").where((F.col("u") < F.col("v")) & near).select("u", "v").distinct()
    hot_fps = tagged.where(F.col("n") > hot).select("fp").distinct()
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(-(1 << 63) if i == 63 else 1 << i).cast("long")) for i in range(64)])
    met = hot_fps.select("fp", F.explode(points).alias("point"))
    least = met.groupBy("point").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("point", "v")
    stars = met.join(least, "point").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, hot: int = 64) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints and those within two bits link; component_id is the smallest doc_id that can be
    reached. Null and empty texts have fingerprint zero. Rows with a null doc_id get the smallest
    id of their component, null if there is none.
    """
    prints = cut(map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _fingerprints, "doc_id long, fp long"))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = connected_components(links(distinct, hot))
    labelled = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    labelled = cut(labelled)
    smallest = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_print = cut(labelled.join(smallest, "label").select(F.col("fp").alias("k"), "component_id"))
    # both sides are plain exchanges, so a fingerprint that a third of the rows share is split at run time
    out = prints.join(by_print, F.col("fp") == F.col("k"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
