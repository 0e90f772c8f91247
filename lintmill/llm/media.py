"""Media columns: interleaved document sequences with payloads resolved by digest.

``parse_sequence`` reads a page into an ordered list of text and media-reference structs; captions
and alternative texts stay with their reference and positions count both kinds. References name
their payload by its SHA-256 digest; a join on the digest brings what the store says about the payload.
``sequences`` puts the resolved structs back in page order.

The store keeps payloads as PNG images of 8-bit grey samples, 192 a row, losslessly. It is a table
in the shared folder; payloads are read back from it and each is decoded once, however many
references it has, and only its figures travel to the join.

Null and empty texts give one row of 192 spaces. A reference whose digest is not stored stays in its place
with null figures; pages without references keep their texts; null pages have no items.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lintmill.llm.common import cut, pieces, shared_path, utf8
from lintmill.llm.markup import walk

WIDTH = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "position int, kind string, text string, digest string, caption string"
FIGURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"

_DIGEST = re.compile(r"media:([0-9a-f]{64})$")
_BREAKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "figure", "blockquote", "td", "th", "tr", "ul", "ol", "table", "br"}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of ``WIDTH``."""
    return text + b" " * (max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG of the payload's bytes, ``WIDTH`` a row, each row unfiltered."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The samples of a PNG that ``encode_png`` wrote; every checksum is verified."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, width, height, packed = len(_SIGNATURE), 0, 0, []
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("bad checksum")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey images without interlace are stored here")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are stored here")
    return lines[:, 1:]


def feature(image: np.ndarray) -> str:
    """Whole-number figures of an image: size, sum, spread, changes along and across rows, and a histogram in 8 bins."""
    wide = image.astype(np.int64)
    histogram = np.bincount(image.ravel() >> 5, minlength=8)
    along, across = int(np.abs(np.diff(wide, axis=1)).sum()), int(np.abs(np.diff(wide, axis=0)).sum())
    return f"{image.shape[1]}x{image.shape[0]};sum={int(wide.sum())};sq={int((wide * wide).sum())};dx={along};dy={across};hist=" + ",".join(map(str, histogram.tolist()))


def parse_sequence(page: str | None) -> list[dict]:
    """Ordered items of a page: {position, kind: text or media, text, digest, caption}."""
    items: list[dict] = []
    parts: list[str] = []
    figure, captioning = None, False

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if not text:
            return
        if captioning and figure is not None and figure < len(items):
            for item in items[figure:]:
                item["caption"] = f"{item['caption'] or ''} {text}".strip()
        else:
            items.append({"position": len(items), "kind": "text", "text": text, "digest": None, "caption": None})

    for kind, value, attributes, _ in walk(page or ""):
        if kind == "text":
            parts.append(value)
        elif value in ("img", "audio", "video", "source"):
            if kind == "open" and (digest := _DIGEST.match(attributes.get("src", ""))):
                close()
                items.append({"position": len(items), "kind": "media", "text": None, "digest": digest.group(1), "caption": " ".join(attributes.get("alt", "").split())})
        elif value == "figcaption":
            close()
            captioning = kind == "open"
        elif value in _BREAKS:
            close()
            if value == "figure":
                figure = None if kind == "close" else len(items)
    close()
    return items


def parse_pages(pages: DataFrame) -> DataFrame:
    """``pages(page, html, ...)`` with ``items`` in the place of ``html``; other columns pass through."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    others = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html"):
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in others), pa.array([parse_sequence(x) for x in piece.column("html").to_pylist()], kind)], [*others, "items"])

    return pages.mapInArrow(run, StructType([*(f for f in pages.schema.fields if f.name != "html"), StructField("items", ArrayType(StructType.fromDDL(ITEM)))]))


def read_store(store: DataFrame) -> DataFrame:
    """Figures of each payload in ``store(digest, media)``, decoded from the stored bytes; one row a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "media"):
                out = []
                for digest, media in zip(piece.column("digest").to_pylist(), piece.column("media").to_pylist(), strict=True):
                    image = decode_png(media)
                    payload = image.tobytes()
                    out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), feature(image)))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in FIGURES.split(", ")])

    return store.mapInArrow(run, FIGURES).dropDuplicates(["digest"])


def sequences(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """``pages(page, html, ...)`` with ``sequence`` in the place of ``html``: the page's items in order, media items with their payload's figures.

    A page's items meet again in one row, as they were in its html. Items are dealt by digest, and those without one by their page,
    so neither texts nor a payload that many pages refer to gather in one task (the latter is split at run time).
    """
    parsed = cut(parse_pages(pages).withColumn("row", F.monotonically_increasing_id()))
    others = [c for c in parsed.columns if c != "items"]
    items = parsed.select(*others, F.explode_outer("items").alias("item"))
    key = F.coalesce("item.digest", F.concat(F.lit("-"), F.col("row").cast("string")))
    known = figures.withColumnRenamed("digest", "stored_digest")
    joined = items.join(known, key == F.col("stored_digest"), "left")
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]
    entry = F.struct(*[F.col(f"item.{c}").alias(c) for c in ("position", "kind", "text", "digest", "caption")], *names)
    whole = joined.groupBy(*others).agg(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), entry))).alias("sequence"))
    return whole.select(*[c for c in others if c != "row"], "sequence")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page that names the document and refers to its text's payload, and the payload's media where this task has not given it yet."""
    given: set[str] = set()
    for batch in batches:
        for piece in pieces(batch, "text"):
            ids, out = piece.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, utf8(piece.column("text")), strict=True):
                media = encode_png(padded(text))
                digest = hashlib.sha256(media).hexdigest()
                if len(given) > 500_000:
                    given.clear()
                page = f'<h1>Document {doc_id}</h1><figure><img src="media:{digest}" alt="grey samples"><figcaption>its text</figcaption></figure>'
                out.append((doc_id, len(text), page, digest, None if digest in given else media))
                given.add(digest)
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page", "n_bytes", "html", "digest", "media"])


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: its payload's figures and ``sequence``, found by way of store, page and digest join.

    The media of a sequence stands after the heading that names the document. Repeated rows give repeated results.
    """
    path = shared_path(docs.sparkSession, "media")
    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_store, "page long, n_bytes long, html string, digest string, media binary").write.parquet(path)
    stored = docs.sparkSession.read.parquet(path)
    figures = cut(read_store(stored.where("media is not null").select("digest", "media")))
    media = F.filter("sequence", lambda x: x["kind"] == "media")[0]
    whole = sequences(stored.select("page", "n_bytes", "html"), figures).withColumn("media", media)
    return whole.select(
        F.col("page").alias("doc_id"),
        "n_bytes",
        *[F.col(f"media.{c}").alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes")],
        F.col("media.digest").alias("media_sha256"),
        "media.feature",
        "sequence",
    )
