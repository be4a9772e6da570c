"""Media columns: texts stored as baseline JPEG files, read back as thumbnails."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .shared import fresh_name, texts_to_python, trimmed

#: Bytes of payload that are coded together.
_BATCH = 256 << 10
FEATURES = "width int, height int, thumb_width int, thumb_height int, thumb_hash string, thumbnail binary"


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, with zeros appended up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def _in_batches(values: Iterator, size) -> Iterator[list]:
    held, n = [], 0
    for v in values:
        held.append(v)
        n += size(v)
        if n >= _BATCH:
            yield held
            held, n = [], 0
    if held:
        yield held


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for texts in _in_batches((t.as_py() for t in b.column(1)), lambda t: len(t or "")):
            payloads = [payload_of(t) for t in texts]
            media = jpeg.write_payloads(payloads)
            raw = [len((t or "").encode()) for t in texts]
            ids = b.column(0).slice(at, len(texts))
            at += len(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text (null: empty) losslessly as one file, a grey baseline JPEG.

    Returns ``id_col, n_bytes long, media binary``, one row per input row; ids
    may be null or repeated, other columns are not read. The file's unit is an
    8x8 block, whose DC value holds one byte. A text beyond 66 MB does not fit a
    JPEG's height and width: its file holds several pictures, one after the other.
    """
    texts_to_python(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(trimmed(_encode), f"id {id_type}, n_bytes long, media binary").withColumnRenamed("id", id_col)


FEATURE_NAMES = [f.split()[0] for f in FEATURES.split(", ")]


def _decode(batches: Iterator[pa.RecordBatch], names: list[str] = FEATURE_NAMES) -> Iterator[pa.RecordBatch]:
    """The columns of each batch, the last of which has the files, with their features."""
    types = [pa.int32()] * 4 + [pa.string(), pa.binary()]
    for b in batches:
        at = 0
        for blobs in _in_batches((m.as_py() for m in b.column(b.num_columns - 1)), lambda m: len(m or b"")):
            rows = _features(blobs)
            kept = [b.column(i).slice(at, len(blobs)) for i in range(b.num_columns)]
            at += len(blobs)
            found = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(kept + found, names=b.schema.names + names)


def _features(blobs: list[bytes | None]) -> list[tuple]:
    out: list[tuple] = [(None,) * 6] * len(blobs)
    good = []
    for i, blob in enumerate(blobs):
        try:
            good.append((i, jpeg.parse_all(blob)) if blob is not None else None)
        except (ValueError, IndexError, KeyError):
            good.append(None)
    good = [x for x in good if x]
    try:
        lights = jpeg.thumbnails([blobs[i] for i, _ in good])
    except (ValueError, IndexError, KeyError):
        lights = [_one(blobs[i]) for i, _ in good]
    for (i, parts), light in zip(good, lights, strict=True):
        if light is not None:
            out[i] = (parts[0].width, sum(p.height for p in parts), light.shape[1], light.shape[0], jpeg.thumbnail_hash(light), light.tobytes())
    return out


def _one(blob: bytes):
    try:
        return jpeg.thumbnails([blob])[0]
    except (ValueError, IndexError, KeyError):
        return None


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds dimensions, a thumbnail hash and the DC-only luminance thumbnail of each file.

    All columns of ``media`` are kept. Those added are ``width, height,
    thumb_width, thumb_height, thumb_hash, thumbnail``, with underscores in front
    where ``media`` has such a column. A null or unreadable file, or one that is
    not baseline, gets nulls.
    """
    kept = [F.col(f"`{c}`") for c in (*(c for c in media.columns if c != media_col), media_col)]
    names = [fresh_name(n, media.columns) for n in FEATURE_NAMES]
    fields = [f"`{n}` {t}" for n, t in media.select(*kept).dtypes]
    added = [f"`{n}` {f.split()[1]}" for n, f in zip(names, FEATURES.split(", "), strict=True)]
    return media.select(*kept).mapInArrow(lambda batches: _decode(batches, names), ", ".join([*fields, *added]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored files to what can be read from them, file by file."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in _decode(batches):
        cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names) if n not in ("id", "n_bytes")}
        back = [x[: jpeg.payload_length(m, len(x))] for m, x in zip(cols["media"], cols["thumbnail"], strict=True)]
        sha = [hashlib.sha256(x).hexdigest() for x in back]
        feature = [f"{w}x{h}/{t}" for w, h, t in zip(cols["width"], cols["height"], cols["thumb_hash"], strict=True)]
        values = [None, None, [len(x) for x in back], sha, [zlib.crc32(x[-64:]) for x in back], [len(x) for x in cols["media"]], [hashlib.sha256(x).hexdigest() for x in cols["media"]], feature]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)] + [pa.array(v, t) for v, t in zip(values[2:], types[2:], strict=True)], names=names)


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of what :func:`encode_media` stored, read back from the files.

    Returns ``id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature``; the payload is the decoded thumbnail.
    """
    id_type = dict(media.dtypes)[id_col]
    out = f"id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    source = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    return source.mapInArrow(trimmed(_digests), out).withColumnRenamed("id", id_col)
