"""Media columns: texts stored as lossless WebP images and read back to pixel arrays.

``store`` turns binary payloads into media: 8-bit samples in rows of 64, in an image of as many rows as the format can
have (16,384, a payload of one MiB), further rows in further images behind it. ``decode`` reads media of one or more
lossless WebP images of one width, which stand below each other, to their width, height and pixels.

Defined cases: a null text is an empty one; the payload always has at least one row; payloads of any length are stored
whole; equal texts give equal media and features; repeated rows repeat; an empty table stays empty. A null medium gives
null pixels, and so does one that is damaged, whose ``error`` says why; it doesn't stop the others. Columns of the input stay, but those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import webp
from umbra.llm.common import slices, table

ROW = 64
#: Rows of an image at most, by the format.
MAX_ROWS = 16_384


def padded(text: str | None) -> tuple[bytes, int]:
    """(the text's bytes with zeros up to a positive multiple of ``ROW``, their number without the zeros)"""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW)), len(raw)


def to_media(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8)
    tile = ROW * MAX_ROWS
    return b"".join(webp.write_grey(samples[at : at + tile], ROW) for at in range(0, len(samples), tile))


def images(media: bytes) -> Iterator[bytes]:
    """The files that a medium consists of, by the lengths in their heads."""
    at = 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at:end]
        at = end


def pixels_of(media: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, pixels) of all of a medium's images below each other."""
    read = [webp.read(x) for x in images(media)]
    if len({width for width, *_ in read}) != 1:
        raise ValueError("no image, or images of different widths")
    return read[0][0], sum(height for _, height, _ in read), np.concatenate([pixels for *_, pixels in read])


def from_media(media: bytes) -> bytes:
    return (pixels_of(media)[2] >> 8).astype(np.uint8).tobytes()


def _shown(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 4
    try:
        width, height, pixels = pixels_of(media)
    except (ValueError, IndexError, struct.error) as damage:
        return None, None, None, str(damage) or type(damage).__name__
    return width, height, pixels.astype("<u4").tobytes(), None


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy and number of different samples."""
    count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = count / count.sum()
    level = np.arange(256)
    mean = float(share @ level)
    deviation = float(share @ (level - mean) ** 2) ** 0.5
    some = share[share > 0]
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={-float(some @ np.log2(some)) + 0.0:.4f};levels={len(some)}"


def store(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_bytes`` of each whole text and its stored form ``media``."""
    kept = [x for x in df.columns if x not in ("n_bytes", "media")]
    schema = df.select(kept).schema.add("n_bytes", "long").add("media", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [padded(x) for x in batch.column(text).to_pylist()]
            arrays = [pa.array([n for _, n in made], pa.int64()), pa.array([to_media(x) for x, _ in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *arrays], [*kept, "n_bytes", "media"])

    return df.mapInArrow(work, schema)


def decode(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with ``width``, ``height``, ``pixels`` (little-endian 32-bit ARGB values) and ``error`` of each medium."""
    fields = [("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]
    names = [name for name, _ in fields]
    kept = [x for x in df.columns if x not in names]
    schema = df.select(kept).schema.add("width", "integer").add("height", "integer").add("pixels", "binary").add("error", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            made = list(zip(*map(_shown, batch.column("_media").to_pylist()), strict=True)) or [()] * len(fields)
            arrays = [pa.array(values, kind) for values, (_, kind) in zip(made, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *arrays], [*kept, *names])

    return df.withColumn("_media", F.col(media)).mapInArrow(work, schema)


def read_back(df: DataFrame, media: str = "media") -> DataFrame:
    """Digests and features of what the stored bytes hold, instead of the stored bytes."""
    kept = [x for x in df.columns if x != media]
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = df.select(kept).schema
    for name, kind in fields:
        schema = schema.add(name, "long" if kind == pa.int64() else "string")

    def digest(stored: bytes) -> tuple:
        payload = from_media(stored)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(*map(digest, batch.column(media).to_pylist()), strict=True)) or [()] * len(fields)
            arrays = [pa.array(values, kind) for values, (_, kind) in zip(made, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *arrays], [*kept, *(name for name, _ in fields)])

    return df.mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
