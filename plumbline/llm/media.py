"""Media columns: PNG images in binary columns, read with numpy, and low-frequency cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a pixel by the colour type of the header.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _predict(rows: np.ndarray, step: int) -> list[np.ndarray]:
    """The filtered rows under the five row filters."""
    wide = rows.astype(np.int16)
    left = np.zeros_like(wide)
    left[:, step:] = wide[:, :-step]
    up = np.zeros_like(wide)
    up[1:] = wide[:-1]
    corner = np.zeros_like(wide)
    corner[1:, step:] = wide[:-1, :-step]
    pa_, pb, pc = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    paeth = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, up, corner))
    return [((wide - p) & 255).astype(np.uint8) for p in (np.zeros_like(wide), left, up, (left + up) >> 1, paeth)]


def encode_png(samples: np.ndarray, *, filters: str = "none", level: int = 6) -> bytes:
    """A lossless PNG of an (h, w) or (h, w, channels) array of 8-bit samples.

    filters: "none", or "adaptive" for the filter with the least sum of signed magnitudes in each row.
    """
    h, w = samples.shape[:2]
    channels = samples.shape[2] if samples.ndim == 3 else 1
    rows = np.ascontiguousarray(samples, np.uint8).reshape(h, w * channels)
    out = np.zeros((h, w * channels + 1), np.uint8)
    if filters == "adaptive":
        options = np.stack(_predict(rows, channels))
        cost = np.minimum(options.astype(np.int64), 256 - options.astype(np.int64)).sum(2)
        best = cost.argmin(0)
        out[:, 0] = best
        out[:, 1:] = options[best, np.arange(h)]
    else:
        out[:, 1:] = rows
    colour = {v: k for k, v in CHANNELS.items()}[channels]
    header = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters. Runs of rows of one kind go through numpy at once where rows allow it."""
    if not kinds.any():
        return rows
    out = rows.copy()
    h, width = rows.shape
    at = 0
    while at < h:
        to = at + 1
        while to < h and kinds[to] == kinds[at]:
            to += 1
        kind = kinds[at]
        if kind == 1:
            run = out[at:to].reshape(to - at, width // step, step)
            out[at:to] = np.cumsum(run, axis=1, dtype=np.uint8).reshape(to - at, width)
        elif kind == 2:
            if at:
                out[at] += out[at - 1]
            out[at:to] = np.cumsum(out[at:to], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(at, to):
                up = out[y - 1].astype(np.int64) if y else np.zeros(width, np.int64)
                line = out[y].astype(np.int64)
                for x in range(0, width, step):
                    here, above = slice(x, x + step), up[x : x + step]
                    left = line[x - step : x] if x else np.zeros(step, np.int64)
                    if kind == 3:
                        line[here] = (line[here] + ((left + above) >> 1)) & 255
                    else:
                        corner = up[x - step : x] if x else np.zeros(step, np.int64)
                        a, b, c = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
                        line[here] = (line[here] + np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))) & 255
                out[y] = line
        elif kind:
            raise ValueError(f"row filter {kind} is unknown")
        at = to
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit PNG without interlace or palette. Raises ValueError for a wrong signature, checksum or length."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or len(data) < at + 12 + size or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise ValueError("header or end is missing")
    w, h, depth, colour, _, _, interlace = header
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError("only 8-bit samples without palette or interlace can be read")
    channels = CHANNELS[colour]
    flat = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(flat) != h * (w * channels + 1):
        raise ValueError("the samples are incomplete")
    lines = flat.reshape(h, w * channels + 1)
    rows = _unfilter(lines[:, 0], lines[:, 1:], channels)
    return rows.reshape(h, w, channels) if channels > 1 else rows


def _cosines(n: int, keep: int) -> np.ndarray:
    grid = np.pi * (2 * np.arange(n) + 1) / (2 * n)
    return np.cos(np.outer(np.arange(keep), grid))


def _shrink(samples: np.ndarray, size: int) -> np.ndarray:
    """Means of size bands along the first axis; with fewer rows, rows repeat."""
    h = len(samples)
    if h < size:
        return samples[np.arange(size) * h // size].astype(np.float64)
    edges = np.arange(size + 1) * h // size
    return np.add.reduceat(samples.astype(np.float64), edges[:-1], axis=0) / np.diff(edges)[:, None]


def cosine_hash(samples: np.ndarray, size: int = 32, keep: int = 8) -> str:
    """keep * keep bits as hex: which low-frequency cosine coefficients of the shrunk image exceed their median."""
    grey = samples if samples.ndim == 2 else samples[..., :3].mean(2)
    small = _shrink(_shrink(grey, size).T, size).T
    c = _cosines(size, keep)
    low = (c @ small @ c.T).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def text_payload(raw: bytes, unit: int = 64) -> bytes:
    """The bytes, padded by zeros to a positive multiple of unit."""
    return raw + bytes(-len(raw) % unit if raw else unit)


def with_text_image(df: DataFrame, text: str = "text", *, width: int = 64, out: str = "media", level: int = 6) -> DataFrame:
    """Replaces a text column by n_bytes and a PNG whose grey samples are the padded UTF-8 bytes, width in a row.

    Null: as empty, which gives one row of zeros. Other columns stay, but for those named n_bytes or as out, which are replaced.
    """
    df = df.drop(*({"n_bytes", out} - {text}))
    schema = T.StructType([f for f in df.schema if f.name != text] + [T.StructField("n_bytes", T.LongType()), T.StructField(out, T.BinaryType())])
    others = [f.name for f in df.schema if f.name != text]
    wide = df.select(*others, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                sizes, images = [], []
                for raw in part.column(text).to_pylist():
                    sizes.append(len(raw))
                    images.append(encode_png(np.frombuffer(text_payload(raw, width), np.uint8).reshape(-1, width), level=level))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + [pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], [*others, "n_bytes", out])

    return wide.mapInArrow(run, schema)


def with_image_features(df: DataFrame, media: str = "media", *, unit: int = 64) -> DataFrame:
    """Adds what the stored image holds: payload_bytes, payload_sha256, tail_crc32 (last unit bytes), media_bytes,
    media_sha256 and feature (cosine_hash); drops the image. A null image gives nulls; a damaged one fails the task.
    Columns that had these names are replaced.
    """
    kinds = [("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string())]
    df = df.drop(*({n for n, _, _ in kinds} - {media}))
    others = [f.name for f in df.schema if f.name != media]
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(n, t) for n, t, _ in kinds])

    def features(image: bytes | None) -> tuple:
        if image is None:
            return (None,) * len(kinds)
        samples = decode_png(image)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-unit:]), len(image), hashlib.sha256(image).hexdigest(), cosine_hash(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, media):
                rows = [features(x) for x in part.column(media).to_pylist()]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + [pa.array(list(v), t) for v, (_, _, t) in zip(columns, kinds, strict=True)], [*others, *(n for n, _, _ in kinds)])

    return df.mapInArrow(run, schema)
