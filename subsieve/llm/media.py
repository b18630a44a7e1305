"""Media columns: texts as PNG images in a binary column, and perceptual hashes of such images.

An image is 64 pixels wide, eight bits each of red, green and blue, so a line holds 192 bytes of payload.
Encoding picks per line the filter none, sub or up with the least sum of absolute differences; decoding
tests signature, chunk order and every checksum and undoes all five filters. The feature is a hash of the
lowest cosine frequencies of the brightness, averaged to 32 x 32: bit k is 1 where coefficient k is above
the median.

Defined results: a null text counts as empty; the payload is never empty (192 spaces for an empty text); a text is
stored whole however long it is; equal payloads, those of repeated rows too, give equal images and features; a
damaged image raises ``ValueError``; an empty table gives an empty table; a column of an output's name is replaced
and all other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from .common import arrow_map, beside, blobs

WIDTH, CHANNELS = 64, 3
LINE = WIDTH * CHANNELS
SIGNATURE = b"\x89PNG\r\n\x1a\n"


#: Rows that are held as images at once.
ROWS = 512


def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, ROWS) for k in range(0, b.num_rows, ROWS))


def payload(raw: bytes) -> bytes:
    """``raw`` and spaces up to a positive multiple of a line."""
    return raw.ljust(max(LINE, -(-len(raw) // LINE) * LINE), b" ")


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: bytes, level: int = 6) -> bytes:
    """An 8-bit RGB image of width ``WIDTH`` whose samples are exactly ``samples``."""
    lines = np.frombuffer(samples, np.uint8).reshape(-1, LINE)
    sub, up = lines.copy(), lines.copy()
    sub[:, CHANNELS:] -= lines[:, :-CHANNELS]
    up[1:] -= lines[:-1]
    ways = (lines, sub, up)
    best = np.argmin([np.abs(w.view(np.int8).astype(np.int16)).sum(1) for w in ways], axis=0)
    out = np.empty((len(lines), LINE + 1), np.uint8)
    out[:, 0] = best
    for k, w in enumerate(ways):
        out[best == k, 1:] = w[best == k]
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(png):
            raise ValueError("the image ends within a chunk")
        n, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + n]
        if len(body) < n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        at += 12 + n
        yield kind, body
    if at != len(png):
        raise ValueError("bytes follow the image's end")


def unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the filters of scan lines whose first byte names the filter. Lines with none, sub or up go by runs."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    n, width = out.shape
    sub = kinds == 1
    if sub.any():
        px = out[sub].reshape(int(sub.sum()), -1, bpp)
        out[sub] = np.cumsum(px, axis=1, dtype=np.uint8).reshape(-1, width)
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), n] if n else []
    for a, b in zip(edges, edges[1:]):
        k = kinds[a]
        if k == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif k > 2:
            for r in range(a, b):
                above = out[r - 1].astype(int).tolist() if r else [0] * width
                row = out[r].tolist()
                for x in range(width):
                    left, up, corner = (row[x - bpp] if x >= bpp else 0), above[x], (above[x - bpp] if x >= bpp else 0)
                    if k == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                    row[x] = (row[x] + guess) & 255
                out[r] = row
    return out


def decode_png(png: bytes) -> np.ndarray:
    """Samples of an 8-bit grey or RGB image without interlacing, as (lines, pixels, channels)."""
    parts = list(chunks(png))
    if parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise ValueError("the image has no header")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    if depth != 8 or colour not in (0, 2) or interlaced:
        raise ValueError("only 8-bit grey or RGB without interlacing is read")
    bpp = 3 if colour == 2 else 1
    data = zlib.decompress(b"".join(body for kind, body in parts if kind == b"IDAT"))
    if len(data) != height * (width * bpp + 1):
        raise ValueError("the image has another size than its header says")
    return unfilter(np.frombuffer(data, np.uint8).reshape(height, width * bpp + 1), bpp).reshape(height, width, bpp)


SIDE, LOW = 32, 8
_K = np.arange(SIDE)
COSINES = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:LOW, None] / (2 * SIDE))


def averaging(n: int, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each of ``side`` bands over n lines; short images repeat lines."""
    start = np.arange(side) * n // side
    return start, np.maximum((np.arange(1, side + 1) * n + side - 1) // side - start, 1)


def dct_hash(samples: np.ndarray) -> bytes:
    """Eight bytes: signs, against their median, of the 8 x 8 lowest cosine frequencies of the brightness."""
    grey = samples.sum(2, dtype=np.float64)
    for axis in (0, 1):
        total = np.concatenate([np.zeros_like(grey.take([0], axis)), np.cumsum(grey, axis)], axis)
        start, count = averaging(grey.shape[axis])
        shape = (-1, 1) if axis == 0 else (1, -1)
        grey = (total.take(start + count, axis) - total.take(start, axis)) / count.reshape(shape)
    low = np.round(COSINES @ grey @ COSINES.T, 6).ravel()
    low[0] = 0.0  # the mean brightness says nothing of the structure
    return np.packbits(low > np.median(low)).tobytes()


#: What can be put beside an image: type and value from (stored bytes, bytes read back, samples read back).
OUTPUTS = {
    "payload": (BinaryType(), pa.binary(), lambda png, back, px: back),
    "payload_bytes": (LongType(), pa.int64(), lambda png, back, px: len(back)),
    "payload_sha256": (StringType(), pa.string(), lambda png, back, px: hashlib.sha256(back).hexdigest()),
    "tail_crc32": (LongType(), pa.int64(), lambda png, back, px: zlib.crc32(back[-16:])),
    "media_bytes": (LongType(), pa.int64(), lambda png, back, px: len(png)),
    "media_sha256": (StringType(), pa.string(), lambda png, back, px: hashlib.sha256(png).hexdigest()),
    "feature": (StringType(), pa.string(), lambda png, back, px: dct_hash(px).hex()),
    "dct_hash": (BinaryType(), pa.binary(), lambda png, back, px: dct_hash(px)),
}


def to_media(docs: DataFrame, text: str = "text", keep: list[str] | None = None, output: str = "png") -> DataFrame:
    """``docs`` (or its columns ``keep``) with its texts as images in a binary column. No shuffle."""
    source, keep, schema = beside(docs, text, keep, [StructField(output, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                made = pa.array([encode_png(payload(raw)) for raw in blobs(part.column(part.num_columns - 1))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*keep, output])

    return arrow_map(source, run, schema)


def from_media(media: DataFrame, png: str = "png", keep: list[str] | None = None, outputs: tuple[str, ...] = ("dct_hash",)) -> DataFrame:
    """``media`` (or its columns ``keep``) with the ``outputs`` of the images in its column ``png``, decoded; null for null."""
    source, keep, schema = beside(media, png, keep, [StructField(o, OUTPUTS[o][0]) for o in outputs])
    wanted = [OUTPUTS[o] for o in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                rows = []
                for x in part.column(part.num_columns - 1).to_pylist():
                    if x is None:
                        rows.append([None] * len(wanted))
                        continue
                    px = decode_png(x)
                    back = px.tobytes()
                    rows.append([f(x, back, px) for _, _, f in wanted])
                made = [pa.array(x, kind) for x, (_, kind, _) in zip(zip(*rows, strict=True) if rows else [[]] * len(wanted), wanted, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*keep, *outputs])

    return arrow_map(source, run, schema)
