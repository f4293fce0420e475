"""Media columns: Netpbm and BMP images in numpy, area-resized tiles, difference hashes.

``decode_image`` reads binary and plain PBM, PGM and PPM (8 and 16 bits) and uncompressed
BMP (1, 4, 8, 24, 32 bits). Resizing takes exact area means from an integral image. Tiles
are NPY bytes; the difference hash compares neighbours of a 9 x 8 area-resized image.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts, read_table

#: Payloads fill whole blocks of so many bytes, and rows of so many samples.
BLOCK, WIDTH = 576, 24
TILE = 16

_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary PGM of an array height x width of bytes."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, dtype=np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """BMP, 8 bits with a grey palette for height x width, 24 bits for height x width x 3."""
    height, width = samples.shape[:2]
    depth = 8 if samples.ndim == 2 else 24
    rows = samples if samples.ndim == 2 else samples[:, :, ::-1].reshape(height, width * 3)
    body = np.pad(rows.astype(np.uint8), ((0, 0), (0, -rows.shape[1] % 4)))[::-1].tobytes()
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if depth == 8 else b""
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, 0, len(body), 2835, 2835, len(palette) // 4, 0)
    return head + info + palette + body


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    while len(head) < (2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("Netpbm header ends early")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = (*head, 1)[:3]
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if kind == 1:
        bits = re.findall(rb"[01]", re.sub(rb"#[^\r\n]*", b"", data[at:]))
        flat = 255 - 255 * np.array(bits[:n], dtype=np.uint8)
    elif kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
    elif kind == 4:
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        flat = 255 - 255 * np.unpackbits(raw, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if len(flat) < n:
        raise ValueError("Netpbm samples end early")
    if kind not in (1, 4) and top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    shape = (height, width) if depth == 1 else (height, width, 3)
    return flat.astype(np.uint8).reshape(shape)


def _decode_bmp(data: bytes) -> np.ndarray:
    start, info, width, height = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<Iii", data, 14)
    depth, packing = struct.unpack_from("<HI", data, 28)
    if packing != 0 or depth not in (1, 4, 8, 24, 32):
        raise ValueError("only uncompressed BMP of 1, 4, 8, 24 or 32 bits")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if depth >= 24:
        return raw[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1].copy()
    if depth == 8:
        index = raw[:, :width]
    else:
        bits = np.unpackbits(raw, axis=1).reshape(rows, -1, depth)
        index = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2)[:, :width]
    colours = (start - 14 - info) // 4
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + info).reshape(colours, 4)[:, 2::-1]
    image = palette[index]
    grey = (image[..., 0] == image[..., 1]).all() and (image[..., 1] == image[..., 2]).all()
    return image[..., 0].copy() if grey else image


def decode_image(data: bytes) -> np.ndarray:
    """height x width, or height x width x 3, of bytes. Other data raise ValueError."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, with fractional borders, read from an integral image."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), len(table) - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    ys = np.arange(height + 1) * (image.shape[0] / height)
    xs = np.arange(width + 1) * (image.shape[1] / width)
    corner = at(xs, at(ys, total).T).T
    sums = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return sums * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 8 cells is brighter than its right neighbour."""
    small = np.round(resize_area(grey(image), 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.round(resize_area(grey(image), side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def payload_image(payload: bytes, form: str = "pgm") -> bytes:
    """The padded payload as the samples of an image of WIDTH columns."""
    padded = payload + b"\xff" * (max(BLOCK, -(-len(payload) // BLOCK) * BLOCK) - len(payload))
    samples = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
    return encode_pgm(samples) if form == "pgm" else encode_bmp(samples)


MEDIA = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("media", T.BinaryType()),
        T.StructField("tile", T.BinaryType()),
        T.StructField("feature", T.StringType()),
    ]
)
DIGEST = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("tile_sha256", T.StringType()),
    ]
)


def media_columns(docs: DataFrame, form: str = "pgm", key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n_bytes, media (the stored image), tile (NPY bytes), feature (difference hash).

    A null or empty text is one block of bytes 255. Repeated rows and null keys stay; other
    columns are not read. Equal texts give equal values. Narrow: no shuffle.
    """

    def compute(texts: list[str]) -> dict[str, list]:
        raw = [t.encode() for t in texts]
        media = [payload_image(x, form) for x in raw]
        images = [decode_image(x) for x in media]
        return {
            "n_bytes": [len(x) for x in raw],
            "media": media,
            "tile": [npy_tile(x) for x in images],
            "feature": [difference_hash(x) for x in images],
        }

    return map_texts(docs, [key], text_col, MEDIA, compute)


def media_digests(docs: DataFrame, form: str = "pgm", key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As media_columns, with the stored bytes and the tile as sizes and digests."""

    def compute(texts: list[str]) -> dict[str, list]:
        rows = []
        for text in texts:
            raw = text.encode()
            media = payload_image(raw, form)
            image = decode_image(media)
            back = image.tobytes()
            sha = hashlib.sha256
            rows.append(
                (
                    len(raw),
                    len(back),
                    sha(back).hexdigest(),
                    zlib.crc32(back[-32:]),
                    len(media),
                    sha(media).hexdigest(),
                    difference_hash(image),
                    sha(npy_tile(image)).hexdigest(),
                )
            )
        return dict(zip(DIGEST.fieldNames(), zip(*rows, strict=True), strict=True))

    return map_texts(docs, [key], text_col, DIGEST, compute)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read_table(spark, sf_dir, "documents"))
