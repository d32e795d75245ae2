"""Media columns: PNG images in binary columns, written and read here, and low-frequency cosine-transform hashes.

``encode_png`` writes 8-bit grey images (adaptive row filters, zlib, several IDAT chunks); ``decode_png`` tests the
signature, every chunk's checksum, the order of chunks and the stream's own checksum, and undoes all five filters with
numpy. ``dct_hash`` is a 64-bit perceptual hash: the signs of the 8 by 8 lowest frequencies against their median.

``payloads`` stores any bytes in such a column: a text as UTF-8, filled up with bytes 255 to a positive multiple of 576,
is an image of 576 samples a row.

Cases: a null text is stored as an empty one; a null doc_id is kept; repeated rows and equal texts give equal values;
an empty table gives an empty result; other columns are ignored. A damaged image raises ``ValueError``; ``read_images``
reports it as a row with an error instead. No shuffle; memory is one text and its image at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binaries, per_batch

UNIT = 576
#: The feature of a payload is taken over rows of 24 samples, 24 of them a unit, so that short texts have two dimensions.
TILE = 24
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 16


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """A 2-D uint8 array as PNG. Each row gets the filter (none, sub or up) with the smallest sum of residuals."""
    h, w = image.shape
    left = image.copy()
    left[:, 1:] -= image[:, :-1]
    up = image.copy()
    up[1:] -= image[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for x in (image, left, up)])
    best = cost.argmin(axis=0)
    rows = np.empty((h, w + 1), np.uint8)
    rows[:, 0] = best
    for k, x in enumerate((image, left, up)):
        rows[best == k, 1:] = x[best == k]
    data = zlib.compress(rows.tobytes(), level)
    body = b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey, not interlaced PNG; ValueError says what is wrong with any other."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG: signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(data):
        if ended or at + 12 > len(data):
            raise ValueError("broken chunk")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r}")
        if (head is None) != (kind == b"IHDR"):
            raise ValueError("IHDR must come first, once")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 0x20:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if head is None or not ended or not parts:
        raise ValueError("IHDR, IDAT or IEND is missing")
    w, h, *form = head
    if form != [8, 0, 0, 0, 0] or not w or not h:
        raise ValueError("only 8-bit grey without interlacing")
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(parts), h * (w + 1) + 1)
        raw += inflate.flush()
    except zlib.error as e:
        raise ValueError(f"image data: {e}") from e
    if len(raw) != h * (w + 1) or not inflate.eof:
        raise ValueError("image data has the wrong length")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(h, w + 1))


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo PNG filters of one-byte samples. Runs of rows of one kind are done at once where they can be."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)], strict=True):
        kind = kinds[a] if b > a else 0
        if kind == 2:
            from_row = max(a - 1, 0)  # the row above, decoded, heads the sum; above the first row is zero
            out[a:b] = np.cumsum(out[from_row:b], axis=0, dtype=np.uint8)[a - from_row :]
        elif kind >= 3:
            for y in range(a, b):
                above = out[y - 1].astype(np.int64) if y else np.zeros(out.shape[1], np.int64)
                out[y] = (_average if kind == 3 else _paeth)(out[y], above)
    return out


def _average(row: np.ndarray, above: np.ndarray) -> list[int]:
    left, got = 0, []
    for x, b in zip(row.tolist(), above.tolist(), strict=True):
        left = (x + (left + b) // 2) & 255
        got.append(left)
    return got


def _paeth(row: np.ndarray, above: np.ndarray) -> list[int]:
    left = corner = 0
    got = []
    for x, b in zip(row.tolist(), above.tolist(), strict=True):
        p = left + b - corner
        pa_, pb, pc = abs(p - left), abs(p - b), abs(p - corner)
        left = (x + (left if pa_ <= pb and pa_ <= pc else b if pb <= pc else corner)) & 255
        corner = b
        got.append(left)
    return got


def _cosines(n: int, k: int = 8) -> np.ndarray:
    """The first ``k`` rows of the type II cosine transform of length ``n``."""
    return np.cos(np.pi * np.arange(k)[:, None] * (2 * np.arange(n) + 1) / (2 * n))


def shrink(image: np.ndarray, side: int = 32) -> np.ndarray:
    """Means over ``side`` by ``side`` nearly equal cells; short axes repeat their samples."""
    x = image.astype(np.float64)
    for axis in (0, 1):
        n = x.shape[axis]
        if n < side:
            x = np.repeat(x, -(-side // n), axis=axis)
            n = x.shape[axis]
        cuts = np.arange(side + 1) * n // side
        x = np.add.reduceat(x, cuts[:-1], axis=axis) / np.diff(cuts).reshape((-1, 1) if axis == 0 else (1, -1))
    return x


_C = _cosines(32)


def dct_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: which of the 8 by 8 lowest frequencies lie above their median (the mean set aside)."""
    low = (_C @ shrink(image) @ _C.T).round(6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = low[0] > 32 * 32 * 127.5
    return np.packbits(bits).tobytes().hex()


def store(text: bytes | None) -> tuple[bytes, bytes]:
    """The payload of a text and its PNG."""
    text = text or b""
    payload = text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))
    return payload, encode_png(np.frombuffer(payload, np.uint8).reshape(-1, UNIT))


def _payloads(batch: pa.RecordBatch) -> dict:
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    out: dict = {"doc_id": batch.column("doc_id")} | {n: [] for n in names}
    for t in binaries(batch.column("text")):
        media = store(t)[1]
        image = decode_png(media)
        back = image.tobytes()
        for n, v in zip(names, (len(t or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), dct_hash(image.reshape(-1, TILE))), strict=True):
            out[n].append(v)
    return out


def payloads(docs: DataFrame) -> DataFrame:
    """Store every text as an image, read it back, and describe what was read."""
    return per_batch(docs.select("doc_id", "text"), _payloads, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def text_images(docs: DataFrame) -> DataFrame:
    """The texts as a binary column ``media`` of images, and their length."""

    def write(b: pa.RecordBatch) -> dict:
        texts = binaries(b.column("text"))
        return {"doc_id": b.column("doc_id"), "n_bytes": [len(t or b"") for t in texts], "media": [store(t)[1] for t in texts]}

    return per_batch(docs.select("doc_id", "text"), write, "doc_id long, n_bytes long, media binary")


def read_images(images: DataFrame) -> DataFrame:
    """Decode a binary column ``media``: its samples, size and hash, or the error (null images are errors too)."""

    def read(b: pa.RecordBatch) -> dict:
        got = []
        for m in b.column("media").to_pylist():
            try:
                if m is None:
                    raise ValueError("null")
                x = decode_png(m)
                got.append((x.shape[1], x.shape[0], x.tobytes(), dct_hash(x), None))
            except ValueError as e:
                got.append((None, None, None, None, str(e)))
        return {"doc_id": b.column("doc_id")} | dict(zip(("width", "height", "samples", "feature", "error"), zip(*got, strict=True) if got else [[]] * 5, strict=True))

    return per_batch(images.select("doc_id", "media"), read, "doc_id long, width long, height long, samples binary, feature string, error string")


def op4_png_media(spark, sf_dir: str) -> DataFrame:
    return payloads(spark.read.parquet(f"{sf_dir}/documents.parquet"))
