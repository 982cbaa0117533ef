"""Media columns: texts as DC-only baseline JPEGs, and features of their thumbnails."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solarweave.llm import jpeg
from solarweave.llm.batches import by_batch, octets, spans

UNIT = 192


def padded(text: bytes) -> bytes:
    """text and bytes 32 up to a positive multiple of UNIT."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def small(plane: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of the samples in each of rows x columns cells; a cell has one sample at least."""
    for axis, n in ((0, rows), (1, columns)):
        size = plane.shape[axis]
        lower = np.minimum(np.arange(n) * size // n, size - 1)
        upper = np.maximum((np.arange(n) + 1) * size // n, lower + 1)
        sums = np.concatenate((np.zeros_like(np.take(plane, [0], axis), np.int64), np.cumsum(plane, axis=axis, dtype=np.int64)), axis=axis)
        counts = (upper - lower).reshape((-1, 1) if axis == 0 else (1, -1))
        plane = (np.take(sums, upper, axis) - np.take(sums, lower, axis)) // counts
    return plane


def thumbnail_hashes(plane: np.ndarray) -> tuple[str, str]:
    """Mean hash and gradient hash of a luminance plane, 64 bits each."""
    mean, slope = small(plane, 8, 8), small(plane, 8, 9)
    bits = (mean > mean.mean(), slope[:, 1:] > slope[:, :-1])
    return tuple(np.packbits(b.ravel()).tobytes().hex() for b in bits)


def media_features(files: list[bytes]) -> list[dict]:
    """Of each baseline JPEG (or several in one file): width, height, thumbnail and its hashes.

    Images of one file stand one below the other; a file whose images differ in width, or
    that is no baseline JPEG, raises ValueError.
    """
    out = []
    for own in jpeg.read(files):
        plane = np.concatenate([p for _, _, p in own])
        mean, slope = thumbnail_hashes(plane)
        out.append({"width": own[0][0], "height": sum(h for _, h, _ in own), "thumbnail": plane, "mean_hash": mean, "slope_hash": slope})
    return out


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", media: bool = True) -> DataFrame:
    """Each row's text stored as JPEG and read back; with the media itself unless media is False.

    Columns: key, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of what was read
    back), media_bytes, media_sha256, width, height, mean_hash, slope_hash, feature[, media].
    The payload is the text in UTF-8 and spaces up to a multiple of 192 bytes. A byte is the
    grey of one block. Null texts count as empty; texts beyond 1.5 MB take several images in
    one file. Equal texts give equal values. Rows stay in their tasks; nothing is shuffled.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    schema = f"k {rows.schema['k'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, mean_hash string, slope_hash string, feature string" + ", media binary" * media

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            texts = octets(batch.column("t"))
            out: dict[str, list] = {f: [] for f in "n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 width height mean_hash slope_hash feature media".split()}
            for a, b in spans([len(t) + UNIT for t in texts], 1 << 20):
                files = jpeg.write([np.frombuffer(padded(t), np.uint8) for t in texts[a:b]])
                for t, f, m in zip(texts[a:b], files, media_features(files), strict=True):
                    payload = m["thumbnail"].tobytes()
                    for name, v in (
                        ("n_bytes", len(t)), ("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-16:])),
                        ("media_bytes", len(f)), ("media_sha256", hashlib.sha256(f).hexdigest()), ("width", m["width"]), ("height", m["height"]), ("mean_hash", m["mean_hash"]), ("slope_hash", m["slope_hash"]),
                        ("feature", f"{m['width']}x{m['height']}:{m['mean_hash']}:{m['slope_hash']}"), ("media", f),
                    ):
                        out[name].append(v)
            return {"k": batch.column("k")} | out

        return each

    return by_batch(rows, schema, start).withColumnRenamed("k", key)
