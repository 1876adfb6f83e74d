"""Media columns: texts stored losslessly as WebP pictures, and features read from them.

A payload is laid out as RGB rows of 64 pixels and cut into pictures of at most 64 rows,
whose files follow each other in the stored form; memory and time of one picture are
bounded however long a text is, and all pictures of a batch are read side by side.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brightquay.llm.common import load, text_of
from brightquay.llm.webp import decode_many, encode_rgb

#: Pixels of a row and bytes of it; rows of a picture; pictures that are read side by side.
WIDTH, ROW, ROWS, SIDE = 64, 192, 64, 1024


def to_pictures(payload: bytes) -> list[np.ndarray]:
    """RGB pictures of a payload whose length is a multiple of ROW."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    return [rows[i : i + ROWS] for i in range(0, len(rows), ROWS)]


def split_files(stored: bytes) -> list[bytes]:
    """The files of a stored form, by the sizes that they begin with."""
    out, at = [], 0
    while at < len(stored):
        end = at + 8 + struct.unpack_from("<I", stored, at + 4)[0]
        out.append(stored[at:end])
        at = end
    return out


def store(payloads: list[bytes]) -> list[bytes]:
    """Stored form of each payload, made up to SIDE pictures at a time."""
    pictures = [to_pictures(p) for p in payloads]
    flat = [x for ps in pictures for x in ps]
    files = iter([f for i in range(0, len(flat), SIDE) for f in encode_rgb(flat[i : i + SIDE])])
    return [b"".join(next(files) for _ in ps) for ps in pictures]


def read(stored: list[bytes]) -> list[np.ndarray]:
    """The RGBA pixels of each stored form, (rows, 64, 4)."""
    files = [split_files(s) for s in stored]
    flat = [x for fs in files for x in fs]
    pictures = iter([p for i in range(0, len(flat), SIDE) for p in decode_many(flat[i : i + SIDE])])
    return [np.concatenate([next(pictures) for _ in fs]) for fs in files]


def feature_of(pixels: np.ndarray) -> str:
    """Average hash: brightness of 8 by 8 areas against their mean, as 16 hex digits."""
    grey = pixels[:, :, :3].sum(axis=2, dtype=np.int64).reshape(len(pixels), 8, 8).sum(axis=2)
    cuts = np.arange(8) * len(grey) // 8
    upto = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(grey, axis=0)])
    ends = np.maximum(np.append(cuts[1:], len(grey)), cuts + 1)
    area = (upto[ends] - upto[cuts]) / (ends - cuts)[:, None]
    return np.packbits(area > area.mean()).tobytes().hex()


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    own, n = [], 0
    for t in texts:
        own.append(t)
        n += 1 + len(t) // (ROW * ROWS)
        if n >= SIDE:
            yield own
            own, n = [], 0
    if own:
        yield own


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text as pictures, read them back, and digest what came back.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature`` per row. Null and empty texts are 192 spaces. Equal texts have
    equal values, so repeated rows do; null ids go through. Empty table, empty result;
    further columns are ignored.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for own in _groups([t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(1)]):
                stored = store([t + b" " * (-len(t) % ROW if t else ROW) for t in own])
                for text, media, pixels in zip(own, stored, read(stored), strict=True):
                    back = np.ascontiguousarray(pixels[:, :, :3]).tobytes()
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pixels)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(of, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def read_media(files: DataFrame, column: str = "content", most_pixels: int = 1 << 24) -> DataFrame:
    """Decode a binary column of lossless WebP files to ``height, width, rgba`` beside ``path``.

    Null files, unreadable ones and those that declare more than ``most_pixels`` give null pixels.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brightquay.llm.webp import WebpError, decode

        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                try:
                    p = decode(x, most_pixels) if x is not None else None
                except (WebpError, IndexError):
                    p = None
                rows.append((None, None, None) if p is None else (p.shape[0], p.shape[1], p.tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["path", "height", "width", "rgba"])

    return files.select("path", column).mapInArrow(of, "path string, height int, width int, rgba binary")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return media_digest(load(spark, sf_dir, "documents"))
