"""Media columns: progressive JPEG in, full-resolution RGB tensors out.

A null or empty text is a payload of 64 zero bytes. Equal texts give equal media. Repeated rows give repeated results,
an empty table an empty one. A media value that is null, no progressive
JPEG, broken or of more than jpeg.MOST_PIXELS pixels has null in every decoded column.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import sha256_hex, small_batches, texts


def padded(text: str | None) -> tuple[bytes, int]:
    """The text in UTF-8 with zero bytes up to a positive multiple of 64, and its own length."""
    data = (text or "").encode("utf-8")
    return data + b"\0" * ((-len(data)) % jpeg.BLOCK or (jpeg.BLOCK if not data else 0)), len(data)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a progressive JPEG."""

    def work(batches):
        for b in small_batches(batches):
            both = [padded(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in both], pa.int64()), pa.array([jpeg.encode_payload(p) for p, _ in both], pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_bytes long, media binary")


def load(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, height, width, rgb: tensors as height * width * 3 bytes, row by row, for any progressive JPEG column."""

    def work(batches):
        for b in small_batches(batches, "media", 1 << 20):
            out = []
            for data in b.column("media").to_pylist():
                try:
                    image = jpeg.decode(data) if data else None
                except ValueError:
                    image = None
                out.append((image.height, image.width, image.rgb().tobytes()) if image else (None, None, None))
            h, w, rgb = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(rgb, pa.binary())], ["doc_id", "height", "width", "rgb"])

    return media.selectExpr(f"`{id_col}` AS doc_id", f"`{media_col}` AS media").mapInArrow(work, "doc_id long, height int, width int, rgb binary")


def feature(rgb) -> str:
    """Height, width, and the mean of each channel to a thousandth."""
    h, w, _ = rgb.shape
    mean = rgb.reshape(-1, 3).sum(0, dtype="int64") * 1000 // (h * w)
    return f"{h}x{w}:" + ",".join(str(x) for x in mean.tolist())


def digests(stored: DataFrame) -> DataFrame:
    """What op1 returns, from the stored bytes: each file is decoded to its tensor, of which only features leave."""

    def work(batches):
        for b in small_batches(batches, "media", 1 << 20):
            rows = []
            for data in b.column("media").to_pylist():
                image = jpeg.decode(data)
                payload = jpeg.payload_of(image)
                rows.append((len(payload), sha256_hex(payload), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(image.rgb())))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_progressive_jpeg(spark, sf_dir: str) -> DataFrame:
    return digests(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op1_progressive_jpeg": op1_progressive_jpeg}
ORACLES: dict[str, str] = {}
