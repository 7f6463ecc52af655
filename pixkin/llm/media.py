"""Media columns of progressive JPEG: payloads are stored as coefficients, pictures are read to full-resolution RGB tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixkin.llm import jpeg
from pixkin.llm.common import small_batches

UNIT = 64
#: Bytes of rows that a task hands on at once.
BATCH_BYTES = 4_000_000


def padded(text: str | None) -> bytes:
    """UTF-8 and bytes 0 up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, bytes_ = [], 0
    for row in rows:
        held.append(row)
        bytes_ += size(row)
        if bytes_ >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, bytes_ = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def store_texts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes (of the text alone), media: a progressive JPEG that holds the padded text. A null text is an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((key, len((t.as_py() or "").encode("utf-8", "surrogatepass")), jpeg.encode_payload(padded(t.as_py()))) for b in batches for key, t in zip(b.column(0).to_pylist(), b.column(1)))
        yield from batches_of(rows, schema, lambda r: len(r[2]))

    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_pictures(media: DataFrame, *, column: str = "media") -> DataFrame:
    """The rows with height, width, rgb (height x width x 3 bytes, row by row), means (of R, G and B), payload and error.

    ``payload`` is what encode_payload stored, null in other pictures. A file that can't be read, or a null, gives nulls and an error;
    its row stays.
    """
    carry = [c for c in media.columns if c not in ("height", "width", "rgb", "means", "payload", "error")]
    more = [("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()), ("means", pa.list_(pa.float64())), ("payload", pa.binary()), ("error", pa.string())]
    kinds = dict(media.dtypes)
    made = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", height int, width int, rgb binary, means array<double>, payload binary, error string"

    def read(data: bytes | None) -> tuple:
        try:
            if data is None:
                raise ValueError("no media")
            picture = jpeg.decode(data)
            rgb = picture.rgb()
            payload = jpeg.payload_of(picture) if picture.comment.startswith(b"payload ") else None
        except (ValueError, KeyError, IndexError, StopIteration) as e:
            return None, None, None, None, None, str(e) or type(e).__name__
        return picture.height, picture.width, rgb.tobytes(), [float(x) for x in rgb.reshape(-1, 3).mean(0, dtype=np.float64)], payload, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([*b.schema, *more])
            at, n, size = 0, b.num_rows, b.schema.get_field_index(column)
            while at < n:
                rows, held = [], 0
                while at + len(rows) < n and held < BATCH_BYTES:
                    rows.append(read(b.column(size)[at + len(rows)].as_py()))
                    held += len(rows[-1][2] or b"") + len(rows[-1][4] or b"")
                part = b.slice(at, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), more))], schema=schema)
                at += len(rows)

    return media.select(*carry).mapInArrow(run, made)


def media_report(docs: DataFrame) -> DataFrame:
    """The digest of texts stored as pictures and read back; feature: size, mean colour and checksum of the RGB tensor."""
    read = read_pictures(store_texts(docs))
    tail = F.expr("substring(payload, greatest(1, octet_length(payload) - 63), 64)")
    feature = F.concat(
        F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), *[x for i in range(3) for x in (F.lit(":"), F.format_string("%.4f", F.get("means", F.lit(i))))], F.lit(":"), F.lower(F.hex(F.crc32("rgb")))
    )
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
