"""Images as tables: stored files, packed arrays, pixel rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import checkpoint

#: Rows of an image that are emitted at once.
BAND = 64


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, height, width, channels, data) of the image files under a path, decoded by Spark; image_id is the
    file's address, data row-major with channels in the order blue, green, red. Files that are no images are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select(
        F.col("image.origin").alias("image_id"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data")
    )


def to_pixels(images: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b), a row for each pixel; gray images repeat their channel and alpha is left out.

    An image whose data is not height * width * channels bytes gives an error. Rows go out in bands, so no image is
    held as one list of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w, n = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                data = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8).reshape(h, w, n)
                bgr = data[..., :3] if n >= 3 else np.repeat(data[..., :1], 3, axis=2)
                for top in range(0, h, BAND):
                    part = bgr[top : top + BAND].astype(np.int32)
                    y, x = np.divmod(np.arange(part.shape[0] * w, dtype=np.int32), np.int32(w))
                    ident = batch.column(0).take(pa.array(np.full(len(x), i)))
                    yield pa.RecordBatch.from_arrays([ident, pa.array(x), pa.array(y + np.int32(top)), *(pa.array(np.ascontiguousarray(part[..., c].ravel())) for c in (2, 1, 0))], ["image_id", "x", "y", "r", "g", "b"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "height", "width", "channels", "data").mapInArrow(run, f"image_id {kind}, x int, y int, r int, g int, b int")


def pack_images(pixels: DataFrame) -> DataFrame:
    """Pixel rows of full images -> (image_id, height, width, channels, data), the form that read_images gives."""
    hexed = F.format_string("%02x%02x%02x", "b", "g", "r")
    rows = pixels.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", hexed.alias("h")))).alias("l"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return rows.select("image_id", "height", "width", F.lit(3).alias("channels"), F.unhex(F.array_join(F.col("l.h"), "")).alias("data"))


def png_bytes(pixels: np.ndarray) -> bytes:
    """An array (h, w, 1, 3 or 4) of gray, red-green-blue or red-green-blue-alpha bytes as a PNG file."""
    h, w, n = pixels.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * n)], axis=1)  # each line after its filter, none

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_images(images: DataFrame, path: str) -> DataFrame:
    """Write images (image_id, height, width, channels, data), as read_images gives them, as PNG files and return (image_id,
    file). path: the address of a folder that all executors reach. A file is named by its image's id, which is to be
    unique and fit for a name; a task that runs again writes the same file again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            names = [f"{v}.png" for v in batch.column(0).to_pylist()]
            for i, name in enumerate(names):
                h, w, n = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                data = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8).reshape(h, w, n)
                rgb = data if n == 1 else np.concatenate([data[..., 2::-1], data[..., 3:]], axis=2)
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(png_bytes(rgb))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{path}/{name}" for name in names], pa.string())], ["image_id", "file"])

    kind = images.schema["image_id"].dataType.simpleString()
    return checkpoint(images.select("image_id", "height", "width", "channels", "data").mapInArrow(run, f"image_id {kind}, file string"))
