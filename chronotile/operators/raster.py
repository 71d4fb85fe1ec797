"""Raster bytes (S10, X2): labelled image files, raw rasters and their gray levels.

A raster row is (image, height, width, channels, data): row-major bytes, channels in the order blue, green, red[, alpha] as
Spark's image source gives them. Bytes stay bytes: a batch of rasters of one shape is viewed as one NumPy array, decoded in
one pass, and given back as binary (image, height, width, data) with one gray byte for each pixel.

Cases: rows without data, with empty data, or whose length is not height x width x channels are dropped, as images that
cannot be read are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.functions.images import basename

# Weights of red, green and blue and the rounding term, in 65536ths.
RED, GREEN, BLUE, HALF = 19595, 38470, 7471, 32768

GRAY = "image string, height int, width int, data binary"


def shape_groups(*sizes: pa.Array) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Rows of equal sizes together: ((size, ...), row numbers). Rows with a null size form no group."""
    if not len(sizes[0]):
        return
    table = np.stack([s.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for s in sizes], axis=1)
    kinds, of = np.unique(table, axis=0, return_inverse=True)
    for i, kind in enumerate(kinds.tolist()):
        if min(kind) >= 0:
            yield tuple(kind), np.flatnonzero(of.reshape(-1) == i)


def stacked(data: pa.Array, rows: np.ndarray, n: int) -> np.ndarray:
    """(row, n) bytes of the rows of a binary column, each n bytes long."""
    data = data.cast(pa.large_binary())
    _, offsets, buffer = data.buffers()
    first = np.frombuffer(offsets, np.int64)[data.offset:data.offset + len(data)][rows]
    raw = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    if len(rows) and n and (np.diff(first) == n).all():
        return raw[first[0]:first[0] + n * len(rows)].reshape(len(rows), n)  # a view
    return raw[first[:, None] + np.arange(n)]


def gray_levels(pixels: np.ndarray) -> np.ndarray:
    """(..., channels) in BGR order -> gray bytes; one channel is gray already."""
    if pixels.shape[-1] == 1:
        return pixels[..., 0]
    b, g, r = (pixels[..., i].astype(np.uint32) for i in range(3))
    return ((RED * r + GREEN * g + BLUE * b + HALF) >> 16).astype(np.uint8)


def gray_images(rasters: DataFrame) -> DataFrame:
    """Rasters (image, height, width, channels, data) -> gray images (image, height, width, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("data")
            length = pa.compute.binary_length(data)
            for (h, w, c, n), rows in shape_groups(batch.column("height"), batch.column("width"), batch.column("channels"), length):
                if n == 0 or n != h * w * c or c not in (1, 3, 4):
                    continue
                gray = np.ascontiguousarray(gray_levels(stacked(data, rows, n).reshape(len(rows), h * w, c)))
                ends = pa.py_buffer((np.arange(len(rows) + 1) * h * w).astype(np.int32).tobytes())
                out = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(gray.tobytes())])
                size = [pa.array(np.full(len(rows), x, np.int32)) for x in (h, w)]
                yield pa.RecordBatch.from_arrays([batch.column("image").take(pa.array(rows)), *size, out], names=["image", "height", "width", "data"])

    cols = ["image", *[F.col(c).cast("int").alias(c) for c in ("height", "width", "channels")], "data"]
    return rasters.select(*cols).mapInArrow(run, GRAY)


def rasters_from_source(images: DataFrame) -> DataFrame:
    """Decoded images of ``spark.read.format("image")`` as rasters, named by file."""
    i = F.col("image")
    return images.select(basename(i.origin).alias("image"), i.height.alias("height"), i.width.alias("width"), i.nChannels.alias("channels"),
                         i.data.alias("data")).where("height > 0")


def labelled_images(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled image files, image struct<bytes,path> and label -> (path, bytes, label, label_name). Rows without bytes are
    dropped; a label outside the list has a null name. ``labels`` (label, label_name) is the list of classes."""
    rows = images.select(F.col("image.path").alias("path"), F.col("image.bytes").alias("bytes"), F.col("label").cast("int").alias("label"))
    return rows.where(F.col("bytes").isNotNull() & (F.octet_length("bytes") > 0)).join(labels.select("label", "label_name"), "label", "left").select(
        "path", "bytes", "label", "label_name")
