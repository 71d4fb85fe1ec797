"""Change masks: cell differences, connected regions, region polygons and overlays.

Per event the work is bounded by the image size (a 256x256 tile with 16-pixel cells is 256 cells), so each row is
independent: no shuffle beyond joining the two gray images to the event. Images and masks are bytes; cell means, region
labels and overlays are Arrow passes over all rows of a batch that share a shape; polygons are Spark higher-order
functions over the few regions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotile.functions import geo
from chronotile.functions.images import basename
from chronotile.operators.raster import shape_groups, stacked
from chronotile.params import Params

REGION = T.StructType([
    T.StructField("x0", T.IntegerType()), T.StructField("y0", T.IntegerType()),
    T.StructField("x1", T.IntegerType()), T.StructField("y1", T.IntegerType()),
    T.StructField("area", T.IntegerType()),
])


def image_pairs(changes: DataFrame, gray: DataFrame) -> DataFrame:
    """Events with both gray images: event_id, tile_col, tile_row, ha, wa, a, hb, wb, b (a = before; a, b are bytes)."""
    g = gray.select("image", "height", "width", "data")
    before = g.select(F.col("image").alias("_bi"), F.col("height").alias("ha"), F.col("width").alias("wa"), F.col("data").alias("a"))
    after = g.select(F.col("image").alias("_ai"), F.col("height").alias("hb"), F.col("width").alias("wb"), F.col("data").alias("b"))
    c = changes.where((F.col("before_image") != "") & (F.col("after_image") != "")).select(
        "event_id", "tile_col", "tile_row", basename("before_image").alias("_bi"), basename("after_image").alias("_ai"))
    return c.join(before, "_bi").join(after, "_ai").drop("_bi", "_ai")


def cell_diff(pairs: DataFrame, cell: int, threshold: float) -> DataFrame:
    """Crop both images to the common size, drop partial edge cells, mean |a - b| per cell; a cell changes when
    its mean is strictly above the threshold. Replaces a and b by h, w, cells_y, cells_x, cell_means and mask (a byte for each
    cell, 0 or 1, row-major). All pairs of a batch that have one shape are one array."""
    kept = [f for f in pairs.schema.fields if f.name not in ("a", "b")]
    sizes = ["h", "w", "cells_y", "cells_x"]
    schema = T.StructType([*kept, *[T.StructField(c, T.IntegerType()) for c in sizes], T.StructField("cell_means", T.ArrayType(T.DoubleType())),
                           T.StructField("mask", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (ha, wa, hb, wb), rows in shape_groups(*[batch.column(c) for c in ("ha", "wa", "hb", "wb")]):
                h, w, n = min(ha, hb), min(wa, wb), len(rows)
                cy, cx = h // cell, w // cell
                a = stacked(batch.column("a"), rows, ha * wa).reshape(n, ha, wa)[:, :cy * cell, :cx * cell].astype(np.int16)
                b = stacked(batch.column("b"), rows, hb * wb).reshape(n, hb, wb)[:, :cy * cell, :cx * cell]
                sums = np.abs(a - b).reshape(n, cy, cell, cx, cell).sum(axis=(2, 4), dtype=np.int64)
                means = sums.reshape(n, cy * cx) / float(cell * cell)
                mask = (means > float(threshold)).astype(np.uint8)
                ends = (np.arange(n + 1) * cy * cx).astype(np.int32)
                cols = [batch.column(f.name).take(pa.array(rows)) for f in kept] + [pa.array(np.full(n, x, np.int32)) for x in (h, w, cy, cx)]
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(means.reshape(-1))))
                cols.append(pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(mask.tobytes())]))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return pairs.mapInArrow(run, schema)


def label_regions(masks: np.ndarray, min_area: int) -> dict[str, np.ndarray]:
    """4-neighbour connected regions of many masks (mask, y, x): arrays row, x0, y0, x1, y1 (exclusive), area, by mask and first
    cell in scan order; regions below min_area dropped. Every cell takes the smallest number around it, then the number of
    the cell that it names, until nothing changes."""
    n, hgt, wid = masks.shape
    outside = masks.size
    own = np.arange(outside).reshape(masks.shape)
    label = np.where(masks, own, outside)
    while True:
        low = label.copy()
        for here, there in (((slice(None), slice(1, None)), (slice(None), slice(None, -1))), ((slice(None), slice(None, -1)), (slice(None), slice(1, None))),
                            ((slice(None), slice(None), slice(1, None)), (slice(None), slice(None), slice(None, -1))),
                            ((slice(None), slice(None), slice(None, -1)), (slice(None), slice(None), slice(1, None)))):
            low[here] = np.minimum(low[here], label[there])
        low = np.where(masks, low, outside)
        low = np.append(low.reshape(-1), outside)[low]
        if (low == label).all():
            break
        label = low
    cell = np.flatnonzero(masks)
    order = np.argsort(label.reshape(-1)[cell], kind="stable")
    cell = cell[order]
    names, first, area = np.unique(label.reshape(-1)[cell], return_index=True, return_counts=True)
    if not len(names):
        return {k: np.zeros(0, np.int64) for k in ("row", "x0", "y0", "x1", "y1", "area")}
    y, x = cell // wid % hgt, cell % wid
    out = {"row": names // (hgt * wid), "x0": np.minimum.reduceat(x, first), "y0": np.minimum.reduceat(y, first),
           "x1": np.maximum.reduceat(x, first) + 1, "y1": np.maximum.reduceat(y, first) + 1, "area": area}
    return {k: v[area >= min_area] for k, v in out.items()}


def _masks(batch: pa.RecordBatch, *more: str) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, ...]]]:
    """Masks of a batch by shape: (row numbers, masks, sizes of the named columns)."""
    for (cy, cx, *sizes), rows in shape_groups(*[batch.column(c) for c in ("cells_y", "cells_x", *more)]):
        yield rows, stacked(batch.column("mask"), rows, cy * cx).reshape(len(rows), cy, cx) > 0, tuple(sizes)


def mask_regions(diffs: DataFrame, min_area: int) -> DataFrame:
    """Adds ``regions`` array<struct<x0,y0,x1,y1,area>> (exclusive max, scan order of the first cell)."""
    cols = ["event_id", "tile_col", "tile_row", "ha", "wa", "cells_x", "cells_y", "mask"]
    slim = diffs.select(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, masks, _ in _masks(batch):
                found = label_regions(masks, min_area)
                boxes = pa.StructArray.from_arrays([pa.array(found[f.name].astype(np.int32)) for f in REGION.fields], names=REGION.names)
                ends = np.searchsorted(found["row"], np.arange(len(rows) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in cols], pa.ListArray.from_arrays(pa.array(ends), boxes)],
                                                 names=[*cols, "regions"])

    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField("regions", T.ArrayType(REGION))]))


def region_polygons(df: DataFrame, zoom: int = 16) -> DataFrame:
    """Adds ``polygons``: per region the lon/lat box ring, from fractions of the tile (cells after cropping)."""

    def poly(r):
        u0 = r["x0"].cast("double") / F.col("cells_x")
        u1 = r["x1"].cast("double") / F.col("cells_x")
        v0 = r["y0"].cast("double") / F.col("cells_y")
        v1 = r["y1"].cast("double") / F.col("cells_y")
        west = geo.col_to_lon(F.col("tile_col") + u0, zoom)
        east = geo.col_to_lon(F.col("tile_col") + u1, zoom)
        north = geo.row_to_lat(F.col("tile_row") + v0, zoom)
        south = geo.row_to_lat(F.col("tile_row") + v1, zoom)
        return geo.ring(west, south, east, north)

    return df.withColumn("polygons", F.transform("regions", poly))


def geometry_json(polygons: Column) -> Column:
    """'' without regions; one region -> Polygon; several -> MultiPolygon."""
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.element_at(polygons, 1)).alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.transform(polygons, lambda r: F.array(r)).alias("coordinates")))
    return F.when(F.size(polygons) == 0, F.lit("")).when(F.size(polygons) == 1, single).otherwise(multi)


def mask_changes(changes: DataFrame, gray: DataFrame, p: Params, of: DataFrame | None = None) -> DataFrame:
    """Changes with ``geometry_mask`` (GeoJSON text or '') and ``mask_image`` ('masks/{id}.png' or ''). ``of``: a stored table of the
    same events, tiles and images, which the masks are made from, so that what made ``changes`` does not run a second time."""
    d = mask_regions(cell_diff(image_pairs(changes if of is None else of, gray), p.cell_size, p.diff_threshold), p.min_area)
    d = region_polygons(d, p.zoom)
    per_event = d.select(
        "event_id",
        geometry_json(F.col("polygons")).alias("geometry_mask"),
        F.when(F.size("regions") > 0, F.concat(F.lit("masks/"), F.col("event_id").cast("string"), F.lit(".png"))).otherwise(F.lit("")).alias("mask_image"),
    )
    base = changes.drop("geometry_mask", "mask_image")
    j = base.join(per_event, "event_id", "left")
    return j.select(*base.columns, F.coalesce("geometry_mask", F.lit("")).alias("geometry_mask"),
                    F.coalesce("mask_image", F.lit("")).alias("mask_image"))


def _overlays(cell: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, masks, (h, w) in _masks(batch, "ha", "wa"):
                up = masks.repeat(cell, axis=1).repeat(cell, axis=2)[:, :h, :w]
                rgba = np.zeros((len(rows), h, w, 4), np.uint8)  # what the cells do not cover stays transparent
                rgba[..., 2] = 255
                rgba[:, :up.shape[1], :up.shape[2], 3] = np.where(up, 150, 0)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("event_id", "wa", "ha")] + [pa.array([x.tobytes() for x in rgba], pa.binary())],
                                                 names=["event_id", "width", "height", "rgba"])

    return run


def mask_overlay(changes: DataFrame, gray: DataFrame, p: Params) -> DataFrame:
    """RGBA overlay per event with regions: event_id, width, height, rgba (changed cells blue, alpha 150)."""
    d = mask_regions(cell_diff(image_pairs(changes, gray), p.cell_size, p.diff_threshold), p.min_area)
    d = d.where(F.size("regions") > 0)
    return d.mapInArrow(_overlays(p.cell_size), "event_id long, width int, height int, rgba binary")

