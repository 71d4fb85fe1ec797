"""Raster bytes, gray levels, cell differences, regions and overlays against plain restatements."""

import os
import struct
import tempfile
import zlib

import numpy as np
import pytest

from chronotile.operators import raster as RA
from chronotile.operators.mask import cell_diff, label_regions, mask_changes, mask_overlay, mask_regions
from chronotile.params import DEFAULT

RASTER = "image string, height int, width int, channels int, data binary"
PAIR = "event_id long, tile_col int, tile_row int, ha int, wa int, a binary, hb int, wb int, b binary"


def flood(mask, min_area):
    """Regions by flood fill, in scan order of the first cell."""
    seen, out = set(), []
    cells = set(map(tuple, np.argwhere(mask)))
    for start in sorted(cells):
        if start in seen:
            continue
        todo, region = [start], set()
        while todo:
            y, x = todo.pop()
            if (y, x) in cells and (y, x) not in region:
                region.add((y, x))
                todo += [(y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)]
        seen |= region
        ys, xs = zip(*region)
        if len(region) >= min_area:
            out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(region)))
    return out


def test_gray_of_three_different_channels_and_of_bad_rows(spark):
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (40, 6, 5, 3), dtype=np.uint8)
    rows = [(f"c{i}", 6, 5, 3, x.tobytes()) for i, x in enumerate(px)]
    rows += [("one", 2, 2, 1, b"\x00\x01\x02\xff"), ("alpha", 1, 1, 4, b"\x0a\x14\x1e\x00"), ("empty", 6, 5, 3, b""), ("none", 6, 5, 3, None),
             ("short", 6, 5, 3, b"\x00"), ("nosize", None, 5, 3, b"\x00"), ("two", 1, 1, 2, b"\x00\x00"), (None, 1, 1, 1, b"\x07")]
    got = {r.image: (r.height, r.width, bytes(r.data)) for r in RA.gray_images(spark.createDataFrame(rows, RASTER)).collect()}
    assert set(got) == {f"c{i}" for i in range(40)} | {"one", "alpha", None}
    for i, x in enumerate(px.astype(int)):
        want = (19595 * x[..., 2] + 38470 * x[..., 1] + 7471 * x[..., 0] + 32768) >> 16
        assert got[f"c{i}"] == (6, 5, bytes(want.astype(np.uint8).reshape(-1)))
    assert got["one"][2] == b"\x00\x01\x02\xff" and got["alpha"][2] == bytes([(19595 * 30 + 38470 * 20 + 7471 * 10 + 32768) >> 16])
    assert RA.gray_images(spark.createDataFrame([], RASTER)).count() == 0


def png(pixels):
    """A PNG file of RGB pixels."""
    h, w, _ = pixels.shape

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\x00" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_files_through_the_image_source(spark):
    folder = tempfile.mkdtemp(prefix="chronotile-png-")
    px = np.random.default_rng(2).integers(0, 256, (3, 4, 7, 3), dtype=np.uint8)
    for i, x in enumerate(px):
        with open(os.path.join(folder, f"{i}.png"), "wb") as f:
            f.write(png(x))
    images = spark.read.format("image").option("dropInvalid", True).load(folder)
    got = {r.image: r for r in RA.gray_images(RA.rasters_from_source(images)).collect()}
    for i, x in enumerate(px.astype(int)):
        r = got[f"{i}.png"]
        want = (19595 * x[..., 0] + 38470 * x[..., 1] + 7471 * x[..., 2] + 32768) >> 16
        assert (r.height, r.width) == (4, 7) and bytes(r.data) == bytes(want.astype(np.uint8).reshape(-1))


def test_labelled_images(spark):
    rows = [((b"ab", "x/1.png"), 0), ((b"", "2.png"), 0), ((None, "3.png"), 1), (None, 1), ((b"c", "4.png"), 7), ((b"d", None), None)]
    files = spark.createDataFrame(rows, "image struct<bytes:binary,path:string>, label long")
    names = spark.createDataFrame([(0, "AnnualCrop"), (1, "Forest")], "label int, label_name string")
    got = sorted((tuple(r) for r in RA.labelled_images(files, names).collect()), key=str)
    assert got == [("4.png", bytearray(b"c"), 7, None), ("x/1.png", bytearray(b"ab"), 0, "AnnualCrop"), (None, bytearray(b"d"), None, None)]


def test_labels_equal_flood_fill():
    rng = np.random.default_rng(3)
    spiral = np.zeros((9, 9), bool)
    spiral[0, :] = spiral[:, 8] = spiral[8, :] = spiral[2:, 0] = spiral[2, :7] = spiral[2:7, 6] = spiral[6, 2:7] = True
    for masks in (rng.random((200, 7, 5)) < 0.5, rng.random((50, 16, 16)) < 0.6, spiral[None], np.zeros((3, 4, 4), bool), np.ones((2, 1, 9), bool),
                  np.zeros((2, 0, 3), bool)):
        for area in (1, 4):
            got = label_regions(masks, area)
            boxes = list(zip(*(got[k].tolist() for k in ("row", "x0", "y0", "x1", "y1", "area"))))
            assert boxes == [(i, *b) for i, m in enumerate(masks) for b in flood(m, area)]


def test_cell_diff_of_mixed_shapes(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i in range(60):
        (ha, wa), (hb, wb) = [(8, 8), (5, 9), (1, 1)][i % 3], [(8, 8), (8, 8), (1, 1)][i // 3 % 3]
        a, b = rng.integers(0, 256, (ha, wa), dtype=np.uint8), rng.integers(0, 256, (hb, wb), dtype=np.uint8)
        rows.append((i, 0, 0, ha, wa, a.tobytes(), hb, wb, b.tobytes()))
        cy, cx = min(ha, hb) // 2, min(wa, wb) // 2
        d = np.abs(a[:cy * 2, :cx * 2].astype(int) - b[:cy * 2, :cx * 2])
        means = [float(d[2 * y:2 * y + 2, 2 * x:2 * x + 2].mean()) for y in range(cy) for x in range(cx)]
        want[i] = (cy, cx, means, bytes(m > 80 for m in means))
    out = cell_diff(spark.createDataFrame(rows, PAIR).repartition(3), 2, 80)
    assert {r.event_id: (r.cells_y, r.cells_x, list(r.cell_means), bytes(r.mask)) for r in out.collect()} == want
    regions = {r.event_id: [tuple(x) for x in r.regions] for r in mask_regions(out, 2).collect()}
    assert regions == {i: flood(np.frombuffer(m, np.uint8).reshape(cy, cx) > 0, 2) for i, (cy, cx, _, m) in want.items()}


def test_threshold_is_strict_and_small_images_have_no_cells(spark):
    b = bytes([128] * 8 + [129] * 8)  # mean difference 28 (unchanged) in the upper cells, 29 in the lower
    rows = [(1, 0, 0, 4, 4, bytes([100] * 16), 4, 4, b), (2, 0, 0, 1, 1, b"\x00", 1, 1, b"\xff")]
    out = {r.event_id: r for r in cell_diff(spark.createDataFrame(rows, PAIR), 2, 28).collect()}
    assert bytes(out[1].mask) == b"\x00\x00\x01\x01" and bytes(out[2].mask) == b"" and out[2].cells_x == 0


@pytest.mark.parametrize("size", [8, 9])
def test_masks_and_overlays_of_changes(spark, size):
    flat, spot = np.zeros((size, size), np.uint8), np.zeros((size, size), np.uint8)
    spot[:4, :4] = 255
    gray = spark.createDataFrame([("a.png", size, size, flat.tobytes()), ("b.png", size, size, spot.tobytes())], "image string, height int, width int, data binary")
    ch = spark.createDataFrame([(1, 5, 6, "x/a.png", "x/b.png"), (2, 5, 6, "a.png", "a.png"), (3, 5, 6, "", "a.png"), (4, 5, 6, "a.png", "missing.png")],
                               "event_id long, tile_col int, tile_row int, before_image string, after_image string")
    p = DEFAULT.with_(cell_size=2, diff_threshold=28, min_area=4)
    got = {r.event_id: (r.geometry_mask[:17], r.mask_image) for r in mask_changes(ch, gray, p).collect()}
    assert got == {1: ('{"type":"Polygon"', "masks/1.png"), 2: ("", ""), 3: ("", ""), 4: ("", "")}
    (o,) = mask_overlay(ch, gray, p).collect()
    px = np.frombuffer(o.rgba, np.uint8).reshape(size, size, 4)
    assert (px[..., 2] == 255).all() and (px[:4, :4, 3] == 150).all() and px[..., 3].sum() == 16 * 150
