import math

import numpy as np

from chronotile.operators.hotspots import hotspots
from chronotile.params import FIXTURE
from chronotile.plans import stages as S

Z = 2**16


def _lon(c):
    return c / Z * 360.0 - 180.0


def _lat(r):
    return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * r / Z))))


def brute_dbscan(cols, rows, eps, min_samples):
    """Reference semantics on rows: x = lon*111.32*cos(mean lat), y = lat*111.32; inclusive eps; clusters in order
    of the first core row of (tile_col, tile_row)-sorted input; border -> first cluster reaching it."""
    order = np.lexsort((rows, cols))
    cols, rows = cols[order], rows[order]
    lon = np.array([(_lon(c) + _lon(c + 1)) / 2 for c in cols])
    lat = np.array([(_lat(r + 1) + _lat(r)) / 2 for r in rows])
    scale = 111.320 * math.cos(math.radians(float(np.mean(lat))))
    x, y = lon * scale, lat * 111.32
    d2 = (x[:, None] - x[None, :]) ** 2 + (y[:, None] - y[None, :]) ** 2
    nb = [np.nonzero(d2[i] <= eps * eps)[0] for i in range(len(x))]
    core = np.array([len(n) >= min_samples for n in nb])
    labels = np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        labels[i] = c
        while stack:
            j = stack.pop()
            if not core[j]:
                continue
            for k in nb[j]:
                if labels[k] == -1:
                    labels[k] = c
                    stack.append(k)
        c += 1
    return {(int(a), int(b)): int(l) + 1 for a, b, l in zip(cols, rows, labels)}


def test_hotspots_match_brute_force(spark, sf_small):
    ch = S.changes(spark, sf_small)
    pdf = ch.select("tile_col", "tile_row").toPandas()
    want = brute_dbscan(pdf.tile_col.to_numpy(), pdf.tile_row.to_numpy(), 15.0, 5)
    got = {(r.tile_col, r.tile_row): r.hotspot_id for r in hotspots(ch, FIXTURE).select("tile_col", "tile_row", "hotspot_id").distinct().collect()}
    # cluster numbers are canonical (first core tile order), so labels must agree exactly
    assert got == want
    assert max(got.values()) > 0


def test_hotspots_duplicates_and_border(spark):
    # three rows on one tile reach min_samples alone; a far tile is noise
    rows = [(1, 40000, 24000), (2, 40000, 24000), (3, 40000, 24000), (4, 40010, 24000), (5, 45000, 24000)]
    df = spark.createDataFrame(rows, "event_id long, tile_col int, tile_row int")
    got = {r.event_id: r.hotspot_id for r in hotspots(df, FIXTURE.with_(hotspot_min_samples=3)).collect()}
    assert got[1] == got[2] == got[3] == 1
    assert got[4] == 1  # border tile within eps of the core tile
    assert got[5] == 0


def test_hotspot_sizes_from_fixture_notes(spark, sf_small):
    """Sizes recorded for the fixtures: changes at sf0.001 (eps 15, min 5) -> 64 clusters, 248 noise rows;
    all events at sf0.01 (eps 15, min 40) -> 25 clusters, 24 border tiles, 2,178 noise rows."""
    h = hotspots(S.changes(spark, sf_small), FIXTURE)
    assert h.where("hotspot_id > 0").select("hotspot_id").distinct().count() == 64
    assert h.where("hotspot_id = 0").count() == 248

    from chronotile.operators.hotspots import tile_clusters

    p = FIXTURE.with_(hotspot_min_samples=40)
    ev = S.events(spark, "/root/testdata/sf0.01")
    tc = tile_clusters(ev, p)
    assert tc.where("hotspot_id > 0").select("hotspot_id").distinct().count() == 25
    assert tc.where("NOT is_core AND hotspot_id > 0").count() == 24
    assert tc.where("hotspot_id = 0").agg({"w": "sum"}).first()[0] == 2178
