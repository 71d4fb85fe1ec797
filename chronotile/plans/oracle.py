"""DuckDB oracle SQL for the registered queries, built from shared CTEs.

Each CTE names its dependencies; ``build(body, *ctes)`` emits ``WITH`` in dependency order. The fixture CTEs
(``events``, ``snaps``) are the shared mapping of FIXTURES.md; everything after them re-states the operator
semantics in plain SQL, independently of the Spark code. Doubles are rounded to 9 decimals in outputs.
"""

from __future__ import annotations

from chronotile.sources.fixtures import LABELS

CTES: dict[str, tuple[list[str], str]] = {}
RECURSIVE: set[str] = set()
HEADS: dict[str, str] = {}


def cte(name: str, deps: list[str], sql: str, recursive: bool = False, head: str | None = None) -> None:
    CTES[name] = (deps, sql)
    if recursive:
        RECURSIVE.add(name)
    if head:
        HEADS[name] = head


def build(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    head = "WITH RECURSIVE " if RECURSIVE & set(order) else "WITH "
    ctes = ",\n".join(f"{HEADS.get(n, n)} AS (\n{CTES[n][1]}\n)" for n in order)
    stripped = body.lstrip()
    if stripped.upper().startswith("WITH "):
        return head + ctes + ",\n" + stripped[5:]
    return head + ctes + "\n" + body


def r9(expr: str, alias: str | None = None) -> str:
    return f"round({expr}, 9) AS {alias or expr}"


def dot(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE), "
            f"lambda p, q: p + q, 0.0::DOUBLE)")


def sqn(a: str) -> str:
    return f"list_reduce(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE), lambda p, q: p + q, 0.0::DOUBLE)"


def sqn_diff(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(list_zip({a}, {b}), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * "
            f"(x[1]::DOUBLE - x[2]::DOUBLE)), lambda p, q: p + q, 0.0::DOUBLE)")


def col_to_lon(c: str) -> str:
    return f"(({c})::DOUBLE / 65536.0 * 360.0 - 180.0)"


def row_to_lat(r: str) -> str:
    return f"degrees(atan(sinh(pi() * (1.0 - 2.0 * ({r})::DOUBLE / 65536.0))))"


def basename(x: str) -> str:
    return f"regexp_replace({x}, '^.*/', '')"


def img_name(t: str) -> str:
    return (f"{t}.tile_col::VARCHAR || '_' || {t}.tile_row::VARCHAR || '_' || "
            f"regexp_replace({t}.release_id, '[^A-Za-z0-9._-]', '_', 'g') || '.' || {t}.ext")


cte("events", [], """
  WITH o AS (
    SELECT o_orderkey AS id, o_custkey AS k, CAST(o_orderdate AS DATE) AS d0,
           CAST(o_orderdate AS DATE) + CAST((o_orderkey * 13) % 400 + 20 AS INT) AS d1,
           CAST(floor(o_custkey / 25) AS BIGINT) AS q, o_custkey % 25 AS c
    FROM orders),
  t AS (
    SELECT id, d0, d1, CAST(d0 AS VARCHAR) AS s0, CAST(d1 AS VARCHAR) AS s1,
      CAST(CASE WHEN k % 7 = 0 THEN 41500 + (k * 131) % 20011
                ELSE 37600 + (c % 5) * 600 + (q * 37) % 121 - 60 END AS INT) AS tile_col,
      CAST(CASE WHEN k % 7 = 0 THEN 20000 + (k * 57) % 9973
                ELSE 24400 + CAST(floor(c / 5) AS BIGINT) * 240 + (q * 53) % 121 - 60 END AS INT) AS tile_row
    FROM o)
  SELECT id, tile_col, tile_row,
    'WB ' || substr(s0, 1, 4) || '/' || substr(s0, 6, 2) AS from_release_id, s0 || 'T00:00:00' AS from_date,
    'WB ' || substr(s1, 1, 4) || '/' || substr(s1, 6, 2) AS to_release_id,
    CASE WHEN id % 211 = 0 THEN '' ELSE s1 || 'T00:00:00' END AS to_date,
    s1 || 'T12:00:00' AS detected_at,
    CAST(id % 97 AS DOUBLE) / 97 AS ssim_score,
    CAST(id % 100 AS DOUBLE) / 100 AS change_ratio,
    CAST(id % 9 AS INT) AS largest_run
  FROM t""")

cte("snaps", ["events"], """
  WITH r AS (
    SELECT from_release_id AS release_id, tile_col, tile_row FROM events
    UNION SELECT to_release_id, tile_col, tile_row FROM events),
  v AS (SELECT *, CAST(substr(release_id, 4, 4) AS INT) * 12 + CAST(substr(release_id, 9, 2) AS INT) AS m FROM r)
  SELECT release_id, tile_col, tile_row, CAST((tile_col * 31 + tile_row * 17 + m * 7) % (SELECT max(vec_id) + 1 FROM embeddings) AS BIGINT) AS vec_id,
    CASE WHEN (tile_col + m) % 3 = 0 THEN 'png' ELSE 'jpg' END AS ext
  FROM v WHERE (tile_col + tile_row + m) % 23 <> 0""")

cte("snapnames", ["snaps"], f"""
  SELECT s.*, {img_name('s')} AS image, 'images/' || {img_name('s')} AS image_path FROM snaps s""")

cte("pairs", ["events", "snaps"], f"""
  SELECT e.id AS event_id, e.tile_col, e.tile_row, e.from_release_id, e.from_date, e.to_release_id, e.to_date,
    e.detected_at, e.ssim_score, e.change_ratio, e.largest_run,
    0 AS land_windows, 0 AS water_windows, 0.0::DOUBLE AS ssim_min, 0.0::DOUBLE AS ssim_p05,
    0.0::DOUBLE AS embedding_similarity, 0 AS embedding_computed, '' AS from_land_cover, '' AS to_land_cover,
    coalesce('images/' || {img_name('b')}, '') AS before_image,
    coalesce('images/' || {img_name('a')}, '') AS after_image
  FROM events e
  LEFT JOIN snaps b ON b.release_id = e.from_release_id AND b.tile_col = e.tile_col AND b.tile_row = e.tile_row
  LEFT JOIN snaps a ON a.release_id = e.to_release_id AND a.tile_col = e.tile_col AND a.tile_row = e.tile_row""")

cte("imgvec", ["snapnames"], """
  SELECT DISTINCT n.image, e.embedding, len(e.embedding) AS dim
  FROM snapnames n JOIN embeddings e ON e.vec_id = n.vec_id""")

cte("sim", ["pairs", "imgvec"], f"""
  SELECT p.*,
    CASE WHEN b.embedding IS NULL OR a.embedding IS NULL THEN NULL
         WHEN sqrt({sqn('b.embedding')}) * sqrt({sqn('a.embedding')}) = 0 THEN 0.0
         ELSE {dot('b.embedding', 'a.embedding')} / (sqrt({sqn('b.embedding')}) * sqrt({sqn('a.embedding')})) END
      AS dino_similarity
  FROM pairs p
  LEFT JOIN imgvec b ON b.image = CASE WHEN p.before_image <> '' THEN {basename('p.before_image')} END
  LEFT JOIN imgvec a ON a.image = CASE WHEN p.after_image <> '' THEN {basename('p.after_image')} END""")

cte("changes", ["sim"], """
  SELECT *, CASE WHEN dino_similarity IS NULL THEN 'no_embedding' ELSE 'dino' END AS candidate_reason,
    true AS is_candidate
  FROM sim WHERE (dino_similarity IS NULL OR dino_similarity < 0.0) AND largest_run >= 2""")

_labels = ", ".join(f"({i}, '{n}')" for i, n in enumerate(LABELS))
cte("labelnames", [], f"SELECT * FROM (VALUES {_labels}) t(label, label_name)")

cte("probe", ["labelnames"], """
  WITH x AS (
    SELECT label, unnest(embedding) AS e, unnest(generate_series(1, len(embedding))) AS i
    FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
  m AS (SELECT label, i, round(avg(e::DOUBLE), 8) AS w FROM x GROUP BY label, i)
  SELECT m.label, n.label_name, list(m.w ORDER BY m.i) AS weights
  FROM m JOIN labelnames n USING (label) GROUP BY m.label, n.label_name""")

cte("logits", ["imgvec", "probe"], f"""
  SELECT v.image, p.label, p.label_name, 120.0 * {dot('v.embedding', 'p.weights')} AS l
  FROM imgvec v CROSS JOIN probe p""")

cte("scores", ["logits"], """
  WITH mx AS (SELECT image, max(l) AS lmax FROM logits GROUP BY image),
  agg AS (
    SELECT g.image, sum(exp(g.l - mx.lmax)) AS denom, min(CASE WHEN g.l = mx.lmax THEN g.label END) AS best
    FROM logits g JOIN mx USING (image) GROUP BY g.image)
  SELECT a.image,
    CASE WHEN 1.0 / a.denom >= 0.5 THEN n.label_name ELSE '' END AS land_cover,
    CASE WHEN 1.0 / a.denom >= 0.5 THEN 1.0 / a.denom ELSE 0.0 END AS land_cover_conf
  FROM agg a JOIN probe n ON n.label = a.best""")

_groups = ", ".join(f"('{k}', '{v}')" for k, v in {
    "Forest": "dogal", "Shrubland": "dogal", "Pasture": "dogal", "AnnualCrop": "tarim", "PermanentCrop": "tarim",
    "Residential": "yapili", "Industrial": "yapili", "Highway": "yapili", "River": "su", "SeaLake": "su"}.items())
cte("groups", [], f"SELECT * FROM (VALUES {_groups}) t(label, grp)")


def _transitions() -> str:
    from chronotile.operators.landcover import CHANGE_TYPES

    rows = ", ".join(f"('{a}', '{b}', '{tr}', '{en}')" for (a, b), (tr, en) in CHANGE_TYPES.items())
    return f"SELECT * FROM (VALUES {rows}) t(fg, tg, tr, en)"


cte("transitions", [], _transitions())

cte("classified", ["changes", "scores", "groups", "transitions"], f"""
  WITH j AS (
    SELECT c.*, coalesce(b.land_cover, '') AS land_cover_from, coalesce(a.land_cover, '') AS land_cover_to,
      coalesce(b.land_cover_conf, 0.0) AS land_cover_conf_from, coalesce(a.land_cover_conf, 0.0) AS land_cover_conf_to
    FROM changes c
    LEFT JOIN scores b ON b.image = CASE WHEN c.before_image <> '' THEN {basename('c.before_image')} END
    LEFT JOIN scores a ON a.image = CASE WHEN c.after_image <> '' THEN {basename('c.after_image')} END)
  SELECT j.*, coalesce(CASE WHEN gf.grp <> gt.grp THEN t.tr END, '') AS change_type_tr,
    coalesce(CASE WHEN gf.grp <> gt.grp THEN t.en END, '') AS change_type_en
  FROM j
  LEFT JOIN groups gf ON gf.label = j.land_cover_from
  LEFT JOIN groups gt ON gt.label = j.land_cover_to
  LEFT JOIN transitions t ON t.fg = gf.grp AND t.tg = gt.grp""")

cte("geo", ["classified"], f"""
  SELECT *, ({col_to_lon('tile_col')} + {col_to_lon('tile_col + 1')}) / 2.0 AS centroid_lon,
    ({row_to_lat('tile_row + 1')} + {row_to_lat('tile_row')}) / 2.0 AS centroid_lat
  FROM classified""")

cte("ep", ["geo"], """
  WITH e0 AS (
    SELECT *, try_cast(nullif(trim(from_date), '') AS TIMESTAMP) AS fts, try_cast(nullif(trim(to_date), '') AS TIMESTAMP) AS tts
    FROM geo),
  e1 AS (
    SELECT *, lag(tts) OVER w AS pto, row_number() OVER w AS pos
    FROM e0 WINDOW w AS (PARTITION BY tile_col, tile_row ORDER BY to_date, event_id)),
  e2 AS (
    SELECT *, CASE WHEN pos > 1 AND fts IS NOT NULL AND pto IS NOT NULL AND fts <= pto THEN 0 ELSE 1 END AS st FROM e1),
  e3 AS (
    SELECT *, sum(st) OVER (ORDER BY tile_col, tile_row, to_date, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      AS episode_id FROM e2)
  SELECT * EXCLUDE (pto, pos, st, fts),
    row_number() OVER (PARTITION BY episode_id ORDER BY tile_col, tile_row, to_date, event_id) - 1 AS episode_index,
    count(*) OVER (PARTITION BY episode_id) AS episode_count
  FROM e3""")

cte("enriched", ["ep"], """
  WITH b AS (SELECT min(tts) AS tmin, max(tts) AS tmax FROM ep),
  r AS (
    SELECT ep.*, CASE WHEN tts IS NULL THEN 0.0
        ELSE (epoch_us(tts) - epoch_us(b.tmin))::DOUBLE / 1e6
             / greatest((epoch_us(b.tmax) - epoch_us(b.tmin))::DOUBLE / 1e6, 1e-9::DOUBLE) END AS rec
    FROM ep CROSS JOIN b)
  SELECT * EXCLUDE (rec, tts),
    least(greatest(
      0.3::DOUBLE * least(greatest(coalesce(change_ratio, 0.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)
      + 0.3::DOUBLE * (1.0::DOUBLE - least(greatest(coalesce(dino_similarity, 1.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE))
      + 0.2::DOUBLE * CASE WHEN change_type_tr <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
      + 0.2::DOUBLE * rec, 0.0::DOUBLE), 1.0::DOUBLE) AS importance
  FROM r""")


def viewports_values() -> str:
    from chronotile.sources.fixtures import viewports

    rows = ", ".join(f"({a}, {b}, {c}, {d}, {e})" for a, b, c, d, e in viewports())
    return f"SELECT * FROM (VALUES {rows}) t(viewport_id, min_col, max_col, min_row, max_row)"


cte("viewports", [], viewports_values())


# ---------------------------------------------------------------- masks (cell 1 / threshold 60 / min_area 4; cell 2 / 40)

cte("gray", ["snapnames"], """
  SELECT DISTINCT n.image, list_transform(
    list_transform(e.embedding, lambda v: CAST(least(255, greatest(0, floor(128.0::DOUBLE + 400.0::DOUBLE * v::DOUBLE + 0.5::DOUBLE))) AS INT)),
    lambda x: (19595 * least(255, x + 20) + 38470 * x + 7471 * (x * 7 % 256) + 32768) >> 16) AS px
  FROM snapnames n JOIN embeddings e ON e.vec_id = n.vec_id""")

cte("imgpairs", ["changes", "gray"], f"""
  SELECT c.event_id, c.tile_col, c.tile_row, b.px AS a, a.px AS b
  FROM changes c
  JOIN gray b ON b.image = {basename('c.before_image')}
  JOIN gray a ON a.image = {basename('c.after_image')}
  WHERE c.before_image <> '' AND c.after_image <> ''""")


def celldiff_cte(name: str, cell: int, threshold: float) -> None:
    cx = 8 // cell
    cte(name, ["imgpairs"], f"""
  WITH px AS (SELECT event_id, tile_col, tile_row, i, abs(a[i + 1] - b[i + 1]) AS d
              FROM imgpairs, range(64) r(i))
  SELECT event_id, tile_col, tile_row, {cx} AS cells_x, {cx} AS cells_y,
    ((i // 8) // {cell}) * {cx} + ((i % 8) // {cell}) AS k,
    ((i % 8) // {cell}) AS x, ((i // 8) // {cell}) AS y,
    sum(d)::DOUBLE / {float(cell * cell)} AS mean_diff,
    sum(d)::DOUBLE / {float(cell * cell)} > {float(threshold)} AS changed
  FROM px GROUP BY event_id, tile_col, tile_row, k, x, y""")


celldiff_cte("celldiff1", 1, 60)
celldiff_cte("celldiff2", 2, 40)

cte("maskcells", ["celldiff1"], "SELECT event_id, tile_col, tile_row, cells_x, cells_y, k, x, y FROM celldiff1 WHERE changed")

cte("maskedges", ["maskcells"], """
  SELECT a.event_id, a.k AS s, b.k AS t FROM maskcells a JOIN maskcells b
    ON a.event_id = b.event_id AND ((abs(a.x - b.x) = 1 AND a.y = b.y) OR (abs(a.y - b.y) = 1 AND a.x = b.x))""")

cte("maskreach", ["maskcells", "maskedges"], """
  SELECT event_id, k AS s, k AS t FROM maskcells
  UNION
  SELECT r.event_id, r.s, e.t FROM maskreach r JOIN maskedges e ON e.event_id = r.event_id AND e.s = r.t""",
    recursive=True)

cte("regions", ["maskcells", "maskreach"], """
  WITH lab AS (SELECT event_id, s AS k, min(t) AS label FROM maskreach GROUP BY 1, 2),
  g AS (
    SELECT c.event_id, c.tile_col, c.tile_row, c.cells_x, c.cells_y, l.label, count(*) AS area,
      min(c.x) AS x0, min(c.y) AS y0, max(c.x) + 1 AS x1, max(c.y) + 1 AS y1
    FROM maskcells c JOIN lab l ON l.event_id = c.event_id AND l.k = c.k
    GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) >= 4)
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY label) - 1 AS region_index,
    count(*) OVER (PARTITION BY event_id) AS n_regions FROM g""")

cte("masked", ["enriched", "regions"], """
  SELECT e.*, coalesce(m.n, 0) > 0 AS has_regions,
    CASE WHEN coalesce(m.n, 0) = 0 THEN '' WHEN m.n = 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS mask_type
  FROM enriched e LEFT JOIN (SELECT event_id, count(*) AS n FROM regions GROUP BY 1) m USING (event_id)""")

# ---------------------------------------------------------------- hotspots (brute force, eps 15 km, min_samples 5)

cte("hs_tiles", ["changes"], f"""
  SELECT tile_col, tile_row, count(*) AS w,
    ({col_to_lon('tile_col')} + {col_to_lon('tile_col + 1')}) / 2.0 AS lon,
    ({row_to_lat('tile_row + 1')} + {row_to_lat('tile_row')}) / 2.0 AS lat
  FROM changes GROUP BY 1, 2""")

cte("hs_pts", ["hs_tiles"], """
  SELECT t.*, t.lon * (111.32 * cos(radians(m.ml))) AS x, t.lat * 111.32 AS y
  FROM hs_tiles t CROSS JOIN (SELECT sum(w * lat) / sum(w) AS ml FROM hs_tiles) m""")

cte("hs_pairs", ["hs_pts"], """
  SELECT a.tile_col AS a_col, a.tile_row AS a_row, b.tile_col AS b_col, b.tile_row AS b_row, b.w AS b_w,
    (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
  FROM hs_pts a JOIN hs_pts b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 225.0""")

cte("hs_core", ["hs_tiles", "hs_pairs"], """
  SELECT a_col AS tile_col, a_row AS tile_row, row_number() OVER (ORDER BY a_col, a_row) AS id
  FROM hs_pairs GROUP BY 1, 2 HAVING sum(b_w) >= 5""")

cte("hs_core_edges", ["hs_core", "hs_pairs"], """
  SELECT a.id AS a, b.id AS b FROM hs_pairs p
  JOIN hs_core a ON a.tile_col = p.a_col AND a.tile_row = p.a_row
  JOIN hs_core b ON b.tile_col = p.b_col AND b.tile_row = p.b_row WHERE a.id <> b.id""")

# smallest core number that each core reaches
cte("hs_reach", ["hs_core", "hs_core_edges"], """
  SELECT id, id FROM hs_core
  UNION
  SELECT e.b, min(r.label) FROM hs_reach r JOIN hs_core_edges e ON e.a = r.node
    JOIN recurring.hs_reach k ON k.node = e.b WHERE r.label < k.label GROUP BY e.b""",
    recursive=True, head="hs_reach(node, label) USING KEY (node)")

cte("hs_of_tile", ["hs_core", "hs_reach", "hs_pairs", "hs_tiles"], """
  WITH c AS (SELECT c.tile_col, c.tile_row, dense_rank() OVER (ORDER BY r.label) AS cluster
             FROM hs_core c JOIN hs_reach r ON r.node = c.id),
  near AS (SELECT p.a_col, p.a_row, min(c.cluster) AS cluster FROM hs_pairs p
           JOIN c ON c.tile_col = p.b_col AND c.tile_row = p.b_row GROUP BY 1, 2)
  SELECT t.*, coalesce(c.cluster, near.cluster, 0) AS hotspot_id FROM hs_tiles t
  LEFT JOIN c USING (tile_col, tile_row)
  LEFT JOIN near ON near.a_col = t.tile_col AND near.a_row = t.tile_row""")
