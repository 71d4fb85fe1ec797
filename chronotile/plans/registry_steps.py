"""Registered queries for the pipeline steps (sources, pairs, embeddings, land cover, enrich, masks, verdicts,
vectors, exports). Imported by ``registry``; shares its dictionaries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from chronotile.functions import geo
from chronotile.functions.images import sniff_extension
from chronotile.operators import embed as EM
from chronotile.operators import hotspots as HS
from chronotile.operators import landcover as LC
from chronotile.operators import mask as MK
from chronotile.operators import pairs as PR
from chronotile.operators import probe as PB
from chronotile.operators import vectors as VC
from chronotile.operators import verdicts as VD
from chronotile.operators.episodes import episodes
from chronotile.operators.importance import importance
from chronotile.operators.noise import noise_filter
from chronotile.operators.raster import labelled_images
from chronotile.params import FIXTURE
from chronotile.plans import export as EX
from chronotile.plans import oracle as O
from chronotile.plans import queries as Q
from chronotile.plans import stages as S
from chronotile.plans.registry import ORACLE, POINT_EVENT, register
from chronotile.plans.store import fresh_path, stored, write_pairs
from chronotile.sources import events as SE
from chronotile.sources import fixtures as fx
from chronotile.sources.ranged import read_ranges, write_ranges
from chronotile.sources.versioned import VersionedTable

R = S.rounded
MASK_P = FIXTURE.with_(cell_size=1, diff_threshold=60, min_area=4)
CELL2_P = FIXTURE.with_(cell_size=2, diff_threshold=40, min_area=4)
HOT_P = FIXTURE.with_(hotspot_eps_km=15.0, hotspot_min_samples=5)
RATIO_P = FIXTURE.with_(min_change_ratio=0.5)
K = 6
REF_TILE = (37600, 24400)


def millionths(vector: str):
    """A digest of the vector's components in whole millionths."""
    return F.md5(F.array_join(F.transform(vector, lambda x: F.floor(x.cast("double") * 1000000.0).cast("string")), ","))


def millionths_sql(vector: str) -> str:
    return f"md5(array_to_string(list_transform({vector}, lambda x: CAST(floor(x::DOUBLE * 1000000.0::DOUBLE) AS BIGINT)::VARCHAR), ','))"


def _snap_images(spark, sf):
    return fx.snapshot_images(S.snapshots(spark, sf))


def _cached(spark, sf):
    """Embedding cache fixture: images whose vector id ends in 0-7 are already embedded."""
    names = _snap_images(spark, sf).where(F.col("vec_id") % 10 < 8).select("image", "vec_id").distinct()
    emb = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return names.join(emb, "vec_id").select("image", "embedding", F.size("embedding").alias("dim"))


def _gray(spark, sf):
    return fx.gray_images(spark, sf, S.snapshots(spark, sf))


def _masked(spark, sf):
    return S.masked(spark, sf, MASK_P).whole


# ---------------------------------------------------------------- sources

@register("scan_change_events", O.build("SELECT * FROM events", "events"))
def q_scan(spark, sf):
    return SE.scan_change_events(S.events(spark, sf))


RANGE = 1024


def _range_files(spark, sf):
    path = fresh_path(spark, "event-ranges")
    write_ranges(S.events(spark, sf), path, "id", RANGE)
    return path


@register("source_scan", O.build(f"SELECT *, id // {RANGE} * {RANGE} AS first_of_range FROM events", "events"))
def q_source_scan(spark, sf):
    """Event files by id range, every row beside the first id of the range it was read from."""
    return read_ranges(spark, _range_files(spark, sf), range_column="first_of_range")


@register("source_scan_range", O.build("SELECT * FROM events WHERE id BETWEEN 700 AND 5000 AND tile_col < 40000", "events"))
def q_source_scan_range(spark, sf):
    """The id range selects files before any task starts."""
    where = [("id", ">=", 700), ("id", "<=", 5000), ("tile_col", "<", 40000)]
    return SE.scan_change_events(read_ranges(spark, _range_files(spark, sf), where=where))


@register("normalize_events", O.build("""
SELECT id AS event_id, tile_col, tile_row, from_release_id, to_release_id, from_date, to_date, detected_at,
  ssim_score, change_ratio, largest_run, 0 AS land_windows, 0 AS water_windows, 0.0::DOUBLE AS ssim_min,
  0.0::DOUBLE AS ssim_p05, 0.0::DOUBLE AS embedding_similarity, 0 AS embedding_computed,
  '' AS from_land_cover, '' AS to_land_cover FROM events""", "events"))
def q_normalize(spark, sf):
    return PR.normalize_events(S.events(spark, sf))


@register("build_pairs", O.build("SELECT * FROM pairs", "pairs"))
def q_build_pairs(spark, sf):
    return S.pairs(spark, sf)


@register("source_counts", O.build("SELECT (SELECT count(*) FROM events) AS change_count, (SELECT count(*) FROM snaps) AS snapshot_count", "snaps"))
def q_source_counts(spark, sf):
    return SE.source_counts(S.events(spark, sf), S.snapshots(spark, sf))


@register("validate_source", O.build("""
SELECT count(*) AS rows, count(*) FILTER (WHERE id IS NULL) AS null_ids, count(id) - count(DISTINCT id) AS duplicate_ids,
  (SELECT count(*) FILTER (WHERE release_id IS NULL OR tile_col IS NULL OR tile_row IS NULL) FROM snaps) AS snapshot_null_keys,
  (SELECT count(*) FROM (SELECT release_id, tile_col, tile_row FROM snaps GROUP BY ALL HAVING count(*) > 1)) AS snapshot_duplicate_keys
FROM events""", "snaps"))
def q_validate(spark, sf):
    return SE.validate_source(S.events(spark, sf), S.snapshots(spark, sf))


@register("has_snapshots", O.build("""
SELECT e.id FROM events e
WHERE EXISTS (SELECT 1 FROM snaps s WHERE s.release_id = e.from_release_id AND s.tile_col = e.tile_col AND s.tile_row = e.tile_row)
  AND EXISTS (SELECT 1 FROM snaps s WHERE s.release_id = e.to_release_id AND s.tile_col = e.tile_col AND s.tile_row = e.tile_row)""", "snaps"))
def q_has_snapshots(spark, sf):
    return PR.with_both_snapshots(S.events(spark, sf), S.snapshots(spark, sf)).select("id")


@register("image_names", O.build("SELECT release_id, tile_col, tile_row, image, image_path FROM snapnames", "snapnames"))
def q_image_names(spark, sf):
    return _snap_images(spark, sf).select("release_id", "tile_col", "tile_row", "image", "image_path")


@register("image_store", O.build("""
SELECT image_path, release_id, tile_col, tile_row, length(CAST(vec_id AS VARCHAR)) + CASE WHEN ext = 'png' THEN 8 ELSE 4 END AS n_bytes
FROM snapnames WHERE image_path NOT IN (SELECT image_path FROM snapnames WHERE vec_id % 10 < 8)""", "snapnames"))
def q_image_store(spark, sf):
    snaps = _snap_images(spark, sf)
    existing = snaps.where(F.col("vec_id") % 10 < 8).select("image_path")
    st = PR.image_store(snaps, existing)
    return st.select("image_path", "release_id", "tile_col", "tile_row", F.length("data").alias("n_bytes"))


@register("image_formats", O.build("SELECT image, ext, ext AS sniffed FROM snapnames", "snapnames"))
def q_image_formats(spark, sf):
    s = _snap_images(spark, sf)
    return s.select("image", "ext", sniff_extension("data").alias("sniffed"))


@register("snapshot_formats", O.build("""
SELECT release_id, tile_col, tile_row, CASE WHEN ext = 'png' THEN 'image/png' ELSE 'image/jpeg' END AS content_type FROM snaps""", "snaps"))
def q_snapshot_formats(spark, sf):
    return SE.snapshot_formats(_snap_images(spark, sf))


@register("event_images", O.build("""
SELECT c.event_id, 'before' AS side, n.image, length(CAST(n.vec_id AS VARCHAR)) + CASE WHEN n.ext = 'png' THEN 8 ELSE 4 END AS n_bytes
FROM changes c JOIN snapnames n ON n.image_path = c.before_image
UNION ALL
SELECT c.event_id, 'after', n.image, length(CAST(n.vec_id AS VARCHAR)) + CASE WHEN n.ext = 'png' THEN 8 ELSE 4 END
FROM changes c JOIN snapnames n ON n.image_path = c.after_image""", "changes", "snapnames"))
def q_event_images(spark, sf):
    ch = S.changes(spark, sf)
    img = _snap_images(spark, sf).select("image", "image_path", "data")
    b = ch.select("event_id", F.lit("before").alias("side"), F.col("before_image").alias("image_path"))
    a = ch.select("event_id", F.lit("after").alias("side"), F.col("after_image").alias("image_path"))
    return b.union(a).join(img, "image_path").select("event_id", "side", "image", F.length("data").alias("n_bytes"))


@register("image_for_event", O.build(f"""
SELECT c.event_id, s.side, n.image, CASE WHEN n.ext = 'png' THEN '89504E470D0A1A0A' ELSE 'FFD8FFE0' END || hex(encode(n.vec_id::VARCHAR)) AS data
FROM changes c CROSS JOIN (VALUES ('before'), ('after')) s(side)
JOIN snapnames n ON n.image_path = CASE s.side WHEN 'before' THEN c.before_image ELSE c.after_image END
WHERE c.event_id = {POINT_EVENT}
UNION ALL
SELECT event_id, 'mask', 'masks/' || event_id || '.png', string_agg(CASE WHEN changed THEN '0000FF96' ELSE '0000FF00' END, '' ORDER BY k)
FROM celldiff1 WHERE event_id = {POINT_EVENT} AND event_id IN (SELECT event_id FROM regions) GROUP BY event_id""", "changes", "snapnames", "celldiff1", "regions"))
def q_image_for_event(spark, sf):
    ch, images = S.served_changes(spark, sf), S.served_images(spark, sf)
    masks = MK.mask_overlay(Q.event_by_id(ch, POINT_EVENT), _gray(spark, sf), MASK_P)
    rows = [Q.image_for_event(ch, images, POINT_EVENT, side, masks) for side in ("before", "after", "mask")]
    return rows[0].union(rows[1]).union(rows[2]).select("event_id", "side", "image", F.hex("data").alias("data"))


# ---------------------------------------------------------------- embeddings

@register("unique_images", O.build(f"""
SELECT DISTINCT {O.basename('x')} AS image FROM (
  SELECT before_image AS x FROM pairs UNION ALL SELECT after_image FROM pairs) WHERE x <> ''""", "pairs"))
def q_unique_images(spark, sf):
    return EM.unique_images(S.pairs(spark, sf))


@register("images_to_embed", O.build(f"""
SELECT DISTINCT {O.basename('x')} AS image FROM (
  SELECT before_image AS x FROM pairs UNION ALL SELECT after_image FROM pairs)
WHERE x <> '' AND {O.basename('x')} NOT IN (SELECT image FROM snapnames WHERE vec_id % 10 < 8)""", "pairs", "snapnames"))
def q_images_to_embed(spark, sf):
    return EM.images_to_embed(EM.unique_images(S.pairs(spark, sf)), _cached(spark, sf))


@register("embedding_cache_append", O.build(f"""
WITH used AS (SELECT DISTINCT {O.basename('x')} AS image FROM (SELECT before_image AS x FROM pairs UNION ALL SELECT after_image FROM pairs) WHERE x <> '')
SELECT i.image, 'fixture' AS model, len(any_value(i.embedding)) AS dim, {millionths_sql('any_value(i.embedding)')} AS millionths,
  CAST(CASE WHEN any_value(n.vec_id) % 10 < 8 THEN 1 ELSE 2 END AS INT) AS written_by
FROM imgvec i JOIN snapnames n USING (image) LEFT JOIN used u USING (image)
WHERE n.vec_id % 10 < 8 OR u.image IS NOT NULL GROUP BY i.image""", "pairs", "snapnames", "imgvec"))
def q_cache_append(spark, sf):
    """A stored cache of vectors by image and model: the second write adds the images that it lacks, a third, of the same, nothing."""
    cache = VersionedTable(spark, fresh_path(spark, "cache"), ["image", "model"])
    by = lambda rows, n: rows.select("image", F.lit("fixture").alias("model"), "embedding", "dim", F.lit(n).alias("written_by"))
    cache.append_new(by(_cached(spark, sf), 1), ("embed", 0))
    wanted = EM.unique_images(S.pairs(spark, sf)).join(S.image_vectors(spark, sf), "image")
    cache.append_new(by(wanted, 2), ("embed", 1))
    cache.append_new(by(wanted, 3), ("embed", 2))
    return cache.read().select("image", "model", "dim", millionths("embedding").alias("millionths"), "written_by")


@register("embed_images", O.build(f"""
SELECT image, 16 AS dim, 'block-mean-2' AS model, array_to_string(list_transform(range(16), lambda j: CAST(round(
  ((px[(j // 4) * 16 + (j % 4) * 2 + 1] + px[(j // 4) * 16 + (j % 4) * 2 + 2] + px[(j // 4) * 16 + (j % 4) * 2 + 9]
    + px[(j // 4) * 16 + (j % 4) * 2 + 10])::FLOAT / 4::FLOAT / 255::FLOAT)::DOUBLE * 1000000) AS BIGINT)::VARCHAR), ',') AS millionths
FROM gray WHERE image IN (
    SELECT {O.basename('x')} FROM (SELECT before_image AS x FROM pairs UNION ALL SELECT after_image FROM pairs) WHERE x <> '')""", "pairs", "gray"))
def q_embed_images(spark, sf):
    imgs = EM.unique_images(S.pairs(spark, sf)).join(_gray(spark, sf), "image")
    out = EM.embed_images(imgs, EM.block_mean_embedder(8, 8, 2), model="block-mean-2")
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string"))
    return out.select("image", "dim", "model", F.array_join(whole, ",").alias("millionths"))


@register("pair_similarity", O.build("""
SELECT event_id, before_image, after_image, round(dino_similarity, 9) AS dino_similarity FROM sim""", "sim"))
def q_pair_similarity(spark, sf):
    return R(S.pairs_with_similarity(spark, sf).select("event_id", "before_image", "after_image", "dino_similarity"))


@register("similarity_stats", O.build("""
SELECT count(*) AS n, round(avg(dino_similarity), 9) AS mean_similarity, round(median(dino_similarity), 9) AS median_similarity,
  round(avg(CASE WHEN dino_similarity < 0.0 THEN 1.0 ELSE 0.0 END), 9) AS share_below
FROM sim WHERE dino_similarity IS NOT NULL""", "sim"))
def q_similarity_stats(spark, sf):
    return R(EM.similarity_stats(S.pairs_with_similarity(spark, sf), FIXTURE.similarity_threshold))


# ---------------------------------------------------------------- noise filter

@register("noise_filter", O.build("""
SELECT event_id, candidate_reason, is_candidate, round(dino_similarity, 9) AS dino_similarity FROM changes""", "changes"))
def q_noise_filter(spark, sf):
    return R(S.changes(spark, sf).select("event_id", "candidate_reason", "is_candidate", "dino_similarity"))


@register("noise_filter_ratio", O.build("""
SELECT event_id, candidate_reason, change_ratio FROM changes WHERE change_ratio >= 0.5""", "changes"))
def q_noise_filter_ratio(spark, sf):
    return noise_filter(S.pairs_with_similarity(spark, sf), RATIO_P).select("event_id", "candidate_reason", "change_ratio")


# ---------------------------------------------------------------- land cover

@register("labelled_images", O.build("""
SELECT 'Forest_' || e.vec_id || '.png' AS path, e.label, n.label_name, '89504E470D0A1A0A' || hex(encode(e.vec_id::VARCHAR)) AS bytes
FROM embeddings e LEFT JOIN labelnames n USING (label) WHERE e.vec_id % 17 <> 0 AND e.vec_id % 19 <> 0""", "labelnames"))
def q_labelled(spark, sf):
    """Labelled image files, written as Parquet and read as such; those without bytes drop out."""
    files = stored(fx.labelled_files(spark, sf), "labelled", write_pairs)
    return labelled_images(files, fx.label_names(spark)).select("path", "label", "label_name", F.hex("bytes").alias("bytes"))


@register("labelled_vectors", O.build("""
SELECT e.vec_id, e.label, n.label_name FROM embeddings e JOIN labelnames n USING (label)
WHERE e.embedding IS NOT NULL AND len(e.embedding) > 0""", "labelnames"))
def q_labelled_vectors(spark, sf):
    return fx.labelled_vectors(spark, sf).select("vec_id", "label", "label_name")


@register("probe_score", O.build("""
SELECT image, land_cover, round(land_cover_conf, 9) AS land_cover_conf FROM scores""", "scores"))
def q_probe_score(spark, sf):
    return R(S.image_scores(spark, sf))


@register("change_type", O.build("""
SELECT event_id, land_cover_from, land_cover_to, round(land_cover_conf_from, 9) AS land_cover_conf_from,
  round(land_cover_conf_to, 9) AS land_cover_conf_to, change_type_tr, change_type_en FROM classified""", "classified"))
def q_change_type(spark, sf):
    return R(S.classified(spark, sf).select("event_id", "land_cover_from", "land_cover_to", "land_cover_conf_from",
                                            "land_cover_conf_to", "change_type_tr", "change_type_en"))


@register("group_names", O.build("""
WITH d AS (SELECT g.label, n.name FROM groups g
           JOIN (VALUES ('dogal', 'Doğal alan'), ('tarim', 'Tarım'), ('yapili', 'Yapılı alan'), ('su', 'Su')) n(grp, name) USING (grp))
SELECT c.event_id, coalesce(f.name, '') AS from_group, coalesce(t.name, '') AS to_group
FROM classified c LEFT JOIN d f ON f.label = c.land_cover_from LEFT JOIN d t ON t.label = c.land_cover_to""", "classified", "groups"))
def q_group_names(spark, sf):
    name = LC.group_name
    return S.classified(spark, sf).select("event_id", name("land_cover_from").alias("from_group"), name("land_cover_to").alias("to_group"))


PROBE_P = FIXTURE.with_(probe_steps=20, probe_rate=8.0)
TEST_SQL = "substr(md5(vec_id::VARCHAR), 1, 1) < '4'"


def _probe_ctes() -> str:
    """One table of weights for each step, from zero; ``px`` are the labelled vectors with a last component of 1."""
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(fx.LABELS))
    whole = lambda v: f"CAST(floor(({v}) * 1048576 + 0.5) AS BIGINT)"
    O.cte("px", [], f"""
  SELECT e.vec_id, e.label, n.label_name, {TEST_SQL} AS test, list_append(list_transform(e.embedding, lambda v: v::DOUBLE), 1.0::DOUBLE) AS x
  FROM embeddings e JOIN (VALUES {names}) n(label, label_name) USING (label) WHERE len(e.embedding) > 0""")
    O.cte("pt", ["px"], "SELECT * FROM px WHERE NOT test")
    O.cte("pw0", ["pt"], """
  SELECT label, min(label_name) AS label_name, list_transform(range(max(len(x))), lambda i: 0.0::DOUBLE) AS w, sum(count(*)) OVER () AS n
  FROM pt GROUP BY label""")
    for k in range(PROBE_P.probe_steps):
        O.cte(f"pw{k + 1}", [f"pw{k}", "pt"], f"""
  SELECT w.label, w.label_name, list_transform(list_zip(w.w, g.g), lambda a: a[1] - {PROBE_P.probe_rate}::DOUBLE * (a[2]::DOUBLE / 1099511627776.0::DOUBLE / w.n::DOUBLE)) AS w, w.n
  FROM pw{k} w JOIN (
    SELECT label, list(s ORDER BY j) AS g FROM (
      SELECT label, j, sum(miss * {whole('v')}) AS s FROM (
        SELECT label, {whole('p / sum(p) OVER (PARTITION BY vec_id) - hit')} AS miss, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM (
          SELECT vec_id, label, hit, x, exp(z - max(z) OVER (PARTITION BY vec_id)) AS p FROM (
            SELECT t.vec_id, w.label, CASE WHEN t.label = w.label THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, t.x, list_dot_product(t.x, w.w) AS z
            FROM pt t CROSS JOIN pw{k} w))) GROUP BY label, j) GROUP BY label) g USING (label)""", head=f"pw{k + 1}")
    return f"pw{PROBE_P.probe_steps}"


PROBE = _probe_ctes()


def _trained(spark, sf):
    rows = fx.labelled_vectors(spark, sf)
    return PB.train_probe(rows.where(~PB.held_out("vec_id")), PROBE_P)


@register("colocated_steps", O.build("""
SELECT c.event_id, round(c.dino_similarity, 9) AS dino_similarity, c.land_cover_from, c.land_cover_to, c.change_type_tr, len(v.embedding) AS dim
FROM classified c LEFT JOIN imgvec v ON v.image = CASE WHEN c.after_image <> '' THEN """ + O.basename("c.after_image") + " END", "classified", "imgvec"))
def q_colocated_steps(spark, sf):
    """Similarity, land cover and vectors of the changes, all from one image table in buckets of the image name."""
    images = S.image_table(spark, sf)
    near = noise_filter(EM.pair_similarity(S.pairs(spark, sf), images), FIXTURE)
    out = LC.classify_changes(near, images).checkpoint(eager=True)
    dims = VC.vector_table(out, images).select("event_id", F.size("vector").alias("dim"))
    return R(out.join(dims, "event_id", "left").select("event_id", "dino_similarity", "land_cover_from", "land_cover_to", "change_type_tr", "dim"))


@register("train_probe", O.build(f"""
SELECT label, label_name, unnest(range(len(w))) AS position, round(unnest(w), 6) + 0.0 AS weight FROM {PROBE}""", PROBE))
def q_train_probe(spark, sf):
    """Every weight of the probe trained on three quarters of the labelled vectors; the last position is the bias."""
    cells = F.posexplode(F.concat("weights", F.array("bias"))).alias("position", "weight")
    return _trained(spark, sf).select("label", "label_name", cells).withColumn("weight", F.round("weight", 6) + 0.0)


@register("probe_accuracy", O.build(f"""
SELECT count(*) FILTER (WHERE NOT test) AS train_rows, round(avg(hit) FILTER (WHERE NOT test), 9) AS train_accuracy,
  count(*) FILTER (WHERE test) AS test_rows, round(avg(hit) FILTER (WHERE test), 9) AS test_accuracy
FROM (SELECT px.vec_id, any_value(px.test) AS test,
    CASE WHEN any_value(px.label) = first(w.label ORDER BY list_dot_product(px.x, w.w) DESC, w.label) THEN 1.0 ELSE 0.0 END AS hit
  FROM px CROSS JOIN {PROBE} w GROUP BY px.vec_id)""", PROBE, "px"))
def q_probe_accuracy(spark, sf):
    return R(PB.probe_accuracy(fx.labelled_vectors(spark, sf), _trained(spark, sf), PB.held_out("vec_id")))


# ---------------------------------------------------------------- enrich

@register("episodes", O.build("""
SELECT event_id, tile_col, tile_row, to_date, episode_id, episode_index, episode_count FROM ep""", "ep"))
def q_episodes(spark, sf):
    c = S.classified(spark, sf)
    return episodes(c).select("event_id", "tile_col", "tile_row", "to_date", "episode_id", "episode_index", "episode_count")


@register("importance", O.build("SELECT event_id, round(importance, 9) AS importance FROM enriched", "enriched"))
def q_importance(spark, sf):
    return R(importance(S.classified(spark, sf), FIXTURE).select("event_id", "importance"))


@register("hotspot_neighbours", O.build("""
SELECT a_col, a_row, b_col, b_row, round(d2, 6) AS d2 FROM hs_pairs""", "hs_pairs"))
def q_hotspot_neighbours(spark, sf):
    pts = HS.tile_points(S.changes(spark, sf), HOT_P)
    # distances depend on the mean latitude, a float sum whose order differs between engines: 6 decimals
    return R(HS.neighbour_pairs(pts, HOT_P).select("a_col", "a_row", "b_col", "b_row", "d2"), 6)


@register("hotspot_core_tiles", O.build("""
SELECT t.tile_col, t.tile_row, t.w, n.n, n.n >= 5 AS is_core
FROM hs_tiles t JOIN (SELECT a_col, a_row, sum(b_w) AS n FROM hs_pairs GROUP BY 1, 2) n
  ON n.a_col = t.tile_col AND n.a_row = t.tile_row""", "hs_tiles", "hs_pairs"))
def q_hotspot_core(spark, sf):
    ch = S.changes(spark, sf)
    pts = HS.tile_points(ch, HOT_P)
    cores = HS.core_tiles(pts, HOT_P)
    return cores.select("tile_col", "tile_row", "w", "n", "is_core")


@register("hotspots", O.build("""
WITH cent AS (SELECT hotspot_id, sum(w * lon) / sum(w) AS lon, sum(w * lat) / sum(w) AS lat FROM hs_of_tile
              WHERE hotspot_id > 0 GROUP BY 1)
SELECT c.event_id, c.tile_col, c.tile_row, t.hotspot_id, round(cent.lon, 6) AS hotspot_centroid_lon,
  round(cent.lat, 6) AS hotspot_centroid_lat
FROM changes c JOIN hs_of_tile t USING (tile_col, tile_row) LEFT JOIN cent ON cent.hotspot_id = t.hotspot_id""",
                              "changes", "hs_of_tile"))
def q_hotspots(spark, sf):
    h = HS.hotspots(S.changes(spark, sf), HOT_P)
    # centroids are float sums, whose order differs between engines: 6 decimals
    return R(h.select("event_id", "tile_col", "tile_row", "hotspot_id", "hotspot_centroid_lon", "hotspot_centroid_lat"), 6)


# ---------------------------------------------------------------- geo functions

def _tiles(spark, sf):
    return S.events(spark, sf).select("tile_col", "tile_row").distinct()


@register("tile_assign", O.build(f"""
WITH t AS (SELECT id AS event_id, tile_col, tile_row,
    ({O.col_to_lon('tile_col')} + {O.col_to_lon('tile_col + 1')}) / 2.0 AS lon,
    ({O.row_to_lat('tile_row + 1')} + {O.row_to_lat('tile_row')}) / 2.0 AS lat FROM events)
SELECT event_id, tile_col, tile_row, CAST(floor((lon + 180.0) / 360.0 * 65536.0) AS INT) AS col,
  CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 65536.0) AS INT) AS row FROM t""", "events"))
def q_tile_assign(spark, sf):
    ev = S.events(spark, sf)
    lon, lat = geo.tile_centroid_lon("tile_col"), geo.tile_centroid_lat("tile_row")
    return ev.select(F.col("id").alias("event_id"), "tile_col", "tile_row", geo.lon_to_col(lon).alias("col"), geo.lat_to_row(lat).alias("row"))


@register("tile_bounds", O.build(f"""
SELECT DISTINCT tile_col, tile_row, round({O.col_to_lon('tile_col')}, 9) AS west, round({O.row_to_lat('tile_row + 1')}, 9) AS south,
  round({O.col_to_lon('tile_col + 1')}, 9) AS east, round({O.row_to_lat('tile_row')}, 9) AS north FROM events""", "events"))
def q_tile_bounds(spark, sf):
    b = geo.tile_bounds("tile_col", "tile_row")
    return R(_tiles(spark, sf).select("tile_col", "tile_row", b.west.alias("west"), b.south.alias("south"),
                                       b.east.alias("east"), b.north.alias("north")))


@register("tile_centroid", O.build(f"""
SELECT DISTINCT tile_col, tile_row, round(({O.col_to_lon('tile_col')} + {O.col_to_lon('tile_col + 1')}) / 2.0, 9) AS lon,
  round(({O.row_to_lat('tile_row + 1')} + {O.row_to_lat('tile_row')}) / 2.0, 9) AS lat FROM events""", "events"))
def q_tile_centroid(spark, sf):
    return R(_tiles(spark, sf).select("tile_col", "tile_row", geo.tile_centroid_lon("tile_col").alias("lon"),
                                       geo.tile_centroid_lat("tile_row").alias("lat")))


@register("tile_polygon", O.build(f"""
SELECT DISTINCT tile_col, tile_row, 5 AS n_points,
  round({O.col_to_lon('tile_col')}, 9) AS x0, round({O.row_to_lat('tile_row + 1')}, 9) AS y0,
  round({O.col_to_lon('tile_col + 1')}, 9) AS x1, round({O.row_to_lat('tile_row + 1')}, 9) AS y1,
  round({O.col_to_lon('tile_col + 1')}, 9) AS x2, round({O.row_to_lat('tile_row')}, 9) AS y2,
  round({O.col_to_lon('tile_col')}, 9) AS x3, round({O.row_to_lat('tile_row')}, 9) AS y3,
  round({O.col_to_lon('tile_col')}, 9) AS x4, round({O.row_to_lat('tile_row + 1')}, 9) AS y4 FROM events""", "events"))
def q_tile_polygon(spark, sf):
    r = geo.tile_ring("tile_col", "tile_row")
    t = _tiles(spark, sf).select("tile_col", "tile_row", r.alias("ring"))
    cols = [F.size("ring").alias("n_points")]
    for i in range(5):
        cols += [F.col("ring")[i][0].alias(f"x{i}"), F.col("ring")[i][1].alias(f"y{i}")]
    return R(t.select("tile_col", "tile_row", *cols))


@register("haversine", O.build(f"""
WITH t AS (SELECT DISTINCT tile_col, tile_row,
    ({O.col_to_lon('tile_col')} + {O.col_to_lon('tile_col + 1')}) / 2.0 AS lon,
    ({O.row_to_lat('tile_row + 1')} + {O.row_to_lat('tile_row')}) / 2.0 AS lat FROM events),
r AS (SELECT ({O.col_to_lon(str(REF_TILE[0]))} + {O.col_to_lon(str(REF_TILE[0] + 1))}) / 2.0 AS lon0,
    ({O.row_to_lat(str(REF_TILE[1] + 1))} + {O.row_to_lat(str(REF_TILE[1]))}) / 2.0 AS lat0)
SELECT tile_col, tile_row, round(2.0 * 6371.0 * asin(sqrt(pow(sin(radians(lat - lat0) / 2.0), 2)
  + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2.0), 2))), 6) AS km
FROM t CROSS JOIN r""", "events"))
def q_haversine(spark, sf):
    lon0, lat0 = geo.tile_centroid_lon(F.lit(REF_TILE[0])), geo.tile_centroid_lat(F.lit(REF_TILE[1]))
    t = _tiles(spark, sf)
    km = geo.haversine_km(lon0, lat0, geo.tile_centroid_lon("tile_col"), geo.tile_centroid_lat("tile_row"))
    return t.select("tile_col", "tile_row", F.round(km, 6).alias("km"))


@register("viewport_ranges", O.build(f"""
WITH t AS (SELECT DISTINCT tile_col, tile_row,
    ({O.col_to_lon('tile_col')} + {O.col_to_lon('tile_col + 1')}) / 2.0 AS lon,
    ({O.row_to_lat('tile_row + 1')} + {O.row_to_lat('tile_row')}) / 2.0 AS lat FROM events),
v AS (SELECT tile_col, tile_row, lon - 0.05 AS west, lat - 0.03 AS south, lon + 0.05 AS east, lat + 0.03 AS north FROM t)
SELECT tile_col, tile_row, CAST(floor((west + 180.0) / 360.0 * 65536.0) AS INT) AS min_col,
  CAST(floor((east + 180.0) / 360.0 * 65536.0) AS INT) AS max_col,
  CAST(floor((1.0 - ln(tan(radians(north)) + 1.0 / cos(radians(north))) / pi()) / 2.0 * 65536.0) AS INT) AS min_row,
  CAST(floor((1.0 - ln(tan(radians(south)) + 1.0 / cos(radians(south))) / pi()) / 2.0 * 65536.0) AS INT) AS max_row FROM v""", "events"))
def q_viewport_ranges(spark, sf):
    t = _tiles(spark, sf).select("tile_col", "tile_row", geo.tile_centroid_lon("tile_col").alias("lon"),
                                  geo.tile_centroid_lat("tile_row").alias("lat"))
    v = t.select("tile_col", "tile_row", (F.col("lon") - 0.05).alias("west"), (F.col("lat") - 0.03).alias("south"),
                 (F.col("lon") + 0.05).alias("east"), (F.col("lat") + 0.03).alias("north"))
    return geo.viewport_ranges(v).select("tile_col", "tile_row", "min_col", "max_col", "min_row", "max_row")


# ---------------------------------------------------------------- masks

def _image_pairs(spark, sf):
    snaps = S.snapshots(spark, sf)
    return MK.image_pairs(S.changes(spark, sf, snaps=snaps), fx.gray_images(spark, sf, snaps))


@register("gray_images", O.build(
    "SELECT image, 8 AS height, 8 AS width, array_to_string(list_transform(px, lambda v: lpad(printf('%X', v), 2, '0')), '') AS data FROM gray", "gray"))
def q_gray_images(spark, sf):
    """Gray levels of rasters whose three channels differ."""
    return _gray(spark, sf).select("image", "height", "width", F.hex("data").alias("data"))


@register("cell_diff", O.build("""
SELECT event_id, any_value(cells_x) AS cells_x, any_value(cells_y) AS cells_y,
  count(*) FILTER (WHERE changed) AS n_changed, string_agg(CASE WHEN changed THEN '1' ELSE '0' END, '' ORDER BY k) AS mask_bits
FROM celldiff2 GROUP BY event_id""", "celldiff2"))
def q_cell_diff(spark, sf):
    d = MK.cell_diff(_image_pairs(spark, sf), CELL2_P.cell_size, CELL2_P.diff_threshold)
    bits = F.regexp_replace(F.hex("mask"), "0(.)", "$1")
    return d.select("event_id", "cells_x", "cells_y", F.length(F.regexp_replace(bits, "0", "")).cast("long").alias("n_changed"), bits.alias("mask_bits"))


@register("mask_regions", O.build("""
SELECT event_id, region_index, x0, y0, x1, y1, area FROM regions""", "regions"))
def q_mask_regions(spark, sf):
    d = MK.mask_regions(MK.cell_diff(_image_pairs(spark, sf), MASK_P.cell_size, MASK_P.diff_threshold), MASK_P.min_area)
    e = d.select("event_id", F.posexplode("regions").alias("region_index", "r"))
    return e.select("event_id", F.col("region_index").cast("long").alias("region_index"),
                    *[F.col(f"r.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1", "area")])


@register("mask_polygons", O.build(f"""
SELECT event_id, region_index, CASE WHEN n_regions = 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS geometry_type,
  round({O.col_to_lon('tile_col + x0::DOUBLE / cells_x')}, 7) AS west, round({O.row_to_lat('tile_row + y1::DOUBLE / cells_y')}, 7) AS south,
  round({O.col_to_lon('tile_col + x1::DOUBLE / cells_x')}, 7) AS east, round({O.row_to_lat('tile_row + y0::DOUBLE / cells_y')}, 7) AS north
FROM regions""", "regions"))
def q_mask_polygons(spark, sf):
    d = MK.mask_regions(MK.cell_diff(_image_pairs(spark, sf), MASK_P.cell_size, MASK_P.diff_threshold), MASK_P.min_area)
    d = MK.region_polygons(d).where(F.size("regions") > 0)
    d = d.withColumn("geometry_type", F.get_json_object(MK.geometry_json(F.col("polygons")), "$.type"))
    e = d.select("event_id", "geometry_type", F.posexplode("polygons").alias("region_index", "ring"))
    # latitudes of fractional rows go through sinh/atan, whose last bits differ between the JVM and libm: 7 decimals
    return R(e.select("event_id", F.col("region_index").cast("long").alias("region_index"), "geometry_type",
                      F.col("ring")[0][0].alias("west"), F.col("ring")[0][1].alias("south"),
                      F.col("ring")[2][0].alias("east"), F.col("ring")[2][1].alias("north")), 7)


@register("mask_overlay", O.build("""
SELECT event_id, 8 AS width, 8 AS height, string_agg(CASE WHEN changed THEN '0000FF96' ELSE '0000FF00' END, '' ORDER BY k) AS rgba
FROM celldiff1 WHERE event_id IN (SELECT event_id FROM regions) GROUP BY event_id""", "celldiff1", "regions"))
def q_mask_overlay(spark, sf):
    o = MK.mask_overlay(S.changes(spark, sf), _gray(spark, sf), MASK_P)
    return o.select("event_id", "width", "height", F.hex("rgba").alias("rgba"))


@register("feature_geometry", O.build("""
SELECT event_id, CASE WHEN has_regions THEN 'mask' ELSE 'tile' END AS source,
  CASE WHEN has_regions THEN mask_type ELSE 'Polygon' END AS geometry_type FROM masked""", "masked"))
def q_feature_geometry(spark, sf):
    m = _masked(spark, sf)
    g = Q.feature_geometry(m)
    return m.select("event_id", F.when(F.col("geometry_mask") != "", "mask").otherwise("tile").alias("source"),
                    F.get_json_object(g, "$.type").alias("geometry_type"))


# ---------------------------------------------------------------- verdicts

VERDICT_SQL = """
  WITH a AS (
    SELECT event_id, CASE event_id % 9
      WHEN 0 THEN '{"is_real": true, "change_type": "construction", "cause_tr": "yeni bina ' || event_id || '", "confidence": 0.' || (event_id % 10) || '}'
      WHEN 1 THEN 'Analiz: {"is_real": false, "change_type": "water", "cause_tr": "golet", "confidence": 0.' || (event_id % 10) || '} bitti'
      WHEN 2 THEN 'yanit yok'
      WHEN 3 THEN '[{"is_real": true}]'
      WHEN 4 THEN '{"is_real": 1, "change_type": "volcano", "cause_tr": "lav", "confidence": "0.' || (event_id % 10) || '"}'
      WHEN 5 THEN '{"is_real": "false", "change_type": "mining", "confidence": 0.5}'
      WHEN 6 THEN '{"is_real": true, "change_type": "other", "cause_tr": "x", "confidence": "high"}'
      WHEN 7 THEN '{"is_real": 0, "change_type": ["water"], "cause_tr": null, "confidence": 0}'
      ELSE '{"change_type": "agriculture"}' END AS text
    FROM changes),
  j AS (
    SELECT event_id, CASE WHEN json_valid(text) THEN text
      WHEN strpos(text, '{') > 0 AND strpos(text, '}') > 0
        THEN substr(text, strpos(text, '{'), length(text) - strpos(reverse(text), '}') + 1 - strpos(text, '{') + 1) END AS js
    FROM a),
  k AS (
    SELECT event_id, js, json_valid(js) AND json_type(js) = 'OBJECT' AS is_obj,
      json_type(js, '$.is_real') AS rt, json_type(js, '$.change_type') AS tt, json_type(js, '$.confidence') AS ct,
      json_type(js, '$.cause_tr') AS kt FROM j),
  v AS (
    SELECT event_id, coalesce(is_obj, false) AND NOT (coalesce(tt IN ('ARRAY', 'OBJECT'), false)
        OR coalesce(ct = 'VARCHAR' AND length(json_extract_string(js, '$.confidence')) > 0 AND TRY_CAST(trim(json_extract_string(js, '$.confidence')) AS DOUBLE) IS NULL, false)
        OR coalesce(ct IN ('ARRAY', 'OBJECT') AND json_extract(js, '$.confidence')::VARCHAR NOT IN ('[]', '{}'), false)) AS ok,
      CASE WHEN rt = 'BOOLEAN' THEN json_extract(js, '$.is_real')::BOOLEAN
           WHEN rt IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract(js, '$.is_real')::DOUBLE <> 0
           WHEN rt = 'VARCHAR' THEN length(json_extract_string(js, '$.is_real')) > 0
           WHEN rt IN ('ARRAY', 'OBJECT') THEN json_extract(js, '$.is_real')::VARCHAR NOT IN ('[]', '{}')
           ELSE false END AS real,
      CASE WHEN tt = 'VARCHAR' AND json_extract_string(js, '$.change_type') IN ('construction', 'agriculture', 'deforestation', 'water', 'mining', 'other')
           THEN json_extract_string(js, '$.change_type') ELSE '' END AS ctype,
      CASE WHEN kt IS NULL THEN '' WHEN kt = 'NULL' THEN NULL ELSE json_extract_string(js, '$.cause_tr') END AS cause,
      CASE WHEN ct IS NULL OR ct = 'NULL' THEN 0.0
           WHEN ct = 'BOOLEAN' THEN CASE WHEN json_extract(js, '$.confidence')::BOOLEAN THEN 1.0 ELSE 0.0 END
           WHEN ct = 'VARCHAR' THEN CASE WHEN length(json_extract_string(js, '$.confidence')) = 0 THEN 0.0
                                         ELSE TRY_CAST(trim(json_extract_string(js, '$.confidence')) AS DOUBLE) END
           WHEN ct IN ('ARRAY', 'OBJECT') THEN 0.0
           ELSE json_extract(js, '$.confidence')::DOUBLE END AS conf
    FROM k)
  SELECT event_id, CASE WHEN coalesce(ok, false) THEN real END AS ai_is_real,
    CASE WHEN coalesce(ok, false) THEN ctype ELSE '' END AS ai_change_type,
    CASE WHEN coalesce(ok, false) THEN cause ELSE '' END AS ai_cause_tr,
    CASE WHEN coalesce(ok, false) THEN conf ELSE 0.0 END AS ai_confidence, 'fixture-model' AS ai_model
  FROM v"""
O.cte("verdicts", ["changes"], VERDICT_SQL)


def _verdicts(spark, sf):
    return VD.parse_verdicts(fx.model_answers(S.changes(spark, sf)), model="fixture-model")


@register("parse_verdicts", O.build("SELECT * FROM verdicts", "verdicts"))
def q_parse_verdicts(spark, sf):
    return _verdicts(spark, sf)


@register("apply_verdicts", O.build("""
SELECT c.event_id, c.tile_col, v.ai_is_real, v.ai_change_type, v.ai_cause_tr, v.ai_confidence, v.ai_model
FROM changes c LEFT JOIN verdicts v USING (event_id)""", "changes", "verdicts"))
def q_apply_verdicts(spark, sf):
    a = VD.apply_verdicts(S.changes(spark, sf), _verdicts(spark, sf))
    return a.select("event_id", "tile_col", "ai_is_real", "ai_change_type", "ai_cause_tr", "ai_confidence", "ai_model")


@register("drop_ai_false", O.build("""
SELECT c.event_id, v.ai_is_real FROM changes c LEFT JOIN verdicts v USING (event_id)
WHERE v.ai_is_real IS NULL OR v.ai_is_real""", "changes", "verdicts"))
def q_drop_ai_false(spark, sf):
    return VD.drop_ai_false(VD.apply_verdicts(S.changes(spark, sf), _verdicts(spark, sf))).select("event_id", "ai_is_real")


@register("ai_confirmed", O.build("""
SELECT c.event_id FROM changes c JOIN verdicts v USING (event_id) WHERE v.ai_is_real""", "changes", "verdicts"))
def q_ai_confirmed(spark, sf):
    return Q.ai_confirmed(VD.apply_verdicts(S.changes(spark, sf), _verdicts(spark, sf))).select("event_id")


@register("vision_requests", O.build("""
WITH u AS (
  SELECT image_path, CASE WHEN ext = 'png' THEN 'data:image/png;base64,' || to_base64(from_hex('89504E470D0A1A0A') || encode(vec_id::VARCHAR))
                          ELSE 'data:image/jpeg;base64,' || to_base64(from_hex('FFD8FFE0') || encode(vec_id::VARCHAR)) END AS url
  FROM snapnames)
SELECT c.event_id, (b.url IS NOT NULL)::INT + (a.url IS NOT NULL)::INT AS n_images, concat_ws(' ', b.url, a.url) AS image_urls
FROM changes c LEFT JOIN u b ON b.image_path = c.before_image LEFT JOIN u a ON a.image_path = c.after_image""", "changes", "snapnames"))
def q_vision_requests(spark, sf):
    img = _snap_images(spark, sf).select("image", "data")
    r = VD.vision_requests(S.changes(spark, sf), img)
    return r.select("event_id", F.size("image_urls").alias("n_images"), F.concat_ws(" ", "image_urls").alias("image_urls"))


@register("vision_requests_limit", O.build("SELECT event_id FROM changes ORDER BY event_id LIMIT 50", "changes"))
def q_vision_requests_limit(spark, sf):
    img = _snap_images(spark, sf).select("image", "data")
    return VD.vision_requests(S.changes(spark, sf), img, limit=50).select("event_id")


# ---------------------------------------------------------------- vectors

def _vectors(spark, sf):
    m = S.masked(spark, sf, MASK_P)
    return VC.vector_table(m.whole, S.image_vectors(spark, sf, m.snapshots))


@register("vector_table", O.build(f"""
SELECT m.event_id, len(v.embedding) AS dim, {millionths_sql('v.embedding')} AS millionths, m.tile_col, m.tile_row, round(m.importance, 9) AS importance,
  m.episode_id, m.has_regions AS has_mask
FROM masked m JOIN imgvec v ON v.image = CASE WHEN m.after_image <> '' THEN {O.basename('m.after_image')} END""", "masked", "imgvec"))
def q_vector_table(spark, sf):
    """The stored table, replaced as a whole; nothing to write would raise."""
    table = VersionedTable(spark, fresh_path(spark, "vectors"), ["event_id"])
    table.replace(_vectors(spark, sf))
    return R(table.read().select("event_id", F.size("vector").alias("dim"), millionths("vector").alias("millionths"), "tile_col", "tile_row",
                                 "importance", "episode_id", "has_mask"))


def _with_vectors(spark, sf, *columns):
    """Some columns of the changes, stored since the search reads them for its event, for its distances and for its hits, and the
    vectors of the images."""
    snaps = S.snapshots(spark, sf)
    return S.changes(spark, sf, snaps=snaps).select(*columns).checkpoint(eager=True), S.image_vectors(spark, sf, snaps)


def _vt_sql() -> str:
    return f"""SELECT e.event_id, v.embedding AS vector FROM changes e
      JOIN imgvec v ON v.image = CASE WHEN e.after_image <> '' THEN {O.basename('e.after_image')} END"""


O.cte("vt", ["changes", "imgvec"], _vt_sql())
O.cte("vt_dist", ["vt"], f"""
  WITH q AS (SELECT vector FROM vt WHERE event_id = {POINT_EVENT})
  SELECT vt.event_id, {O.sqn_diff('vt.vector', 'q.vector')} AS distance FROM vt CROSS JOIN q""")


@register("similar_changes", O.build(f"""
SELECT row_number() OVER (ORDER BY distance, event_id) AS rank, event_id, round(distance, 9) AS distance
FROM (SELECT * FROM vt_dist ORDER BY distance, event_id LIMIT {K}) WHERE event_id <> {POINT_EVENT}""", "vt_dist"))
def q_similar_changes(spark, sf):
    ch, vectors = _with_vectors(spark, sf, "event_id", "after_image")
    return R(VC.similar_changes(VC.vector_table(ch, vectors), POINT_EVENT, K))


@register("similar_features", O.build(f"""
SELECT h.rank, h.event_id, c.tile_col, c.tile_row, c.candidate_reason
FROM (SELECT row_number() OVER (ORDER BY distance, event_id) AS rank, event_id
      FROM (SELECT * FROM vt_dist ORDER BY distance, event_id LIMIT {K}) WHERE event_id <> {POINT_EVENT}) h
JOIN changes c USING (event_id)""", "vt_dist", "changes"))
def q_similar_features(spark, sf):
    ch, vectors = _with_vectors(spark, sf, "event_id", "after_image", "tile_col", "tile_row", "candidate_reason")
    hits = VC.similar_changes(VC.vector_table(ch, vectors), POINT_EVENT, K)
    return VC.similar_features(hits.select("rank", "event_id"), ch).select("rank", "event_id", "tile_col", "tile_row", "candidate_reason")


@register("similar_batch", O.build(f"""
WITH dv AS (SELECT DISTINCT vector FROM vt),
d AS (SELECT a.vector AS qv, b.vector AS cv, {O.sqn_diff('a.vector', 'b.vector')} AS distance FROM dv a CROSS JOIN dv b),
m AS (SELECT vector, event_id FROM vt),
top AS (
  SELECT q.event_id AS query_event_id, c.event_id, d.distance,
    row_number() OVER (PARTITION BY q.event_id ORDER BY d.distance, c.event_id) AS r
  FROM m q JOIN d ON d.qv = q.vector JOIN m c ON c.vector = d.cv
  QUALIFY r <= {K})
SELECT query_event_id, row_number() OVER (PARTITION BY query_event_id ORDER BY r) AS rank, event_id, round(distance, 9) AS distance
FROM top WHERE event_id <> query_event_id""", "vt"))
def q_similar_batch(spark, sf):
    snaps = S.snapshots(spark, sf)
    v = VC.vector_table(S.changes(spark, sf, snaps=snaps), S.image_vectors(spark, sf, snaps))
    return R(VC.similar_batch(v, K))


# ---------------------------------------------------------------- exports and metrics

def _corners_sql() -> str:
    """West, south, east and north of the first box that is exported: of the first region, else of the tile."""
    side = lambda name, box, tile: f"round(CASE WHEN m.has_regions THEN {box} ELSE {tile} END, 7) AS {name}"
    lon, lat = O.col_to_lon, O.row_to_lat
    return ", ".join([side("west", lon("r.tile_col + r.x0::DOUBLE / r.cells_x"), lon("m.tile_col")),
                      side("south", lat("r.tile_row + r.y1::DOUBLE / r.cells_y"), lat("m.tile_row + 1")),
                      side("east", lon("r.tile_col + r.x1::DOUBLE / r.cells_x"), lon("m.tile_col + 1")),
                      side("north", lat("r.tile_row + r.y0::DOUBLE / r.cells_y"), lat("m.tile_row"))])


def _corners(coordinates):
    """The same from the text of a geometry's coordinates: points 0 and 2 of the first ring are its opposite corners."""
    numbers = F.regexp_extract_all(coordinates, F.lit(r"(-?[0-9][0-9.eE+-]*)"))
    return [F.round(numbers[i].cast("double"), 7).alias(c) for i, c in ((0, "west"), (1, "south"), (4, "east"), (5, "north"))]


EXPORT_SQL = "FROM masked m LEFT JOIN regions r ON r.event_id = m.event_id AND r.region_index = 0"


@register("export_geojson_features", O.build(f"""
SELECT m.event_id, CASE WHEN has_regions THEN mask_type ELSE 'Polygon' END AS geometry_type, {_corners_sql()},
  round(importance, 9) AS importance, NULL::BOOLEAN AS ai_is_real {EXPORT_SQL}""", "masked", "regions"))
def q_export_geojson(spark, sf):
    """FeatureCollections written by the sink and read back."""
    path, f = fresh_path(spark, "geojson"), F.col("feature")
    EX.write_geojson(_masked(spark, sf), path)
    return R(EX.read_features(spark, path).select(
        F.get_json_object(f, "$.properties.event_id").cast("long").alias("event_id"), F.get_json_object(f, "$.geometry.type").alias("geometry_type"),
        *_corners(F.get_json_object(f, "$.geometry.coordinates")), F.get_json_object(f, "$.properties.importance").cast("double").alias("importance"),
        F.get_json_object(f, "$.properties.ai_is_real").cast("boolean").alias("ai_is_real")))


EXPORTED = {
    "event_id": "long", "tile_col": "int", "tile_row": "int", "centroid_lon": "double", "centroid_lat": "double",
    "from_release_id": "string", "from_date": "string", "to_release_id": "string", "to_date": "string", "detected_at": "string",
    "ssim_score": "double", "change_ratio": "double", "largest_run": "int", "dino_similarity": "double",
    "land_cover_from": "string", "land_cover_to": "string", "change_type_tr": "string", "change_type_en": "string",
    "importance": "double", "episode_id": "long", "episode_index": "long", "episode_count": "long", "before_image": "string",
    "after_image": "string",
}


@register("export_ndjson", O.build(f"""
SELECT 'Feature' AS type, CASE WHEN m.has_regions THEN m.mask_type ELSE 'Polygon' END AS geometry_type, {_corners_sql()},
  {", ".join(f"round(m.{c}, 9) AS {c}" if t == "double" else f"m.{c}" for c, t in EXPORTED.items())}
{EXPORT_SQL}""", "masked", "regions"))
def q_export_ndjson(spark, sf):
    """The lines written by the sink, read back: geometry type, corners and properties."""
    path, f = fresh_path(spark, "ndjson"), F.col("feature")
    EX.write_ndjson(_masked(spark, sf), path)
    props = F.from_json(F.get_json_object(f, "$.properties"), ", ".join(f"{c} {t}" for c, t in EXPORTED.items()))
    rows = EX.read_features(spark, path).select(F.get_json_object(f, "$.type").alias("type"), F.get_json_object(f, "$.geometry.type").alias("geometry_type"),
                                                *_corners(F.get_json_object(f, "$.geometry.coordinates")), props.alias("p"))
    return rows.select("type", "geometry_type", "west", "south", "east", "north",
                       *[F.round(f"p.{c}", 9).alias(c) if t == "double" else f"p.{c}" for c, t in EXPORTED.items()])


@register("export_geoparquet", O.build(f"""
SELECT m.event_id, CASE WHEN n.n > 1 THEN 9 + 93 * n.n ELSE 93 END AS wkb_bytes, CASE WHEN n.n > 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type,
  {_corners_sql()}, m.tile_col, m.tile_row, round(m.importance, 9) AS importance, m.episode_id, m.change_type_tr
{EXPORT_SQL} LEFT JOIN (SELECT event_id, count(*) AS n FROM regions GROUP BY 1) n ON n.event_id = m.event_id""", "masked", "regions"))
def q_export_geoparquet(spark, sf):
    """GeoParquet written by the sink and read back, its geometry decoded."""
    path = fresh_path(spark, "geoparquet")
    EX.write_geoparquet(_masked(spark, sf), path)
    sizes = spark.read.parquet(path).select("event_id", F.length("geometry").cast("long").alias("wkb_bytes"))
    g = F.col("geometry")
    back = EX.read_geoparquet(spark, path).select("event_id", F.get_json_object(g, "$.type").alias("geometry_type"), *_corners(F.get_json_object(g, "$.coordinates")),
                                                  "tile_col", "tile_row", F.round("importance", 9).alias("importance"), "episode_id", "change_type_tr")
    return back.join(sizes, "event_id")


@register("summary", O.build("""
SELECT count(*) AS total_changes, count(DISTINCT (tile_col, tile_row)) AS distinct_tiles,
  coalesce(min(CASE WHEN from_date <> '' THEN from_date END), '') AS date_from,
  coalesce(max(CASE WHEN to_date <> '' THEN to_date END), '') AS date_to,
  count(*) FILTER (WHERE land_cover_from <> '' AND land_cover_to <> '') AS labeled,
  count(*) FILTER (WHERE has_regions) AS with_mask, count(DISTINCT episode_id) AS episodes,
  count(*) FILTER (WHERE t.hotspot_id > 0) AS hotspots, count(DISTINCT t.hotspot_id) FILTER (WHERE t.hotspot_id > 0) AS hotspot_clusters
FROM masked JOIN hs_of_tile t USING (tile_col, tile_row)""", "masked", "hs_of_tile"))
def q_summary(spark, sf):
    return EX.summary(HS.hotspots(_masked(spark, sf), HOT_P))


@register("summary_maps", O.build("""
SELECT 'type' AS kind, change_type_tr AS key, count(*) AS n FROM classified GROUP BY 2
UNION ALL
SELECT 'year', substr(to_date, 1, 4), count(*) FROM classified WHERE to_date <> '' GROUP BY 2""", "classified"))
def q_summary_maps(spark, sf):
    maps = EX.summary_maps(S.classified(spark, sf))
    rows = [maps.select(F.lit(kind).alias("kind"), F.explode(c).alias("key", "n")) for kind, c in (("type", "change_types"), ("year", "by_year"))]
    return rows[0].union(rows[1])


@register("step_metrics", O.build("""
SELECT (SELECT count(*) FROM pairs) AS pairs, count(*) AS changes,
  count(*) FILTER (WHERE land_cover_from <> '' AND land_cover_to <> '') AS labelled,
  count(*) FILTER (WHERE has_regions) AS with_mask, count(v.ai_is_real) AS judged, count(DISTINCT episode_id) AS episodes,
  count(*) FILTER (WHERE t.hotspot_id > 0) AS in_hotspots,
  round(count(*) FILTER (WHERE land_cover_from <> '' AND land_cover_to <> '')::DOUBLE / greatest(count(*), 1), 9) AS labelled_share
FROM masked JOIN hs_of_tile t USING (tile_col, tile_row) LEFT JOIN verdicts v USING (event_id)""", "masked", "pairs", "hs_of_tile", "verdicts"))
def q_step_metrics(spark, sf):
    """Observed while the pipeline's result is written; no step runs again to be counted."""
    from chronotile.plans.metrics import StepMetrics
    from chronotile.plans.pipeline import fixture_tables, run_tables

    seen, t = StepMetrics(), fixture_tables(spark, sf)
    out = run_tables(replace(t, answers=fx.model_answers(S.changes(spark, sf, snaps=t.snapshots))), MASK_P, logit_scale=S.PROBE_LOGIT_SCALE, metrics=seen)
    write_pairs(out, fresh_path(spark, "enriched"))
    return R(seen.report(spark))


@register("step_counts", ORACLE["step_metrics"])
def q_step_counts(spark, sf):
    """The same counts from the tables of the steps."""
    m = S.masked(spark, sf, MASK_P)
    # the answers are of the changes, of which an image with two vectors makes more rows once it is classified
    verdicts = VD.parse_verdicts(fx.model_answers(S.changes(spark, sf, snaps=m.snapshots)), model="fixture-model")
    judged = VD.apply_verdicts(HS.hotspots(m.rows, HOT_P), verdicts)
    return R(EX.step_metrics(S.pairs(spark, sf, m.snapshots), judged))


@register("map_layer", O.build(f"""
WITH g AS (SELECT tile_col // 64 * 64 AS c, tile_row // 64 * 64 AS r, count(*) AS n FROM changes GROUP BY 1, 2)
SELECT 'grid' AS layer, round({O.col_to_lon('c')}, 7) AS west, round({O.row_to_lat('r + 64')}, 7) AS south,
  round({O.col_to_lon('c + 64')}, 7) AS east, round({O.row_to_lat('r')}, 7) AS north, n FROM g""", "changes"))
def q_map_layer(spark, sf):
    """The map's features, read back: corners of each grid block and its count."""
    rows = Q.map_layer(S.changes(spark, sf), (0, 2**16 - 1, 0, 2**16 - 1), 10, p=FIXTURE)
    at = lambda i, k: F.get_json_object("feature", f"$.geometry.coordinates[0][{i}][{k}]").cast("double")
    return R(rows.select("layer", at(0, 0).alias("west"), at(0, 1).alias("south"), at(2, 0).alias("east"), at(2, 1).alias("north"),
                         F.get_json_object("feature", "$.properties.count").cast("long").alias("n")), 7)


FEATURE = {**EXPORTED, "hotspot_id": "long", "mask_image": "string", "ai_is_real": "boolean", "ai_change_type": "string", "ai_cause_tr": "string",
           "ai_confidence": "double"}


def _feature_sql() -> str:
    of = {"hotspot_id": "t.hotspot_id", "mask_image": "CASE WHEN m.has_regions THEN 'masks/' || m.event_id || '.png' ELSE '' END",
          **{c: f"v.{c}" for c in FEATURE if c.startswith("ai_")}}
    cols = [f"round({of.get(c, 'm.' + c)}, 9) AS {c}" if FEATURE[c] == "double" else f"{of.get(c, 'm.' + c)} AS {c}" for c in Q.FEATURE_KEYS]
    v = fx.viewports()[0]
    return f"""SELECT 'features' AS layer, 'Feature' AS type, CASE WHEN m.has_regions THEN m.mask_type ELSE 'Polygon' END AS geometry_type, {", ".join(cols)}
FROM masked m JOIN hs_of_tile t USING (tile_col, tile_row) LEFT JOIN verdicts v USING (event_id)
WHERE m.tile_col BETWEEN {v[1]} AND {v[2]} AND m.tile_row BETWEEN {v[3]} AND {v[4]}
ORDER BY m.importance DESC, m.event_id LIMIT 4000"""


@register("map_layer_features", O.build(_feature_sql(), "masked", "hs_of_tile", "verdicts"))
def q_map_layer_features(spark, sf):
    """The map's features at a zoom that shows them, read back: all property keys."""
    judged = VD.apply_verdicts(HS.hotspots(_masked(spark, sf), HOT_P), _verdicts(spark, sf))
    rows = Q.map_layer(judged, fx.viewports()[0][1:], 16, p=FIXTURE)
    f = F.col("feature")
    props = F.from_json(F.get_json_object(f, "$.properties"), ", ".join(f"{c} {FEATURE[c]}" for c in Q.FEATURE_KEYS))
    out = rows.select("layer", F.get_json_object(f, "$.type").alias("type"), F.get_json_object(f, "$.geometry.type").alias("geometry_type"), props.alias("p"))
    return R(out.select("layer", "type", "geometry_type", "p.*"))


PIPELINE_SQL = O.build("""
SELECT m.event_id, m.before_image, m.after_image, round(m.dino_similarity, 9) AS dino_similarity, m.land_cover_from, m.land_cover_to,
  m.change_type_tr, m.change_type_en, CASE WHEN m.has_regions THEN m.mask_type ELSE '' END AS mask_type,
  'Polygon' AS geometry_type, round(m.centroid_lon, 9) AS centroid_lon, round(m.centroid_lat, 9) AS centroid_lat, m.episode_id,
  m.episode_index, m.episode_count, round(m.importance, 9) AS importance, t.hotspot_id
FROM masked m JOIN hs_of_tile t USING (tile_col, tile_row)""", "masked", "hs_of_tile")


def _end_to_end(out):
    return R(out.select("event_id", "before_image", "after_image", "dino_similarity", "land_cover_from", "land_cover_to", "change_type_tr",
                        "change_type_en", F.coalesce(F.get_json_object("geometry_mask", "$.type"), F.lit("")).alias("mask_type"),
                        F.get_json_object("geometry", "$.type").alias("geometry_type"), "centroid_lon", "centroid_lat", "episode_id",
                        "episode_index", "episode_count", "importance", "hotspot_id"))


@register("pipeline_end_to_end", PIPELINE_SQL)
def q_pipeline(spark, sf):
    from chronotile.plans.pipeline import run_pipeline

    return _end_to_end(run_pipeline(spark, sf))


@register("pipeline_tables", PIPELINE_SQL)
def q_pipeline_tables(spark, sf):
    """The same over a folder of stored tables, as a user has them; the events lie there by id range."""
    from chronotile.plans.pipeline import fixture_tables, read_tables, run_tables

    folder, t = fresh_path(spark, "tables"), fixture_tables(spark, sf)
    write_ranges(t.events, f"{folder}/events", "id", RANGE)
    for name in ("snapshots", "embeddings", "probe", "rasters"):
        getattr(t, name).write.parquet(f"{folder}/{name}.parquet")
    return _end_to_end(run_tables(read_tables(spark, folder), MASK_P, logit_scale=S.PROBE_LOGIT_SCALE))
