"""The driver's test tables mapped onto the land-change data model (see FIXTURES.md §B).

Everything here is derived by Spark from the parquet tables in ``sf_dir``, so the work grows with them:

* ``change_events``  <- ``orders`` (one event per order; 25 dense tile regions plus scattered noise)
* ``tile_snapshots`` <- the releases the events name (image identity only; some snapshots are missing)
* ``image_embeddings`` <- snapshots joined to ``embeddings.vec_id`` (one vector per image name)
* ``labelled_vectors`` <- ``embeddings`` with the label id mapped to a land-cover name
* ``raster_images``  <- 8x8 rasters of three channels derived from the image vectors, ``gray_images`` their gray levels
* ``labelled_files`` <- labelled image files, some without bytes
* ``model_answers``  <- raw vision-model answer texts built from the event id
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotile.functions.images import image_file_name, image_rel_path

# EuroSAT label order (label id -> name), as used by the land-cover probe.
LABELS = [
    "AnnualCrop",
    "Forest",
    "Shrubland",
    "Highway",
    "Industrial",
    "Pasture",
    "PermanentCrop",
    "Residential",
    "River",
    "SeaLake",
]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dstr(d: Column) -> Column:
    return d.cast("string")


def _release(s: Column) -> Column:
    return F.concat(F.lit("WB "), F.substring(s, 1, 4), F.lit("/"), F.substring(s, 6, 2))


def _dated_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tile_col, tile_row and both days (d0, d1) of every event."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d0")
    )
    k, i = F.col("k"), F.col("id")
    q = F.floor(k / 25)
    c = k % 25
    scattered = (k % 7) == 0
    tile_col = F.when(scattered, 41500 + (k * 131) % 20011).otherwise(37600 + (c % 5) * 600 + (q * 37) % 121 - 60)
    tile_row = F.when(scattered, 20000 + (k * 57) % 9973).otherwise(24400 + F.floor(c / 5) * 240 + (q * 53) % 121 - 60)
    d1 = F.date_add(F.col("d0"), ((i * 13) % 400 + 20).cast("int"))
    return o.select("id", tile_col.cast("int").alias("tile_col"), tile_row.cast("int").alias("tile_row"), "d0", d1.alias("d1"))


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _dated_tiles(spark, sf_dir).select("id", "tile_col", "tile_row", _dstr(F.col("d0")).alias("s0"), _dstr(F.col("d1")).alias("s1"))
    i = F.col("id")
    s0, s1 = F.col("s0"), F.col("s1")
    return t.select(
        "id",
        "tile_col",
        "tile_row",
        _release(s0).alias("from_release_id"),
        F.concat(s0, F.lit("T00:00:00")).alias("from_date"),
        _release(s1).alias("to_release_id"),
        F.when(i % 211 == 0, F.lit("")).otherwise(F.concat(s1, F.lit("T00:00:00"))).alias("to_date"),
        F.concat(s1, F.lit("T12:00:00")).alias("detected_at"),
        ((i % 97).cast("double") / 97.0).alias("ssim_score"),
        ((i % 100).cast("double") / 100.0).alias("change_ratio"),
        (i % 9).cast("int").alias("largest_run"),
    )


def tile_snapshots(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Snapshot identity table: release_id, tile_col, tile_row, vec_id, ext (unique on the key). Without ``events`` those of all
    events, told apart by the number of their month before any text is made."""
    if events is None:
        month = [F.year(d) * 12 + F.month(d) for d in ("d0", "d1")]
        v = _dated_tiles(spark, sf_dir).select(F.explode(F.array(*month)).alias("m"), "tile_col", "tile_row").distinct()
        text = F.to_date(F.make_date(F.floor((F.col("m") - 1) / 12).cast("int"), (F.col("m") - 1) % 12 + 1, F.lit(1))).cast("string")
        v = v.withColumn("release_id", _release(text))
    else:
        sides = F.explode(F.array("from_release_id", "to_release_id")).alias("release_id")
        r = events.select(sides, "tile_col", "tile_row").distinct()
        v = r.withColumn("m", F.substring("release_id", 4, 4).cast("int") * 12 + F.substring("release_id", 9, 2).cast("int"))
    vector_ids = F.lit(table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1)  # all vectors are used
    col, row, mm = F.col("tile_col"), F.col("tile_row"), F.col("m")
    return v.where((col + row + mm) % 23 != 0).select(
        "release_id",
        "tile_col",
        "tile_row",
        ((col * 31 + row * 17 + mm * 7) % vector_ids).cast("long").alias("vec_id"),
        F.when((col + mm) % 3 == 0, F.lit("png")).otherwise(F.lit("jpg")).alias("ext"),
    )


def snapshot_images(snapshots: DataFrame) -> DataFrame:
    """Snapshots with their stored image name and a synthetic encoded payload (magic bytes + vector id)."""
    magic = F.when(F.col("ext") == "png", F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("FFD8FFE0")))
    return snapshots.select(
        "*",
        image_file_name("tile_col", "tile_row", "release_id", "ext").alias("image"),
        image_rel_path("tile_col", "tile_row", "release_id", "ext").alias("image_path"),
        F.concat(magic, F.col("vec_id").cast("string").cast("binary")).alias("data"),
        F.when(F.col("ext") == "png", F.lit("image/png")).otherwise(F.lit("image/jpeg")).alias("content_type"),
    )


def image_embeddings(spark: SparkSession, sf_dir: str, snapshots: DataFrame) -> DataFrame:
    """Embedding cache table (image, embedding, dim): one vector per distinct image name."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    names = snapshot_images(snapshots).select("image", "vec_id").distinct()
    return names.join(emb, "vec_id").select("image", "embedding", F.size("embedding").alias("dim"))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled vectors (the labelled image set after embedding): vec_id, embedding, label, label_name."""
    names = spark.createDataFrame([(i, n) for i, n in enumerate(LABELS)], "label int, label_name string")
    emb = table(spark, sf_dir, "embeddings")
    return emb.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).join(
        F.broadcast(names), "label", "inner"
    ).select("vec_id", "embedding", "label", "label_name")


def raster_images(spark: SparkSession, sf_dir: str, snapshots: DataFrame) -> DataFrame:
    """Raw 8x8 rasters from 64-float vectors: with x = clamp(floor(128 + 400 v + 0.5), 0, 255), blue is 7 x mod 256, green is
    x, red is min(255, x + 20). Columns image, height, width, channels, data (BGR bytes)."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    names = snapshot_images(snapshots).select("image", "vec_id").distinct()

    def level(v: Column) -> Column:
        return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.lit(128.0) + F.lit(400.0) * v.cast("double") + 0.5))).cast("int")

    def pixel(x: Column) -> Column:
        return F.concat(*[F.lpad(F.hex(c), 2, "0") for c in (x * 7 % 256, x, F.least(F.lit(255), x + 20))])

    pixels = F.transform(F.transform("embedding", level), pixel)
    one = emb.select("vec_id", F.to_binary(F.array_join(pixels, ""), F.lit("hex")).alias("data"))
    return names.join(one, "vec_id").select("image", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("channels"), "data")


def gray_images(spark: SparkSession, sf_dir: str, snapshots: DataFrame) -> DataFrame:
    """Decoded gray images: image, height, width, data (a byte for each pixel, row-major)."""
    from chronotile.operators.raster import gray_images as decode

    return decode(raster_images(spark, sf_dir, snapshots))


def label_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LABELS)), "label int, label_name string")


def labelled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled image files (image struct<bytes,path>, label): the bytes are a PNG mark and the vector's text, every 17th has no
    bytes and every 19th empty ones."""
    v = F.col("vec_id")
    data = F.when(v % 17 == 0, F.lit(None)).when(v % 19 == 0, F.lit(b"")).otherwise(
        F.concat(F.unhex(F.lit("89504E470D0A1A0A")), v.cast("string").cast("binary")))
    return table(spark, sf_dir, "embeddings").select(
        F.struct(data.alias("bytes"), F.concat(F.lit("Forest_"), v.cast("string"), F.lit(".png")).alias("path")).alias("image"), "label")


def model_answers(changes: DataFrame) -> DataFrame:
    """Raw model answers per event covering the parse cases: valid JSON, JSON in prose, invalid text, array,
    unknown type, string "false", non-numeric confidence, numeric zero, missing keys."""
    e = F.col("event_id")
    v = e % 9
    conf = F.format_string("0.%d", (e % 10))
    text = (
        F.when(v == 0, F.format_string('{"is_real": true, "change_type": "construction", "cause_tr": "yeni bina %d", "confidence": %s}', e, conf))
        .when(v == 1, F.format_string('Analiz: {"is_real": false, "change_type": "water", "cause_tr": "golet", "confidence": %s} bitti', conf))
        .when(v == 2, F.lit("yanit yok"))
        .when(v == 3, F.lit('[{"is_real": true}]'))
        .when(v == 4, F.format_string('{"is_real": 1, "change_type": "volcano", "cause_tr": "lav", "confidence": "%s"}', conf))
        .when(v == 5, F.lit('{"is_real": "false", "change_type": "mining", "confidence": 0.5}'))
        .when(v == 6, F.lit('{"is_real": true, "change_type": "other", "cause_tr": "x", "confidence": "high"}'))
        .when(v == 7, F.lit('{"is_real": 0, "change_type": ["water"], "cause_tr": null, "confidence": 0}'))
        .otherwise(F.lit('{"change_type": "agriculture"}'))
    )
    return changes.select("event_id", text.alias("text"))


def viewports() -> list[tuple[int, int, int, int, int]]:
    """25 tile ranges around the fixture region centres: (viewport_id, min_col, max_col, min_row, max_row)."""
    out = []
    for i in range(5):
        for j in range(5):
            cc, cr = 37600 + 600 * i, 24400 + 240 * j
            out.append((i * 5 + j, cc - 60, cc + 60, cr - 60, cr + 60))
    return out
