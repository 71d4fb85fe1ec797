"""Event normalisation, before/after image pairing and the image store (steps P1-P7, J1, F11, S7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotile.functions.images import image_rel_path, sniff_extension
from chronotile.operators.numbering import with_row_number
from chronotile.schema import EVENT_OPTIONAL, PAIR_COLUMNS, conform

_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:\.(\d{1,6}))?)?(Z|[+-]\d{2}:\d{2})?$"


def iso_text(x) -> Column:
    """ISO-8601 text as a parsed-then-formatted datetime: date only gets T00:00:00, ' ' becomes 'T',
    missing seconds become :00, a fraction is printed with 6 digits unless zero, Z becomes +00:00.
    Empty or null gives ''; text that does not parse is kept."""
    s = F.col(x) if isinstance(x, str) else x
    ok = s.rlike(_ISO)
    day = F.regexp_extract(s, _ISO, 1)
    hm = F.regexp_extract(s, _ISO, 2)
    sec = F.regexp_extract(s, _ISO, 3)
    frac = F.regexp_extract(s, _ISO, 4)
    tz = F.regexp_extract(s, _ISO, 5)
    time = F.when(hm == "", F.lit("00:00:00")).otherwise(F.concat(hm, F.when(sec == "", F.lit(":00")).otherwise(sec)))
    frac6 = F.rpad(frac, 6, "0")
    frac_txt = F.when((frac == "") | (frac6 == "000000"), F.lit("")).otherwise(F.concat(F.lit("."), frac6))
    tz_txt = F.when(tz == "Z", F.lit("+00:00")).otherwise(tz)
    formatted = F.concat(day, F.lit("T"), time, frac_txt, tz_txt)
    # Fast path without regex: 'YYYY-MM-DDTHH:MM:SS' prints back unchanged when it parses and is kept unchanged
    # when it does not, so any 19-character text with the separators in place can pass through as is.
    canonical = (F.length(s) == 19) & (F.substring(s, 5, 1) == "-") & (F.substring(s, 8, 1) == "-") & (
        F.substring(s, 11, 1) == "T") & (F.substring(s, 14, 1) == ":") & (F.substring(s, 17, 1) == ":")
    return F.when(s.isNull() | (s == ""), F.lit("")).when(canonical, s).when(ok, formatted).otherwise(s)


def _typed(events: DataFrame) -> DataFrame:
    """The columns of an event, typed; the id as it is."""
    ev = conform(events, EVENT_OPTIONAL)
    cols = []
    for name, (dtype, default) in EVENT_OPTIONAL.items():
        if name in ("from_date", "to_date", "detected_at"):
            cols.append(iso_text(F.col(name).cast("string")).alias(name))
        else:
            cols.append(F.coalesce(F.col(name).try_cast(dtype), F.lit(default).cast(dtype)).alias(name))
    return ev.select(
        F.col("id").cast("long").alias("id"),
        F.col("tile_col").cast("int").alias("tile_col"),
        F.col("tile_row").cast("int").alias("tile_row"),
        F.col("from_release_id").cast("string").alias("from_release_id"),
        F.col("to_release_id").cast("string").alias("to_release_id"),
        *cols,
    )


def normalize_events(events: DataFrame, fallback_ids: bool = True, low: DataFrame | None = None) -> DataFrame:
    """Raw change events -> typed rows: missing or falsy metrics become 0 / '', dates ISO text,
    and an id that is null or 0 becomes the 0-based position in ``ORDER BY id`` (nulls first).

    ``fallback_ids=False`` (streams, where a global position does not exist) keeps the id as it is. ``low``: the rows of ``events``
    whose id is null or at most 0, from a source that selects them without a scan of the others."""
    bad_id = F.col("id").isNull() | (F.col("id") == 0)
    base = _typed(events)
    if not fallback_ids:
        return base.select(F.col("id").alias("event_id"), *[c for c in base.columns if c != "id"])
    good = base.where(~bad_id).withColumn("event_id", F.col("id"))
    # Rows needing a fallback id: their position = rows ordered before them. Only that (normally empty)
    # subset is numbered; rows with a negative id sort before 0, so they add a scalar offset.
    bad = (base if low is None else _typed(low)).where(bad_id)
    out_cols = ["event_id", *[c for c in base.columns if c != "id"]]
    # one pruned scan of the id column (the predicate reaches the Parquet reader) sizes both
    few = (events if low is None else low).where(F.col("id").isNull() | (F.col("id") <= 0))
    seen = few.agg(F.count_if(bad_id).alias("bad"), F.count_if(F.col("id") < 0).alias("neg")).first()
    if seen["bad"] == 0:
        return good.select(*out_cols)
    n_neg = F.lit(seen["neg"])
    order = [F.col("id").asc_nulls_first(), "tile_col", "tile_row", "from_release_id", "to_release_id", "to_date"]
    numbered = with_row_number(bad, order, "pos", start=0)
    fixed = numbered.withColumn(
        "event_id", F.when(F.col("id").isNull(), F.col("pos")).otherwise(F.col("pos") + n_neg)
    ).drop("pos")
    return good.unionByName(fixed).select(*out_cols)


def _side(snaps: DataFrame, release_col: str, out: str) -> DataFrame:
    return snaps.select(
        F.col("release_id").alias(release_col),
        "tile_col",
        "tile_row",
        image_rel_path("tile_col", "tile_row", "release_id", "ext").alias(out),
    )


def build_pairs(events: DataFrame, snapshots: DataFrame, fallback_ids: bool = True, low: DataFrame | None = None) -> DataFrame:
    """One row per event with ``before_image`` / ``after_image`` relative names ('' when the snapshot is missing).

    Two left equi-joins on (release, col, row). Image bytes never enter the pair table; the snapshot
    side carries only the key and the extension (a few bytes per row). ``low`` as in ``normalize_events``."""
    ev = normalize_events(events, fallback_ids=fallback_ids, low=low)
    snaps = snapshots.select("release_id", "tile_col", "tile_row", "ext")
    keys_before = ["from_release_id", "tile_col", "tile_row"]
    keys_after = ["to_release_id", "tile_col", "tile_row"]
    pairs = ev.join(_side(snaps, "from_release_id", "before_image"), keys_before, "left").join(
        _side(snaps, "to_release_id", "after_image"), keys_after, "left"
    )
    return pairs.select(
        *[c for c in PAIR_COLUMNS if c not in ("before_image", "after_image")],
        F.coalesce("before_image", F.lit("")).alias("before_image"),
        F.coalesce("after_image", F.lit("")).alias("after_image"),
    )


def with_both_snapshots(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events whose before and after snapshots both exist (two left-semi joins)."""
    s = snapshots.select("release_id", "tile_col", "tile_row")
    before = s.withColumnRenamed("release_id", "from_release_id")
    after = s.withColumnRenamed("release_id", "to_release_id")
    return events.join(before, ["from_release_id", "tile_col", "tile_row"], "left_semi").join(
        after, ["to_release_id", "tile_col", "tile_row"], "left_semi"
    )


def image_store(snapshots: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Images to write: one row per (col, row, release) with a non-empty payload, named by sniffed format,
    minus names already present in ``existing`` (left-anti). Shared images are stored once."""
    s = snapshots.where(F.col("data").isNotNull() & (F.length("data") > 0)).dropDuplicates(
        ["tile_col", "tile_row", "release_id"]
    )
    named = s.select(
        "release_id",
        "tile_col",
        "tile_row",
        image_rel_path("tile_col", "tile_row", "release_id", sniff_extension("data")).alias("image_path"),
        "data",
    )
    if existing is not None:
        named = named.join(existing.select("image_path"), "image_path", "left_anti")
    return named


def write_image_store(images: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet image store partitioned by release (the sink of ``image_store``)."""
    images.write.mode(mode).partitionBy("release_id").parquet(path)
