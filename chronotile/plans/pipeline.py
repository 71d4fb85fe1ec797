"""The batch pipeline with a skip list (O1): one lazy DataFrame chain, materialised where a result is reused.

pairs -> similarity -> noise filter -> classify -> mask -> enrich (geometry, episodes, importance, hotspots)
-> optional drop of model-rejected rows. Narration is not part of the pipeline (its answers come from outside).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from py4j.java_gateway import java_import
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotile.operators.embed import pair_similarity
from chronotile.operators.episodes import episodes
from chronotile.operators.hotspots import hotspots
from chronotile.operators.importance import importance
from chronotile.operators.landcover import classify_changes, score_images
from chronotile.operators.mask import mask_changes
from chronotile.operators.noise import noise_filter
from chronotile.operators.pairs import build_pairs
from chronotile.operators.raster import gray_images
from chronotile.operators.verdicts import apply_verdicts, drop_ai_false, parse_verdicts
from chronotile.params import FIXTURE, Params
from chronotile.plans import stages as S
from chronotile.plans.metrics import StepMetrics, change_counts, enriched_counts
from chronotile.sources import fixtures as fx
from chronotile.sources.events import scan_change_events, validate_source
from chronotile.sources.ranged import MANIFEST, read_ranges

STEPS = ("classify", "mask", "enrich")


@dataclass(frozen=True)
class Tables:
    """The inputs of a run. ``events`` (id, tile_col, tile_row, from_release_id, to_release_id, optional columns), ``snapshots``
    (release_id, tile_col, tile_row, ext), ``embeddings`` (image, embedding); ``probe`` (label, label_name, weights[, bias]) for
    classify, ``rasters`` (image, height, width, channels, data) for mask, ``answers`` (event_id, text) of a model if there are
    any. ``low_events``: these events and the rows of theirs whose id is null or at most 0, where their source selects them without
    reading the others; it serves only as long as ``events`` is that table."""

    events: DataFrame
    snapshots: DataFrame
    embeddings: DataFrame
    probe: DataFrame | None = None
    rasters: DataFrame | None = None
    answers: DataFrame | None = None
    low_events: tuple[DataFrame, DataFrame] | None = None


STORED = tuple(x for x in Tables.__dataclass_fields__ if x != "low_events")


def _exists(spark: SparkSession, path: str) -> bool:
    java_import(spark._jvm, "org.apache.hadoop.fs.Path")
    at = spark._jvm.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_tables(spark: SparkSession, folder: str) -> Tables:
    """The tables of a folder, each a Parquet file or folder ``<name>`` or ``<name>.parquet``; events may also be stored by key
    range. Required ones that are missing raise; the events' required columns are checked."""

    ranged = {}

    def read(name: str) -> DataFrame | None:
        for path in (f"{folder}/{name}", f"{folder}/{name}.parquet"):
            if _exists(spark, f"{path}/{MANIFEST}"):
                ranged[name] = path
                return read_ranges(spark, path)
            if _exists(spark, path):
                return spark.read.parquet(path)
        return None

    found = {name: read(name) for name in STORED}
    missing = [n for n in ("events", "snapshots", "embeddings") if found[n] is None]
    if missing:
        raise ValueError(f"tables missing in {folder}: {missing}")
    validate_source(found["events"], found["snapshots"])
    events, low = scan_change_events(found["events"]), None
    if "events" in ranged and isinstance(events.schema["id"].dataType, T.IntegralType):
        # the scan takes conditions as an argument only: those of a plan over it would read every file
        some = [read_ranges(spark, ranged["events"], [where]) for where in (("id", "<=", 0), ("id", "null"))]
        low = (events, scan_change_events(some[0].union(some[1])))
    return Tables(**{**found, "events": events, "low_events": low})


def run_tables(t: Tables, p: Params, skip: Iterable[str] = (), logit_scale: float = 1.0,
               metrics: StepMetrics | None = None) -> DataFrame:
    """The enriched changes of the given tables. A step that lacks its table must be in ``skip``. ``metrics`` observes the steps;
    its values are complete once the result has been written."""
    skip = set(skip)
    unknown = skip - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    for step, table in (("classify", t.probe), ("mask", t.rasters)):
        if step not in skip and table is None:
            raise ValueError(f"no table for the step {step}")
    low = t.low_events[1] if t.low_events and t.low_events[0] is t.events else None
    pairs = build_pairs(t.events, t.snapshots, low=low)
    if metrics:
        pairs = metrics.observe("pairs", pairs, pairs=F.count(F.lit(1)))
    changes = noise_filter(pair_similarity(pairs, t.embeddings), p)
    if "classify" not in skip:
        changes = classify_changes(changes, score_images(t.embeddings, t.probe, p, logit_scale=logit_scale))
    if "mask" not in skip:
        # masks are joined back to the changes that they are made from: without a cut both joins and the scores run twice
        changes = changes.checkpoint(eager=True)
        changes = mask_changes(changes, gray_images(t.rasters), p)
    if t.answers is not None:
        changes = apply_verdicts(changes, parse_verdicts(t.answers.select("event_id", F.col("text").cast("string").alias("text"))))
    if metrics:
        changes = metrics.observe("changes", changes, **change_counts(changes))
    if "enrich" not in skip:
        # the enrich input is reused by episodes, importance and hotspots: cut the lineage once
        base = S.with_tile_geometry(changes, p.zoom).checkpoint(eager=True)
        changes = hotspots(importance(episodes(base, stored=True), p, dates=base), p)
        if metrics:
            changes = metrics.observe("enriched", changes, **enriched_counts())
        if p.drop_ai_false and "ai_is_real" in changes.columns:
            changes = drop_ai_false(changes)
    return changes


def fixture_tables(spark: SparkSession, sf: str) -> Tables:
    snaps = S.snapshots(spark, sf)
    return Tables(S.events(spark, sf), snaps, S.image_vectors(spark, sf, snaps), S.probe(spark, sf), fx.raster_images(spark, sf, snaps))


def run_pipeline(spark: SparkSession, sf: str, p: Params = FIXTURE, skip: Iterable[str] = (),
                 mask_params: Params | None = None) -> DataFrame:
    """The pipeline over the driver tables."""
    m = mask_params or p.with_(cell_size=1, diff_threshold=60, min_area=4)
    p = p.with_(cell_size=m.cell_size, diff_threshold=m.diff_threshold, min_area=m.min_area)
    return run_tables(fixture_tables(spark, sf), p, skip, S.PROBE_LOGIT_SCALE)
