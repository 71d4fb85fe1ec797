"""The batch pipeline over the driver tables, one lazily composed DataFrame per step.

Each function takes (spark, sf_dir) and derives its input from the parquet tables, so every registered query
reads the given tables and its work grows with them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotile.functions import geo
from chronotile.operators.embed import pair_similarity
from chronotile.operators.episodes import episodes
from chronotile.operators.importance import importance
from chronotile.operators.landcover import classify_changes, probe_from_means, score_images
from chronotile.operators.noise import noise_filter
from chronotile.operators.pairs import build_pairs
from chronotile.params import FIXTURE, Params
from chronotile.plans.store import bucketed, served, write_changes, write_named
from chronotile.session import ensure_checkpoint_dir
from chronotile.sources import fixtures as fx

# The fixture probe (per-label mean vectors) turns dot products into logits with this factor.
PROBE_LOGIT_SCALE = 120.0


def events(spark: SparkSession, sf: str) -> DataFrame:
    return fx.change_events(spark, sf)


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Stored once: every join with them or their images reads this table, and no condition moves below its distinct."""
    ensure_checkpoint_dir(spark)
    return fx.tile_snapshots(spark, sf).checkpoint(eager=True)


def image_vectors(spark: SparkSession, sf: str, snaps: DataFrame | None = None) -> DataFrame:
    return fx.image_embeddings(spark, sf, snapshots(spark, sf) if snaps is None else snaps)


def pairs(spark: SparkSession, sf: str, snaps: DataFrame | None = None) -> DataFrame:
    return build_pairs(events(spark, sf), snapshots(spark, sf) if snaps is None else snaps)


def pairs_with_similarity(spark: SparkSession, sf: str, snaps: DataFrame | None = None) -> DataFrame:
    snaps = snapshots(spark, sf) if snaps is None else snaps
    return pair_similarity(pairs(spark, sf, snaps), image_vectors(spark, sf, snaps))


def changes(spark: SparkSession, sf: str, p: Params = FIXTURE, snaps: DataFrame | None = None) -> DataFrame:
    return noise_filter(pairs_with_similarity(spark, sf, snaps), p)


def probe(spark: SparkSession, sf: str) -> DataFrame:
    return probe_from_means(fx.labelled_vectors(spark, sf))


def image_scores(spark: SparkSession, sf: str, p: Params = FIXTURE, snaps: DataFrame | None = None) -> DataFrame:
    return score_images(image_vectors(spark, sf, snaps), probe(spark, sf), p, logit_scale=PROBE_LOGIT_SCALE)


def image_table(spark: SparkSession, sf: str, p: Params = FIXTURE) -> DataFrame:
    """Every image once with its vector and land cover, in buckets of the image name: the stored side of the similarity, land-cover
    and vector joins."""
    vectors = image_vectors(spark, sf).select("image", "embedding").checkpoint(eager=True)
    scores = score_images(vectors, probe(spark, sf), p, logit_scale=PROBE_LOGIT_SCALE)
    return bucketed(vectors.join(scores, "image"), "images", "image")


def classified(spark: SparkSession, sf: str, p: Params = FIXTURE, snaps: DataFrame | None = None) -> DataFrame:
    snaps = snapshots(spark, sf) if snaps is None else snaps
    return classify_changes(changes(spark, sf, p, snaps), image_scores(spark, sf, p, snaps))


def with_tile_geometry(df: DataFrame, zoom: int = 16) -> DataFrame:
    """``geometry`` (tile polygon GeoJSON text) and the tile centroid."""
    return df.select(
        "*",
        geo.tile_polygon_json("tile_col", "tile_row", zoom).alias("geometry"),
        geo.tile_centroid_lon("tile_col", zoom).alias("centroid_lon"),
        geo.tile_centroid_lat("tile_row", zoom).alias("centroid_lat"),
    )


def _placed(df: DataFrame) -> DataFrame:
    """``with_tile_geometry`` with its columns before those of the episodes."""
    new = ["geometry", "centroid_lon", "centroid_lat"]
    at = df.columns.index("episode_id")
    return with_tile_geometry(df).select(*df.columns[:at], *new, *df.columns[at:])


def _enriched(stored: DataFrame, p: Params) -> DataFrame:
    """Episodes and importance of stored changes, yet without the geometry: a long text that only the finished row needs."""
    return importance(episodes(stored, stored=True), p, dates=stored)


def enriched(spark: SparkSession, sf: str, p: Params = FIXTURE) -> DataFrame:
    """Changes after classify + geometry + episodes + importance (the table the map queries serve)."""
    return _placed(_enriched(classified(spark, sf, p).checkpoint(eager=True), p))


@dataclass(frozen=True)
class Masked:
    """Masked and enriched changes (``rows``, without geometry), and the stored tables that they are made from."""

    snapshots: DataFrame
    changes: DataFrame
    rows: DataFrame

    @property
    def whole(self) -> DataFrame:
        return _placed(self.rows)


def masked(spark: SparkSession, sf: str, mask_p: Params, p: Params = FIXTURE) -> Masked:
    from chronotile.operators.mask import mask_changes

    snaps = snapshots(spark, sf)
    stored = classified(spark, sf, p, snaps).checkpoint(eager=True)
    return Masked(snaps, stored, mask_changes(_enriched(stored, p), fx.gray_images(spark, sf, snaps), mask_p, of=stored))


def _tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [fx.table(spark, sf, t) for t in ("orders", "embeddings")]


def served_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The stored changes of the map queries: masked and enriched, in Z-order."""
    made = []

    def build() -> DataFrame:
        made.append(masked(spark, sf, FIXTURE.with_(cell_size=1, diff_threshold=60, min_area=4)))
        return made[0].rows

    def write(rows: DataFrame, path: str) -> None:
        write_changes(rows, path, rows=made[0].changes.count(), widen=_placed)

    return served(_tables(spark, sf), "changes", build, write)


def served_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    from chronotile.plans.pyramid import pyramid, write_pyramid

    return served(_tables(spark, sf), "pyramid", lambda: pyramid(served_changes(spark, sf)), write_pyramid)


def served_images(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        return fx.snapshot_images(snapshots(spark, sf)).select("image", "data")

    return served(_tables(spark, sf), "images", build, write_named)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column for engine-independent comparison (float results differ in the last ulp
    between the JVM and C math libraries)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
