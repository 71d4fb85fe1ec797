"""Yield of the pipeline's steps, observed while its result is written.

Each step's counts ride on the rows as they pass (``DataFrame.observe``), so no step runs again to be counted. Values are there
once an action has run through the step. Spark adds a task's counts when it ends; a shuffle stage that is repeated after
a lost executor may count its rows again, so these are figures for monitoring. ``export.step_metrics`` counts a stored table
exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Columns of the report, in order.
REPORT = ["pairs", "changes", "labelled", "with_mask", "judged", "episodes", "in_hotspots"]


class StepMetrics:
    def __init__(self):
        self.steps: dict[str, Observation] = {}

    def observe(self, step: str, rows: DataFrame, **counts: Column) -> DataFrame:
        self.steps[step] = Observation()
        return rows.observe(self.steps[step], *[c.alias(name) for name, c in counts.items()])

    def values(self) -> dict[str, int]:
        """All counts seen; waits for the action that runs through the steps."""
        return {k: v for o in self.steps.values() for k, v in o.get.items()}

    def report(self, spark: SparkSession) -> DataFrame:
        """One row of REPORT (0 for a step that did not run) and the labelled share."""
        seen = self.values()
        row = [int(seen.get(k) or 0) for k in REPORT]
        one = spark.createDataFrame([tuple(row)], ", ".join(f"{k} long" for k in REPORT))
        return one.withColumn("labelled_share", F.col("labelled") / F.greatest(F.col("changes"), F.lit(1)))


def change_counts(changes: DataFrame) -> dict[str, Column]:
    """Counts of the changes before they are enriched; a column that a skipped step would have made counts 0."""
    has = lambda *names: set(names) <= set(changes.columns)
    none = F.sum(F.lit(0))
    both = (F.col("land_cover_from") != "") & (F.col("land_cover_to") != "")
    return {
        "changes": F.count(F.lit(1)),
        "labelled": F.count_if(both) if has("land_cover_from", "land_cover_to") else none,
        "with_mask": F.count_if(F.col("geometry_mask") != "") if has("geometry_mask") else none,
        "judged": F.count("ai_is_real") if has("ai_is_real") else none,
    }


def enriched_counts() -> dict[str, Column]:
    """Episodes are numbered without gaps from 1, so the greatest number counts them."""
    return {"episodes": F.max("episode_id"), "in_hotspots": F.count_if(F.col("hotspot_id") > 0)}
