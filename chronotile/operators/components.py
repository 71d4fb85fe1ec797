"""Connected components of an undirected graph given as an edge DataFrame (u, v of type long).

Alternating large-star / small-star (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
O(log^2 n) rounds, every round a few joins and partial aggregates. Each round is checkpointed to the cluster's
checkpoint folder, so the lineage stays short and a lost executor recomputes one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.session import ensure_checkpoint_dir


def _norm(e: DataFrame) -> DataFrame:
    """Edges as (u, v) with u > v, no self loops, no duplicates."""
    return (
        e.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = both.groupBy("u").agg(F.min("v").alias("mv")).select("u", F.least("u", "mv").alias("m"))
    out = both.join(m, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _norm(out)


def _small_star(e: DataFrame) -> DataFrame:
    # e is normalised: v < u, so v ranges over the smaller neighbours of u
    m = e.groupBy("u").agg(F.min("v").alias("m"))
    spokes = e.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    centre = m.select("u", F.col("m").alias("v"))
    return _norm(spokes.union(centre))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 64) -> DataFrame:
    """Return (node, component) where component is the smallest node id of the component.

    ``nodes`` (column ``node``) adds isolated nodes; they are their own component."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = _norm(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))).checkpoint(eager=True)
    for _ in range(max_rounds):
        nxt = _small_star(_large_star(e)).checkpoint(eager=True)
        # both set differences in one job: empty means the star graph is stable
        changed = nxt.exceptAll(e).union(e.exceptAll(nxt)).limit(1).count()
        e = nxt
        if changed == 0:
            break
    else:
        raise RuntimeError("connected components did not converge")
    both = e.select(F.col("u").alias("node"), F.col("v").alias("nb")).union(
        e.select(F.col("v").alias("node"), F.col("u").alias("nb"))
    )
    comp = both.groupBy("node").agg(F.least(F.col("node"), F.min("nb")).alias("component"))
    if nodes is not None:
        iso = nodes.select(F.col("node").cast("long")).distinct().join(comp, "node", "left_anti")
        comp = comp.unionByName(iso.select("node", F.col("node").alias("component")))
    return comp
