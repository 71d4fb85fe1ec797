"""Merkle dataset manifest by sibling-shift self-joins.

Nodes are rows (tree, pos, digest). At every level the slot-zero node of each run computes the indices of its run's
nodes (``pos XOR shift`` for a binary tree, ``pos + shift`` otherwise), an equi-join on (tree, index) fetches their
digests, and the slot-zero row then emits the parent, the SHA-256 of the digests as hex text. A level without partner,
a lone node at position 0, ends its tree. Trees over the rows of each group give subroots; one tree over the subroots, in
the order of the groups, gives the root.

A proof is the path of a node: for each level the digests of its run and its own slot in it. Paths are joined top
down, run by run, so that what sixteen leaves share is moved once; ``fold`` recomputes the root from a leaf and a path.

Scale: join keys are (tree, index), which are unique, so a group that holds a third of all rows is spread like any
other. Positions come from one range partition of narrow rows (no texts) with at most one carried count per partition.
Every level is checkpointed; the driver sees one row per partition, one flag per level and the root.

Cases: a null field is `-`, an empty one `0:`; rows with a null id come first in their group; the null group comes first;
rows of one id are ordered by their leaf, equal rows are leaves of their own; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotile.llm.common import prepare
from chronotile.operators.numbering import ordered_checkpoint, with_row_number

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value as text."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest_of(fields: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(c) for c in fields]), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def hash_of(digests: Column) -> Column:
    """Digest of an array of digests, taken as hex text."""
    return F.unhex(F.sha2(F.array_join(F.transform(digests, hex_text), ""), 256))


def tree_key(group: Column) -> Column:
    """Text key whose bytewise order puts the null group first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def positions(rows: DataFrame, order: Sequence) -> DataFrame:
    """Add pos: the position of each row in its tree, by (tree, *order). ``rows`` should be narrow and checkpointed."""
    ranged = ordered_checkpoint(rows, ["tree", *order])
    counts = ranged.groupBy(F.spark_partition_id().alias("part"), "tree").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("carry", F.sum("n").over(before)).where("carry > 0")
    carry = {r["part"]: (r["tree"], r["carry"]) for r in carried.select("part", "tree", "carry").collect()}  # a row per partition at most
    names = ranged.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, upto = carry.get(TaskContext.get().partitionId(), (None, 0))
        for b in batches:
            trees = b.column("tree")
            if b.num_rows == 0:
                continue
            code = trees.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            start = np.repeat(first, np.diff(np.append(first, b.num_rows)))
            pos = np.arange(b.num_rows) - start
            if trees[0].as_py() == last:
                pos[start == 0] += upto
            last, upto = trees[b.num_rows - 1].as_py(), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos.astype(np.int64))], names=[*names, "pos"])

    return ranged.mapInArrow(run, T.StructType([*ranged.schema.fields, T.StructField("pos", T.LongType())]))


def sibling(pos: Column, shift: Column, arity: int) -> Column:
    return pos.bitwiseXOR(shift) if arity == 2 else pos + shift


def level(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, pos, digest) -> runs (tree, run, digests in slot order, lone)."""
    heads = nodes.where(F.col("pos") % arity == 0).select("tree", F.col("pos").alias("head"))
    wanted = heads.withColumn("shift", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(arity - 1).cast("long"))))
    wanted = wanted.withColumn("pos", sibling(F.col("head"), F.col("shift"), arity))
    met = wanted.join(nodes.select("tree", "pos", "digest"), ["tree", "pos"])
    runs = met.groupBy("tree", "head").agg(F.array_sort(F.collect_list(F.struct("shift", "digest"))).alias("slots"))
    return runs.select("tree", F.floor(F.col("head") / arity).cast("long").alias("run"), F.col("slots.digest").alias("digests"),
                       ((F.col("head") == 0) & (F.size("slots") == 1)).alias("lone"))


def build(nodes: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """(levels from the leaves up, tops (tree, digest)); every level is checkpointed."""
    if arity < 2:
        raise ValueError("a run needs two slots at least")
    levels = []
    while True:
        runs = level(nodes, arity).checkpoint(eager=True)
        levels.append(runs)
        if runs.where(~F.col("lone")).isEmpty():
            break
        nodes = runs.where(~F.col("lone")).select("tree", F.col("run").alias("pos"), hash_of(F.col("digests")).alias("digest"))
    tops = levels[0].where("lone")
    for x in levels[1:]:
        tops = tops.unionByName(x.where("lone"))
    return levels, tops.select("tree", F.element_at("digests", 1).alias("digest"))


def _node_path(pos: Column, arity: int) -> Column:
    """Path of the node at pos from its run's row (digests, lone, above)."""
    own = F.struct(F.col("digests"), (pos % arity).cast("int").alias("slot"))
    return F.when(F.col("lone"), F.col("above")).otherwise(F.concat(F.array(own), F.col("above")))


EMPTY_PATH = "CAST(array() AS array<struct<digests:array<binary>,slot:int>>)"


def attach_paths(nodes: DataFrame, levels: list[DataFrame], arity: int = ARITY, beyond: DataFrame | None = None) -> DataFrame:
    """Add path, an array of (digests, slot) from the leaf's level up, to nodes (tree, pos, ...). ``beyond`` continues the
    path over a tree's top: (tree, beyond)."""
    upper = None
    for runs in reversed(levels):
        lone = runs.where("lone")
        if beyond is None:
            known = lone.withColumn("above", F.expr(EMPTY_PATH))
        else:
            known = lone.join(beyond, "tree").withColumnRenamed("beyond", "above")
        known = known.select("tree", "run", "digests", "lone", "above")
        if upper is not None:
            up = upper.withColumnRenamed("run", "up")
            inner = runs.where(~F.col("lone")).select("tree", "run", F.col("digests").alias("mine"), F.floor(F.col("run") / arity).cast("long").alias("up"))
            inner = inner.join(up, ["tree", "up"]).select("tree", "run", "mine", _node_path(F.col("run"), arity).alias("path"))
            known = known.unionByName(inner.select("tree", "run", F.col("mine").alias("digests"), F.lit(False).alias("lone"), F.col("path").alias("above")))
        upper = known
    keyed = nodes.withColumn("run", F.floor(F.col("pos") / arity).cast("long"))
    return keyed.join(upper, ["tree", "run"]).select(*nodes.columns, _node_path(F.col("pos"), arity).alias("path"))


def proof_text(path: Column) -> Column:
    """The siblings of a path as hex text, level by level, left to right."""
    others = lambda e: F.array_join(F.transform(F.filter(e["digests"], lambda d, i: i != e["slot"]), hex_text), "")
    return F.array_join(F.transform(path, others), "")


def fold(leaf: Column, path: Column) -> Column:
    """Root recomputed from a leaf and its path, as hex text."""
    up = lambda acc, e: F.sha2(F.array_join(F.transform(e["digests"], lambda d, i: F.when(i == e["slot"], acc).otherwise(hex_text(d))), ""), 256)
    return F.aggregate(path, hex_text(leaf), up)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id",
             altered: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """(order, group, pos, leaf, subroot, root, path, other) for every row. ``other`` is the leaf with the columns of
    ``altered`` put in place of the stored ones: what a reader would see after tampering."""
    prepare(docs.sparkSession)
    altered = altered or {}
    leaf = digest_of([F.col(c) for c in fields])
    other = digest_of([altered.get(c, F.col(c)) for c in fields]) if altered else leaf
    rows = docs.select(tree_key(F.col(group)).alias("tree"), F.col(order).alias("id"), F.col(group).alias("of"), leaf.alias("digest"), other.alias("other"))
    rows = positions(rows.checkpoint(eager=True), [F.col("id").asc_nulls_first(), "digest"]).checkpoint(eager=True)
    levels, tops = build(rows, arity)
    ranked = with_row_number(tops, ["tree"], "pos", start=0).checkpoint(eager=True)
    groups = ranked.select(F.lit("").alias("tree"), "pos", "digest", F.col("tree").alias("key"))
    upper, roots = build(groups, arity)
    root = (roots.first() or [None, None])[1]
    beyond = attach_paths(groups, upper, arity).select(F.col("key").alias("tree"), F.struct("path", "digest").alias("beyond")).checkpoint(eager=True)
    paths = attach_paths(rows, levels, arity, beyond.select("tree", F.col("beyond.path").alias("beyond")))
    subroot = beyond.select(F.col("tree").alias("sub_tree"), F.col("beyond.digest").alias("subroot"))
    return paths.join(subroot, F.col("tree") == F.col("sub_tree")).select(
        F.col("id").alias(order), F.col("of").alias(group), "pos", F.col("digest").alias("leaf"), "subroot",
        F.lit(bytes(root) if root is not None else None).cast("binary").alias("root"), "path", "other")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else kept; pure ASCII takes the fast function."""
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, az, az.lower()))


def verify_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of ``documents`` with every row checked against the root after a fifth of the texts was tampered with."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    m = manifest(docs, altered={"text": F.when(hit, lower_ascii(F.col("text").cast("string"))).otherwise(F.col("text"))})
    out = m.select("doc_id", hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"),
                   F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), fold(F.col("other"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
