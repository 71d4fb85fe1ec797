"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Size of a document: its words (runs of other than ASCII white space). Sources in code-point order, null last, weigh
WEIGHTS repeating and share all words by weight; a target stops at MOST times its source's words and the excess is
shared again by weight (closed form: the common rate is the largest of the rates that follow from capping the first k
sources in order of cap over weight).

Each document expects target / source words copies. The whole part is taken; the fractions are rounded in duels that
move word mass: of two documents one gains what the other loses, until one of them is a whole copy or none, in the
direction and with the chances that keep both expectations. A source's words thus stay at their target up to its last
fractional document. Duels run in groups of about GROUP documents (largest first); what stays fractional in a group
meets the rest of GROUP groups in the next level of the tree, until one per source is left. That one is rounded to the
nearer whole copy, so a source misses its target by at most half of one document.

Scale: only ids, sizes and source names move, pre-aggregated by (id, source, size); groups are dealt by a hash of the
id within a source, so a source with a third of all rows spreads over many groups; a level has 1/GROUP of the rows of
the level before; the sources' table (one row per source) is the only single-task step, and is broadcast only up to
BROADCAST_SOURCES rows. Draws are hashes of ids: reruns agree.

Cases: null text and text without words have size 0 and take 0; null source is a source; a source without words has
target 0; rows equal in id, source and size share their copies evenly; null ids are ids; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotile.llm.common import fresh, prepare

WEIGHTS = (5, 2, 1)
MOST = 3
GROUP = 64
SEED = 11
BROADCAST_SOURCES = 10_000
_UNIT = "doc_id", "source", "size", "many", "base"


def sizes(docs: DataFrame) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       words.cast("long").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, n (distinct rows), target, ratio (expected copies of a document)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1))
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    every = Window.partitionBy()
    per = per.withColumn("rate", (F.sum("source_size").over(every) - before) / left)
    per = per.withColumn("target", F.least("cap", F.col("weight") * F.max("rate").over(every)))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "n", "target", F.least(ratio, F.lit(float(most))).alias("ratio"))


def _draw(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def _duel(state: Column, x: Column, seed: int, level: int) -> Column:
    """One step of a group's fold: the held document against the next one. mass: the words expected of a document."""
    a, b = state["held"], x
    up = F.least(a["size"] - a["mass"], b["mass"])  # what a may gain from b
    down = F.least(a["mass"], b["size"] - b["mass"])
    a_gains = _draw(F.lit(seed), F.lit(level), a["doc_id"], b["doc_id"], a["size"], b["size"]) * (up + down) < down
    a_full = a["size"] - a["mass"] <= b["mass"]
    a_none = a["mass"] <= b["size"] - b["mass"]

    def with_mass(s: Column, mass: Column) -> Column:
        return F.struct(*[s[c].alias(c) for c in _UNIT], mass.cast("double").alias("mass"))

    def whole(s: Column, copies: int) -> Column:
        return F.struct(*[s[c].alias(c) for c in _UNIT], F.lit(copies).alias("extra"))

    def step(held: Column, done: Column) -> Column:
        return F.struct(held.alias("held"), F.array_append(state["done"], done).alias("done"))

    gain = F.when(a_full, step(with_mass(b, b["mass"] - up), whole(a, 1))).otherwise(step(with_mass(a, a["mass"] + up), whole(b, 0)))
    lose = F.when(a_none, step(with_mass(b, b["mass"] + down), whole(a, 0))).otherwise(step(with_mass(a, a["mass"] - down), whole(b, 1)))
    return F.when(a_gains, gain).otherwise(lose)


_DONE = "array<struct<doc_id:bigint,source:string,size:bigint,many:bigint,base:bigint,extra:int>>"


def _level(units: DataFrame, seed: int, level: int) -> DataFrame:
    """Fold every group (source, part): rows (source, part, held, done). units: _UNIT columns, mass, part."""
    row = F.struct((-F.col("size")).alias("o1"), F.xxhash64(F.lit(seed), F.lit(level), "doc_id").alias("o2"), "doc_id",
                   "many", "base", "source", "size", "mass")
    rows = units.groupBy("source", "part").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    first = F.col("rows")[0]
    held = F.struct(*[first[c].alias(c) for c in _UNIT], first["mass"].alias("mass"))
    start = F.struct(held.alias("held"), F.array().cast(_DONE).alias("done"))
    end = F.aggregate(F.slice("rows", 2, F.size("rows")), start, lambda s, x: _duel(s, x, seed, level))
    return rows.select("source", "part", end.alias("end")).select("source", "part", "end.held", "end.done")


def round_copies(units: DataFrame, largest: int, seed: int = SEED) -> DataFrame:
    """Units with a fraction, dealt to ``part`` numbers 0.. within each source, rounded: _UNIT columns and extra 0/1.
    largest: the number of parts of the source that has most."""
    out, level = None, 0
    while True:
        folded = _level(units, seed, level).checkpoint(eager=True)
        done = folded.select(F.explode("done").alias("d")).select("d.*")
        out = done if out is None else out.unionByName(done)
        if largest <= 1:
            break
        largest, level = -(-largest // GROUP), level + 1
        units = folded.select("held.*", F.floor(F.col("part") / GROUP).cast("long").alias("part"))
    last = folded.select("held.*").withColumn("extra", (F.col("mass") * 2 > F.col("size")).cast("int"))
    return out.unionByName(last.select(*_UNIT, "extra"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (copies times size)."""
    prepare(docs.sparkSession)
    sized = sizes(docs).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("many")).checkpoint(eager=True)
    per = targets(sized.select("source", (F.col("size") * F.col("many")).alias("size")), weights, most).checkpoint(eager=True)
    facts = per.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("n")).first()  # one row
    small = per.withColumn("parts", F.ceil(F.col("n") / GROUP).cast("long")).withColumnRenamed("source", "of")
    small = F.broadcast(small) if facts["sources"] <= BROADCAST_SOURCES else small
    units = sized.join(small, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    expected = F.col("many") * F.col("ratio")
    units = units.withColumn("base", F.when(F.col("ratio") >= most, F.col("many") * most).otherwise(F.floor(expected)).cast("long"))
    share = F.when(F.col("ratio") >= most, F.lit(0.0)).otherwise(expected - F.col("base"))
    units = units.withColumn("mass", share * F.col("size")).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("parts")))
    whole = units.where((F.col("mass") <= 0) | (F.col("size") == 0)).select(*_UNIT, F.lit(0).alias("extra"))
    parted = units.where((F.col("mass") > 0) & (F.col("size") > 0)).select(*_UNIT, "mass", "part")
    rounded = round_copies(parted, -(-(facts["n"] or 0) // GROUP), seed).unionByName(whole)
    total = F.col("base") + F.col("extra")
    each = rounded.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many"))))
    copies = F.floor(total / F.col("many")) + (F.col("i") <= total % F.col("many")).cast("long")
    each = each.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long"))
    return each.join(small, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns. Rows that share an id are told apart
    by source, size and text; of rows equal in these, the first ones take the copies of that many."""
    prepare(docs.sparkSession)
    nth, n = fresh(docs, "mix_nth"), fresh(docs, "mix_copies")
    chosen = mix(docs, weights, most, seed).where(F.col("copies") > 0)
    k_id, k_source, k_size, k_nth = (fresh(docs, c) for c in ("k_id", "k_source", "k_size", "k_nth"))
    by = Window.partitionBy("doc_id", "source", "size").orderBy(F.desc("copies"))
    chosen = chosen.withColumn(k_nth, F.row_number().over(by)).select(
        F.col("doc_id").alias(k_id), F.col("source").alias(k_source), F.col("size").alias(k_size), k_nth, F.col("copies").alias(n))
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    s = fresh(docs, "mix_size")
    rows = docs.withColumn(s, size)
    same = Window.partitionBy(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col(s)).orderBy(F.xxhash64("text"))
    rows = rows.withColumn(nth, F.row_number().over(same))
    on = (F.col("doc_id").cast("long").eqNullSafe(F.col(k_id)) & F.col("source").cast("string").eqNullSafe(F.col(k_source))
          & (F.col(s) == F.col(k_size)) & (F.col(nth) == F.col(k_nth)))
    out = rows.join(chosen, on).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    return out.select(*docs.columns)
