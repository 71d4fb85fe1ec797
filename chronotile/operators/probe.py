"""Training the land-cover probe (X9, A13): softmax regression on frozen vectors by full-batch gradient steps.

Every step is one pass over the labelled vectors: Arrow batches give partial gradients of ``classes x (dim + 1)`` cells, Spark
sums them by class, and the driver takes the step on weights of a bounded size. Probabilities and vectors enter the gradient as
whole multiples of 2**-SCALE_BITS and the sums are whole numbers, so that neither the partitioning nor a repeated task
changes the result. The vectors are checkpointed once and read by every step.

Rows without a vector or a label take no part; a vector with a null, a non-finite component or one beyond ``MAX_ABS``, or
vectors of different lengths, raise. An empty table gives no weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotile.operators.landcover import MAX_PROBE_CELLS
from chronotile.params import Params

SCALE_BITS = 20
MAX_ABS = 1024.0  # with ROWS rows at a time a sum stays below 2**62
ROWS = 4096


def held_out(key) -> Column:
    """A quarter of all keys, by the first digit of their MD5: the rows that measure the probe and never train it."""
    return F.substring(F.md5(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))), 1, 1) < "4"


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Vectors of a batch as rows, with a last column of ones for the bias."""
    flat = batch.column("x").flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    if not np.isfinite(x).all() or (np.abs(x) > MAX_ABS).any():
        raise ValueError(f"a vector has a component that is null, not finite or beyond {MAX_ABS}")
    return np.hstack([x, np.ones((len(x), 1))])


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _whole(a: np.ndarray) -> np.ndarray:
    return np.floor(a * 2.0**SCALE_BITS + 0.5).astype(np.int64)


def _gradient_pass(weights: np.ndarray, labels: list[int]):
    order = np.asarray(labels)

    def run(batches):
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                b = whole_batch.slice(at, ROWS)
                x = _matrix(b)
                miss = _whole(_softmax(x @ weights.T) - (b.column("label").to_numpy()[:, None] == order[None, :]))
                sums = miss.T @ _whole(x)
                yield pa.RecordBatch.from_pydict({"label": pa.array(order, pa.int32()), "g": pa.array(list(sums), pa.list_(pa.int64()))})

    return run


def train_probe(labelled: DataFrame, p: Params, features: str = "embedding") -> DataFrame:
    """Weights table (label, label_name, weights, bias) after ``p.probe_steps`` steps of size ``p.probe_rate`` from zero.
    ``labelled``: label, label_name and a vector column."""
    spark = labelled.sparkSession
    out = "label int, label_name string, weights array<double>, bias double"
    x = F.col(features)
    rows = labelled.where(x.isNotNull() & (F.size(x) > 0) & F.col("label").isNotNull())
    data = rows.select(F.col("label").cast("int").alias("label"), "label_name", x.cast("array<double>").alias("x")).checkpoint(eager=True)
    # a row for each label: bounded by the classes
    classes = data.groupBy("label").agg(F.min("label_name").alias("name"), F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"),
                                        F.max(F.size("x")).alias("most")).orderBy("label").limit(MAX_PROBE_CELLS + 1).collect()
    if not classes:
        return spark.createDataFrame([], out)
    dim = classes[0]["most"]
    if any(c["least"] != dim or c["most"] != dim for c in classes):
        raise ValueError("labelled vectors have different lengths")
    if len(classes) * (dim + 1) > MAX_PROBE_CELLS:
        raise ValueError(f"a probe of {len(classes)} classes and {dim} dimensions has more than {MAX_PROBE_CELLS} weights")
    labels, n = [c["label"] for c in classes], sum(c["n"] for c in classes)
    weights = np.zeros((len(labels), dim + 1))
    unit = 2.0 ** (2 * SCALE_BITS)
    for _ in range(p.probe_steps):
        part = data.select("label", "x").mapInArrow(_gradient_pass(weights, labels), "label int, g array<long>")
        cells = part.select("label", F.posexplode("g").alias("j", "g")).groupBy("label", "j").agg(F.sum(F.col("g").cast("decimal(38,0)")).alias("g"))
        step = np.zeros_like(weights)
        for r in cells.collect():  # classes x (dim + 1) rows
            step[labels.index(r["label"]), r["j"]] = float(r["g"]) / unit / n
        weights = weights - p.probe_rate * step
    made = [(c["label"], c["name"], w[:-1].tolist(), float(w[-1])) for c, w in zip(classes, weights)]
    return spark.createDataFrame(made, out)


def predict(labelled: DataFrame, probe: DataFrame, features: str = "embedding", name: str = "predicted") -> DataFrame:
    """Adds the label of the greatest logit (ties: the smallest label); null where there is no vector or no probe."""
    rows = probe.orderBy("label").select("label", "weights", "bias").collect()  # bounded by MAX_PROBE_CELLS
    if not rows:
        return labelled.withColumn(name, F.lit(None).cast("int"))
    weights = np.asarray([list(r["weights"]) + [r["bias"]] for r in rows])
    labels = np.asarray([r["label"] for r in rows], dtype=object)

    @F.arrow_udf("int")
    def best(v: pa.Array) -> pa.Array:
        ok = np.asarray(pc.fill_null(pc.greater(pc.list_value_length(v), 0), False))
        found = np.full(len(v), None, dtype=object)
        if ok.any():
            x = _matrix(pa.RecordBatch.from_arrays([v.filter(pa.array(ok))], ["x"]))
            found[ok] = labels[np.argmax(x @ weights.T, axis=1)]
        return pa.array(list(found), pa.int32())

    return labelled.withColumn(name, best(F.col(features)))


def probe_accuracy(labelled: DataFrame, probe: DataFrame, test: Column, features: str = "embedding") -> DataFrame:
    """One row: rows and accuracy of the part that trained the probe and of the held-out part (null accuracy for no rows)."""
    hit = (F.col("predicted") == F.col("label")).cast("double")
    seen = predict(labelled.where(F.col("label").isNotNull()).select("label", features, F.coalesce(test, F.lit(False)).alias("test")), probe, features)
    seen = seen.where(F.col("predicted").isNotNull())
    return seen.agg(F.count_if(~F.col("test")).alias("train_rows"), F.avg(F.when(~F.col("test"), hit)).alias("train_accuracy"),
                    F.count_if(F.col("test")).alias("test_rows"), F.avg(F.when(F.col("test"), hit)).alias("test_accuracy"))
