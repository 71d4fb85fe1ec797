"""Land-cover scores and change types (X10, P20-P22, P36, J4); ``probe`` trains the probe.

The probe is a linear head over stored image vectors. Its weights are bounded by
``classes x dim`` (10 x 64 here, 10 x 768 for large models), so they travel as literals inside the
scoring expression: scoring is a projection over the vector table, with no join and no Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotile.functions.images import basename
from chronotile.params import Params

# Land-cover label -> broad group.
GROUP = {
    "Forest": "dogal",
    "Shrubland": "dogal",
    "Pasture": "dogal",
    "AnnualCrop": "tarim",
    "PermanentCrop": "tarim",
    "Residential": "yapili",
    "Industrial": "yapili",
    "Highway": "yapili",
    "River": "su",
    "SeaLake": "su",
}

# Fixed values: (from group, to group) -> change type in Turkish and English.
CHANGE_TYPES = {
    ("dogal", "tarim"): ("Tarıma açılma", "Conversion to agriculture"),
    ("dogal", "yapili"): ("Doğal alanın yapılaşması", "Natural area developed"),
    ("dogal", "su"): ("Su baskını", "Flooding"),
    ("tarim", "yapili"): ("Tarım arazisinin yapılaşması", "Farmland developed"),
    ("tarim", "dogal"): ("Doğallaşma", "Reverting to natural"),
    ("tarim", "su"): ("Su baskını", "Flooding"),
    ("yapili", "dogal"): ("Yeşillendirme", "Greening"),
    ("yapili", "tarim"): ("Tarıma dönüşüm", "Conversion to agriculture"),
    ("su", "dogal"): ("Su çekilmesi", "Water recession"),
    ("su", "tarim"): ("Su çekilmesi", "Water recession"),
    ("su", "yapili"): ("Dolgu/yapılaşma", "Landfill and development"),
}

# Display name of each group.
GROUP_DISPLAY = {"dogal": "Doğal alan", "tarim": "Tarım", "yapili": "Yapılı alan", "su": "Su"}

MAX_PROBE_CELLS = 1_000_000  # classes x dim bound for carrying weights as literals


def _map_lit(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def group_name(label) -> Column:
    """Display name of a label's group; '' for an empty or unknown label."""
    names = _map_lit({k: GROUP_DISPLAY[g] for k, g in GROUP.items()})
    label = F.col(label) if isinstance(label, str) else label
    return F.coalesce(F.try_element_at(names, label), F.lit(""))


def change_type_dimension(spark) -> DataFrame:
    """The transition table as a DataFrame (for inspection and joins by users)."""
    rows = [(fg, tg, tr, en) for (fg, tg), (tr, en) in CHANGE_TYPES.items()]
    return spark.createDataFrame(rows, "from_group string, to_group string, change_type_tr string, change_type_en string")


def change_type(from_label, to_label) -> tuple[Column, Column]:
    """(tr, en) change type for a label transition; '' when a label is empty/unknown, the groups are equal,
    or the transition is not in the table."""
    groups = _map_lit(GROUP)
    fl = F.col(from_label) if isinstance(from_label, str) else from_label
    tl = F.col(to_label) if isinstance(to_label, str) else to_label
    fg = F.element_at(groups, fl)
    tg = F.element_at(groups, tl)
    key = F.concat_ws("|", fg, tg)
    tr_map = _map_lit({f"{a}|{b}": v[0] for (a, b), v in CHANGE_TYPES.items()})
    en_map = _map_lit({f"{a}|{b}": v[1] for (a, b), v in CHANGE_TYPES.items()})
    ok = fg.isNotNull() & tg.isNotNull() & (fg != tg)
    tr = F.when(ok, F.coalesce(F.try_element_at(tr_map, key), F.lit(""))).otherwise(F.lit(""))
    en = F.when(ok, F.coalesce(F.try_element_at(en_map, key), F.lit(""))).otherwise(F.lit(""))
    return tr, en


def probe_from_means(labelled: DataFrame, dim: int | None = None, decimals: int = 8) -> DataFrame:
    """Fixture probe: the per-label mean vector is the weight row (label, label_name, weights array<double>).
    One pass with ``dim`` partial averages per label (no explode); by default the vectors' own length, which must be
    the same for all."""
    if dim is None:
        low, high = labelled.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if low != high:
            raise ValueError(f"labelled vectors have lengths from {low} to {high}")
        dim = high or 0
    agg = labelled.groupBy("label", "label_name").agg(
        *[F.round(F.avg(F.col("embedding")[i].cast("double")), decimals).alias(f"w{i}") for i in range(dim)]
    )
    return agg.select("label", "label_name", F.array(*[F.col(f"w{i}") for i in range(dim)]).alias("weights"))


def score_images(vectors: DataFrame, probe: DataFrame, p: Params, logit_scale: float = 1.0,
                 vector_col: str = "embedding") -> DataFrame:
    """Softmax over ``logit_scale * (w . v + b)``; argmax (first index wins ties); below the confidence floor
    there is no label and confidence 0. Output: image, land_cover, land_cover_conf.

    The weights (``classes x dim``, a bounded table) are collected once and captured by an Arrow-batched UDF;
    dot products sum over the dimension in index order."""
    cols = probe.columns
    rows = probe.orderBy("label").select("label", "label_name", "weights", *(["bias"] if "bias" in cols else [])).collect()
    cells = sum(len(r["weights"]) for r in rows)
    if cells > MAX_PROBE_CELLS:
        raise ValueError(f"probe has {cells} weights; above {MAX_PROBE_CELLS} score with model.transform instead")
    W = np.asarray([list(r["weights"]) for r in rows], dtype=np.float64)
    bias = np.asarray([float(r["bias"]) if "bias" in cols and r["bias"] is not None else 0.0 for r in rows])
    has_bias = "bias" in cols
    names = [r["label_name"] for r in rows]
    floor = float(p.confidence_floor)
    scale = float(logit_scale)

    @F.pandas_udf("land_cover string, land_cover_conf double")
    def score(v: pd.Series) -> pd.DataFrame:
        n = len(v)
        label = np.array([""] * n, dtype=object)
        conf_out = np.zeros(n)
        ok = np.array([x is not None for x in v], dtype=bool)
        if any(len(x) != W.shape[1] for x in v[ok]):
            raise ValueError(f"a vector's length differs from the probe's {W.shape[1]}")
        if ok.any():
            V = np.stack([np.asarray(x, dtype=np.float64) for x in v[ok]])
            logits = np.empty((V.shape[0], W.shape[0]))
            for i in range(W.shape[0]):
                acc = np.zeros(V.shape[0])
                for j in range(W.shape[1]):
                    acc += V[:, j] * W[i, j]
                if has_bias:
                    acc = acc + bias[i]
                logits[:, i] = scale * acc
            lmax = logits.max(axis=1)
            denom = np.zeros(V.shape[0])
            for i in range(W.shape[0]):
                denom += np.exp(logits[:, i] - lmax)
            conf = 1.0 / denom
            arg = np.argmax(logits == lmax[:, None], axis=1)
            keep = conf >= floor
            label[ok] = np.where(keep, np.asarray(names, dtype=object)[arg], "")
            conf_out[ok] = np.where(keep, conf, 0.0)
        return pd.DataFrame({"land_cover": label, "land_cover_conf": conf_out})

    s = score(F.col(vector_col))
    return vectors.select("image", s.land_cover.alias("land_cover"), s.land_cover_conf.alias("land_cover_conf"))


def classify_changes(changes: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach land cover of both images (two left joins on the image name) and the derived change type."""
    s = scores.select("image", "land_cover", "land_cover_conf")
    fb = s.select(F.col("image").alias("_b"), F.col("land_cover").alias("land_cover_from"),
                  F.col("land_cover_conf").alias("land_cover_conf_from"))
    fa = s.select(F.col("image").alias("_a"), F.col("land_cover").alias("land_cover_to"),
                  F.col("land_cover_conf").alias("land_cover_conf_to"))
    c = changes.drop("land_cover_from", "land_cover_to", "land_cover_conf_from", "land_cover_conf_to",
                     "change_type_tr", "change_type_en")
    c = c.withColumn("_b", F.when(F.col("before_image") != "", basename("before_image"))).withColumn(
        "_a", F.when(F.col("after_image") != "", basename("after_image")))
    j = c.join(fb, "_b", "left").join(fa, "_a", "left").drop("_a", "_b")
    j = j.select(
        *[x for x in j.columns if x not in ("land_cover_from", "land_cover_to", "land_cover_conf_from", "land_cover_conf_to")],
        F.coalesce("land_cover_from", F.lit("")).alias("land_cover_from"),
        F.coalesce("land_cover_to", F.lit("")).alias("land_cover_to"),
        F.coalesce("land_cover_conf_from", F.lit(0.0)).alias("land_cover_conf_from"),
        F.coalesce("land_cover_conf_to", F.lit(0.0)).alias("land_cover_conf_to"),
    )
    tr, en = change_type("land_cover_from", "land_cover_to")
    return j.select("*", tr.alias("change_type_tr"), en.alias("change_type_en"))
