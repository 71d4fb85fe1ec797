"""Vision-model verdicts: request rows, answer parsing and joining.

The HTTP call itself is outside Spark; answers arrive as a table (event_id, text). Parsing uses VARIANT
(``try_parse_json``), so it stays in the JVM. Python truthiness and conversion rules are reproduced per JSON type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotile.functions.images import basename
from chronotile.schema import VERDICT_COLUMNS

# Change types accepted from the model.
VALID_TYPES = ["construction", "agriculture", "deforestation", "water", "mining", "other"]

# The answer's JSON keys and types are fixed; the wording is a default that callers may replace.
INSTRUCTION = (
    "You get two satellite images of one place, the older one first. Decide whether they show a real change of the land "
    "or only an artefact (season, clouds, viewing angle, image compression). Reply with one JSON object and nothing else: "
    "is_real (true or false), change_type (one of " + ", ".join(VALID_TYPES) + "), cause_tr (a short reason in Turkish), "
    "confidence (a number from 0 to 1)."
)
REQUEST = "Compare these two images."


def _kind(v: Column, path: str) -> Column:
    """JSON type of a member: 'missing', 'null', 'bool', 'num', 'str', 'array', 'object'."""
    s = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return (
        F.when(F.try_variant_get(v, path, "variant").isNull(), F.lit("missing"))
        .when(s == "VOID", F.lit("null"))
        .when(s == "BOOLEAN", F.lit("bool"))
        .when(s == "STRING", F.lit("str"))
        .when(s.startswith("ARRAY"), F.lit("array"))
        .when(s.startswith("OBJECT"), F.lit("object"))
        .otherwise(F.lit("num"))
    )


def _nonempty_container(v: Column, path: str) -> Column:
    j = F.to_json(F.try_variant_get(v, path, "variant"))
    return (j != "[]") & (j != "{}")


def parse_verdicts(answers: DataFrame, model: str = "") -> DataFrame:
    """(event_id, text) -> event_id, ai_is_real, ai_change_type, ai_cause_tr, ai_confidence, ai_model.

    Whole text as JSON, else the span from the first '{' to the last '}'; a non-object gives a null verdict.
    ``is_real`` by truthiness ("false" is true); unknown or non-string type -> ''; missing cause -> '';
    confidence: falsy -> 0.0, numbers and numeric text -> float. A list/object type or a confidence that cannot
    be converted fails the row, which then gets the null verdict (null, '', '', 0.0)."""
    t = F.col("text")
    span = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    v = F.coalesce(F.try_parse_json(t), F.when(span != "", F.try_parse_json(span)))
    is_obj = F.schema_of_variant(v).startswith("OBJECT")

    rk = _kind(v, "$.is_real")
    real = (
        F.when(rk == "bool", F.try_variant_get(v, "$.is_real", "boolean"))
        .when(rk == "num", F.try_variant_get(v, "$.is_real", "double") != 0)
        .when(rk == "str", F.length(F.try_variant_get(v, "$.is_real", "string")) > 0)
        .when(rk.isin("array", "object"), _nonempty_container(v, "$.is_real"))
        .otherwise(F.lit(False))
    )
    tk = _kind(v, "$.change_type")
    tval = F.try_variant_get(v, "$.change_type", "string")
    ctype = F.when((tk == "str") & tval.isin(VALID_TYPES), tval).otherwise(F.lit(""))

    ck = _kind(v, "$.confidence")
    cnum = F.try_variant_get(v, "$.confidence", "double")
    cstr = F.try_variant_get(v, "$.confidence", "string")
    number = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))$"
    ctext = F.when(F.trim(cstr).rlike(number), F.trim(cstr).try_cast("double"))
    conf = (
        F.when(ck.isin("missing", "null"), F.lit(0.0))
        .when(ck == "bool", F.when(F.try_variant_get(v, "$.confidence", "boolean"), F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(ck == "num", cnum)
        .when(ck == "str", F.when(F.length(cstr) == 0, F.lit(0.0)).otherwise(ctext))
        .when(ck.isin("array", "object"), F.when(_nonempty_container(v, "$.confidence"), F.lit(None)).otherwise(F.lit(0.0)))
    )
    conf_fails = (ck == "str") & (F.length(cstr) > 0) & ctext.isNull() | (ck.isin("array", "object") & _nonempty_container(v, "$.confidence"))
    type_fails = tk.isin("array", "object")
    ok = v.isNotNull() & is_obj & ~F.coalesce(conf_fails | type_fails, F.lit(False))

    ck2 = _kind(v, "$.cause_tr")
    cause = F.when(ck2 == "missing", F.lit("")).when(ck2 == "null", F.lit(None).cast("string")).otherwise(
        F.coalesce(F.try_variant_get(v, "$.cause_tr", "string"), F.to_json(F.try_variant_get(v, "$.cause_tr", "variant"))))
    return answers.select(
        "event_id",
        F.when(ok, real).otherwise(F.lit(None).cast("boolean")).alias("ai_is_real"),
        F.when(ok, ctype).otherwise(F.lit("")).alias("ai_change_type"),
        F.when(ok, cause).otherwise(F.lit("")).alias("ai_cause_tr"),
        F.when(ok, conf).otherwise(F.lit(0.0)).cast("double").alias("ai_confidence"),
        F.lit(model).alias("ai_model"),
    )


def apply_verdicts(changes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Left join on event_id; existing ai_* columns are replaced, all change rows are kept."""
    base = changes.drop(*VERDICT_COLUMNS)
    return base.join(verdicts.select("event_id", *VERDICT_COLUMNS), "event_id", "left")


def drop_ai_false(changes: DataFrame) -> DataFrame:
    """Keep rows the model did not reject (null or true)."""
    return changes.where(F.col("ai_is_real").isNull() | F.col("ai_is_real"))


def ai_confirmed(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("ai_is_real") == F.lit(True))


def _data_url(path: Column, data: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([^./]*)$", 1)
    ext = F.when(ext == "", F.lit("jpeg")).when(ext == "jpg", F.lit("jpeg")).otherwise(ext)
    return F.concat(F.lit("data:image/"), ext, F.lit(";base64,"), F.base64(data))


def vision_requests(changes: DataFrame, images: DataFrame, limit: int | None = None, system: str = INSTRUCTION,
                    text: str = REQUEST) -> DataFrame:
    """Request rows: event_id, system, text, image_urls (before then after, present sides only).
    ``images`` has image (file name) and data (bytes). A limit picks the first events by id for judging."""
    c = changes
    if limit:
        c = c.orderBy("event_id").limit(limit)
    img = images.select("image", "data")
    b = img.select(F.col("image").alias("_bi"), F.col("data").alias("_bd"))
    a = img.select(F.col("image").alias("_ai"), F.col("data").alias("_ad"))
    c = c.select("event_id", "before_image", "after_image",
                 F.when(F.col("before_image") != "", basename("before_image")).alias("_bi"),
                 F.when(F.col("after_image") != "", basename("after_image")).alias("_ai"))
    j = c.join(b, "_bi", "left").join(a, "_ai", "left")
    urls = F.filter(
        F.array(F.when(F.col("_bd").isNotNull(), _data_url(F.col("before_image"), F.col("_bd"))),
                F.when(F.col("_ad").isNotNull(), _data_url(F.col("after_image"), F.col("_ad")))),
        lambda x: x.isNotNull(),
    )
    return j.select("event_id", F.lit(system).alias("system"), F.lit(text).alias("text"), urls.alias("image_urls"))
