"""Image naming and format sniffing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match for equal results: magic numbers of the sniffed formats.
JPEG_MAGIC = bytes.fromhex("ffd8ff")
PNG_MAGIC = bytes.fromhex("89504e470d0a1a0a")
RIFF_MAGIC = b"RIFF"
WEBP_TAG = b"WEBP"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_release_id(release) -> Column:
    """Characters outside [A-Za-z0-9._-] become '_'."""
    return F.regexp_replace(_c(release), r"[^A-Za-z0-9._-]", "_")


def image_file_name(col, row, release, ext) -> Column:
    return F.concat_ws("", _c(col).cast("string"), F.lit("_"), _c(row).cast("string"), F.lit("_"),
                       safe_release_id(release), F.lit("."), _c(ext))


def image_rel_path(col, row, release, ext) -> Column:
    return F.concat(F.lit("images/"), image_file_name(col, row, release, ext))


def basename(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def sniff_extension(data) -> Column:
    """jpg / png / webp from magic bytes; anything else (also empty) is 'jpg'."""
    d = _c(data)
    return (
        F.when(F.substring(d, 1, 3) == F.lit(JPEG_MAGIC), F.lit("jpg"))
        .when(F.substring(d, 1, 8) == F.lit(PNG_MAGIC), F.lit("png"))
        .when((F.substring(d, 1, 4) == F.lit(RIFF_MAGIC)) & (F.substring(d, 9, 4) == F.lit(WEBP_TAG)), F.lit("webp"))
        .otherwise(F.lit("jpg"))
    )
