"""Station keys, variable names and model names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_DECIMALS = 6


def _coordinate_text(c: Column) -> Column:
    # Double-to-text switches to exponents below 1e-3; a fixed format with the
    # trailing zeros cut keeps those keys readable and equal across engines.
    r = F.round(c, KEY_DECIMALS)
    fixed = F.regexp_replace(F.format_string("%.6f", r.cast("double")), "0+$", "")
    fixed = F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed)
    return F.when((F.abs(r) < 1e-3) & (r != 0), fixed).otherwise(r.cast("string"))


def station_key(lat: Column, lon: Column) -> Column:
    """``lat_lon`` with six decimals. Pass float columns unwidened."""
    return F.concat_ws("_", _coordinate_text(lat), _coordinate_text(lon))


def station_lat(key: Column) -> Column:
    return F.split_part(key, F.lit("_"), F.lit(1)).cast("double")


def station_lon(key: Column) -> Column:
    return F.split_part(key, F.lit("_"), F.lit(2)).cast("double")


# Fixed patterns: word starts inside camel case names.
WORD_START = "(.)([A-Z][a-z]+)"
LOWER_UPPER = "([a-z0-9])([A-Z])"


def camel_to_words(c: Column) -> Column:
    spaced = F.regexp_replace(c, WORD_START, "$1 $2")
    return F.lower(F.regexp_replace(spaced, LOWER_UPPER, "$1 $2"))


# The fields of a model name, in order, after the leading tag.
MODEL_NAME_FIELDS = [
    ("k_fore", "int"),
    ("lat_range", "array<double>"),
    ("lon_range", "array<double>"),
    ("n_hours", "int"),
    ("n_steps", "int"),
    ("n_harmonics", "int"),
    ("iterations", "int"),
    ("learn_rate", "double"),
    ("depth", "int"),
    ("min_weight", "int"),
]


def parse_model_name(df: DataFrame, col: str) -> DataFrame:
    """One column per field of a ``tag_k_lat,lat_lon,lon_…`` model name."""
    out = {}
    for i, (name, kind) in enumerate(MODEL_NAME_FIELDS, start=2):
        part = F.split_part(F.col(col), F.lit("_"), F.lit(i))
        if kind.startswith("array"):
            out[name] = F.split(part, ",").cast(kind)
        else:
            out[name] = part.cast(kind)
    return df.withColumns(out)


def format_model_name(tag: str, params: dict) -> str:
    """The inverse of :func:`parse_model_name` for one parameter set."""
    parts = [tag]
    for name, kind in MODEL_NAME_FIELDS:
        value = params[name]
        parts.append(",".join(str(v) for v in value) if kind.startswith("array") else str(value))
    return "_".join(parts)
