"""Unit-bearing values: parsing, scaling, rounding, formatting, identity keys."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Multiplier of each unit suffix to its SI base ("m" is milli).
UNIT_SCALES = {
    "": 1.0,
    "f": 1e-15,
    "p": 1e-12,
    "n": 1e-9,
    "u": 1e-6,
    "um": 1e-6,
    "micron": 1e-6,
    "microns": 1e-6,
    "m": 1e-3,
    "mil": 25.4e-6,
    "mm": 1e-3,
    "cm": 1e-2,
    "meter": 1.0,
    "meters": 1.0,
    "in": 0.0254,
    "inch": 0.0254,
    "k": 1e3,
    "meg": 1e6,
    "g": 1e9,
    "hz": 1.0,
    "khz": 1e3,
    "mhz": 1e6,
    "ghz": 1e9,
    "thz": 1e12,
}

# The accepted spelling of a number with an optional suffix.
NUMBER_PATTERN = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
TOKEN_PATTERN = rf"^({NUMBER_PATTERN})\s*([A-Za-z]*)$"


def lookup(mapping: dict[str, float], key: Column) -> Column:
    """Literal map lookup; NULL where the key is absent."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def strip_token(token: Column) -> Column:
    """Remove one pair of matching quotes around the token, then all commas."""
    unquoted = F.regexp_replace(F.trim(token), r"^([\"'])(.*)\1$", "$2")
    return F.replace(F.trim(unquoted), F.lit(","), F.lit(""))


def token_number(token: Column) -> Column:
    text = F.trim(token)
    return F.regexp_extract(text, TOKEN_PATTERN, 1).try_cast("double")


def token_unit(token: Column) -> Column:
    """Lower-cased suffix; NULL when the token is not a number with a suffix."""
    text = F.trim(token)
    return F.when(text.rlike(TOKEN_PATTERN), F.lower(F.regexp_extract(text, TOKEN_PATTERN, 2)))


def unit_scale(unit: Column) -> Column:
    return lookup(UNIT_SCALES, unit)


def split_value(token: Column) -> Column:
    """STRUCT<value, unit, scale>; ``scale`` is NULL for an unknown suffix."""
    unit = token_unit(token)
    return F.struct(token_number(token).alias("value"), unit.alias("unit"), unit_scale(unit).alias("scale"))


def parse_si(token: Column) -> Column:
    """SI value of a token by its own suffix."""
    return token_number(token) * unit_scale(token_unit(token))


def parse_observed(token: Column, declared_unit: Column, bare_values: str = "parameter-units") -> Column:
    """An explicit suffix wins; a bare number is read in the declared unit
    (``parameter-units``) or as SI (``base-units``)."""
    number, unit = token_number(token), token_unit(token)
    bare = number
    if bare_values == "parameter-units":
        bare = number * F.coalesce(unit_scale(F.lower(F.coalesce(declared_unit, F.lit("")))), F.lit(1.0))
    return F.when(unit == "", bare).otherwise(number * unit_scale(unit))


def to_unit(value: Column, lower: Column, upper: Column, scale: Column) -> Column:
    """Coordinate in [0, 1] on a linear or logarithmic axis."""
    logged = (F.log(value) - F.log(lower)) / (F.log(upper) - F.log(lower))
    return F.when(scale == "log", logged).otherwise((value - lower) / (upper - lower))


def from_unit(u: Column, lower: Column, upper: Column, scale: Column) -> Column:
    logged = F.exp(F.log(lower) + u * (F.log(upper) - F.log(lower)))
    return F.when(scale == "log", logged).otherwise(lower + u * (upper - lower))


def decimal_grid(lower: Column, upper: Column, unit_factor: Column, places: int) -> tuple[Column, Column]:
    """First and last grid index inside the range, with a 1e-12 relative guard."""
    low = lower / unit_factor * F.lit(float(10**places))
    high = upper / unit_factor * F.lit(float(10**places))
    one = F.lit(1.0)
    first = F.ceil(low - F.lit(1e-12) * F.greatest(one, F.abs(low)))
    last = F.floor(high + F.lit(1e-12) * F.greatest(one, F.abs(high)))
    return first, last


def round_to_grid(value: Column, lower: Column, upper: Column, unit_factor: Column, places: int) -> Column:
    """Half-even rounding in the declared unit, kept inside the range."""
    first, last = decimal_grid(lower, upper, unit_factor, places)
    step = F.lit(float(10**places))
    index = F.least(last.cast("double"), F.greatest(first.cast("double"), F.rint(value / unit_factor * step)))
    return index / step * unit_factor


def format_fixed(value: Column, unit: Column, unit_factor: Column, places: int) -> Column:
    """Fixed decimals with trailing zeros stripped, ``-0`` shown as ``0``, then the unit."""
    step = F.lit(float(10**places))
    shown = F.rint(value / unit_factor * step) / step + F.lit(0.0)
    text = F.format_string(f"%.{places}f", shown)
    if places > 0:
        text = F.regexp_replace(text, r"\.?0+$", "")
    text = F.when(text == "-0", F.lit("0")).otherwise(text)
    return F.concat(text, F.coalesce(unit, F.lit("")))


@F.pandas_udf(StringType())
def significant_text(values: pd.Series) -> pd.Series:
    """Twelve significant digits, as C's ``%.12g`` (the JVM's ``%g`` differs)."""
    return values.map(lambda v: None if pd.isna(v) else f"{v:.12g}")


def format_significant(value: Column, unit: Column, unit_factor: Column) -> Column:
    return F.concat(significant_text(value / unit_factor), F.coalesce(unit, F.lit("")))


def metadata_number(value: Column) -> Column:
    """Value as it is stored in metadata: twelve significant digits."""
    return significant_text(value).cast("double")


def identity_key(formatted: Sequence[Column]) -> Column:
    """Geometry identity: the formatted values in parameter order."""
    return F.array(*formatted)


def in_unit_cube(point: Column, tolerance: float = 1e-9) -> Column:
    return F.forall(point, lambda u: (u >= F.lit(-tolerance)) & (u <= F.lit(1.0 + tolerance)))


def clamp_unit(point: Column) -> Column:
    return F.transform(point, lambda u: F.least(F.lit(1.0), F.greatest(F.lit(0.0), u)))


def csv_number(text: Column) -> Column:
    """Finite number or NULL."""
    number = F.trim(text).try_cast("double")
    return F.when(is_finite(number), number)


def is_finite(value: Column) -> Column:
    """True for ordinary numbers; false for NULL, NaN and infinities."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def is_close(left: Column, right: Column, rel: float, abs_tol: float) -> Column:
    """Symmetric closeness: relative to the larger magnitude."""
    bound = F.greatest(F.lit(rel) * F.greatest(F.abs(left), F.abs(right)), F.lit(abs_tol))
    return (left == right) | (F.abs(left - right) <= bound)


def expand_range(lower: Column, upper: Column, scale: Column, factor: Column) -> Column:
    """STRUCT<lower, upper> of a range widened about its (log-)centre."""
    half = (upper - lower) * 0.5 * factor
    centre = (lower + upper) * 0.5
    log_half = (F.log(upper) - F.log(lower)) * 0.5 * factor
    log_centre = (F.log(lower) + F.log(upper)) * 0.5
    return F.struct(
        F.when(scale == "log", F.exp(log_centre - log_half)).otherwise(centre - half).alias("lower"),
        F.when(scale == "log", F.exp(log_centre + log_half)).otherwise(centre + half).alias("upper"),
    )


def extension_plan(lower: Column, upper: Column, new_lower: Column, new_upper: Column, scale: Column) -> Column:
    """STRUCT<side, slab_lower, slab_upper, added_volume_ratio> of a one-sided
    range extension; ``side`` is NULL when neither or both bounds move outward."""
    same_low = is_close(new_lower, lower, 1e-10, 1e-18)
    same_high = is_close(new_upper, upper, 1e-10, 1e-18)
    side = F.when((new_lower < lower) & same_high, F.lit("lower")).when(same_low & (new_upper > upper), F.lit("upper"))
    slab_low = F.when(side == "lower", new_lower).when(side == "upper", upper)
    slab_high = F.when(side == "lower", lower).when(side == "upper", new_upper)

    def span(a: Column, b: Column) -> Column:
        return F.when(scale == "log", F.log(b) - F.log(a)).otherwise(b - a)

    return F.struct(
        side.alias("side"),
        slab_low.alias("slab_lower"),
        slab_high.alias("slab_upper"),
        (span(slab_low, slab_high) / span(lower, upper)).alias("added_volume_ratio"),
    )
