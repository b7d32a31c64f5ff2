"""Small scalar rules of the metric, trial and log tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .units import is_finite, lookup

DECIBEL_METRICS = ("evm_db", "weighted_evm_db")


def metric_score(metric: str, value: Column) -> Column:
    """Comparable positive score of a metric value."""
    if metric.lower() in DECIBEL_METRICS:
        return F.pow(F.lit(10.0), value / F.lit(20.0))
    return F.abs(value)


def percent_change(value: Column, baseline: Column) -> Column:
    """Percent change; NULL when only the baseline is zero, 0 when both are."""
    value, baseline = F.coalesce(value, F.lit(0.0)), F.coalesce(baseline, F.lit(0.0))
    change = (F.try_divide(value, baseline) - F.lit(1.0)) * F.lit(100.0)
    return F.when(baseline == 0.0, F.when(value == 0.0, F.lit(0.0))).otherwise(change)


def nested_number(document: Column, path: str) -> Column:
    """Finite number at a dotted path of a JSON document."""
    number = F.get_json_object(document, "$." + path).try_cast("double")
    return F.when(is_finite(number), number)


# Frequency, current and duration suffixes.
FREQUENCY_UNITS = {"": 1.0, "hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9, "thz": 1e12}
CURRENT_UNITS = {
    "": 1.0,
    "A": 1.0,
    "fA": 1e-15,
    "pA": 1e-12,
    "nA": 1e-9,
    "uA": 1e-6,
    "mA": 1e-3,
    "kA": 1e3,
    "MA": 1e6,
}
DURATION_UNITS = {
    "": 1.0,
    "ns": 1e-9,
    "us": 1e-6,
    "ms": 1e-3,
    "s": 1.0,
    "sec": 1.0,
    "secs": 1.0,
    "second": 1.0,
    "seconds": 1.0,
    "min": 60.0,
    "mins": 60.0,
    "minute": 60.0,
    "minutes": 60.0,
    "h": 3600.0,
    "hr": 3600.0,
    "hrs": 3600.0,
    "hour": 3600.0,
    "hours": 3600.0,
}


def frequency_hz(value: Column, unit: Column) -> Column:
    return value * lookup(FREQUENCY_UNITS, F.lower(F.trim(unit)))


def power_dbm(value: Column, unit: Column) -> Column:
    """dBm from dBm, dBW, mW or W; NULL for a linear power that is not positive."""
    name = F.lower(F.trim(unit))
    watts = F.when(name == "mw", value * F.lit(1e-3)).otherwise(value)
    linear = F.when(watts > 0.0, F.lit(10.0) * F.log10(watts / F.lit(1e-3)))
    return F.when(name.isin("", "dbm"), value).when(name == "dbw", value + F.lit(30.0)).otherwise(linear)


def micro_sign(text: Column) -> Column:
    """Both Unicode micro signs written as ``u``."""
    return F.translate(text, "μµ", "uu")


def current_amperes(value: Column, unit: Column) -> Column:
    """Amperes; an unknown unit leaves the number as it is."""
    return value * F.coalesce(lookup(CURRENT_UNITS, micro_sign(F.trim(unit))), F.lit(1.0))


def duration_seconds(text: Column) -> Column:
    """Seconds of ``h:mm:ss``, ``mm:ss`` or a number with a time suffix."""
    clean = F.trim(micro_sign(text))
    parts = F.transform(F.split(clean, ":"), lambda p: p.try_cast("double"))
    first, second, third = [F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3)]
    clock = F.when(F.size(parts) == 3, first * 3600.0 + second * 60.0 + third).when(
        F.size(parts) == 2, first * 60.0 + second
    )
    pattern = r"^([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*([A-Za-z]*)$"
    number = F.regexp_extract(clean, pattern, 1).try_cast("double")
    factor = lookup(DURATION_UNITS, F.lower(F.regexp_extract(clean, pattern, 2)))
    return F.when(F.instr(clean, ":") > 0, clock).otherwise(number * factor)
