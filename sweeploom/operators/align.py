"""Coarse and fine sweeps on common samples, and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.complexmath import frequency_features
from . import ordered


def parameter_key(values: Sequence[Column]) -> list[Column]:
    """Match key: parameters rounded half-even to 15 decimals.

    Beyond 2^53 / 1e15 a double has no such digits, so the value stays as it is.
    """
    out = []
    for v in values:
        rounded = F.rint(v * F.lit(1e15)) / F.lit(1e15)
        out.append(F.when(F.abs(v) < F.lit(9.0), rounded).otherwise(v) + F.lit(0.0))
    return out


def match_occurrences(
    fine: DataFrame, coarse: DataFrame, params: Sequence[str], fine_order: str, coarse_order: str
) -> DataFrame:
    """Pair the n-th fine block of a key with the n-th coarse block.

    Result: all fine columns, ``coarse_id`` (the coarse order value), NULL where
    no block is left.
    """

    def keyed(df: DataFrame, order: str) -> DataFrame:
        df = df.withColumns({f"__k{i}": c for i, c in enumerate(parameter_key([F.col(p) for p in params]))})
        keys = [f"__k{i}" for i in range(len(params))]
        return ordered.number_rows(df, keys, [order], ordered.index_chunk(F.col(order)), "__n")

    keys = [f"__k{i}" for i in range(len(params))]
    left = keyed(fine, fine_order)
    right = keyed(coarse.select(*params, F.col(coarse_order)), coarse_order).select(
        *keys, "__n", F.col(coarse_order).alias("coarse_id")
    )
    return left.join(right, [*keys, "__n"], "left").drop(*keys, "__n")


def interpolate(
    coarse: DataFrame,
    fine: DataFrame,
    keys: Sequence[str],
    axis: str,
    values: Sequence[str],
    chunk: Column,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Coarse values on the fine axis, linear between neighbours.

    Both sides are stacked and the nearest coarse sample is carried forward and
    backward along the axis, so the work is one ordered pass, not a range join.
    ``covered`` is false where the fine point lies outside the coarse range.
    """
    sample = F.struct(F.col(axis).alias("f"), *[F.col(v).alias(v) for v in values])
    extra = [c for c in fine.columns if c not in keys and c != axis]
    stacked = coarse.select(*keys, axis, F.lit(0).alias("__side"), sample.alias("__c")).unionByName(
        fine.select(*keys, axis, *extra, F.lit(1).alias("__side")), allowMissingColumns=True
    )
    order = [axis, "__side", *[t for t in ties if t in extra]]
    down = ordered.forward_fill(stacked, keys, order, chunk, {"__lo": "__c"})
    # A coarse sample at the same axis value sorts first, so it is the lower end.
    both = ordered.backward_fill(down, keys, order, chunk, {"__hi": "__c"}).where("__side = 1")
    low, high = F.col("__lo.f"), F.col("__hi.f")
    share = F.when(high > low, (F.col(axis) - low) / (high - low)).otherwise(F.lit(0.0))
    out = {}
    for v in values:
        a, b = F.col(f"__lo.{v}"), F.col(f"__hi.{v}")
        out[f"coarse_{v}"] = F.when(F.col(axis) == low, a).otherwise(a + (b - a) * share)
    exact = F.col(axis) == low
    covered = low.isNotNull() & (exact | high.isNotNull())
    result = both.withColumns(out).withColumn("covered", F.coalesce(covered, F.lit(False)))
    return result.drop("__side", "__c", "__lo", "__hi")


def with_dc(rows: DataFrame, dc: DataFrame, block: Sequence[str], axis: str, values: Sequence[str], label: Sequence[str] = ("label",)) -> DataFrame:
    """Take zero-frequency values from the DC prediction where there is one."""
    renamed = dc.select(*block, *label, *[F.col(v).alias(f"__dc_{v}") for v in values])
    joined = rows.join(renamed, [*block, *label], "left")
    return joined.withColumns(
        {v: F.when(F.col(axis) == 0.0, F.coalesce(F.col(f"__dc_{v}"), F.col(v))).otherwise(F.col(v)) for v in values}
    ).drop(*[f"__dc_{v}" for v in values])


def positive_rows(rows: DataFrame, axis: str = "freq_hz") -> DataFrame:
    return rows.where(F.col(axis) > 0.0)


def zero_rows(rows: DataFrame, axis: str = "freq_hz") -> DataFrame:
    """Exact zero only; the lowest RF row never stands in."""
    return rows.where(F.col(axis) == 0.0)


def usable_dc(samples: DataFrame, sigma: str = "max_singular_value", tolerance: float = 1e-6) -> DataFrame:
    """Zero-frequency matrices that are finite and passive."""
    finite = F.forall("matrix", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return zero_rows(samples).where(finite & (F.col(sigma) <= 1.0 + tolerance))


def dc_matrices(samples: DataFrame, block: Sequence[str]) -> DataFrame:
    """Mean of the usable zero-frequency matrices of each block, entry by entry."""
    cells = samples.select(*block, F.posexplode("matrix").alias("entry", "value"))
    means = cells.groupBy(*block, "entry").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return means.groupBy(*block).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("entry", "value"))), lambda s: s["value"]).alias("dc_matrix"),
        F.max("n").alias("dc_rows"),
    )


def features(
    rows: DataFrame,
    params: Sequence[str],
    axis: str,
    response: Sequence[str],
    coarse: Sequence[str] = (),
    transform: str = "log",
    residual: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``x`` and ``y`` arrays for fitting: parameters, frequency features and, if
    asked, the coarse response as input; target is the response or the residual."""
    x = [F.col(p) for p in params] + frequency_features(F.col(axis), transform)
    if coarse and not residual:
        x += [F.col(c) for c in coarse]
    y = [F.col(r) - F.col(c) for r, c in zip(response, coarse)] if residual else [F.col(r) for r in response]
    return rows.where(F.col(axis) > 0.0).select(*keep, F.array(*x).alias("x"), F.array(*y).alias("y"))


# --- scalers ------------------------------------------------------------------


def standardizer(rows: DataFrame, columns: Sequence[str], tiny: float = 1e-12) -> DataFrame:
    """``column, mean, std, floored``: near-constant columns take the median std
    of the others, or 1 when there is none."""
    stats = rows.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std"))
            for c in columns
        ]
    )
    long = stats.select(F.explode(pairs).alias("p")).select("p.*")
    varying = F.when(F.col("std") >= tiny, F.col("std"))
    floor = long.agg(F.percentile(varying, F.lit(0.5)).alias("__floor"))
    flat = F.col("std") < tiny
    return long.crossJoin(F.broadcast(floor)).select(  # one row
        "column",
        "mean",
        F.when(flat, F.coalesce("__floor", F.lit(1.0))).otherwise(F.col("std")).alias("std"),
        flat.alias("floored"),
    )


def common_rms_scale(rows: DataFrame, columns: Sequence[str], tiny: float = 1e-12) -> DataFrame:
    """``column, mean, std`` with one scale for all: RMS of the centred values."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.var_pop(c).alias(f"v_{c}") for c in columns])
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(f"v_{c}")
    scale = F.sqrt(total / len(columns))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean")) for c in columns])
    return stats.select(F.when(scale >= tiny, scale).otherwise(F.lit(1.0)).alias("std"), F.explode(pairs).alias("p")).select(
        "p.column", "p.mean", "std"
    )


def value_stats(rows: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Finite count, min, max, mean, std, rms and median."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    v = F.when(finite, value)
    facts = rows.groupBy(*by).agg(
        F.count(v).alias("finite_values"),
        F.count_if(~finite).alias("nonfinite_values"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.sqrt(F.avg(v * v)).alias("rms"),
    )
    return ordered.with_percentiles(facts, rows, by, v, {"median": 0.5})


def profile(response: DataFrame, block: DataFrame) -> DataFrame:
    """One row describing a sweep table: blocks, splits, labels, frequency span."""
    rows = response.agg(
        F.sort_array(F.collect_set("label")).alias("labels"),
        F.min("freq_hz").alias("minimum_frequency_hz"),
        F.max("freq_hz").alias("maximum_frequency_hz"),
    )
    blocks = block.agg(
        F.count("*").alias("blocks"),
        F.count_if(F.col("role") == "train").alias("train_blocks"),
        F.count_if(F.col("role") == "verification").alias("verification_blocks"),
    )
    return blocks.crossJoin(F.broadcast(rows))  # one row each


def numeric_parameters(block: DataFrame) -> DataFrame:
    """Parameters that are numeric in every block."""
    from ..functions.units import parse_si

    total = block.agg(F.count("*").alias("blocks"))
    counts = (
        block.select(F.explode("params").alias("parameter", "token"))
        .groupBy("parameter")
        .agg(F.count(parse_si(F.col("token"))).alias("n"))
    )
    return counts.join(F.broadcast(total), F.col("n") == F.col("blocks")).select("parameter")  # one row


def blank_template(block: DataFrame, freqs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every fitted block, frequency and label with zero responses."""
    grid = freqs.crossJoin(F.broadcast(labels))  # labels: N*N rows
    return block.crossJoin(F.broadcast(grid)).withColumn("re", F.lit(0.0)).withColumn("im", F.lit(0.0))
