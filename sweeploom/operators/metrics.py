"""Truth against prediction: weights, error metrics and error regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import ordered

from ..functions.complexmath import magnitude
from ..functions.scores import metric_score
from ..functions.units import is_finite
from ..session import broadcast_small

# Metrics tried in this order when none is named.
METRIC_PREFERENCE = ("evm_pct", "rmse_abs", "max_abs", "rmse_db", "max_abs_db")
NEAR_ZERO = 1e-12


def match_positions(
    truth: DataFrame,
    predicted: DataFrame,
    keys: Sequence[str],
    axis: str,
    values: Sequence[str],
    rel: float = 1e-10,
    abs_tol: float = 1e-6,
) -> DataFrame:
    """Truth next to prediction by position, with ``grid_ok`` per row."""
    left = truth.select(*keys, F.col(axis).alias("truth_axis"), *[F.col(v).alias(f"truth_{v}") for v in values])
    right = predicted.select(*keys, F.col(axis).alias("pred_axis"), *[F.col(v).alias(f"pred_{v}") for v in values])
    gap = F.abs(F.col("truth_axis") - F.col("pred_axis"))
    both = left.join(right, list(keys), "full")
    return both.withColumn(
        "grid_ok", F.coalesce(gap <= F.lit(abs_tol) + F.lit(rel) * F.abs(F.col("truth_axis")), F.lit(False))
    )


def apply_rules(
    rows: DataFrame, rules: DataFrame, matches: Column, row_key: Sequence[str], default: float = 1.0
) -> DataFrame:
    """Add ``weight``: the last matching rule (largest ``ordinal``) wins.

    ``matches`` compares row and rule columns.  Rules are few and their number
    is checked before they are shared with every task.
    """
    distinct = rows.select(*row_key).distinct()
    hit = distinct.join(broadcast_small(rules), matches, "left")
    chosen = hit.groupBy(*row_key).agg(F.max_by("rule_weight", "ordinal").alias("weight"))
    return rows.join(chosen, list(row_key), "left").withColumn("weight", F.coalesce("weight", F.lit(default)))


# Accepted words of each label selector.
ALL_WORDS = ("all", "default", "*")
DIAGONAL_WORDS = ("diag", "diagonal", "return", "reflection")
OFF_DIAGONAL_WORDS = ("offdiag", "off-diagonal", "transmission")
ROW_WORDS = r"^(?:row|out|output)([0-9]+)$"
COLUMN_WORDS = r"^(?:col|column|in|input)([0-9]+)$"


def label_selector(selector: Column, label: Column, row: Column, col: Column) -> Column:
    """Does a label rule select this entry?  Words, ``rowN`` / ``colN``,
    wildcards such as ``S2*`` and comma lists are understood."""
    text = F.lower(F.trim(selector))
    name = F.lower(label)
    listed = F.exists(
        F.split(text, r"\s*,\s*"),
        lambda item: (item == name)
        | (
            F.contains(item, F.lit("*"))
            & F.rlike(name, F.concat(F.lit("^"), F.replace(item, F.lit("*"), F.lit(".*")), F.lit("$")))
        ),
    )
    return (
        F.when(text.isin(*ALL_WORDS), F.lit(True))
        .when(text.isin(*DIAGONAL_WORDS), row == col)
        .when(text.isin(*OFF_DIAGONAL_WORDS), row != col)
        .when(text == "upper", row < col)
        .when(text == "lower", row > col)
        .when(text.rlike(ROW_WORDS), F.regexp_extract(text, ROW_WORDS, 1).try_cast("int") == row)
        .when(text.rlike(COLUMN_WORDS), F.regexp_extract(text, COLUMN_WORDS, 1).try_cast("int") == col)
        .otherwise(listed)
    )


def frequency_selector(low: Column, high: Column, freq: Column, rel: float = 1e-9) -> Column:
    """Inclusive band; a point is a band with equal ends."""
    slack = F.lit(rel) * F.greatest(F.abs(low), F.abs(high), F.lit(1.0))
    return (freq >= low - slack) & (freq <= high + slack)


def normalise_weights(rows: DataFrame, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Divide weights by their mean, over all rows or per group."""
    means = rows.groupBy(*by).agg(F.avg(weight).alias("__mean"))
    joined = rows.join(means, list(by)) if by else rows.crossJoin(F.broadcast(means))  # one row when global
    return joined.withColumn(f"normalized_{weight}", F.col(weight) / F.col("__mean")).drop("__mean")


def verification_metrics(
    matched: DataFrame,
    by: Sequence[str],
    truth: Sequence[str],
    predicted: Sequence[str],
    weight: Column | None = None,
) -> DataFrame:
    """Error metrics per group, plain and weighted; ``truth`` is [re] or [re, im].

    Decibel errors leave out rows whose truth or prediction is nearly zero.
    """
    zero = F.lit(0.0)

    def part(names: Sequence[str], i: int) -> Column:
        return F.col(names[i]) if i < len(names) else zero

    w = F.lit(1.0) if weight is None else weight
    err = magnitude(part(predicted, 0) - part(truth, 0), part(predicted, 1) - part(truth, 1))
    ref, got = magnitude(part(truth, 0), part(truth, 1)), magnitude(part(predicted, 0), part(predicted, 1))
    heard = (ref > NEAR_ZERO) & (got > NEAR_ZERO)
    db = F.when(heard, F.lit(20.0) * F.log10(got / ref))
    rows = matched.select(
        *by, err.alias("__e"), ref.alias("__t"), db.alias("__d"), w.alias("__w")
    )
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse_abs"),
        F.avg("__e").alias("mean_abs"),
        F.max("__e").alias("max_abs"),
        F.sqrt(F.try_divide(F.sum(F.col("__e") * F.col("__e")), F.sum(F.col("__t") * F.col("__t")))).alias("evm_rms"),
        F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias("rmse_db"),
        F.max(F.abs("__d")).alias("max_abs_db"),
        F.sqrt(
            F.try_divide(F.sum(F.col("__w") * F.col("__e") * F.col("__e")), F.sum("__w"))
        ).alias("weighted_rmse_abs"),
        F.sqrt(
            F.try_divide(
                F.sum(F.col("__w") * F.col("__e") * F.col("__e")), F.sum(F.col("__w") * F.col("__t") * F.col("__t"))
            )
        ).alias("weighted_evm_rms"),
    )
    return sums.withColumn("evm_pct", F.col("evm_rms") * 100.0).withColumn(
        "evm_db", F.when(F.col("evm_rms") > 0, F.lit(20.0) * F.log10("evm_rms"))
    )


def choose_metric(metrics: DataFrame, preference: Sequence[str] = METRIC_PREFERENCE) -> DataFrame:
    """One row ``metric``: the first preferred column with any value."""
    present = [c for c in preference if c in metrics.columns]
    filled = [F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in present]
    counts = metrics.agg(*filled)
    return counts.select(
        F.coalesce(*[F.when(F.col(c) > 0, F.lit(c)) for c in present]).alias("metric")
    )


def usable_rows(
    metrics: DataFrame, value: Column, tokens: Sequence[Column], units: Sequence[Column]
) -> DataFrame:
    """Flag metric rows in stages: ``has_metric``, ``complete``, ``parsed``, ``inside``.

    ``units`` are the unit coordinates of the parameters, ``tokens`` their texts.
    """
    complete = F.lit(True)
    parsed = F.lit(True)
    inside = F.lit(True)
    for token, u in zip(tokens, units):
        complete = complete & token.isNotNull() & (F.trim(token.cast("string")) != "")
        parsed = parsed & is_finite(u)
        inside = inside & (u >= F.lit(-1e-9)) & (u <= F.lit(1.0 + 1e-9))
    has = is_finite(value)
    return (
        metrics.withColumn("metric_value", F.when(has, value))
        .withColumn("has_metric", has)
        .withColumn("complete", has & complete)
        .withColumn("parsed", has & complete & parsed)
        .withColumn("inside", has & complete & parsed & F.coalesce(inside, F.lit(False)))
    )


def stage_counts(flagged: DataFrame, sample: Column, samples: int = 3) -> DataFrame:
    """One row of staged counters with up to ``samples`` texts of each failure."""
    counts = flagged.agg(
        F.count_if("has_metric").alias("usable_metric_rows"),
        F.count_if("complete").alias("complete_parameter_rows"),
        F.count_if("parsed").alias("parsed_parameter_rows"),
        F.count_if("inside").alias("accepted_rows"),
    )

    def shown(rule: Column, name: str) -> DataFrame:
        # A bounded top-k keeps the collected list at ``samples`` texts.
        picked = flagged.where(rule).select(sample.alias("s")).orderBy("s").limit(samples)
        return picked.agg(F.sort_array(F.collect_list("s")).alias(name))

    invalid = shown(F.col("complete") & ~F.col("parsed"), "invalid_samples")
    outside = shown(F.col("parsed") & ~F.col("inside"), "outside_samples")
    return counts.crossJoin(F.broadcast(invalid)).crossJoin(F.broadcast(outside))  # one row each


def effective_weight(normalised: Column, plain: Column) -> Column:
    """A positive normalised weight, else the plain one; a missing or zero plain weight counts as 1."""
    return F.when(normalised > 0.0, normalised).otherwise(
        F.when(F.coalesce(plain, F.lit(0.0)) != 0.0, plain).otherwise(F.lit(1.0))
    )


def error_regions(
    rows: DataFrame, source: str, axes: Sequence[str], metric: str, value: str, label: str, weight: Column, ordinal: str
) -> DataFrame:
    """Weighted RMS error of each geometry.

    Groups by source and unit point rounded half-even to 12 decimals;
    the worst label is the first row with the largest score.
    """
    scored = rows.select(
        F.col(source).alias("source_index"),
        *[(F.rint(F.col(a) * 1e12) / 1e12 + F.lit(0.0)).alias(a) for a in axes],
        metric_score(metric, F.col(value)).alias("__s"),
        weight.alias("__w"),
        F.col(label).alias("__l"),
        F.col(ordinal).alias("__o"),
    )
    regions = scored.groupBy("source_index", *axes).agg(
        F.sqrt(F.try_divide(F.sum(F.col("__w") * F.col("__s") * F.col("__s")), F.sum("__w"))).alias("score"),
        F.sum("__w").alias("weight_sum"),
        F.max_by("__l", F.struct(F.col("__s"), -F.col("__o"))).alias("worst_sparam"),
        F.max("__s").alias("worst_sparam_score"),
        F.count("*").alias("row_count"),
    )
    return regions.where("weight_sum > 0").drop("weight_sum")


def region_summary(regions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rms, median, p90 (linear interpolation) and max of the region scores."""
    s = F.greatest(F.col("score"), F.lit(0.0))
    facts = regions.groupBy(*by).agg(F.sqrt(F.avg(s * s)).alias("rms"), F.max(s).alias("max"), F.count("*").alias("regions"))
    out = ordered.with_percentiles(facts, regions, by, s, {"median": 0.5, "p90": 0.9})
    return out.select(*by, "rms", "median", "p90", "max", "regions")


def ranked(rows: DataFrame, score: str, ties: Sequence[str], name: str = "rank") -> DataFrame:
    """Rank all rows by descending score: range-partitioned running count over
    chunks of the score's magnitude, never one global window."""
    # NaN sorts last: its negative is NaN again, which is behind every number.
    known = F.when(~F.isnan(F.col(score)), F.col(score))
    size = F.least(F.greatest(F.abs(known), F.lit(1e-300)), F.lit(1e300))
    level = F.floor(F.log2(size) * F.lit(256.0)).cast("long") + F.lit(300_000)
    chunk = F.when(known > 0, -level).when(known < 0, level).when(known == 0, F.lit(0))
    chunk = F.coalesce(chunk, F.when(F.col(score).isNull(), F.lit(-1_000_000)).otherwise(F.lit(1_000_000)))
    order = ["__neg", *ties]
    return ordered.global_index(rows.withColumn("__neg", -F.col(score)), order, chunk, name).drop("__neg")
