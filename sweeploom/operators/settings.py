"""Ranked resolution of recovered settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

RANK = ("priority", "mtime", "source")


def winners(settings: DataFrame, path: Sequence[str] = ("path",), value: str = "value") -> DataFrame:
    """Highest (priority, mtime, source) of each path, with its distinct sources counted."""
    rank = F.struct(*RANK)
    return settings.groupBy(*path).agg(
        F.max_by(value, rank).alias("selected_value"),
        F.max(rank).alias("__rank"),
        F.count("*").alias("candidates"),
        F.count_distinct(value).alias("distinct_values"),
    ).select(
        *path,
        "selected_value",
        F.col("__rank.priority").alias("priority"),
        F.col("__rank.mtime").alias("mtime"),
        F.col("__rank.source").alias("selected_source"),
        "candidates",
        "distinct_values",
    )


def conflicts(settings: DataFrame, path: Sequence[str] = ("path",), value: str = "value") -> DataFrame:
    """Every losing value against the final winner of its path, with the reason.

    Losers with equal values merge to their strongest source, so the result is
    bounded by the number of distinct values.
    """
    won = winners(settings, path, value).select(
        *path, "selected_value", "selected_source", F.col("priority").alias("__p")
    )
    losers = settings.groupBy(*path, value).agg(F.max(F.struct(*RANK)).alias("__r"))
    return (
        losers.join(won, list(path))
        .where(~F.col(value).eqNullSafe(F.col("selected_value")))
        .select(
            *path,
            "selected_value",
            "selected_source",
            F.col(value).alias("other_value"),
            F.col("__r.source").alias("other_source"),
            F.when(F.col("__r.priority") != F.col("__p"), "higher-confidence artifact")
            .otherwise("newer artifact of equal confidence")
            .alias("resolution"),
        )
    )


def prefix_collisions(settings: DataFrame, path: str = "path") -> DataFrame:
    """Pairs of paths where one is a strict prefix of the other.

    Distinct paths explode to their prefixes and meet them by equality.
    """
    paths = settings.select(path).distinct()
    prefixes = paths.select(
        F.col(path).alias("longer"),
        F.explode(F.sequence(F.lit(1), F.size(path) - 1)).alias("n"),
    ).where("n >= 1 AND n < size(longer)").select("longer", F.expr("slice(longer, 1, n)").alias("shorter"))
    return prefixes.join(paths.select(F.col(path).alias("shorter")), "shorter")


def resolved(settings: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """Winners with prefix collisions decided: the higher-ranked path stays."""
    won = winners(settings, [path], value)
    rank = F.struct("priority", "mtime", F.col("selected_source").alias("source"))
    ranks = won.select(F.col(path), rank.alias("__r"))
    pairs = (
        prefix_collisions(settings, path)
        .join(ranks.select(F.col(path).alias("shorter"), F.col("__r").alias("__s")), "shorter")
        .join(ranks.select(F.col(path).alias("longer"), F.col("__r").alias("__l")), "longer")
    )
    losing = pairs.select(F.when(F.col("__s") >= F.col("__l"), F.col("longer")).otherwise(F.col("shorter")).alias(path)).distinct()
    return won.join(losing, path, "left_anti")


def distinct_in_order(rows: DataFrame, by: Sequence[str], value: str, order: str, separator: str = ",") -> DataFrame:
    """Distinct values of each group in first-seen order.

    Values reduce to their first position before they are gathered.
    """
    firsts = rows.groupBy(*by, value).agg(F.min(order).alias("__o"))
    return firsts.groupBy(*by).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("__o", F.col(value).cast("string").alias("__v")))),
                lambda s: s["__v"],
            ),
            separator,
        ).alias("values_in_order")
    )


def fill_from_alternatives(
    settings: DataFrame, commands: DataFrame, alternatives: DataFrame, name: str = "name"
) -> DataFrame:
    """Give a command's missing setting the value of its first filled alternative.

    ``settings``: location, name, value.  ``commands``: location, name wanted.
    ``alternatives``: location, ordinal, other (location to borrow from).
    """
    own = commands.join(settings, ["location", name], "left")
    borrowed = (
        own.where("value IS NULL")
        .select("location", name)
        .join(alternatives, "location")
        .join(settings.select(F.col("location").alias("other"), name, F.col("value").alias("__v")), ["other", name])
        .groupBy("location", name)
        .agg(F.min_by("__v", "ordinal").alias("__b"), F.min_by("other", "ordinal").alias("borrowed_from"))
    )
    return own.join(borrowed, ["location", name], "left").select(
        "location", name, F.coalesce("value", "__b").alias("value"), "borrowed_from"
    )


def first_existing(pointers: DataFrame, existing: DataFrame, key: Sequence[str], path: str, ordinal: str) -> DataFrame:
    """First pointer (by ordinal) whose file exists, per key."""
    found = pointers.join(existing.select(path).distinct(), path, "left_semi")
    return found.groupBy(*key).agg(F.min_by(path, ordinal).alias(path), F.min(ordinal).alias(ordinal))


def metrics_source(candidates: DataFrame, key: Sequence[str], allow_nonpassive: bool = False) -> DataFrame:
    """Metrics table to use: explicit, fit folder, best model, and a fallback
    that is not passive only when allowed.

    ``candidates``: key, kind, path, exists.
    """
    # Order in which the kinds are tried.
    order = {"explicit": 0, "fit_dir": 1, "best_model": 2, "nonpassive_fallback": 3}
    rank: Column = F.lit(None).cast("int")
    for kind, position in order.items():
        rank = F.when(F.col("kind") == kind, F.lit(position)).otherwise(rank)
    usable = candidates.withColumn("__o", rank).where("exists AND __o IS NOT NULL")
    if not allow_nonpassive:
        usable = usable.where("kind != 'nonpassive_fallback'")
    return usable.groupBy(*key).agg(F.min_by("path", "__o").alias("path"), F.min_by("kind", "__o").alias("kind"))

