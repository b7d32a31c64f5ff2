"""Design-point inventories: keys, dedupe, union, conflicts, leakage, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import ordered


def keep_first(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """First row of each key.  A grouped ``min_by``: copies collapse map-side,
    where a ranking window would ship every copy to one task."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return best.select(*key, *[F.col("__r")[c].alias(c) for c in rest]).select(rows.columns)


def training_wins(rows: DataFrame, key: Sequence[str], split: str, order: str) -> DataFrame:
    """One row per key.  Training beats verification whatever the order; the
    survivor takes the first position at which the key was seen."""
    rest = [c for c in rows.columns if c not in key]
    choice = F.struct(F.when(F.col(split) == "train", 0).otherwise(1), F.col(order))
    best = rows.groupBy(*key).agg(
        F.min_by(F.struct(*rest), choice).alias("__r"), F.min(order).alias("position")
    )
    return best.select(*key, *[F.col("__r")[c].alias(c) for c in rest], "position")


def cleanup_counts(rows: DataFrame, key: Sequence[str], split: str, order: str) -> DataFrame:
    """Duplicates removed within a split and across splits while keeping the
    first row, with training replacing verification.

    Per key the survivor is verification until the first training row, then
    training; a later row counts as cross-split when it differs from it.
    """
    train = F.col(split) == "train"
    facts = rows.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.min(order).alias("first"),
        F.min(F.when(train, F.col(order))).alias("first_train"),
        F.count_if(train).alias("trains"),
    )
    joined = rows.join(facts.where("n > 1").select(*key, "first", "first_train"), list(key))
    later = joined.where(F.col(order) != F.col("first"))
    before = F.when(F.col("first_train") < F.col(order), "train").otherwise("verification")
    return later.agg(
        F.count_if(F.col(split) == before).alias("same_split_duplicates_removed"),
        F.count_if(F.col(split) != before).alias("cross_split_duplicates_removed"),
    )


def cross_split_conflicts(rows: DataFrame, key: Sequence[str], split: str, source: str, order: str) -> DataFrame:
    """Later rows of the other split than the first row of their key."""
    first = rows.groupBy(*key).agg(
        F.min_by(split, order).alias("first_dataset"),
        F.min_by(source, order).alias("first_source"),
        F.min(order).alias("__first"),
    )
    return (
        rows.join(first, list(key))
        .where((F.col(order) > F.col("__first")) & (F.col(split) != F.col("first_dataset")))
        .select(
            *key,
            "first_dataset",
            "first_source",
            F.col(split).alias("conflicting_dataset"),
            F.col(source).alias("conflicting_source"),
            F.lit("train").alias("retained_dataset"),
        )
    )


def accumulate(parts: Sequence[DataFrame], key: Sequence[str], split: str, order: str) -> DataFrame:
    """Union of inventories in the order given, one row per key.

    ``order`` is the row order inside each part.
    """
    stacked = None
    for rank, part in enumerate(parts):
        tagged = part.withColumn("__seq", F.struct(F.lit(rank).alias("part"), F.col(order).cast("long").alias("row")))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    return training_wins(stacked, key, split, "__seq").drop("__seq")


def new_duplicates(batch: DataFrame, occupied: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of a new batch that are taken or repeated; must be empty."""
    counts = batch.groupBy(*key).agg(F.count("*").alias("n"))
    return (
        counts.join(occupied.select(*key).distinct().withColumn("taken", F.lit(True)), list(key), "left")
        .where("n > 1 OR taken")
        .select(*key, "n", F.coalesce("taken", F.lit(False)).alias("taken"))
    )


def unoccupied(candidates: DataFrame, occupied: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Candidates with a free key, the first of each key.  Copies are removed
    before the anti join so a hot key is shuffled once per task."""
    return keep_first(candidates, key, order).join(occupied.select(*key).distinct(), list(key), "left_anti")


def leaked(metrics: DataFrame, training: DataFrame, key: Sequence[str]) -> DataFrame:
    """Measured geometries that also occur in training."""
    return metrics.join(training.select(*key).distinct(), list(key), "left_semi")


def verification_observations(verification: DataFrame, metrics: DataFrame, training: DataFrame, key: Sequence[str]) -> DataFrame:
    """(verification union metrics) minus training, as a set of keys."""
    return (
        verification.select(*key).union(metrics.select(*key)).distinct().join(
            training.select(*key).distinct(), list(key), "left_anti"
        )
    )


def split_overlap(rows: DataFrame, key: Sequence[str], split: str) -> DataFrame:
    """Keys present in both splits."""
    return (
        rows.groupBy(*key)
        .agg(F.max(F.col(split) == "train").alias("t"), F.max(F.col(split) == "verification").alias("v"))
        .where("t AND v")
        .select(*key)
    )


def split_integrity(rows: DataFrame, key: Sequence[str], split: str) -> DataFrame:
    """One row: geometries, unique, per split and shared between splits."""
    keys = rows.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(split) == "train").alias("train"),
        F.count_if(F.col(split) == "verification").alias("verification"),
    )
    return keys.agg(
        F.sum("n").alias("total"),
        F.count("*").alias("unique_geometries"),
        F.sum("train").alias("train"),
        F.sum("verification").alias("verification"),
        F.count_if((F.col("train") > 0) & (F.col("verification") > 0)).alias("train_verification_overlap"),
    )


def inventory_counts(rows: DataFrame, key: Sequence[str], split: str) -> DataFrame:
    """Training and verification keys, training winning shared ones."""
    owners = rows.groupBy(*key).agg(F.max(F.col(split) == "train").alias("is_training"))
    return owners.agg(
        F.count_if("is_training").alias("training"), F.count_if(~F.col("is_training")).alias("verification")
    )


def constraint_violations(
    rows: DataFrame, key: Sequence[str], checks: dict[str, Column], split: str | None = None
) -> DataFrame:
    """``rule, rows``: failed row checks, repeated keys, keys in both splits."""
    marks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    failed = (
        rows.select(F.explode(F.array_compact(marks)).alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))
    )
    repeated = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    out = failed.unionByName(
        repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).where("rows > 0").select(
            F.lit("duplicate_key").alias("rule"), "rows"
        )
    )
    if split:
        out = out.unionByName(
            split_overlap(rows, key, split).agg(F.count("*").alias("rows")).where("rows > 0").select(
                F.lit("split_overlap").alias("rule"), "rows"
            )
        )
    return out


def rounded_unique(points: DataFrame, axes: Sequence[str], order: str, tolerance: float = 1e-10) -> DataFrame:
    """Points unique on a grid of ``tolerance``, first kept."""
    cells = [F.rint(F.col(a) / tolerance).cast("long").alias(f"__k_{a}") for a in axes]
    keyed = points.select("*", *cells)
    names = [f"__k_{a}" for a in axes]
    return keep_first(keyed, names, order).drop(*names)


def number_points(rows: DataFrame, order: str, split: str, chunk: Column | None = None) -> DataFrame:
    """point_index over all rows and sequence numbers within each split."""
    chunk = ordered.index_chunk(F.col(order)) if chunk is None else chunk
    train = F.when(F.col(split) == "train", 1).otherwise(0).cast("long")
    numbered = ordered.running(
        rows,
        [],
        [order],
        chunk,
        {
            "point_index": F.lit(1).cast("long"),
            "__t": train,
            "__v": F.lit(1).cast("long") - train,
        },
    )
    is_train = F.col(split) == "train"
    return (
        numbered.withColumn("train_sequence", F.when(is_train, F.col("__t")))
        .withColumn("verification_sequence", F.when(~is_train, F.col("__v")))
        .withColumn("split_sequence", F.coalesce("train_sequence", "verification_sequence"))
        .drop("__t", "__v")
    )


def head_split(rows: DataFrame, index: str, total: int, verification: int) -> DataFrame:
    """First rows train, the last ``verification`` rows verification; ``index`` from 1."""
    return rows.withColumn(
        "dataset", F.when(F.col(index) <= total - verification, "train").otherwise("verification")
    )


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows by which two tables differ, as multisets, with their side."""
    cols = left.columns
    counted = (
        left.select(*cols, F.lit(1).alias("__n"))
        .unionByName(right.select(*cols, F.lit(-1).alias("__n")))
        .groupBy(*cols)
        .agg(F.sum("__n").alias("surplus"))
    )
    return counted.where("surplus != 0")


def family_violations(combined: DataFrame, views: dict[str, DataFrame], key: Sequence[str], split: str) -> DataFrame:
    """Each split view must equal the rows of its role in the combined inventory."""
    out = None
    for role, view in views.items():
        differing = same_rows(combined.where(F.col(split) == role).select(*key), view.select(*key))
        row = differing.agg(F.count("*").alias("differences")).select(F.lit(role).alias("view"), "differences")
        out = row if out is None else out.unionByName(row)
    return out.where("differences > 0")


def density_recommendation(
    inventory: DataFrame, split: str, ratio: float, dimensions: int, explicit_count: int | None = None
) -> DataFrame:
    """How many points a range extension needs.

    Only the literal label ``verification`` counts as verification.
    """
    counts = inventory.agg(
        F.count("*").alias("n"), F.count_if(F.col(split) == "verification").alias("v")
    ).withColumn("t", F.col("n") - F.col("v"))
    advised_train = F.greatest(F.ceil(F.col("t") * F.lit(ratio)), F.lit(4 * dimensions))
    advised_check = F.greatest(F.ceil(F.col("v") * F.lit(ratio)), F.lit(2 * dimensions))
    if explicit_count is None:
        return counts.select(
            F.col("n").alias("existing"),
            advised_train.cast("long").alias("train"),
            advised_check.cast("long").alias("verification"),
        )
    share = F.rint(F.lit(float(explicit_count)) * F.col("v") / F.col("n"))
    check = F.least(F.lit(float(explicit_count - 1)), F.greatest(F.lit(1.0), share)).cast("long")
    return counts.select(
        F.col("n").alias("existing"),
        (F.lit(explicit_count) - check).cast("long").alias("train"),
        check.alias("verification"),
    )


def holdout(
    blocks: DataFrame, key: str, label: Column, fraction: float = 0.2, seed: int = 1234
) -> DataFrame:
    """Role of each block: by split label, or a seeded hold-out of whole blocks
    when no block is labelled for training.

    The hold-out takes the blocks with the smallest hash up to the wanted count;
    the cut is found from a histogram of hash prefixes, never a global sort.
    """
    from ..functions.labels import TRAIN_WORDS, VERIFICATION_WORDS

    word = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    tagged = blocks.withColumn("__t", word.isin(*TRAIN_WORDS)).withColumn("__v", word.isin(*VERIFICATION_WORDS))
    facts = tagged.agg(F.count_if("__t").alias("trains"), F.count("*").alias("n")).first()
    if facts["trains"]:
        role = F.when(F.col("__t"), "train").when(F.col("__v"), "verification").otherwise("unassigned")
        return tagged.withColumn("role", role).drop("__t", "__v")
    wanted = min(facts["n"] - 1, max(1, round(facts["n"] * fraction))) if facts["n"] > 1 and fraction > 0 else 0
    ranked = hash_ranked(tagged, key, seed, wanted)
    return ranked.withColumn("role", F.when(F.col("chosen"), "verification").otherwise("train")).drop(
        "chosen", "__t", "__v"
    )


def hash_ranked(rows: DataFrame, key: str, seed: int, wanted: int) -> DataFrame:
    """Mark exactly ``wanted`` rows with the smallest seeded hash (``chosen``)."""
    hashed = rows.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key)))
    bucket = F.shiftrightunsigned(F.col("__h"), 44).cast("int")
    ordered_hash = hashed.withColumn("__b", bucket)
    counts = ordered_hash.groupBy("__b").agg(F.count("*").alias("n"))
    before = ordered.running(counts, [], ["__b"], ordered.index_chunk(F.col("__b")), {"upto": F.col("n")})
    edge = before.where(F.col("upto") >= wanted).agg(F.min_by(F.struct("__b", (F.col("upto") - F.col("n")).alias("done")), "__b").alias("e")).first()["e"]
    if wanted <= 0 or edge is None:
        return ordered_hash.withColumn("chosen", F.lit(wanted > 0)).drop("__h", "__b")
    from pyspark.sql import Window

    inside = ordered_hash.where(F.col("__b") == edge["__b"]).withColumn(
        "__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    )
    picked = inside.where(F.col("__r") <= wanted - edge["done"]).select(F.col(key).alias("__k"), F.lit(True).alias("__c"))
    out = ordered_hash.join(picked, F.col(key) == F.col("__k"), "left")
    return out.withColumn("chosen", (F.col("__b") < edge["__b"]) | F.coalesce("__c", F.lit(False))).drop(
        "__h", "__b", "__k", "__c"
    )
