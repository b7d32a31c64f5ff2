"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its size takes every document floor(r) times
for certain; the rest is sampled.  Document i of the sample has inclusion odds
p / (1 - p) with p the fractional part of r times its boost, and documents are
ranked by random odds divided by inclusion odds.  The sample has a fixed size
in words: documents enter by rank until the source's open words are met, and
the one at the border enters if more than half of it fits.

The cut is found without ordering a source in one task: words are summed by
(source, slice of the logarithm of the rank), the running sums of slices name
the one slice with the border, and only that slice is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CEILING = 2.0

# Slices per unit of the natural logarithm of the rank; the densest slice of a
# source holds about 1 / (4 * SLICES) of its documents.
SLICES = 1024


def targets(sizes: DataFrame, share: float = SHARE, weights=WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sizes`` has source (NULL allowed) and size.  Weights repeat over the
    sources by code point, NULL last.  A target stops at ``ceiling`` times its
    source's size; the excess is shared again by weight until none is above.
    That is the level L with sum(min(cap, L * weight)) = total, found from
    running sums over the sources ordered by cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("__n", F.row_number().over(everything) - 1)
    per = per.withColumn("__w", F.element_at(cycle, (F.col("__n") % len(weights) + 1).cast("int")))
    per = per.withColumn("__cap", F.lit(float(ceiling)) * F.col("source_size"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("__total", F.lit(float(share)) * F.sum("source_size").over(whole))
    per = per.withColumn(
        "__level",
        (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(onward),
    )
    steep = F.col("__cap") / F.col("__w")
    first = F.min(F.when(steep >= F.col("__level"), F.struct(steep.alias("__r"), "__n", "__level"))).over(whole)
    per = per.withColumn("__L", first["__level"])
    target = F.least("__cap", F.coalesce(F.col("__L") * F.col("__w"), F.col("__cap")))
    return per.select("source", "source_size", "docs", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    boost: Column | None = None,
    share: float = SHARE,
    weights=WEIGHTS,
    ceiling: float = CEILING,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken.

    ``docs`` needs doc_id, source and text (or a ``size``); other columns pass through unless
    they bear one of the new names.  NULL or empty texts have size 0 and take
    0 words; a NULL source is a source of its own; rows that repeat are ranked
    one by one; an empty table gives an empty result.  ``boost`` scales a
    document's inclusion probability before it is clipped below 1.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c not in new]
    size = common.words_of(F.col("text")) if size is None else size
    base = docs.withColumn("__size", size).select(*[F.col(f"`{c}`") for c in kept], F.col("__size").alias("size"))
    slim = common.stored(base.groupBy("source").agg(F.sum("size").alias("size")), "mix-sources")
    per = targets(slim, share, weights, ceiling)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = (
        per.withColumn("__sure", F.floor(ratio).cast("long"))
        .withColumn("__p", ratio - F.floor(ratio))
        .withColumn("__open", F.col("target") - F.col("__sure") * F.col("source_size"))
        .withColumnRenamed("source", "__source")
    )
    per = common.stored(per.drop("docs"), "mix-targets")
    full = base.join(per, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    p = F.col("__p") if boost is None else F.least(F.col("__p") * boost, F.lit(1.0 - 1e-9))
    u = common.unit_hash(F.col("doc_id"), F.lit(seed))
    rank = (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))
    full = full.withColumn("__rank", F.when(p > 0, rank))
    full = full.withColumn("__slice", F.floor(F.log("__rank") * SLICES).cast("long"))
    sums = full.filter(F.col("__slice").isNotNull()).groupBy("source", "__slice").agg(
        F.sum("size").alias("__words"), F.max("__open").alias("__need")
    )
    upto = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__words").over(upto), F.lit(0)))
    border = sums.filter(
        (F.col("__before") <= F.col("__need")) & (F.col("__before") + F.col("__words") > F.col("__need"))
    ).groupBy("source").agg(F.min_by("__before", "__slice").alias("__before"), F.min("__slice").alias("__border"))
    border = common.stored(border.withColumnRenamed("source", "__source"), "mix-borders")
    full = full.join(border, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    inside = F.col("__slice") == F.col("__border")
    cut = Window.partitionBy("source").orderBy("__rank", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    at = full.filter(inside).withColumn("__sum", F.col("__before") + F.sum("size").over(cut))
    at = at.withColumn("__in", F.col("__sum") - F.col("size") / 2.0 <= F.col("__open"))
    rest = full.filter(~F.coalesce(inside, F.lit(False))).withColumn(
        "__in",
        F.col("__slice").isNotNull() & (F.col("__border").isNull() | (F.col("__slice") < F.col("__border"))),
    )
    both = rest.unionByName(at.drop("__sum"))
    copies = F.col("__sure") + F.when(F.col("__in"), 1).otherwise(0)
    return both.select(
        *[F.col(f"`{c}`") for c in kept],
        "size",
        "source_size",
        "target",
        copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def repeated(mixed: DataFrame, columns) -> DataFrame:
    """The mix as documents: each row as often as it was taken."""
    times = F.array_repeat(F.lit(1), F.col("copies").cast("int"))
    return mixed.filter(F.col("copies") > 0).withColumn("__t", F.explode(times)).select(
        *[F.col(f"`{c}`") for c in columns]
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", common.words_of(F.col("text")).alias("words"))
    slim = common.stored(sized, "mix-sizes")
    return mix(slim, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || 'mix'), 1, 13))::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n, 2.0::DOUBLE * source_size AS cap FROM s),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS w,
             1.5::DOUBLE * sum(source_size) OVER () AS total FROM n),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min(struct_pack(r := cap / w, n := n, level := level)).level AS level FROM l WHERE cap / w >= level),
t AS (SELECT l.source, source_size, least(cap, coalesce(f.level * w, cap)) AS target FROM l, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t),
e AS (SELECT d.doc_id, d.size, r.source_size, r.target, floor(ratio)::BIGINT AS sure, ratio - floor(ratio) AS p, u, d.source
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0 - u)) / (p / (1.0 - p)) END AS rank FROM e),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, size, source_size, target,
       ((sure + CASE WHEN p > 0 AND upto - size / 2.0::DOUBLE <= target - sure * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""
