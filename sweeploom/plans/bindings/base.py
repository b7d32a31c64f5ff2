"""Registry of the queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(value: Column | str, places: int = 6) -> Column:
    return F.round(value, places)


# One row per (order, line number); the tables repeat some pairs.
SAMPLES_SQL = """
samples AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS rn
    FROM lineitem) WHERE rn = 1)"""


def samples(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """First row of each (order, line number) by a full tie-break; only the
    needed columns are read."""
    ties = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    keys = ["l_orderkey", "l_linenumber"]
    data = table(spark, folder, "lineitem").select(*keys, *ties, *[c for c in columns if c not in keys + ties])
    rest = [*ties, *[c for c in data.columns if c not in keys + ties]]
    best = data.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("b"))
    return best.select(*keys, "b.*")


# The same rows as two-port sweeps: order = block, line number = frequency.
RESPONSE_SQL = SAMPLES_SQL + """,
response AS (
  SELECT l_orderkey AS record_id, l_linenumber - 1 AS freq_idx, (l_linenumber - 1) * 1e9 AS freq_hz, 'S11' AS label,
         l_discount AS re, l_tax AS im, l_linestatus FROM samples
  UNION ALL SELECT l_orderkey, l_linenumber - 1, (l_linenumber - 1) * 1e9, 'S12', l_quantity / 48.0, l_tax, l_linestatus FROM samples
  UNION ALL SELECT l_orderkey, l_linenumber - 1, (l_linenumber - 1) * 1e9, 'S21', l_quantity / 49.0, l_discount, l_linestatus FROM samples
  UNION ALL SELECT l_orderkey, l_linenumber - 1, (l_linenumber - 1) * 1e9, 'S22', l_tax, l_discount, l_linestatus FROM samples)"""


def response(spark: SparkSession, folder: str, *keep: str, rows: DataFrame | None = None) -> DataFrame:
    """Four labelled rows a sample; ``keep`` names columns of lineitem that stay.
    ``rows``: stored result of :func:`samples`, when there is one."""
    s = samples(spark, folder, "l_linestatus") if rows is None else rows
    q = F.col("l_quantity")
    entries = F.array(
        *[
            F.struct(F.lit(label).alias("label"), re.alias("re"), im.alias("im"))
            for label, re, im in (
                ("S11", F.col("l_discount"), F.col("l_tax")),
                ("S12", q / 48.0, F.col("l_tax")),
                ("S21", q / 49.0, F.col("l_discount")),
                ("S22", F.col("l_tax"), F.col("l_discount")),
            )
        ]
    )
    return s.select(
        F.col("l_orderkey").alias("record_id"),
        F.col("l_orderkey").alias("ordinal"),
        (F.col("l_linenumber") - 1).alias("freq_idx"),
        ((F.col("l_linenumber") - 1) * F.lit(1e9)).alias("freq_hz"),
        "l_linestatus",
        *keep,
        F.explode(entries).alias("e"),
    ).select("record_id", "ordinal", "freq_idx", "freq_hz", "l_linestatus", *keep, "e.*")


def two_port(spark: SparkSession, folder: str, *more: Column) -> DataFrame:
    """One matrix per sample, built column-wise without exploding; ``more`` columns come from the same row."""
    s = samples(spark, folder)
    q = F.col("l_quantity")
    return s.select(
        F.col("l_orderkey").alias("record_id"),
        (F.col("l_linenumber") - 1).alias("freq_idx"),
        ((F.col("l_linenumber") - 1) * F.lit(1e9)).alias("freq_hz"),
        F.lit(2).alias("ports"),
        F.array(
            F.col("l_discount"), q / 48.0, q / 49.0, F.col("l_tax"),
            F.col("l_tax"), F.col("l_tax"), F.col("l_discount"), F.col("l_discount"),
        ).alias("matrix"),
        *more,
    )


# Largest singular value of the 2x2 matrices above.
SIGMA_SQL = SAMPLES_SQL + """,
m AS (
  SELECT l_orderkey AS record_id, l_linenumber - 1 AS freq_idx, (l_linenumber - 1) * 1e9 AS freq_hz,
         l_discount AS ar, l_tax AS ai, l_quantity / 48.0 AS br, l_tax AS bi,
         l_quantity / 49.0 AS cr, l_discount AS ci, l_tax AS dr, l_discount AS di FROM samples),
sigma AS (
  SELECT record_id, freq_idx, freq_hz,
    sqrt((ar*ar+ai*ai+br*br+bi*bi+cr*cr+ci*ci+dr*dr+di*di
      + sqrt(power(ar*ar+ai*ai+cr*cr+ci*ci-br*br-bi*bi-dr*dr-di*di, 2)
        + 4 * (power(ar*br+ai*bi+cr*dr+ci*di, 2) + power(ar*bi-ai*br+cr*di-ci*dr, 2)))) / 2) AS s,
    sqrt(power(br-cr, 2) + power(bi-ci, 2)) AS recip
  FROM m)"""
