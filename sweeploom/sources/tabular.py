"""CSV and JSON tables of the workflow: inventories, domains, views, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.labels import normal_key
from ..functions.units import unit_scale

DOMAIN_SCHEMA = (
    "schema_version int, geometry_file string, generation_kind string, parameters array<struct<name:string,"
    "base_unit_range:array<double>,unit:string,scale:string>>, split_counts map<string,long>, "
    "output_files struct<cumulative_all_points:struct<training_and_verification:string>>, "
    "next_gp_existing_points string, cumulative_split_files struct<combined:string>"
)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header and strings only; types are decided after unit parsing."""
    return spark.read.csv(path, header=True, inferSchema=False).select(
        "*", F.col("_metadata.file_path").alias("source_file")
    )


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def read_domain(spark: SparkSession, path: str) -> DataFrame:
    """Declared parameter ranges (SI) of metadata files, one row per parameter."""
    docs = spark.read.schema(DOMAIN_SCHEMA).json(path, multiLine=True).select(
        "*", F.col("_metadata.file_path").alias("source_file")
    )
    unit = F.coalesce(F.col("p.unit"), F.lit(""))
    return docs.select("source_file", F.posexplode("parameters").alias("ordinal", "p")).select(
        "source_file",
        "ordinal",
        F.col("p.name").alias("name"),
        normal_key(F.col("p.name")).alias("name_key"),
        F.element_at("p.base_unit_range", 1).alias("lower"),
        F.element_at("p.base_unit_range", 2).alias("upper"),
        unit.alias("unit"),
        unit_scale(F.lower(unit)).alias("unit_scale"),
        F.coalesce(F.col("p.scale"), F.lit("linear")).alias("scale"),
    )


def domain_problems(domain: DataFrame) -> DataFrame:
    """Invalid declarations: empty or inverted range, bad scale or unit, repeated name."""
    checks = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.lit("missing name")),
            F.when(~F.coalesce(F.col("upper") > F.col("lower"), F.lit(False)), F.lit("empty range")),
            F.when(~F.col("scale").isin("linear", "log"), F.lit("unknown scale")),
            F.when((F.col("scale") == "log") & (F.col("lower") <= 0), F.lit("log range must be positive")),
            F.when(F.col("unit_scale").isNull(), F.lit("unknown unit")),
        )
    )
    single = domain.select("source_file", "name", F.explode(checks).alias("problem"))
    repeated = (
        domain.groupBy("source_file", "name_key").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n > 1")
    )
    return single.unionByName(repeated.select("source_file", "name", F.lit("repeated name").alias("problem")))


def companions(tables: DataFrame, documents: DataFrame, table: str = "source_file", document: str = "source_file") -> DataFrame:
    """Tables with the document of the same folder and stem."""
    folder = lambda c: F.regexp_replace(c, r"[^/\\]+$", "")
    left = tables.select(F.col(table).alias("table_file")).distinct()
    left = left.withColumn("__d", folder(F.col("table_file"))).withColumn("__s", stem(F.col("table_file")))
    right = documents.select(F.col(document).alias("document_file")).distinct()
    right = right.withColumn("__d", folder(F.col("document_file"))).withColumn("__s", stem(F.col("document_file")))
    return left.join(right, ["__d", "__s"], "left").select("table_file", "document_file")


def inventory_pointers(spark: SparkSession, path: str) -> DataFrame:
    """Cumulative inventories named by metadata: ``source_file, ordinal, path``."""
    docs = spark.read.schema(DOMAIN_SCHEMA).json(path, multiLine=True).select(
        "*", F.col("_metadata.file_path").alias("source_file")
    )
    full = F.col("generation_kind").isin("generated", "range_extension")
    pointers = F.array(
        F.col("output_files.cumulative_all_points.training_and_verification"),
        F.col("next_gp_existing_points"),
        F.col("cumulative_split_files.combined"),
        F.when(full, F.col("geometry_file")),
    )
    return docs.select("source_file", F.posexplode(pointers).alias("ordinal", "path")).where("path IS NOT NULL")


def union_of_fields(parts: Sequence[DataFrame], preferred: Sequence[str] = ()) -> DataFrame:
    """All rows with all columns; preferred columns first."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    first = [c for c in preferred if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def write_split_views(inventory: DataFrame, path: str, split: str = "dataset") -> None:
    """One folder per split; an overwrite removes a stale view."""
    inventory.write.mode("overwrite").partitionBy(split).parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One folder per table (blocks, samples, issues, summary ...)."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_blocks(text: DataFrame, path: str) -> None:
    """Block text, one part file per task."""
    text.select("value").write.mode("overwrite").text(path)


def metadata_document(inventory: DataFrame, domain: DataFrame, key: Sequence[str], split: str, geometry_file: str) -> DataFrame:
    """One-row document with parameters, split counts and integrity counts."""
    from ..operators.inventory import split_integrity

    parameters = domain.agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct("ordinal", "name", F.array("lower", "upper").alias("base_unit_range"), "unit", "scale"))
            ),
            lambda p: F.struct(p["name"].alias("name"), p["base_unit_range"].alias("base_unit_range"), p["unit"].alias("unit"), p["scale"].alias("scale")),
        ).alias("parameters")
    )
    counts = split_integrity(inventory, key, split)
    return counts.crossJoin(F.broadcast(parameters)).select(  # one row each
        F.lit(1).alias("schema_version"),
        F.lit(geometry_file).alias("geometry_file"),
        "parameters",
        F.create_map(F.lit("train"), "train", F.lit("verification"), "verification").alias("split_counts"),
        F.struct("total", "unique_geometries", "train_verification_overlap").alias("geometry_integrity"),
    )
