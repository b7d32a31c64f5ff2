"""Recovered settings: recursive scan of artifacts and extraction per kind."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Artifact name patterns and the confidence of what they state.
PATTERNS = {
    "document": "*.json",
    "trial_table": "*_sweep_results.csv",
    "summary": "*_summary.md",
    "report": "*_report.md",
}
PRIORITY = {
    "options": 100,
    "command": 60,
    "additional_points": 45,
    "best_config": 50,
    "trial_table": 40,
    "generated_points": 35,
    "log_report": 35,
    "model_metadata": 30,
    "audit_summary": 30,
    "parameter_names": 20,
}


def scan(spark: SparkSession, root: str, patterns: Sequence[str] = tuple(PATTERNS.values())) -> DataFrame:
    """``path, mtime, text`` of matching files in all folders below ``root``."""
    parts = [
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", p).load(root)
        for p in patterns
    ]
    files = reduce(DataFrame.unionByName, parts).dropDuplicates(["path"])
    return files.select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def extract(
    files: DataFrame, where: Column, base: Sequence[str], fields: dict[str, str], priority: int
) -> DataFrame:
    """Setting rows of one kind of document: ``fields`` maps setting to JSON path.

    Arrays of scalars become comma lists; objects stay JSON.
    """
    values = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.get_json_object("text", "$." + path).alias("v"))
            for k, path in fields.items()
        ]
    )
    rows = files.where(where).select("path", "mtime", F.explode(values).alias("s")).where("s.v IS NOT NULL")
    listed = F.from_json("s.v", "array<string>")
    is_list = F.col("s.v").startswith("[")
    return rows.select(
        F.array(*[F.lit(b) for b in base], F.col("s.k")).alias("path"),
        F.when(is_list, F.array_join(listed, ",")).otherwise(F.col("s.v")).alias("value"),
        F.col("path").alias("source"),
        F.lit(priority).alias("priority"),
        "mtime",
    )


def settings(files: DataFrame) -> DataFrame:
    """All settings the documents state, as path, value, source, priority, mtime."""
    kind = F.get_json_object("text", "$.generation_kind")
    model = F.get_json_object("text", "$.model_type")
    generated = extract(
        files,
        kind.isin("generated", "range_extension"),
        ["workflows", "points", "commands", "generate"],
        {"count": "point_count", "method": "method", "split_var": "split_var", "decimal_places": "decimal_places", "seed": "seed"},
        PRIORITY["generated_points"],
    )
    additional = extract(
        files,
        kind.isNotNull() & ~kind.isin("generated", "range_extension"),
        ["workflows", "points", "commands", "suggest-additional"],
        {
            "metric": "analysis_metric",
            "acquisition": "acquisition_method",
            "candidate_method": "candidate_method",
            "decimal_places": "decimal_places",
        },
        PRIORITY["additional_points"],
    )
    fitted = extract(
        files,
        model.isNotNull(),
        ["models", "fit"],
        {
            "parameter_names": "parameter_names",
            "activation": "activation",
            "freq_transform": "freq_transform",
            "output_domain": "output_domain",
            "mode": "mode",
            "frequency_weights": "frequency_weights",
            "sparam_weights": "sparam_weights",
            "passivity_mode": "passivity_mode",
            "passivity_margin": "passivity_margin",
            "reciprocity_mode": "reciprocity_mode",
            "split_var": "split_var",
            "order": "n_poles",
            "pole_damping": "pole_damping",
            "ridge": "ridge",
        },
        PRIORITY["model_metadata"],
    )
    audited = extract(
        files,
        F.get_json_object("text", "$.verdict").isNotNull(),
        ["workflows", "audit", "commands", "audit"],
        {"parameter_names": "parameter_names", "split_var": "split_var", "bare_values": "bare_values"},
        PRIORITY["audit_summary"],
    )
    best = extract(
        files,
        F.coalesce(F.get_json_object("text", "$.config"), F.get_json_object("text", "$.best_available_config")).isNotNull(),
        ["models", "optimize"],
        {
            "hidden_layers": "config.hidden_layers",
            "activation": "config.activation",
            "learning_rate": "config.learning_rate",
            "freq_transform": "config.freq_transform",
            "mode": "config.mode",
            "selection_metric": "selection_metric",
        },
        PRIORITY["best_config"],
    )
    logs = extract(
        files,
        F.get_json_object("text", "$.summaries").startswith("["),
        ["workflows", "hb-report", "commands", "hb-report"],
        {"logs": "summaries[*].source_file", "labels": "summaries[*].model"},
        PRIORITY["log_report"],
    )
    return reduce(DataFrame.unionByName, [generated, additional, fitted, audited, best, logs])


def trial_settings(trials: DataFrame, columns: Sequence[str], source: str = "source_file", order: str = "trial", mtime: str = "mtime") -> DataFrame:
    """Values tried in a trial table, in first-seen order, as settings."""
    from ..operators.settings import distinct_in_order

    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns])
    rows = trials.select(F.col(source).alias("source"), F.col(mtime).alias("mtime"), order, F.explode(pairs).alias("s"))
    rows = rows.select("source", "mtime", order, F.col("s.k").alias("k"), F.trim("s.v").alias("v")).where("v != ''")
    listed = distinct_in_order(rows, ["source", "mtime", "k"], "v", order)
    return listed.select(
        F.array(F.lit("models"), F.lit("optimize"), "k").alias("path"),
        F.col("values_in_order").alias("value"),
        "source",
        F.lit(PRIORITY["trial_table"]).alias("priority"),
        "mtime",
    )
