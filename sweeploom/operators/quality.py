"""Per-block quality rules.  Each rule is a DataFrame of issue rows.

Inputs: ``response`` (one row per block, frequency and label) and ``block``
(one row per block).  ``ordinal`` is the source order of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.complexmath import assemble, largest_singular, largest_singular_2x2, magnitude, passivity, port_numbers
from ..functions.units import is_finite
from ..session import checkpointed
from . import ordered

# Default thresholds.
PASSIVITY_TOLERANCE = 1e-6
RECIPROCITY_TOLERANCE = 1e-3
FREQUENCY_ATOL_HZ = 1e-3

ISSUE_COLUMNS = (
    "severity string, code string, dataset_kind string, role string, source_file string, "
    "source_index int, frequency_hz double, message string"
)
BLOCK_COLUMNS = ("dataset_kind", "role", "source_file", "source_index")


def issue_rows(
    df: DataFrame, severity: str, code: str, message: Column, frequency: Column | None = None
) -> DataFrame:
    """Issue rows of the blocks in ``df``; missing block columns become NULL."""
    columns = set(df.columns)
    text = [c for c in BLOCK_COLUMNS[:3]]
    return df.select(
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        *[(F.col(c) if c in columns else F.lit(None)).cast("string").alias(c) for c in text],
        (F.col("source_index") if "source_index" in columns else F.lit(None)).cast("int").alias("source_index"),
        (frequency if frequency is not None else F.lit(None)).cast("double").alias("frequency_hz"),
        message.cast("string").alias("message"),
    )


def axis_breaks(
    samples: DataFrame,
    block: Sequence[str],
    index: str,
    axis: str,
    atol: float = FREQUENCY_ATOL_HZ,
    chunk: Column | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Rows whose axis value does not exceed the previous one by more than ``atol``."""
    chunk = ordered.index_chunk(F.col(index)) if chunk is None else chunk
    order = [index, *ties]
    stepped = ordered.previous(samples, block, order, chunk, {"previous_axis": axis})
    return stepped.where(F.col(axis) - F.col("previous_axis") <= F.lit(atol))


def grid_rows(response: DataFrame, block: Sequence[str] = ("record_id",)) -> DataFrame:
    """One row per block and frequency index (labels share the grid)."""
    return response.groupBy(*block, "freq_idx").agg(F.min("freq_hz").alias("freq_hz"))


def structure_issues(
    response: DataFrame, block: DataFrame, expected_labels: DataFrame, grid: DataFrame | None = None
) -> DataFrame:
    """Label set, length, finiteness and ordering rules.

    ``expected_labels``: one column ``label``.  ``grid``: stored result of
    :func:`grid_rows`, when there is one.
    """
    meta = block.select("record_id", *BLOCK_COLUMNS)
    per_label = response.groupBy("record_id", "label").agg(
        F.count("*").alias("rows"),
        F.count_if(~(is_finite(F.col("re")) & is_finite(F.col("im")))).alias("bad"),
    )
    per_label = checkpointed(per_label)
    if grid is None:
        grid = checkpointed(grid_rows(response))
    counts = grid.groupBy("record_id").agg(
        F.count("*").alias("grid_rows"),
        F.count_if(~is_finite(F.col("freq_hz"))).alias("bad_frequency"),
        F.count_if(F.col("freq_hz") < 0.0).alias("negative"),
    )
    # Every rule below reads these; stored once, they are not counted again by each rule.
    counts = checkpointed(counts)
    facts = counts.join(meta, "record_id")
    labelled = per_label.join(counts.select("record_id", "grid_rows"), "record_id").join(meta, "record_id")
    breaks = (
        axis_breaks(grid, ["record_id"], "freq_idx", "freq_hz")
        .groupBy("record_id")
        .agg(F.count("*").alias("breaks"))
        .join(meta, "record_id")
    )
    wrong_labels = label_differences(per_label, expected_labels).join(meta, "record_id")
    return (
        issue_rows(
            wrong_labels,
            "ERROR",
            "SPARAM_COLUMN_MISMATCH",
            F.concat(
                F.lit("missing "),
                F.array_join("missing", ","),
                F.lit("; extra "),
                F.array_join("extra", ","),
            ),
        )
        .unionByName(
            issue_rows(
                facts.where("bad_frequency > 0"),
                "ERROR",
                "NONFINITE_FREQUENCY",
                F.lit("Frequency values contain NaN or infinity."),
            )
        )
        .unionByName(
            issue_rows(
                facts.where("negative > 0"),
                "ERROR",
                "NEGATIVE_FREQUENCY",
                F.lit("Negative frequency values are not valid."),
            )
        )
        .unionByName(
            issue_rows(
                breaks,
                "ERROR",
                "NONINCREASING_FREQUENCY",
                F.lit("Frequency rows are duplicated or not strictly increasing."),
            )
        )
        .unionByName(
            issue_rows(
                labelled.where("rows != grid_rows"),
                "ERROR",
                "SPARAM_LENGTH_MISMATCH",
                F.format_string("%s has %d values for %d frequency rows.", "label", "rows", "grid_rows"),
            )
        )
        .unionByName(
            issue_rows(
                labelled.where("rows = grid_rows AND bad > 0"),
                "ERROR",
                "NONFINITE_SPARAM",
                F.concat("label", F.lit(" contains NaN or infinity.")),
            )
        )
    )


def label_differences(response: DataFrame, expected_labels: DataFrame) -> DataFrame:
    """Blocks whose label set differs from the expected one, with ``missing`` and ``extra``."""
    expected = expected_labels.agg(F.sort_array(F.collect_set("label")).alias("expected"))
    actual = response.groupBy("record_id").agg(F.sort_array(F.collect_set("label")).alias("actual"))
    both = actual.crossJoin(F.broadcast(expected))  # the right side is one row
    return both.select(
        "record_id",
        F.array_except("expected", "actual").alias("missing"),
        F.array_except("actual", "expected").alias("extra"),
    ).where("size(missing) > 0 OR size(extra) > 0")


def common_label_set(response: DataFrame) -> DataFrame:
    """The most frequent label set; the one seen first wins a tie.

    Needs ``ordinal`` on the response rows.  One row: ``labels, blocks``.
    """
    sets = response.groupBy("record_id").agg(
        F.sort_array(F.collect_set("label")).alias("labels"), F.min("ordinal").alias("ordinal")
    )
    return (
        sets.groupBy("labels")
        .agg(F.count("*").alias("blocks"), F.min("ordinal").alias("first_seen"))
        .orderBy(F.col("blocks").desc(), "first_seen")
        .limit(1)
        .select("labels", "blocks")
    )


def incomplete_matrix_issues(expected_labels: DataFrame) -> DataFrame:
    """The expected labels must be all N*N entries of an N-port."""
    port = port_numbers(F.col("label"))
    facts = expected_labels.agg(
        F.count("*").alias("labels"), F.max(F.greatest(port["row"], port["col"])).alias("ports"), F.count(port["row"]).alias("parsed")
    )
    bad = facts.where("ports IS NULL OR parsed != labels OR labels != ports * ports")
    return issue_rows(bad, "ERROR", "INCOMPLETE_SPARAM_MATRIX", F.format_string("%d labels are not a complete matrix.", "labels"))


def labels_in_every_block(response: DataFrame, block: Sequence[str] = ("record_id",), label: str = "label") -> DataFrame:
    """Labels that occur in all blocks."""
    pairs = response.select(*block, label).distinct()
    total = pairs.select(*block).distinct().agg(F.count("*").alias("blocks"))
    return (
        pairs.groupBy(label)
        .agg(F.count("*").alias("n"))
        .join(F.broadcast(total), F.col("n") == F.col("blocks"))  # one row
        .select(label)
    )


def matrices(
    response: DataFrame, keys: Sequence[str] = ("record_id", "freq_idx"), carry: Sequence[str] = ("freq_hz",)
) -> DataFrame:
    """One matrix array per sample; a group holds the N*N entries of one sample."""
    port = port_numbers(F.col("label"))
    cells = response.select(*keys, *carry, port["row"].alias("row"), port["col"].alias("col"), "re", "im").where(
        "row IS NOT NULL"
    )
    return cells.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carry],
        F.max(F.greatest("row", "col")).alias("ports"),
        assemble(F.collect_list(F.struct("row", "col", "re", "im"))).alias("matrix"),
    ).where(F.size("matrix") == 2 * F.col("ports") * F.col("ports"))


def reciprocity_error(matrix: Column, ports: Column) -> Column:
    """Largest |Mij - Mji|."""
    n2 = ports * ports
    index = F.sequence(F.lit(0), n2 - 1)
    errors = F.transform(
        index,
        lambda k: magnitude(
            F.get(matrix, k) - F.get(matrix, (k % ports) * ports + F.floor(k / ports).cast("int")),
            F.get(matrix, n2 + k) - F.get(matrix, n2 + (k % ports) * ports + F.floor(k / ports).cast("int")),
        ),
    )
    return F.array_max(errors)


def passivity_rows(samples: DataFrame, tolerance: float = PASSIVITY_TOLERANCE, two_port: bool = False) -> DataFrame:
    """Largest singular value, passivity and reciprocity of each sample matrix."""
    sigma = largest_singular_2x2(F.col("matrix")) if two_port else largest_singular(F.col("matrix"))
    return judged(samples.withColumn("max_singular_value", sigma), tolerance)


def judged(samples: DataFrame, tolerance: float = PASSIVITY_TOLERANCE) -> DataFrame:
    """Passivity and reciprocity of matrices whose largest singular value is known."""
    state = passivity(F.col("max_singular_value"), tolerance)
    return (
        samples.withColumn("passive", state["passive"])
        .withColumn("passivity_excess", state["excess"])
        .withColumn("passivity_margin_db", state["margin_db"])
        .withColumn("reciprocity_max_abs_error", reciprocity_error(F.col("matrix"), F.col("ports")))
    )


def block_summary(samples: DataFrame, block: Sequence[str] = ("record_id",)) -> DataFrame:
    """Per-block rows, frequency span, DC rows, worst sigma and its first frequency."""
    worst = F.struct(F.col("max_singular_value"), -F.col("freq_idx"))
    return samples.groupBy(*block).agg(
        F.count("*").alias("frequency_rows"),
        F.min("freq_hz").alias("minimum_frequency_hz"),
        F.max("freq_hz").alias("maximum_frequency_hz"),
        F.count_if(F.col("freq_hz") == 0.0).alias("dc_rows"),
        F.max("max_singular_value").alias("max_singular_value"),
        F.max_by("freq_hz", worst).alias("worst_passivity_frequency_hz"),
        F.count_if(~F.col("passive")).alias("passivity_violating_rows"),
        F.max("reciprocity_max_abs_error").alias("max_reciprocity_abs_error"),
    )


def passivity_summary(samples: DataFrame) -> DataFrame:
    """One row: points, violating points, largest sigma."""
    return samples.agg(
        F.count("*").alias("points"),
        F.count_if(~F.col("passive")).alias("violating_points"),
        F.max("max_singular_value").alias("max_singular_value"),
    )


def passivity_issues(
    summary: DataFrame,
    block: DataFrame,
    expect_reciprocal: bool = False,
    reciprocity_tolerance: float = RECIPROCITY_TOLERANCE,
) -> DataFrame:
    facts = summary.join(block.select("record_id", *BLOCK_COLUMNS), "record_id")
    out = issue_rows(
        facts.where("passivity_violating_rows > 0"),
        "ERROR",
        "RAW_NONPASSIVE_DATA",
        F.format_string(
            "%d frequency row(s) exceed the limit; worst sigma is %.9f at %.9g Hz.",
            "passivity_violating_rows",
            "max_singular_value",
            "worst_passivity_frequency_hz",
        ),
        F.col("worst_passivity_frequency_hz"),
    )
    if expect_reciprocal:
        out = out.unionByName(
            issue_rows(
                facts.where(F.col("max_reciprocity_abs_error") > reciprocity_tolerance),
                "ERROR",
                "RECIPROCITY_VIOLATION",
                F.format_string("Maximum |Sij-Sji| is %.6g.", "max_reciprocity_abs_error"),
            )
        )
    return out


def reciprocity_pairs(response: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sij next to Sji for i < j, without a join: both entries meet in one group."""
    port = port_numbers(F.col("label"))
    cells = response.select(
        *keys,
        F.least(port["row"], port["col"]).alias("low"),
        F.greatest(port["row"], port["col"]).alias("high"),
        (port["row"] < port["col"]).alias("upper"),
        "re",
        "im",
    ).where("low < high")
    sides = cells.groupBy(*keys, "low", "high").agg(
        *[
            F.max(F.when(F.col("upper") == side, F.col(part))).alias(f"{name}_{part}")
            for side, name in ((True, "forward"), (False, "reverse"))
            for part in ("re", "im")
        ]
    )
    return sides.withColumn(
        "abs_error",
        magnitude(F.col("forward_re") - F.col("reverse_re"), F.col("forward_im") - F.col("reverse_im")),
    )


def reciprocity_summary(pairs: DataFrame) -> DataFrame:
    """Largest absolute and relative disagreement over all pairs."""
    reference = F.greatest(
        magnitude(F.col("forward_re"), F.col("forward_im")), magnitude(F.col("reverse_re"), F.col("reverse_im"))
    )
    return pairs.agg(F.max("abs_error").alias("max_abs_error"), F.max(reference).alias("reference")).select(
        "max_abs_error",
        (F.col("max_abs_error") / F.greatest("reference", F.lit(1e-12))).alias("relative_error"),
    )


def reciprocal_projection(response: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace Sij and Sji by their mean.  Both land in one group of two rows."""
    port = port_numbers(F.col("label"))
    tagged = response.withColumn("__low", F.least(port["row"], port["col"])).withColumn(
        "__high", F.greatest(port["row"], port["col"])
    )
    means = tagged.groupBy(*keys, "__low", "__high").agg(
        F.avg("re").alias("re"), F.avg("im").alias("im"), F.collect_set("label").alias("labels")
    )
    return means.select(*keys, F.explode("labels").alias("label"), "re", "im")


def impedance_issues(block: DataFrame) -> DataFrame:
    """Distinct and missing reference impedances over the audited blocks."""
    facts = block.agg(
        F.count_distinct("reference_impedance_ohm").alias("values"),
        F.count_if(F.col("reference_impedance_ohm").isNull()).alias("missing"),
    )
    return issue_rows(
        facts.where("values > 1"),
        "ERROR",
        "INCONSISTENT_REFERENCE_IMPEDANCE",
        F.format_string("%d different reference impedances.", "values"),
    ).unionByName(
        issue_rows(
            facts.where("missing > 0"),
            "WARNING",
            "MISSING_REFERENCE_IMPEDANCE",
            F.format_string("%d block(s) without a reference impedance.", "missing"),
        )
    )


def parameter_issues(resolved: DataFrame, block: DataFrame) -> DataFrame:
    """Blocks with a missing, non-numeric or non-finite parameter.

    ``resolved``: one row per block and required parameter, ``value`` in SI.
    """
    bad = (
        resolved.groupBy("record_id")
        .agg(F.count_if(~is_finite(F.col("value"))).alias("bad"))
        .where("bad > 0")
        .join(block.select("record_id", *BLOCK_COLUMNS), "record_id")
    )
    return issue_rows(
        bad,
        "ERROR",
        "INVALID_PARAMETER_VALUE",
        F.lit("One or more required geometry parameters are missing, nonnumeric, or nonfinite."),
    )


def role_issues(block: DataFrame, random_holdout: bool = False) -> DataFrame:
    """Split rules: unassigned blocks, no training, no verification."""
    facts = block.agg(
        F.count_if(F.col("role") == "unassigned").alias("unassigned"),
        F.count_if((F.col("dataset_kind") == "fine") & (F.col("role") == "train")).alias("train"),
        F.count_if((F.col("dataset_kind") == "fine") & (F.col("role") == "verification")).alias("verification"),
    )
    out = issue_rows(
        facts.where("unassigned > 0"),
        "ERROR",
        "UNASSIGNED_BLOCKS",
        F.format_string("%d block(s) have no recognized role.", "unassigned"),
    )
    for rule, severity, code, text in (
        ("train = 0", "ERROR", "NO_TRAINING_BLOCKS", "No fine training blocks."),
        ("verification = 0", "WARNING", "NO_VERIFICATION_BLOCKS", "No fine verification blocks."),
    ):
        out = out.unionByName(issue_rows(facts.where(rule), severity, code, F.lit(text)))
    if random_holdout:
        out = out.unionByName(
            issue_rows(
                facts, "WARNING", "RANDOM_HOLDOUT_USED", F.lit("No explicit training label; a random hold-out was used.")
            )
        )
    return out


def severity_rank() -> Column:
    return F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)


# What to do about a code; others get the last line.
ADVICE = {
    "SPARAM_COLUMN_MISMATCH": "Export the named blocks again with the same matrix entries as the others.",
    "SPARAM_LENGTH_MISMATCH": "Give every entry of the block one value for each frequency.",
    "INCOMPLETE_SPARAM_MATRIX": "Add the entries that are missing so that every port pair has one.",
    "INVALID_PARAMETER_VALUE": "Write a finite number for every audited parameter of the block.",
    "NONFINITE_FREQUENCY": "Remove or repair the frequency rows without a finite value.",
    "NEGATIVE_FREQUENCY": "Remove the rows below zero Hz or correct their sign.",
    "NONINCREASING_FREQUENCY": "Sort the rows of the block and keep one row for each frequency.",
    "NONFINITE_SPARAM": "Remove or simulate again the rows with NaN or infinite entries.",
    "RAW_NONPASSIVE_DATA": "Check ports and reference impedance; simulate again what still amplifies.",
    "RECIPROCITY_VIOLATION": "Check the port order, or say that the device is not reciprocal.",
    "TRAIN_VERIFICATION_OVERLAP": "Leave each geometry in one split only.",
    "DUPLICATE_GEOMETRY": "Keep one block of each geometry, or name what makes them differ.",
    "DUPLICATE_GEOMETRY_GRID_MISMATCH": "Bring blocks of one geometry to the same frequencies and entries.",
    "DUPLICATE_GEOMETRY_RESPONSE_CONFLICT": "Find out which block of the geometry is right and drop the others.",
    "NEIGHBOR_RESPONSE_OUTLIER": "Look at both neighbours; one of them is likely mislabelled or not converged.",
    "VERIFICATION_OUTSIDE_GEOMETRY_RANGE": "Move the verification point into the declared range, or widen the range.",
    "VERIFICATION_OUTSIDE_TRAIN_RANGE": "Add training points around the verification point.",
    "FINE_OUTSIDE_COARSE_TRAIN_RANGE": "Add coarse blocks that cover the fine ones.",
    "INCONSISTENT_FREQUENCY_GRIDS": "Use one frequency grid for all blocks, or accept the interpolation.",
    "INCONSISTENT_REFERENCE_IMPEDANCE": "Renormalise all blocks to one reference impedance.",
    "MISSING_REFERENCE_IMPEDANCE": "State the reference impedance in the header of the blocks.",
    "UNASSIGNED_BLOCKS": "Label the blocks for training or verification.",
    "NO_TRAINING_BLOCKS": "Label fine blocks for training.",
    "NO_VERIFICATION_BLOCKS": "Label some fine blocks for verification.",
    "RANDOM_HOLDOUT_USED": "Label the splits, so that every run judges the same blocks.",
}
OTHER_ADVICE = "Correct the listed blocks, or accept the condition on purpose."


def advice(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.lit(OTHER_ADVICE))


def location(issues: DataFrame) -> Column:
    """Where an issue is: kind and role, file name, block and frequency, as far as they are known; NULL if nothing is."""

    def text(name: str) -> Column:
        value = F.col(name) if name in issues.columns else F.lit(None)
        return F.nullif(value.cast("string"), F.lit(""))

    frequency = F.col("frequency_hz").cast("double") if "frequency_hz" in issues.columns else F.lit(None).cast("double")
    whole = (frequency == F.floor(frequency)) & (F.abs(frequency) < 1e15)
    written = F.when(whole, frequency.cast("long").cast("string")).otherwise(frequency.cast("string"))
    parts = F.concat_ws(
        ", ",
        F.nullif(F.concat_ws("/", text("dataset_kind"), text("role")), F.lit("")),
        F.substring_index(text("source_file"), "/", -1),
        F.concat(F.lit("block "), text("source_index")),
        F.concat(written, F.lit(" Hz")),
    )
    return F.nullif(parts, F.lit(""))


def first_distinct(rows: DataFrame, keys: Sequence[str], value: str, order: str, shown: int, name: str) -> DataFrame:
    """Per key the ``shown`` first different values in ``order`` (array ``name``) and how many more there are.

    Values are reduced to their first place before grouping, and each task keeps
    its ``shown`` earliest, so no group collects all its rows.
    """
    from pyspark.sql import Window

    seen = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("__first"))
    counts = seen.groupBy(*keys).agg(F.count("*").alias("__n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__first", value))
    top = seen.withColumn("__rank", rank).where(F.col("__rank") <= shown)
    lists = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__rank", value))).alias("__l"))
    both = lists.join(counts, keys)
    return both.select(
        *keys, F.transform("__l", lambda m: m[value]).alias(name), F.greatest(F.lit(0), F.col("__n") - shown).alias(f"additional_{name}")
    )


def issue_reasons(issues: DataFrame, ordinal: str = "ordinal", shown: int = 5) -> DataFrame:
    """Issues by severity and code: the first different messages and places, how many more, and what to do.

    ``ordinal`` is any column in whose order the issues count, over all files.
    """
    keys = ["severity", "code"]
    placed = issues.select(
        *keys, F.col(ordinal).alias("__order"), F.coalesce("message", F.lit("No explanation was given.")).alias("message"), location(issues).alias("place")
    )
    totals = placed.groupBy(*keys).agg(F.count("*").alias("count"))
    messages = first_distinct(placed, keys, "message", "__order", shown, "message")
    places = first_distinct(placed, keys, "place", "__order", shown, "place")
    return (
        totals.join(messages, keys)
        .join(places, keys, "left")
        .select(
            *keys,
            "count",
            F.col("message")[0].alias("reason"),
            F.col("message").alias("representative_messages"),
            F.coalesce("place", F.array().cast("array<string>")).alias("affected_examples"),
            F.col("additional_message").alias("additional_message_count"),
            F.coalesce("additional_place", F.lit(0)).cast("long").alias("additional_location_count"),
            advice(F.col("code")).alias("recommendation"),
        )
        .orderBy(severity_rank(), "code")
    )


def verdict(issues: DataFrame) -> DataFrame:
    """One row: error and warning counts and FAIL, WARNING or PASS."""
    counts = issues.agg(
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
    )
    return counts.select(
        "errors",
        "warnings",
        F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARNING").otherwise("PASS").alias("verdict"),
    )


def worst_samples(samples: DataFrame, count: int = 20) -> DataFrame:
    """Largest violations first (bounded top-k)."""
    return (
        samples.where(~F.col("passive"))
        .orderBy(F.col("max_singular_value").desc(), "record_id", "freq_idx")
        .limit(count)
    )
