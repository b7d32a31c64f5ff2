"""Solver logs: from lines to Newton rows, solves and per-log summaries.

Lines are (log, line_number, line).  The table state, the active labels and
the solve number are running results over the lines of a log; every step is a
chunked window, so one very long log does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import logtext
from ..functions.scores import percent_change
from ..session import checkpointed
from . import ordered

HEADER_LOOKAHEAD = 20


def sessions(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk,
    label: str,
    counter: str,
    name: str = "session",
) -> DataFrame:
    """Number the runs of each key: a new one starts when ``label`` changes or
    ``counter`` does not increase."""
    stepped = ordered.previous(rows, keys, order, chunk, {"__label": label, "__counter": counter})
    fresh = (
        F.col("__counter").isNull()
        | ~F.col(label).eqNullSafe(F.col("__label"))
        | (F.col(counter) <= F.col("__counter"))
    )
    flagged = stepped.withColumn("__new", F.when(fresh, 1).otherwise(0).cast("long"))
    return ordered.running(flagged, keys, order, chunk, {name: F.col("__new")}).drop("__label", "__counter", "__new")


def classified(lines: DataFrame, frequency_regex: str | None = None, power_regex: str | None = None) -> DataFrame:
    """Lines with their kind, labels and parsed Newton row (no state yet)."""
    text = F.rtrim(F.regexp_replace("line", "\u0000", ""))
    data = lines.select("log", "line_number", text.alias("line"))
    blank = (F.trim("line") == "") | F.rlike("line", F.lit(logtext.SEPARATOR))
    kind = (
        F.when(F.rlike("line", F.lit(logtext.KRYLOV_TITLE)), "krylov")
        .when(F.rlike("line", F.lit(logtext.NEWTON_TITLE)) | F.rlike("line", F.lit(logtext.NEWTON_COLUMNS)), "newton")
        .when(blank, "blank")
        .when(F.col("row").isNotNull(), "row")
        .otherwise("text")
    )
    return (
        data.withColumn("frequency", logtext.line_frequency(F.col("line"), frequency_regex))
        .withColumn("power", logtext.line_power(F.col("line"), power_regex))
        .withColumn("row", logtext.newton_row(F.col("line")))
        .withColumn("kind", kind)
    )


def newton_rows(lines: DataFrame, **patterns) -> DataFrame:
    """Rows inside Newton tables with active labels and ``solve_index``.

    A table is open from its header until a Krylov header, or a text line after
    a row, or more than 20 text lines before the first row.  Blank and
    separator lines change nothing.
    """
    return _solved(lines, **patterns).where("in_table_row").select(
        "log",
        "solve_index",
        "line_number",
        "row.*",
        "frequency_hz",
        "frequency_text",
        "input_power_dbm",
        "input_power_text",
    )


def _solved(lines: DataFrame, **patterns) -> DataFrame:
    """Lines that matter (rows, labels, messages) with table state, active
    labels and the solve that is current at the line."""
    chunk = ordered.index_chunk(F.col("line_number"))
    keys, order = ["log"], ["line_number"]
    told = logtext.any_of(F.col("line"), (logtext.FAILURE, logtext.RETRY))
    # Parsing is the costly part: it runs once, then every window reads the result.
    parsed = checkpointed(
        classified(lines, **patterns)
        .withColumn("told", told)
        .withColumn("line", F.when(F.col("told"), F.col("line")))
    )
    data = ordered.running(
        parsed, keys, order, chunk, {"__text": F.when(F.col("kind") == "text", 1).otherwise(0).cast("long")}
    )
    header = F.struct("kind", F.col("__text").alias("text"), "line_number")
    data = data.withColumn("__event", F.when(F.col("kind").isin("krylov", "newton"), header))
    data = ordered.forward_fill(
        data, keys, order, chunk, {"event": "__event", "active_frequency": "frequency", "active_power": "power"}
    )
    inside = F.coalesce(F.col("event.kind") == "newton", F.lit(False))
    data = checkpointed(
        data.withColumn("__inside", inside)
        .withColumn("__waited", F.col("__text") - F.col("event.text"))
        .withColumn("__candidate", (F.col("kind") == "row") & inside)
        .withColumn("__header", F.col("event.line_number"))
        .where("__candidate OR told OR frequency IS NOT NULL OR power IS NOT NULL")
    )
    firsts = (
        data.where("__candidate")
        .groupBy("log", "__header")
        .agg(F.min("line_number").alias("__first_row"), F.min("__waited").alias("__first_waited"))
    )
    data = data.join(firsts, ["log", "__header"], "left")
    # A text line after the first row closes the table; too long a header does as well.
    accepted = (
        F.col("__candidate") & (F.col("__first_waited") <= HEADER_LOOKAHEAD) & (F.col("__waited") == F.col("__first_waited"))
    )
    # Text of an open table before its first row belongs to the header.
    header_text = (
        (F.col("kind") == "text")
        & F.col("__inside")
        & (F.col("__waited") <= HEADER_LOOKAHEAD)
        & (F.col("__first_row").isNull() | (F.col("line_number") < F.col("__first_row")))
    )
    data = checkpointed(
        data.withColumn("in_table_row", F.coalesce(accepted, F.lit(False))).withColumn(
            "quiet", F.col("kind").isin("krylov", "newton") | F.coalesce(header_text, F.lit(False))
        )
    )
    # A changed label ends the current solve, even when it changes back later.
    kind = data.schema["row"].dataType
    events = data.where("in_table_row").select("log", "line_number", "row", F.lit(0).cast("long").alias("__switch"))
    for label in ("frequency", "power"):
        values = data.where(f"{label} IS NOT NULL").select("log", "line_number", F.col(label)["value"].alias("__v"))
        changed = ordered.previous(values, keys, order, chunk, {"__old": "__v"}).where("NOT (__old <=> __v)")
        events = events.unionByName(
            changed.select("log", "line_number", F.lit(None).cast(kind).alias("row"), F.lit(1).cast("long").alias("__switch"))
        )
    events = events.withColumn("__tie", F.when(F.col("row").isNull(), 0).otherwise(1))
    counted = checkpointed(
        ordered.running(events, keys, ["line_number", "__tie"], chunk, {"__state": F.col("__switch")})
    )
    solved = sessions(
        counted.where("row IS NOT NULL").withColumn("__iteration", F.col("row.iteration")),
        keys, order, chunk, "__state", "__iteration", "solve_index",
    ).select("log", "line_number", "solve_index", F.col("__state").alias("__row_state"))
    switches = counted.where("row IS NULL").groupBy("log", "line_number").agg(F.max("__state").alias("__switched"))
    out = data.join(solved, ["log", "line_number"], "left").join(switches, ["log", "line_number"], "left")
    out = ordered.forward_fill(
        checkpointed(out), keys, order, chunk,
        {"__solve": "solve_index", "__solve_state": "__row_state", "__now": "__switched"},
    )
    current = F.col("__solve").isNotNull() & (F.coalesce("__now", F.lit(0)) <= F.col("__solve_state"))
    return out.select(
        "log",
        "line_number",
        "line",
        "row",
        "told",
        "in_table_row",
        "quiet",
        F.when(current, F.col("__solve")).alias("solve_index"),
        F.col("active_frequency.value").alias("frequency_hz"),
        F.col("active_frequency.text").alias("frequency_text"),
        F.col("active_power.value").alias("input_power_dbm"),
        F.col("active_power.text").alias("input_power_text"),
    )


def messages(solved: DataFrame) -> DataFrame:
    """Failure and retry lines with the solve they belong to (NULL: unassigned)."""
    text = solved.where(F.col("told") & ~F.col("quiet") & ~F.col("in_table_row"))
    pairs = F.array(
        F.when(F.rlike("line", F.lit(logtext.FAILURE)), F.lit("failure")),
        F.when(F.rlike("line", F.lit(logtext.RETRY)), F.lit("retry")),
    )
    return text.select(
        "log", "line_number", "solve_index", F.trim("line").alias("message"), F.explode(F.array_compact(pairs)).alias("message_kind")
    )


def solve_summary(rows: DataFrame, messages_: DataFrame | None = None, keys: Sequence[str] = ("log", "solve_index")) -> DataFrame:
    """One row per solve from its Newton rows (and messages)."""
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("newton_iterations"),
        F.min_by("iteration", "line_number").alias("first_newton_iteration"),
        F.max_by("iteration", "line_number").alias("last_newton_iteration"),
        F.sum("krylov_iterations").alias("total_krylov_iterations"),
        F.avg("krylov_iterations").alias("mean_krylov_per_newton"),
        F.max("krylov_iterations").alias("max_krylov_in_newton_step"),
        F.max_by("kcl_residual_a", "line_number").alias("final_kcl_residual_a"),
        F.max_by("krylov_residual", "line_number").alias("final_krylov_residual"),
        F.count_if("rebuilt").alias("jacobian_rebuild_rows"),
        F.min("line_number").alias("start_line"),
        F.max("line_number").alias("end_line"),
        *[
            F.min_by(c, "line_number").alias(c)
            for c in ("frequency_hz", "frequency_text", "input_power_dbm", "input_power_text")
            if c in rows.columns
        ],
    )
    if messages_ is None:
        return sums
    notes = messages_.where("solve_index IS NOT NULL").groupBy(*keys).agg(
        F.count_if(F.col("message_kind") == "failure").alias("warning_count"),
        F.count_if(F.col("message_kind") == "retry").alias("retry_message_count"),
        F.max("line_number").alias("__last"),
    )
    out = sums.join(notes, list(keys), "left").withColumn("end_line", F.greatest("end_line", "__last")).drop("__last")
    return out.fillna(0, ["warning_count", "retry_message_count"]).withColumn(
        "failure_detected", F.col("warning_count") > 0
    )


def log_summary(solves: DataFrame, timing: DataFrame | None = None, by: Sequence[str] = ("log",)) -> DataFrame:
    """Per-log totals; p95 is the nearest rank, the worst solve the first maximum."""
    work = F.col("total_krylov_iterations")
    out = solves.groupBy(*by).agg(
        F.count("*").alias("solve_count"),
        F.sum("newton_iterations").alias("total_newton_iterations"),
        F.sum(work).alias("total_krylov_iterations"),
        F.avg("newton_iterations").alias("mean_newton_per_solve"),
        F.avg(work).alias("mean_krylov_per_solve"),
        F.max(work).alias("max_krylov_per_solve"),
        F.min_by("solve_index", F.struct(-work, F.col("solve_index"))).alias("max_krylov_solve_index"),
    )
    out = ordered.with_percentiles(out, solves, by, work, {"median_krylov_per_solve": 0.5}, {"p95_krylov_per_solve": 0.95})
    out = out.withColumn("p95_krylov_per_solve", F.col("p95_krylov_per_solve").cast("long"))
    out = out.withColumn(
        "mean_krylov_per_newton", F.try_divide(F.col("total_krylov_iterations"), F.col("total_newton_iterations"))
    )
    if timing is None:
        return out
    out = out.join(timing, list(by), "left")
    for name in ("wall_clock", "simulation_stopwatch", "cpu_time"):
        out = out.withColumn(f"{name}_per_solve_seconds", F.col(f"{name}_seconds") / F.col("solve_count"))
    return out


def run_timing(lines: DataFrame) -> DataFrame:
    """Per log, the best-scored timing of each kind; the later line wins a tie."""
    samples = lines.select("log", "line_number", F.explode(logtext.timing_samples(F.col("line"))).alias("s"))
    good = samples.where(F.col("s.score") >= logtext.TIMING_ACCEPT)
    order = F.struct(F.col("s.score"), F.col("line_number"))
    seconds = F.col("s.seconds")
    return good.groupBy("log").agg(
        *[
            F.max_by(seconds, F.when(F.col("s.kind") == kind, order)).alias(name)
            for kind, name in (
                ("wall", "wall_clock_seconds"),
                ("cpu", "cpu_time_seconds"),
                ("simulation_stopwatch", "simulation_stopwatch_seconds"),
            )
        ]
    )


def parse_logs(lines: DataFrame, **patterns) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(newton rows, solves, messages) of all logs."""
    solved = checkpointed(_solved(lines, **patterns))
    rows = solved.where("in_table_row").select(
        "log", "solve_index", "line_number", "row.*", "frequency_hz", "frequency_text", "input_power_dbm", "input_power_text"
    )
    notes = messages(solved)
    return rows, solve_summary(rows, notes), notes


def frequency_summary(solves: DataFrame, by: Sequence[str] = ("log", "frequency_hz")) -> DataFrame:
    return solves.where(F.col(by[-1]).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("solves"),
        F.sum("newton_iterations").alias("newton_iterations"),
        F.sum("total_krylov_iterations").alias("krylov_iterations"),
        F.avg("total_krylov_iterations").alias("krylov_per_solve"),
    )


def against_first(summaries: DataFrame, order: str, measures: Sequence[str], count: str = "solve_count") -> DataFrame:
    """Percent change of each measure against the first log, and the solve-count difference."""
    first = summaries.orderBy(order).limit(1).select(
        *[F.col(m).alias(f"__b_{m}") for m in measures], F.col(count).alias("__b_count")
    )
    joined = summaries.crossJoin(F.broadcast(first))  # one row
    return joined.select(
        *summaries.columns,
        *[percent_change(F.col(m).cast("double"), F.col(f"__b_{m}").cast("double")).alias(f"{m}_change_pct") for m in measures],
        (F.col(count) - F.col("__b_count")).alias("solve_count_difference"),
    )


def heaviest_solves(solves: DataFrame, count: int = 12, ties: Sequence[str] = ("log", "solve_index")) -> DataFrame:
    """Solves with most Krylov work over all logs (bounded top-k)."""
    return solves.orderBy(F.col("total_krylov_iterations").desc(), *ties).limit(count)


def message_table(messages_: DataFrame) -> DataFrame:
    """Messages of solves followed by the unassigned ones."""
    assigned = messages_.where("solve_index IS NOT NULL").withColumn("scope", F.lit("solve"))
    return assigned.unionByName(messages_.where("solve_index IS NULL").withColumn("scope", F.lit("unassigned")))
