"""Solver logs, one feature each: what a single line or table changes."""

import pytest

from sweeploom.operators import solverlogs

TITLE = "Newton iteration  GMRES"
COLUMNS = "Iter  Residual  Damp  Update  Iters  Residual"


def table(*rows, title=(TITLE, COLUMNS)):
    """Rows as (iteration, residual with its unit, inner iterations)."""
    return [*title, *[f"{i} {kcl} 75.0 {inner} 2.5e-4" for i, kcl, inner in rows]]


LOGS = {
    # One table, nothing else: a single solve without labels.
    "bare": table((1, "2 uA", 3), (2, "40 nA", 5)),
    # The iteration number falls back, so a new solve begins inside the table.
    "restart": table((3, "1 mA", 2), (4, "2 uA", 2), (2, "9 mA", 4), (5, "8 nA", 1)),
    # It stays the same: also a new solve.
    "stall": table((1, "1 mA", 6), (1, "1 mA", 7)),
    # Labels by other words and units; they stay until they are named again.
    "labels": ["freq[1]: 750 MHz", *table((1, "3 pA", 2)), "Pavs = 1 mW", *table((1, "5 nA", 4))],
    # A label that comes back to its value still ends the solve between.
    "there_and_back": ["Pin = 3 dBm", *table((1, "1 mA", 1)), "Pin = 4 dBm", "Pin = 3 dBm", *table((2, "1 mA", 9))],
    # The same label once more does not.
    "same_label": ["Pin = 3 dBm", *table((1, "1 mA", 1)), "Pin = 3 dBm", *table((2, "1 mA", 9))],
    # A starred row counts as one with a rebuilt matrix.
    "star": table(("1*", "1 mA", 2), (2, "1 mA", 2), ("3*", "1 mA", 2)),
    # Rows of an inner solver look alike but are none.
    "inner": [*table((1, "6 mA", 8)), "BiCGStab solver", "1 0.5", "2 0.25 1.0 90 1e-3"],
    # Text behind a row closes the table; the number line below is no row.
    "closed": [*table((1, "6 mA", 8)), "saving the operating point", "2 1 mA 50.0 90 1e-3"],
    # A blank line and a rule do not.
    "open": [*table((1, "6 mA", 8)), "", "=====", "2 1 mA 50.0 2 1e-3"],
    # A title whose columns are broken over lines.
    "broken": ["Newton-Raphson solver", "Iterations", "of the outer loop", "Residual", "4 7 uA 10.0 12 1e-2"],
    # A message between the rows of a solve belongs to it, one behind it as well.
    "messages": [*table((1, "1 mA", 1)), "did not converge", *table((2, "1 uA", 1)), "retry with continuation"],
    # Before any solve it belongs to none.
    "early": ["aborted", *table((1, "1 mA", 1))],
    "clock": ["Overall CPU time (all threads) = 2 min", "wall-clock time: 1:30"],
    "both": ["cpu/wall time: 6 s, 4.5 s"],
    "neither": ["time passes"],
}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(log, n, line) for log, text in LOGS.items() for n, line in enumerate(text, 1)]
    return spark.createDataFrame(rows, "log string, line_number long, line string").repartition(4).cache()


@pytest.fixture(scope="module")
def parsed(lines):
    _, solves, notes = solverlogs.parse_logs(lines)
    found = {}
    for r in solves.orderBy("log", "solve_index").collect():
        found.setdefault(r["log"], []).append(r)
    return found, notes.cache()


@pytest.mark.parametrize(
    "log,work",
    [
        ("bare", [8]), ("restart", [4, 5]), ("stall", [6, 7]), ("labels", [2, 4]), ("there_and_back", [1, 9]), ("same_label", [10]),
        ("star", [6]), ("inner", [8]), ("closed", [8]), ("open", [10]), ("broken", [12]), ("messages", [2]), ("early", [1]),
    ],
)
def test_inner_iterations_of_each_solve(parsed, log, work):
    assert [r["total_krylov_iterations"] for r in parsed[0][log]] == work


def test_logs_without_tables_have_no_solves(parsed):
    assert not {"clock", "both", "neither"} & parsed[0].keys()


def test_residuals_have_their_units(parsed):
    last = {log: parsed[0][log][-1]["final_kcl_residual_a"] for log in ("bare", "labels", "broken")}
    assert last == {"bare": pytest.approx(4e-8), "labels": pytest.approx(5e-9), "broken": pytest.approx(7e-6)}


def test_labels_reach_the_solves_behind_them(parsed):
    first, second = parsed[0]["labels"]
    assert (first["frequency_hz"], first["input_power_dbm"]) == (7.5e8, None)
    assert (second["frequency_hz"], second["input_power_dbm"]) == (7.5e8, pytest.approx(0.0))


def test_starred_rows_are_counted(parsed):
    assert [parsed[0][log][0]["jacobian_rebuild_rows"] for log in ("star", "bare")] == [2, 0]


def test_messages_belong_to_the_solve_around_them(parsed):
    found, notes = parsed
    assert [(r["warning_count"], r["retry_message_count"]) for r in found["messages"]] == [(1, 1)]
    assert [(r["warning_count"], r["retry_message_count"]) for r in found["early"]] == [(0, 0)]
    scopes = {(r["log"], r["message"]): r["scope"] for r in solverlogs.message_table(notes).collect()}
    assert scopes[("early", "aborted")] == "unassigned" and scopes[("messages", "did not converge")] != "unassigned"


def test_timing_lines(lines):
    timing = {r["log"]: (r["wall_clock_seconds"], r["cpu_time_seconds"]) for r in solverlogs.run_timing(lines).collect()}
    assert timing["clock"] == (90.0, 120.0) and timing["both"] == (4.5, 6.0)
    assert timing.get("neither", (None, None)) == (None, None)


def test_small_ranges_are_read_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F
    from sweeploom.sources import textlogs

    text = "".join(f"line {k}\n" for k in range(5_000))
    (tmp_path / "a.log").write_text(text)
    lines = textlogs.read_lines(spark, str(tmp_path / "a.log"), split_bytes=2_000).withColumn("task", F.spark_partition_id())
    rows = lines.orderBy("line_number").collect()
    assert [r["line"] for r in rows] == text.splitlines() and [r["line_number"] for r in rows] == list(range(1, 5_001))
    assert len({r["task"] for r in rows}) > 1  # adaptive execution would merge the short rows of ranges into one task
