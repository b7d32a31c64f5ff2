"""Sweep files: block text with VAR lines and ACDATA tables.

A file is cut at ``END`` lines, so a file of any size is read in parallel
splits and a record is one block.  Values that stay in force for later blocks
(a VAR before BEGIN) are kept while a split is read; what earlier splits leave
is carried on by one row a split.
"""

from __future__ import annotations

import math
import re as regex

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.units import NUMBER_PATTERN, UNIT_SCALES
from ..session import broadcast_small, checkpointed, scratch

BLOCK_SCHEMA = (
    "source_file string, split long, number long, inherited map<string,string>, own map<string,string>, "
    "has_block boolean, data_format string, frequency_unit string, reference_impedance_ohm double, "
    "freq_hz array<double>, labels array<string>, re array<array<double>>, im array<array<double>>"
)
# Numbers of blocks that a task holds before it hands them on.
BATCH_VALUES = 200_000
FREQUENCY_UNITS = ("hz", "khz", "mhz", "ghz", "thz")
_NUMBER = regex.compile(rf"^({NUMBER_PATTERN})([A-Za-z]*)$")


def _number(token: str) -> float | None:
    found = _NUMBER.match(token.strip().strip("\"'"))
    if not found or found.group(2).lower() not in UNIT_SCALES:
        return None
    return float(found.group(1)) * UNIT_SCALES[found.group(2).lower()]


def _assignment(line: str) -> tuple[str, str] | None:
    if line[:3].upper() != "VAR":
        return None
    name, sign, value = line[3:].strip().partition("=")
    if not sign:
        pieces = name.split(None, 1)
        if len(pieces) < 2:
            return None
        name, value = pieces
    value = value.strip()
    if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]:
        value = value[1:-1]
    return name.strip(), value


def _columns(tokens: list[str]) -> list[str]:
    """Entry labels of a column header; ``S11R S11I`` name one entry."""
    names = []
    for token in tokens:
        bare = regex.sub(r"[^A-Za-z0-9_,]", "", token)
        pair = regex.match(r"^([A-Za-z]+\d[\d_,]*)[RrIi]$", bare)
        name = (pair.group(1) if pair else bare).upper()
        if name not in names:
            names.append(name)
    return names


def _to_pair(kind: str, a: float, b: float) -> tuple[float, float]:
    if kind == "RI":
        return a, b
    size = a if kind == "MA" else 10.0 ** (a / 20.0)
    return size * math.cos(math.radians(b)), size * math.sin(math.radians(b))


def parse_record(text: str, with_values: bool = True) -> list[dict]:
    """Blocks and sticky assignments of one record, in order.

    The tail of a record without a block keeps its assignments
    (``has_block`` false) for the blocks that follow.
    """
    out: list[dict] = []
    sticky: list[tuple[int, str, str]] = []
    block: dict | None = None

    def close():
        nonlocal block, sticky
        if block is not None:
            block["sticky"] = sticky
            out.append(block)
        block, sticky = None, []

    pending: list[float] = []
    for raw in text.splitlines():
        line = raw.split("!", 1)[0].strip()
        if not line:
            continue
        upper = line.upper()
        var = _assignment(line)
        if var:
            if block is None:
                sticky.append((len(sticky), *var))
            else:
                block["own"][var[0]] = var[1]
        elif upper.startswith("BEGIN"):
            close() if block is not None else None
            block = {"own": {}, "has_block": True, "format": "RI", "unit": "Hz", "z0": None, "freq": [], "labels": [], "re": [], "im": []}
            pending = []
        elif upper.startswith("END"):
            close()
        elif block is not None and line[0] == "#":
            tokens = line[1:].split()
            for k, token in enumerate(tokens):
                if token.lower() in FREQUENCY_UNITS:
                    block["unit"] = token
                if token.upper() in ("RI", "MA", "DB"):
                    block["format"] = token.upper()
                if token.upper() == "R" and k + 1 < len(tokens):
                    block["z0"] = _number(tokens[k + 1])
        elif block is not None and line[0] == "%":
            block["labels"] += [n for n in _columns(line[1:].split()) if n not in block["labels"] and n != "FREQ" and not n.startswith("FREQ")]
        elif block is not None and with_values:
            pending += [float(t) for t in line.split()]
            width = 1 + 2 * len(block["labels"])
            while block["labels"] and len(pending) >= width:
                row, pending = pending[:width], pending[width:]
                cells = [_to_pair(block["format"], row[1 + 2 * k], row[2 + 2 * k]) for k in range(len(block["labels"]))]
                block["freq"].append(row[0] * UNIT_SCALES[block["unit"].lower()])
                block["re"].append([c[0] for c in cells])
                block["im"].append([c[1] for c in cells])
    if block is not None:
        close()
    elif sticky:
        out.append({"own": {}, "has_block": False, "format": None, "unit": None, "z0": None, "freq": [], "labels": [], "re": [], "im": [], "sticky": sticky})
    return out


def read_records(spark: SparkSession, path: str, with_values: bool = True) -> DataFrame:
    """Parsed blocks, and one row without a block at the end of each split.

    A task meets the records of a split one after the other, so it counts the
    blocks (``number``, from 0 in the split) and keeps the assignments that stay
    in force: ``inherited`` has those made in the split before or at the block.
    The closing row has the number of blocks of the split and all its assignments.
    """
    text = spark.read.text(path, lineSep="\nEND")
    placed = text.select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split"),
    )

    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]

    def work(batches):
        import pyarrow as pa

        texts, numbers = pa.map_(pa.string(), pa.string()), pa.list_(pa.float64())
        kinds = [
            pa.string(), pa.int64(), pa.int64(), texts, texts, pa.bool_(), pa.string(), pa.string(), pa.float64(),
            numbers, pa.list_(pa.string()), pa.list_(numbers), pa.list_(numbers),
        ]
        nothing = {"own": {}, "format": None, "unit": None, "z0": None, "freq": [], "labels": [], "re": [], "im": []}
        at, number, known, held = None, 0, {}, 0
        columns: list[list] = [[] for _ in kinds]

        def add(b, has_block):
            row = (
                *at, number, tuple(known.items()), tuple(b["own"].items()), has_block, b["format"], b["unit"], b["z0"],
                b["freq"], b["labels"], b["re"], b["im"],
            )
            for column, value in zip(columns, row):
                column.append(value)

        def packed():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            for column in columns:
                column.clear()
            return made

        for batch in batches:
            for value, source, split in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= BATCH_VALUES:
                    yield packed()
                    held = 0
                if (source, split) != at:
                    if at is not None:
                        add(nothing, False)
                    at, number, known = (source, split), 0, {}
                # The separator was swallowed: what follows END on its line is not data.
                body = value + "\nEND" if "BEGIN" in value.upper() else value
                for b in parse_record(body, with_values):
                    known.update((name, given) for _, name, given in b["sticky"])
                    if b["has_block"]:
                        add(b, True)
                        number += 1
                        held += 1 + len(b["freq"]) * (1 + len(b["labels"]))
            if columns[0]:
                yield packed()
                held = 0
        if at is not None:
            add(nothing, False)
            yield packed()

    return placed.mapInArrow(work, BLOCK_SCHEMA)


def _before(*keys: str):
    return Window.partitionBy(*keys).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)


def blocks(spark: SparkSession, path: str, dataset_kind: str = "fine", with_values: bool = True) -> DataFrame:
    """One row per block: ``record_id, ordinal, source_index, params``, header, arrays.

    ``with_values`` off gives the parameter-only scan.
    """
    kept = scratch(spark, "sweep-blocks")
    read_records(spark, path, with_values).write.parquet(kept)
    parsed = spark.read.schema(BLOCK_SCHEMA).parquet(kept)
    empty = F.create_map().cast("map<string,string>")
    newer = lambda older, new: F.map_concat(F.map_filter(older, lambda k, v: ~F.map_contains_key(new, k)), new)
    # What earlier splits of the file leave in force: the last split that assigns a name counts.
    ends = parsed.where("NOT has_block").select("source_file", "split", "number", "inherited")
    ends = checkpointed(ends.withColumn("first", F.coalesce(F.sum("number").over(_before("source_file")), F.lit(0))))
    given = ends.select("source_file", "split", F.explode("inherited").alias("name", "value"))
    names = given.select("source_file", "name").distinct()
    every = ends.select("source_file", "split").join(names, "source_file").join(given, ["source_file", "split", "name"], "left")
    earlier = every.withColumn("left", F.last("value", ignorenulls=True).over(_before("source_file", "name"))).where("left IS NOT NULL")
    left = earlier.groupBy("source_file", "split").agg(F.map_from_entries(F.collect_list(F.struct("name", "left"))).alias("left"))
    carry = ends.select("source_file", "split", "first").join(left, ["source_file", "split"], "left")
    carry = broadcast_small(checkpointed(carry))  # one row a split
    joined = parsed.where("has_block").join(carry, ["source_file", "split"])
    index = F.col("first") + F.col("number")
    return joined.select(
        F.concat_ws("|", F.lit(dataset_kind), "source_file", index.cast("string")).alias("record_id"),
        F.lit(dataset_kind).alias("dataset_kind"),
        "source_file",
        index.cast("int").alias("source_index"),
        newer(newer(F.coalesce("left", empty), F.col("inherited")), F.col("own")).alias("params"),
        "data_format",
        "frequency_unit",
        "reference_impedance_ohm",
        "freq_hz",
        "labels",
        "re",
        "im",
    )


def with_ordinal(block: DataFrame) -> DataFrame:
    """Source order over all files: files by path, blocks by index."""
    counts = block.groupBy("source_file").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("source_file", F.coalesce(start, F.lit(0)).alias("offset"))
    return block.join(offsets, "source_file").withColumn("ordinal", F.col("offset") + F.col("source_index")).drop("offset")


def response(block: DataFrame, *more: str) -> DataFrame:
    """Long form: one row per block, frequency and label; ``more`` columns of the block stay."""
    samples = block.select(
        *[c for c in ("record_id", "ordinal", "dataset_kind", "role", "source_file", "source_index") if c in block.columns],
        *more,
        "labels",
        F.posexplode(F.arrays_zip("freq_hz", "re", "im")).alias("freq_idx", "s"),
    )
    keep = [c for c in samples.columns if c not in ("labels", "s")]
    return samples.select(
        *keep,
        F.col("s.freq_hz").alias("freq_hz"),
        F.explode(F.arrays_zip(F.col("labels").alias("label"), F.col("s.re").alias("re"), F.col("s.im").alias("im"))).alias("e"),
    ).select(*keep, "freq_hz", F.col("e.label").alias("label"), F.col("e.re").alias("re"), F.col("e.im").alias("im"))


def block_text(block: DataFrame, split_var: str = "dataset") -> DataFrame:
    """Text of each block, ready for a text sink (one row per block)."""
    heads = F.transform(
        F.map_entries("params"), lambda e: F.concat(F.lit("VAR "), e["key"], F.lit("="), e["value"])
    )
    def line(i):
        pairs = F.transform(
            F.arrays_zip(F.get("re", i).alias("a"), F.get("im", i).alias("b")),
            lambda c: F.concat_ws(" ", c["a"].cast("string"), c["b"].cast("string")),
        )
        return F.concat_ws(" ", F.get("freq_hz", i).cast("string"), F.concat_ws(" ", pairs))

    rows = F.transform(F.sequence(F.lit(0), F.size("freq_hz") - 1), line)
    option = F.format_string("# Hz S RI R %s", F.coalesce(F.col("reference_impedance_ohm"), F.lit(50.0)).cast("string"))
    return block.select(
        "record_id",
        F.concat_ws(
            "\n",
            F.array_join(heads, "\n"),
            F.lit("BEGIN ACDATA"),
            F.concat(F.lit("% Freq "), F.array_join("labels", " ")),
            option,
            F.array_join(rows, "\n"),
            F.lit("END"),
        ).alias("value"),
    )
