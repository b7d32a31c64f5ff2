"""Log files: encoding detection and numbered lines, in splits at any size.

Files are cut into byte ranges.  A first pass counts, for each range, what tells
the encoding (place of NUL bytes, halves of surrogate pairs) and how many lines
begin in it under every encoding; the counts are folded per file.  A second pass
reads the ranges again, each line in the range where it begins, and numbers the
lines from the counts of the ranges before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Bytes of a range; even, so that code units are not cut.
SPLIT_BYTES = 32 * 1024 * 1024
# A file is tested for UTF-16 if it has a NUL within so many bytes.
PROBE_BYTES = 4096
# Bytes read at a time behind a range for the end of its last line.
TAIL_BYTES = 64 * 1024

_BREAK = re.compile("\r\n|\r|\n")
# Name, bytes of a code unit, its type.
CHARSETS = (("utf-8", 1, "u1"), ("utf-16-le", 2, "<u2"), ("utf-16-be", 2, ">u2"))
_KIND = {name: (width, unit) for name, width, unit in CHARSETS}


def _marked(head: bytes) -> tuple[str | None, int]:
    """Encoding and length of a byte-order mark."""
    if head[:2] == b"\xff\xfe":
        return "utf-16-le", 2
    if head[:2] == b"\xfe\xff":
        return "utf-16-be", 2
    return ("utf-8", 3) if head[:3] == b"\xef\xbb\xbf" else (None, 0)


def _lone_halves(units: np.ndarray, first: int, last: int) -> int:
    """Units in [first, last) that are half of a surrogate pair without the other."""
    high, low = (units & 0xFC00) == 0xD800, (units & 0xFC00) == 0xDC00
    lone_high, lone_low = high.copy(), low.copy()
    lone_high[:-1] &= ~low[1:]
    lone_low[1:] &= ~high[:-1]
    return int((lone_high | lone_low)[first:last].sum())


def _begins(units: np.ndarray, at: int, first: int, last: int, total: int, mark: int) -> np.ndarray:
    """Places in [first, last) where a line begins; ``units`` start at place ``at``.

    A line begins behind each CR LF, CR or LF unless the file ends there, and at
    the start of a file that is not empty.
    """
    ends = units == 10
    alone = units == 13
    alone[:-1] &= units[1:] != 10
    begins = np.flatnonzero(ends | alone) + 1 + at
    if first <= mark < last:
        begins = np.concatenate(([mark], begins[begins > mark]))
    return begins[(begins >= first) & (begins < min(last, total))]


class _File:
    """Byte ranges of one file in any file system that Arrow opens."""

    def __init__(self, path: str, size: int) -> None:
        from pyarrow import fs

        local = path.startswith(("file:", "/"))
        system, name = (fs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if local else fs.FileSystem.from_uri(path)
        self.file, self.size = system.open_input_file(name), size

    def bytes(self, first: int, last: int) -> bytes:
        first, last = max(first, 0), min(last, self.size)
        return self.file.read_at(last - first, first) if last > first else b""

    def units(self, charset: str, first: int, last: int) -> tuple[np.ndarray, int]:
        """Units that lie in [first - 1 unit, last) and the place of the first one."""
        width, unit = _KIND[charset]
        start = max(first - width, 0)
        data = self.bytes(start, last)
        return np.frombuffer(data, unit, len(data) // width), start // width


_COUNTS = [f"begins_{k}" for k in range(len(CHARSETS))]


def _probe(batches) -> Iterator:
    """One row of counts for each range."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for log, size, first, last in zip(*[c.to_pylist() for c in batch.columns]):
            file = _File(log, size)
            own = np.frombuffer(file.bytes(first, last), "u1")
            named, mark = _marked(file.bytes(0, 4))
            places = np.flatnonzero(own == 0) + first
            row = {
                "log": log, "size": size, "first": first, "last": last, "mark": mark, "named": named,
                "probe": bool((places < PROBE_BYTES).any()), "even": int((places % 2 == 0).sum()), "odd": int((places % 2 == 1).sum()),
            }
            for k, (charset, width, _) in enumerate(CHARSETS):
                units, at = file.units(charset, first, last + 2)
                lo, hi = first // width, -(-last // width)
                row[f"lone_{k}"] = _lone_halves(units, lo - at, min(hi, size // width) - at) if width == 2 else 0
                begins = _begins(units, at, lo, hi, size // width, mark // width)
                row[f"begins_{k}"] = len(begins)
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=_probe_schema())


def _probe_schema():
    import pyarrow as pa

    longs = ["size", "first", "last", "mark", "even", "odd", *[f"lone_{k}" for k in range(len(CHARSETS))], *_COUNTS]
    kinds = {"log": pa.string(), "named": pa.string(), "probe": pa.bool_()}
    return pa.schema([*kinds.items(), *[(c, pa.int64()) for c in longs]])


def _read(batches) -> Iterator:
    """Lines that begin in each range, with their numbers."""
    import pyarrow as pa

    for batch in batches:
        for log, size, first, last, mark, charset, before in zip(*[c.to_pylist() for c in batch.columns]):
            file, width = _File(log, size), _KIND[charset][0]
            units, at = file.units(charset, first, last + 2)
            begins = _begins(units, at, first // width, -(-last // width), size // width, mark // width) * width
            if not len(begins):
                continue
            stop = last
            while True:  # on to the end of the last line
                tail, tail_at = file.units(charset, stop, stop + TAIL_BYTES)
                ends = _begins(tail, tail_at, max(stop, int(begins[-1]) + 1) // width, 1 << 62, 1 << 62, -1) * width
                stop = min(stop + TAIL_BYTES, size)
                if len(ends) or stop >= size:
                    break
            text = file.bytes(int(begins[0]), int(ends[0]) if len(ends) else size).decode(charset, "replace")
            lines = _BREAK.split(text)[: len(begins)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([log] * len(lines), pa.string()), pa.array(np.arange(len(lines)) + before + 1), pa.array(lines, pa.string())],
                names=["log", "line_number", "line"],
            )


def ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``log, size, first, last``: byte ranges of all files; their content is not read."""
    step = split_bytes + split_bytes % 2
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("log"), F.col("length").alias("size"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long")))
    placed = files.withColumn("first", starts)
    return placed.withColumn("last", F.least(F.col("first") + step, F.col("size"))).select("log", "size", "first", "last")


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``log, line_number, line`` of all files under ``path``.

    The encoding is the one of a byte-order mark; else UTF-16 if a NUL stands early
    and the file is valid in it (big endian where more NULs have even places); else
    UTF-8.  Bytes that are not valid become U+FFFD.  Lines end with CR LF, CR or LF.
    """
    cut = ranges(spark, path, split_bytes)
    # A range is a short row here and many lines below: a counted repartition is not merged for being small.
    size = cut.agg(F.count("*").alias("n"), F.sum(F.col("last") - F.col("first")).alias("bytes")).first()
    tasks = max(1, min(size["n"], max(-(-(size["bytes"] or 0) // SPLIT_BYTES), 2 * spark.sparkContext.defaultParallelism)))
    spread = cut.repartition(tasks, "log", "first")
    kinds = ", ".join(f"{c} long" for c in ("size", "first", "last", "mark", "even", "odd", "lone_0", "lone_1", "lone_2", *_COUNTS))
    counted = spread.mapInArrow(_probe, f"log string, named string, probe boolean, {kinds}")
    # A file has few ranges beside its lines: one row for each SPLIT_BYTES.
    file = Window.partitionBy("log")
    sums = {c: F.sum(c).over(file) for c in ("even", "odd", "lone_1", "lone_2")}
    folded = counted.withColumn("probe", F.max("probe").over(file)).withColumns(sums)
    wide = F.col("probe") & (F.col("size") % 2 == 0)
    little, big = F.col("lone_1") == 0, F.col("lone_2") == 0
    charset = (
        F.when(F.col("named").isNotNull(), F.col("named"))
        .when(wide & (F.col("even") > F.col("odd")) & big, "utf-16-be")
        .when(wide & (F.col("even") <= F.col("odd")) & little, "utf-16-le")
        .otherwise("utf-8")
    )
    begun = F.coalesce(*[F.when(F.col("charset") == name, F.col(c)) for (name, _, _), c in zip(CHARSETS, _COUNTS)])
    earlier = Window.partitionBy("log").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    known = folded.withColumn("charset", charset).withColumn("before", F.coalesce(F.sum(begun).over(earlier), F.lit(0)))
    dealt = known.select("log", "size", "first", "last", "mark", "charset", "before").repartition(tasks, "log", "first")
    return dealt.mapInArrow(_read, "log string, line_number long, line string")
