"""What the operators of this folder share: words, hashes, shared tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch

# Words of every contract: runs of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Texts are handled in pieces of at most this many bytes inside a task.
BATCH_BYTES = 4 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again.

    The table outlives lost executors and is columnar, so later jobs read only
    the columns they need.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) that depends only on the parts, from 52 bits of MD5."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's digits modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(5)


def plain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.uint64(base & 0xFFFFFFFFFFFFFFFF)
        return np.multiply.accumulate(out)


class Powers:
    """Powers of the hash base and of its inverse, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up = _powers(_BASE, n)
            self.down = _powers(pow(_BASE, -1, 1 << 64), n)
        return self.up, self.down


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base^i modulo 2^64 before every position."""
    up, _ = POWERS.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the byte strings [start, end)."""
    _, down = POWERS.to(len(sums))
    with np.errstate(over="ignore"):
        return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array and the offsets of their starts (one more than texts)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def by_bytes(texts: Sequence[bytes], most: int = BATCH_BYTES):
    """Ranges [lo, hi) of texts of about ``most`` bytes together; one text may be longer."""
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > most:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def word_spans(data: np.ndarray, ends: np.ndarray):
    """Starts, ends and text numbers of the words in joined texts."""
    solid = ~_SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends[:-1]] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    edge[ends[1:]] = True
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    return start, end, np.searchsorted(ends, start, side="right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and a mask of present values of an Arrow text column, without copies."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    n = len(column)
    kind = np.dtype(np.int64 if wide else np.int32)
    if n and places is not None:
        ends = np.frombuffer(places, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    else:
        ends = np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends, np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)


def parts(column, most: int = BATCH_BYTES):
    """(lo, hi, data, ends) of consecutive texts of about ``most`` bytes together.

    ``ends`` are offsets into ``data``, one more than texts; a text longer than
    ``most`` comes alone.
    """
    raw, ends, _ = text_bytes(column)
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
        yield lo, hi, raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def give_back() -> None:
    """Return freed memory to the system; a worker that waits would hold it through the next stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def lean(work):
    """``work(batches)`` that gives memory back at its end."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def with_text_results(docs: DataFrame, keep: Sequence[str], fields, function, most: int | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and new fields that ``function`` computes.

    ``function`` gets the Arrow array of texts and gives one array per field.
    Rows are handled in the order and the tasks they came in; nothing moves.
    With ``most`` it gets texts of about that many bytes at a time, which bounds
    the results held at once.
    """
    from pyspark.sql import types as T

    keep = [c for c in keep if c not in {f.name for f in fields}]
    schema = T.StructType([docs.schema[c] for c in keep] + list(fields))
    names = schema.names
    # A kept text is the one that came in; it is not sent twice.
    others = [c for c in keep if c != "text"]
    places = [0 if c == "text" else 1 + others.index(c) for c in keep]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            ranges = [(lo, hi) for lo, hi, _, _ in parts(whole.column(0), most)] if most else [(0, whole.num_rows)]
            for lo, hi in ranges:
                batch = whole.slice(lo, hi - lo)
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in function(batch.column(0))]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in places] + made, names=names)

    taken = docs.select(F.col("text"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(others)])
    return taken.mapInArrow(lean(run), schema)


def bounded(rows: DataFrame, group: str, most: int, seed: str) -> DataFrame:
    """About ``most`` rows of each group, chosen by a hash of doc_id.

    Only the group sizes are shared with the tasks: one row for each class that
    a model is about to learn.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n")).withColumnRenamed(group, "__g")
    drawn = rows.join(F.broadcast(sizes), F.col(group) == F.col("__g"))
    return drawn.filter(unit_hash(F.col("doc_id"), F.lit(seed)) * F.col("__n") < most).drop("__n", "__g")


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the folds to learn from with a 0/1 label."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label"))
    return rows.filter("label in (0, 1)").filter(fold_of(F.col("doc_id")) != 0)


def logistic_fit(x: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton steps of a logistic regression with an intercept and a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (label - p)) - ridge * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(bend, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta
