"""Ordered window results that survive a hot key.

A plain window sends all rows of one key to one task.  Here each key is cut
into chunks along its order (``chunk`` is a column that never decreases with
the order, such as ``line_number div 1000000``).  The window runs inside
(key, chunk); one summary row per chunk carries the state to the next chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows of one key that a single task may order.
CHUNK_ROWS = 1_000_000

_KEY = "__key"
_CHUNK = "__chunk"
_CARRY = "__carry"


def index_chunk(index: Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk of a dense integer order such as a line number."""
    return F.floor(index / F.lit(rows)).cast("long")


def value_chunk(value: Column, width: float) -> Column:
    """Chunk of a numeric order by fixed width."""
    return F.floor(value / F.lit(float(width))).cast("long")


def time_chunk(ts: Column, seconds: int = 86_400) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def _prepared(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Add the key as one struct and the chunk.  The struct is never NULL and
    compares NULL fields as equal, so windows, aggregates and the join below
    agree on it and the join reuses the partitioning of the window."""
    key = F.struct(*keys) if keys else F.lit(0)
    return df.withColumn(_KEY, key).withColumn(_CHUNK, chunk)


def _inside():
    return Window.partitionBy(_KEY, _CHUNK)


def _join_carry(df: DataFrame, carry: DataFrame) -> DataFrame:
    return df.join(carry, [_KEY, _CHUNK], "left")


def _chunk_state(df: DataFrame, state: Column, carried) -> DataFrame:
    """One row per (key, chunk) with the state carried in from earlier chunks."""
    parts = df.groupBy(_KEY, _CHUNK).agg(state.alias("__state"))
    order = Window.partitionBy(_KEY).orderBy(_CHUNK)
    return parts.select(_KEY, _CHUNK, carried(F.col("__state"), order).alias(_CARRY))


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: dict[str, str]
) -> DataFrame:
    """Add ``values`` = {new column: source column} of the row before."""
    data = _prepared(df, keys, chunk)
    inside = _inside().orderBy(*order)
    tail = F.max_by(F.struct(*[F.col(v).alias(k) for k, v in values.items()]), F.struct(*order))
    carry = _chunk_state(data, tail, lambda s, w: F.lag(s).over(w))
    out = data.withColumn("__first", F.row_number().over(inside) == 1)
    for name, source in values.items():
        out = out.withColumn(name, F.lag(source).over(inside))
    out = _join_carry(out, carry)
    for name in values:
        out = out.withColumn(name, F.when(F.col("__first"), F.col(_CARRY)[name]).otherwise(F.col(name)))
    return out.drop("__first", _CARRY, _KEY, _CHUNK)


def following(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: dict[str, str]
) -> DataFrame:
    """Add ``values`` of the row after."""
    data = _prepared(df, keys, chunk)
    inside = _inside().orderBy(*[F.col(o).desc() for o in order])
    head = F.min_by(F.struct(*[F.col(v).alias(k) for k, v in values.items()]), F.struct(*order))
    carry = _chunk_state(data, head, lambda s, w: F.lead(s).over(w))
    out = data.withColumn("__first", F.row_number().over(inside) == 1)
    for name, source in values.items():
        out = out.withColumn(name, F.lag(source).over(inside))
    out = _join_carry(out, carry)
    for name in values:
        out = out.withColumn(name, F.when(F.col("__first"), F.col(_CARRY)[name]).otherwise(F.col(name)))
    return out.drop("__first", _CARRY, _KEY, _CHUNK)


def _fill(df, keys, order, chunk, values, backward: bool) -> DataFrame:
    data = _prepared(df, keys, chunk)
    ordering = [F.col(o).desc() if backward else F.col(o).asc() for o in order]
    inside = (
        _inside().orderBy(*ordering).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    pick = F.min_by if backward else F.max_by
    last = F.struct(
        *[
            pick(F.col(v), F.when(F.col(v).isNotNull(), F.struct(*order))).alias(k)
            for k, v in values.items()
        ]
    )

    def carried(state: Column, window) -> Column:
        span = (
            window.rowsBetween(1, Window.unboundedFollowing)
            if backward
            else window.rowsBetween(Window.unboundedPreceding, -1)
        )
        choose = F.first if backward else F.last
        return F.struct(*[choose(state[k], ignorenulls=True).over(span).alias(k) for k in values])

    carry = _chunk_state(data, last, carried)
    out = data
    for name, source in values.items():
        out = out.withColumn(f"__in_{name}", F.last(source, ignorenulls=True).over(inside))
    out = _join_carry(out, carry)
    for name in values:
        out = out.withColumn(name, F.coalesce(F.col(f"__in_{name}"), F.col(_CARRY)[name]))
    return out.drop(_CARRY, _KEY, _CHUNK, *[f"__in_{name}" for name in values])


def forward_fill(df, keys, order, chunk: Column, values: dict[str, str]) -> DataFrame:
    """Add ``values`` = {new column: source}: last non-NULL at or before the row."""
    return _fill(df, keys, order, chunk, values, backward=False)


def backward_fill(df, keys, order, chunk: Column, values: dict[str, str]) -> DataFrame:
    """Add ``values``: next non-NULL at or after the row."""
    return _fill(df, keys, order, chunk, values, backward=True)


def running(df, keys, order, chunk: Column, sums: dict[str, Column]) -> DataFrame:
    """Add running sums, current row included."""
    data = _prepared(df, keys, chunk)
    for name, value in sums.items():
        data = data.withColumn(f"__v_{name}", value)
    inside = (
        _inside().orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.struct(*[F.sum(f"__v_{name}").alias(name) for name in sums])

    def carried(state: Column, window) -> Column:
        span = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.struct(*[F.sum(state[k]).over(span).alias(k) for k in sums])

    carry = _chunk_state(data, total, carried)
    out = data
    for name in sums:
        out = out.withColumn(name, F.sum(f"__v_{name}").over(inside))
    out = _join_carry(out, carry)
    for name in sums:
        out = out.withColumn(name, F.coalesce(F.col(_CARRY)[name], F.lit(0)) + F.coalesce(F.col(name), F.lit(0)))
    return out.drop(_CARRY, _KEY, _CHUNK, *[f"__v_{name}" for name in sums])


def running_min(df, keys, order, chunk: Column, name: str, value: Column) -> DataFrame:
    """Add the smallest ``value`` at or before each row."""
    data = _prepared(df, keys, chunk).withColumn("__v", value)
    inside = (
        _inside().orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carry = _chunk_state(
        data, F.min("__v"), lambda s, w: F.min(s).over(w.rowsBetween(Window.unboundedPreceding, -1))
    )
    out = _join_carry(data.withColumn("__in", F.min("__v").over(inside)), carry)
    return out.withColumn(name, F.least("__in", _CARRY)).drop(_CARRY, _KEY, _CHUNK, "__in", "__v")


def number_rows(df, keys, order, chunk: Column, name: str = "row_number") -> DataFrame:
    """Number the rows of each key from 1 in ``order``."""
    return running(df, keys, order, chunk, {name: F.lit(1).cast("long")})


def global_index(df: DataFrame, order: Sequence[str], chunk: Column, name: str) -> DataFrame:
    """Number all rows from 1 without an unpartitioned window over the rows."""
    return number_rows(df, [], order, chunk, name)


def with_percentiles(
    out: DataFrame, rows: DataFrame, keys: Sequence[str], value: Column, shares: dict[str, float], ranks: dict[str, float] | None = None
) -> DataFrame:
    """``out`` (one row per key) with exact percentiles of ``value`` over ``rows``.

    ``shares`` interpolate between neighbours, ``ranks`` take the first value that
    so large a share does not exceed.  Values are counted before anything is
    ordered, and a key's different values are cut into chunks of about equal
    size, so no task holds all values of a key.
    """
    key = F.struct(*keys) if keys else F.lit(0)
    counts = rows.select(key.alias("__g"), value.cast("double").alias("__x")).where("__x IS NOT NULL")
    counts = counts.groupBy("__g", "__x").agg(F.count("*").alias("__n"))
    cuts = F.percentile_approx("__x", F.array(*[F.lit(k / 256) for k in range(1, 256)]), F.lit(2_560))
    facts = counts.groupBy("__g").agg(cuts.alias("__cuts"), F.sum("__n").alias("__total"))
    chunk = F.size(F.filter("__cuts", lambda c: c < F.col("__x")))
    placed = running(counts.join(facts, "__g"), ["__g"], ["__x"], chunk, {"__upto": F.col("__n")})
    first_over = lambda place: F.min(F.when(F.col("__upto") > place, F.col("__x")))
    found = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("__total") - 1)
        found += [first_over(F.floor(place)).alias(f"__lo_{name}"), first_over(F.ceil(place)).alias(f"__hi_{name}"), F.max(place).alias(f"__at_{name}")]
    for name, share in (ranks or {}).items():
        found.append(F.min(F.when(F.col("__upto") >= F.lit(share) * F.col("__total"), F.col("__x"))).alias(name))
    made = placed.groupBy("__g").agg(*found)
    between = {}
    for name in shares:
        lo, hi, at = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), F.col(f"__at_{name}")
        mixed = (F.ceil(at) - at) * lo + (at - F.floor(at)) * hi
        between[name] = F.when((F.floor(at) == F.ceil(at)) | (lo == hi), lo).otherwise(mixed)
    made = made.withColumns(between).select("__g", *shares, *(ranks or {})) if between else made
    return out.withColumn("__g", key).join(made, "__g", "left").drop("__g")
