"""Space-filling designs generated in parallel from row numbers and hashes."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.units import from_unit
from ..session import checkpointed
from . import inventory, ordered, pairs

REFILL_ATTEMPTS = 32
REFILL_SEED_STEP = 1009
MAXIMIN_DESIGNS = 64


def primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    return found


def radical_inverse(index: Column, base: int) -> Column:
    """Digits of ``index`` mirrored about the radix point."""
    digits = F.ceil(F.log(F.greatest(index, F.lit(1)).cast("double") + 1.0) / F.log(F.lit(float(base)))) + 1
    start = F.struct(index.cast("long").alias("rest"), F.lit(1.0 / base).alias("factor"), F.lit(0.0).alias("value"))
    return F.aggregate(
        F.sequence(F.lit(1), digits.cast("int")),
        start,
        lambda s, _: F.struct(
            F.call_function("div", s["rest"], F.lit(base).cast("long")).alias("rest"),
            (s["factor"] * F.lit(1.0 / base)).alias("factor"),
            (s["value"] + F.pmod(s["rest"], F.lit(base).cast("long")) * s["factor"]).alias("value"),
        ),
        lambda s: s["value"],
    )


def halton(rows: DataFrame, index: str, dimensions: int, skip: int = 0, prefix: str = "u") -> DataFrame:
    """Halton coordinates of 0-based row numbers; first primes as bases."""
    at = F.col(index) + F.lit(skip + 1)
    return rows.withColumns({f"{prefix}{d}": radical_inverse(at, b) for d, b in enumerate(primes(dimensions))})


# --- Latin hypercube ---------------------------------------------------------


def _round(left: Column, right: Column, half: int, keys: Sequence[Column], step: int) -> tuple[Column, Column]:
    mask = F.lit((1 << half) - 1)
    mixed = F.xxhash64(F.lit(step), right, *keys).bitwiseAND(mask)
    return right, left.bitwiseXOR(mixed)


def _shuffled_once(value: Column, half: int, keys: Sequence[Column]) -> Column:
    left, right = F.shiftright(value, half), value.bitwiseAND(F.lit((1 << half) - 1))
    for step in range(4):
        left, right = _round(left, right, half, keys, step)
    return F.shiftleft(left, half).bitwiseOR(right)


def permuted(value: Column, count: int, keys: Sequence[Column]) -> Column:
    """Seeded permutation of 0..count-1, computed per row without a shuffle.

    A balanced Feistel network permutes the next even power of two; values that
    fall outside are sent through again until they fall inside.
    """
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    start = value.cast("long")

    def lap(current: Column) -> Column:
        return _shuffled_once(current, half, keys)

    def more(value: Column, laps: int) -> Column:
        # Bound once by the array; a value that is inside takes no further lap.
        def walk(v: Column) -> Column:
            steps = F.when(v < F.lit(count), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(laps)))
            return F.aggregate(steps, v, lambda current, _: F.when(current < F.lit(count), current).otherwise(lap(current)))

        return F.get(F.transform(F.array(value), walk), 0)

    # Nearly all values are inside after a few laps, so the long walk is seldom started.
    laps = 4**half if half <= 3 else 256
    few = min(laps, 6)
    inside = more(lap(start), few)
    return more(inside, laps - few) if laps > few else inside


def uniform(*keys: Column) -> Column:
    """Reproducible number in [0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def latin_hypercube(
    rows: DataFrame, index: str, count: int, dimensions: int, seed: int, design: Column | None = None, prefix: str = "u"
) -> DataFrame:
    """One stratum per row and dimension, jittered inside the stratum."""
    extra = design if design is not None else F.lit(0)
    coords = {}
    for d in range(dimensions):
        keys = [F.lit(seed), F.lit(d), extra]
        stratum = permuted(F.col(index), count, keys)
        jitter = uniform(F.lit(seed), F.lit(d), extra, F.col(index), F.lit(7))
        coords[f"{prefix}{d}"] = (stratum.cast("double") + jitter) / F.lit(float(count))
    return rows.withColumns(coords)


def maximin_latin_hypercube(
    rows: DataFrame, index: str, count: int, dimensions: int, seed: int, designs: int = MAXIMIN_DESIGNS, prefix: str = "u"
) -> DataFrame:
    """The design with the largest smallest pair distance; the first wins ties.

    All designs are one table.  Distances inside every design come from one
    grid join: cells as wide as the stratified spacing guarantees are visited
    first, so only close points meet.
    """
    table = rows.withColumn("__design", F.explode(F.sequence(F.lit(0), F.lit(designs - 1))))
    # The rows of one small file would all be drawn in its task; a counted repartition is not merged for being small.
    table = table.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "__design", index)
    table = checkpointed(latin_hypercube(table, index, count, dimensions, seed, F.col("__design"), prefix))
    axes = [f"{prefix}{d}" for d in range(dimensions)]
    score = design_scores(table, "__design", index, axes, count)
    best = score.agg(F.max_by("__design", F.struct("minimum_distance", -F.col("__design"))).alias("d")).first()["d"]
    chosen = 0 if best is None else best
    return table.where(F.col("__design") == chosen).drop("__design")


def design_scores(table: DataFrame, design: str, index: str, axes: Sequence[str], count: int) -> DataFrame:
    """Smallest pair distance of each design.

    The expected spacing of ``count`` points bounds the cell size from above;
    designs that have no pair inside the neighbouring cells are searched again
    with cells twice as wide, so the answer is exact.
    """
    dims = len(axes)
    width = max(1.0 / max(count, 1), (1.0 / max(count, 1)) ** (1.0 / dims))
    todo = table
    found = None
    while True:
        cells = [F.floor(F.col(a) / F.lit(width)).cast("long").alias(f"__c{k}") for k, a in enumerate(axes)]
        keep = min(dims, 3)  # the first axes choose the cell, the distance uses all
        placed = todo.select(design, index, *axes, *cells[:keep])
        names = [f"__c{k}" for k in range(keep)]
        spread = placed
        for name in names:
            spread = spread.withColumn(name, F.explode(F.sequence(F.col(name) - 1, F.col(name) + 1)))
        other = placed.select(design, *names, F.col(index).alias("__j"), *[F.col(a).alias(f"__o_{a}") for a in axes])
        distance = F.sqrt(reduce(lambda x, y: x + y, [(F.col(a) - F.col(f"__o_{a}")) ** 2 for a in axes]))
        scores = (
            spread.join(other, [design, *names])
            .where(F.col(index) < F.col("__j"))
            .groupBy(design)
            .agg(F.min(distance).alias("minimum_distance"))
        )
        # A pair further apart than one cell may have been missed.
        sure = scores if width >= 1.0 else scores.where(F.col("minimum_distance") <= width)
        sure = checkpointed(sure)
        found = sure if found is None else found.unionByName(sure)
        rest = todo.join(sure.select(design), design, "left_anti")
        if width >= 1.0 or rest.isEmpty():
            return found
        todo, width = rest, width * 2.0


# --- Sobol -------------------------------------------------------------------

# Initial direction numbers of the first dimensions (Joe and Kuo,
# new-joe-kuo-6).  Later dimensions draw theirs by rule.
SOBOL_INITIAL = (
    (1,),
    (1, 3),
    (1, 3, 1),
    (1, 1, 1),
    (1, 1, 3, 3),
    (1, 3, 5, 13),
    (1, 1, 5, 5, 17),
    (1, 1, 5, 5, 5),
    (1, 1, 7, 11, 19),
)
# As many bits as a double keeps below one.
SOBOL_BITS = 52


def _is_primitive(polynomial: int, degree: int) -> bool:
    """True if x generates all non-zero residues of the polynomial over GF(2)."""

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            if b & 1:
                out ^= a
            a <<= 1
            if a >> degree:
                a ^= polynomial
            b >>= 1
        return out

    def power(e: int) -> int:
        out, x = 1, 2 if degree > 1 else 1
        while e:
            if e & 1:
                out = times(out, x)
            x = times(x, x)
            e >>= 1
        return out

    order = (1 << degree) - 1
    rest, factors, n = order, set(), 2
    while n * n <= rest:
        while rest % n == 0:
            factors.add(n)
            rest //= n
        n += 1
    factors |= {rest} - {1}
    return power(order) == 1 and all(power(order // f) != 1 for f in factors)


def primitive_polynomials(count: int) -> list[tuple[int, int]]:
    """(degree, polynomial) in order of degree and then of value."""
    found: list[tuple[int, int]] = []
    degree = 1
    while len(found) < count:
        for polynomial in range((1 << degree) + 1, 2 << degree, 2):
            if len(found) < count and _is_primitive(polynomial, degree):
                found.append((degree, polynomial))
        degree += 1
    return found


def sobol_directions(dimensions: int) -> list[list[int]]:
    """Direction integers of each dimension, most significant bit first."""
    out = [[1 << (SOBOL_BITS - 1 - k) for k in range(SOBOL_BITS)]]
    for axis, (degree, polynomial) in enumerate(primitive_polynomials(dimensions - 1)):
        if axis < len(SOBOL_INITIAL):
            m = list(SOBOL_INITIAL[axis])
        else:  # any odd number below 2^(k + 1) may stand at place k
            draw = random.Random(axis)
            m = [2 * draw.randrange(1 << k) + 1 for k in range(degree)]
        for k in range(degree, SOBOL_BITS):
            value = m[k - degree] ^ (m[k - degree] << degree)
            for j in range(1, degree):
                if polynomial >> (degree - j) & 1:
                    value ^= m[k - j] << j
            m.append(value)
        out.append([m[k] << (SOBOL_BITS - 1 - k) for k in range(SOBOL_BITS)])
    return out[:dimensions]


def sobol(
    rows: DataFrame, index: str, dimensions: int, seed: int = 0, scramble: bool = False, skip: int = 0, prefix: str = "u"
) -> DataFrame:
    """Sobol coordinates of 0-based row numbers below 2^52 (Gray-code order).  The
    scramble is a digital shift, which differs from a nested one."""
    at = (F.col(index) + F.lit(skip)).cast("long")
    gray = at.bitwiseXOR(F.shiftright(at, 1))
    table = np.array(sobol_directions(dimensions), np.int64).T

    @F.pandas_udf("array<long>")
    def mixed(codes: pd.Series) -> pd.Series:
        code = codes.to_numpy(np.int64)
        bits = np.zeros((len(code), dimensions), np.int64)
        if not len(code):
            return pd.Series([], dtype=object)
        if code.min() < 0 or code.max() >> SOBOL_BITS:
            raise ValueError(f"Sobol row numbers must lie in 0 .. 2^{SOBOL_BITS} - 1")
        for k in range(int(code.max()).bit_length()):
            bits ^= -(code >> k & 1)[:, None] & table[k]
        return pd.Series(list(bits))

    # The function sees no NULL; a row without number gets no coordinates.
    rows = rows.withColumn("__bits", F.when(F.col(index).isNotNull(), mixed(F.coalesce(gray, F.lit(0)))))
    coords = {}
    for d in range(dimensions):
        bits = F.col("__bits")[d]
        if scramble:
            bits = bits.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(d)).bitwiseAND(F.lit((1 << SOBOL_BITS) - 1)))
        coords[f"{prefix}{d}"] = bits.cast("double") / F.lit(float(1 << SOBOL_BITS))
    return rows.withColumns(coords).drop("__bits")


# --- unique points on the output grid -----------------------------------------


def unit_points(spark: SparkSession, method: str, count: int, dimensions: int, seed: int, skip: int = 0, scramble: bool = False, designs: int = MAXIMIN_DESIGNS) -> DataFrame:
    """``row`` and coordinates ``u0``..; one table for every method."""
    rows = spark.range(count).select(F.col("id").alias("row"))
    if method == "halton":
        return halton(rows, "row", dimensions, skip)
    if method == "sobol":
        return sobol(rows, "row", dimensions, seed, scramble, skip)
    if method == "latin-hypercube":
        return latin_hypercube(rows, "row", count, dimensions, seed)
    if method in ("maximin-lhs", "minimax-lhs"):
        return maximin_latin_hypercube(rows, "row", count, dimensions, seed, designs)
    raise ValueError(f"unknown design method {method!r}")


def grid_capacity(sizes: Sequence[int]) -> int:
    """Number of distinct points on a decimal grid."""
    total = 1
    for size in sizes:
        total *= max(0, size)
    return total


def grid_steps(p: dict, places: int) -> tuple[int, int]:
    """First and last step of one axis on its decimal grid."""
    step = p.get("unit_scale", 1.0)
    low, high = p["lower"] / step * 10**places, p["upper"] / step * 10**places
    return math.ceil(low - 1e-12 * max(1.0, abs(low))), math.floor(high + 1e-12 * max(1.0, abs(high)))


def free_grid_points(
    spark: SparkSession, domain: Sequence[dict], places: int, count: int, seed: int, taken: DataFrame | None
) -> DataFrame:
    """``count`` points of the grid that are not taken, chosen by hash (all, if fewer); ``row`` numbers the grid.

    Point numbers are turned into one step per axis, so nothing is listed twice.
    """
    from ..functions.units import round_to_grid

    names, rest = [p["name"] for p in domain], F.col("id")
    steps = [grid_steps(p, places) for p in domain]
    table = spark.range(grid_capacity([hi - lo + 1 for lo, hi in steps]))
    values = {}
    for p, (lo, hi) in zip(domain, steps):
        step = F.lit(float(p.get("unit_scale", 1.0)))
        value = (F.pmod(rest, F.lit(hi - lo + 1)) + F.lit(lo)).cast("double") / F.lit(10.0**places) * step
        values[p["name"]] = round_to_grid(value, F.lit(float(p["lower"])), F.lit(float(p["upper"])), step, places)
        rest = F.call_function("div", rest, F.lit(hi - lo + 1).cast("long"))
    table = table.withColumns(values)
    if taken is not None:
        table = table.join(taken.select(*names), names, "left_anti")
    chosen = inventory.hash_ranked(table, "id", seed, count).where("chosen")
    return chosen.select(*names, F.col("id").alias("row"))


def unique_points(
    spark: SparkSession,
    method: str,
    count: int,
    domain: Sequence[dict],
    places: int,
    seed: int = 0,
    skip: int = 0,
    occupied: DataFrame | None = None,
    designs: int = MAXIMIN_DESIGNS,
) -> DataFrame:
    """Exactly ``count`` points, distinct after rounding to ``places`` decimals.

    ``domain``: dicts with name, lower, upper, scale and unit_scale (bounds in
    SI).  The first design usually suffices; refills continue its order with a
    new seed and skip, 32 times.  What is missing then comes from the free points of
    the grid, which is crowded by that time, in a seeded order.
    """
    sizes = [last - first + 1 for first, last in (grid_steps(p, places) for p in domain)]
    if count > grid_capacity(sizes):
        raise ValueError(f"only {grid_capacity(sizes)} distinct points exist, fewer than {count}")
    names = [p["name"] for p in domain]
    taken = occupied
    chosen = None
    have = 0
    for attempt in range(REFILL_ATTEMPTS + 1):
        missing = count - have
        if attempt == REFILL_ATTEMPTS:
            fresh = free_grid_points(spark, domain, places, missing, seed, taken)
        else:
            batch_size = count if attempt == 0 else max(missing, min(count, max(8, 2 * len(domain))))
            batch = unit_points(spark, method, batch_size, len(domain), seed + attempt * REFILL_SEED_STEP, skip, designs=designs)
            skip += batch_size
            batch = on_grid(batch, domain, places)
            fresh = inventory.keep_first(batch, names, "row")
            if taken is not None:
                fresh = fresh.join(taken.select(*names), names, "left_anti")
        fresh = checkpointed(fresh.select(*names, (F.col("row") + F.lit(attempt * 10**12)).alias("row")))
        got = fresh.count()
        if have + got > count:
            surplus = ordered.number_rows(fresh, [], ["row"], ordered.index_chunk(F.col("row")), "__n")
            fresh, got = surplus.where(F.col("__n") <= missing).drop("__n"), missing
        chosen = fresh if chosen is None else chosen.unionByName(fresh)
        taken = fresh.select(*names) if taken is None else taken.select(*names).unionByName(fresh.select(*names))
        have += got
        if have == count:
            return ordered.global_index(chosen, ["row"], ordered.index_chunk(F.col("row")), "point_index").drop("row")
    raise ValueError(f"could generate only {have} of {count} distinct points")


def on_grid(points: DataFrame, domain: Sequence[dict], places: int) -> DataFrame:
    """Replace coordinates ``u<k>`` by values rounded to the output grid."""
    from ..functions.units import round_to_grid

    out = points
    for k, p in enumerate(domain):
        low, high, step = F.lit(float(p["lower"])), F.lit(float(p["upper"])), F.lit(float(p.get("unit_scale", 1.0)))
        value = from_unit(F.col(f"u{k}"), low, high, F.lit(p.get("scale", "linear")))
        out = out.withColumn(p["name"], round_to_grid(value, low, high, step, places))
    return out


def product(*sides: DataFrame) -> DataFrame:
    """Product of small axes (parameter grid, frequency grid, setting values).

    A product is the feature itself: its size is the size of its result.
    """
    return reduce(lambda left, right: left.crossJoin(right), sides)


def candidate_pool(
    spark: SparkSession, count: int, ranges: Sequence[dict], categories: dict[str, Sequence[str]], seed: int = 0
) -> DataFrame:
    """Unique candidates over numeric ranges (linear, log or integer) and categories."""
    rows = spark.range(count).select(F.col("id").alias("row"))
    table = halton(rows, "row", len(ranges) + len(categories), skip=seed)
    for k, r in enumerate(ranges):
        value = from_unit(F.col(f"u{k}"), F.lit(float(r["lower"])), F.lit(float(r["upper"])), F.lit(r.get("scale", "linear")))
        table = table.withColumn(r["name"], F.rint(value).cast("long") if r.get("integer") else value)
    for k, (name, values) in enumerate(categories.items()):
        u = F.col(f"u{len(ranges) + k}")
        table = table.withColumn(
            name, F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))
        )
    names = [r["name"] for r in ranges] + list(categories)
    return inventory.keep_first(table.select("row", *names), names, "row")


def minimum_distance(points: DataFrame, index: str, axes: Sequence[str]) -> DataFrame:
    table = points.select(F.col(index).cast("long").alias("id"), F.array(*[F.col(a) for a in axes]).alias("p"))
    return pairs.minimum_pair_distance(table)
