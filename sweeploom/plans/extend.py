"""An inventory over a wider domain: the points it has and new ones in the part that was added.

The added part, the new box without the old one, is cut into disjoint slabs:
one below and one above the old range of each axis, with the old range on the
axes before it and the new range on the axes behind it.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import TRAIN_WORDS, VERIFICATION_WORDS
from ..operators import designs, inventory, ordered


def _coordinate(value: float, p: dict) -> float:
    """Place of a value on the new axis, 0 to 1."""
    low, high = float(p["lower"]), float(p["upper"])
    if p.get("scale", "linear") == "log":
        low, high, value = math.log(low), math.log(high), math.log(value)
    return (value - low) / (high - low)


def slabs(old: Sequence[dict], new: Sequence[dict], places: int) -> list[dict]:
    """Slabs with name, domain and share of the new box; empty ones are left out.

    On the axis that makes a slab it starts one step of the grid beyond the old
    range, so a rounded point cannot lie in both.
    """
    for p, q in zip(old, new):
        if q["lower"] > p["lower"] or q["upper"] < p["upper"]:
            raise ValueError(f"the new range of {p['name']} must hold the old one")
    made = []
    for k, (p, q) in enumerate(zip(old, new)):
        size = p.get("unit_scale", 1.0) / 10**places
        first, last = designs.grid_steps(p, places)
        for side, low, high, edge in (
            ("below", q["lower"], (first - 1) * size, (q["lower"], p["lower"])),
            ("above", (last + 1) * size, q["upper"], (p["upper"], q["upper"])),
        ):
            domain = [dict(d) for d in (*old[:k], {**q, "lower": low, "upper": high}, *new[k + 1 :])]
            steps = [designs.grid_steps(d, places) for d in domain]
            capacity = designs.grid_capacity([b - a + 1 for a, b in steps])
            if edge[1] <= edge[0] or capacity == 0:
                continue
            share = _coordinate(edge[1], q) - _coordinate(edge[0], q)
            for d, n in zip(old[:k], new[:k]):
                share *= _coordinate(d["upper"], n) - _coordinate(d["lower"], n)
            made.append({"name": f"{p['name']} {side}", "domain": domain, "share": share, "capacity": capacity})
    return made


def fitting_places(old: Sequence[dict], new: Sequence[dict], count: int, places: int, most: int = 9) -> int:
    """Decimals, ``places`` or more, of the coarsest grid on which every slab has room for its share of ``count``."""
    for k in range(places, most + 1):
        parts = slabs(old, new, k)
        total = sum(s["share"] for s in parts)
        if parts and all(math.ceil(count * s["share"] / total) <= s["capacity"] for s in parts):
            return k
    raise ValueError(f"no grid of up to {most} decimals holds {count} points in the added range")


def shared_out(count: int, shares: Sequence[float], room: Sequence[int]) -> list[int]:
    """``count`` by share with largest remainders; what a slab has no room for goes to the others."""
    if count > sum(room):
        raise ValueError(f"only {sum(room)} free points exist in the added range, fewer than {count}")
    given = [0] * len(shares)
    while sum(given) < count:
        open_ = [k for k in range(len(shares)) if given[k] < room[k]]
        missing, total = count - sum(given), sum(shares[k] for k in open_)
        wanted = {k: missing * shares[k] / total for k in open_}
        whole = {k: math.floor(w) for k, w in wanted.items()}
        for k in sorted(open_, key=lambda k: (whole[k] - wanted[k], k))[: missing - sum(whole.values())]:
            whole[k] += 1
        for k, n in whole.items():
            given[k] = min(room[k], given[k] + n)
    return given


def extended_inventory(
    existing: DataFrame,
    old: Sequence[dict],
    new: Sequence[dict],
    count: int,
    verification: int,
    places: int,
    method: str = "maximin-lhs",
    seed: int = 0,
    order: str = "row",
    split: str = "dataset",
    designs_tried: int = designs.MAXIMIN_DESIGNS,
) -> DataFrame:
    """All old rows and ``count`` new points: point_index, sequences, dataset, method, slab and one value per axis.

    ``existing`` has one value column per axis, an ``order`` and a ``split`` column.
    Old rows keep their values and come first; labels become ``train`` or
    ``verification``, anything else counts as train.  New points are distinct from
    each other and from the old ones; the last ``verification`` of them, taken
    evenly over the slabs, are for verification.
    """
    if not 0 <= verification <= count:
        raise ValueError("verification points are some of the new ones")
    spark, names = existing.sparkSession, [p["name"] for p in new]
    parts = slabs(old, new, places)
    held = []
    for slab in parts:
        inside = [
            F.col(d["name"]).between(d["lower"] - 1e-9 * abs(d["lower"]), d["upper"] + 1e-9 * abs(d["upper"]))
            for d in slab["domain"]
        ]
        held.append(F.count_distinct(F.when(reduce(operator.and_, inside), F.struct(*names))).alias(f"s{len(held)}"))
    used = existing.agg(*held).first() if held else []
    given = shared_out(count, [s["share"] for s in parts], [s["capacity"] - u for s, u in zip(parts, used)])
    word = F.lower(F.trim(F.coalesce(F.col(split), F.lit(""))))
    rows = ordered.global_index(existing, [order], ordered.index_chunk(F.col(order)), "__at").select(
        F.lit(0).alias("__new"), F.col("__at").cast("double").alias("__at"), F.lit(0).alias("__slab"),
        F.when(word.isin(*VERIFICATION_WORDS) & ~word.isin(*TRAIN_WORDS), "verification").otherwise("train").alias(split),
        (F.col("method") if "method" in existing.columns else F.lit("existing")).alias("method"),
        F.lit(None).cast("string").alias("slab"), *names,
    )
    fresh = None
    for k, (slab, n) in enumerate(zip(parts, given)):
        if n:
            points = designs.unique_points(
                spark, method, n, slab["domain"], places, seed + k, occupied=existing.select(*names), designs=designs_tried
            )
            # Slabs take turns by their share of the new points.
            points = points.select(
                F.lit(1).alias("__new"), ((F.col("point_index") - 0.5) / n).alias("__at"), F.lit(k).alias("__slab"),
                F.lit(f"range-extension-{method}").alias("method"), F.lit(slab["name"]).alias("slab"), *names,
            )
            fresh = points if fresh is None else fresh.unionByName(points)
    if fresh is not None:
        keys = ["__at", "__slab"]
        numbered = ordered.global_index(fresh, keys, F.floor(F.col("__at") * F.lit(max(1, count // ordered.CHUNK_ROWS))), "__n")
        role = F.when(F.col("__n") <= count - verification, "train").otherwise("verification")
        rows = rows.unionByName(numbered.withColumn(split, role).withColumn("__at", F.col("__n").cast("double")).drop("__n"))
    chunk = F.col("__new") * F.lit(1 << 40) + ordered.index_chunk(F.col("__at"))
    rows = ordered.global_index(rows, ["__new", "__at"], chunk, "__row")
    out = inventory.number_points(rows, "__row", split, ordered.index_chunk(F.col("__row")))
    return out.select("point_index", split, "split_sequence", "train_sequence", "verification_sequence", "method", "slab", *names)
