"""Near duplicates among embeddings by spherical k-means and blocked cosines.

Centroids are fitted on a bounded sample; every vector is placed.  A vector is
at home in the cell of its nearest centroid and visits each cell whose border
is nearer than half the largest distance of a linked pair.  Of two linked
vectors on both sides of a border one is that near to it, so every pair meets.
Inside a cell, blocks of vectors are compared by one matrix product each; a
cell of any size is cut into blocks, and a block sends counts and one edge per
member, never pairs.  Equal vectors are collapsed before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from ..operators.pairs import connected_labels

COSINE = 0.95
# Vectors of a cell on average, and the most cells of a fit.
CELL_ROWS = 512
MOST_CELLS = 4_096
# Bound of the fitting sample, and its Lloyd steps.
SAMPLE = 20_000
STEPS = 8
BLOCK = 2_048


def spherical_kmeans(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit rows; a centroid without rows stays where it was."""
    rng = np.random.default_rng(seed)
    centre = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(steps):
        near = np.concatenate([(x[i : i + 4096] @ centre.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        some = norm > 1e-12
        centre[some] = total[some] / norm[some, None]
    return np.unique(centre, axis=0)


def directions(vectors: DataFrame) -> DataFrame:
    """Every row with the unit vector and two hashes of the vector; NULL where it has no direction."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wide = F.transform(v, lambda x: x.cast("double"))
    largest = F.array_max(F.transform(wide, lambda x: F.abs(x)))
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & (largest > 0), F.lit(False))
    # Scaling by the largest component first keeps tiny and huge vectors exact.
    scaled = F.when(good, F.transform(wide, lambda x: x / largest))
    rows = vectors.select(
        "vec_id", F.when(good, F.xxhash64(v)).alias("h1"), F.when(good, F.xxhash64(F.lit("v"), v)).alias("h2"), scaled.alias("s")
    )
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("n", norm).select(
        "vec_id", "h1", "h2", F.transform("s", lambda x: x / F.col("n")).alias("unit")
    )


def _same_width(column, width: int):
    """Mask of rows of the fitted width and their matrix."""
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    mask = size == width
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if mask.all():
        return mask, flat.reshape(len(column), width)
    return mask, flat[np.repeat(mask, size)].reshape(int(mask.sum()), width)


def margin_of(cosine: float) -> float:
    """Distance from a border up to which a vector visits the other side: half the
    distance of unit vectors at ``cosine``, and a little for rounding."""
    return float(np.sqrt(max(2 - 2 * cosine, 0.0))) / 2 * 1.001 + 1e-6


def placed(units: DataFrame, centre: np.ndarray, margin: float) -> DataFrame:
    """One row per vector: (at, rep, copies, unit, visits), its home and the other cells it is in.

    A vector of another width than the fit goes to a cell of that width alone.
    """
    width = centre.shape[1]
    gram = centre @ centre.T
    gap = np.sqrt(np.maximum(2 - 2 * gram, 1e-12))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                mask, x = _same_width(part.column(2), width)
                near = x @ centre.T
                home = near.argmax(axis=1)
                lead = near[np.arange(len(x)), home]
                inside = (lead[:, None] - near) <= margin * gap[home]
                inside[np.arange(len(x)), home] = False
                row, cell = np.nonzero(inside)
                most = np.zeros(part.num_rows, np.int64)
                most[np.flatnonzero(mask)] = inside.sum(axis=1)
                at = -np.diff(part.column(2).offsets.to_numpy()).astype(np.int32)
                at[mask] = home
                offsets = np.concatenate(([0], np.cumsum(most))).astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), part.column(0), part.column(1), part.column(2), visits],
                    names=["at", "rep", "copies", "unit", "visits"],
                )

    return units.select("rep", "copies", "unit").mapInArrow(
        run, "at int, rep long, copies long, unit array<double>, visits array<int>"
    )


def _compare(table, cosine: float = COSINE):
    """Links of one block pair: rows (rep, root, links)."""
    import pyarrow as pa

    table = table.combine_chunks()
    cell = table.column("cell")[0].as_py() if table.num_rows else 0
    rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    left, right = table.column("x").to_numpy(), table.column("y").to_numpy()
    home = table.column("at").to_numpy()
    flat = table.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    unit = flat.reshape(table.num_rows, -1)
    visits = table.column("visits").combine_chunks()
    offsets, visited = visits.offsets.to_numpy(), visits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    # Numbers of (row, visited cell); cells of other widths are negative and never visited.
    known = np.sort(np.repeat(np.arange(table.num_rows), np.diff(offsets)) * (MOST_CELLS + 1) + visited)
    i, j = np.flatnonzero(left), np.flatnonzero(right)
    hit = unit[i] @ unit[j].T >= cosine
    hit &= rep[i][:, None] != rep[j][None, :]
    a, b = np.nonzero(hit)
    a, b = i[a], j[b]
    links = np.zeros(table.num_rows, np.int64)
    np.add.at(links, a, copies[b])
    # A visitor that is not visited in turn is counted for its host here.
    asked = b * (MOST_CELLS + 1) + home[a].astype(np.int64)
    at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    alone = (home[a] != cell) & ((known[at] != asked) if len(known) else np.ones(len(a), bool))
    np.add.at(links, b[alone], copies[a[alone]])
    root = np.arange(table.num_rows)
    while True:  # smallest row of each component of this block
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    some = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
    return pa.table({"rep": rep[some], "root": rep[root[some]], "links": links[some]})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding; other columns are ignored):
    vec_id, n_links, component_id, kept.

    Vectors that are NULL, empty, all zero, or hold NULL or non-finite components
    link with nothing, as do vectors of different width.  Equal vectors link; an
    empty table gives no rows.  Rows are told apart by themselves, not by their id:
    rows that repeat an id keep their own links, and a NULL id links like any
    other.  A component bears its smallest id that is not NULL (NULL, if it has
    none); ``kept`` is true for every row whose id is the component's.
    """
    units = common.stored(directions(vectors.select("vec_id", "embedding")), "embed-units")
    grouped = units.filter("unit is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit")
    )
    # A number of its own for each different vector; the table is written once, so it stays.
    reps = common.stored(grouped.withColumn("rep", F.monotonically_increasing_id()), "embed-reps")
    count = reps.count()
    drawn = [r["unit"] for r in reps.orderBy("h1", "h2").limit(SAMPLE).select("unit").collect()]
    if not drawn:
        empty = vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return empty.withColumn("kept", F.lit(True))
    widths = [len(u) for u in drawn]
    width = max(sorted(set(widths)), key=widths.count)
    sample = np.array([u for u in drawn if len(u) == width], float)
    centre = spherical_kmeans(sample, max(1, min(MOST_CELLS, -(-count // CELL_ROWS))))
    homes = common.stored(placed(reps, centre, margin_of(cosine)), "embed-cells")
    rows = homes.withColumn("cell", F.explode(F.concat(F.array("at"), "visits")))
    # Members of a cell are cut into blocks, and so are the ones at home in it: each member meets all of these.
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    parts = rows.groupBy("cell").agg(
        blocks(F.count("*")).alias("lefts"), blocks(F.count_if(F.col("cell") == F.col("at"))).alias("rights")
    )
    rows = rows.join(parts, "cell").withColumns(
        {
            "home": F.col("cell") == F.col("at"),
            "left": F.pmod(F.xxhash64("rep"), F.col("lefts")).cast("int"),
            "right": F.pmod(F.xxhash64(F.lit("right"), "rep"), F.col("rights")).cast("int"),
        }
    )
    shared = ["cell", "rep", "copies", "unit", "visits", "at"]
    lefts = rows.select(
        *shared, F.col("left").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"), "home", "right"
    ).select(*shared, "i", "j", F.lit(True).alias("x"), (F.col("home") & (F.col("j") == F.col("right"))).alias("y"))
    rights = (
        rows.filter("home")
        .select(*shared, "left", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), F.col("right").alias("j"))
        .filter("i != left")
        .select(*shared, "i", "j", F.lit(False).alias("x"), F.lit(True).alias("y"))
    )
    found = common.stored(
        lefts.unionByName(rights).groupBy("cell", "i", "j").applyInArrow(lambda t: _compare(t, cosine), "rep long, root long, links long"),
        "embed-links",
    )
    labels = connected_labels(
        reps.select(F.col("rep").alias("node")), found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    member = reps.select("rep", "h1", "h2", "least", "copies").join(labels, F.col("node") == F.col("rep"))
    names = member.groupBy("label").agg(F.min("least").alias("component_id"))
    per = member.join(names, "label").join(links, "rep", "left").select(
        F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    whole = units.select("vec_id", "h1", "h2").join(per, (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")), "left")
    component = F.when(F.col("__h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
