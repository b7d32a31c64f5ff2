"""Hard negatives: candidate lists shared by clusters of anchors.

Anchors are clustered by direction.  For a cluster, candidates are sorted once
by the most that any member's direction can give them: their length times the
cosine of the angle to the centre less the widest angle of a member.  Every
member walks that list, computing its products, until the bound of the next
candidate certifies that no later one can enter its result.  Candidates are cut
into blocks and clusters into parts, so a task holds one of each; results of
the blocks are merged.  One walk finds the positives of the anchors, a second
one, under the bands that the positives set, the negatives.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common
from .embed import spherical_kmeans
from .topk import as_long, exact_floats, in_blocks, integer_components, matrix, usable

BLOCK_ROWS = 8_192
# Anchors of a cluster part; the most clusters of a fit (a larger cluster has more parts); its sample.
PART_ROWS = 256
MOST_CLUSTERS = 1_024
SAMPLE = 20_000
# Candidates that a member takes from its list at a time.
STRIDE = 512
SLACK = 1e-6


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(axis=1))


def _units(x: np.ndarray) -> np.ndarray:
    length = _lengths(x)
    return x.astype(float) / np.where(length > 0, length, 1.0)[:, None]


class SharedList:
    """Candidates of a block in the order that all members of a cluster walk."""

    def __init__(self, rows: np.ndarray, members: np.ndarray) -> None:
        unit = _units(members)
        centre = unit.sum(axis=0)
        centre /= max(float(np.linalg.norm(centre)), 1e-300)
        angle = lambda u: np.arccos(np.clip(u @ centre, -1, 1))
        turned = unit[_lengths(members) > 0]
        widest = float(angle(turned).max()) if len(turned) else 0.0
        off = np.maximum(angle(_units(rows)) - widest - SLACK, 0.0)
        bound = _lengths(rows) * (np.cos(off) + SLACK)
        self.order = np.argsort(-bound, kind="stable")
        self.bound = bound[self.order]

    def of(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of the masked rows alone, and its bounds."""
        some = mask[self.order]
        return self.order[some], self.bound[some]


def walk(rows: np.ndarray, ids: np.ndarray, anchor: np.ndarray, listed: np.ndarray, bound: np.ndarray, bands, k: int):
    """The first k listed rows of each band (lowest, highest score; None: open), by score and id.

    Returns one (row numbers, scores) per band and the number of rows visited.
    """
    length = float(_lengths(anchor[None, :])[0])
    taken, scores = 0, np.zeros(0, rows.dtype)
    last = [-np.inf] * len(bands)  # the k-th score of each band so far
    while taken < len(listed):
        most = bound[taken] * length + SLACK
        if all(most < max(kth, -np.inf if low is None else low) for kth, (low, _) in zip(last, bands)):
            break
        scores = np.append(scores, rows[listed[taken : taken + STRIDE]] @ anchor)
        taken = min(taken + STRIDE, len(listed))
        for b, (low, high) in enumerate(bands):
            inside = scores if low is None else scores[(scores >= low) & (scores <= high)]
            if len(inside) >= k:
                last[b] = np.partition(inside, len(inside) - k)[len(inside) - k]
    out = []
    for low, high in bands:
        inside = np.arange(taken) if low is None else np.flatnonzero((scores >= low) & (scores <= high))
        first = inside[np.lexsort((ids[listed[inside]], -scores[inside]))[:k]]
        out.append((listed[first], as_long(scores[first])))
    return out, taken


def clustered(anchors: DataFrame) -> DataFrame:
    """``anchors`` (anchor_id, mark, label, v) with the cluster and part they walk in.

    Centroids are fitted on a sample of at most SAMPLE anchors; every anchor is placed.
    """
    count = anchors.count()
    drawn = [r["v"] for r in anchors.orderBy(F.xxhash64("anchor_id", "v")).limit(SAMPLE).select("v").collect()]
    widths = [len(v) for v in drawn]
    width = max(sorted(set(widths)), key=widths.count) if widths else 0
    centre = np.zeros((1, width))
    if width:
        sample = _units(np.array([v for v in drawn if len(v) == width]))
        centre = spherical_kmeans(sample, min(MOST_CLUSTERS, -(-count // PART_ROWS)))
    schema = "anchor_id long, mark long, label int, v array<long>, cluster int"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(3).to_pylist()
            near = [-1 if len(v) != width else int((centre @ _units(np.array([v], float))[0]).argmax()) for v in vectors]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "cluster"])

    placed = common.stored(anchors.select("anchor_id", "mark", "label", "v").mapInArrow(run, schema), "negatives-anchors")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("members"))
    part = F.pmod(F.xxhash64("anchor_id", "mark"), F.ceil(F.col("members") / PART_ROWS)).cast("int")
    # One row a cluster: at most MOST_CLUSTERS rows and one.
    return placed.join(F.broadcast(sizes), "cluster").withColumn("part", part).drop("members")


_ROW = "anchor_id long, mark long, place int, vec_id long, score long, copies long"


def _walked(anchors: DataFrame, rows: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
    """The best k rows of every block for each anchor and band: (anchor_id, mark, place, vec_id, score, copies)."""
    lists = anchors.select("cluster", "part").distinct()
    common_ = ["cluster", "part", "block", "width", "id", "mark", "label", "v", "copies", "positives"]
    asked = anchors.select(
        "cluster", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.size("v").alias("width"),
        F.col("anchor_id").alias("id"), "mark", "label", "v", F.lit(0).cast("long").alias("copies"), "positives",
    )
    # Every part of a cluster meets every block once: one row for each part and block.
    grid = lists.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    offered = rows.join(grid, "block").select(
        "cluster", "part", "block", F.size("v").alias("width"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("mark"),
        "label", "v", "copies", F.lit(None).cast("array<long>").alias("positives"),
    )

    def run(table):
        import pyarrow as pa

        copies = table.column("copies").to_numpy()
        ids, mark = table.column("id").to_numpy(), table.column("mark").to_numpy()
        label = table.column("label").to_numpy()
        vectors = matrix(table.column("v"), len(ids))
        row = np.flatnonzero(copies > 0)
        member = np.flatnonzero(copies == 0)
        out: list[list] = [[] for _ in range(6)]
        if len(row) and len(member):
            cand, own = exact_floats(vectors[row], vectors[member])
            shared = SharedList(cand, own)
            of_label = {}
            for m, bands in zip(range(len(member)), table.column("positives").take(pa.array(member)).to_pylist()):
                i = member[m]
                if label[i] not in of_label:
                    alike = label[row] == label[i]
                    of_label[label[i]] = shared.of(alike if same else ~alike)
                listed, bound = of_label[label[i]]
                other = ids[row[listed]] != ids[i]
                if not other.all():
                    listed, bound = listed[other], bound[other]
                # 30 p <= 100 n <= 90 p in whole numbers.
                limits = [(None, None)] if same else [(-(-30 * p // 100), 90 * p // 100) for p in bands]
                found, _ = walk(cand, ids[row], own[m], listed, bound, limits, k)
                for place, (at, score) in enumerate(found):
                    same_for_all = (np.full(len(at), x, np.int64) for x in (ids[i], mark[i], place))
                    for column, x in zip(out, (*same_for_all, ids[row[at]], score, copies[row[at]])):
                        column.append(x)
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        flat[2] = flat[2].astype(np.int32)
        return pa.table(dict(zip(["anchor_id", "mark", "place", "vec_id", "score", "copies"], flat)))

    both = asked.select(*common_).unionByName(offered.select(*common_))
    return both.groupBy("cluster", "part", "block", "width").applyInArrow(run, _ROW)


def _first(rows: DataFrame, k: int, *key: str) -> DataFrame:
    """The k best of each key over all blocks with their ``rank``; a repeated row counts as often as it is there."""
    each = rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))))
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10) -> DataFrame:
    """Hard negatives of ``anchors``: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has (vec_id, label, v) and ``anchors`` (anchor_id, label, v), with
    vectors of whole numbers.  Positives are the first rows of the anchor's label
    under other ids; negatives the first rows of other labels and ids whose score is
    30 to 90% of the positive's.  Rows that repeat count as often as they are there; an
    anchor that repeats is asked once, an id with several vectors or labels for
    each.  Vectors of another width have no score.
    """
    held = rows.filter("vec_id is not null and label is not null and v is not null")
    held = held.groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies"))
    held, blocks = in_blocks(common.stored(held, "negatives-rows"), BLOCK_ROWS, "row", "vec_id", "label", "v")
    asked = anchors.filter("anchor_id is not null and label is not null and v is not null")
    asked = asked.select("anchor_id", F.xxhash64("label", "v").alias("mark"), "label", "v").distinct()
    placed = clustered(common.stored(asked, "negatives-asked"))
    alike = _walked(placed.withColumn("positives", F.lit(None).cast("array<long>")), held, blocks, True, positives)
    first = common.stored(
        _first(alike, positives, "anchor_id", "mark").select(
            "anchor_id", "mark", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "negatives-positives",
    )
    scores = first.groupBy("anchor_id", "mark").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))), lambda x: x["positive_score"]).alias(
            "positives"
        )
    )
    found = _walked(placed.join(scores, ["anchor_id", "mark"]), held, blocks, False, negatives)
    best = _first(found, negatives, "anchor_id", "mark", "place").select(
        "anchor_id", "mark", (F.col("place") + 1).alias("at"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    out = best.join(first.withColumnRenamed("rank", "at"), ["anchor_id", "mark", "at"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, every: int = 100, label: Column | None = None, positives: int = 5, negatives: int = 10) -> DataFrame:
    """``mine`` among the vectors themselves (vec_id, embedding, label); anchors are ids divisible by ``every``.

    Rows without id, label or vector, or with NULL or non-finite components, take
    no part; other columns are ignored; an empty table gives no rows.
    """
    fine = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    label = F.col("label") if label is None else label
    rows = fine.select("vec_id", label.cast("int").alias("label"), integer_components(F.col("embedding")).alias("v"))
    anchors = rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "anchor_id")
    return mine(rows, anchors, positives, negatives)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(common.table(spark, sf_dir, "embeddings"), 100, moved)


OP12_SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT DISTINCT vec_id AS anchor_id, label, v FROM fine WHERE vec_id % 100 = 0),
scored AS (
  SELECT a.anchor_id, a.label, a.v, f.vec_id, f.label = a.label AS alike,
    CAST(list_dot_product(a.v, f.v) AS BIGINT) AS score
  FROM anchors a JOIN fine f ON f.vec_id <> a.anchor_id AND len(f.v) = len(a.v)),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id, label, v ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE alike QUALIFY place <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.label, p.v, p.place ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND n.label = p.label AND n.v = p.v AND NOT n.alike
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10"""
