"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the id), so equal texts lie
together.  The splitters between shards are found by rounds: each round counts
exact bytes in the cells of a finer grid, only inside the cells that still hold
a splitter, and stops when the cell is within the tolerance.  Rows move once,
when the splitters are known.  The law is ``bytes``: shards have nearly equal
bytes.  A group of equal texts is cut only if it is heavier than
``group_share`` of a shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

SHARDS = 24
TOLERANCE = 0.002
GROUP_SHARE = 0.02
# Bits of the key that one round refines; the driver sees at most shards * 2^BITS counts.
BITS = 12
# Rows that one task numbers inside a shard.
BLOCK_ROWS = 50_000
_LEAST_BLOCKS = 16
_TOP = -(1 << 63)


def keys(text: Column, doc_id: Column) -> tuple[Column, Column]:
    """Two signed 64-bit words; equal texts share the first."""
    return F.xxhash64(text), F.xxhash64(doc_id.cast("string"), F.lit("shard"))


def _cell(key: Column, bits: int) -> Column:
    """The leading ``bits`` of a key in signed order, as a number from 0."""
    flipped = key.bitwiseXOR(F.lit(_TOP).cast("long"))
    return F.shiftrightunsigned(flipped, 64 - bits) if bits else F.lit(0).cast("long")


def _edge(cell: int, bits: int) -> int:
    """The first signed key of a cell."""
    return (cell << (64 - bits)) + _TOP


def splitters(slim: DataFrame, shards: int = SHARDS, tolerance=TOLERANCE, group_share=GROUP_SHARE):
    """``shards - 1`` keys (k1, k2); a row at or above one is past that border.

    ``slim`` has k1, k2 and size.  The second word stays at its least value
    unless a group of equal texts must be cut.
    """
    total = slim.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    todo = {s: (0, 0, None, 0) for s in range(1, shards)}  # bytes before the cell, cell, text key, bits
    done: dict[int, tuple[int, int]] = {}
    while todo and total:
        wanted = sorted({(one, cell, bits) for _, cell, one, bits in todo.values()}, key=str)
        parts = []
        for n, (one, cell, bits) in enumerate(wanted):
            word = F.col("k1") if one is None else F.col("k2")
            inside = _cell(word, bits) == cell
            parts.append((n, inside if one is None else inside & (F.col("k1") == one), word, min(BITS, 64 - bits) + bits))
        which = reduce(lambda acc, p: acc.when(p[1], F.lit(p[0])), parts[1:], F.when(parts[0][1], F.lit(parts[0][0])))
        fine = reduce(lambda acc, p: acc.when(p[1], _cell(p[2], p[3])), parts[1:], F.when(parts[0][1], _cell(parts[0][2], parts[0][3])))
        rows = (
            slim.select(which.alias("n"), fine.alias("cell"), "size")
            .filter(F.col("n").isNotNull())
            .groupBy("n", "cell")
            .agg(F.sum("size").alias("size"))
            .collect()
        )
        counts: dict[int, list] = {}
        for r in rows:
            counts.setdefault(r["n"], []).append((r["cell"] % (1 << 64), r["size"]))
        left = {}
        for s, (before, cell, one, bits) in todo.items():
            n = wanted.index((one, cell, bits))
            fine_bits = parts[n][3]
            goal = total * s / shards
            low = before
            for at, size in sorted(counts[n]):
                if low + size > goal:
                    break
                low += size
            last = fine_bits == 64
            close = size <= tolerance * share or (last and one is None and size <= group_share * share)
            if close or (last and one is not None):
                past = goal - low > low + size - goal
                edge = min(_edge(at, fine_bits) + (past << (64 - fine_bits)), (1 << 63) - 1)
                done[s] = (edge, _TOP) if one is None else (one, edge)
            elif last:
                left[s] = (low, 0, _edge(at, 64), 0)
            else:
                left[s] = (low, at, one, fine_bits)
        todo = left
    return [done[s] for s in sorted(done)]


def shard(docs: DataFrame, shards: int = SHARDS, tolerance=TOLERANCE, group_share=GROUP_SHARE) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    ``docs`` needs doc_id and text; other columns pass through unless they bear
    one of the new names.  A NULL text has 8 bytes and the checksum of no bytes;
    rows that repeat get slots of their own; an empty table gives no rows.  Slots
    count from 0 in each shard without gaps.  ``grown_shard`` is NULL under this law.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    k1, k2 = keys(F.col("text"), F.col("doc_id"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(8)
    keyed = docs.select(
        *kept,
        size.alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        k1.alias("k1"),
        k2.alias("k2"),
    )
    slim = common.stored(keyed.select("k1", "k2", "size"), "shard-keys")
    borders = splitters(slim, shards, tolerance, group_share)
    blocks = max(_LEAST_BLOCKS, -(-slim.count() // (shards * BLOCK_ROWS)))

    def placed(df: DataFrame) -> DataFrame:
        past = [(F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b)) for a, b in borders]
        number = reduce(lambda x, y: x + y, [p.cast("int") for p in past], F.lit(0))
        block = F.pmod(F.shiftrightunsigned("k2", 1), F.lit(blocks)).cast("int")
        return df.withColumn("shard", number).withColumn("__block", block)

    counts = placed(slim).groupBy("shard", "__block").agg(F.count("*").alias("__rows"))
    earlier = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "__block", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("shard", "__block").orderBy("k1", "k2")
    numbered = placed(keyed).withColumn("__n", F.row_number().over(inside) - 1)
    out = numbered.join(bases, ["shard", "__block"], "left")
    return out.select(
        *kept,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("__base") + F.col("__n")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One folder per shard, each in as many files as its rows need, in slot order."""
    part = F.floor(F.col("slot") / BLOCK_ROWS)
    sharded.repartition("shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.plain(common.table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
