"""Near duplicates by bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles, as 64-bit hashes; its
sketch is the K smallest.  Documents with equal sets collapse first.  Inverted
lists of the retained values give the candidates: two sets that are alike share
many of their K values, so it is enough to look into the lists of the rarest
few of each document (prefix filter), which keeps common lines and phrases out.
The sketch of the union estimates the likeness of a candidate pair, and pairs
that pass are confirmed on the full sets.

Lists are first linked as stars around their most typical member.  Members of a
list that are still apart are then looked at with their full sets: shingles
that only one of them has rule out most, and what is left is compared with the
members of other components, so a large group of near copies costs about its
size, not its square.

The share of retained values that a true pair must have in common is LOSS_SIGMAS
standard deviations below its mean, so a pair is lost with a chance of about one
in a million; the shingle hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import common
from ..operators.pairs import connected_labels

WORDS = 5
PERCENT = 75
K = 64
LOSS_SIGMAS = 5.0
# Pairs whose estimate is below are not confirmed; 0.75 less about 4.6 standard deviations.
LEAST_ESTIMATE = 0.5
# Texts that are hashed together: a task holds about 20 bytes for each byte of them.
PART_BYTES = 1 << 20

_COEFFICIENTS = common.mix64(np.arange(1, WORDS + 2, dtype=np.uint64)) | np.uint64(1)


def _word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and their text numbers; long texts go in blocks cut at white space."""
    if len(data) <= 2 * common.BATCH_BYTES or len(ends) > 2:
        low = common.lower_ascii(data)
        start, end, own = common.word_spans(low, ends)
        return common.span_hashes(common.prefix_sums(low), start, end), own
    found, at = [], 0
    while at < len(data):
        to = min(at + common.BATCH_BYTES, len(data))
        while to < len(data) and data[to] not in b" \t\n\v\f\r":
            step = data[to : to + common.BATCH_BYTES]
            space = np.flatnonzero(common._SPACES[step])
            to += int(space[0]) if len(space) else len(step)
        found.append(_word_hashes(data[at:to], np.array([0, to - at]))[0] if to - at <= 2 * common.BATCH_BYTES else _one(data[at:to]))
        at = to
    hashes = np.concatenate(found)
    return hashes, np.zeros(len(hashes), np.int64)


def _one(data: np.ndarray) -> np.ndarray:
    """Hashes of a block that holds a word longer than a block."""
    low = common.lower_ascii(data)
    start, end, _ = common.word_spans(low, np.array([0, len(low)]))
    return common.span_hashes(common.prefix_sums(low), start, end)


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and the offsets of the texts."""
    n = len(ends) - 1
    word, own = _word_hashes(data, ends)
    count = np.bincount(own, minlength=n)
    with np.errstate(over="ignore"):
        total = np.zeros(max(len(word) - words + 1, 0), np.uint64)
        for j in range(words):
            total += word[j : j + len(total)] * _COEFFICIENTS[j]
        inside = own[: len(total)] == own[words - 1 :] if len(total) else np.zeros(0, bool)
        value, owner = common.mix64(total[inside]), own[: len(total)][inside]
        # Texts with fewer words are one shingle; its length keeps it apart.
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):
            first = np.searchsorted(own, short)
            whole = count[short].astype(np.uint64) * _COEFFICIENTS[words]
            for j in range(words - 1):
                has = count[short] > j
                whole[has] += word[first[has] + j] * _COEFFICIENTS[j]
            value = np.concatenate([value, common.mix64(whole)])
            owner = np.concatenate([owner, short])
    value = value.view(np.int64)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(n + 1))


def sketches(docs: DataFrame, words: int = WORDS, keep=("doc_id",)) -> DataFrame:
    """``keep`` columns, n (set size), s1 and s2 (hashes of the set), sketch (its K smallest values).

    NULL texts and texts without words have an empty set.
    """
    fields = [
        T.StructField("n", T.LongType()),
        T.StructField("s1", T.LongType()),
        T.StructField("s2", T.LongType()),
        T.StructField("sketch", T.ArrayType(T.LongType())),
    ]

    def run(column):
        import pyarrow as pa

        size, one, two, flat, lengths = [], [], [], [], []
        for lo, hi, data, ends in common.parts(column, PART_BYTES):
            value, at = shingle_sets(data, ends, words)
            sums = []
            for salt in (0x51, 0xA7):
                mixed = common.mix64(value.view(np.uint64) ^ np.uint64(salt << 40))
                with np.errstate(over="ignore"):
                    run_ = np.concatenate(([np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)))
                    sums.append((run_[at[1:]] - run_[at[:-1]]).view(np.int64))
            size.append(np.diff(at))
            one.append(sums[0])
            two.append(sums[1])
            kept = np.minimum(np.diff(at), K)
            place = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept) + np.repeat(at[:-1], kept)
            flat.append(value[place])
            lengths.append(kept)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(join(lengths)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(join(flat)))
        return [pa.array(join(size).astype(np.int64)), pa.array(join(one)), pa.array(join(two)), lists]

    return common.with_text_results(docs, keep, fields, run)


def full_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and shingles, the sorted distinct shingle hashes of the whole text."""

    def run(column):
        import pyarrow as pa

        flat, lengths = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for lo, hi, data, ends in common.parts(column, PART_BYTES):
            value, at = shingle_sets(data, ends, words)
            flat.append(value)
            lengths.append(np.diff(at))
        ends = np.cumsum(np.concatenate(lengths)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))]

    return common.with_text_results(docs, ["doc_id"], [T.StructField("shingles", T.ArrayType(T.LongType()))], run)


def _prefix_length(n: Column, percent: int) -> Column:
    """How many of the rarest retained values must be looked up."""
    share = percent / 100
    retained = F.least(n, F.lit(K))
    surest = F.ceil(n * percent / 100)
    slack = LOSS_SIGMAS * (K * share * (1 - share)) ** 0.5
    likely = F.lit(max(1, int(K * share - slack)))
    # Partners of a set of at most K * share shingles are retained whole.
    shared = F.when(n <= int(K * share), surest).otherwise(likely)
    return (retained - shared + 1).cast("int")


def _alike_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def estimated(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) whose union sketch does not rule them out."""
    one = sets.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    both = both.withColumn("u", union)
    shared = F.size(F.array_intersect(F.array_intersect("u", "sa"), F.col("sb")))
    return both.filter(shared >= F.size("u") * LEAST_ESTIMATE).select("a", "b")


def confirmed(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with 100 * intersection >= percent * union on the full sets."""
    one = whole.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa"))
    two = whole.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb"))
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("xa", "xb")).cast("long")
    both = both.withColumn("i", shared)
    return both.filter(F.col("i") * 100 >= (F.size("xa") + F.size("xb") - F.col("i")) * percent).select("a", "b")


def remaining(index: DataFrame, parts: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may still be alike.

    They share a list of the index.  The full sets rule out nearly all of them:
    shingles are ordered by how many of these documents have them, a pair must
    meet among the first few of both, and what follows the meeting place must
    suffice for the overlap it needs.
    """
    member = index.join(parts, F.col("rep") == F.col("node")).select("value", "rep", "label")
    mixed = member.groupBy("value").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y")
    apart = member.join(mixed.select("value"), "value", "left_semi").select("rep", "label").distinct()
    apart = common.stored(apart, "minhash-apart")
    each = whole.join(apart, F.col("doc_id") == F.col("rep")).select(
        "rep", "label", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle")
    )
    often = each.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")
    lists = each.join(often, "shingle").groupBy("rep", "label", "n").agg(
        F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("list")
    )
    # Shingles that no other document has come first in the order.
    lone = F.col("n") - F.size("list")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    lists = lists.withColumns({"lone": lone, "open": (first - lone).cast("int")}).filter("open > 0")
    placed = lists.select("rep", "label", "n", "lone", F.posexplode(F.slice("list", F.lit(1), F.col("open"))))
    placed = placed.select(
        "rep", "label", "n", F.col("col.shingle").alias("shingle"), (F.col("n") - F.col("lone") - F.col("pos")).alias("left")
    )
    placed = common.stored(placed, "minhash-places")
    count = placed.groupBy("shingle", "label").agg(F.count("*").alias("c"))
    main = count.groupBy("shingle").agg(F.max_by("label", "c").alias("main"), F.count("*").alias("labels"))
    placed = placed.join(main.filter("labels > 1").drop("labels"), "shingle")
    one = placed.filter("label != main").select(
        "shingle", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("left").alias("fa")
    )
    two = placed.select(
        "shingle", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("left").alias("fb"), "main"
    )
    needed = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    pairs = one.join(two, "shingle").filter(
        (F.col("la") != F.col("lb"))
        & ((F.col("lb") == F.col("main")) | (F.col("a") < F.col("b")))
        & _alike_sizes(F.col("na"), F.col("nb"), percent)
        & (F.least("fa", "fb") >= needed)
    )
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with two hashes of the whole row, NULLs by their place."""
    row = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return docs.withColumns({"__k1": F.xxhash64(*row), "__k2": F.xxhash64(F.lit("row"), *row)})


def _grouped(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """One row per row of ``rows`` (``keyed``): doc_id, __k1, __k2, n, first, rows.

    ``first`` is the smallest (none, doc_id, __k1, __k2) of its component, NULL ids
    last, and ``rows`` the number of rows there; both are NULL without words.
    """
    per_doc = common.stored(sketches(rows, words, ["doc_id", "__k1", "__k2"]), "minhash-sketches")
    # A set is known by a number, so rows of one doc_id with different texts stay apart.
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__k1", "__k2")
    sets = (
        per_doc.filter("n > 0")
        .groupBy("s1", "s2", "n")
        .agg(F.min(own).alias("least"), F.count("*").alias("rows"), F.first("sketch").alias("sketch"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    sets = common.stored(sets, "minhash-sets")
    values = sets.select("rep", "n", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("often")).filter("often > 1")
    shared = values.join(often, "value").groupBy("rep", "n").agg(
        F.sort_array(F.collect_list(F.struct("often", "value"))).alias("list"), F.sum("often").alias("typical")
    )
    retained = F.least(F.col("n"), F.lit(K)).cast("int")
    open_ = _prefix_length(F.col("n"), percent) - (retained - F.size("list"))
    index = (
        shared.withColumn("open", open_)
        .filter("open > 0")
        .select("rep", "n", "typical", F.explode(F.slice("list", F.lit(1), F.col("open"))).alias("e"))
        .select("rep", "n", "typical", F.col("e.value").alias("value"))
    )
    index = common.stored(index, "minhash-index")
    nodes = index.select(F.col("rep").alias("node")).distinct()
    # Stars: every member of a list with the member whose values are the most common.
    heads = index.groupBy("value").agg(
        F.max_by(F.struct("rep", "n"), F.struct("typical", -F.col("rep"))).alias("head"), F.count("*").alias("members")
    )
    heads = heads.filter("members > 1").select("value", F.col("head.rep").alias("b"), F.col("head.n").alias("nb"))
    stars = index.join(heads, "value").filter(F.col("rep") != F.col("b"))
    stars = stars.filter(_alike_sizes(F.col("n"), F.col("nb"), percent))
    stars = stars.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    likely = common.stored(estimated(stars, sets), "minhash-stars")
    # Full sets only of documents that have a candidate at all.
    asked = sets.join(nodes, F.col("rep") == F.col("node")).select(
        F.col("least.__k1").alias("__k1"), F.col("least.__k2").alias("__k2"), "rep"
    )
    texts = rows.select("text", "__k1", "__k2").join(asked, ["__k1", "__k2"]).select(F.col("rep").alias("doc_id"), "text")
    # Rows that repeat wholly have one set.
    whole = common.stored(full_sets(texts, words), "minhash-full").dropDuplicates(["doc_id"])
    links = common.stored(confirmed(likely, whole, percent), "minhash-star-links")
    parts = common.stored(connected_labels(nodes, links), "minhash-parts")
    more = common.stored(remaining(index, parts, whole, percent), "minhash-rest")
    if not more.isEmpty():
        links = common.stored(links.unionByName(confirmed(more, whole, percent)), "minhash-links")
        parts = common.stored(connected_labels(nodes, links), "minhash-labels")
    group = parts.join(sets.select("rep", "least", "rows"), F.col("node") == F.col("rep"))
    group = group.groupBy("label").agg(F.min("least").alias("first"), F.sum("rows").alias("together"))
    named = sets.join(parts.join(group, "label"), F.col("rep") == F.col("node"), "left").select(
        "s1", "s2", "n", F.coalesce("first", "least").alias("first"), F.coalesce("together", "rows").alias("rows")
    )
    out = per_doc.select("doc_id", "__k1", "__k2", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    return out.select("doc_id", "__k1", "__k2", "n", "first", "rows")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id,
    n_shingles, component_id, kept.

    A NULL text or one without words links with nothing; each row is linked by its
    own text; a component is named by its smallest doc_id that is not NULL, and all
    its rows of that doc_id are kept; an empty table gives no rows.
    """
    out = _grouped(keyed(docs.select("doc_id", "text")), words, percent)
    component = F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def survivors(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with exactly one row of each component, one of its smallest doc_id
    (NULL ids last); rows without words all stay."""
    rows = keyed(docs)
    found = _grouped(rows, words, percent).filter("n > 0 and rows > 1")
    stays = (F.col("__k1") == F.col("first.__k1")) & (F.col("__k2") == F.col("first.__k2"))
    fate = found.groupBy("__k1", "__k2").agg(F.max(stays).alias("stays"), F.count("*").alias("copies"))
    fate = common.stored(fate.filter("not stays or copies > 1"), "minhash-fate")
    left = rows.join(fate, ["__k1", "__k2"], "left_anti")
    again = fate.filter("stays").select("__k1", "__k2")
    if not again.isEmpty():  # of rows that repeat wholly one stays
        left = left.unionByName(rows.join(again, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
