"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs at line ends and sentence ends; each distinct
paragraph has a 64-bit digest.  A table has three sub-tables; a digest is
added to one cell of each, and a cell keeps a count, the XOR of its digests
and the XOR of their checks.  Two tables of one shape subtract cell by cell;
what is left is the difference of the two sets.  Peeling takes digests out of
cells that hold just one until all are empty, which gives the digests that
only one side has.  A table that cannot be peeled is built again larger.

Everything is column expressions: no row leaves the JVM.  Long texts use many
tables, one for each slice of digests, so work grows with the length.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common
from ..operators import ordered

SUBTABLES = 3  # bits 0 to 35 of a digest; the slices read bits 40 and 52 upwards
# Cells of a sub-table: of the fingerprint, and of the retries after it.
SIZES = (8, 16, 64)
# Digests for which one table is meant.
SLICE = 6
ROUNDS = 6
# Documents whose order one task sorts, unless there are more than MOST_CUTS times as many.
CHUNK_ROWS = 2_000
MOST_CUTS = 10_000
_LONG = "bigint"


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs; NULL and empty texts have none."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(". "), F.lit(".\n")), "\n")
    parts = F.filter(lines, lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _placed(digest: Column, sign: Column, size: int) -> Column:
    """A digest with its sign, its check and its cell in each sub-table.

    Each sub-table reads 12 bits of its own.
    """
    places = [
        (F.shiftrightunsigned(digest, 12 * t).bitwiseAND(F.lit(size - 1)) + F.lit(t * size)).cast("int").alias(f"p{t}")
        for t in range(SUBTABLES)
    ]
    return F.struct(sign.cast("int").alias("n"), digest.alias("d"), _check(digest).alias("c"), *places)


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _void() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast(_LONG).alias("d"), F.lit(0).cast(_LONG).alias("c"))


def _with(cell: Column, key: Column, count: Column) -> Column:
    return F.struct(
        count.cast("int").alias("n"),
        cell["d"].bitwiseXOR(key["d"]).alias("d"),
        cell["c"].bitwiseXOR(key["c"]).alias("c"),
    )


def table(items: Column, size: int) -> Column:
    """Cells of the digests: sub-table after sub-table."""
    # One element, so that places and checks are computed once for all cells.
    keyed = F.array(F.transform(items, lambda x: _placed(x, F.lit(1), size)))

    def filled(keys: Column) -> Column:
        def cells(t: int) -> Column:
            def cell(at: Column) -> Column:
                return F.aggregate(
                    keys, _void(), lambda acc, k: F.when(k[f"p{t}"] == at, _with(acc, k, acc["n"] + 1)).otherwise(acc)
                )

            return F.transform(F.sequence(F.lit(t * size), F.lit((t + 1) * size - 1)), cell)

        return F.concat(*[cells(t) for t in range(SUBTABLES)])

    return F.element_at(F.transform(keyed, filled), 1)


def subtracted(left: Column, right: Column) -> Column:
    return F.zip_with(
        left,
        right,
        lambda a, b: F.struct(
            (a["n"] - b["n"]).cast("int").alias("n"),
            a["d"].bitwiseXOR(b["d"]).alias("d"),
            a["c"].bitwiseXOR(b["c"]).alias("c"),
        ),
    )


def peeled(difference: Column, size: int) -> Column:
    """(only_left, only_right): digests of one side; NULL where peeling gets stuck."""
    none = F.array().cast("array<struct<n:int,d:bigint,c:bigint,p0:int,p1:int,p2:int>>")
    start = F.struct(difference.alias("cells"), none.alias("found"), F.lit(False).alias("done"))

    def pure(cells: Column) -> Column:
        lone = F.filter(cells, lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["d"])))
        keys = F.transform(lone, lambda c: _placed(c["d"], c["n"], size))
        # A digest alone in several cells is taken once.
        return F.array_distinct(keys)

    def taken(cells: Column, keys: Column) -> Column:
        def part(t: int) -> Column:
            def out(cell: Column, at: Column) -> Column:
                return F.aggregate(
                    keys,
                    cell,
                    lambda acc, k: F.when(k[f"p{t}"] == at + t * size, _with(acc, k, acc["n"] - k["n"])).otherwise(acc),
                )

            return F.transform(F.slice(cells, t * size + 1, size), out)

        return F.concat(*[part(t) for t in range(SUBTABLES)])

    def step(state: Column, _: Column) -> Column:
        # One element, so that the keys of a round are computed once.
        made = F.transform(
            F.array(pure(state["cells"])),
            lambda keys: F.when(
                F.size(keys) == 0,
                F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("done")),
            ).otherwise(
                F.struct(
                    taken(state["cells"], keys).alias("cells"),
                    F.concat(state["found"], keys).alias("found"),
                    F.lit(False).alias("done"),
                )
            ),
        )
        return F.when(state["done"], state).otherwise(F.element_at(made, 1))

    def summary(state: Column) -> Column:
        clean = F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["d"] == 0) & (c["c"] == 0))
        left = F.transform(F.filter(state["found"], lambda k: k["n"] > 0), lambda k: k["d"])
        right = F.transform(F.filter(state["found"], lambda k: k["n"] < 0), lambda k: k["d"])
        return F.when(clean, F.struct(left.alias("only_left"), right.alias("only_right")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, summary)


def cuts_for(left: Column, right: Column) -> Column:
    """Logarithm of the number of slices that leaves at most SLICE digests in one on average."""
    most = F.greatest(F.size(left), F.size(right), F.lit(1)) / F.lit(float(SLICE))
    return F.greatest(F.ceil(F.log2(most)), F.lit(0)).cast(_LONG)


def differing(left: Column, right: Column, first: Column, second: Column) -> Column:
    """(only_left, only_right) of two sets of digests, by tables that grow until one peels.

    The sets are cut twice, ``first`` and ``second`` times, both columns with a
    power of two; both cuts read bits of their own.  A slice that no size
    resolves (three digests that share all their cells in the largest one) is
    compared as plain sets.
    """

    def sliced(pairs: Column, cuts: Column, shift: int) -> Column:
        def one(pair: Column) -> Column:
            def part(at: Column) -> Column:
                def mine(x: Column) -> Column:
                    return F.shiftrightunsigned(x, shift).bitwiseAND(cuts - 1) == at

                return F.struct(F.filter(pair["a"], mine).alias("a"), F.filter(pair["b"], mine).alias("b"))

            return F.transform(F.sequence(F.lit(0).cast(_LONG), cuts - 1), part)

        return F.flatten(F.transform(pairs, one))

    def resolved(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        tries = [peeled(subtracted(table(a, s), table(b, s)), s) for s in SIZES]
        plain = F.struct(F.array_except(a, b).alias("only_left"), F.array_except(b, a).alias("only_right"))
        return F.coalesce(*tries, plain)

    pairs = sliced(sliced(F.array(F.struct(left.alias("a"), right.alias("b"))), first, 52), second, 40)
    # One element, so that the slices are resolved once for both sides.
    found = F.array(F.transform(pairs, resolved))

    def joined(each: Column) -> Column:
        return F.struct(
            F.flatten(F.transform(each, lambda f: f["only_left"])).alias("only_left"),
            F.flatten(F.transform(each, lambda f: f["only_right"])).alias("only_right"),
        )

    return F.element_at(F.transform(found, joined), 1)


def likeness(left: Column, right: Column, difference: Column) -> Column:
    """Shared paragraphs over all paragraphs, from the recovered differences; 1 for two empty sets."""
    shared = F.size(left) - F.size(difference["only_left"])
    union = F.size(left) + F.size(difference["only_right"])
    return F.when(union > 0, shared / union).otherwise(F.lit(1.0))


def as_text(items: Column) -> Column:
    """The table of the first size: per cell the count, and digests and checks in hexadecimal."""

    def cell(c: Column) -> Column:
        return F.concat_ws(".", c["n"].cast("string"), F.hex(c["d"]), F.hex(c["c"].bitwiseAND(F.lit(0xFFFF).cast(_LONG))))

    return F.lower(F.array_join(F.transform(table(items, SIZES[0]), cell), "-"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, own) with ``next`` and ``next_own`` of the next doc_id; after the last comes the first.

    Equal ids are ordered by their text's hash; a NULL id comes first.  The
    order is cut at quantiles of the ids, so no task sorts the whole table.
    """
    rows = docs.count()
    cuts = max(1, min(MOST_CUTS, -(-rows // CHUNK_ROWS)))
    edges = docs.stat.approxQuantile("doc_id", [i / cuts for i in range(1, cuts)], 0.25 / cuts) if cuts > 1 else []
    splits = [float("-inf"), *sorted(set(edges)), float("inf")]
    data = docs.withColumn("__place", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    if len(splits) > 2:
        data = Bucketizer(splits=splits, inputCol="__place", outputCol="__bucket").transform(data)
    else:
        data = data.withColumn("__bucket", F.lit(0.0))
    data = data.withColumn("__tie", F.xxhash64("text")).withColumn("__here", F.lit(True))
    after = {"__after": "text", "__after_own": "own", "__found": "__here"}
    out = ordered.following(data, [], ["doc_id", "__tie"], F.col("__bucket").cast("long"), after)
    first = docs.agg(F.min_by(F.struct("text", "own"), F.struct("doc_id", F.xxhash64("text"))).alias("__first"))
    out = out.crossJoin(F.broadcast(first))  # one row
    found = F.col("__found").isNotNull()
    return out.select(
        "doc_id",
        "text",
        "own",
        F.when(found, F.col("__after")).otherwise(F.col("__first")["text"]).alias("next"),
        F.when(found, F.col("__after_own")).otherwise(F.col("__first")["own"]).alias("next_own"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs.

    A NULL text counts as empty and has the fingerprint of no paragraphs; two
    empty sets are alike by 1; an empty table gives no rows.  The edited text has
    its last floor(n / 2) code points replaced by the first as many of the next.
    """
    empty = F.lit("")
    base = with_next(docs.select("doc_id", "text", digests(F.col("text")).alias("own"))).select(
        "doc_id", F.coalesce("text", empty).alias("text"), F.coalesce("next", empty).alias("next"), "own", "next_own"
    )
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next"), F.lit(1), half))
    base = base.withColumn("edited", edited)
    sets = base.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("own").alias("a"),
        digests(F.col("edited")).alias("e"),
        F.col("next_own").alias("n"),
    )
    sets = sets.withColumns({"ce": cuts_for(F.col("a"), F.col("e")), "cn": cuts_for(F.col("a"), F.col("n"))})

    def halved(k: str, round_) -> Column:
        return F.pow(F.lit(2.0), round_(F.col(k) / 2)).cast(_LONG)

    sets = sets.withColumns({f"{k}{i}": halved(k, r) for k in ("ce", "cn") for i, r in ((1, F.ceil), (2, F.floor))})
    compared = sets.withColumns(
        {
            "de": differing(F.col("a"), F.col("e"), F.col("ce1"), F.col("ce2")),
            "dn": differing(F.col("a"), F.col("n"), F.col("cn1"), F.col("cn2")),
        }
    )
    return compared.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("a")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e"), F.col("de")).alias("near_edited"),
        likeness(F.col("a"), F.col("n"), F.col("dn")).alias("near_next"),
        F.size("a").cast("long").alias("n_paragraphs"),
    )


def op4_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
