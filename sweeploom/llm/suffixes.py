"""Removal of long repeated byte strings by a blockwise suffix array.

A window is a string of LENGTH bytes of one text; every byte of a window that
also starts elsewhere is removed.  Suffixes are dealt to buckets by content:
each window looks at the GRAM-byte strings inside it and belongs to the bucket
of the one with the smallest hash (its anchor), so equal windows always share
a bucket.  Neighbouring windows of one anchor travel together as a segment.
Buckets whose anchor occurs once hold no repeats and are dropped; segments that
occur twice as a whole are repeats without sorting.

What is left is sorted one block of buckets at a time.  In a block, the suffixes
at positions of a difference cover (6 of every 31) are ranked first, by their
first bytes and then by doubling.  The other suffixes are sorted by their first
bytes; longer ties are resolved by comparing the ranks of the two cover
positions at the same distance behind them, which every pair of suffixes has
within 30 bytes.  Neighbours in this order that agree in LENGTH bytes are
repeats.  Memory is bounded by the block, not by the corpus or by the ties.

A bucket with more than CROWD different segments is split: windows at the same
distance from the anchor go together in strips of STRIP windows, each strip to
the bucket of the bytes that all its windows share.  Strips that recur as a whole
are repeats without sorting, and one of each stays.  A bucket that still has more
than CROWD different strips is split to the end, into single windows, each known by
two hashes of all its bytes; no bucket grows with the copies of a passage.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common

LENGTH = 400
GRAM = 32
CYCLE = 31
COVER = (1, 5, 11, 24, 25, 27)  # differences modulo 31 give every number from 0 to 30
PART_BYTES = 1 << 20
# Texts whose windows are looked at together: a task holds about 70 bytes for each byte of them.
SCAN_BYTES = 1 << 18
BLOCK_BYTES = 1 << 20
CROWD = 1_000
STRIP = 32
# Keys that the rows of one recurring strip or window are spread over.
SALTS = 16
_PLACE_BITS = np.uint64(24)

_IN_COVER = np.zeros(CYCLE, bool)
_IN_COVER[list(COVER)] = True
# For two positions modulo CYCLE: the distance at which both reach the cover.
_DISTANCE = np.array(
    [
        [next(d for d in range(CYCLE) if _IN_COVER[(i + d) % CYCLE] and _IN_COVER[(j + d) % CYCLE]) for j in range(CYCLE)]
        for i in range(CYCLE)
    ]
)


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by minima from both sides of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """Runs of windows with one anchor: arrays (text, first window, windows, anchor distance, anchor hash, segment hash).

    Positions count from the start of the text; ``data`` holds less than 2^24 bytes.
    """
    none = np.zeros(0, np.int64)
    gram = min(GRAM, length)
    if len(data) < length:
        return none, none, none, none, none, none
    sums = common.prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    hashes = common.span_hashes(sums, at, at + gram)
    key = (hashes >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
    anchor = (_sliding_minimum(key, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    own = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= ends[own + 1]
    first = valid.copy()
    first[1:] &= ~(valid[:-1] & (anchor[1:] == anchor[:-1]))
    start = np.flatnonzero(first)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    last = np.flatnonzero(stop)
    whole = common.span_hashes(sums, start, last + length)
    text = own[start]
    return text, start - ends[text], last - start + 1, anchor[start] - start, hashes[anchor[start]].view(np.int64), whole.view(np.int64)


def _long_text(data: np.ndarray, length: int):
    """``segments`` of one long text, by slices of windows that overlap in bytes."""
    found = []
    for at in range(0, max(len(data) - length + 1, 1), PART_BYTES):
        piece = data[at : at + PART_BYTES + length - 1]
        made = segments(piece, np.array([0, len(piece)]), length)
        found.append((made[0], made[1] + at, *made[2:]))
    return tuple(np.concatenate(x) for x in zip(*found))


_FOUND = "k1 long, k2 long, start int, windows int, distance int, anchor long, whole long, times int"


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """Segments of all texts.  A segment that recurs inside its text comes once, with
    its number, and its windows come as finished spans (times 0, windows up to the end)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, data, ends in common.parts(batch.column(0), SCAN_BYTES):
                long = hi - lo == 1 and len(data) > 2 * PART_BYTES
                text, start, windows, distance, anchor, whole = (
                    _long_text(data, length) if long else segments(data, ends, length)
                )
                order = np.lexsort((start, whole, text))
                t, w = text[order], whole[order]
                fresh = np.ones(len(t), bool)
                fresh[1:] = (t[1:] != t[:-1]) | (w[1:] != w[:-1])
                lead = np.flatnonzero(fresh)
                times = np.diff(np.append(lead, len(t)))
                pick = order[lead]
                again = np.sort(order[np.repeat(times, times) > 1])
                # Spans of recurring segments, joined where they touch.
                a, b, own = start[again], start[again] + windows[again] - 1 + length, text[again]
                cut = np.ones(len(again), bool)
                if len(again):
                    cut[1:] = (own[1:] != own[:-1]) | (a[1:] > np.maximum.accumulate(b + own * (1 << 40))[:-1] - own[1:] * (1 << 40))
                s = np.flatnonzero(cut)
                spans = (own[s], a[s], np.maximum.reduceat(b, s) if len(s) else b)
                rows = np.concatenate([text[pick], spans[0]]) + lo
                zero = np.zeros(len(s), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k1[rows]),
                        pa.array(k2[rows]),
                        pa.array(np.concatenate([start[pick], spans[1]]).astype(np.int32)),
                        pa.array(np.concatenate([windows[pick], spans[2] - spans[1]]).astype(np.int32)),
                        pa.array(np.concatenate([distance[pick], zero]).astype(np.int32)),
                        pa.array(np.concatenate([anchor[pick], zero])),
                        pa.array(np.concatenate([whole[pick], zero])),
                        pa.array(np.concatenate([times, zero]).astype(np.int32)),
                    ],
                    names=["k1", "k2", "start", "windows", "distance", "anchor", "whole", "times"],
                )

    return docs.filter(F.octet_length("text") >= length).select("text", "k1", "k2").mapInArrow(common.lean(run), _FOUND)


_PIECE = "bucket long, strip boolean, whole long, k1 long, k2 long, start int, windows int, bytes binary"


def _pieces(batches, length: int):
    """Strings to sort: (bucket, strip, hash of the string, k1, k2, start, windows, bytes), some MB at a time."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["bucket", "strip", "whole", "k1", "k2", "start", "windows", "bytes"]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def digest(data: bytes, key: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=key).digest(), "little", signed=True)

    rows, size = [], 0
    for batch in batches:
        k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for lo, hi, data, ends in common.parts(batch.column(0), PART_BYTES):
            for i, wanted in enumerate(batch.column(3).slice(lo, hi - lo).to_pylist()):
                text, own = data[ends[i] : ends[i + 1]], (int(k1[lo + i]), int(k2[lo + i]))
                for w in wanted:
                    start, windows = w["start"], w["windows"]
                    if not w["crowded"]:
                        string = text[start : start + windows - 1 + length].tobytes()
                        rows.append((w["anchor"], False, 0, *own, start, windows, string))
                        size += len(string)
                    at = 0 if w["crowded"] else windows
                    while at < windows:
                        far = w["distance"] - at  # of the anchor from this window
                        strip, left = divmod(far, STRIP)
                        take = min(left + 1, windows - at)
                        middle = start + at + left  # the last window of the strip
                        shared = text[middle : middle - STRIP + 1 + length].tobytes()
                        string = text[start + at : start + at + take - 1 + length].tobytes()
                        bucket = digest(shared, strip.to_bytes(4, "little"))
                        rows.append((bucket, True, digest(string, b"whole"), *own, start + at, take, string))
                        size += len(string)
                        at += take
                    if size >= PART_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
    if rows:
        yield packed(rows)


def _single_windows(batches, length: int):
    """Every window of the strips: (h1, h2, k1, k2, start), with two hashes of its bytes."""
    import pyarrow as pa

    for batch in batches:
        k1, k2, start, windows = (batch.column(c).to_numpy() for c in range(4))
        for lo, hi, data, ends in common.parts(batch.column(4), PART_BYTES // 8):
            count = windows[lo:hi].astype(np.int64)
            own = np.repeat(np.arange(hi - lo), count)
            step = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            at = ends[own] + step
            ahead = common.span_hashes(common.prefix_sums(data), at, at + length)
            behind = common.span_hashes(common.prefix_sums(data[::-1]), len(data) - at - length, len(data) - at)
            columns = [ahead.view(np.int64), behind.view(np.int64), k1[lo:hi][own], k2[lo:hi][own], (start[lo:hi][own] + step).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "k1", "k2", "start"])


def _of_recurring(rows: DataFrame, recurring: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose key is one of ``recurring``; the rows of a key are spread over SALTS keys."""
    salts = recurring.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("k1", "start"), F.lit(SALTS)).cast("int")).join(salts, [*keys, "salt"])


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number that sorts like them."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | text[at + j]
    return out


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of rows sorted by ``order``; equal keys share a rank."""
    step = np.zeros(len(order), np.int64)
    for k in keys:
        k = k[order]
        step[1:] |= k[1:] != k[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def cover_ranks(text: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Rank of the suffix at each cover position below ``size``, to ``depth`` bytes at least; -1 elsewhere.

    ``text`` is padded with zeros beyond ``size`` by 2 * CYCLE bytes.
    """
    at = np.arange(size)
    at = at[_IN_COVER[at % CYCLE]]
    keys = [_words(text, at + 8 * j) for j in range(4)]
    rank = _dense(np.lexsort(keys[::-1]), *keys)
    whole = np.full(size + CYCLE, -1, np.int64)
    known, reach = CYCLE, CYCLE
    while known < depth:
        whole[at] = rank
        beyond = at + reach
        next_rank = np.where(beyond < size, whole[np.minimum(beyond, size + CYCLE - 1)], -1) + 1
        key = (rank << 32) | next_rank
        rank = _dense(np.argsort(key, kind="stable"), key)
        known, reach = known * 2, reach * 2
    whole[at] = rank
    return whole


def suffix_order(text: np.ndarray, size: int, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ``start`` in order to ``depth`` bytes, and True where one shares its first bytes with the one before."""
    rank = cover_ranks(text, size, depth)
    keys = [_words(text, start + 8 * j) for j in range(4)]
    order = np.lexsort(keys[::-1])
    same = np.zeros(len(order), bool)
    same[1:] = True
    for k in keys:
        k = k[order]
        same[1:] &= k[1:] == k[:-1]
    out = start[order]
    # Groups of equal first bytes, split around a pivot until each is resolved.
    group = np.cumsum(~same)
    count = np.bincount(group, minlength=(group[-1] + 1) if len(group) else 1)
    active = np.flatnonzero(count[group] > 1)
    label = group[active]
    while len(active):
        edge = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        sizes = np.diff(np.append(edge, len(label)))
        pivot = np.repeat(out[active[edge + sizes // 2]], sizes)
        mine = out[active]
        ahead = _DISTANCE[mine % CYCLE, pivot % CYCLE]
        sign = np.sign(rank[mine + ahead] - rank[pivot + ahead]) + 1
        group_number = np.repeat(np.arange(len(edge)), sizes)
        key = group_number * 3 + sign
        move = np.argsort(key, kind="stable")
        out[active] = mine[move]
        key = key[move]
        keep_count = np.bincount(key, minlength=3 * len(edge))
        stay = (key % 3 != 1) & (keep_count[key] > 1)
        active, label = active[stay], key[stay]
    return out, same


def repeated_windows(strings: list[bytes], windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For joined windows of all strings: True where the same window starts elsewhere in them."""
    sizes = np.array([len(s) for s in strings], np.int64)
    size = int(sizes.sum())
    text = np.zeros(size + 2 * CYCLE + length, np.uint8)
    text[:size] = np.frombuffer(b"".join(strings), np.uint8)
    base = np.cumsum(sizes) - sizes
    first = np.cumsum(windows) - windows
    start = np.arange(int(windows.sum())) - np.repeat(first, windows) + np.repeat(base, windows)
    order, same = suffix_order(text, size, start, max(length, CYCLE))
    equal = same.copy()
    pair = np.flatnonzero(equal)
    for j in [*range(0, length - 7, 8), max(length - 8, 0)]:
        good = _words(text, order[pair] + j) == _words(text, order[pair - 1] + j)
        equal[pair[~good]] = False
        pair = pair[good]
    number = np.full(size, -1, np.int64)
    number[start] = np.arange(len(start))
    marked = np.zeros(len(start), bool)
    hit = np.flatnonzero(equal)
    marked[number[order[hit]]] = True
    marked[number[order[hit - 1]]] = True
    return marked


def _sorted_blocks(batches, length: int):
    """Spans (k1, k2, start, end) of repeats, from pieces in the order of their bucket."""
    import pyarrow as pa

    held: list[tuple] = []
    size = 0

    def flush():
        windows = np.array([h[4] for h in held], np.int64)
        marked = repeated_windows([h[5] for h in held], windows, length)
        own = np.repeat(np.arange(len(held)), windows)
        place = np.arange(len(marked)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin, stop = marked.copy(), marked.copy()
        begin[1:] &= ~(marked[:-1] & (own[1:] == own[:-1]))
        stop[:-1] &= ~(marked[1:] & (own[1:] == own[:-1]))
        b, e = np.flatnonzero(begin), np.flatnonzero(stop)
        who = own[b]
        start = np.array([h[3] for h in held], np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.array([h[1] for h in held], np.int64)[who]),
                pa.array(np.array([h[2] for h in held], np.int64)[who]),
                pa.array((start[who] + place[b]).astype(np.int32)),
                pa.array((start[who] + place[e] + length).astype(np.int32)),
            ],
            names=["k1", "k2", "start", "stop"],
        )

    bucket = None
    for batch in batches:
        for lo, hi, _, _ in common.parts(batch.column(5), BLOCK_BYTES):
            for row in zip(*[c.to_pylist() for c in batch.slice(lo, hi - lo).columns]):
                if row[0] != bucket and size >= BLOCK_BYTES:
                    yield flush()
                    held, size = [], 0
                bucket = row[0]
                held.append(row)
                size += len(row[5])
    if held:
        yield flush()


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, spans): by hashes of the text, the sorted spans [start, stop) to remove; they may overlap."""
    found = common.stored(_scan(docs, length), "suffix-segments")
    segment = found.filter("times > 0")
    often = segment.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor")
    open_ = common.stored(segment.join(often, "anchor"), "suffix-candidates")
    different = common.stored(
        open_.groupBy("anchor", "whole").agg(
            F.sum("times").alias("times"), F.min(F.struct("k1", "k2", "start", "windows", "distance")).alias("at")
        ),
        "suffix-different",
    )
    twice = different.filter("times > 1").select("anchor", "whole")
    decided = open_.join(twice, ["anchor", "whole"]).select(
        "k1", "k2", "start", (F.col("start") + F.col("windows") - 1 + length).alias("stop")
    )
    direct = found.filter("times = 0").select("k1", "k2", "start", (F.col("start") + F.col("windows")).alias("stop"))
    mixed = different.groupBy("anchor").agg(F.count("*").alias("n"), F.min("times").alias("least"))
    mixed = mixed.filter("n > 1 and least = 1").select("anchor", (F.col("n") > CROWD).alias("crowded"))
    wanted = different.join(mixed, "anchor").select(
        "at.k1", "at.k2", F.struct("anchor", "at.start", "at.windows", "at.distance", "crowded").alias("w")
    )
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))
    texts = docs.filter(F.octet_length("text") >= length).select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    asked = texts.join(wanted, ["k1", "k2"]).select("text", "k1", "k2", "wanted")
    pieces = common.stored(asked.mapInArrow(common.lean(lambda b: _pieces(b, length)), _PIECE), "suffix-pieces")
    strips = pieces.filter("strip")
    place = ["k1", "k2", "start"]
    stop = (F.col("start") + F.col("windows") - 1 + length).alias("stop")
    kinds = strips.groupBy("bucket", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*place, "windows")).alias("at"))
    kinds = common.stored(kinds, "suffix-strips")
    known = _of_recurring(strips.drop("bytes"), kinds.filter("n > 1"), ["bucket", "whole"]).select(*place, stop)
    full = kinds.groupBy("bucket").agg(F.count("*").alias("different")).filter("different > 1")
    sorted_alone = kinds.select("bucket", "at.*").join(full.filter(F.col("different") <= CROWD), "bucket")
    split_up = kinds.select("bucket", "at.*").join(full.filter(F.col("different") > CROWD), "bucket")
    keys = ["bucket", *place, "windows"]
    columns = [*keys, "bytes"]
    blocks = pieces.filter("not strip").select(*columns).unionByName(strips.join(sorted_alone.select(*keys), keys).select(*columns))
    blocks = blocks.repartition("bucket").sortWithinPartitions("bucket")
    sorted_ = common.stored(
        blocks.mapInArrow(common.lean(lambda b: _sorted_blocks(b, length)), "k1 long, k2 long, start int, stop int"), "suffix-sorted"
    )
    single = strips.join(split_up.select(*keys), keys).select(*place, "windows", "bytes").mapInArrow(
        common.lean(lambda b: _single_windows(b, length)), "h1 long, h2 long, k1 long, k2 long, start int"
    )
    twice_there = single.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    lone = _of_recurring(single, twice_there, ["h1", "h2"]).select(*place, (F.col("start") + length).alias("stop"))
    spans = direct.unionByName(decided).unionByName(known).unionByName(lone).unionByName(sorted_).distinct()
    return spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with two hashes of the text (NULL counts as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("suffix"), text)})


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep=None) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256, removed and kept_text.

    ``removed`` has the maximal removed spans; ``kept_text`` is the rest, without
    bytes of characters that a cut left incomplete (NULL stays NULL).  A NULL text
    counts as empty; rows that repeat remove each other wholly if they are long
    enough; columns that bear a new name are replaced; an empty table gives no rows.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept_text"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    others = [c for c in keep if c != "text"]
    data = keyed(docs.select(F.col("text"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("__row")))
    spans = repeated_spans(data, length)
    both = data.join(spans, ["k1", "k2"], "left")
    fields = [
        T.StructField("__row", data.schema["__row"].dataType),
        *([docs.schema["text"]] if "text" in keep else []),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("removed", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("kept_text", T.StringType()),
    ]
    whole = "text" in keep

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())), pa.string()]
        for batch in batches:
            present = common.text_bytes(batch.column(0))[2]
            for lo, hi, raw, ends in common.parts(batch.column(0)):
                made = [[] for _ in range(6)]
                for i, spans in enumerate(batch.column(2).slice(lo, hi - lo).to_pylist()):
                    data = raw[ends[i] : ends[i + 1]].tobytes()
                    runs: list[list[int]] = []
                    for s in spans or ():
                        if runs and s["start"] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], s["stop"])
                        else:
                            runs.append([s["start"], s["stop"]])
                    edges = [0, *[x for r in runs for x in r], len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else data
                    digest = hashlib.sha256(kept).hexdigest()
                    text = kept.decode("utf-8", "ignore") if present[lo + i] else None
                    for column, value in zip(made, (len(data), len(data) - len(kept), len(runs), digest, runs, text)):
                        column.append(value)
                arrays = [pa.array(m, k) for m, k in zip(made, kinds)]
                same = [batch.column(1).slice(lo, hi - lo), *([batch.column(0).slice(lo, hi - lo)] if whole else [])]
                yield pa.RecordBatch.from_arrays([*same, *arrays], names=[f.name for f in fields])

    out = both.select("text", "__row", "spans").mapInArrow(common.lean(run), T.StructType(fields))
    return out.select(*[F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in keep], *new)


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = remove_repeats(docs, keep=["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return cut.withColumn("has_repeat", F.col("n_removed") > 0)
