"""Alignment of the tokens of two tokenizers over the same bytes.

Both tokenizers encode a text, and each token covers a range of its bytes.  A
byte offset where tokens of both end is a shared cut.  Cuts are found by divide
and conquer: an interval looks at the end nearest to its middle, by bisection
in the other tokenizer's ends, and widens around the middle until it meets a
shared cut; both sides of what was looked at are intervals of the next level,
so no end is looked at twice.  An interval without a cut is a leaf, and the
tokens between two cuts are a group.  All intervals of a level and of a batch
of texts are searched together.

Counts of linked token pairs cover the corpus: they are summed from one row per
text and pair, and joined back to these rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from . import common

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PART_BYTES = 1 << 19
# Characters that a tokenizer gets at a time, where a text can be cut.
SEGMENT = 1 << 16
# Most rows of a table of pair counts that tasks share whole; a larger one is joined by key.
SHARED_PAIRS = 1_000_000
# Rows of one pair are spread over so many keys in that join.
SALTS = 32
_ID_BITS = 20
_CUT = re.compile(r"(?<=\S) (?=\S)")


def shared_cuts(a: np.ndarray, b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """True for every end of ``a`` within the intervals [start, stop) of its indexes that ``b`` has too."""
    cut = np.zeros(len(a), bool)

    def look(at: np.ndarray) -> np.ndarray:
        place = np.searchsorted(b, a[at])
        hit = b[np.minimum(place, len(b) - 1)] == a[at]
        cut[at[hit]] = True
        return hit

    def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = hi - lo
        own = np.repeat(np.arange(len(lo)), size)
        return np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + lo[own], own

    open_ = stop > start
    s, e = start[open_], stop[open_]
    while len(s):
        left = (s + e) >> 1
        right = left + 1
        wide = np.flatnonzero(~look(left) & (e - s > 1))
        reach = 1
        while len(wide):
            further_left = np.maximum(s[wide], left[wide] - reach)
            further_right = np.minimum(e[wide], right[wide] + reach)
            at, own = ranges(
                np.concatenate([further_left, right[wide]]), np.concatenate([left[wide], further_right])
            )
            found = np.zeros(len(wide), bool)
            found[own[look(at)] % len(wide)] = True
            left[wide], right[wide] = further_left, further_right
            wide = wide[~found & ((further_left > s[wide]) | (further_right < e[wide]))]
            reach *= 2
        s, e = np.concatenate([s, right]), np.concatenate([left, e])
        open_ = e > s
        s, e = s[open_], e[open_]
    return cut


class Vocabulary:
    """Bytes of every id, and how ids are written."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.empty = bool((self.sizes == 0).any())

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def written(self, plain: bytes, last: bytes) -> list[bytes]:
        """Each id followed by ``plain``, then each id followed by ``last``."""
        return [b"%d%s" % (i, end) for end in (plain, last) for i in range(len(self.pieces))]


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand
    for themselves, the others follow from 256 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


# How the first tokenizer's file says that it splits texts, and the words of that split.
_PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def disputed_characters() -> tuple[str, str]:
    """Patterns of the characters, up to U+FFFF and above, that libraries with other Unicode tables may class otherwise.

    A character that was a letter, a number or neither in the oldest table at
    hand and still is counts as settled; one without a meaning yet does not.
    """

    def kind(c: str) -> str:
        return c if c in "LN" else "-"

    def pattern(first: int, last: int) -> str:
        out, start = [], None
        for i in range(first, last + 2):
            now = unicodedata.category(chr(i)) if i <= last else "Lu"
            open_ = i <= last and (now == "Cn" or kind(now[0]) != kind(unicodedata.ucd_3_2_0.category(chr(i))[0]))
            if open_ and start is None:
                start = i
            elif not open_ and start is not None:
                out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
                start = None
        return f"[{''.join(out)}]"

    return pattern(0, 0xFFFF), pattern(0x10000, sys.maxunicode)


class Disputed:
    """Whether a text has a disputed character; most texts are told by their bytes alone."""

    def __init__(self, patterns: tuple[str, str]) -> None:
        self.low, self.high = map(re.compile, patterns)
        self.plain = not any(self.low.match(chr(i)) for i in range(256))

    def __contains__(self, text: str) -> bool:
        try:
            text.encode("latin-1")
            if self.plain:
                return False
        except UnicodeEncodeError:
            pass
        wide = len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text)
        return bool(self.low.search(text)) or (wide and bool(self.high.search(text)))


def _ranked(byte_model: str, pieces: list[bytes]):
    """A faster encoder of the same vocabulary, if its ids are the order of its merges; else None."""
    import tiktoken

    model = json.loads(byte_model)["model"]
    vocabulary = model.get("vocab", {})
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    in_order = all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    if model.get("type") != "BPE" or not in_order or any(len(p) != 1 for p in pieces[:256]):
        return None
    ranks = {pieces[i]: i for i in range(256 + len(merges))}
    return tiktoken.Encoding("pieces", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})


class Tokenizers:
    """Both tokenizers from the content of their files.

    Where the first file's ids are the order of its merges, texts of settled
    characters are coded by a faster library with that file's vocabulary; the
    tests hold it against the file's own tokenizer.
    """

    def __init__(self, byte_model: str, piece_model: bytes, disputed: tuple[str, str]) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task on a core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        letters = _byte_letters()
        named = {i: token for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        spelled = lambda t: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.va = Vocabulary([spelled(named.get(i, "")) for i in range(max(named, default=-1) + 1)])
        self.vb = Vocabulary([self._piece(i) for i in range(self.b.get_piece_size())])
        self.text_a = self.va.written(b",", b"|")
        self.text_b = self.vb.written(b",", b";")
        # The first tokenizer splits a text before a space between two words, and no piece of
        # the second has a space behind another character: there a text can be cut.
        split = json.loads(byte_model).get("pre_tokenizer") or {}
        self.fast, self.disputed = _ranked(byte_model, self.va.pieces) if split == _PLAIN_SPLIT else None, Disputed(disputed)
        words = split.get("type") == "ByteLevel" and split.get("use_regex", True)
        self.cuttable = words and not any(b" " in p.lstrip(b" ") for p in self.vb.pieces)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode()

    def segments(self, text: str) -> list[str]:
        """The text in cuts of about SEGMENT characters; the space of a cut is left out."""
        out, at = [], 0
        while self.cuttable and len(text) - at > SEGMENT:
            cut = _CUT.search(text, at + SEGMENT)
            if cut is None:
                break
            out.append(text[at : cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def first_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of space + text by the first tokenizer."""
        plain = [self.fast is not None and t not in self.disputed for t in texts]
        rest = self.a.encode_batch_fast([" " + t for t, p in zip(texts, plain) if not p], add_special_tokens=False)
        slow = iter(rest)
        return [self.fast.encode_ordinary(" " + t) if p else next(slow).ids for t, p in zip(texts, plain)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids of space + text by the first and of the text by the second tokenizer, and whether both give it back."""
        cuts = [self.segments(t) for t in texts]
        flat = [c for cut in cuts for c in cut]
        coded = []
        for lo, hi in common.by_bytes(flat, PART_BYTES):
            some = flat[lo:hi]
            for cut, a, b in zip(some, self.first_ids(some), self.b.encode(some, num_threads=1)):
                wanted = b" " + cut.encode()
                exact = self.va.joined(a) == wanted and self.vb.joined(b) == wanted
                coded.append((np.array(a, np.int32), np.array(b, np.int32), exact))
        first, out = np.cumsum([0, *map(len, cuts)]), []
        for i, j in zip(first[:-1], first[1:]):
            a, b, exact = zip(*coded[i:j])
            out.append((np.concatenate(a), np.concatenate(b), all(exact)))
        return out


class Aligned:
    """Tokens and groups of a batch of texts.

    ``ends_a`` and ``ends_b`` are the numbers of tokens up to the end of each
    group; ``first_*`` are offsets of the texts in the flat arrays.
    """

    def __init__(self, coders: Tokenizers, texts: list[str | None]) -> None:
        full = [i for i, t in enumerate(texts) if t]
        none = np.zeros(0, np.int32)
        ids_a, ids_b = [none] * len(texts), [none] * len(texts)
        for i, (a, b, exact) in zip(full, coders.encode([texts[i] for i in full])):
            if exact:
                ids_a[i], ids_b[i] = a, b
        self.first_a = np.cumsum([0, *map(len, ids_a)])
        self.first_b = np.cumsum([0, *map(len, ids_b)])
        self.a = np.concatenate([none, *ids_a]).astype(np.int64)
        self.b = np.concatenate([none, *ids_b]).astype(np.int64)
        end_a, end_b = np.cumsum(coders.va.sizes[self.a]), np.cumsum(coders.vb.sizes[self.b])
        cut = shared_cuts(end_a, end_b, self.first_a[:-1], np.maximum(self.first_a[1:] - 1, self.first_a[:-1]))
        some = self.first_a[1:] > self.first_a[:-1]
        cut[self.first_a[1:][some] - 1] = True  # both end with the text
        self.ends_a = np.flatnonzero(cut) + 1
        self.ends_b = np.searchsorted(end_b, end_a[self.ends_a - 1]) + 1
        self.first_group = np.searchsorted(self.ends_a, self.first_a, side="right")

    def digests(self, coders: Tokenizers) -> list[str]:
        """Lowercase hex SHA-256 of the groups as `a1,a2|b1;a3|b2,b3` for each text; '' without tokens."""
        na, nb = len(coders.va.pieces), len(coders.vb.pieces)
        groups = np.arange(len(self.ends_a))
        size_a, size_b = np.diff(self.ends_a, prepend=0), np.diff(self.ends_b, prepend=0)
        own_a, own_b = np.repeat(groups, size_a), np.repeat(groups, size_b)
        before_b, upto_a = self.ends_b - size_b, self.ends_a
        code = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.ends_a - 1] = True
        last_b[self.ends_b - 1] = True
        code[np.arange(len(self.a)) + before_b[own_a]] = self.a + na * last_a
        code[np.arange(len(self.b)) + upto_a[own_b]] = 2 * na + self.b + nb * last_b
        table = coders.text_a + coders.text_b
        places = self.first_a + self.first_b
        out = []
        for lo, hi in zip(places[:-1], places[1:]):
            text = b"".join(map(table.__getitem__, code[lo:hi].tolist()))
            out.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different linked pairs of each text: offsets by text, ids of a, ids of b, how often."""
        text = np.repeat(np.arange(len(self.first_group) - 1), np.diff(self.first_group))
        low = (1 << _ID_BITS) - 1
        key = (text << 2 * _ID_BITS) | (self.a[self.ends_a - 1] << _ID_BITS) | self.b[self.ends_b - 1]
        pair, times = np.unique(key, return_counts=True)
        offsets = np.searchsorted(pair >> 2 * _ID_BITS, np.arange(len(self.first_group)))
        return offsets, pair >> _ID_BITS & low, pair & low, times


_INTS = T.ArrayType(T.IntegerType())
_PAIR = T.StructType([T.StructField(c, T.IntegerType()) for c in ("a", "b", "times")])
FIELDS = {
    "n_a": T.LongType(),
    "n_b": T.LongType(),
    "n_groups": T.LongType(),
    "groups_sha256": T.StringType(),
    "links": T.ArrayType(_PAIR),
    "ids_a": _INTS,
    "ids_b": _INTS,
    "group_ends_a": _INTS,
    "group_ends_b": _INTS,
}


def align(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, keep=None, fields=tuple(FIELDS)) -> DataFrame:
    """``docs`` with the wanted ``fields``.

    ids_a and ids_b: the tokens of space + text and of the text; group_ends_a and
    group_ends_b: how many of them end with each group; links: the different
    pairs of tokens that end together, with how often; n_a, n_b, n_groups;
    groups_sha256.  NULL and empty texts, and texts that either tokenizer does not
    give back byte by byte, have no tokens: zeros, empty lists and ''.  Columns of
    ``docs`` that bear a wanted name are replaced; repeated rows stay.  The two
    files are read on the driver, and tasks get their content.
    """
    spark = docs.sparkSession
    with open(byte_model, encoding="utf-8") as a, open(piece_model, "rb") as b:
        content = (a.read(), b.read(), disputed_characters())
    shared = spark.sparkContext.broadcast(content)  # as long as the two vocabulary files
    held: dict[str, Tokenizers] = {}
    wanted = [T.StructField(f, FIELDS[f]) for f in fields]

    def run(column):
        import pyarrow as pa

        if not held:
            held["both"] = Tokenizers(*shared.value)
        coders = held["both"]
        made = Aligned(coders, column.to_pylist())
        group = made.first_group
        ints = lambda ends, flat: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        out = {f: pa.array(np.diff(x), pa.int64()) for f, x in (("n_a", made.first_a), ("n_b", made.first_b), ("n_groups", group))}
        if "groups_sha256" in fields:
            out["groups_sha256"] = pa.array(made.digests(coders), pa.string())
        if "links" in fields:
            offsets, *columns = made.links()
            pairs = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], ["a", "b", "times"])
            out["links"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
        out["ids_a"], out["ids_b"] = ints(made.first_a, made.a), ints(made.first_b, made.b)
        for f, first, ends in (("group_ends_a", made.first_a, made.ends_a), ("group_ends_b", made.first_b, made.ends_b)):
            out[f] = ints(group, ends - np.repeat(first[:-1], np.diff(group)))
        return [out[f] for f in fields]

    return common.with_text_results(docs, docs.columns if keep is None else keep, wanted, run, PART_BYTES)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): how often tokens are linked, and whether no partner of b is linked to it oftener."""
    counts = aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum("times").alias("count"))
    # At most one row for each entry of the first vocabulary is in a window.
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def scored(aligned: DataFrame, shared_pairs: int = SHARED_PAIRS) -> DataFrame:
    """``aligned`` (with links, and ``row`` that tells rows apart) with n_links, n_best and count_sum."""
    counts = common.stored(pair_counts(aligned), "links-counts")
    rest = [c for c in aligned.columns if c not in ("row", "links", "n_links", "n_best", "count_sum")]
    each = aligned.select("row", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("own"), F.explode_outer("links").alias("l"))
    each = each.select("row", "own", "l.*")
    if counts.count() <= shared_pairs:
        met = each.join(F.broadcast(counts), ["a", "b"], "left")
    else:
        spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(spread, ["a", "b", "salt"], "left")
    zero = F.lit(0).cast("long")
    sums = met.groupBy("row").agg(
        F.first("own").alias("own"),
        F.coalesce(F.sum("times"), zero).alias("n_links"),
        F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), zero).alias("n_best"),
        F.coalesce(F.sum(F.col("times") * F.col("count")), zero).alias("count_sum"),
    )
    return sums.select("own.*", "n_links", "n_best", "count_sum")


def op13_tokenlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    made = align(docs, keep=["doc_id"], fields=("n_a", "n_b", "n_groups", "groups_sha256", "links"))
    stored = common.stored(made.withColumn("row", F.monotonically_increasing_id()), "links-aligned")
    return scored(stored).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
