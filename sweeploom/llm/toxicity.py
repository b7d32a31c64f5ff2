"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample: one on ordinary
text, one on the fragments of toxic text that ordinary text lacks (byte
n-grams with high odds).  The toxic side compresses with both dictionaries
behind one another, so a window saves bytes only where toxic fragments occur.
All windows of a text are compressed both ways; the savings above a threshold
are its evidence, and a calibration on all labelled rows turns the evidence
into a score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common

THRESHOLD = 0.5
WINDOW = 56
OVERLAP = 12
# A window counts when it saves at least so many bytes.
LEAST_SAVING = 2
GRAMS = (5,)
# Bounds of the training sample: documents of each label, and bytes of each.
TOXIC_DOCS = 2_000
ORDINARY_DOCS = 4_000
SAMPLE_BYTES = 8_192
# An n-gram is toxic when its test statistic and its log odds are at least these.
LEAST_RATIO = 30.0
LEAST_ODDS = 3.5
# Longer runs are passages that copies of one toxic text share, not toxic words.
LONGEST = 20
TOXIC_DICT = 4_096
ORDINARY_DICT = 32_768
CELL = 1 / 64


def _grams(text: bytes, n: int) -> np.ndarray:
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    count = max(len(data) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out = (out << np.uint64(8)) | data[j : j + count]
    return out


def _in_texts(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams and the number of texts that have them, but no more than the
    number of different contexts they have on one side: passages that copies
    share come in one context, words in many."""
    found = [np.unique(_grams(t, n)) for t in texts]
    gram, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    wide = [_grams(t, 8) for t in texts]
    wide = np.unique(np.concatenate(wide)) if wide else gram
    most = np.zeros(len(gram), np.int64)
    for inner in (wide & np.uint64((1 << 8 * n) - 1), wide >> np.uint64(8 * (8 - n))):
        same, contexts = np.unique(inner, return_counts=True)
        at = np.searchsorted(gram, same)
        most[at] = np.maximum(most[at], contexts)
    return gram, np.minimum(count, np.maximum(most, 1))


def toxic_grams(toxic: list[bytes], ordinary: list[bytes], n: int) -> np.ndarray:
    """N-grams with high odds of a toxic text, by a likelihood-ratio test over texts."""
    gram, count = _in_texts(toxic, n)
    keep = count >= 3
    gram, count = gram[keep], count[keep]
    other, often = _in_texts(ordinary, n)
    at = np.minimum(np.searchsorted(other, gram), max(len(other) - 1, 0))
    base = np.where(other[at] == gram, often[at], 0) if len(other) else np.zeros(len(gram), np.int64)
    odds = np.log((count + 0.5) / (len(toxic) + 1)) - np.log((base + 0.5) / (len(ordinary) + 1))
    expected = (count + base) * (len(toxic) / (len(toxic) + len(ordinary)))
    rest = count + base - expected
    ratio = 2 * (count * np.log(count / expected) + base * np.log(np.maximum(base, 1) / rest))
    return gram[(ratio >= LEAST_RATIO) & (odds >= LEAST_ODDS)]


def fragments(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Maximal runs of toxic texts covered by n-grams that ordinary texts lack."""
    chosen = {n: toxic_grams(toxic, ordinary, n) for n in GRAMS}
    out = []
    for text in toxic:
        cover = np.zeros(len(text) + 1, np.int64)
        for n, grams in chosen.items():
            hit = np.flatnonzero(np.isin(_grams(text, n), grams))
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + n, -1)
        inside = np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(inside))
        out += [text[a:b] for a, b in zip(edge[::2], edge[1::2]) if b - a <= LONGEST]
    return out


def _dictionary(samples: list[bytes], size: int, unit: int) -> bytes:
    """Content chosen by the dictionary trainer; plain samples where there are too few to train."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=unit, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


class Distance:
    """The two dictionaries; compressors are made once per task."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]) -> None:
        found = fragments(toxic, ordinary)
        bundles = [b"".join(found[i : i + 8]) for i in range(0, len(found), 8)]
        pieces = [t[i : i + 256] for t in ordinary for i in range(0, len(t), 256)]
        self.ordinary = _dictionary(pieces[:20_000], ORDINARY_DICT, 32)
        self.toxic = _dictionary(bundles, TOXIC_DICT, 24)
        self.line = None
        self.flat = 0.0
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def _compressors(self):
        import zstandard as z

        if self._pair is None:
            options = z.ZstdCompressionParameters(
                window_log=17, hash_log=15, chain_log=15, search_log=3, min_match=4, strategy=z.STRATEGY_LAZY2,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            self._pair = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                if len(content) < 8:
                    self._pair.append(z.ZstdCompressor(compression_params=options))
                    continue
                d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=options)
                self._pair.append(z.ZstdCompressor(dict_data=d, compression_params=options))
        return self._pair

    def savings(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Bytes that the toxic side saves in each window."""
        import zstandard as z

        if not len(start):
            return np.zeros(0, np.int64)
        places = np.column_stack([start, length]).astype(np.uint64).tobytes()
        sizes = []
        for c in self._compressors():
            made = c.multi_compress_to_buffer(z.BufferWithSegments(data, places), threads=1)
            sizes.append(np.fromiter((len(made[i]) for i in range(len(made))), np.int64, len(made)))
        return sizes[0] - sizes[1]

    def evidence(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Per text: logarithm of the saved bytes a window, -4 where none is saved."""
        size = np.diff(ends)
        step = WINDOW - OVERLAP
        count = -(-size // step)
        own = np.repeat(np.arange(len(size)), count)
        first = np.concatenate(([0], np.cumsum(count)))[:-1]
        start = ends[:-1][own] + (np.arange(len(own)) - first[own]) * step
        length = np.minimum(WINDOW, ends[1:][own] - start)
        saved = np.zeros(len(size))
        for i in range(0, len(start), 16_384):
            part = self.savings(data, start[i : i + 16_384], length[i : i + 16_384])
            good = part >= LEAST_SAVING
            np.add.at(saved, own[i : i + 16_384][good], part[good])
        # Half a window is added below, so that one window of a short text weighs less.
        return np.log(saved / np.maximum(count + 2, 1) + np.exp(-4.0))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.line is None:
            return np.full(len(evidence), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.line[0] + self.line[1] * evidence, -40, 40)))


def train(docs: DataFrame, labels: DataFrame) -> Distance | None:
    """Dictionaries from a bounded sample of labelled rows outside the held-out fold."""
    rows = common.labelled(labels, "toxic")
    slack = F.greatest(F.octet_length("text") - F.lit(SAMPLE_BYTES), F.lit(0))
    place = F.floor(common.unit_hash(F.col("doc_id"), F.lit("place")) * slack).cast("int") + 1
    piece = F.col("text").cast("binary").substr(place, F.lit(SAMPLE_BYTES))
    texts = {}
    for label, most in ((1, TOXIC_DOCS), (0, ORDINARY_DOCS)):
        # The drawn ids are bounded by ``most``, so they go to the documents and no text moves.
        drawn = common.bounded(rows.filter(F.col("label") == label), "label", most, "toxicity").select("doc_id")
        found = docs.filter(F.col("text").isNotNull()).join(F.broadcast(drawn.distinct()), "doc_id")
        pieces = found.select("doc_id", piece.alias("piece")).collect()
        texts[label] = [bytes(r["piece"]) for r in sorted(pieces, key=lambda r: (str(r["doc_id"]), bytes(r["piece"])))]
    if not texts[0] or not texts[1]:
        return None
    return Distance(texts[1], texts[0])


def described(docs: DataFrame, model: Distance | None, keep) -> DataFrame:
    """``keep`` columns and evidence.  A NULL text counts as empty; without a model all evidence is alike."""

    def run(column):
        found = np.full(len(column), -4.0)
        if model is not None:
            for lo, hi, data, ends in common.parts(column):
                found[lo:hi] = model.evidence(data, ends)
        return [found]

    return common.with_text_results(docs, keep, [T.StructField("evidence", T.DoubleType())], run)


def calibrate(evidence: DataFrame, labels: DataFrame) -> tuple[np.ndarray | None, float]:
    """Line of a logistic regression over all labelled rows outside the held-out fold,
    from counts by cell of the evidence; a constant where a class is missing."""
    rows = evidence.join(common.labelled(labels, "toxic"), "doc_id")
    cell = F.round(F.col("evidence") / CELL).cast("long").alias("cell")
    counts = rows.select(cell, "label").groupBy("cell", "label").count().collect()
    label = np.array([r["label"] for r in counts])
    weight = np.array([r["count"] for r in counts], float)
    if len(set(label.tolist())) < 2:
        ones = float(weight[label == 1].sum()) if len(label) else 0.0
        return None, (ones + 0.0) / (float(weight.sum()) + 1.0)
    x = np.array([r["cell"] * CELL for r in counts])
    return common.logistic_fit(x[:, None], label, weight), 0.0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels")
    model = train(docs, labels)
    found = common.stored(described(docs, model, ["doc_id"]), "toxicity-evidence")
    line, flat = calibrate(found, labels)
    if line is None:
        score = F.lit(float(flat))
    else:
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(line[0])) + F.lit(float(line[1])) * F.col("evidence"))))
    out = found.withColumn("score", score).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    return out.select("doc_id", (common.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
