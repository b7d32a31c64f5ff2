"""Language identification by a byte convolutional network.

Texts are cut into windows of WINDOW bytes.  A window's bytes are embedded,
filters of several widths run over them, each filter keeps its largest answer,
and a softmax over these answers gives the languages.  A text's score is the
mean over all its windows, weighted by their bytes.  Training is numpy with
Adam on a bounded sample of labelled rows: about SAMPLE_DOCS documents of each
language, SAMPLE_BYTES from a place chosen by hash in each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
SAMPLE_DOCS = 1_000
SAMPLE_BYTES = 1_024
STEPS = 300
BATCH = 96
UNKNOWN = "und"
_LETTER = r"\p{L}"


class ByteNet:
    """Embedding, convolutions of several widths, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        f32 = np.float32
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(f32)
        self.filters = [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(f32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, f32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(f32)
        self.shift = np.zeros(len(languages), f32)

    def values(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.shift]

    def _answers(self, windows: np.ndarray, w: int):
        """All answers of the filters of width WIDTHS[w]: (window, place, filter)."""
        width, n = WIDTHS[w], windows.shape[1]
        codes = self.embed[windows]
        look = np.concatenate([codes[:, j : n - width + 1 + j] for j in range(width)], axis=2)
        return look, look @ self.filters[w] + self.bias[w]

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        best = [self._answers(windows, w)[1].max(axis=1) for w in range(len(WIDTHS))]
        return np.maximum(np.concatenate(best, axis=1), 0)

    def chances(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.out + self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Slopes of the mean weighted cross entropy, in the order of ``values``."""
        rows = np.arange(len(windows))[:, None]
        looks, places, tops = [], [], []
        for w in range(len(WIDTHS)):
            look, answer = self._answers(windows, w)
            at = answer.argmax(axis=1)
            looks.append(look)
            places.append(at)
            tops.append(answer[rows, at, np.arange(FILTERS)[None, :]])
        top = np.concatenate(tops, axis=1)
        hidden = np.maximum(top, 0)
        z = hidden @ self.out + self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(label)), label] -= 1
        z *= (weight / len(label))[:, None]
        to_hidden = (z @ self.out.T) * (top > 0)
        g_embed = np.zeros_like(self.embed)
        g_filters, g_bias = [], []
        for w, width in enumerate(WIDTHS):
            slope = to_hidden[:, w * FILTERS : (w + 1) * FILTERS]
            seen = looks[w][rows, places[w]]
            g_filters.append(np.einsum("bfk,bf->kf", seen, slope))
            g_bias.append(slope.sum(axis=0))
            back = slope[:, :, None] * self.filters[w].T[None]
            for j in range(width):
                codes = windows[rows, places[w] + j]
                np.add.at(g_embed, codes, back[:, :, j * EMBED : (j + 1) * EMBED])
        return [g_embed, *g_filters, *g_bias, hidden.T @ z, z.sum(axis=0)]


def cut_windows(data: np.ndarray, ends: np.ndarray, window: int = WINDOW):
    """Windows of joined texts, padded with zero bytes: (windows, text numbers, bytes).

    Windows overlap by the widest filter less one byte, so no filter's view is
    lost at a cut.  An empty text has no window.
    """
    step = window - (max(WIDTHS) - 1)
    sizes = np.diff(ends)
    count = np.where(sizes > 0, np.maximum(1, -(-(sizes - (window - step)) // step)), 0)
    own = np.repeat(np.arange(len(sizes)), count)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    start = ends[:-1][own] + (np.arange(len(own)) - first[own]) * step
    length = np.minimum(window, ends[1:][own] - start)
    at = start[:, None] + np.arange(window)
    inside = np.arange(window) < length[:, None]
    padded = data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(inside, padded, 0).astype(np.uint8), own, length


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS, seed: int = 7) -> ByteNet | None:
    """A network from the rows with text and lang of the folds that may be learnt from.

    None when there is no such row.
    """
    rows = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & (F.octet_length("text") > 0) & (common.fold_of(F.col("doc_id")) != 0)
    )
    slack = F.greatest(F.octet_length("text") - F.lit(SAMPLE_BYTES), F.lit(0))
    place = F.floor(common.unit_hash(F.col("doc_id"), F.lit("place")) * slack).cast("int") + 1
    piece = F.col("text").cast("binary").substr(place, F.lit(SAMPLE_BYTES))
    drawn = common.bounded(rows, "lang", sample_docs, "langid").select("doc_id", "lang", piece.alias("piece"))
    drawn = sorted(drawn.collect(), key=lambda r: (str(r["doc_id"]), bytes(r["piece"])))
    if not drawn:
        return None
    languages = sorted({r["lang"] for r in drawn})
    data, ends = common.joined([bytes(r["piece"]) for r in drawn])
    windows, own, length = cut_windows(data, ends)
    label = np.array([languages.index(r["lang"]) for r in drawn])[own]
    weight = (1 / np.bincount(label, minlength=len(languages)))[label]
    weight = (weight / weight.mean()).astype(np.float32)
    net = ByteNet(languages, seed)
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(v) for v in net.values()]
    second = [np.zeros_like(v) for v in net.values()]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), BATCH)
        batch = windows[pick].copy()
        # Some windows are shortened, so that short texts are known as well.
        for i in np.flatnonzero(rng.random(BATCH) < 0.3):
            batch[i, rng.integers(8, WINDOW) :] = 0
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for v, g, m, s in zip(net.values(), net.gradients(batch, label[pick], weight[pick]), first, second):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return net


def predict(docs: DataFrame, net: ByteNet | None, keep=None) -> DataFrame:
    """``docs`` with lang_pred and score.

    A NULL text or one without a letter is ``und`` with score 0, as is every
    text where nothing could be learnt.  Columns of ``docs`` named lang_pred or
    score are replaced; all others, clashing or not, pass through.
    """
    keep = docs.columns if keep is None else keep
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def run(column):
        n = len(column)
        names = np.full(n, UNKNOWN, object)
        score = np.zeros(n)
        for lo, hi, data, ends in common.parts(column):
            if net is None:
                break
            total = np.zeros((hi - lo, len(net.languages)))
            # A long text is scored in blocks of windows, so memory stays bounded.
            for a, b, piece, edges in _blocks(data, ends):
                windows, own, length = cut_windows(piece, edges)
                for i in range(0, len(windows), 512):
                    chance = net.chances(windows[i : i + 512]) * length[i : i + 512, None]
                    np.add.at(total, a + own[i : i + 512], chance)
            size = total.sum(axis=1)
            some = np.flatnonzero(size > 0)
            best = total[some].argmax(axis=1)
            names[lo + some] = np.array(net.languages, object)[best]
            score[lo + some] = total[some, best] / size[some]
        return [_strings(names), np.clip(score, 0, 1)]

    lettered = F.coalesce(F.col("text").rlike(_LETTER), F.lit(False))
    out = common.with_text_results(docs.withColumn("__lettered", lettered), [*keep, "__lettered"], fields, run)
    known = F.col("__lettered")
    return out.withColumns(
        {
            "lang_pred": F.when(known, F.col("lang_pred")).otherwise(F.lit(UNKNOWN)),
            "score": F.when(known, F.col("score")).otherwise(F.lit(0.0)),
        }
    ).drop("__lettered")


def _blocks(data: np.ndarray, ends: np.ndarray, most: int = 1 << 20):
    """Texts as they are, or slices of one long text: (first text, last, data, ends)."""
    if len(ends) == 2 and len(data) > most:
        for i in range(0, len(data), most):
            piece = data[i : i + most]
            yield 0, 1, piece, np.array([0, len(piece)])
    else:
        yield 0, len(ends) - 1, data, ends


def _strings(values):
    import pyarrow as pa

    return pa.array(values.tolist(), pa.string())


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    net = train(docs)
    out = predict(docs.select("doc_id", "text"), net, ["doc_id"])
    return out.select("doc_id", (common.fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
