"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once.  At each position
it reports, by its output links, every piece that ends there, longest first; a
piece relaxes the best score of its end from the best score of its start.  The
path of best total score gives the ids.  Characters that no piece covers become
byte pieces.  A space is the sign U+2581 and one stands before the text.  A
U+2581 of the text itself is written as bytes, so decoding gives back every
text exactly.

No piece has the sign after another character, so a text is cut before each
run of signs and the pieces of a cut do not depend on its neighbours; cuts that
recur are looked up.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SIGN = "▁"
# Stands among the cuts for a sign of the text itself; no cut is empty.
OWN_SIGN = ""
# Below the worst score of a piece, for a character without a piece.
PENALTY = 10.0
# Cuts remembered in a task, and their length in characters.
REMEMBERED = 300_000
SHORT = 48

_CUT = re.compile(f"{SIGN}*[^{SIGN}]+|{SIGN}+")


def vocabulary(path: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is normal, byte or control.

    The file is read on the driver; tasks get the list.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        kind = "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) else "normal"
        out.append((model.id_to_piece(i), float(model.get_score(i)), kind))
    return out


class Remembered(dict):
    """Results of recurring cuts; ``make`` gives the ones that are not there."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, cut: str) -> bytes:
        value = self.make(cut)
        if len(cut) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[cut] = value
        return value


class Pieces:
    def __init__(self, vocabulary: list[tuple[str, float, str]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.bytes_of, self.byte_id, self.lengths = [], {}, []
        scores = []
        whole = True
        for i, (piece, score, kind) in enumerate(vocabulary):
            self.lengths.append(len(piece))
            if kind == "byte":
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif kind == "control":
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SIGN, " ").encode())
                self.automaton.add_word(piece, (len(piece), score, i))
                scores.append(score)
                whole = whole and not re.search(f"[^{SIGN}]{SIGN}", piece)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.cuttable = whole
        self.lone = min(scores, default=0.0) - PENALTY
        # Ids of a cut as 32-bit numbers, and cuts whose ids stand for other bytes than their own.
        self.seen = Remembered(self._checked)
        self.odd: set[str] = set()

    def _checked(self, cut: str) -> bytes:
        ids = self.path(cut)
        own = SIGN if cut == OWN_SIGN else cut.replace(SIGN, " ")
        if b"".join(map(self.bytes_of.__getitem__, ids)) != own.encode("utf-8", "surrogatepass"):
            self.odd.add(cut)
        return ids.tobytes()

    def path(self, text: str) -> array:
        """Ids of the best path over one cut."""
        if text == OWN_SIGN:
            return array("i", [self.byte_id[b] for b in SIGN.encode()])
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        came = [-1] * (n + 1)  # piece that ends here; -1 for a lone character
        done = 0  # positions up to here are settled but for their lone character
        lone = self.lone
        if len(self.automaton):
            for last, (length, score, i) in self.automaton.iter(text):
                while done < last:
                    value = best[done] + lone
                    done += 1
                    if value > best[done]:
                        best[done] = value
                        came[done] = -1
                end = last + 1
                value = best[end - length] + score
                if value > best[end]:
                    best[end] = value
                    came[end] = i
        while done < n:
            value = best[done] + lone
            done += 1
            if value > best[done]:
                best[done] = value
                came[done] = -1
        ids = []
        at = n
        while at:
            i = came[at]
            if i < 0:
                ids += [self.byte_id[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
                at -= 1
            else:
                ids.append(i)
                at -= self.lengths[i]
        ids.reverse()
        return array("i", ids)

    def coded(self, text: str) -> tuple[bytes, bytes]:
        """Ids of the text as 32-bit numbers, and the bytes that they decode to."""
        cuts: list[str] = []
        for k, run in enumerate(text.split(SIGN) if text else ()):
            if k:  # the text's own sign
                cuts.append(OWN_SIGN)
            signed = run.replace(" ", SIGN)
            if not k:
                signed = SIGN + signed
            cuts += _CUT.findall(signed) if self.cuttable else [signed] * bool(signed)
        if len(self.odd) > REMEMBERED:
            self.odd.clear(), self.seen.clear()
        ids = b"".join(map(self.seen.__getitem__, cuts))
        # Every cut was decoded when its ids were made: together they give back the text.
        if self.odd.isdisjoint(cuts):
            return ids, (" " + text).encode("utf-8", "surrogatepass") if text else b""
        return ids, b"".join(map(self.bytes_of.__getitem__, array("i", ids)))

    def encode(self, text: str) -> array:
        return array("i", self.coded(text)[0])

    def decode(self, ids) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data[1:].decode("utf-8", "surrogatepass") if data[:1] == b" " else data.decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, path: str = MODEL, keep=None) -> DataFrame:
    """``docs`` with ids, n_pieces, n_byte_pieces, ids_sha256, decoded_sha256, round_trip.

    A NULL text has NULL ids and digests, 0 pieces and a true round trip; an empty
    text has no ids.  Columns of ``docs`` that bear a new name are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(path))  # as long as the vocabulary file
    fields = [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("n_byte_pieces", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
    held: dict[str, Pieces] = {}

    def run(column):
        import pyarrow as pa

        if not held:
            held["pieces"] = Pieces(shared.value)
        pieces = held["pieces"]
        marks = np.zeros(len(pieces.bytes_of) + 1, bool)
        marks[list(pieces.byte_id.values())] = True
        flat, ends = [], [0]
        present, low, digest, back, same = [], [], [], [], []
        for value in column:
            text = value.as_py()
            present.append(text is not None)
            if text is None:
                ends.append(ends[-1])
                low.append(0), digest.append(None), back.append(None), same.append(True)
                continue
            ids, meant = pieces.coded(text)
            meant = meant[1:] if meant[:1] == b" " else meant
            flat.append(ids)
            ends.append(ends[-1] + len(ids) // 4)
            low.append(int(marks[np.frombuffer(ids, np.int32)].sum()))
            digest.append(hashlib.sha256(ids).hexdigest())
            back.append(hashlib.sha256(meant).hexdigest())
            same.append(meant == text.encode("utf-8", "surrogatepass"))
        ends = np.array(ends)
        numbers = pa.array(np.frombuffer(b"".join(flat), np.int32))
        places = pa.array(ends.astype(np.int32), mask=np.append(~np.array(present, bool), False))
        lists = pa.ListArray.from_arrays(places, numbers)
        counts = np.diff(ends)
        return [lists, pa.array(counts, pa.int64()), pa.array(low, pa.int64()), pa.array(digest, pa.string()),
                pa.array(back, pa.string()), pa.array(same, pa.bool_())]

    return common.with_text_results(docs, docs.columns if keep is None else keep, fields, run, common.BATCH_BYTES)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids; NULL ids give NULL."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    held: dict[str, Pieces] = {}
    keep = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])
    names = schema.names
    taken = encoded.select(F.col("ids"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)])

    def run(batches):
        import pyarrow as pa

        if not held:
            held["pieces"] = Pieces(shared.value)
        for batch in batches:
            texts = [None if v is None else held["pieces"].decode(v) for v in batch.column(0).to_pylist()]
            columns = [batch.column(1 + i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=names)

    return taken.mapInArrow(run, schema)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, keep=["doc_id"])
