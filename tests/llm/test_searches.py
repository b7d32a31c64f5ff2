"""Exact searches and token alignment against brute force, on odd rows and on the smallest tables."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from sweeploom.llm import common, negatives, queries, tokenlinks, topk

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, score string, rank string, copies int, v string, block string"


def odd_vectors():
    """NULLs, non-finite and empty vectors, other widths, ties, repeated rows and ids, huge components."""
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)], int(i) % 4) for i in range(120)]
    rows += [
        (200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (202, [float("nan")] + [0.0] * 5, 1),
        (203, [float("inf")] + [0.0] * 5, 2), (204, [], 2), (205, [], 3), (206, [0.0] * 6, 0), (207, [0.25] * 3, 0),
        (210, [0.5] * 3, 0), (220, [0.75] * 3, 2), (208, rows[10][1], None), (None, rows[10][1], 1),
        (20, rows[3][1], 0), rows[10], rows[10], rows[11], rows[11], (209, rows[11][1], 3), (240, [-1.0] * 6, 2),
    ]
    return [(*r, "a", "b", 3, "c", "d") for r in rows]


def whole(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return tuple(math.floor(256 * x) for x in vector)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, every, k):
    fine = [(r[0], whole(r[1])) for r in rows if r[0] is not None and whole(r[1]) is not None]
    out = []
    for query, v in sorted({q for q in fine if q[0] % every == 0}):
        scored = sorted((-dot(v, w), i) for i, w in fine if i != query and len(w) == len(v))
        out += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,few", [(topk.BLOCK_ROWS, topk.FEW), (20, 0)])
def test_top_rows_match_brute_force(spark, monkeypatch, block, few):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "BATCH_ROWS", 7)
    monkeypatch.setattr(topk, "FEW", few)
    rows = odd_vectors()
    got = topk.nearest(spark.createDataFrame(rows, VECTORS), 5, 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, 5)
    assert topk.nearest(spark.createDataFrame([], VECTORS), 5).count() == 0


def test_top_rows_of_huge_components_are_exact(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [2.0**40, 3.0]), (3, [-(2.0**39), 0.0]), (4, [2.0**40, 2.0])]
    got = topk.search(
        spark.createDataFrame([(1, [3 << 38, 5])], "query_id long, v array<long>"),
        spark.createDataFrame([(i, [int(x) for x in v]) for i, v in rows], "vec_id long, v array<long>"),
        3,
    )
    edge = (1 << 63) - 1
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, edge), (1, 2, 4, edge), (1, 3, 3, -edge - 1)]


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(9)
    block = np.floor(256 * rng.normal(size=(2_000, 16)) / 4)
    query = block[:40].copy()
    found, read = topk.best_of_block(block, np.arange(2_000), query, np.arange(40), 5)
    assert read < 0.9 * 40 * block.size
    for q in range(40):
        score = block @ query[q]
        score[q] = -np.inf
        want = sorted(range(2_000), key=lambda i: (-score[i], i))[:5]
        assert found[1][found[0] == q].tolist() == want
    # Many rows of the best score: none of them may be lost before ties are settled.
    block[100:400] = block[0]
    found, _ = topk.best_of_block(block, np.arange(2_000), block[:1], np.array([0]), 5)
    assert found[1].tolist() == [100, 101, 102, 103, 104]


def brute_negatives(rows, every, moved, k=5, m=10):
    fine = [(r[0], moved(r[0], r[2]), whole(r[1])) for r in rows if None not in (r[0], r[2]) and whole(r[1]) is not None]
    out = []
    for a, label, v in sorted({f for f in fine if f[0] % every == 0}):
        near = lambda alike: sorted((-dot(v, w), i) for i, l, w in fine if i != a and len(w) == len(v) and (l == label) == alike)  # noqa: E731, E741
        others = near(False)
        for s, p in near(True)[:k]:
            good = [(n, -t) for t, n in others if -30 * s <= -100 * t <= -90 * s]
            out += [(a, p, rank + 1, n, -s, t) for rank, (n, t) in enumerate(good[:m])]
    return sorted(out)


@pytest.mark.parametrize("block,stride", [(negatives.BLOCK_ROWS, negatives.STRIDE), (25, 3)])
def test_negatives_match_brute_force(spark, monkeypatch, block, stride):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "STRIDE", stride)
    monkeypatch.setattr(negatives, "PART_ROWS", 6)
    rows = odd_vectors()
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), 5)
    want = brute_negatives(rows, 5, lambda i, label: label)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), 5).count() == 0


def test_walks_end_early():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 32))
    rows = np.floor(256 * (centre[rng.integers(0, 20, 6_000)] + 0.1 * rng.normal(size=(6_000, 32))))
    members = rows[np.argsort(-(rows @ rows[0]))[:30]]
    shared = negatives.SharedList(rows, members)
    listed, bound = shared.of(np.ones(len(rows), bool))
    for member in members:
        (found,), visited = negatives.walk(rows, np.arange(len(rows)), member, listed, bound, [(None, None)], 5)
        score = rows @ member
        assert found[0].tolist() == sorted(range(len(rows)), key=lambda i: (-score[i], i))[:5]
        assert visited < len(rows) / 2


@pytest.mark.parametrize("name", ["op11_topk", "op12_negatives"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    cursor = con.execute(queries.SQL[name])
    assert [d[0] for d in cursor.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())


# 13


def plain_cuts(a, b):
    return [i for i, x in enumerate(a) if x in set(b)]


def test_cuts_match_a_plain_search():
    rng = np.random.default_rng(8)
    for n, keep in ((1, 1.0), (40, 0.9), (300, 0.5), (2_000, 0.02), (3_000, 0.0)):
        for _ in range(5):
            places = np.arange(1, n + 1) * 2
            a = places[rng.random(n) < 0.8]
            common_ = a[rng.random(len(a)) < keep]
            b = np.unique(np.concatenate([common_, places[rng.random(n) < 0.5] - 1, [2 * n + 2]]))
            a = np.append(a, 2 * n + 2)
            cut = tokenlinks.shared_cuts(a, b, np.array([0, len(a) - 1]), np.array([len(a) - 1, len(a) - 1]))
            assert np.flatnonzero(cut).tolist() == [i for i in plain_cuts(a, b) if i < len(a) - 1]


def brute_alignment(texts):
    """One token at a time, with the tokenizers' own encoders and offsets added up by hand."""
    with open(tokenlinks.BYTE_MODEL, encoding="utf-8") as a, open(tokenlinks.PIECE_MODEL, "rb") as b:
        coders = tokenlinks.Tokenizers(a.read(), b.read(), tokenlinks.disputed_characters())
    letters = tokenlinks._byte_letters()
    made, counts = [], Counter()
    for text in texts:
        groups = []
        if text:
            a = coders.a.encode(" " + text, add_special_tokens=False).tokens
            ids_a = coders.a.encode(" " + text, add_special_tokens=False).ids
            ids_b = coders.b.encode(text)
            bytes_a = [bytes(letters[c] for c in t) for t in a]
            names = [coders.b.id_to_piece(i) for i in ids_b]
            bytes_b = [bytes([int(p[3:5], 16)]) if coders.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, names)]
            if b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                i = j = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
                    groups.append((ids_a[i:p], ids_b[j:q]))
                    i, j = p, q
        made.append(groups)
        counts.update((x[-1], y[-1]) for x, y in groups)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for groups in made:
        pairs = [(x[-1], y[-1]) for x, y in groups]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(pairs),
                sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs),
                hashlib.sha256(written.encode()).hexdigest() if groups else "",
            )
        )
    return out


def test_cut_texts_have_the_tokens_of_whole_ones(monkeypatch):
    with open(tokenlinks.BYTE_MODEL, encoding="utf-8") as a, open(tokenlinks.PIECE_MODEL, "rb") as b:
        coders = tokenlinks.Tokenizers(a.read(), b.read(), tokenlinks.disputed_characters())
    rng = np.random.default_rng(6)
    words = ["the", "quick", "naïve", "漢字", "x2", "it's", "(a)", "-", "  ", "\n", "tokenisers", "9,5", "a_b", "² m", "ß", "\x85", "\u3000", "\u200b", "\x1c", "\u180e", "'s", "…"]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(20)] + [t for t in odd_texts() if t and "▁" not in t]
    monkeypatch.setattr(tokenlinks, "SEGMENT", 17)
    assert len(coders.segments(texts[0])) > 20 and coders.fast is not None
    for text, (ids_a, ids_b, exact) in zip(texts, coders.encode(texts)):
        assert ids_a.tolist() == coders.a.encode(" " + text, add_special_tokens=False).ids
        assert ids_b.tolist() == coders.b.encode(text)
        assert exact


def test_both_encoders_of_the_first_file_agree():
    with open(tokenlinks.BYTE_MODEL, encoding="utf-8") as a, open(tokenlinks.PIECE_MODEL, "rb") as b:
        coders = tokenlinks.Tokenizers(a.read(), b.read(), tokenlinks.disputed_characters())
    # Every settled character between letters, numbers, signs and spaces.
    settled = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c not in coders.disputed]
    assert len(settled) > 100_000 and all(c not in coders.disputed for c in "aß漢9²é ▁\U0001f600")
    assert "ab\u0221" in coders.disputed and "x\U00016ea0" in coders.disputed and "\U0010ffff" in coders.disputed
    pad = ["a{}b", "1{}2", ".{}!", " {} ", "{}{}"]
    texts = [" ".join(pad[(k // 500) % 5].format(c, c) for c in settled[k : k + 500]) for k in range(0, len(settled), 500)]
    texts += ["\U00016ea0 new letters", "we'll it's 'S 're", "tabs\t\t x\n\n y  "]
    assert coders.first_ids(texts) == [e.ids for e in coders.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def odd_texts():
    return [
        None, "", " ", "  two  spaces\n\n\ttabs ", "a▁sign", "<|endoftext|> <s> </s> <unk> <0x41>", "é 漢字 \U0001f600 \x00 end",
        "the same words", "the same words", "internationalisation of tokenisers " * 40, "x" * 3_000, "aéb" * 500, " wide gaps",
    ]


@pytest.mark.parametrize("part,shared", [(tokenlinks.PART_BYTES, tokenlinks.SHARED_PAIRS), (100, 0)])
def test_token_links_match_brute_force(spark, monkeypatch, part, shared):
    monkeypatch.setattr(tokenlinks, "PART_BYTES", part)
    monkeypatch.setattr(tokenlinks, "SEGMENT", part)
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, row string, own string")
    made = tokenlinks.align(docs).withColumn("row", tokenlinks.F.monotonically_increasing_id())
    got = tokenlinks.scored(common.stored(made, "links-test"), shared).orderBy("doc_id").collect()
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r[c] for c in columns) for r in got] == brute_alignment(texts)
    for r in got:
        assert len(r.ids_a) == r.n_a and len(r.group_ends_b) == r.n_groups and (not r.n_groups or r.group_ends_b[-1] == r.n_b)
    empty = tokenlinks.align(docs.limit(0)).withColumn("row", tokenlinks.F.lit(0).cast("long"))
    assert tokenlinks.scored(empty).count() == 0


def test_token_links_of_the_small_table(spark):
    docs = common.table(spark, FOLDER, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(map(tuple, tokenlinks.op13_tokenlinks(spark, FOLDER).collect()))
    assert got == [(d.doc_id, *row) for d, row in zip(docs, brute_alignment([d.text for d in docs]))]
