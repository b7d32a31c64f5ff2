"""The dealt operators against brute force, on odd rows and on the smallest tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sweeploom.llm import common, embed, langid, minhash, mixing, pieces, prints, quality, queries, sharding, suffixes, toxicity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, shard string, kept string, n string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n))


def odd_rows():
    """NULLs, empty and long texts, ties, repeated rows; columns that bear the operators' names."""
    rng = np.random.default_rng(5)
    base = sentence(rng, 160)
    near = base.replace(" ", " x", 1)
    shared = sentence(rng, 120)
    texts = [
        None, "", " \t\n", "one two", "ONE two", base, base, near, base.upper(),
        "start " + sentence(rng, 30) + " " + shared, sentence(rng, 50) + " " + shared + " tail",
        "aaaa" * 400, "ab " * 30_000, sentence(rng, 20_000), "é▁ü 漢字▁ ' \" \x00 \U0001f600" * 3,
    ]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", None, "s0", "s2"][i % 4], 0, 7, "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows.append((5, base, "en", "s0", 1, 7, "x", "y", "z", "w"))  # a repeated row
    rows.append((None, "a text without an id " * 3, None, "s9", None, None, None, None, None, None))
    rows.append((20, shared, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return common.table(spark, FOLDER, "documents")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# 1


def brute_repeats(texts, length):
    seen = Counter()
    for b in texts:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 0, 2])
def test_repeats_match_brute_force(odd, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) < 50_000]
    data = odd.sparkSession.createDataFrame(rows, SCHEMA)
    got = suffixes.remove_repeats(data).collect()
    expected = brute_repeats([(r[1] or "").encode() for r in rows], suffixes.LENGTH)
    want = sorted((str(r[0]), *e) for r, e in zip(rows, expected))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert got[0].asDict().keys() >= {"size", "score", "kept_text", "removed"}


def test_suffix_blocks_match_brute_force():
    rng = np.random.default_rng(2)
    for alphabet, length in ((2, 40), (3, 64), (1, 50), (20, 400)):
        strings = [bytes(rng.integers(97, 97 + alphabet, rng.integers(length, length + 60)).astype(np.uint8)) for _ in range(12)]
        strings += [strings[0][5:] + b"zz" * 5, strings[1]]
        strings = [s if len(s) >= length else s.ljust(length, b"q") for s in strings]
        windows = np.array([len(s) - length + 1 for s in strings])
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [seen[s[i : i + length]] > 1 for s in strings for i in range(len(s) - length + 1)]
        assert suffixes.repeated_windows(strings, windows, length).tolist() == want
        text = np.frombuffer(strings[0] + bytes(2 * suffixes.CYCLE + length), np.uint8)
        start = np.arange(len(strings[0]) - length + 1)
        order, _ = suffixes.suffix_order(text, len(strings[0]), start, length)
        keys = [bytes(text[i : i + length]) for i in order]
        assert keys == sorted(keys)


def test_repeats_of_the_small_table_match_brute_force(spark, small):
    docs = small.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:5] for r in suffixes.op1_suffixes(spark, FOLDER).collect()}
    want = brute_repeats([(d.text or "").encode() for d in docs], suffixes.LENGTH)
    assert [got[d.doc_id] for d in docs] == want


def test_cover_has_every_difference():
    assert {(a - b) % suffixes.CYCLE for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.CYCLE))


def test_long_texts_are_cut_alike():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, suffixes.PART_BYTES + 5_000).astype(np.uint8)
    cut = suffixes._long_text(data, 400)
    assert cut[2].sum() == len(data) - 399 and (np.diff(cut[1]) > 0).all()


# 2


def test_mix_meets_its_targets(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and "score" in rows[0].asDict() and mixing.mix(none).count() == 0
    per = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size and r.size == len(WORD.findall(r.text or ""))
        per[r.source] = (r.source_size, r.target)
    total = sum(s for s, _ in per.values())
    assert abs(sum(t for _, t in per.values()) - 1.5 * total) < 1e-6 * total
    assert all(t <= 2 * s + 1e-9 for s, t in per.values())
    again = mixing.mix(odd.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.repeated(mixing.mix(odd), ["doc_id"]).count() == sum(r.copies for r in rows)


def test_mix_sources_near_target(small):
    taken = defaultdict(int)
    facts, largest = {}, defaultdict(int)
    for r in mixing.mix(small).collect():
        taken[r.source] += r.taken
        facts[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - t) <= largest[s] / 2 + 1 for s, t in facts.items())


# 3


def brute_components(rows, words=5, percent=75):
    sets = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_documents_match_brute_force(odd, none, small):
    rows = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    want = brute_components(rows.items())
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and minhash.near_duplicates(none).count() == 0
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    # Chains of near copies, where the star of a list is not enough.
    rng = np.random.default_rng(9)
    words = sentence(rng, 400).split()
    chain = []
    for k in range(12):
        for j in range(5):
            words[(k * 37 + j * 71) % 400] = f"w{k}x{j}"
        chain.append((k, " ".join(words)))
    data = odd.sparkSession.createDataFrame(chain, "doc_id long, text string")
    want = brute_components(chain)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(data).collect()} == want
    table = [(r.doc_id, r.text) for r in small.collect()]
    want = brute_components(table)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(small).collect()} == want


def test_long_words_and_blocks_hash_alike(monkeypatch):
    text = (b"ab " * 2000 + b"x" * 5000 + b" cd") * 2
    data = np.frombuffer(text, np.uint8)
    ends = np.array([0, len(data)])
    whole, _ = minhash._word_hashes(data, ends)
    monkeypatch.setattr(common, "BATCH_BYTES", 1000)
    assert (minhash._word_hashes(data, ends)[0] == whole).all()


# 4


def brute_prints(rows):
    cut = lambda t: {x for x in t.replace(". ", ".\n").split("\n") if x}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        a, e, n = cut(text), cut(edited), cut(following)
        out.append((i, len(text), digest, round(like(a, e), 9), round(like(a, n), 9)))
    return out


def test_fingerprints_match_brute_force(odd, none, small):
    rows = sorted({r[0]: r[1] for r in odd_rows() if r[0] is not None}.items())
    data = odd.sparkSession.createDataFrame(rows, "doc_id long, text string")
    for frame, plain in ((data, rows), (small, sorted((r.doc_id, r.text) for r in small.collect()))):
        got = prints.fingerprints(frame).collect()
        key = sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
        assert key == brute_prints(plain)
    by_text = defaultdict(set)
    found = prints.fingerprints(odd).collect()
    assert len(found) == odd.count() and prints.fingerprints(none).count() == 0
    for r in prints.fingerprints(data).collect():
        by_text[dict(rows)[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_stuck_tables_grow(spark, monkeypatch):
    from pyspark.sql import functions as F

    data = spark.range(1).select(
        F.transform(F.sequence(F.lit(1), F.lit(60)), lambda x: F.xxhash64(x)).alias("a"),
        F.transform(F.sequence(F.lit(50), F.lit(90)), lambda x: F.xxhash64(x)).alias("b"),
    )
    first = prints.peeled(prints.subtracted(prints.table(F.col("a"), 8), prints.table(F.col("b"), 8)), 8)
    last = prints.peeled(prints.subtracted(prints.table(F.col("a"), 128), prints.table(F.col("b"), 128)), 128)
    row = data.select(first.alias("x"), last.alias("y")).first()
    assert row.x is None and (len(row.y.only_left), len(row.y.only_right)) == (49, 30)
    cuts = data.withColumns({"f": F.lit(1).cast("long"), "s": F.lit(1).cast("long")})
    whole = cuts.select(prints.differing(F.col("a"), F.col("b"), F.col("f"), F.col("s")).alias("d")).first().d
    assert (len(whole.only_left), len(whole.only_right)) == (49, 30)


# 5


def test_languages(spark, odd, none):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    net = langid.train(docs, steps=200)
    got = langid.predict(docs.select("doc_id", "text", "lang"), net).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)
    rows = langid.predict(odd, net).collect()
    assert len(rows) == odd.count() and langid.predict(none, net).count() == 0 and langid.train(none) is None
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered)
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_slopes_match_differences():
    net = langid.ByteNet(["a", "b", "c"])
    for v in net.values():
        v[...] = v.astype(np.float32)
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (6, 40)).astype(np.uint8)
    label, weight = np.array([0, 1, 2, 0, 1, 2]), np.ones(6, np.float32)

    def loss():
        return -np.log(net.chances(windows)[np.arange(6), label].astype(float)).mean()

    for v, g in zip(net.values(), net.gradients(windows, label, weight)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        held, step = v[at], 1e-2
        v[at] = held + step
        up = loss()
        v[at] = held - step
        down = loss()
        v[at] = held
        assert abs((up - down) / (2 * step) - g[at]) <= 0.1 * abs(g[at]) + 2e-3


# 6


def best_score(coder, scores, text):
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + coder.lone
        for start in range(max(0, end - 40), end):
            if text[start:end] in scores:
                best[end] = max(best[end], best[start] + scores[text[start:end]])
    return best[-1]


def test_pieces_round_trip_and_best_path(odd, none):
    words = pieces.vocabulary()
    coder = pieces.Pieces(words)
    scores = {p: s for p, s, kind in words if kind == "normal"}
    assert coder.cuttable
    for text in ("hello world", "  two  spaces ", "▁", "a▁b ▁ c", "漢字 straße", "\n\t x", "aaaaaaaaaaaa", "éééé\U0001f600"):
        ids = coder.encode(text)
        assert coder.decode(ids) == text
        cut = pieces.SIGN + text.replace(" ", pieces.SIGN)
        if pieces.SIGN not in text:
            path = coder.path(cut)
            got = sum(words[i][1] if words[i][2] == "normal" else 0.0 for i in path)
            lone = best_score(coder, scores, cut)
            low = [c for c in cut if c not in scores]
            assert abs(got + coder.lone * len(low) - lone) < 1e-6
            assert list(path) == list(ids)
    rows = pieces.encode(odd).collect()
    assert all(r.round_trip for r in rows) and len(rows) == odd.count() and pieces.encode(none).count() == 0
    for r in rows:
        assert (r.ids is None) == (r.text is None) and r.n_pieces == len(r.ids or [])
        assert r.text is None or r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    back = pieces.decode(pieces.encode(odd)).collect()
    assert all(r.decoded == r.text for r in back)


# 7


def test_shards(odd, none, small):
    assert sharding.shard(none).count() == 0
    for frame in (odd, small):
        rows = sharding.shard(frame).collect()
        assert len(rows) == frame.count()
        slots, sizes = defaultdict(list), defaultdict(int)
        for r in rows:
            slots[r.shard].append(r.slot)
            sizes[r.shard] += r.size
            assert r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(slots) <= 23
    heaviest = max(r.size for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(24)) <= 2 * heaviest
    assert "score" in sharding.shard(odd).columns
    # A group of equal texts that holds most rows is cut; small groups are not.
    spark = odd.sparkSession
    many = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 < 2, 'same text', concat('t', id div 6)) as text")
    rows = sharding.shard(many).collect()
    sizes, places = Counter(), defaultdict(set)
    for r in rows:
        sizes[r.shard] += r.size
        places[r.text].add(r.shard)
    assert len(places["same text"]) > 10 and all(len(v) == 1 for k, v in places.items() if k != "same text")
    assert max(sizes.values()) < 1.05 * min(sizes.values())


# 8 and 10


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    ones = label == 1
    return (rank[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


def test_quality(spark, odd, none):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in quality.op8_quality(spark, folder).collect()}
    labels = [r for r in common.table(spark, folder, "labels").collect() if got[r.doc_id].held_out]
    label = np.array([r.quality for r in labels])
    assert area(np.array([got[r.doc_id].score for r in labels]), label) > 0.98
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    stats = quality.described(odd, ["doc_id", "score"])
    model = quality.train(stats, no_labels(spark))
    rows = quality.score(stats, model, ["doc_id"]).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.5}
    assert quality.described(none, ["doc_id"]).count() == 0


def test_toxicity(spark, odd, none):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, folder).collect()}
    texts = {r.doc_id: r.lang for r in common.table(spark, folder, "documents").select("doc_id", "lang").collect()}
    # Elsewhere these tables have too few toxic texts of a language to learn from.
    labels = [r for r in common.table(spark, folder, "labels").collect() if got[r.doc_id].held_out and texts[r.doc_id] == "en"]
    label = np.array([r.toxic for r in labels])
    predicted = np.array([got[r.doc_id].predicted for r in labels])
    assert predicted[label == 1].mean() > 0.8 and predicted[label == 0].mean() < 0.03
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert toxicity.train(odd, no_labels(spark)) is None
    rows = toxicity.described(odd, toxicity.Distance([b"bad words here"] * 4, [b"fine words there"] * 4), ["doc_id"]).collect()
    assert len(rows) == odd.count() and toxicity.described(none, None, ["doc_id"]).count() == 0


# 9


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24))
    x[300:420] = x[:120] + 0.04 * rng.normal(size=(120, 24))
    x[420:450] = x[0] + 0.02 * rng.normal(size=(30, 24))
    x[450:460] = x[1]
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0, "e") for i, v in enumerate(x)]
    bad = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0], [1e-30] * 24]
    rows += [(1000 + i, v, None, None) for i, v in enumerate(bad)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, unit string")
    got = {r.vec_id: r for r in embed.near_duplicates(data).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    label = np.arange(len(u))
    for _ in range(20):
        for i in range(len(u)):
            label[i] = min(label[i], label[np.flatnonzero(hit[i])].min(initial=label[i]))
    assert [got[i].n_links for i in range(600)] == hit.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(600)] == label.tolist()
    assert [got[1000 + i].n_links for i in range(9)] == [0, 0, 0, 0, 0, 0, 1, 1, 0]
    assert got[1007].component_id == 1006 and not got[1007].kept
    assert embed.near_duplicates(data.filter("vec_id > 1005 and vec_id < 1000")).count() == 0
    assert embed.near_duplicates(data.filter("vec_id < 5").unionByName(data.filter("vec_id < 5"))).filter("n_links = 1").count() == 10


def test_vectors_with_repeated_and_missing_ids(spark):
    near, far = [1.0, 0.01], [0.0, 1.0]
    rows = [(1, [1.0, 0.0]), (1, None), (2, near), (3, far), (4, [1.0, 0.0]), (4, [-1.0, 0.0]), (None, far), (None, [0.7, -0.7]), (5, near), (5, near), (None, None)]
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    def unit(v):
        return None if v is None else np.array(v) / np.linalg.norm(v)

    units = [unit(v) for _, v in rows]
    linked = lambda i, j: i != j and units[i] is not None and units[j] is not None and units[i] @ units[j] >= 0.95
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *[group[j] for j in range(len(rows)) if linked(i, j)]]) for i in range(len(rows))]
    want = []
    for i, (own, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        least = min(ids, default=None)
        want.append((own, sum(bool(linked(i, j)) for j in range(len(rows))), least, own == least))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("cosine", [0.95, 0.9])
def test_pairs_across_borders_meet(spark, monkeypatch, cosine):
    monkeypatch.setattr(embed, "CELL_ROWS", 8)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 4))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= cosine
    np.fill_diagonal(hit, False)
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed.near_duplicates(data, cosine).collect()}
    assert [got[i] for i in range(len(x))] == hit.sum(axis=1).tolist()


# The pipeline and the registry


def test_stages_take_odd_rows(spark, odd, none):
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "mixing", "sentencepiece"]
    for frame in (odd, none):
        docs = frame
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = common.stored(stage(spark, docs, FOLDER), name)
            if k < 4:
                assert docs.columns == frame.columns
    assert docs.count() == 0


def test_one_row_of_a_repeated_document_survives(spark):
    rng = np.random.default_rng(11)
    a, b, c, d = (sentence(rng, 160) for _ in range(4))
    near = a.replace(" ", " x", 1)
    rows = [(1, a), (1, a), (2, near), (3, b), (3, near), (4, c), (4, c), (None, d), (None, d), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (3, b), (4, c), (None, d)], key=str)
    cut = corpus_pipeline.cut_repeats(spark, common.stored(kept, "kept"), FOLDER).collect()
    assert sorted(r.text for r in cut) == sorted([a, b, c, d])
    links = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert {(3, 3, True), (3, 1, False), (None, 4, False)} <= links


def test_pipeline_stages_match_brute_force(spark, small):
    docs = small
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    cut = corpus_pipeline.cut_repeats(spark, kept, FOLDER).collect()
    texts = [r.text.encode() for r in kept.collect()]
    assert sum(len(r.text.encode()) for r in cut) >= sum(n - gone for n, gone, _, _ in brute_repeats(texts, 400)) - 8 * len(texts)
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and out.filter("not round_trip").count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    tables = {"op9_embed": "embeddings"}
    assert len(got) == common.table(spark, FOLDER, tables.get(name, "documents")).count()
    if name in queries.SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
        cursor = con.execute(queries.SQL[name])
        assert [d[0] for d in cursor.description] == df.columns
        assert sorted(got) == sorted(cursor.fetchall())


def test_pieces_decode_each_cut_once_and_tell_odd_ones():
    from sweeploom.llm import pieces

    words = [("<0x%02X>" % b, 0.0, "byte") for b in range(256)] + [(pieces.SIGN, -3.0, "normal"), (pieces.SIGN + "ab", -1.0, "normal"), ("c", -2.0, "normal")]
    coder = pieces.Pieces(words)
    made = []
    path = coder.path
    coder.path = lambda cut: made.append(cut) or path(cut)
    long = "abc" * 40
    for text in ("", "ab abc", long, "x\u2581ab", "\ud800"):
        assert coder.decode(coder.encode(text)) == text
        assert coder.coded(text)[1] == ((" " + text).encode("utf-8", "surrogatepass") if text else b"")
    assert made.count(pieces.SIGN + long) == 2  # too long to remember: one search a call
    coder.bytes_of[258] = b"?"
    coder.seen.clear()
    assert coder.coded("abc")[1] == b" ab?" and coder.odd


def test_work_in_tasks_gives_memory_back(monkeypatch):
    called = []
    monkeypatch.setattr(common, "give_back", lambda: called.append(1))
    assert list(common.lean(lambda batches: (2 * b for b in batches))([1, 2])) == [2, 4] and called == [1]


def test_scan_holds_little_memory(spark):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 4_000))) for _ in range(250)]
    numbers = pa.array(np.arange(250))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), numbers, numbers], names=["text", "k1", "k2"])

    class Docs:
        def filter(self, *_):
            return self

        select = filter

        def mapInArrow(self, work, schema):
            return work([batch])

    list(suffixes._scan(Docs(), 400))  # powers of the hash base are made once
    tracemalloc.start()
    rows = [r for b in suffixes._scan(Docs(), 400) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(r["windows"] for r in rows) == 250 * 3_601
    assert peak < 40 << 20
