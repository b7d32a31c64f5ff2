import os
import subprocess
import sys

import numpy as np
import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from sweeploom.functions.complexmath import from_matrices, y_to_s_stack
from sweeploom.operators import acquire, composite, dense, designs, rational, search
from sweeploom.plans import extend


def sweep_rows(spark, groups, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(g, float(f), float(rng.normal()), float(rng.normal()), float(rng.uniform(0.5, 2))) for g in range(groups) for f in np.linspace(1e9, 9e9, n)]
    return rows, spark.createDataFrame(rows, "g int, freq_hz double, re double, im double, w double")


@pytest.mark.parametrize("slice_rows,ridge", [(4096, 0.0), (5, 0.0), (5, 1e-3)])
def test_rational_fit_equals_lstsq(spark, monkeypatch, slice_rows, ridge):
    monkeypatch.setattr(rational, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(rational, "FOLD_FAN_IN", 2)
    rows, df = sweep_rows(spark, 4, 23)
    poles, scale = rational.fixed_poles(1e9, 9e9, 3, 0.1)
    got = {r["g"]: np.array(r["coef_re"]) + 1j * np.array(r["coef_im"]) for r in rational.fit(df, ["g"], poles, scale, ridge, weight="w").collect()}
    for g in range(4):
        part = np.array([r[1:] for r in rows if r[0] == g])
        b = rational.basis(part[:, 0], poles, scale) * np.sqrt(part[:, 3])[:, None]
        y = (part[:, 1] + 1j * part[:, 2]) * np.sqrt(part[:, 3])
        if ridge:
            b, y = np.vstack([b, np.sqrt(ridge) * np.eye(4)]), np.append(y, np.zeros(4))
        np.testing.assert_allclose(got[g], np.linalg.lstsq(b, y, rcond=None)[0], rtol=1e-7, atol=1e-9)


def test_evaluate_flatten_and_conditioning(spark):
    rows, df = sweep_rows(spark, 3, 12, 1)
    df = df.withColumn("label", F.lit("S11"))
    poles, scale = rational.fixed_poles(1e9, 9e9, 2, 0.1)
    c = rational.fit(df, ["g", "label"], poles, scale)
    scored = rational.evaluate(df, c, ["g", "label"], poles, scale).where("g = 1").orderBy("freq_hz").collect()
    coef = c.where("g = 1").first()
    want = rational.basis(np.array([r["freq_hz"] for r in scored]), poles, scale) @ (np.array(coef["coef_re"]) + 1j * np.array(coef["coef_im"]))
    np.testing.assert_allclose([r["fit_re"] for r in scored], want.real, atol=1e-12)
    back = rational.unflatten(rational.flatten(c, ["g"], "label"), ["g"], "label", 3)
    assert sorted(map(str, back.collect())) == sorted(map(str, c.select(*back.columns).collect()))
    encoder, decoder, facts = rational.conditioning(df, poles, scale)
    full = rational.basis(np.array([r[1] for r in rows]), poles, scale)
    v = np.array([1.0, 2.0 - 1j, 0.5j])
    assert np.linalg.norm(v @ encoder) == pytest.approx(np.linalg.norm(full @ v))
    np.testing.assert_allclose(encoder @ decoder, np.eye(3), atol=1e-12)
    flat = np.concatenate([v.real, v.imag])
    moved = v @ encoder
    np.testing.assert_allclose(flat @ rational.real_form(encoder, 1), np.concatenate([moved.real, moved.imag]), atol=1e-12)
    assert facts["frequency_rows"] == 36


def test_coefficient_models_respond_as_their_coefficients_say(spark):
    poles, scale = rational.fixed_poles(1e9, 9e9, 3, 0.1)
    rng = np.random.default_rng(2)
    w, b = dense.xavier([2, 5, 2 * 9 * 4], 1)
    network = dense.DenseModel(w, b, "tanh", np.zeros(2), np.ones(2), rng.normal(size=72), rng.uniform(1, 2, 72))
    decoder = rng.normal(size=(4, 4)) + 1j * rng.normal(size=(4, 4))
    model = composite.CoefficientModel(network, poles, scale, decoder, 3, 0.9)
    x, freq = rng.normal(size=(6, 2)), rng.uniform(1e9, 9e9, 6)
    coarse = rng.normal(size=(6, 18)) * 0.1
    rows = [([float(v) for v in a], float(f), [float(v) for v in c[:9]], [float(v) for v in c[9:]]) for a, f, c in zip(x, freq, coarse)]
    df = spark.createDataFrame(rows, "x array<double>, freq_hz double, cr array<double>, ci array<double>")
    got = sorted(composite.responses(df, model, coarse=("cr", "ci")).collect(), key=lambda r: r.freq_hz)
    for r, k in zip(got, np.argsort(freq)):
        flat = network.predict(x[k][None])[0]
        coefficients = (flat[:36] + 1j * flat[36:]).reshape(9, 4) @ decoder
        want = 0.9 * (coefficients @ rational.basis(freq[k : k + 1], poles, scale)[0] + coarse[k, :9] + 1j * coarse[k, 9:])
        np.testing.assert_allclose(np.array(r.fit_re) + 1j * np.array(r.fit_im), want, atol=1e-12)
        assert r.sigma == pytest.approx(np.linalg.norm(want.reshape(3, 3), 2))
    assert composite.largest_asymmetry(df, 3, "cr", "ci") > 0
    even = composite.enforce_reciprocity(model).respond(x, freq)
    np.testing.assert_allclose(even, even.swapaxes(1, 2), atol=1e-12)


def test_reciprocity_policy():
    wanted = composite.reciprocity_wanted
    assert wanted("auto", True, False, None) and not wanted("auto", False, False, None) and not wanted("off", True, True, 0.0)
    assert wanted("enforce", False, True, 1e-13) and not wanted("auto", True, True, 1e-3)
    for asymmetry in (1e-3, None):
        with pytest.raises(ValueError, match="not reciprocal"):
            wanted("enforce", True, True, asymmetry)


def test_conductances_recover_branches(spark):
    branches = [(1, 2), (1, 3), (2, 3)]
    y = (dense.branch_matrix(3, branches) @ np.array([0.01, 0.02, 0.03])).reshape(3, 3)
    s = y_to_s_stack(y[None].astype(complex), 50.0)
    df = spark.createDataFrame([("a", [float(v) for v in from_matrices(s)[0]])] * 2, "b string, matrix array<double>")
    got = sorted((r["branch"], r["conductance"]) for r in dense.conductances(df, ["b"], 3, branches).collect())
    np.testing.assert_allclose([g for _, g in got], [0.01, 0.02, 0.03], rtol=1e-11)


def test_dense_fit_learns_a_line_and_is_partition_free(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (200, 2))
    rows = [([float(a), float(b)], [float(2 * a - b), 3.0]) for a, b in x]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>")
    one = dense.fit(df.repartition(1), [], epochs=40, learning_rate=0.1, seed=1)
    many = dense.fit(df.repartition(7), [], epochs=40, learning_rate=0.1, seed=1)
    # Adam divides by the gradient's size, so rounding noise of a zero gradient
    # grows; the losses agree, the weights only roughly.
    np.testing.assert_allclose([h[1] for h in one.history], [h[1] for h in many.history], rtol=0.01)
    assert one.history[-1][1] < 0.05 * one.history[0][1]
    scored = dense.predict(df, one).first()
    np.testing.assert_allclose(scored["prediction"], one.predict(np.array([scored["x"]]))[0])


def test_passivity_penalty_reduces_sigma(spark):
    rng = np.random.default_rng(2)
    rows = [([float(a)], [1.2 + 0.1 * float(a), 0.0]) for a in rng.uniform(-1, 1, 60)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>")
    plain = dense.fit(df, [], epochs=40, learning_rate=0.05)
    held = dense.fit(df, [], epochs=40, learning_rate=0.05, passivity_target=1.0, passivity_penalty=50.0)
    x = np.array([[0.9]])
    assert abs(held.predict(x)[0, 0]) < abs(plain.predict(x)[0, 0])


def line_rows(spark, n=200):
    rng = np.random.default_rng(0)
    return spark.createDataFrame(
        [([float(a), float(b)], [float(2 * a - b), float(a * b)]) for a, b in rng.uniform(-1, 1, (n, 2))],
        "x array<double>, y array<double>",
    )


LOST_TASK = """
import os
import sys
import numpy as np
from pyspark.sql import SparkSession
from sweeploom.operators import dense

spark = SparkSession.builder.master("local[3,4]").config("spark.ui.enabled", "false").getOrCreate()
rng = np.random.default_rng(0)
rows = [([float(a), float(b)], [float(2 * a - b), float(a * b)]) for a, b in rng.uniform(-1, 1, (200, 2))]
df = spark.createDataFrame(rows, "x array<double>, y array<double>")
seen, mark = [], sys.argv[1]

def once_lost(out, y, w):
    from pyspark import BarrierTaskContext

    seen.append(1)
    if len(seen) == 3 and BarrierTaskContext.get().partitionId() == 1 and not os.path.exists(mark):
        open(mark, "w").close()
        raise OSError("lost")
    return 0.0, np.zeros_like(out)

options = {"epochs": 12, "learning_rate": 0.05, "workers": 3}
want = dense.fit(df, [3], **options)
got = dense.fit(df, [3], save_interval=5, extra_gradient=once_lost, **options)
np.testing.assert_allclose([h[1:] for h in got.history], [h[1:] for h in want.history], rtol=1e-9)
"""


def test_a_lost_task_starts_the_stage_again_from_the_saved_steps(tmp_path):
    # A session of its own: the shared one gives up after the first failure of a task.
    mark = tmp_path / "lost"
    made = subprocess.run(
        [sys.executable, "-c", LOST_TASK, str(mark)], env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300
    )
    assert made.returncode == 0, made.stderr[-2000:]
    assert mark.exists()


def test_a_fit_goes_on_from_its_folder(spark, tmp_path):
    df, folder = line_rows(spark), str(tmp_path / "state")
    options = {"learning_rate": 0.05, "workers": 2, "save_interval": 4}
    want = dense.fit(df, [3], epochs=12, **options)
    dense.fit(df, [3], epochs=8, state=folder, **options)
    got = dense.fit(df, [3], epochs=12, state=folder, **options)
    assert spark.read.parquet(folder).count() == 3
    np.testing.assert_allclose([h[1] for h in got.history], [h[1] for h in want.history], rtol=1e-9)


def test_shares_checks_and_extra_terms_of_a_fit(spark):
    df = line_rows(spark)
    model = dense.fit(df, [3], epochs=30, learning_rate=0.05, batch_share=0.5, check=df.limit(40), check_interval=5, patience=10)
    assert min(h[2] for h in model.history) < model.history[0][2]

    def pull(out, y, w):  # the same squared error once more
        return float(((out - y) ** 2).sum()) / out.shape[1], 2.0 * (out - y) / out.shape[1]

    # With equal spreads of both outputs the weights of the columns are one.
    even = df.select("x", F.array(F.col("y")[0], -F.col("y")[0]).alias("y"))
    one, two = (dense.fit(even, [], epochs=5, learning_rate=0.05, extra_gradient=e) for e in (None, pull))
    np.testing.assert_allclose(two.history[0][1], 2 * one.history[0][1], rtol=1e-9)


def test_composite_penalty_equals_the_sum_of_both_parts(spark):
    rng = np.random.default_rng(3)
    rows = [([float(a)], [0.9 + 0.1 * float(a), 0.0], [0.2, 0.1], [1.1 + 0.1 * float(a), 0.1]) for a in rng.uniform(-1, 1, 50)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>, c array<double>, whole array<double>")
    options = {"epochs": 15, "learning_rate": 0.05, "passivity_target": 1.0, "passivity_penalty": 2.0}
    # Fitting the residual with its coarse part must see the same excess as fitting the whole response,
    # because a constant coarse response only moves the mean of the outputs.
    whole = dense.fit(df.select("x", F.col("whole").alias("y")), [], **options)
    parts = dense.fit(df.select("x", "y", "c"), [], coarse="c", **options)
    np.testing.assert_allclose([h[1] for h in parts.history], [h[1] for h in whole.history], rtol=1e-9)


def test_sobol_tells_far_indexes_apart(spark):
    assert [p for _, p in designs.primitive_polynomials(5)] == [0b11, 0b111, 0b1011, 0b1101, 0b10011]
    far = designs.sobol(spark.createDataFrame([(5,), ((1 << 31) + 5,), ((1 << 51) + 5,)], "i long"), "i", 40).collect()
    assert len({r["u39"] for r in far}) == 3 and all(0 <= v < 1 for r in far for v in r[1:])
    rows = designs.sobol(spark.range(1 << 6).withColumnRenamed("id", "i"), "i", 40).collect()
    for axis in range(40):
        assert sorted(int(r[f"u{axis}"] * 64) for r in rows) == list(range(64))


def test_range_extension(spark, monkeypatch):
    monkeypatch.setattr(designs, "REFILL_ATTEMPTS", 2)  # the free grid points come in sooner
    one = [{"name": "w", "lower": 0.0, "upper": 1.0}]
    known = spark.createDataFrame([(1, 0.0, "training"), (2, 1.0, "Verify")], "row long, w double, dataset string")
    out = extend.extended_inventory(known, one, [{**one[0], "upper": 2.0}], 1, 0, 0, "halton").orderBy("point_index").collect()
    assert [(r.w, r.dataset, r.slab) for r in out] == [(0.0, "train", None), (1.0, "verification", None), (2.0, "train", "w above")]
    two = [{"name": "w", "lower": 1.0, "upper": 10.0, "scale": "log"}, {"name": "l", "lower": 0.0, "upper": 2.0}]
    wide = [{**two[0], "upper": 12.0}, {**two[1], "lower": -1.0, "upper": 3.0}]
    parts = extend.slabs(two, wide, 0)
    assert [p["name"] for p in parts] == ["w above", "l below", "l above"] and [p["capacity"] for p in parts] == [10, 10, 10]
    # Every free point of the added part, and not one more.
    known = spark.createDataFrame([(1, 2.0, 1.0, "train"), (2, 11.0, -1.0, "train")], "row long, w double, l double, dataset string")
    out = extend.extended_inventory(known, two, wide, 29, 9, 0, "latin-hypercube").collect()
    points = {(r.w, r.l) for r in out}
    assert len(out) == len(points) == 31
    assert points == {(float(w), float(l)) for w in range(1, 13) for l in range(-1, 4) if w > 10 or not 0 <= l <= 2} | {(2.0, 1.0)}
    assert sum(r.dataset == "verification" for r in out) == 9 and sorted(r.point_index for r in out) == list(range(1, 32))
    with pytest.raises(ValueError, match="only 29 free points"):
        extend.extended_inventory(known, two, wide, 30, 0, 0)


def test_projection_makes_outputs_reciprocal():
    w, b = dense.xavier([2, 3, 8], 0)
    model = dense.DenseModel(w, b, "tanh", np.zeros(2), np.ones(2), np.arange(8.0), np.arange(1.0, 9.0))
    x = np.random.default_rng(0).normal(size=(5, 2))
    before = model.predict(x)
    dense.project_outputs(model, dense.reciprocity_projection(2))
    after = model.predict(x)
    np.testing.assert_allclose(after, before @ dense.reciprocity_projection(2), atol=1e-12)
    np.testing.assert_allclose(after[:, 1], after[:, 2])


def test_growth_plan_golden(spark):
    def plan(training):
        p = acquire.verification_growth(F.lit(training), F.lit(8), F.lit(8), 6)
        return spark.range(1).select(p.alias("p")).first()["p"]

    a, b, c = plan(24), plan(32), plan(40)
    assert (a["projected_training_count"], a["additional_verification_count"], a["next_training_trigger"]) == (32, 0, 36)
    assert (b["target_verification_count"], b["additional_verification_count"]) == (12, 4)
    assert (c["target_verification_count"], c["additional_verification_count"]) == (16, 8)


def test_recommendation_golden(spark):
    for dims, want in {2: (4, 4, 6), 3: (5, 6, 9), 4: (6, 8, 12), 6: (9, 12, 18), 8: (12, 16, 24)}.items():
        rows = spark.createDataFrame([(k, s, max(3 * dims, 12)) for k, s in enumerate((1.5, 2.5, 4.5))], "k int, rms double, regions int")
        out = acquire.recommend(rows, dims, F.lit(max(4 * dims, 12)), target=1.0).orderBy("k").collect()
        assert tuple(r["recommended_count"] for r in out) == want


def test_hybrid_shares_add_up():
    for regime in acquire.HYBRID_SHARES:
        for n in range(0, 25):
            given = acquire.hybrid_allocation(n, regime)
            assert sum(given.values()) == n and (n < 3 or min(given.values()) >= 1)
            order = acquire.hybrid_schedule(given)
            assert sorted(order) == sorted(k for k, v in given.items() for _ in range(v))
            # No kind is ever a whole pick ahead of its share.
            for step in range(1, n + 1):
                assert all(order[:step].count(k) * n < v * step + n for k, v in given.items())
    letters = "".join(k[0] for k in acquire.hybrid_schedule({"exploitation": 6, "uncertainty": 2, "coverage": 2}))
    assert letters == "eueceeuece"


def test_large_error_model_equals_the_dense_one(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *map(float, rng.random(2)), float(rng.random() + 0.1)) for i in range(500)]
    regions = spark.createDataFrame(rows, "id long, u0 double, u1 double, score double")
    options = {"noise": 1e-4, "length_scale": [0.3, 0.5]}
    dense_model = acquire.fit_error_model(regions, ["u0", "u1"], **options)
    large = acquire.fit_error_model(regions, ["u0", "u1"], dense_points=100, **options)
    assert isinstance(large, acquire.LargeErrorModel)
    points = rng.random((60, 2))
    frame = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, p array<double>")
    got = {r["id"]: (r["log_mean"], r["log_std"]) for r in acquire.posterior(frame, large).collect()}
    mu, sd = dense_model.posterior(points)
    np.testing.assert_allclose([got[i][0] for i in range(60)], mu, atol=1e-8)
    np.testing.assert_allclose([got[i][1] ** 2 for i in range(60)], sd**2, atol=1e-8)
    old = spark.createDataFrame([(0, [0.1, 0.1])], "id long, p array<double>")
    picks = [[(c["id"], c["score"]) for c in acquire.greedy(frame, old, ["gp-ucb", "uncertainty", "uncertainty"], m)] for m in (dense_model, large)]
    assert [i for i, _ in picks[0]] == [i for i, _ in picks[1]]
    np.testing.assert_allclose([s for _, s in picks[0]], [s for _, s in picks[1]], rtol=1e-5)
    chosen = acquire.fit_error_model(regions, ["u0", "u1"], noise=1e-2, dense_points=60)
    assert isinstance(chosen, acquire.LargeErrorModel) and len(chosen.scales) == 2


def test_a_believed_point_equals_a_new_fit():
    rng = np.random.default_rng(1)
    points, targets = rng.random((30, 2)), rng.normal(size=30)
    model = acquire.build(points, targets, 0.3, 1.7, np.array([0.4, 0.6]), 1e-4)
    x = rng.random((9, 2))
    grown = model.believe(x[0]).believe(x[1])
    again = acquire.build(grown.points, grown.targets, 0.3, 1.7, model.scales, 1e-4)
    for a, b in zip(grown.posterior(x), again.posterior(x)):
        np.testing.assert_allclose(a, b, atol=1e-7)


def test_greedy_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    regions = spark.createDataFrame([(i, *map(float, rng.random(2)), float(rng.random() + 0.1)) for i in range(15)], "id long, u0 double, u1 double, score double")
    model = acquire.fit_error_model(regions, ["u0", "u1"])
    points = rng.random((80, 2))
    old = rng.random((6, 2))
    frame = lambda a: spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(a)], "id long, p array<double>")
    chosen = acquire.greedy(frame(points).repartition(4), frame(old), ["gp-ucb"] * 3, model, exploration=1.5)
    occupied, current, left, want = list(old), model, dict(enumerate(points)), []
    for _ in range(3):
        best = None
        for i, p in left.items():
            mu, sd = current.posterior(p[None])
            near = min(np.linalg.norm(p - o) for o in occupied)
            score = np.exp(mu[0] + 1.5 * sd[0]) * min(1.0, near / np.sqrt(2))
            if best is None or score > best[0] + 1e-15:
                best = (score, i)
        want.append(best[1])
        occupied.append(left.pop(best[1]))
        current = current.believe(points[best[1]])
    assert [c["id"] for c in chosen] == want


def test_designs(spark):
    n = 37
    lhs = designs.unit_points(spark, "latin-hypercube", n, 3, 5).collect()
    for d in range(3):
        assert sorted(int(r[f"u{d}"] * n) for r in lhs) == list(range(n))
    sob = designs.unit_points(spark, "sobol", 16, 4, 0).orderBy("row").collect()
    assert [sob[k]["u0"] for k in range(4)] == [0.0, 0.5, 0.75, 0.25]
    for d in range(4):
        assert sorted(int(r[f"u{d}"] * 16) for r in sob) == list(range(16))
    table = designs.latin_hypercube(spark.range(40).select(F.col("id").alias("row")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))), "row", 40, 2, 9, F.col("k"))
    scores = {r["k"]: r["minimum_distance"] for r in designs.design_scores(table, "k", "row", ["u0", "u1"], 40).collect()}
    for k in range(5):
        p = np.array([[r["u0"], r["u1"]] for r in table.where(F.col("k") == k).collect()])
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) + np.eye(40) * 9
        assert scores[k] == pytest.approx(d.min())
    domain = [{"name": "a", "lower": 0.0, "upper": 1.0}, {"name": "b", "lower": 0.0, "upper": 1.0}]
    pts = designs.unique_points(spark, "latin-hypercube", 100, domain, 1, seed=2)
    assert pts.select("a", "b").distinct().count() == 100
    with pytest.raises(ValueError):
        designs.unique_points(spark, "halton", 200, domain, 1)


def test_adaptive_trials_balance_categories(spark):
    acts, forms = ["tanh", "relu"], ["log", "linear", "both"]
    rows = [(i, a, f, 1e-3 * (1 + i)) for i, (a, f) in enumerate((a, f) for _ in range(4) for a in acts for f in forms)]
    pool = search.features(spark.createDataFrame(rows, "id long, act string, form string, rate double"), ["rate"], ["rate"], {"act": acts, "form": forms}).cache()
    done = []
    for _ in range(6):
        trials = pool.where(F.col("id").isin(done) if done else F.lit(False)).withColumn("metric", F.lit(1.0)).withColumn("violations", F.lit(0)).withColumn("max_sigma", F.lit(1.0))
        got = search.next_trial(pool, trials, {"act": acts, "form": forms}, F.lit(True), initial=6)
        assert got["stage"] == "initial_maximin"
        done.append(got["id"])
    picked = [rows[i] for i in done]
    assert sorted(sum(r[1] == a for r in picked) for a in acts) == [3, 3]
    assert sorted(sum(r[2] == f for r in picked) for f in forms) == [2, 2, 2]
    trials = pool.where(F.col("id").isin(done)).withColumn("metric", F.col("rate")).withColumn("violations", F.lit(3)).withColumn("max_sigma", F.lit(1.2))
    got = search.next_trial(pool, trials, {"act": acts, "form": forms}, F.col("violations") == 0, initial=6)
    assert got["stage"] == "gp_lcb" and got["id"] not in done


def test_repeated_trials_count_as_their_mean_and_large_models_need_no_barrier(spark, monkeypatch):
    from sweeploom.operators import acquire, kriging, search

    draw = np.random.default_rng(4)
    places = draw.random((60, 2))
    at = draw.integers(0, 60, 150)
    values = np.sin(5 * places[at, 0]) + places[at, 1] + 0.01 * draw.standard_normal(150)
    rows = [(i, [float(v) for v in places[k]], "a", float(y), 0, 1.0) for i, (k, y) in enumerate(zip(at, values))]
    trials = spark.createDataFrame(rows, "id long, p array<double>, act string, metric double, violations int, max_sigma double")
    fresh = [[float(v) for v in p] for p in draw.random((40, 2))]
    pool = spark.createDataFrame([(1000 + i, fresh[i % 40], "a") for i in range(120)], "id long, p array<double>, act string")

    # Every trial on its own, in one matrix.
    mean, spread = values.mean(), values.std()
    models = [acquire.build(places[at], (values - mean) / spread, mean, spread, np.full(2, s), search.TRIAL_NOISE) for s in acquire.LENGTH_SCALES]
    best = max(models, key=lambda m: m.likelihood)
    mu, sd = best.posterior(np.array(fresh))
    pick = int((mu - 1.5 * sd).argmin())

    monkeypatch.setattr(kriging.LargeErrorModel, "_stage", None)  # the barrier stage
    for dense_points in (100, 59):  # fewer than the trials, but not than their points; fewer than both
        monkeypatch.setattr(acquire, "DENSE_POINTS", dense_points)
        got = search.next_trial(pool, trials, {"act": ["a"]}, F.lit(True))
        assert got["id"] == 1000 + pick and abs(got["predicted_objective"] - mu[pick]) < 1e-6


def test_block_factor_solves_like_a_whole_one(monkeypatch):
    from sweeploom.operators import kriging

    monkeypatch.setattr(kriging, "FACTOR_ROWS", 7)
    draw = np.random.default_rng(1)
    points, noise, b = draw.random((33, 2)), 0.01 + draw.random(33), draw.random((33, 4))
    whole = kriging.matern(points, points, np.array([0.3, 0.4])) + np.diag(noise)
    factor = kriging.Factor(points, np.array([0.3, 0.4]), noise)
    assert np.allclose(factor.backward(factor.forward(b)), np.linalg.solve(whole, b))
    steps = kriging.System(points, np.array([0.3, 0.4]), noise).solve(b, slice(0, 33))
    assert np.allclose(steps, np.linalg.solve(whole, b))


def test_sobol_strata_are_spread_and_free_of_lambdas(spark):
    from sweeploom.plans.bindings import models

    plan = models.sobol_strata(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "lambdafunction" not in plan
    rows = spark.createDataFrame([(0,), (5,), (None,)], "i long")
    got = {r["i"]: (r["u0"], r["u1"]) for r in designs.sobol(rows, "i", 2).collect()}
    directions = designs.sobol_directions(2)
    wanted = [(d[0] ^ d[1] ^ d[2]) / 2**designs.SOBOL_BITS for d in directions]  # 5 in Gray code: 111
    assert got[0] == (0.0, 0.0) and got[5] == tuple(wanted) and got[None] == (None, None)


def test_designs_of_one_small_file_are_drawn_in_many_tasks(spark):
    rows = spark.range(0, 40, 1, 1).withColumnRenamed("id", "i")
    made = designs.maximin_latin_hypercube(rows, "i", 40, 2, seed=3, designs=8)
    assert made.rdd.getNumPartitions() > 1 and made.count() == 40
    for count in (1, 2, 5, 40, 300):
        keys = [F.lit(7)]
        got = [r[0] for r in spark.range(count).select(designs.permuted(F.col("id"), count, keys)).collect()]
        assert sorted(got) == list(range(count))


def test_nan_metrics_rank_last_and_are_not_eligible(spark):
    from sweeploom.operators import metrics, trials

    rows = [(1, 0.5), (2, 1.0), (3, float("nan")), (4, 1e6), (5, None), (6, float("inf"))]
    data = spark.createDataFrame(rows, "trial int, metric double")
    got = {r["trial"]: (r["rank"], r["eligible"]) for r in trials.rerank(data, "metric", F.lit(True)).collect()}
    assert got == {1: (1, True), 2: (2, True), 4: (3, True), 6: (4, True), 3: (5, False), 5: (6, False)}
    best = {r["trial"]: r["rank"] for r in metrics.ranked(data.filter("metric is not null"), "metric", ["trial"]).collect()}
    assert best == {6: 1, 4: 2, 2: 3, 1: 4, 3: 5}


@pytest.mark.parametrize("name", ["dense_fit_history", "dense_predictions", "passivity_penalised_fit", "dc_regression", "sampled_grid_export", "maximin_design"])
def test_queries_keep_the_defaults_of_fits_and_designs(spark, monkeypatch, name):
    from sweeploom.plans.bindings import models

    class Called(Exception):
        pass

    def stop(*args, **options):
        raise Called({"epochs", "patience", "designs"} & set(options))

    monkeypatch.setattr(models.dense, "fit", stop)
    monkeypatch.setattr(models.designs, "maximin_latin_hypercube", stop)
    with pytest.raises(Called) as found:
        getattr(models, name)(spark, "/root/testdata/sf0.001")
    assert found.value.args[0] == set()


def test_batches_see_the_existing_points_of_all_nations(spark):
    from sweeploom.plans.bindings import models

    folder = "/root/testdata/sf0.001"
    assert models._existing(spark, folder).count() == models.table(spark, folder, "customer").count()


def test_extension_takes_a_finer_grid_when_the_first_is_too_coarse(spark):
    old = [{"name": "w", "lower": 0.0, "upper": 4.0}, {"name": "l", "lower": 0.0, "upper": 4.0}]
    new = [{"name": "w", "lower": 0.0, "upper": 6.0}, {"name": "l", "lower": 0.0, "upper": 6.0}]
    assert extend.fitting_places(old, new, 10, 0) == 0
    places = extend.fitting_places(old, new, 60, 0)
    assert places == 1
    known = spark.createDataFrame([(0, 1.0, 1.0, "train")], "row int, w double, l double, dataset string")
    out = extend.extended_inventory(known, old, new, 60, 15, places, "halton").where("slab IS NOT NULL")
    assert out.count() == 60 and out.select("w", "l").distinct().count() == 60
    with pytest.raises(ValueError):
        extend.fitting_places(old, new, 60, 0, most=0)


def test_suggestions_and_their_check_read_the_same_scores(spark, monkeypatch):
    from sweeploom.plans.bindings import models

    plain = models._unit_regions
    # The last digits of a sum differ from job to job.
    monkeypatch.setattr(models, "_unit_regions", lambda *a: plain(*a).withColumn("score", F.col("score") * (1.0 + 1e-12 * F.rand())))
    row = models.suggestion_provenance(spark, "/root/testdata/sf0.001").first()
    assert row["nearest"] and row["free"]


def test_a_row_held_once_counts_as_often_as_it_occurs():
    rng = np.random.default_rng(5)
    w, b = dense.xavier([2, 3, 8], 0)
    model = dense.DenseModel(w, b, "tanh", np.zeros(2), np.ones(2), rng.normal(size=8), rng.uniform(0.5, 2, 8))
    goal = dense.Objective(model, rng.uniform(0.5, 2, 8), 1.5, 2.0, False, None)
    often = rng.integers(1, 5, 40)
    rows = np.column_stack([rng.normal(size=(40, 10)), rng.uniform(0.5, 2, 40), often])
    single = np.repeat(rows, often, axis=0)
    single[:, -1] = 1.0
    np.testing.assert_allclose(goal.sums([rows]), goal.sums([single]), rtol=1e-10, atol=1e-12)
    m = rng.normal(size=(50, 2, 2)) + 1j * rng.normal(size=(50, 2, 2))
    m[0] = np.eye(2)
    m[1] = 0.0
    np.testing.assert_allclose(dense.largest_singular_values(m), np.linalg.svd(m, compute_uv=False)[:, 0], rtol=1e-13, atol=1e-300)
    # The slope is the one of the loss.
    total, flat, step = goal.sums([rows]), goal.flat(), 1e-6
    for at in (0, 7, len(flat) - 1):
        moved = []
        for sign in (1, -1):
            goal.load(flat + sign * step * (np.arange(len(flat)) == at))
            moved.append(goal.loss(goal.sums([rows], False)))
        np.testing.assert_allclose(goal.gradient(total)[at], (moved[0] - moved[1]) / (2 * step), rtol=1e-5)


def test_a_fit_sees_copies_as_rows(spark):
    df = line_rows(spark, 30)
    options = {"epochs": 8, "learning_rate": 0.05, "workers": 1}
    once, often = dense.fit(df, [3], **options), dense.fit(df.unionByName(df).unionByName(df), [3], **options)
    np.testing.assert_allclose([h[1] for h in often.history], [h[1] for h in once.history], rtol=1e-9)
    level = spark.createDataFrame([([1e9, float(v)], [3.0, float(v)]) for v in range(7)] * 3, "x array<double>, y array<double>")
    assert dense.fit(level, [3], **options).x_std[0] == 1.0
