"""Dense regression: data-parallel fit, batch prediction, passivity penalty,
post-fit contraction, and DC conductance extraction."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.complexmath import s_to_y_stack, to_matrices
from .together import TreeSum, stage_tasks

# Optimiser constants.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
# Most tasks of a fit, and the rows a task works on at a time.
MOST_WORKERS = 64
CHUNK_ROWS = 16_384


@dataclass
class DenseModel:
    """Layer weights with the scalers of both ends; small enough to broadcast."""

    weights: list
    biases: list
    activation: str
    x_mean: np.ndarray
    x_std: np.ndarray
    y_mean: np.ndarray
    y_std: np.ndarray
    history: list = field(default_factory=list)

    def hidden(self, x: np.ndarray) -> list:
        layers = [x]
        for k, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = layers[-1] @ w + b
            last = k == len(self.weights) - 1
            layers.append(z if last else (np.tanh(z) if self.activation == "tanh" else np.maximum(z, 0.0)))
        return layers

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Physical outputs for physical inputs."""
        return self.hidden((x - self.x_mean) / self.x_std)[-1] * self.y_std + self.y_mean


def xavier(sizes: Sequence[int], seed: int) -> tuple[list, list]:
    rng = np.random.default_rng(seed)
    weights = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        bound = (6.0 / (a + b)) ** 0.5
        weights.append(rng.uniform(-bound, bound, (a, b)))
    return weights, [np.zeros(b) for b in sizes[1:]]


def predict(rows: DataFrame, model, x: str = "x", out: str = "prediction") -> DataFrame:
    """Score rows with any object that has ``predict(matrix)``; the model is
    broadcast once and applied to Arrow batches.  A model that tells its input
    width (``x_mean``) gets plain double columns, which need no unpacking."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width = len(getattr(model, "x_mean", ()))

    @F.pandas_udf("array<double>")
    def score(*columns: pd.Series) -> pd.Series:
        first = columns[0]
        if not len(first):
            return pd.Series([], dtype=object)
        matrix = np.column_stack([c.to_numpy(dtype=float) for c in columns]) if width else np.stack(first.to_numpy()).astype(float)
        return pd.Series(list(shared.value.predict(matrix)), index=first.index)

    inputs = [F.get(x, F.lit(k)) for k in range(width)] if width else [F.col(x)]
    return rows.withColumn(out, score(*inputs))


def compose(prediction: Column, coarse: Column, mode: str, scale: float = 1.0) -> Column:
    """Final response of a composite model: residual modes add the coarse
    response; the RF scale multiplies the sum."""
    if mode not in ("plain", "residual", "prior-input"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "residual":
        return F.zip_with(prediction, coarse, lambda p, c: (p + c) * F.lit(scale))
    return F.transform(prediction, lambda p: p * F.lit(scale))


def array_scaler(rows: DataFrame, column: str, floor_constant: bool, copies: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population std per position of an array column, from aggregate rows;
    ``copies`` names how often a row counts."""
    first = rows.select(F.size(column).alias("n")).first()
    width = first["n"] if first else 0
    at = [F.get(column, F.lit(k)).cast("double") for k in range(width)]
    often = F.col(copies) if copies else F.lit(1)

    def average(values: Sequence[Column]) -> np.ndarray:
        if not values:
            return np.zeros(0)
        present = [F.sum(F.when(v.isNotNull(), often)) for v in values]
        row = rows.agg(*[(F.sum(v * often) / n).alias(f"m{k}") for k, (v, n) in enumerate(zip(values, present))]).first()
        return np.array([row[f"m{k}"] for k in range(width)], dtype=float)

    # From the least value on, so that a constant column has exactly no spread.
    low = rows.agg(*[F.min(c).alias(f"l{k}") for k, c in enumerate(at)]).first() if width else ()
    mean = np.array(low, dtype=float) + average([c - F.lit(v) for c, v in zip(at, low)])
    std = np.sqrt(average([(c - F.lit(float(m))) ** 2 for c, m in zip(at, mean)]))
    # The last digits of a sum differ with the order of its rows, and the first steps of
    # a fit would blow them up: both are kept to 2^-40 of the spread.
    step = np.exp2(np.floor(np.log2(np.where(std > 0, std, 1.0))) - 40)
    mean, std = np.where(std > 0, np.round(mean / step) * step, mean), np.round(std / step) * step
    flat = std < 1e-12
    floor = float(np.median(std[~flat])) if floor_constant and (~flat).any() else 1.0
    return mean, np.where(flat, floor, std)


def penalty_terms(sigma: np.ndarray, weights: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray]:
    """Excess over the target and its weighted square, per sample."""
    excess = np.maximum(0.0, sigma - target)
    return excess, weights * excess**2


def largest_singular_values(m: np.ndarray) -> np.ndarray:
    """Largest singular value of each matrix; of 2x2 matrices in closed form."""
    if m.shape[1:] != (2, 2):
        return np.linalg.svd(m, compute_uv=False)[:, 0]
    a, b, c, d = m[:, 0, 0], m[:, 0, 1], m[:, 1, 0], m[:, 1, 1]
    left = (a * a.conj() + c * c.conj()).real
    right = (b * b.conj() + d * d.conj()).real
    cross = a.conj() * b + c.conj() * d
    return np.sqrt((left + right + np.sqrt((left - right) ** 2 + 4.0 * (cross * cross.conj()).real)) / 2.0)


class Rows:
    """Rows of one task as doubles in an unnamed file, so that memory does not grow with them."""

    def __init__(self, width: int) -> None:
        self.width, self.count, self.file = width, 0, tempfile.TemporaryFile()

    def add(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, dtype=float).tobytes())
        self.count += len(values)

    def chunks(self):
        if self.count:
            self.file.flush()
            held = np.memmap(self.file, float, "r", shape=(self.count, self.width))
            for at in range(0, self.count, CHUNK_ROWS):
                yield held[at : at + CHUNK_ROWS]


@dataclass
class FitState:
    """Where a fit stands after ``step`` steps; what a lost stage goes on from."""

    flat: np.ndarray
    first: np.ndarray
    second: np.ndarray
    best_flat: np.ndarray
    best: float = np.inf
    best_step: int = 0
    step: int = 0
    done: bool = False
    history: list = field(default_factory=list)

    def update(self, gradient: np.ndarray, learning_rate: float) -> None:
        self.first = BETA1 * self.first + (1 - BETA1) * gradient
        self.second = BETA2 * self.second + (1 - BETA2) * gradient**2
        upright = self.first / (1 - BETA1**self.step), self.second / (1 - BETA2**self.step)
        self.flat = self.flat - learning_rate * upright[0] / (np.sqrt(upright[1]) + EPSILON)


@dataclass
class Objective:
    """Weighted squared error in scaled outputs, with a passivity penalty on the response.

    The penalty is lambda * (mean(w e^2) + sqrt(mean((w e^2)^2))).  The slope of its
    root needs a mean over all rows, so that part is summed apart and scaled when
    the mean is known: one exchange a step.  With ``coarse`` columns the response
    is their sum with the outputs.  The last two columns of a row are its weight and
    how often it counts.
    """

    model: DenseModel
    column_weight: np.ndarray
    target: float | None
    penalty: float
    coarse: bool
    extra: Callable | None

    def __post_init__(self) -> None:
        self.shapes = [w.shape for w in self.model.weights] + [b.shape for b in self.model.biases]
        self.size = sum(int(np.prod(s)) for s in self.shapes)
        self.inputs, self.outputs = len(self.model.x_mean), len(self.model.y_mean)

    def load(self, flat: np.ndarray) -> None:
        parts = np.split(flat, np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1])
        shaped = [p.reshape(s) for p, s in zip(parts, self.shapes)]
        n = len(self.model.weights)
        self.model.weights, self.model.biases = shaped[:n], shaped[n:]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.reshape(-1) for w in self.model.weights] + list(self.model.biases))

    def _back(self, layers: list, delta: np.ndarray) -> np.ndarray:
        by_weight, by_bias = [], []
        for k in range(len(self.model.weights) - 1, -1, -1):
            by_weight.append((layers[k].T @ delta).reshape(-1))
            by_bias.append(delta.sum(axis=0))
            if k:
                back = delta @ self.model.weights[k].T
                delta = back * (1.0 - layers[k] ** 2 if self.model.activation == "tanh" else layers[k] > 0)
        return np.concatenate(by_weight[::-1] + by_bias[::-1])

    def sums(self, chunks, slope: bool = True) -> np.ndarray:
        """Rows, loss, sum of squared penalties, then both parts of the gradient."""
        out = np.zeros(3 + (2 * self.size if slope else 0))
        for rows in chunks:
            x, y = rows[:, : self.inputs], rows[:, self.inputs : self.inputs + self.outputs]
            w, often = rows[:, -2], rows[:, -1]
            layers = self.model.hidden(x)
            error = layers[-1] - y
            weighted = w[:, None] * self.column_weight * error
            out[0] += float(often.sum())
            out[1] += float((often[:, None] * weighted * error).sum()) / self.outputs
            delta = (2.0 / self.outputs) * often[:, None] * weighted
            if self.penalty > 0:
                raw = layers[-1] * self.model.y_std + self.model.y_mean
                if self.coarse:
                    raw = raw + rows[:, self.inputs + self.outputs : -2]
                half = self.outputs // 2
                ports = int(round(half**0.5))
                matrices = (raw[:, :half] + 1j * raw[:, half:]).reshape(-1, ports, ports)
                excess, squared = penalty_terms(largest_singular_values(matrices), w, self.target)
                out[1] += self.penalty * float((often * squared).sum())
                out[2] += float((often * squared**2).sum())
                beyond = np.flatnonzero(excess > 0)
                if slope and len(beyond):
                    # Only a value beyond the target has a slope.
                    u, _, vh = np.linalg.svd(matrices[beyond])
                    top = (u[:, :, :1] * vh[:, :1, :]).reshape(len(beyond), -1)
                    pull = np.concatenate([top.real, top.imag], axis=1) * self.model.y_std
                    pull *= (2.0 * self.penalty * w * excess * often)[beyond, None]
                    delta[beyond] += pull
                    out[3 + self.size :] += self._back([z[beyond] for z in layers], pull * squared[beyond, None])
            if slope:
                if self.extra is not None:
                    more, lean = self.extra(layers[-1], y, w)
                    out[1] += more
                    delta = delta + lean
                out[3 : 3 + self.size] += self._back(layers, delta)
        return out

    def loss(self, total: np.ndarray) -> float:
        return float(total[1] / max(total[0], 1.0) + self.penalty * self._root(total))

    def gradient(self, total: np.ndarray) -> np.ndarray:
        plain, rooted = total[3 : 3 + self.size], total[3 + self.size :]
        return (plain + rooted / max(self._root(total), 1e-300)) / max(total[0], 1.0)

    @staticmethod
    def _root(total: np.ndarray) -> float:
        return float(np.sqrt(total[2] / max(total[0], 1.0)))


def fit(
    rows: DataFrame,
    hidden: Sequence[int],
    activation: str = "tanh",
    epochs: int = 200,
    learning_rate: float = 2e-3,
    patience: int = 50,
    seed: int = 1234,
    output_weights: Sequence[float] | None = None,
    row_weight: str | None = None,
    passivity_target: float | None = None,
    passivity_penalty: float = 0.0,
    coarse: str | None = None,
    extra_gradient: Callable | None = None,
    batch_share: float = 1.0,
    check: DataFrame | None = None,
    check_interval: int = 1,
    workers: int | None = None,
    save_interval: int = 100,
    state: str | None = None,
) -> DenseModel:
    """Fit ``y`` arrays from ``x`` arrays with synchronous data-parallel Adam.

    Equal rows are held once with their number, and every sum counts them as often;
    with ``extra_gradient``, which sees single rows, all are held.
    ``workers`` tasks of one barrier stage (as many as the session's parallelism and
    the rows held need, up to MOST_WORKERS) hold the rows over all steps; a step adds their gradient
    sums along a tree, and every task makes the same update.  The stage ends every
    ``save_interval`` steps with the weights and the optimiser's state: a lost
    executor costs the steps since then, and with a ``state`` folder a new session
    goes on from there too.  ``batch_share`` < 1 uses a hash-chosen share of rows
    per step.  ``coarse`` names the coarse response that the composite form adds
    before the passivity penalty.  Barrier stages need a fixed number of executors.
    """
    spark = rows.sparkSession
    names = ["x", "y", *([coarse] if coarse else []), *([row_weight] if row_weight else [])]

    def held(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        if extra_gradient is not None:
            return df.select(*columns, F.lit(1).cast("long").alias("__often"))
        # Sorted, so that sums do not depend on where a row was before.
        return df.groupBy(*columns).agg(F.count("*").alias("__often")).sortWithinPartitions(*columns)

    rows = held(rows, names).persist(StorageLevel.MEMORY_AND_DISK)
    x_mean, x_std = array_scaler(rows, "x", False, "__often")
    y_mean, y_std = array_scaler(rows, "y", True, "__often")
    wanted = np.ones(len(y_mean)) if output_weights is None else np.asarray(output_weights, dtype=float)
    # The requested weight is one on physical error, not on the scaled column.
    column_weight = wanted * y_std**2
    column_weight = column_weight / column_weight.mean()
    weights, biases = xavier([len(x_mean), *hidden, len(y_mean)], seed)
    model = DenseModel(weights, biases, activation, x_mean, x_std, y_mean, y_std)
    penalised = passivity_penalty > 0 and passivity_target is not None
    goal = Objective(model, column_weight, passivity_target, passivity_penalty if penalised else 0.0, bool(coarse), extra_gradient)

    # Plain scaled double columns reach the tasks as whole Arrow buffers.
    def spread(df: DataFrame, weight: Column, checking: bool) -> DataFrame:
        scaled = lambda c, mean, std: [
            ((F.get(c, F.lit(k)).cast("double") - F.lit(float(m))) / F.lit(float(d))).alias(f"{c}{k}")
            for k, (m, d) in enumerate(zip(mean, std))
        ]
        added = [F.get(coarse, F.lit(k)).cast("double").alias(f"c{k}") for k in range(len(y_mean) if coarse else 0)]
        return df.select(
            *scaled("x", x_mean, x_std), *scaled("y", y_mean, y_std), *added, weight.cast("double").alias("w"), F.col("__often").cast("double").alias("often"),
            F.lit(checking).alias("checking"), F.xxhash64("x", "y").alias("h") if batch_share < 1.0 else F.lit(0).cast("long").alias("h"),
        )

    data = spread(rows, F.col(row_weight) if row_weight else F.lit(1.0), False)
    if check is not None:
        data = data.unionByName(spread(held(check, ["x", "y", *([coarse] if coarse else [])]), F.lit(1.0), True))
    # A task has at least one chunk of rows to work on.
    tasks = workers or min(stage_tasks(spark.sparkContext, MOST_WORKERS), max(1, -(-data.count() // CHUNK_ROWS)))
    dealt = data.repartition(tasks) if extra_gradient is not None else data.repartition(tasks, F.xxhash64(*data.columns))
    data = dealt.sortWithinPartitions(*data.columns).persist(StorageLevel.MEMORY_AND_DISK)
    has_check = check is not None

    def run(start: FitState, until: int, token: bytes) -> bytes:
        def work(batches):
            import pyarrow as pa
            from pyspark import BarrierTaskContext

            at = start
            width = goal.inputs + goal.outputs * (2 if goal.coarse else 1) + 2
            train, judge, marks = Rows(width), Rows(width), []
            for batch in batches:
                values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:width]])
                checking = np.asarray(batch.column(width).to_numpy(zero_copy_only=False), bool)
                train.add(values[~checking])
                judge.add(values[checking])
                if batch_share < 1.0:
                    marks.append(batch.column(width + 1).to_numpy()[~checking])
            mark = np.concatenate(marks) if marks else np.zeros(0, np.int64)
            tree = TreeSum(BarrierTaskContext.get(), token)
            while at.step < until and not at.done:
                at.step += 1
                goal.load(at.flat)
                total = tree.total(goal.sums(_batch(train, mark, at.step, batch_share)))
                loss = judged = goal.loss(total)
                looked = not has_check or at.step % check_interval == 0
                if has_check and looked:
                    judged = goal.loss(tree.total(goal.sums(judge.chunks(), False)))
                at.history.append((at.step, loss, judged))
                if looked and judged < at.best:
                    at.best, at.best_flat, at.best_step = judged, at.flat.copy(), at.step
                elif looked and at.step - at.best_step >= patience:
                    at.done = True
                    break
                at.update(goal.gradient(total), learning_rate)
            tree.close()
            if tree.rank == 0:
                yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(at)]})

        # Spark starts a failed barrier stage again only if a shuffle follows it.
        return data.mapInArrow(work, "state binary", barrier=True).repartition(1).collect()[0]["state"]

    flat = goal.flat()
    at = FitState(flat, np.zeros(len(flat)), np.zeros(len(flat)), flat.copy())
    saved = _last_state(spark, state)
    if saved is not None:
        at = saved
    while at.step < epochs and not at.done:
        packed = run(at, min(epochs, at.step + save_interval), uuid.uuid4().bytes)
        at = pickle.loads(packed)
        if state:
            spark.createDataFrame([(at.step, packed)], "step int, state binary").write.mode("append").parquet(state)
    goal.load(at.best_flat)
    model.history = at.history
    data.unpersist()
    rows.unpersist()
    return model


def _batch(train: Rows, mark: np.ndarray, step: int, share: float):
    """All rows, or those whose hash with the step falls into the share."""
    if share >= 1.0:
        yield from train.chunks()
        return
    done = 0
    for rows in train.chunks():
        with np.errstate(over="ignore"):
            x = mark[done : done + len(rows)].view(np.uint64) ^ (np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = x ^ (x >> np.uint64(31))
        done += len(rows)
        yield rows[(x % np.uint64(1_000_000)) < np.uint64(int(share * 1_000_000))]


def _last_state(spark, folder: str | None) -> FitState | None:
    """The latest state in ``folder``; None where nothing was saved yet."""
    if not folder:
        return None
    try:
        last = spark.read.parquet(folder).orderBy(F.desc("step")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return pickle.loads(last["state"]) if last else None


def project_outputs(model: DenseModel, projection: np.ndarray) -> DenseModel:
    """Fold a linear map of the physical outputs into the last layer."""
    scaled = (model.y_std[:, None] / model.y_std[None, :]) * projection
    shift = (model.y_mean @ projection - model.y_mean) / model.y_std
    model.biases[-1] = model.biases[-1] @ scaled + shift
    model.weights[-1] = model.weights[-1] @ scaled
    return model


def reciprocity_projection(ports: int) -> np.ndarray:
    """Averages Sij with Sji in the flattened real and imaginary outputs."""
    n2 = ports * ports
    swap = np.zeros((n2, n2))
    for i in range(ports):
        for j in range(ports):
            swap[i * ports + j, j * ports + i] = 1.0
    return np.kron(np.eye(2), 0.5 * (np.eye(n2) + swap))


def contraction(predicted: DataFrame, matrix: str = "prediction", margin: float = 0.0) -> float:
    """Factor that brings the largest predicted singular value to 1 - margin; 1
    when it is there already."""
    from ..functions.complexmath import largest_singular

    sigma = predicted.select(largest_singular(F.col(matrix)).alias("s")).agg(F.max("s").alias("m")).first()["m"]
    target = 1.0 - margin
    return 1.0 if sigma is None or sigma <= target else target / float(sigma)


# --- DC conductances -----------------------------------------------------------


def branch_matrix(ports: int, branches: Sequence[tuple[int, int | None]]) -> np.ndarray:
    """Columns are the flattened admittance patterns of unit branches; a branch
    ends at a port (from 1) or at ground (None)."""
    columns = []
    for a, b in branches:
        y = np.zeros((ports, ports))
        y[a - 1, a - 1] += 1.0
        if b is not None:
            y[b - 1, b - 1] += 1.0
            y[a - 1, b - 1] -= 1.0
            y[b - 1, a - 1] -= 1.0
        columns.append(y.reshape(-1))
    return np.array(columns).T


def nonnegative_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares with an active set (Lawson and Hanson)."""
    n = a.shape[1]
    x = np.zeros(n)
    free = np.zeros(n, dtype=bool)
    slope = a.T @ (b - a @ x)
    limit = 1e-12 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(10 * n + 10):
        if free.all() or slope[~free].max(initial=-np.inf) <= limit:
            break
        free[np.argmax(np.where(free, -np.inf, slope))] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if trial[free].min(initial=np.inf) > 0:
                break
            low = free & (trial <= 0)
            step = np.min(x[low] / (x[low] - trial[low]))
            x = x + step * (trial - x)
            free &= x > 1e-15
            x[~free] = 0.0
        x = trial
        slope = a.T @ (b - a @ x)
    return x


def conductances(
    dc: DataFrame,
    block: Sequence[str],
    ports: int,
    branches: Sequence[tuple[int, int | None]],
    z0: float = 50.0,
    open_threshold_ohm: float = 1e9,
    open_resistance_ohm: float = 1e12,
) -> DataFrame:
    """Branch conductances of each block from its usable zero-Hz matrices.

    ``dc`` has one row per usable matrix.  Conductances are found per row and
    averaged per block; an average below 1/threshold counts as open.
    """
    pattern = branch_matrix(ports, branches)

    @F.pandas_udf("array<double>")
    def extract(m: pd.Series) -> pd.Series:
        if not len(m):
            return pd.Series([], dtype=object)
        y = s_to_y_stack(to_matrices(m), z0)
        target = np.real(y + y.swapaxes(1, 2)) / 2.0
        return pd.Series([nonnegative_fit(pattern, t.reshape(-1)) for t in target], index=m.index)

    rows = dc.select(*block, F.posexplode(extract(F.col("matrix"))).alias("branch", "g"))
    means = rows.groupBy(*block, "branch").agg(F.avg("g").alias("g"))
    is_open = F.col("g") < F.lit(1.0 / open_threshold_ohm)
    return means.select(
        *block,
        "branch",
        F.when(is_open, F.lit(1.0 / open_resistance_ohm)).otherwise(F.col("g")).alias("conductance"),
        is_open.alias("is_open"),
    ).withColumn("log_conductance", F.log("conductance"))
