"""Error model over any number of observations: conjugate gradients without a matrix.

Tasks of one barrier stage share the points (a few doubles each) and multiply
their rows of the kernel with a vector, tile by tile; the products are added
along a tree.  A pivoted factor of small rank preconditions the system.  The
solve for the weights is shared by all tasks; the ones for the variances of the
candidates are each task's own, many right sides at a time.

Up to FACTOR_POINTS observations every task makes the triangular factor for its
candidates itself, block row by block row, and no barrier stage is needed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .together import TreeSum, stage_tasks

RANK = 200
TILE = 256
TOLERANCE = 1e-10
MOST_STEPS = 2_000
RIGHT_SIDES = 256
MOST_WORKERS = 64
# Observations up to which a task holds the lower triangle: half of 10,000 * 10,000 doubles, 400 MB.
FACTOR_POINTS = 10_000
FACTOR_ROWS = 512


def matern(a: np.ndarray, b: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Matern 5/2 correlation with one length per axis, axis by axis."""
    d2 = np.zeros((len(a), len(b)))
    for k, scale in enumerate(scales):
        d2 += ((a[:, k, None] - b[None, :, k]) / scale) ** 2
    r = np.sqrt(5.0 * d2)
    return (1.0 + r + 5.0 / 3.0 * d2) * np.exp(-r)


def pivoted_factor(points: np.ndarray, scales: np.ndarray, rank: int = RANK) -> np.ndarray:
    """F with F F' close to the kernel: the row with the largest remainder is taken out in each step."""
    left = np.ones(len(points))
    out = np.zeros((len(points), min(rank, len(points))))
    for k in range(out.shape[1]):
        at = int(left.argmax())
        if left[at] < 1e-12:
            return out[:, :k]
        column = matern(points, points[at : at + 1], scales)[:, 0] - out[:, :k] @ out[at, :k]
        out[:, k] = column / np.sqrt(left[at])
        left = np.maximum(left - out[:, k] ** 2, 0.0)
    return out


class Factor:
    """Lower triangle of kernel + noise in rows of blocks; nothing is stored right of the diagonal."""

    def __init__(self, points: np.ndarray, scales: np.ndarray, noise: np.ndarray) -> None:
        self.rows, self.inverses = [], []
        for lo in range(0, len(points), FACTOR_ROWS):
            own = slice(lo, min(lo + FACTOR_ROWS, len(points)))
            row = np.empty((own.stop - lo, own.stop))
            for at, earlier, inverse in [*zip(range(0, lo, FACTOR_ROWS), self.rows, self.inverses), (lo, None, None)]:
                part = slice(at, min(at + FACTOR_ROWS, len(points)))
                block = matern(points[own], points[part], scales)
                if earlier is not None:
                    row[:, part] = (block - row[:, :at] @ earlier[:, :at].T) @ inverse.T
                    continue
                block[np.diag_indices(len(block))] += noise[own]
                row[:, part] = np.linalg.cholesky(block - row[:, :at] @ row[:, :at].T)
            self.rows.append(row)
            self.inverses.append(np.linalg.inv(row[:, lo:]))

    def forward(self, b: np.ndarray) -> np.ndarray:
        """x with L x = b."""
        x = np.empty_like(b)
        for k, (row, inverse) in enumerate(zip(self.rows, self.inverses)):
            lo = k * FACTOR_ROWS
            x[lo : lo + len(row)] = inverse @ (b[lo : lo + len(row)] - row[:, :lo] @ x[:lo])
        return x

    def backward(self, b: np.ndarray) -> np.ndarray:
        """x with L' x = b."""
        x = b.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            lo, row = k * FACTOR_ROWS, self.rows[k]
            x[lo : lo + len(row)] = self.inverses[k].T @ x[lo : lo + len(row)]
            x[:lo] -= row[:, :lo].T @ x[lo : lo + len(row)]
        return x


class System:
    """(kernel + noise) x = b; ``rows`` is the part that this task multiplies, ``total`` adds up the parts."""

    def __init__(self, points: np.ndarray, scales: np.ndarray, noise: float | np.ndarray) -> None:
        self.points, self.scales = points, scales
        self.noise = np.broadcast_to(np.asarray(noise, dtype=float), len(points))[:, None]
        f = pivoted_factor(points, scales)
        rest = float(np.maximum(1.0 - (f**2).sum(axis=1), 0.0).mean())
        self.f, self.shift = f, max(float(self.noise.mean()), rest, 1e-12)
        self.inner = np.linalg.inv(self.shift * np.eye(f.shape[1]) + f.T @ f)

    def times(self, x: np.ndarray, rows: slice) -> np.ndarray:
        out = np.zeros_like(x)
        for at in range(rows.start, rows.stop, TILE):
            part = slice(at, min(at + TILE, rows.stop))
            out[part] = matern(self.points[part], self.points, self.scales) @ x + self.noise[part] * x[part]
        return out

    def eased(self, r: np.ndarray) -> np.ndarray:
        return (r - self.f @ (self.inner @ (self.f.T @ r))) / self.shift

    def solve(self, b: np.ndarray, rows: slice, total=lambda part: part) -> np.ndarray:
        """Columns of x for the columns of b, each to TOLERANCE of its own size."""
        x, r = np.zeros_like(b), b.copy()
        size = np.maximum(np.linalg.norm(b, axis=0), 1e-300)
        z = self.eased(r)
        p, rz = z.copy(), (r * z).sum(axis=0)
        for _ in range(MOST_STEPS):
            if (np.linalg.norm(r, axis=0) <= TOLERANCE * size).all():
                return x
            kp = total(self.times(p, rows))
            step = rz / np.maximum((p * kp).sum(axis=0), 1e-300)
            x += step * p
            r -= step * kp
            z = self.eased(r)
            new = (r * z).sum(axis=0)
            p = z + (new / np.maximum(rz, 1e-300)) * p
            rz = new
        raise ArithmeticError(f"no solution in {MOST_STEPS} steps; raise the noise variance")


@dataclass
class LargeErrorModel:
    """Posterior of log error; ``observed`` has (p, t): points and standardised targets.

    A column ``n`` tells how many observations of one point ``t`` is the mean of.
    """

    observed: DataFrame
    mean: float
    spread: float
    scales: np.ndarray
    noise: float

    def __post_init__(self) -> None:
        if "n" not in self.observed.columns:
            self.observed = self.observed.withColumn("n", F.lit(1))

    def _stage(self, candidates: DataFrame, work, schema: str) -> DataFrame:
        """``work(system, targets, rows, total, batches)`` in every task; batches are ids and points of candidates."""
        scales, noise, token = self.scales, self.noise, uuid.uuid4().bytes
        width = len(scales)
        both = self.observed.select(F.lit(None).cast("long").alias("id"), "p", "t", F.col("n").cast("double").alias("n")).unionByName(
            candidates.select("id", "p", F.lit(0.0).alias("t"), F.lit(1.0).alias("n"))
        )
        tasks = stage_tasks(self.observed.sparkSession.sparkContext, MOST_WORKERS)

        def run(batches):
            import pyarrow as pa
            from pyspark import BarrierTaskContext

            ids, rows = [], [np.zeros((0, width + 2))]
            for batch in batches:
                points = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                rows.append(np.column_stack([points, *[batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)]]))
                ids.append(batch.column(0))
            own = np.concatenate(rows)
            ident = pa.chunked_array(ids, pa.int64()).combine_chunks()
            seen = np.asarray(ident.is_null().to_numpy(zero_copy_only=False), bool)
            stage = BarrierTaskContext.get()
            counts = [int(n) for n in stage.allGather(str(int(seen.sum())))]
            tree = TreeSum(stage, token)
            first = sum(counts[: tree.rank])
            shared = np.zeros((sum(counts), width + 2))
            shared[first : first + counts[tree.rank]] = own[seen]
            shared = tree.total(shared.reshape(-1)).reshape(-1, width + 2)
            system = System(shared[:, :width], scales, noise / shared[:, width + 1])
            part = slice(first, first + counts[tree.rank])
            together = lambda x: tree.total(x.reshape(-1)).reshape(x.shape)
            left = np.flatnonzero(~seen)
            yield from work(system, shared[:, width : width + 1], part, together, ident.take(pa.array(left)), own[left, :width])
            tree.close()

        # A shuffle behind it lets Spark start a failed barrier stage again.
        dealt = both.repartition(tasks).mapInArrow(run, schema, barrier=True)
        return dealt.repartition(tasks)

    def posterior(self, candidates: DataFrame) -> DataFrame:
        """``id, log_mean, variance`` of candidates (id, p); the variance is the one of the standardised targets."""
        mean, spread = self.mean, self.spread
        rows = self.observed.select("p", "t", "n").limit(FACTOR_POINTS + 1).collect()
        if len(rows) <= FACTOR_POINTS:
            return self._factored(candidates, rows)

        def work(system, targets, part, total, ids, points):
            import pyarrow as pa

            weights = system.solve(targets, part, total)
            everything = slice(0, len(system.points))
            for at in range(0, len(points), RIGHT_SIDES):
                k = matern(system.points, points[at : at + RIGHT_SIDES], system.scales)
                variance = np.maximum(0.0, 1.0 - (k * system.solve(k, everything)).sum(axis=0))
                log_mean = mean + spread * (k.T @ weights)[:, 0]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(variance)), pa.array(log_mean), pa.array(variance)], names=["id", "log_mean", "variance"])

        return self._stage(candidates, work, "id long, log_mean double, variance double")

    def _factored(self, candidates: DataFrame, rows: list) -> DataFrame:
        """The posterior from a factor that each task makes of the shared observations."""
        mean, spread, scales, noise = self.mean, self.spread, self.scales, self.noise
        rows = sorted((r["p"], r["t"], r["n"]) for r in rows)
        context = candidates.sparkSession.sparkContext
        shared = context.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), noise / np.array([r[2] for r in rows], dtype=float)))

        def run(batches):
            import pyarrow as pa

            factor = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                points, targets, own_noise = shared.value
                if factor is None:
                    factor = Factor(points, scales, own_noise)
                    weights = factor.backward(factor.forward(targets[:, None]))[:, 0]
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for at in range(0, len(x), RIGHT_SIDES):
                    k = matern(points, x[at : at + RIGHT_SIDES], scales)
                    variance = np.maximum(0.0, 1.0 - (factor.forward(k) ** 2).sum(axis=0))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(variance)), pa.array(mean + spread * (k.T @ weights)), pa.array(variance)], names=["id", "log_mean", "variance"]
                    )

        # A factor costs more than many candidates, so it is made once a core.
        dealt = candidates.select("id", "p").repartition(stage_tasks(context, MOST_WORKERS))
        return dealt.mapInArrow(run, "id long, log_mean double, variance double")

    def weights(self) -> DataFrame:
        """``p, weight`` of every observation: the posterior mean is their sum over the kernel."""

        def work(system, targets, part, total, ids, points):
            import pyarrow as pa

            found, own = system.solve(targets, part, total)[part, 0], system.points[part]
            flat = pa.array(own.reshape(-1))
            places = pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(places, flat), pa.array(found)], names=["p", "weight"])

        none = self.observed.select(F.lit(0).cast("long").alias("id"), "p").limit(0)
        return self._stage(none, work, "p array<double>, weight double")

    def covariances(self, candidates: DataFrame, pick: np.ndarray) -> DataFrame:
        """``id, covariance`` of every candidate with one point, given the observations."""

        def work(system, targets, part, total, ids, points):
            import pyarrow as pa

            solved = system.solve(matern(system.points, pick[None, :], system.scales), part, total)[:, 0]
            for at in range(0, len(points), 4096):
                x = points[at : at + 4096]
                value = matern(x, pick[None, :], system.scales)[:, 0] - matern(x, system.points, system.scales) @ solved
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(x)), pa.array(value)], names=["id", "covariance"])

        return self._stage(candidates, work, "id long, covariance double")
