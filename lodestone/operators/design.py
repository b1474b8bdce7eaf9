"""Numeric kernels of multi-objective experiment design."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import norm_cdf, norm_pdf

SATURATION, XI, RHO = 0.15, 0.01, 0.05


def pareto_2d(df: DataFrame, x: str, y: str, buckets: int = 64) -> DataFrame:
    """Rows that no row dominates (both minimised, one strictly less); equal rows all stay.

    Ranges of x are judged apart: a row is dominated by an earlier range exactly if the least y there is at most its
    own, so only each range's least y (one row a range) goes beyond its range. Within a range a running minimum decides.
    """
    cuts = df.approxQuantile(x, [k / buckets for k in range(1, buckets)], 0.01)
    edges = sorted(set(cuts))
    part = F.lit(0)
    for e in edges:
        part = part + F.when(F.col(x) > e, 1).otherwise(0)
    own = df.withColumn("_p", part)
    least = own.groupBy("_p").agg(F.min(y).alias("_m")).collect()  # at most `buckets` rows
    before, best = [], math.inf
    low = {r["_p"]: r["_m"] for r in least}
    for k in range(len(edges) + 1):
        before.append(best)
        best = min(best, low.get(k, math.inf))
    beyond = F.element_at(F.array(*map(F.lit, before)), F.col("_p") + 1)
    left = own.where(F.col(y) < beyond)
    run = Window.partitionBy("_p").orderBy(x, y)
    rows = left.withColumn("_less", F.min(y).over(run.rowsBetween(Window.unboundedPreceding, -1)))
    firsts = rows.where((F.col(y) < F.col("_less")) | F.col("_less").isNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    return left.join(firsts, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left_semi").drop("_p")


def _undominated(y: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
    """Which rows of y no row of `by` (y itself by default) dominates."""
    keep = np.ones(len(y), bool)
    own = y if by is None else by
    for k, i in enumerate(np.argsort(own.sum(axis=1), kind="stable")):
        if by is not None or keep[i]:
            keep &= ~((own[i] <= y).all(axis=1) & (own[i] < y).any(axis=1))
        if by is not None and k % 64 == 63 and not keep.any():
            break
    return keep


def pareto(df: DataFrame, objectives: list[str], block: int = 20_000) -> DataFrame:
    """O01 for any number of objectives, on doubles: rows that no row dominates; equal rows all stay, rows with a null don't count.

    Partitions give their own fronts first, and those are merged by eights as long as that shrinks them. If more than
    `block` different points are left, they are dealt into blocks, and each block meets each other one in a task of its
    own: no task holds more than two blocks, however large the front is.
    """
    own = df.dropna(subset=objectives)
    points = own.select(*[F.col(c).cast("double").alias(f"o{k}") for k, c in enumerate(objectives)])
    schema, names = points.schema, points.columns

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = (f if held is None else pd.concat([held, f])).drop_duplicates()
            held = f[_undominated(f[names].to_numpy(float))]
        if held is not None:
            yield held

    front = points.mapInPandas(local, schema)
    held = front.persist()
    n, parts = held.count(), held.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 8)
        if n > block * parts:
            break
        merged = held.coalesce(parts).mapInPandas(local, schema).persist()
        before, n = n, merged.count()
        held.unpersist()
        held = merged
        if n > 0.9 * before and n > block:
            break
    if parts > 1 or n > block:
        held = _between_blocks(held, names, -(-n // block))
    keys = [F.col(c).cast("double") == held[f"o{k}"] for k, c in enumerate(objectives)]
    met = keys[0]
    for k in keys[1:]:
        met = met & k
    return own.join(held, met, "left_semi")


def _between_blocks(points: DataFrame, names: list[str], blocks: int) -> DataFrame:
    """The points that none of any block dominates."""
    each = points.distinct().withColumn("i", F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left, right = each.withColumn("j", other), each.withColumnRenamed("i", "j").withColumn("i", other)

    def beaten(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return a[~_undominated(a[names].to_numpy(float), b[names].to_numpy(float))][names] if len(a) and len(b) else a[names][:0]

    gone = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(beaten, points.schema).distinct()
    return each.drop("i").join(gone, names, "left_anti")


def hypervolume_2d(front: DataFrame, x: str, y: str, ref: tuple[float, float]) -> DataFrame:
    """The area that a front of two minimised objectives dominates within the reference point, one row."""
    inside = front.where((F.col(x) < ref[0]) & (F.col(y) < ref[1])).groupBy(F.col(x).alias("x")).agg(F.min(F.col(y)).alias("y"))
    nxt = F.coalesce(F.lead("x").over(Window.orderBy("x")), F.lit(float(ref[0])))  # a front is small
    return inside.select(((nxt - F.col("x")) * (ref[1] - F.col("y"))).alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("hypervolume"))


#: Samples of one bitmap row (Spark's bitmaps have 32,768 bits).
SAMPLES_PER_ROW = 32_768


def sample_steps(dims: int, seed: int) -> list[tuple[float, float]]:
    """(start, step) of each dimension of an additive recurrence: point i is the fraction of start + (i + 1) * step.

    The steps are powers of the inverse of the root of x^(d+1) = x + 1, which spreads points evenly in d dimensions.
    """
    root = 2.0
    for _ in range(64):
        root = (1 + root) ** (1 / (dims + 1))
    return [((seed * 0.6180339887498949 + 0.5) % 1.0, (1 / root) ** (k + 1) % 1.0) for k in range(dims)]


def hypervolume(front: DataFrame, objectives: list[str], ref: list[float], samples: int = 7 * SAMPLES_PER_ROW, seed: int = 0) -> DataFrame:
    """O02 for any number of objectives: an estimate of what a front dominates within the reference point, one row.

    Sample points are numbered, and a number alone gives a point: every task makes the same ones, marks those that its
    part of the front dominates in bitmaps, and bitmaps are joined by or. So the estimate doesn't depend on partitions,
    and no task holds the front. `error` is a bound for three standard deviations of as many independent points (0.1 %
    of the box for 230,000 of them; an additive recurrence does better). Points that don't beat the reference count for
    nothing. `samples` is rounded up to whole bitmaps.
    """
    inside = F.lit(True)
    for c, r in zip(objectives, ref, strict=True):
        inside = inside & (F.col(c) < r)
    own = front.where(inside).select(*[F.col(c).cast("double").alias(f"o{k}") for k, c in enumerate(objectives)])
    low = list(own.agg(*[F.min(c) for c in own.columns]).first())
    if low[0] is None:
        return front.sparkSession.createDataFrame([(0.0, 0.0)], "hypervolume double, error double")
    rows, steps = -(-samples // SAMPLES_PER_ROW), sample_steps(len(ref), seed)
    at, span = np.array(low), np.array(ref, float) - np.array(low)

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros((rows, SAMPLES_PER_ROW), bool)
        for f in frames:
            y = f.to_numpy(float)
            for r in range(rows):
                i = np.arange(r * SAMPLES_PER_ROW, (r + 1) * SAMPLES_PER_ROW, dtype=float) + 1
                points = np.stack([(start + i * step) % 1.0 for start, step in steps], axis=1) * span + at
                for p in y:
                    left = np.flatnonzero(~bits[r])
                    bits[r, left[(points[left] >= p).all(axis=1)]] = True
        yield pd.DataFrame({"row": np.arange(rows), "bits": [np.packbits(b, bitorder="little").tobytes() for b in bits]})

    hits = own.mapInPandas(mark, "row long, bits binary").groupBy("row").agg(F.bitmap_or_agg("bits").alias("b")).agg(F.sum(F.bitmap_count("b")).alias("n"))
    share, box = F.col("n") / (rows * SAMPLES_PER_ROW), float(np.prod(span))
    return hits.select((share * box).alias("hypervolume"), (3 * F.sqrt(share * (1 - share) / (rows * SAMPLES_PER_ROW)) * box).alias("error"))


def reference_point(df: DataFrame, objectives: list[str]) -> DataFrame:
    """The worst value of each objective and a tenth of its span beyond (span 1 if there is none)."""
    far = lambda c: F.max(c) + 0.1 * F.when(F.max(c) == F.min(c), 1.0).otherwise(F.max(c) - F.min(c))
    return df.agg(*[far(c).alias(c) for c in objectives])


def encode(parameters: list[dict], value) -> Column:
    """Continuous clipped to its range, binary as 0 or 1, categorical one-hot (first choice by default). value(name) gives a column."""
    out = []
    for p in parameters:
        v = value(p["name"])
        if p["kind"] == "continuous":
            out.append(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - p["low"]) / (p["high"] - p["low"]))))
        elif p["kind"] == "binary":
            out.append(F.when(v, 1.0).otherwise(0.0))
        else:
            known = F.when(v.isin(*p["choices"]), v).otherwise(p["choices"][0])
            out += [F.when(known == c, 1.0).otherwise(0.0) for c in p["choices"]]
    return F.array(*out)


def expected_improvement(mu: Column, sigma: Column, best: float | Column) -> Column:
    """O08 (minimised)."""
    s = F.greatest(sigma, F.lit(1e-9))
    gain = best - mu - XI
    return F.greatest(F.lit(0.0), gain * norm_cdf(gain / s) + s * norm_pdf(gain / s))


def chebyshev(values: list[Column], weights: list[float]) -> Column:
    """The augmented Chebyshev scalar of normalised objectives."""
    terms = [w * v for w, v in zip(weights, values, strict=True)]
    return (F.greatest(*terms) if len(terms) > 1 else terms[0]) + RHO * sum(terms[1:], terms[0])


def log_prior(beliefs: list[tuple[str, float, int]], level) -> Column:
    """Saturating reward of including helpful and leaving out harmful components. level(name) gives a column in 0..1."""
    total = F.lit(0.0)
    for name, strength, direction in beliefs:
        x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), level(name)))
        x = x if direction > 0 else 1 - x
        if direction:
            total = total + strength * (2 * x / (x + SATURATION) - 1)
    return total


def decayed(beta: float, n: Column) -> Column:
    """The prior's weight after n observations."""
    return beta / (1.0 + n)


class GaussianProcess:
    """RBF kernel, median length scale, noise 1e-3, Cholesky; a numpy kernel for a bounded set of observations."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> GaussianProcess:
        self.x, self.mean = np.asarray(x, float), float(np.mean(y))
        self.std = float(np.std(y)) or 1.0
        d = np.sqrt(((self.x[:, None] - self.x[None]) ** 2).sum(-1))
        above = d[np.triu_indices(len(d), 1)]
        self.scale = float(np.median(above[above > 0])) if (above > 0).any() else 1.0
        self.chol = np.linalg.cholesky(np.exp(-0.5 * (d / self.scale) ** 2) + (1e-3 + 1e-8) * np.eye(len(d)))
        z = (np.asarray(y, float) - self.mean) / self.std
        self.alpha = np.linalg.solve(self.chol.T, np.linalg.solve(self.chol, z))
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.exp(-0.5 * ((np.asarray(x, float)[:, None] - self.x[None]) ** 2).sum(-1) / self.scale**2)
        v = np.linalg.solve(self.chol, k.T)
        return k @ self.alpha * self.std + self.mean, np.sqrt(np.maximum(1 - (v**2).sum(0), 1e-12)) * self.std


def score_pool(pool: DataFrame, x_col: str, model: GaussianProcess, best: float) -> DataFrame:
    """Expected improvement of a pool of candidates; the fitted model goes to the tasks, candidates stay where they are."""
    schema = pool.select("*", F.lit(0.0).alias("ei")).schema
    erf = np.vectorize(math.erf)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            mu, sigma = model.predict(np.stack(f[x_col].to_numpy()))
            gain, s = best - mu - XI, np.maximum(sigma, 1e-9)
            z = gain / s
            yield f.assign(ei=np.maximum(0.0, gain * 0.5 * (1 + erf(z / math.sqrt(2))) + s * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)))

    return pool.mapInPandas(run, schema)


def propose(observed: tuple[np.ndarray, np.ndarray], pool: DataFrame, x_col: str, id_col: str, batch: int, *, seed: int = 0, prior: str | None = None, weight: float = 0.0) -> list:
    """A batch of distinct candidates, each the best expected improvement of a random scalarisation (few slots, one job each).

    A log prior column multiplies the improvement by exp(weight * (prior - its maximum)).
    """
    x, y = observed
    span = np.where(np.ptp(y, axis=0) == 0, 1.0, np.ptp(y, axis=0))
    normal, rng, taken = (y - y.min(axis=0)) / span, np.random.default_rng(seed), []
    gain = F.col("ei")
    if prior and weight > 0:
        gain = gain * F.exp(weight * (F.col(prior) - F.lit(pool.agg(F.max(prior)).first()[0])))
    for _ in range(batch):
        w = rng.dirichlet(np.ones(y.shape[1]))
        scalar = (normal * w).max(axis=1) + RHO * (normal * w).sum(axis=1)
        model = GaussianProcess().fit(x, scalar)
        left = pool if not taken else pool.where(~F.col(id_col).isin(*taken))
        top = score_pool(left, x_col, model, float(scalar.min())).orderBy(gain.desc(), id_col).select(id_col).first()
        if top is None:
            break
        taken.append(top[0])
    return taken


def saturating(x: Column, k: float) -> Column:
    """X / (x + k)."""
    return x / (x + k)
