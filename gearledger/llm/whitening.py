"""Embedding whitening by incremental eigendecomposition.

Every partition keeps the spectrum (eigenvalues and eigenvectors) of its centred scatter matrix
and takes in one vector after another: a rank-one update, whose eigenvalues are the roots of a
secular equation between the old ones and whose eigenvectors follow from them; coordinates that
change nothing and eigenvalues that coincide are deflated first. ``STREAMS`` such spectra grow
side by side, so that the roots of many updates are found in one array operation. Two spectra
are combined by as many rank-one updates as one of them has directions, and one more for the
distance of the means. The combined basis is refined once by Rayleigh-Ritz: a distributed pass
projects the vectors, centred at their exact mean, on the basis, and the eigenvectors of the small
projected covariance turn it. The basis spans the whole space, so the result is exact to double
precision however the updates were rounded.

Scale: the list of distinct vectors is read twice, once to update and once to refine; what moves
is one spectrum per partition, combined ``WIDTH`` at a time in rounds. The driver holds one
basis (the square of the vectors' length) and no vector. A vector with very many copies combines
before the shuffle that makes the list distinct.

Defined results: vectors that are null, empty, or hold a null or non-finite entry have no rows;
entries beyond 64 bits stop at the bound, and so does a deviation; vectors of different length
are lists of their own, each with its components; repeated rows repeat; vectors shorter than the
asked components have as many as entries; a component without variance has whitened 0 and is left
out of the identity; equal eigenvalues may have any basis of their space; further columns play
no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle

SCALE, COMPONENTS = 256, 4
STREAMS, WIDTH = 16, 16
ROUNDS = 60
EPS = np.finfo(float).eps
LAST = (1 << 63) - 1

SPECTRUM = "dim int, part int, n long, sums array<string>, mean binary, values binary, vectors binary"
MOMENTS = "dim int, part int, square binary"
WHITE = T.StructType([
    T.StructField("deviation", T.LongType()),
    T.StructField("whitened", T.ArrayType(T.DoubleType())),
])


def merge_equal(values: np.ndarray, vectors: np.ndarray, push: np.ndarray, tol: np.ndarray) -> None:
    """Deflation of equal eigenvalues, in place: a rotation moves the whole push to the later one."""
    for g in np.flatnonzero((np.diff(values, axis=1) <= 2 * tol[:, None]).any(axis=1)):
        held = None
        for j in np.flatnonzero(push[g]):
            if held is not None and values[g, j] - values[g, held] <= 2 * tol[g]:
                length = np.hypot(push[g, held], push[g, j])
                c, s = push[g, j] / length, push[g, held] / length
                a, b = vectors[g, :, held].copy(), vectors[g, :, j].copy()
                vectors[g, :, held], vectors[g, :, j] = c * a - s * b, s * a + c * b
                push[g, held], push[g, j] = 0.0, length
            held = j


def roots(values: np.ndarray, square: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum of square_j / (values_j - x), one right of every active value.

    Returns the roots and ``apart[g, i, j]`` = value j less root i, both to full relative
    precision: a root is kept as its distance to the nearer of the two values it lies between.
    """
    streams, d = values.shape
    places = np.broadcast_to(np.arange(d), values.shape)
    later = np.where(active, places, d)
    nearest = np.minimum.accumulate(later[:, ::-1], axis=1)[:, ::-1]
    after = np.concatenate([nearest[:, 1:], np.full((streams, 1), d)], axis=1)
    final = after == d
    after = np.minimum(after, d - 1)
    row = np.arange(streams)[:, None]
    gap = np.where(final, square.sum(axis=1, keepdims=True), values[row, after] - values)
    gap = np.where(active, gap, 1.0)
    spread = values[:, None, :] - values[:, :, None]
    weight = square[:, None, :]

    def level(apart: np.ndarray) -> np.ndarray:
        return 1 + (weight / apart).sum(axis=2)

    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        high_half = (level(spread - gap[:, :, None] / 2) < 0) & ~final
        origin = np.where(high_half, after, places)
        spread = values[:, None, :] - values[row, origin][:, :, None]
        low = np.where(high_half, -gap / 2, 0.0)
        high = np.where(high_half, 0.0, np.where(final, gap, gap / 2))
        x = (low + high) / 2
        left = (places[:, None, :] <= places[:, :, None]).astype(float)
        todo = active.copy()
        for _ in range(ROUNDS):
            apart = spread - x[:, :, None]
            part = weight / apart
            slope = part / apart
            f = 1 + part.sum(axis=2)
            size = 1 + np.abs(part).sum(axis=2)
            todo &= np.abs(f) > EPS * size * 2
            if not todo.any():
                break
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            total = slope.sum(axis=2)
            own = (slope * left).sum(axis=2)
            to_own, to_next = apart[row, places, places], apart[row, places, after]
            a = (to_own + to_next) * f - to_own * to_next * total
            b = to_own * to_next * f
            c = f - to_own * own - to_next * (total - own)
            bent = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - bent) / (2 * c), 2 * b / (a + bent))
            step = np.where(final, to_own + to_own**2 * total / (f - to_own * total), step)
            moved = x + step
            inside = np.isfinite(moved) & (moved > low) & (moved < high)
            moved = np.where(inside, moved, (low + high) / 2)
            still = np.abs(moved - x) > EPS * np.abs(moved)
            x, todo = np.where(todo, moved, x), todo & still
    apart = spread - x[:, :, None]
    return np.where(active, values[row, origin] + x, values), apart


def rank_one(values: np.ndarray, vectors: np.ndarray, push: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of V diag(values) V' + (V push)(V push)', one per stream; values ascend.

    ``values`` is (streams, d), ``vectors`` (streams, d, d) by columns, ``push`` (streams, d).
    """
    streams, d = values.shape
    length = np.sqrt((push**2).sum(axis=1))
    tol = 8 * EPS * (np.abs(values).max(axis=1) + length**2)
    push = np.where(np.abs(push) * length[:, None] > tol[:, None], push, 0.0)
    if (np.diff(values, axis=1) <= 2 * tol[:, None]).any():
        vectors = vectors.copy()
        merge_equal(values, vectors, push, tol)
    active = push != 0
    if not active.any():
        return values, vectors
    moved, apart = roots(values, push**2, active)
    same = np.eye(d, dtype=bool)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        # The push for which these roots are exact: it keeps the vectors orthogonal.
        between = np.where(same, 1.0, values[:, :, None] - values[:, None, :])
        ratio = np.where(active[:, :, None], -apart / between, 1.0)
        exact = np.sqrt(np.abs(ratio.prod(axis=1)))
        turn = np.where(active, np.copysign(exact, push), 0.0)[:, None, :] / apart
        turn = np.where(active[:, :, None], turn, same)
        turn = np.where(active[:, :, None] & ~active[:, None, :], 0.0, turn)
    turn /= np.sqrt((turn**2).sum(axis=2, keepdims=True))
    vectors = vectors @ turn.transpose(0, 2, 1)
    order = np.argsort(moved, axis=1, kind="stable")
    return np.take_along_axis(moved, order, 1), np.take_along_axis(vectors, order[:, None, :], 2)


@dataclass
class Spectra:
    """Scatter matrices of several streams: rows seen, means, eigenvalues and eigenvectors."""

    n: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(streams: int, d: int) -> Spectra:
        eye = np.broadcast_to(np.eye(d), (streams, d, d)).copy()
        return Spectra(np.zeros(streams), np.zeros((streams, d)), np.zeros((streams, d)), eye)

    def push(self, rows: np.ndarray) -> None:
        """One new row for each of the first streams."""
        k = len(rows)
        away = np.zeros_like(self.mean)
        away[:k] = rows - self.mean[:k]
        told = np.zeros(len(self.n))
        told[:k] = 1
        weight = self.n / (self.n + 1)
        inner = np.sqrt(weight)[:, None] * (away[:, None, :] @ self.vectors)[:, 0, :]
        self.values, self.vectors = rank_one(self.values, self.vectors, inner)
        self.mean = self.mean + away / (self.n + 1)[:, None]
        self.n = self.n + told

    def halved(self) -> Spectra:
        """The second half of the streams combined into the first by rank-one updates."""
        half = len(self.n) // 2
        one, other = ([part[s] for part in (self.n, self.mean, self.values, self.vectors)] for s in (slice(0, half), slice(half, 2 * half)))
        n, mean, values, vectors = one
        away = other[1] - mean
        both = n + other[0]
        weight = n * other[0] / np.maximum(both, 1)
        pushes = [np.sqrt(weight)[:, None] * away]
        lengths = np.sqrt(np.maximum(other[2], 0))
        pushes += [lengths[:, k, None] * other[3][:, :, k] for k in range(values.shape[1])]
        for push in pushes:
            if push.any():
                values, vectors = rank_one(values, vectors, (push[:, None, :] @ vectors)[:, 0, :])
        mean = mean + away * (other[0] / np.maximum(both, 1))[:, None]
        joined = Spectra(both, mean, values, vectors)
        if len(self.n) % 2:
            rest = [part[-1:] for part in (self.n, self.mean, self.values, self.vectors)]
            joined = Spectra(*(np.concatenate(x) for x in zip((joined.n, joined.mean, joined.values, joined.vectors), rest)))
        return joined

    def one(self) -> Spectra:
        """All streams as one."""
        told = self
        while len(told.n) > 1:
            told = told.halved()
        return told


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of whole numbers, of any size."""
    if float(np.abs(x.astype(float)).max(initial=0)) * max(len(x), 1) < 2**62:
        return [int(v) for v in x.sum(axis=0)]
    return [sum(int(v) for v in column) for column in x.T]


def by_length(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, matrix of whole numbers) of rows sorted by length, a batch at a time."""
    for batch in batches:
        lengths = batch["dim"].to_numpy()
        for a, b in zip(*(lambda e: (e, np.append(e[1:], len(batch))))(np.flatnonzero(np.append(True, np.diff(lengths) != 0)) if len(batch) else np.zeros(0, int))):
            yield int(lengths[a]), np.stack(batch["x"].iloc[a:b].to_list()).astype(np.int64)


def spectrum_row(dim: int, part: int, sums: list[int], told: Spectra) -> pd.DataFrame:
    row = (dim, part, int(told.n[0]), [str(v) for v in sums], told.mean[0].tobytes(), told.values[0].tobytes(), np.ascontiguousarray(told.vectors[0]).tobytes())
    return pd.DataFrame([row], columns=["dim", "part", "n", "sums", "mean", "values", "vectors"])


def updater(streams: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The spectra of one partition, one row per length of vectors."""

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        dim, told, sums = None, None, []
        for length, x in by_length(batches):
            if length != dim:
                if dim is not None:
                    yield spectrum_row(dim, part, sums, told.one())
                dim, told, sums = length, Spectra.empty(streams, length), [0] * length
            sums = [a + b for a, b in zip(sums, column_sums(x))]
            rows = x.astype(float)
            for at in range(0, len(rows), streams):
                told.push(rows[at : at + streams])
        if dim is not None:
            yield spectrum_row(dim, part, sums, told.one())

    return update


def combine(rows: pd.DataFrame) -> pd.DataFrame:
    """Up to ``WIDTH`` spectra of one length as one."""
    rows = rows.sort_values("part")
    d = int(rows["dim"].iloc[0])
    arrays = [np.stack([np.frombuffer(b, float) for b in rows[c]]) for c in ("mean", "values", "vectors")]
    told = Spectra(rows["n"].to_numpy(float), arrays[0], arrays[1], arrays[2].reshape(-1, d, d)).one()
    sums = [sum(int(v) for v in column) for column in zip(*rows["sums"])]
    return spectrum_row(d, int(rows["slot"].iloc[0]), sums, told).assign(n=int(rows["n"].sum()))


def add_up(rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of up to ``WIDTH`` matrices of one length."""
    total = np.sum([np.frombuffer(b, float) for b in rows.sort_values("part")["square"]], axis=0)
    return pd.DataFrame([(rows["dim"].iloc[0], rows["slot"].iloc[0], total.tobytes())], columns=["dim", "part", "square"])


def fold_parts(parts: DataFrame, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One row per length from rows numbered by ``part``, ``WIDTH`` of them at a time."""
    parts = settle(parts)
    while parts.where("part > 0").limit(1).count():
        slots = parts.withColumn("slot", F.floor(F.col("part") / WIDTH).cast("int"))
        parts = settle(slots.groupBy("dim", "slot").applyInPandas(fold, schema))
    return parts


@dataclass(frozen=True)
class Whitener:
    """Exact sums, mean and components of the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def rates(self, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Projection of centred rows on the first k components, their shares, and the trace."""
        top = self.values[:k]
        flat = len(self.values) * EPS * max(float(self.values.max(initial=0)), 0.0)
        scale = np.where(top > flat, 1 / np.sqrt(np.where(top > flat, top, 1.0)), 0.0)
        trace = float(self.values.sum())
        return self.vectors[:, :k] * scale, np.maximum(top, 0) / trace if trace > 0 else np.zeros(k), trace

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - sum)^2, exact, at most the largest long."""
        reach = self.n * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, self.sums), default=0)
        if reach**2 * max(x.shape[1], 1) < 2**62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1)
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x]
        return np.array([min(v, LAST) for v in exact], np.int64)


def projector(bases: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per partition and length: the sum of products of the projected, centred rows."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        dim, total = None, None
        for length, x in by_length(batches):
            if length != dim:
                if dim is not None:
                    yield pd.DataFrame([(dim, part, total.tobytes())], columns=["dim", "part", "square"])
                dim, total = length, 0.0
            mean, basis = bases[length]
            seen = (x - mean) @ basis
            total = total + seen.T @ seen
        if dim is not None:
            yield pd.DataFrame([(dim, part, total.tobytes())], columns=["dim", "part", "square"])

    return project


def squares(fit: DataFrame, bases: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums of products of all centred rows in the given bases, by length."""
    parts = fit.sortWithinPartitions("dim").mapInPandas(projector(bases), MOMENTS)
    found = fold_parts(parts, add_up, MOMENTS).collect()  # one small matrix per length
    shapes = {d: basis.shape[1] for d, (_, basis) in bases.items()}
    return {r["dim"]: np.frombuffer(r["square"], float).reshape(shapes[r["dim"]], -1) for r in found}


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x, dim) with whole-number entries, without vectors that take no part."""
    wide = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("_v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.select("vec_id", wide.alias("_v")).where(F.col("_v").isNotNull() & (F.size("_v") > 0) & ~bad)
    return kept.select("vec_id", F.transform("_v", lambda v: F.floor(v * scale)).alias("x"), F.size("_v").alias("dim"))


def fit_whitener(fit: DataFrame, streams: int = STREAMS) -> dict[int, Whitener]:
    """Whiteners by length from settled distinct rows (x, dim)."""
    parts = fit.sortWithinPartitions("dim").mapInPandas(updater(streams), SPECTRUM)
    rough = fold_parts(parts, combine, SPECTRUM).collect()  # one basis per length
    bases, told = {}, {}
    for r in rough:
        d, n, sums = r["dim"], r["n"], [int(v) for v in r["sums"]]
        basis, _ = np.linalg.qr(np.frombuffer(r["vectors"], float).reshape(d, d))
        bases[d], told[d] = (np.array([s / n for s in sums]), basis), (n, sums)
    whiteners = {}
    for d, square in squares(fit, bases).items():
        values, turn = np.linalg.eigh((square + square.T) / (2 * told[d][0]))
        whiteners[d] = Whitener(*told[d], np.maximum(values[::-1], 0), bases[d][1] @ turn[:, ::-1])
    return whiteners


def identity_errors(fit: DataFrame, whiteners: dict[int, Whitener], k: int) -> dict[int, float]:
    """Per length, the largest distance of an entry of the whitened rows' covariance from the identity's."""
    bases = {d: (w.mean, w.rates(k)[0]) for d, w in whiteners.items()}
    # A further column of ones in the basis would only repeat the mean, which is exact already.
    errors = {}
    for d, square in squares(fit, bases).items():
        live = np.flatnonzero(bases[d][1].any(axis=0))
        distance = np.abs(square / whiteners[d].n - np.eye(len(square)))[np.ix_(live, live)]
        errors[d] = float(distance.max(initial=0.0))
    return errors


def white(whiteners: dict[int, Whitener], k: int) -> Callable[[Column], Column]:
    """A Column function from whole-number vectors to their deviation and whitened entries."""
    bases = {d: (w.mean, w.rates(k)[0]) for d, w in whiteners.items()}

    @F.pandas_udf(WHITE)
    def told(vectors: pd.Series) -> pd.DataFrame:
        deviation, entries = np.zeros(len(vectors), np.int64), [None] * len(vectors)
        lengths = vectors.map(len).to_numpy(np.int64)
        for d in np.unique(lengths):
            places = np.flatnonzero(lengths == d)
            x = np.stack(vectors.iloc[places].to_list()).astype(np.int64)
            deviation[places] = whiteners[d].deviations(x)
            mean, basis = bases[d]
            for place, row in zip(places, (x - mean) @ basis):
                entries[place] = row
        return pd.DataFrame({"deviation": deviation, "whitened": entries})

    return told


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: its whitened entry, and what the component explains."""
    kept = settle(whole_vectors(vectors))
    fit = settle(kept.select("x", "dim").distinct())
    whiteners = fit_whitener(fit)
    errors = identity_errors(fit, whiteners, components)
    facts = [
        (d, j + 1, w.n, float(share), errors[d])
        for d, w in whiteners.items() for j, share in enumerate(w.rates(components)[1])
    ]
    named = vectors.sparkSession.createDataFrame(facts, "dim int, component int, n long, explained double, identity_error double")
    entries = kept.select("vec_id", "dim", white(whiteners, components)("x").alias("_w")).select(
        "vec_id", "dim", F.col("_w.deviation").alias("deviation"), F.posexplode("_w.whitened").alias("_at", "whitened")
    )
    return entries.withColumn("component", F.col("_at") + 1).join(named, ["dim", "component"]).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    )
