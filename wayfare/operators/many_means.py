"""k-means for many numbers of clusters and training folds in shared passes.

A model is a pair (k, fold): ``k`` centres fitted on the rows outside of the fold.  Every pass reads the written matrix once and
moves the centres of all models; only centres and per-centre sums (models x k x features) leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators.encode import Scaling, fit_scalings
from wayfare.session import settle

# Rows from which first centres are drawn, about, per fold; all other work reads every row.
SEED_ROWS = 2_000
ROUNDS = 20
# A model has settled when no centre moves further (in standard deviations, squared).
SETTLED = 1e-8


@dataclass(frozen=True)
class ManyMeans:
    """Centres of all models, with each fold's scaling (rows: median, mean, spread)."""

    columns: tuple[str, ...]
    scalings: dict[int, np.ndarray]
    centres: dict[tuple[int, int], np.ndarray]
    cost: dict[tuple[int, int], float]

    @property
    def models(self) -> list[tuple[int, int]]:
        return sorted(self.centres)

    def assign(self, matrix: DataFrame) -> DataFrame:
        """``matrix`` without x, with ``segments``: of every model (in order of k, then fold) the row's nearest centre, ties to the first."""
        names = [c for c in matrix.columns if c != "x"]
        shared = matrix.sparkSession.sparkContext.broadcast((self.scalings, [(f, self.centres[k, f]) for k, f in self.models]))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scalings, centres = shared.value
            for frame in frames:
                raw = _rows(frame)
                scaled = {f: _scaled(raw, s) for f, s in scalings.items()}
                found = [_nearest(scaled[f], c)[0] for f, c in centres]
                out = frame[names].copy()
                out["segments"] = list(np.stack(found, axis=1).astype(np.int32)) if len(frame) else []
                yield out

        schema = ", ".join(f"`{c}` {t}" for c, t in matrix.dtypes if c != "x")
        return matrix.mapInPandas(run, f"{schema}, segments array<int>")


def _rows(frame: pd.DataFrame) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in x] for x in frame["x"]], np.float64)


def _scaled(raw: np.ndarray, scaling: np.ndarray) -> np.ndarray:
    median, mean, spread = scaling
    return (np.where(np.isfinite(raw), raw, median) - mean) / np.where(spread > 0, spread, 1.0)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre and the squared distance to it."""
    apart = (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1)
    # Rounding must not part equal distances.
    at = np.round(np.maximum(apart, 0.0), 9).argmin(axis=1)
    return at, np.maximum(apart[np.arange(len(rows)), at], 0.0)


def _first_centres(rows: np.ndarray, k: int, draw: np.random.RandomState) -> np.ndarray:
    """Rows drawn with the square of their distance to the ones before as weight."""
    picked = [rows[draw.randint(len(rows))]]
    for _ in range(k - 1):
        apart = _nearest(rows, np.array(picked))[1]
        total = apart.sum()
        picked.append(rows[draw.choice(len(rows), p=apart / total)] if total > 0 else rows[draw.randint(len(rows))])
    return np.array(picked)


def feature_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All columns but the features, and the features as one array ``x`` (missing values stay null)."""
    taken = set(columns) - {"current_state"}
    return df.select(*[c for c in df.columns if c not in taken], F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))


def _moved(matrix: DataFrame, fit: ManyMeans, open_models: list[tuple[int, int]]) -> tuple[dict, dict]:
    """One pass: new centres of the open models, and their cost."""
    shared = matrix.sparkSession.sparkContext.broadcast((fit.scalings, {m: fit.centres[m] for m in open_models}))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scalings, centres = shared.value
        # Per centre: the sum of its rows, their number, their cost.
        sums = {m: np.zeros((len(c), c.shape[1] + 2)) for m, c in centres.items()}
        for frame in frames:
            raw, folds = _rows(frame), frame["fold"].to_numpy()
            for fold, scaling in scalings.items():
                rows = _scaled(raw[folds != fold], scaling)
                for model, own in centres.items():
                    if model[1] != fold or not len(rows):
                        continue
                    at, apart = _nearest(rows, own)
                    member = at[:, None] == np.arange(len(own))
                    sums[model] += np.column_stack([member.T.astype(float) @ rows, member.sum(axis=0), member.T.astype(float) @ apart])
        out = [(k, f, c, p, v) for (k, f), s in sums.items() for c, row in enumerate(s.tolist()) if row[-2] for p, v in enumerate(row)]
        yield pd.DataFrame(out, columns=["k", "fold", "centre", "part", "value"])

    parts = matrix.select("fold", "x").mapInPandas(run, "k int, fold int, centre int, part int, value double")
    total = parts.groupBy("k", "fold", "centre", "part").agg(F.sum("value").alias("value"))
    width = len(fit.columns)
    found = {m: np.zeros((len(fit.centres[m]), width + 2)) for m in open_models}
    for r in total.collect():
        found[r.k, r.fold][r.centre, r.part] = r.value
    # A centre that lost all its rows stays where it was.
    moved = {m: np.where(s[:, [width]] > 0, s[:, :width] / np.maximum(s[:, [width]], 1), fit.centres[m]) for m, s in found.items()}
    return moved, {m: float(s[:, width + 1].sum()) for m, s in found.items()}


def fit_many(matrix: DataFrame, columns: Sequence[str], ks: Sequence[int], folds: int, *, seed: int = 42, rounds: int = ROUNDS) -> ManyMeans:
    """Centres of every (k, fold) on ``matrix`` (id, fold, x), scaled and imputed by the rows outside of the fold."""
    held = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))).alias("_held")
    values = matrix.select(held, *[F.get("x", i).alias(f"x{i}") for i in range(len(columns))])
    by_fold: dict[int, Scaling] = fit_scalings(values, [f"x{i}" for i in range(len(columns))], "_held")
    scalings = {int(f): np.array([s.stats[f"x{i}"] for i in range(len(columns))]).T for f, s in by_fold.items()}
    share = min(1.0, SEED_ROWS * folds / max(1, folds - 1) / max(1, matrix.count()))
    mark = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1_000_000
    sample = matrix.where(mark < share).select("id", "fold", "x").orderBy("id").toPandas()
    raw, own = _rows(sample), sample["fold"].to_numpy()
    centres = {}
    for f, scaling in scalings.items():
        rows = _scaled(raw[own != f], scaling) if (own != f).any() else np.zeros((1, len(columns)))
        for k in ks:
            centres[k, f] = _first_centres(rows, k, np.random.RandomState(seed + 1000 * k + f))
    fit, open_models = ManyMeans(tuple(columns), scalings, centres, dict.fromkeys(centres, float("inf"))), sorted(centres)
    for _ in range(rounds):
        moved, cost = _moved(matrix, fit, open_models)
        shift = {m: float(((c - fit.centres[m]) ** 2).sum(axis=1).max()) for m, c in moved.items()}
        fit = ManyMeans(fit.columns, scalings, fit.centres | moved, fit.cost | cost)
        open_models = [m for m in open_models if shift[m] > SETTLED]
        if not open_models:
            break
    return fit


def many_segments(features: DataFrame, columns: Sequence[str], ks: Sequence[int], folds: int, **fit) -> DataFrame:
    """``features`` without its feature columns, with the segments of every model (see ``ManyMeans.assign``); written once."""
    matrix = settle(feature_matrix(features, columns))
    return settle(fit_many(matrix, columns, ks, folds, **fit).assign(matrix))
