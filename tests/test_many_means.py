"""Many k-means models in shared passes against plain ones."""

from __future__ import annotations

import numpy as np

from wayfare.operators import many_means


def plain(rows, centres, rounds):
    for _ in range(rounds):
        at = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2).round(9).argmin(axis=1)
        centres = np.array([rows[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(len(centres))])
    return centres


def test_models_move_as_plain_ones_do(spark):
    draw = np.random.RandomState(4)
    values = np.concatenate([draw.normal(m, 0.4, (40, 3)) for m in (0, 3, 7)])
    data = [(f"j{i}", i % 3, float(a), None if i % 17 == 0 else float(b), float(c)) for i, (a, b, c) in enumerate(values)]
    frame = spark.createDataFrame(data, "id string, fold int, a double, b double, c double").repartition(3)
    matrix = many_means.feature_matrix(frame, ["a", "b", "c"])
    first = many_means.fit_many(matrix, ["a", "b", "c"], [2, 3], 3, rounds=0)
    fit = many_means.fit_many(matrix, ["a", "b", "c"], [2, 3], 3, rounds=4)
    assert fit.models == [(k, f) for k in (2, 3) for f in range(3)]
    raw = np.array([[np.nan if x is None else x for x in r[2:]] for r in data])
    folds = np.array([r[1] for r in data])
    for (k, f), centres in fit.centres.items():
        train = raw[folds != f]
        median = np.nanmedian(train, axis=0)
        filled = np.where(np.isfinite(raw), raw, median)
        mean, spread = filled[folds != f].mean(axis=0), filled[folds != f].std(axis=0)
        assert np.allclose(fit.scalings[f], [median, mean, spread])
        scaled = (filled - mean) / spread
        assert np.allclose(centres, plain(scaled[folds != f], first.centres[k, f], 4))
    got = {r["id"]: r["segments"] for r in fit.assign(matrix).collect()}
    for place, (k, f) in enumerate(fit.models):
        filled = np.where(np.isfinite(raw), raw, fit.scalings[f][0])
        scaled = (filled - fit.scalings[f][1]) / fit.scalings[f][2]
        at = ((scaled[:, None, :] - fit.centres[k, f][None]) ** 2).sum(axis=2).round(9).argmin(axis=1)
        assert [got[r[0]][place] for r in data] == at.tolist()
