"""Boosting that stops by a held-out fold, and the options of the tree learners."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import evaluate, learn


@pytest.fixture(scope="module")
def folded(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(240, 3))
    label = (x[:, 0] + r.normal(0, 1.0, 240) > 0.3).astype(int)
    rows = [(f"j{i}", *map(float, v), int(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))]
    return evaluate.stratified_folds(spark.createDataFrame(rows, "id string, a double, b double, c double, label int"), 2)


def test_rounds_stop_where_the_fold_gains_no_more(folded):
    taken = {r.fold: r for r in learn.rounds_by_fold(folded, ["a", "b", "c"], folds=2, most=30, depth=3, rate=0.3).collect()}
    assert sorted(taken) == [0, 1] and all(1 <= r.rounds < 30 for r in taken.values())
    # On noisy labels the full number of rounds does worse on the fold that was held out.
    here = F.col("fold") == 0
    full = learn.boosting(["a", "b", "c"], rounds=30, depth=3, rate=0.3).fit(learn.with_weights(folded.where(~here)))
    loss = evaluate.point_metrics(learn.probability(full, folded.where(here)), "fold").first().log_loss
    assert taken[0].log_loss < loss


def test_leaf_size_and_final_fit(folded):
    weighted = learn.with_weights(folded)
    # A leaf of more than half of the rows allows no split.
    for maker in (learn.random_forest(["a", "b"], trees=2, leaf=200), learn.boosting(["a", "b"], rounds=2, leaf=200)):
        p = learn.probability(maker.fit(weighted), folded).select("p").distinct()
        assert p.count() == 1
    model, taken = learn.stopped_boosting(folded, ["a", "b"], folds=2, most=10, depth=2, rate=0.5, rows=0.9)
    rounds = sorted(r.rounds for r in taken.collect())
    assert rounds[0] <= model.stages[-1].getNumTrees <= rounds[1]
