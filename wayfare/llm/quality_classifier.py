"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams are scaled by class log-count ratios; a linear hinge-loss model over them is fitted by dual
coordinate descent.  The n-grams are words, word pairs, and runs of one to three word shapes (which characters a word has, how long
it is, how far back the same word stands).

The fit uses a bounded sample of labelled rows (``rows`` of them in expectation, by a hash of the id) in one task and returns one row
of weights; scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wayfare.session import settle

# A power of two.
SLOTS = 1 << 19
TRAIN_ROWS = 10_000
ROUNDS = 24
COST = 1.0
SMOOTH = 1.0
# One in so many sampled rows calibrates the margin instead of fitting it.
CALIBRATE = 4
WORDS_AT_ONCE = 1 << 18
# Words back in which a word is looked for again.
LOOK_BACK = 4

_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, _BANG, _BAR = (1 << i for i in range(7))


def _classes() -> np.ndarray:
    table = np.full(256, _LOWER, np.uint8)
    for b in range(128):
        c = chr(b)
        kind = _UPPER if c.isupper() else _LOWER if c.islower() else _DIGIT if c.isdigit() else _STOP if c in ".,;:'\"-()" else _BANG if c in "!?" else _BAR if c == "|" else _SYMBOL
        table[b] = kind
    return table


CLASS = _classes()


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) & np.uint64(SLOTS - 1)).astype(np.int32)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def features(text: str | None) -> np.ndarray:
    """Distinct slots of a text's n-grams; none for a null or blank text."""
    found = (text or "").encode("utf-8", "surrogatepass").split()
    # Every run after the first starts early enough to know what its first words follow.
    early = lambda i: min(i, 2 * LOOK_BACK)
    slots = [_features(found[i - early(i) : i + WORDS_AT_ONCE], early(i) // 2) for i in range(0, len(found), WORDS_AT_ONCE)]
    return slots[0] if len(slots) == 1 else _distinct(np.concatenate(slots)) if slots else np.zeros(0, np.int32)


def _features(found: list[bytes], known: int = 0) -> np.ndarray:
    """Distinct slots of the n-grams of a run of words; the first ``known`` words are only looked back at."""
    data = np.frombuffer(b"".join(found), np.uint8)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(sizes) - sizes
    kinds = CLASS[data]
    shape = np.bitwise_or.reduceat(kinds, starts).astype(np.uint64)
    # A word's hash: the sum of its bytes' mixed values by place in the word.
    place = (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.uint64)
    mixed = (data.astype(np.uint64) + np.uint64(257) * (place + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93)
    word = np.add.reduceat((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD), starts)
    n = len(word)
    back = np.zeros(n, np.uint64)
    for d in range(LOOK_BACK, 0, -1):
        back[d:][word[d:] == word[:-d]] = d
    code = shape | (np.minimum(sizes, 24) // 6).astype(np.uint64) << np.uint64(8) | back << np.uint64(12)
    word, code, n = word[known:], code[known:], n - known
    one, two, three = np.uint64(1), np.uint64(2), np.uint64(3)
    grams = [word * two + one, code * np.uint64(0x1000193) + three]
    if n > 1:
        grams += [word[:-1] * np.uint64(31) + word[1:] * np.uint64(17) + two, code[:-1] * np.uint64(0x10001) + code[1:] * np.uint64(0x3000005) + one]
    if n > 2:
        grams.append(code[:-2] * np.uint64(0x50000B) + code[1:-1] * np.uint64(0x700001) + code[2:] * np.uint64(0x90001) + two)
    return _distinct(_spread(np.concatenate(grams)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        if not len(slots):
            return self.bias
        return float(self.weights[slots].sum() / np.sqrt(len(slots)) + self.bias)

    def score(self, slots: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(slots) + self.shift, -30, 30))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = [np.full(SLOTS, SMOOTH) for _ in range(2)]
    for slots, y in zip(rows, labels.tolist(), strict=True):
        counts[y][slots] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, rounds: int = ROUNDS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights of a linear hinge-loss model: one dual variable per row, between 0 and the row's cost, each set to its optimum in turn.

    A row's vector is its slots' scales over the root of their number, and a constant 1 for the bias; the
    rarer class costs more, in proportion.  The weights come back with the scale in them.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    weigh = np.where(labels == 1, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9)) * cost
    values = [scale[s] / np.sqrt(max(1, len(s))) for s in rows]
    square = np.array([v @ v + 1.0 for v in values])
    dual, w, bias = np.zeros(len(rows)), np.zeros(SLOTS), 0.0
    shuffled = np.random.default_rng(42)
    for _ in range(rounds):
        for i in shuffled.permutation(len(rows)).tolist():
            s, v, y = rows[i], values[i], sign[i]
            slope = y * (w[s] @ v + bias) - 1.0
            new = min(max(0.0, dual[i] - slope / square[i]), weigh[i])
            step = (new - dual[i]) * y
            if step:
                w[s] += step * v
                bias += step
                dual[i] = new
    return w * scale, bias


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from margin to probability, by Newton steps."""
    target = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * (at - [1.0, 0.0]))
        at = at - np.clip(step, -5, 5)
    return float(max(at[0], 1e-3)), float(at[1])


def fitted(rows: list[np.ndarray], labels: np.ndarray, calibrate: np.ndarray) -> Model:
    """Model from rows' slots; rows marked in ``calibrate`` only place the curve.  Without rows every score is a half."""
    fit = ~calibrate if (~calibrate).any() else calibrate
    chosen = [r for r, f in zip(rows, fit, strict=True) if f]
    if not chosen:
        return Model(np.zeros(SLOTS, np.float32), 0.0, 1.0, 0.0)
    ratio = log_count_ratio(chosen, labels[fit])
    w, bias = dual_descent(chosen, labels[fit], ratio)
    model = Model(w.astype(np.float32), bias, 1.0, 0.0)
    held = calibrate if len(set(labels[calibrate].tolist())) == 2 else np.ones(len(rows), bool)
    margins = np.array([model.margin(r) for r, c in zip(rows, held, strict=True) if c])
    return Model(model.weights, bias, *calibrated(margins, labels[held]))


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` labelled rows that are not held out.

    Repeated labels of one id count once, the lower one if they differ; null ids and labels are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"))
    n = known.count()
    chance = min(1.0, rows / n) if n else 1.0
    mark = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1_000_000
    # A bounded number of small rows: their files are small, so the texts need no shuffle.
    sample = settle(known.where(mark < chance)).select(F.col("doc_id").alias("l_id"), "y")
    texts = docs.join(sample, F.col("doc_id") == F.col("l_id")).select("doc_id", "y", F.col("text").cast("string").alias("text"))

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "slots": [features(t).tobytes() for t in frame["text"]]})

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "slots"])
        slots = [np.frombuffer(s, np.int32) for s in frame["slots"]]
        model = fitted(slots, frame["y"].to_numpy(np.int64), np.arange(len(frame)) % CALIBRATE == 0)
        return pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias], "slope": [model.slope], "shift": [model.shift]})

    kind = dict(docs.dtypes)["doc_id"]
    got = texts.mapInPandas(coded, f"doc_id {kind}, y int, slots binary").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "weights binary, bias double, slope double, shift double").collect()
    if not got:
        return fitted([], np.zeros(0, np.int64), np.zeros(0, bool))
    r = got[0]
    return Model(np.frombuffer(r["weights"], np.float32), r["bias"], r["slope"], r["shift"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``score``, the probability of label 1; a null text scores like an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(features(t)) for t in texts], dtype="float64")

    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), score(docs["text"].cast("string")).alias("score"))
