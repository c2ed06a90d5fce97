"""State-by-state algebra on one segment's rate table (NumPy inside Spark tasks).

Inputs are vocabulary-sized: tens to a few thousand states, never journeys or events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

# Largest rate x time handled by one uniformization series; above it the step is halved and squared.
SERIES_LIMIT = 24.0
SERIES_TOL = 1e-16
# The same bound where only vectors are multiplied.
SPARSE_LOAD = 400.0


def dense(pdf: pd.DataFrame, extra=()) -> tuple[np.ndarray, np.ndarray]:
    """Sorted states and the generator matrix of one rate table."""
    seen = set(pdf["from_state"]) | set(pdf["to_state"]) | set(extra)
    states = np.array(sorted(s for s in seen if s is not None))
    q = np.zeros((len(states), len(states)))
    rows = np.searchsorted(states, pdf["from_state"].to_numpy())
    cols = np.searchsorted(states, pdf["to_state"].to_numpy())
    np.add.at(q, (rows, cols), pdf["rate"].to_numpy(dtype=float))
    np.fill_diagonal(q, 0.0)
    np.fill_diagonal(q, -q.sum(axis=1))
    return states, q


def transition_matrix(q: np.ndarray, t: float) -> np.ndarray:
    """exp(Q t) as a Poisson mixture of powers of I + Q/L: every term is non-negative."""
    n = len(q)
    top = float(-q.diagonal().min()) if n else 0.0
    if n == 0 or top <= 0 or t <= 0:
        return np.eye(n)
    halvings = max(0, int(np.ceil(np.log2(top * t / SERIES_LIMIT))))
    load = top * t / 2**halvings
    step = np.eye(n) + q / top
    power, weight = np.eye(n), np.exp(-load)
    out, mass, k = weight * power, weight, 0
    while 1.0 - mass > SERIES_TOL and k < 400:
        k += 1
        power = power @ step
        weight *= load / k
        out += weight * power
        mass += weight
    out /= out.sum(axis=1, keepdims=True)
    for _ in range(halvings):
        out = out @ out
        out /= out.sum(axis=1, keepdims=True)
    return out


def goal_hits(pdf: pd.DataFrame, goal, horizon: float, dense_states: int = 512) -> pd.DataFrame:
    """P(goal within the horizon) per state, without a matrix of states when there are many of them.

    exp(Q t) applied to the goal alone: a Poisson mixture of what one uniformized step after the other makes of the goal's vector, so memory is that of
    the edges.  The number of steps grows with the largest rate times the horizon, and ends where a step changes nothing any more.
    Few states are cheaper by squaring (``horizon_hits``); both ways agree.
    """
    states, ends = np.unique(np.concatenate([pdf["from_state"].to_numpy(), pdf["to_state"].to_numpy()]), return_inverse=True)
    if len(states) <= dense_states:
        return horizon_hits(pdf, goal, horizon)
    start, stop = ends[: len(pdf)], ends[len(pdf) :]
    rate = pdf["rate"].to_numpy(dtype=float)
    at = int(np.searchsorted(states, goal))
    if at == len(states) or states[at] != goal:
        return pd.DataFrame({"state": states, "p": np.zeros(len(states))})
    moves = (start != at) & (start != stop)
    start, stop, rate = start[moves], stop[moves], rate[moves]
    out_of = np.bincount(start, rate, len(states))
    top = float(out_of.max(initial=0.0))
    value = np.zeros(len(states))
    value[at] = 1.0
    parts = max(1, int(np.ceil(top * horizon / SPARSE_LOAD)))
    load = top * horizon / parts
    for _ in range(parts if top > 0 else 0):
        term, weight, mass, k = value, np.exp(-load), np.exp(-load), 0
        out, settled = weight * term, False
        while 1.0 - mass > SERIES_TOL and k < 20 * SPARSE_LOAD:
            k += 1
            new = term + (np.bincount(start, rate * term[stop], len(states)) - out_of * term) / top
            settled = bool(np.abs(new - term).max() < 1e-16)
            term = new
            if settled:
                break
            weight *= load / k
            mass += weight
            out += weight * term
        out += max(0.0, 1.0 - mass) * term
        value = out
        if settled and k == 1:
            break
    return pd.DataFrame({"state": states, "p": np.clip(value, 0.0, 1.0)})


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def horizon_hits(pdf: pd.DataFrame, success, horizon: float) -> pd.DataFrame:
    """P(success within the horizon) per state; success is made absorbing."""
    states, q = dense(pdf)
    if success not in states:
        return pd.DataFrame({"state": states, "p": np.zeros(len(states))})
    at = int(np.searchsorted(states, success))
    q[at] = 0.0
    p = transition_matrix(q, horizon)[:, at]
    return pd.DataFrame({"state": states, "p": np.clip(p, 0.0, 1.0)})


def absorption(pdf: pd.DataFrame, success, failure) -> pd.DataFrame:
    """P(success before failure) per state from the embedded linear system."""
    states, q = dense(pdf)
    known = {success: 1.0, failure: 0.0}
    inner = np.array([s not in known for s in states], dtype=bool)
    out = dict(known)
    if inner.any() and success in states:
        at = int(np.searchsorted(states, success))
        u = solve(q[np.ix_(inner, inner)], -q[inner, at])
        out.update(zip(states[inner], np.clip(np.nan_to_num(u), 0.0, 1.0)))
    return pd.DataFrame({"state": list(out), "p": [float(v) for v in out.values()]})


def hitting_time(pdf: pd.DataFrame, success) -> pd.DataFrame:
    """Expected seconds to success per state (inf when there is no finite solution)."""
    states, q = dense(pdf)
    if success not in states:
        return pd.DataFrame({"state": states, "seconds": np.full(len(states), np.inf)})
    inner = states != success
    times = solve(q[np.ix_(inner, inner)], -np.ones(int(inner.sum())))
    out = np.zeros(len(states))
    out[inner] = np.where(np.isfinite(times), np.maximum(times, 0.0), np.inf)
    return pd.DataFrame({"state": states, "seconds": out})


def value_iteration(pdf: pd.DataFrame, success, failure, rounds: int = 500, tol: float = 1e-10) -> pd.DataFrame:
    """Empirical success value: the mean over outgoing samples, late ones count as failures."""
    states = np.array(sorted(set(pdf["from_state"]) | set(pdf["to_state"]) | {success, failure}))
    i = np.searchsorted(states, pdf["from_state"].to_numpy())
    j = np.searchsorted(states, pdf["to_state"].to_numpy())
    n = pdf["n"].to_numpy(dtype=float)
    in_time = n - pdf["late"].to_numpy(dtype=float)
    out_n = np.bincount(i, weights=n, minlength=len(states))
    fixed = (states == success) | (states == failure)
    moving = (out_n > 0) & ~fixed
    weight = np.zeros((len(states), len(states)))
    np.add.at(weight, (i, j), in_time)
    weight[moving] /= out_n[moving, None]
    v = np.where(states == success, 1.0, np.where(states == failure, 0.0, 0.5))
    for _ in range(rounds):
        new = v.copy()
        new[moving] = weight[moving] @ v
        delta = np.abs(new - v).max()
        v = new
        if delta < tol:
            break
    return pd.DataFrame({"state": states, "p": np.clip(v, 0.0, 1.0)})
