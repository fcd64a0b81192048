"""Forward-backward arithmetic of a hidden Markov model over symbol sequences, many sequences at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    """``start`` [K], ``move`` [K, K] and ``emit`` [K, B] hold probabilities; each row sums to one."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def initial(cls, states: int, symbols: int, seed: int = 1) -> Model:
        """Sticky moves and emissions near the uniform ones; the noise makes the states differ."""
        rng = np.random.default_rng(seed)
        emit = rng.uniform(0.5, 1.5, (states, symbols))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, counts: np.ndarray, symbols: int, prior: float = 0.1) -> Model:
        """Maximisation step from expected counts laid out as in ``expected_counts``, each with ``prior`` added."""
        states = len(counts)
        smooth = counts + prior
        part = lambda a, b: smooth[:, a:b] / smooth[:, a:b].sum(1, keepdims=True)
        return cls(smooth[:, 0] / smooth[:, 0].sum(), part(1, 1 + states), part(1 + states, 1 + states + symbols))


def _steps(sequences: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """All symbols by time over sequences sorted from long to short; where each time step lies; the order used."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    flat = np.concatenate([sequences[i] for i in order]) if len(order) else np.empty(0, np.int64)
    time = np.concatenate([np.arange(n) for n in lengths]) if len(order) else np.empty(0, np.int64)
    symbols = flat[np.argsort(time, kind="stable")]
    alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    ends = np.cumsum(alive)
    return symbols, list(zip((ends - alive).tolist(), ends.tolist())), order


def _forward(model: Model, symbols: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward variables, their scales, and the emissions, all by time."""
    seen = np.ascontiguousarray(model.emit.T)[symbols]
    alpha, scale = np.empty_like(seen), np.empty(len(symbols))
    for t, (lo, hi) in enumerate(steps):
        now = seen[lo:hi] * model.start if t == 0 else (alpha[before : before + hi - lo] @ model.move) * seen[lo:hi]
        c = now.sum(1)
        np.divide(now, c[:, None], out=alpha[lo:hi])
        scale[lo:hi] = c
        before = lo
    return alpha, scale, seen


def log10_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Exact log10 probability of each sequence of symbols, by the scaled forward recursion; 0 for an empty one.

    Only one time step is held, so the memory does not grow with the length of a sequence.
    """
    sums = np.zeros(len(sequences))
    symbols, steps, order = _steps(sequences)
    emit = np.ascontiguousarray(model.emit.T)
    for t, (lo, hi) in enumerate(steps):
        seen = emit[symbols[lo:hi]]
        alpha = seen * model.start if t == 0 else (alpha[: hi - lo] @ model.move) * seen
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        sums[: hi - lo] += np.log10(scale)
    out = np.zeros(len(sequences))
    out[order] = sums
    return out


def batches_by_length(sequences: list[np.ndarray], most: int = 300_000, cut: int = 100_000):
    """The sequences from long to short in batches of about ``most`` symbols; longer ones than ``cut`` come in parts."""
    parts = [s[i : i + cut] for s in sequences for i in range(0, len(s), cut)]
    batch, size = [], 0
    for part in sorted(parts, key=len, reverse=True):
        if batch and size + len(part) > most:
            yield batch
            batch, size = [], 0
        batch.append(part)
        size += len(part)
    if batch:
        yield batch


def expected_counts(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Baum-Welch counts [K, 1 + K + B]: of starts in a state, of moves out of it, and of the symbols it emits."""
    states, size = model.emit.shape
    counts = np.zeros((states, 1 + states + size))
    symbols, steps, _ = _steps(sequences)
    if not len(symbols):
        return counts
    alpha, scale, seen = _forward(model, symbols, steps)
    seen /= scale[:, None]
    beta = np.ones_like(alpha)
    moves, back = np.zeros((states, states)), model.move.T.copy()
    for t in range(len(steps) - 1, 0, -1):
        (lo, hi), (was, _) = steps[t], steps[t - 1]
        ahead = seen[lo:hi] * beta[lo:hi]
        moves += alpha[was : was + hi - lo].T @ ahead
        beta[was : was + hi - lo] = ahead @ back
    counts[:, 1 : 1 + states] = moves * model.move
    gamma = alpha
    gamma *= beta
    counts[:, 0] = gamma[slice(*steps[0])].sum(0)
    for k in range(states):
        counts[k, 1 + states :] = np.bincount(symbols, gamma[:, k], size)
    return counts
