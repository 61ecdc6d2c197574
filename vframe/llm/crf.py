"""A linear-chain conditional random field over the tags outside, begin, inside.

Emissions are sums of one weight for each feature group of a token. Training
maximises the penalised likelihood of padded windows; decoding is Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OUT, BEGIN, INSIDE = 0, 1, 2
_FORBIDDEN = -1e4


@dataclass
class Crf:
    weights: np.ndarray  #: features x 3
    moves: np.ndarray  #: from x to

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Of tokens x groups feature numbers."""
        total = np.zeros((len(features), 3), dtype=np.float32)
        for g in range(features.shape[1]):
            total += self.weights[features[:, g]]
        return total


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(features: np.ndarray, tags: np.ndarray, lengths: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log-likelihood of windows (n x t x groups, n x t, n) and its gradients by ``weights`` and ``moves``.

    Before and after a window stands ``outside``; what is beyond a window's length is padding.
    """
    n, t, groups = features.shape
    inside = np.arange(t)[None, :] < lengths[:, None]
    before = np.concatenate((np.zeros((n, 1), int), tags[:, :-1]), axis=1)
    last = tags[np.arange(n), lengths - 1]
    em = weights[features[:, :, 0]]
    for g in range(1, groups):
        em += weights[features[:, :, g]]
    alpha, beta = np.empty((t, n, 3), em.dtype), np.empty((t, n, 3), em.dtype)
    alpha[0] = moves[OUT][None] + em[:, 0]
    for i in range(1, t):
        new = _logsum(alpha[i - 1][:, :, None] + moves[None], 1) + em[:, i]
        alpha[i] = np.where(inside[:, i, None], new, alpha[i - 1])
    whole = _logsum(alpha[t - 1] + moves[:, OUT][None], 1)
    beta[t - 1] = moves[:, OUT][None]
    for i in range(t - 2, -1, -1):
        new = _logsum(moves[None] + (em[:, i + 1] + beta[i + 1])[:, None, :], 2)
        beta[i] = np.where(inside[:, i + 1, None], new, moves[:, OUT][None])
    share = np.exp(alpha + beta - whole[None, :, None]).transpose(1, 0, 2)
    off = (np.eye(3, dtype=em.dtype)[tags] - share)[inside]
    flat = features[inside].ravel()
    by_weight = np.stack([np.bincount(flat, weights=np.repeat(off[:, k], groups), minlength=len(weights)) for k in range(3)], axis=1)
    counts = np.zeros((3, 3))
    np.add.at(counts, (before[inside], tags[inside]), 1)
    np.add.at(counts, (last, OUT), 1)
    found = float(np.take_along_axis(em, tags[:, :, None], axis=2)[..., 0][inside].sum(dtype=np.float64) + (counts * moves).sum() - whole.sum(dtype=np.float64))
    expected = np.zeros((3, 3))
    expected[OUT] += np.exp(moves[OUT][None] + em[:, 0] + beta[0] - whole[:, None]).sum(axis=0)
    for i in range(1, t):
        pair = np.exp(alpha[i - 1][:, :, None] + moves[None] + (em[:, i] + beta[i])[:, None, :] - whole[:, None, None])
        expected += pair[inside[:, i]].sum(axis=0)
    expected[:, OUT] += np.exp(alpha[t - 1] + moves[:, OUT][None] - whole[:, None]).sum(axis=0)
    return found, by_weight, counts - expected


def fit(features: np.ndarray, tags: np.ndarray, lengths: np.ndarray, size: int, steps: int = 60, rate: float = 0.1, penalty: float = 1e-4) -> Crf:
    """Fits windows by Adam; deterministic. Without windows there is nothing to fit, which is an error."""
    n = len(features)
    values = [np.zeros((size, 3), np.float32), np.zeros((3, 3), np.float32)]
    barred = np.zeros((3, 3), np.float32)
    barred[OUT, INSIDE] = _FORBIDDEN
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for step in range(1, steps + 1):
        grads = likelihood(features, tags, lengths, values[0], values[1] + barred)[1:]
        for value, grad, (first, second) in zip(values, grads, state, strict=True):
            g = (grad / n - penalty * value).astype(np.float32)
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            value += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Crf(values[0], values[1] + barred)


def viterbi(emissions: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of a sequence between two outside tokens."""
    n = len(emissions)
    score, back = moves[OUT] + emissions[0], np.zeros((n, 3), dtype=np.int8)
    for i in range(1, n):
        both = score[:, None] + moves
        back[i] = both.argmax(axis=0)
        score = both.max(axis=0) + emissions[i]
    tags = np.empty(n, dtype=np.int8)
    tags[-1] = (score + moves[:, OUT]).argmax()
    for i in range(n - 1, 0, -1):
        tags[i - 1] = back[i, tags[i]]
    return tags


def windows(emissions: np.ndarray, moves: np.ndarray) -> list[tuple[int, int]]:
    """Ranges outside which Viterbi's path is outside throughout.

    A stretch of tags that beats staying outside gains ``gain`` at a token at
    most. It must hold a token whose gain is positive, and it cannot go on
    beyond a token when it has lost more since than there is to gain in all.
    """
    stay = moves[OUT, OUT]
    inner = max(0.0, float((moves[1:, 1:] - stay).max()))
    edge = max(0.0, float(moves[OUT, BEGIN] + moves[1:, OUT].max() - 2 * stay))
    gain = emissions[:, 1:].max(axis=1) - emissions[:, 0] + inner + edge
    hot = np.flatnonzero(gain > 0)
    if not len(hot):
        return []
    most, out = float(gain[hot].sum()), []
    for h in hot.tolist():
        if out and h < out[-1][1]:
            continue
        low, left = h, most
        while low > 0 and left > 0:
            low -= 1
            left += min(0.0, float(gain[low]))
        high, left = h + 1, most
        while high < len(gain) and left > 0:
            left = most if gain[high] > 0 else left + float(gain[high])
            high += 1
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out
