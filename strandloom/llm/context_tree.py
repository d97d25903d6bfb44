"""Context-tree weighting over bytes: binary decomposition, Krichevsky-Trofimov estimates, all depths mixed.

The model of a text is that of its bytes, each cut into eight binary choices; every choice, given the bits before it in its byte,
has a context tree of its own over the D bytes before. A node's estimate of its counts (a, b) is that of Krichevsky and
Trofimov, and its weighted probability is half its own estimate plus half the product of its children's, the deepest nodes
apart. Given the counts, the probability of a choice is w * own estimate + (1 - w) * the child's, with w the share of the
node's own estimate in its weighted probability: all depths are mixed by how well each explains the training bytes.

A gram is a number: the D bytes before a byte, the nearest first, then the byte. In order, the grams of a node are
neighbours. Arrays of distinct grams hold the whole tree; nodes are runs of them. A sub-tree of two context bytes is
worked out by itself; what it says about the nodes above (256 of one byte, and the root) is a sum over their 255 choices.
"""

from __future__ import annotations

import numpy as np

_TABLE = 1 << 16
_LOG = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 0.5))])
_LOGF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _TABLE + 1)))])
_STIRLING = (1 / 12, -1 / 360, 1 / 1260)


def _lgamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + sum(c / x ** (2 * i + 1) for i, c in enumerate(_STIRLING))


def _half(n: np.ndarray) -> np.ndarray:
    """log of (1/2)(3/2)...(n - 1/2)."""
    out = _LOG[np.minimum(n, _TABLE)]
    big = n > _TABLE
    if big.any():
        out[big] = _lgamma(n[big] + 0.5) - 0.5723649429247001
    return out


def _fact(n: np.ndarray) -> np.ndarray:
    out = _LOGF[np.minimum(n, _TABLE)]
    big = n > _TABLE
    if big.any():
        out[big] = _lgamma(n[big] + 1.0)
    return out


def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _half(a) + _half(b) - _fact(a + b)


def grams(data: np.ndarray, depth: int) -> np.ndarray:
    """The gram of each byte; data begins with `depth` bytes that only serve as context."""
    out = data[depth:].astype(np.uint64)
    for d in range(depth):
        out |= data[depth - 1 - d : len(data) - 1 - d].astype(np.uint64) << np.uint64(8 * (depth - d))
    return out


def _mix(log_own: np.ndarray, log_below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's weighted probability and its own estimate's share in it."""
    total = np.logaddexp(log_own, log_below) - np.log(2)
    return total, np.exp(log_own - np.log(2) - total)


def _runs(keys: np.ndarray, counts: np.ndarray, depth: int, most: int):
    """Ranges of grams that hold whole sub-trees of two context bytes, of about `most` grams; a larger sub-tree is a range of its own."""
    near = keys >> np.uint64(8 * (depth - 1))
    cut = np.concatenate([np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]])), [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(keys):
        hi = int(cut[max(np.searchsorted(cut, lo, side="right"), np.searchsorted(cut, lo + most, side="right") - 1)])
        yield lo, hi
        lo = hi


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
    """Works out nodes from `depth` up to depth `top`, for sorted distinct grams and their counts, one bit place after the other.

    For each bit place: every gram's probability of its bit, mixed up to `top`, and the depth-top choices: their (context, bits
    so far) key, both counts and the log of their weighted probability.
    """
    pairs, count, moves = [keys], [counts], []
    for _ in range(depth - top):
        low = pairs[-1] & np.uint64(0xFF)
        less, move = np.unique(pairs[-1] >> np.uint64(16) << np.uint64(8) | low, return_inverse=True)
        pairs.append(less)
        moves.append(move.astype(np.int32))
        count.append(np.bincount(move, weights=count[-1], minlength=len(less)).astype(np.int64))
    for j in range(8):
        number, bit, probability, below = None, (keys >> np.uint64(7 - j) & np.uint64(1)) == 1, None, None
        for d, (pair, n) in enumerate(zip(pairs, count, strict=True)):
            key = pair >> np.uint64(8 - j)
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(fresh)
            of = (np.cumsum(fresh) - 1).astype(np.int32)
            b = np.add.reduceat(np.where(pair >> np.uint64(7 - j) & np.uint64(1), n, 0), first)
            a = np.add.reduceat(n, first) - b
            weighted = log_estimate(a, b)
            number = moves[d - 1][number] if d > 1 else moves[0] if d else None
            at = of if number is None else of[number]
            estimate = (np.where(bit, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1.0)
            if d:
                weighted, share = _mix(weighted, np.bincount(of[moves[d - 1][before]], weights=below, minlength=len(first)))
                w = share[at]
                estimate = w * estimate + (1 - w) * probability
            probability, below, before = estimate, weighted, first
        yield probability, (key[first], a, b, weighted)


def above(choices: dict[tuple[int, int], tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of one context byte and the root, from sums over the two-byte ones.

    choices: (context byte, choice 1 to 255) to counts a, b and the sum of the children's log weighted probabilities.
    Gives tables by (context byte, choice) of share and estimate of a one, and the same of the root by choice.
    """
    a, b, below = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((256, 256))
    for (c, x), (na, nb, s) in choices.items():
        a[c, x], b[c, x], below[c, x] = na, nb, s
    total, share = _mix(log_estimate(a, b), below)
    a0, b0 = a.sum(0), b.sum(0)
    _, share0 = _mix(log_estimate(a0, b0), total.sum(0))
    return share, (b + 0.5) / (a + b + 1.0), share0, (b0 + 0.5) / (a0 + b0 + 1.0)


def tops(keys: np.ndarray, counts: np.ndarray, depth: int, most: int = 1 << 17):
    """What sub-trees of two context bytes say about the nodes above: arrays of context byte, choice, zeros, ones and the sums of log weighted probabilities."""
    for lo, hi in _runs(keys, counts, depth, most):
        for j, (_, (key, a, b, weighted)) in enumerate(subtree(keys[lo:hi], counts[lo:hi], depth, 2)):
            at, of = np.unique((key >> np.uint64(j + 8)).astype(np.int64) << 8 | 1 << j | (key & np.uint64((1 << j) - 1)).astype(np.int64), return_inverse=True)
            total = [np.bincount(of, weights=x, minlength=len(at)) for x in (a, b, weighted)]
            yield at >> 8, at & 255, total[0].astype(np.int64), total[1].astype(np.int64), total[2]


def log_probabilities(keys: np.ndarray, counts: np.ndarray, tables, depth: int, most: int = 1 << 17) -> np.ndarray:
    """log10 of the probability of each gram's byte, mixed up to the root."""
    share, one, share0, one0 = tables
    out = np.zeros(len(keys))
    for lo, hi in _runs(keys, counts, depth, most):
        byte, near = (keys[lo:hi] & np.uint64(0xFF)).astype(np.int32), (keys[lo:hi] >> np.uint64(8 * depth)).astype(np.int32)
        for j, (p, _) in enumerate(subtree(keys[lo:hi], counts[lo:hi], depth, 2)):
            bit, choice = byte >> (7 - j) & 1 == 1, 1 << j | byte >> (8 - j)
            for w, q in ((share[near, choice], one[near, choice]), (share0[choice], one0[choice])):
                p = w * np.where(bit, q, 1 - q) + (1 - w) * p
            out[lo:hi] += np.log10(p)
    return out
