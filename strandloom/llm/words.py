"""Words of many texts at once: their places and 64-bit hashes, by array operations on the bytes.

A word is a run of bytes other than the six ASCII white-space bytes. A hash is mixed from the word's bytes, eight at a
time; two words of a corpus of 10^9 distinct ones share a hash with probability below 0.03.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .common import IS_SPACE

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)
#: Words beyond so many bytes are hashed one by one.
LONG = 512


def mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of a hash and one more number."""
    h = (h ^ w) * _M1
    h ^= h >> np.uint64(32)
    h *= _M2
    h ^= h >> np.uint64(29)
    return h


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts data[at[i]:at[i+1]], and for each text (one more) the first word's number."""
    own = data[at[0] : at[-1]]
    word = np.zeros(len(own) + 2, dtype=bool)
    np.logical_not(IS_SPACE[own], out=word[1:-1])
    edge = np.zeros(len(own) + 1, dtype=bool)
    edge[at - at[0]] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    return starts + at[0], ends + at[0], np.searchsorted(starts, at - at[0])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)]) if len(starts) and ends[-1] + 8 > len(data) else data
    eight = np.ndarray((max(0, len(padded) - 7),), dtype="<u8", buffer=np.ascontiguousarray(padded), strides=(1,))
    h = n.astype(np.uint64) * _M2
    todo = np.arange(len(n)) if len(n) and n.max() <= LONG else np.flatnonzero(n <= LONG)
    for done in range(0, LONG, 8):
        if done:
            todo = todo[n[todo] > done]
        if not len(todo):
            break
        w = eight[starts[todo] + done] & _MASK[np.minimum(n[todo] - done, 8)]
        h[todo] = mixed(h[todo], w)
    for i in np.flatnonzero(n > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingle_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's n-word shingles, and for each text (one more) the first one's number.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    words = np.diff(first)
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    pos = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], count)
    size = np.repeat(np.minimum(words, n), count)
    out = np.full(len(pos), 0x2545F4914F6CDD1D, dtype=np.uint64)
    for j in range(n):
        there = size > j
        if there.all():
            out = mixed(out, h[pos + j])
        else:
            out[there] = mixed(out[there], h[pos[there] + j])
    return mixed(out, size.astype(np.uint64)), begin
