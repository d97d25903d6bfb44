"""SentencePiece encoding and decoding: merges for a model of type BPE, a max-plus (Viterbi) search over the scores for others.

A BPE model's encoding merges, of all adjacent pairs that form a piece, the one with the greatest score (the first of equal ones), until
none does. Pieces don't cross white space (see below), so each distinct pre-token is merged once per task.

For other models, an encoding is the path of pieces with the greatest sum of scores from a text's begin to its end; of equal sums, the one
whose last piece is longest, then the last but one, and so on. Scores are integers here, so sums are exact and the max-plus
product is associative. This is how the library encodes with a unigram model.

White space (and line ends, if no piece joins them) bounds all pieces, so a text is the sequence of its pre-tokens, and each distinct
pre-token is searched once per task, all new ones side by side. A giant text, or one for whose vocabulary that does not
hold, is cut into chunks at any place. A boundary's state is how far the piece across it reaches: at most the longest
piece. Each chunk gives a transfer matrix from entry to exit states; matrices are combined by a parallel prefix scan; with its
entry scores each chunk then works out by itself which entry state each exit state comes from, these maps are combined from the
end, and each chunk is traced back on its own.

Nulls: a null text is empty and has no pieces; a null doc_id stays null. One narrow pass: keys and their skew have no effect.
A literal U+2581 is read as a space, as the library does; only such texts don't decode to themselves.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, utf8

SPACE = 0x2581
MARK = chr(SPACE).encode()
#: Bytes of a giant text, characters of a chunk, chunks worked out side by side, entries of a task's list, bytes of text at once.
GIANT, CHUNK, LANES, KEPT, AT_ONCE = 64 << 10, 512, 256, 1_000_000, 2 << 20
LOW = -(1 << 62)
_M = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a SentencePiece model, as a trie whose steps are entries of a hash table."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.merges = model.trainer_spec.model_type == pb.TrainerSpec.BPE
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = np.array([sp.get_score(i) for i in plain], dtype=np.float64)
        scale = 1 if (scores == np.rint(scores)).all() else 1 << 10
        self.byte_ids = np.full(256, -1)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        self.unknown, self.unknown_score = sp.unk_id(), int(np.rint(scores.min() * scale)) - 10 * scale
        pieces = {i: sp.id_to_piece(i) for i in plain}
        self.longest = max(map(len, pieces.values()))
        self.ids = {p: i for i, p in pieces.items()}
        self.ranks = {p: -s for p, s in zip(pieces.values(), scores.tolist(), strict=True)}
        self.cuts_space = not any(re.search("[^▁]▁", p) for p in pieces.values())
        self.cuts_line = not any("\n" in p and len(p) > 1 for p in pieces.values())
        self.bytes = [b""] * n
        for i, p in pieces.items():
            self.bytes[i] = p.replace("▁", " ").encode()
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                self.bytes[i] = bytes([b])
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.size = np.array([len(b) for b in self.bytes])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        step: dict[int, int] = {}
        piece, score = [-1], [0]
        for (i, p), s in zip(pieces.items(), np.rint(scores * scale).astype(np.int64).tolist(), strict=True):
            node = 0
            for c in map(ord, p):
                key = node << 21 | c
                if key not in step:
                    step[key] = len(piece)
                    piece.append(-1)
                    score.append(0)
                node = step[key]
            piece[node], score[node] = i, s
        self.piece, self.score = np.array(piece), np.array(score, dtype=np.int64)
        self.bits = max(4, len(step) * 4 - 1).bit_length()
        self.keys, self.next = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int64)
        left_k, left_v = np.fromiter(step.keys(), dtype=np.int64, count=len(step)), np.fromiter(step.values(), dtype=np.int64, count=len(step))
        at = self._place(left_k)
        while len(left_k):
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(at), dtype=bool)
            take[first] = True
            take &= free
            self.keys[at[take]], self.next[at[take]] = left_k[take], left_v[take]
            left_k, left_v, at = left_k[~take], left_v[~take], (at[~take] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _M >> np.uint64(64 - self.bits)).astype(np.int64)

    def follow(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node after each node's step by a character, or -1."""
        key = nodes << 21 | chars
        at, out = self._place(key), np.full(len(key), -1, dtype=np.int64)
        todo = np.arange(len(key))
        while len(todo):
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.next[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def edges(self, chars: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, length, score and id of every piece in chars that ends by its start's stop; a character without its own piece is an unknown one."""
        start = np.arange(len(chars))
        node, single = np.zeros(len(chars), dtype=np.int64), np.zeros(len(chars), dtype=bool)
        found = []
        live = start[start < stop]
        for n in range(1, self.longest + 1):
            live = live[live + n <= stop[live]]
            after = self.follow(node[live], chars[live + n - 1])
            live, after = live[after >= 0], after[after >= 0]
            if not len(live):
                break
            node[live] = after
            is_piece = self.piece[after] >= 0
            at = live[is_piece]
            found.append((at, np.full(len(at), n), self.score[after[is_piece]], self.piece[after[is_piece]]))
            if n == 1:
                single[at] = True
        odd = start[~single & (start < stop)]
        found.append((odd, np.ones(len(odd), np.int64), np.full(len(odd), self.unknown_score), np.full(len(odd), -1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def spelt(self, ids: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Ids with unknown characters (-1, chars tells which) as their bytes, or as the unknown piece."""
        if (ids >= 0).all():
            return ids
        out = []
        for i, c in zip(ids.tolist(), chars.tolist(), strict=True):
            if i >= 0:
                out.append(i)
            elif (spell := self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))]).min() < 0:
                out.append(self.unknown)
            else:
                out.extend(spell.tolist())
        return np.array(out, dtype=np.int64)

    def text_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the pieces, with spaces."""
        n = self.size[ids]
        end = np.cumsum(n)
        return self.flat[np.repeat(self.start[ids] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def characters(text: str) -> np.ndarray:
    out = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    out[out == 32] = SPACE
    return out


def encode_words(v: Vocabulary, words: list[str]) -> list[np.ndarray]:
    """The ids of each of the words, which are searched side by side, place by place."""
    chars = characters("".join(words))
    size = np.array([len(w) for w in words])
    begin = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(words)), size)
    start, n, score, ids = v.edges(chars, begin[of + 1])
    place = start + n - begin[of[start]]
    order = np.lexsort((start, of[start], place))
    start, n, score, ids, place = (x[order] for x in (start, n, score, ids, place))
    # a word of n characters has n + 1 nodes
    source, target = start + of[start], start + n + of[start]
    best = np.full(len(chars) + len(words), LOW)
    best[begin[:-1] + np.arange(len(words))] = 0
    back = np.zeros(len(best), dtype=np.int64)
    cut = np.searchsorted(place, np.arange(1, (size.max() if len(size) else 0) + 2))
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if lo == hi:
            continue
        got, to = best[source[lo:hi]] + score[lo:hi], target[lo:hi]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        top = np.maximum.reduceat(got, first)
        is_top = np.flatnonzero(got == np.repeat(top, np.diff(np.concatenate([first, [hi - lo]]))))
        where, at = np.unique(to[is_top], return_index=True)
        best[where], back[where] = top, lo + is_top[at]
    node, word, steps = begin[1:] + np.arange(len(words)), np.arange(len(words)), []
    word, node = word[size > 0], node[size > 0]
    while len(word):
        edge = back[node]
        steps.append((word, ids[edge], chars[start[edge]]))
        node = source[edge]
        more = node > begin[word] + word
        word, node = word[more], node[more]
    out = [np.zeros(0, np.int64)] * len(words)
    if steps:
        w, i, c = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(w[::-1], kind="stable")
        w, i, c = w[::-1][order], i[::-1][order], c[::-1][order]
        cuts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        for lo, hi in zip(cuts, [*cuts[1:], len(w)], strict=True):
            out[w[lo]] = v.spelt(i[lo:hi], c[lo:hi])
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of pairs of matrices."""
    return np.maximum((a[..., :, :, None] + b[..., None, :, :]).max(axis=-2), LOW)


def scan(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, in logarithmically many steps."""
    out, d = matrices.copy(), 1
    while d < len(out):
        out = np.concatenate([out[:d], product(out[:-d], out[d:])])
        d *= 2
    return out


def encode_chunks(v: Vocabulary, chars: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The ids of one text, by chunks; a chunk's pieces start in it and may end beyond it."""
    n, k = len(chars), v.longest
    chunk = max(chunk, k)
    if not n:
        return np.zeros(0, np.int64)
    cuts = np.arange(0, max(1, n - n % chunk if n % chunk >= k or n < chunk else n - n % chunk), chunk)
    cuts = np.concatenate([cuts[cuts + k <= n] if n >= k else np.zeros(1, np.int64), [n]])
    lanes, width = len(cuts) - 1, int(np.diff(cuts).max())
    matrices = np.empty((lanes, k, k), dtype=np.int64)
    tables = []
    for lo in range(0, lanes, LANES):
        hi = min(lanes, lo + LANES)
        a, z = int(cuts[lo]), min(n, int(cuts[hi]) + k)
        start, size, score, ids = v.edges(chars[a:z], np.full(z - a, z - a))
        keep = start < cuts[hi] - a
        start, size, score, ids = start[keep], size[keep], score[keep], ids[keep]
        lane = np.searchsorted(cuts[lo + 1 : hi + 1] - a, start, side="right")
        table, piece = np.full((hi - lo, width, k), LOW), np.full((hi - lo, width, k), -2, dtype=np.int32)
        table[lane, start - (cuts[lo:hi] - a)[lane], size - 1], piece[lane, start - (cuts[lo:hi] - a)[lane], size - 1] = score, ids
        tables.append(piece)
        length = np.diff(cuts[lo : hi + 1])
        best = np.full((hi - lo, k, width + k), LOW)
        best[:, np.arange(k), np.arange(k)] = 0
        _forward(best, table, width)
        for i in range(hi - lo):
            matrices[lo + i] = best[i, :, length[i] : length[i] + k]
        tables[-1] = (table, piece)
    entry = np.full((lanes, k), LOW)
    entry[0, 0] = 0
    if lanes > 1:
        entry[1:] = scan(matrices)[:-1, 0, :]
    # with its entry scores, each chunk tells from which entry state each exit state comes
    origin, backs = np.empty((lanes, k), dtype=np.int64), []
    for g, (table, _) in enumerate(tables):
        lo, hi = g * LANES, min(lanes, g * LANES + LANES)
        best = np.full((hi - lo, 1, width + k), LOW)
        best[:, 0, :k] = entry[lo:hi]
        back = _forward(best, table, width, True)
        backs.append(back)
        at = np.diff(cuts[lo : hi + 1])[:, None] + np.arange(k)
        moving = np.ones_like(at, dtype=bool)
        rows = np.arange(hi - lo)[:, None]
        while moving.any():
            step = back[rows, np.clip(at, 0, width + k - 1)]
            moving = step > 0
            at = at - step
        origin[lo:hi] = np.minimum(at, k - 1)
    exits = np.zeros(lanes, dtype=np.int64)
    for i in range(lanes - 1, 0, -1):
        exits[i - 1] = origin[i, exits[i]]
    out_id, out_char, out_lane = [], [], []
    for g, (_, piece) in enumerate(tables):
        lo, hi = g * LANES, min(lanes, g * LANES + LANES)
        at, lane = np.diff(cuts[lo : hi + 1]) + exits[lo:hi], np.arange(hi - lo)
        while len(lane):
            step = backs[g][lane, at]
            lane, at, step = lane[step > 0], at[step > 0], step[step > 0]
            at = at - step
            out_id.append(piece[lane, at, step - 1])
            out_char.append(chars[cuts[lo + lane] + at])
            out_lane.append(lane + lo)
    lane = np.concatenate(out_lane)[::-1]
    order = np.argsort(lane, kind="stable")
    return v.spelt(np.concatenate(out_id)[::-1][order].astype(np.int64), np.concatenate(out_char)[::-1][order])


def _forward(best: np.ndarray, table: np.ndarray, width: int, trace: bool = False):
    """Fills best (lane, row, place) from its entry scores; with trace, the lengths of the pieces by which places are reached."""
    k = table.shape[2]
    back = np.zeros((best.shape[0], best.shape[2]), dtype=np.int64) if trace else None
    for t in range(width):
        own = best[:, :, t]
        got = np.where((own == LOW)[:, :, None] | (table[:, t, :] == LOW)[:, None, :], LOW, own[:, :, None] + table[:, t, :][:, None, :])
        there = best[:, :, t + 1 : t + 1 + k]
        if trace:
            # an entry score stands for pieces that began before, which come first among equals
            back[:, t + 1 : t + 1 + k] = np.where(got[:, 0] > there[:, 0], np.arange(1, k + 1), back[:, t + 1 : t + 1 + k])
        np.maximum(there, got, out=there)
    return back


class Encoder:
    """Encodes texts, with a bounded list of known pre-tokens."""

    def __init__(self, v: Vocabulary, giant: int = GIANT, chunk: int = CHUNK):
        self.v, self.giant, self.chunk, self.splits = v, giant, chunk, v.cuts_space
        self.pattern = re.compile(rb" *[^ \n]+| +|\n" if v.cuts_line else rb" *[^ ]+| +")
        self._clear()

    def _clear(self):
        self.known: dict[bytes, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _searched(self, short: list[bytes], long: list[bytes]) -> list[np.ndarray]:
        found = []
        for i in range(0, len(short), 50_000):
            found += encode_words(self.v, [w.decode("utf-8", "surrogatepass") for w in short[i : i + 50_000]])
        return found + [encode_chunks(self.v, characters(w.decode("utf-8", "surrogatepass")), self.chunk) for w in long]

    def _learn(self, words: list[bytes]):
        if len(self.known) > KEPT:
            self._clear()
            words = list(words)
        new = [w for w in words if w not in self.known]
        long = [w for w in new if len(w) > 4 * CHUNK]
        short = [w for w in new if len(w) <= 4 * CHUNK]
        found = self._searched(short, long)
        self.known.update(zip(short + long, range(len(self.size), len(self.size) + len(found)), strict=True))
        size = np.array([len(f) for f in found], dtype=np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *found])

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        texts = [t.replace(MARK, b" ") for t in texts]  # both are the space's character, whether or not a text is cut there
        out: list = [None] * len(texts)
        split = {}
        for k, t in enumerate(texts):
            if not t:
                out[k] = np.zeros(0, np.int64)
            elif len(t) > self.giant or not self.splits:
                out[k] = encode_chunks(self.v, characters(" " + t.decode("utf-8", "surrogatepass")), self.chunk)
            else:
                split[k] = self.pattern.findall(b" " + t)
        self._learn(list({w for s in split.values() for w in s}))
        known = self.known
        for k, s in split.items():
            at = np.fromiter((known[w] for w in s), dtype=np.int64, count=len(s))
            n = self.size[at]
            end = np.cumsum(n)
            out[k] = self.flat[np.repeat(self.start[at] - (end - n), n) + np.arange(int(end[-1]))]
        return out


def merged(v: Vocabulary, word: str) -> list[str]:
    """The parts of a word after all merges."""
    parts, get, none = list(word), v.ranks.get, float("inf")
    if len(parts) > 128:
        return _merged_long(v, parts)
    ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while ranks and (least := min(ranks)) < none:
        i = ranks.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i:
            ranks[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(ranks):
            ranks[i] = get(parts[i] + parts[i + 1], none)
    return parts


def _merged_long(v: Vocabulary, parts: list[str]) -> list[str]:
    """The same by a heap of pairs and a linked list of parts, for words of any length."""
    n = len(parts)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple] = []

    def add(i: int, j: int):
        if i >= 0 and j >= 0 and (rank := v.ranks.get(pair := parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (rank, i, j, len(pair)))

    for i in range(n - 1):
        add(i, i + 1)
    while heap:
        _, i, j, size = heapq.heappop(heap)
        if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], ""
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        add(before[i], i)
        add(i, after[i])
    return [p for p in parts if p]


class Merger(Encoder):
    """Encodes texts by merges, pre-token by pre-token."""

    def __init__(self, v: Vocabulary):
        super().__init__(v, giant=1 << 62)
        self.splits = True
        if not v.cuts_space:
            self.pattern = re.compile(rb"(?s).+")

    def _searched(self, short: list[bytes], long: list[bytes]) -> list[np.ndarray]:
        found, ids = [], self.v.ids.get
        for w in short + long:
            parts = merged(self.v, w.decode("utf-8", "surrogatepass").replace(" ", "▁"))
            found.append(self.v.spelt(np.array([ids(p, -1) for p in parts], dtype=np.int64), np.array([ord(p[0]) for p in parts])))
        return found


def encoder(v: Vocabulary, giant: int = GIANT, chunk: int = CHUNK) -> Encoder:
    """What encodes as the model's type says."""
    return Merger(v) if v.merges else Encoder(v, giant, chunk)


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of ids: pieces side by side, without the space that encoding puts first."""
    return v.text_of(np.asarray(ids, dtype=np.int64)).tobytes()[1:]


def encode(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id and ids of each whole text."""

    def run(batches):
        e = encoder(vocabulary(model), giant, chunk)
        for b in batches:
            at, data = utf8(b.column("text"))
            for lo, hi in slices(at, AT_ONCE):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([x.astype(np.int32) for x in e([data[at[k] : at[k + 1]].tobytes() for k in range(lo, hi)])], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""

    def run(batches):
        v = vocabulary(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([decode(v, x.values.to_numpy() if len(x) else np.zeros(0, np.int64)).decode("utf-8", "replace") for x in b.column("ids")], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _checked(batches, model: str):
    v = vocabulary(model)
    e = encoder(v)
    for b in batches:
        at, data = utf8(b.column("text"))
        ids_crc, n, same = [], [], []
        for lo, hi in slices(at, AT_ONCE):
            texts = [data[at[k] : at[k + 1]].tobytes() for k in range(lo, hi)]
            for t, ids in zip(texts, e(texts), strict=True):
                n.append(len(ids))
                ids_crc.append(zlib.crc32(ids.astype("<i4").tobytes()))
                same.append(decode(v, ids) == t)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(n, pa.int64()), pa.array(ids_crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_bytes", "n_pieces", "ids_crc32", "round_trip"])


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encodes and decodes each whole text: doc_id, n_bytes, n_pieces, ids_crc32 (of the ids as 32-bit little-endian numbers) and round_trip."""
    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_checked, model=model), "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, round_trip boolean")
