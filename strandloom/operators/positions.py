"""Positions, node numbers and common suffixes of all edges of a graph, with labels as numbers of two bits a symbol.

For a graph of which only this is asked, and k of up to 32 or from 45 to 64 (between, a number's higher word has too few symbols to cut by). An edge is one number, its reversed node and its symbol, whose order is the graph's; a row of a shuffle is a
sorted array of them. Ranges of that order (buckets) are cut at quantiles of every STRIDE-th edge, so that none is much larger than others, and never
split a node. Only the last node of a read can be a sink, on either strand, and a source is a sink's reverse complement: a bucket tells its own sinks, and
padded edges follow from these. What grows with the data is neither collected nor broadcast but for one row of totals for each bucket.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .reads import _spread

#: Edges between two that tell where buckets are cut, edges of a bucket, buckets beyond which these get larger ones, and rows of a batch.
STRIDE, ROWS, MANY, OUT = 1 << 12, 1 << 18, 1 << 12, 1 << 16
_CODE = np.full(256, 255, dtype=np.uint8)
for _i, _c in enumerate(b"acgt"):
    _CODE[_c] = _CODE[_c - 32] = _i
_FOUR = np.array([[b"acgt"[b >> 2 * j & 3] for j in range(4)] for b in range(256)], dtype=np.uint8).view(np.uint32).ravel()
_U = np.uint64


def _codes(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all reads of at least k symbols, one after the other, and where each begins (one more than reads)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    c = _CODE[np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]] if data is not None else np.zeros(0, np.uint8)
    kept = np.flatnonzero(c < 4)
    begin = np.searchsorted(kept, at - at[0])
    c, size = c[kept], np.diff(begin)
    enough = size >= k
    return c[np.repeat(enough, size)], np.concatenate([[0], np.cumsum(size[enough])])


def _strands(column: pa.Array, k: int):
    c, begin = _codes(column, k)
    if len(c):
        yield c, begin
        yield 3 - c[::-1], len(c) - begin[::-1]


def _windows(c: np.ndarray, m: int) -> np.ndarray:
    """Of each place, the next m symbols (32 at most), the last one first."""
    out, done, power, width = np.zeros(len(c) - m + 1, dtype=_U), 0, c.astype(_U), 1
    while m:
        if m & 1:
            out |= power[done : done + len(out)] << _U(2 * done)
            done += width
        m >>= 1
        if m:
            power = power[:-width] | power[width:] << _U(2 * width)
            width *= 2
    return out


def _nodes(c: np.ndarray, k: int) -> list[np.ndarray]:
    """The reversed node at each place, in one or two words, the higher first."""
    if k <= 32:
        return [_windows(c, k - 1)]
    n = len(c) - k + 2
    return [_windows(c[32:], k - 33)[:n] if k > 33 else np.zeros(n, _U), _windows(c, 32)[:n]]


def _keyed(node: list[np.ndarray], w: np.ndarray) -> list[np.ndarray]:
    low = node[-1] << _U(2) | w.astype(_U)
    return [low] if len(node) == 1 else [node[0] << _U(2) | node[1] >> _U(62), low]


def _node_of(key: list[np.ndarray]) -> list[np.ndarray]:
    return [key[0] >> _U(2)] if len(key) == 1 else [key[0] >> _U(2), key[1] >> _U(2) | key[0] << _U(62)]


def _order(words: list[np.ndarray], kind: str | None = None) -> np.ndarray:
    """The order of numbers of one or two words; equal ones stay as they are if kind is stable."""
    at = np.argsort(words[0], kind=kind)
    if len(words) > 1 and len(at) > 1:
        h = words[0][at]
        same = h[1:] == h[:-1]
        tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        sub = at[tied]
        at[tied] = sub[np.lexsort((words[1][sub], words[0][sub]))]
    return at


def _unlike(words: list[np.ndarray]) -> np.ndarray:
    """Whether each differs from the one before it."""
    out = np.ones(len(words[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
    return out


def _distinct(words: list[np.ndarray]) -> list[np.ndarray]:
    words = [np.sort(words[0])] if len(words) == 1 else (lambda at: [w[at] for w in words])(_order(words))
    keep = _unlike(words)
    return [w[keep] for w in words]


def _blob(words: list[np.ndarray]) -> bytes:
    """Sorted numbers as differences of the higher words, byte by byte as far as there are any, and the lower words."""
    d = np.diff(words[0], prepend=_U(0))
    n = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([n]) + d.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes() + b"".join(w.tobytes() for w in words[1:])


def _read(blob: bytes, count: int) -> list[np.ndarray]:
    n, d = blob[0], np.zeros((count, 8), dtype=np.uint8)
    d[:, :n] = np.frombuffer(blob, dtype=np.uint8, count=n * count, offset=1).reshape(n, count).T
    more = np.frombuffer(blob, dtype=_U, offset=1 + n * count) if len(blob) > 1 + n * count else None
    return [np.cumsum(d.view(_U).ravel(), dtype=_U)] + ([] if more is None else [more])


_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("nodes", pa.int64()), ("data", pa.binary()), ("last", pa.binary())])
_DDL = "bucket int, kind int, n long, nodes long, data binary, last binary"
EDGE, SINK, PADDED = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROWS)], schema=_ROWS)


def _dealt(node: list[np.ndarray], bounds: np.ndarray):
    """(bucket, from, to) of numbers in order, by the higher word of their nodes."""
    ends = np.concatenate([[0], np.searchsorted(node[0], bounds, side="left"), [len(node[0])]])
    for i in np.flatnonzero(np.diff(ends)):
        yield int(i), int(ends[i]), int(ends[i + 1])


def _sampled(batches, k: int):
    for b in batches:
        for c, begin in _strands(b.column(0), k):
            end = np.repeat(begin[1:], np.diff(begin))
            at = np.flatnonzero(np.arange(len(c)) + k <= end)
            some = at[STRIDE // 2 :: STRIDE]
            high = np.zeros(len(some), dtype=_U)
            for j in range(32 if k > 32 else 0, k - 1):
                high |= c[some + j].astype(_U) << _U(2 * (j - (32 if k > 32 else 0)))
            yield pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int64()), pa.array([high.tobytes()], pa.binary())], names=["n", "high"])


def _cut(batches, k: int, bounds: np.ndarray):
    """Edges and the last nodes of reads, by buckets."""
    for b in batches:
        keys, lasts = [], []
        for c, begin in _strands(b.column(0), k):
            node = _nodes(c, k)
            at = np.flatnonzero(np.arange(len(c)) + k <= np.repeat(begin[1:], np.diff(begin)))
            keys.append(_keyed([x[at] for x in node], c[at + k - 1]))
            lasts.append([x[begin[1:] - k + 1] for x in node])
        if keys:
            out = []
            for kind, parts in ((EDGE, keys), (SINK, lasts)):
                words = _distinct([np.concatenate(x) for x in zip(*parts, strict=True)])
                for i, lo, hi in _dealt(_node_of(words) if kind == EDGE else words, bounds):
                    out.append((i, kind, hi - lo, None, _blob([w[lo:hi] for w in words]), None))
            yield _rows(out)


def _buckets(batches):
    """(bucket, rows) of batches ordered by bucket."""
    of, held = None, []
    for b in batches:
        for r in zip(*(b.column(c) for c in ("bucket", "kind", "n", "data")), strict=True):
            bucket, row = r[0].as_py(), (r[1].as_py(), r[2].as_py(), r[3].as_py())
            if bucket != of:
                if held:
                    yield of, held
                of, held = bucket, []
            held.append(row)
    if held:
        yield of, held


def _joined(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(_read(d, n) for _, n, d in parts), strict=True)]


def _merged(batches):
    """The distinct edges of each bucket, and of the last nodes those that no edge leaves."""
    for bucket, held in _buckets(batches):
        edges, ends, out, node = [r for r in held if r[0] == EDGE], [r for r in held if r[0] == SINK], [], None
        if edges:
            words = _distinct(_joined(edges))
            node = _node_of(words)
            new = _unlike(node)
            out.append((bucket, EDGE, len(new), int(new.sum()), _blob(words), b"".join(x[-1].tobytes() for x in node)))
            node = [x[new] for x in node]
        if ends:
            sinks = _distinct(_joined(ends))
            if node:
                both = [np.concatenate([x, y]) for x, y in zip(node, sinks, strict=True)]
                at = _order(both, "stable")
                alone = at[_unlike([x[at] for x in both])]
                sinks = [x[np.sort(alone[alone >= len(node[0])])] for x in both]
            if len(sinks[0]):
                out.append((bucket, SINK, len(sinks[0]), None, _blob(sinks), None))
        yield _rows(out)


def _shifted(node: list[np.ndarray], bits: int, left: bool) -> list[np.ndarray]:
    if len(node) == 1:
        return [node[0] << _U(bits) if left else node[0] >> _U(bits)] if bits < 64 else [np.zeros_like(node[0])]
    hi, lo = node
    if bits >= 64:
        return [lo << _U(bits - 64), np.zeros_like(lo)] if left else [np.zeros_like(hi), hi >> _U(bits - 64)]
    if not bits:
        return [hi, lo]
    return [hi << _U(bits) | lo >> _U(64 - bits), lo << _U(bits)] if left else [hi >> _U(bits), lo >> _U(bits) | hi << _U(64 - bits)]


def _symbol(node: list[np.ndarray], j: int) -> np.ndarray:
    return _shifted(node, 2 * j, False)[-1] & _U(3)


def _specials(batches, k: int, bounds: np.ndarray):
    """The `$` edges of sinks and the padded edges of sources, by buckets: node words, plain symbols and code of w, as columns of words."""
    for b in batches:
        for n, data in zip(b.column("n").to_pylist(), b.column("data").to_pylist(), strict=True):
            sinks = _read(data, n)
            symbols = [_symbol(sinks, j) for j in range(k - 1)]
            source = [np.zeros(n, _U) for _ in sinks]
            for j in range(k - 1):
                one = [np.zeros(n, _U)] * (len(sinks) - 1) + [_U(3) - symbols[k - 2 - j]]
                source = [x | y for x, y in zip(source, _shifted(one, 2 * j, True), strict=True)]
            every = [sinks + [np.full(n, k - 1, _U), np.zeros(n, _U)]]
            room = _U(2 * (k - 1) - 64 * (len(sinks) - 1))
            top = _U((1 << int(room)) - 1)
            for p in range(k - 1):
                node = _shifted(source, 2 * (k - 1 - p), True)
                node[0] = node[0] & top
                every.append(node + [np.full(n, p, _U), _symbol(source, p) + _U(1)])
            words = [np.concatenate(x) for x in zip(*every, strict=True)]
            at = np.lexsort(words[::-1])
            words = [w[at] for w in words]
            keep = _unlike(words)
            words = [w[keep] for w in words]
            yield _rows([(i, PADDED, hi - lo, None, np.stack([w[lo:hi] for w in words]).tobytes(), None) for i, lo, hi in _dealt(words, bounds)])


def _special_columns(rows: list[tuple]) -> list[np.ndarray]:
    return list(np.concatenate([np.frombuffer(d, dtype=_U).reshape(-1, n) for _, n, d in rows], axis=1))


def _united(batches):
    for bucket, held in _buckets(batches):
        words = _special_columns(held)
        at = np.lexsort(words[::-1])
        words = [w[at] for w in words]
        keep = _unlike(words)
        words = [w[keep] for w in words]
        yield _rows([(bucket, PADDED, len(words[0]), int(_unlike(words[:-1]).sum()), np.stack(words).tobytes(), b"".join(w[-1].tobytes() for w in words[:-1]))])


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths."""
    high = x >> _U(32)
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, np.frexp((x & _U(0xFFFFFFFF)).astype(np.float64))[1])


def _text(data: np.ndarray, width: int) -> pa.Array:
    n = data.size // width
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(data)))


def _placed(batches, k: int, before: dict):
    for bucket, held in _buckets(batches):
        edges, padded = [r for r in held if r[0] == EDGE], [r for r in held if r[0] == PADDED]
        parts = []
        if padded:
            parts.append(_special_columns(padded))
        if edges:
            key = _joined(edges)
            parts.append(_node_of(key) + [np.full(len(key[0]), k - 1, _U), (key[-1] & _U(3)) + _U(1)])
        *node, plain, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        if padded:  # padded edges come before those of a node that goes on with `a`
            at = _order(node, "stable")
            *node, plain, w = (x[at] for x in (*node, plain, w))
        pos, node_id, last = before[bucket]
        new = _unlike([*node, plain])
        ids = node_id - 1 + np.cumsum(new)
        prev = [np.concatenate([[_U(last[i]) if last else _U(0)], x[:-1]]) for i, x in enumerate([*node, plain])]
        differ = [x ^ y for x, y in zip(node, prev, strict=False)]
        length = _bits(differ[-1])
        if len(node) > 1:
            length = np.where(differ[0] > 0, _bits(differ[0]) + 64, length)
        lcs = np.minimum(np.minimum(k - 1 - (length + 1) // 2, plain.astype(np.int64)), prev[-1].astype(np.int64))
        lcs[~new] = k - 1
        if last is None:
            lcs[0] = 0
        for lo in range(0, len(w), OUT):
            of = slice(lo, lo + OUT)
            chars = np.concatenate([_FOUR[x[of].view(np.uint8)].view(np.uint8).reshape(-1, 32) for x in node[::-1]], axis=1)[:, : k - 1]
            short = np.flatnonzero(plain[of] < k - 1)
            if len(short):
                pads = np.arange(k - 1) < (k - 1 - plain[of][short].astype(np.int64))[:, None]
                chars[short] = np.where(pads, np.uint8(ord("$")), chars[short])
            n = len(chars)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(pos + lo, pos + lo + n)), pa.array(ids[of]), _text(chars, k - 1), _text(np.frombuffer(b"$acgt", np.uint8)[w[of].astype(np.int64)], 1), pa.array(lcs[of].astype(np.int64))],
                names=["pos", "node_id", "node", "w", "lcs"],
            )


def positions(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """(pos, node_id, node, w, lcs) of every edge of the graph of these texts, with reverse complements and all dummies: what Graph.of_text(docs, k).edges has."""
    if not (2 <= k <= 32 or 45 <= k <= 64):
        raise ValueError("k must be from 2 to 32 or from 45 to 64")
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    texts = _spread(docs.select(text))
    seen = texts.mapInArrow(partial(_sampled, k=k), "n long, high binary").where("n > 0").collect()  # a number for every STRIDE edges
    total, high = sum(r.n for r in seen), np.sort(np.frombuffer(b"".join(r.high for r in seen), dtype=_U))
    count = max(1, -(-total // max(ROWS, total // MANY)))
    bounds = np.unique(high[(np.arange(1, count) * len(high)) // count]) if len(high) else high
    by_bucket = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    parts = cut(by_bucket(texts.mapInArrow(partial(_cut, k=k, bounds=bounds), _DDL)).mapInArrow(_merged, _DDL), "edges")
    padded = by_bucket(parts.where(F.col("kind") == SINK).mapInArrow(partial(_specials, k=k, bounds=bounds), _DDL)).mapInArrow(_united, _DDL)
    padded = cut(padded, "padded")
    edges = parts.where(F.col("kind") == EDGE)
    totals: dict[int, list] = {}
    for r in edges.union(padded).select("bucket", "kind", "n", "nodes", "last").collect():  # two rows for each bucket
        t = totals.setdefault(r.bucket, [0, 0, []])
        t[0] += r.n
        t[1] += r.nodes
        last = tuple(np.frombuffer(r.last, dtype=_U).tolist())
        t[2].append(last if r.kind == PADDED else (*last, k - 1))
    before, pos, node, last = {}, 0, 0, None
    for bucket in sorted(totals):
        before[bucket] = (pos, node, last)
        n, nodes, lasts = totals[bucket]
        pos, node, last = pos + n, node + nodes, max(lasts)
    return by_bucket(edges.union(padded).select("bucket", "kind", "n", "data")).mapInArrow(partial(_placed, k=k, before=before), "pos long, node_id long, node string, w string, lcs long")
