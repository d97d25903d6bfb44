"""LM scoring: context-tree weighting learned from the corpus, next to a word unigram base.

Learning and lookup go by blocks and buckets. A block is some BLOCK documents, or some BLOCK_BYTES where they are long, chosen by a hash of id and text; a bucket is
a share of all grams (by their two nearest context bytes) or of all words (by hash). Each block hands every bucket its
distinct grams or words, with their counts in training documents (0 for those of held-out ones alone). A bucket adds up all
blocks' counts: these are the sub-trees of its two-byte contexts; what they say about the 256 one-byte nodes and the root is summed into a
table of at most 65,280 rows, the only model data that is broadcast. The bucket then works out every gram's log probability and answers
each block; the block adds up its documents' scores. Counts cover all training documents, and what is gathered grows
with the input; a task holds one block's texts, or one bucket's distinct grams and one block's share of them.

The text of a document is its bytes, A-Z lower-cased, and one end byte (0xFF, which UTF-8 never uses); before a text stand
`depth` such bytes. So the model is a probability over all texts.

Nulls: a null text is empty: no words, one end. A document whose id is null is in training. An empty table gives an empty result. Rows with the
same id and text are in one block and count each. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import context_tree as ctw
from .common import bounded, slices, utf8, written
from .words import lowered, mixed, word_hashes, word_spans

DEPTH, BLOCK, BLOCK_BYTES, AT_ONCE, PENDING = 5, 4096, 24 << 20, 1 << 20, 2 << 20
END = 0xFF
_PART = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _coded(x: np.ndarray) -> bytes:
    """Sorted numbers as differences, which compress."""
    return np.diff(x, prepend=np.uint64(0)).tobytes()


def _decoded(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, dtype=np.uint64), dtype=np.uint64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several lists, in order, with the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _grams(at: np.ndarray, data: np.ndarray, depth: int):
    """For slices of about AT_ONCE bytes: first and last text, each gram and its text (counted from the first)."""
    for lo, hi in slices(at, AT_ONCE):
        n = hi - lo
        low = lowered(data[at[lo] : at[hi]])
        if len(low) > 2 * AT_ONCE:  # a long text, which is alone: its grams part by part
            padded = np.concatenate([np.full(depth, END, np.uint8), low, np.full(1, END, np.uint8)])
            for s in range(0, len(low) + 1, AT_ONCE):
                g = ctw.grams(padded[s : s + AT_ONCE + depth], depth)
                yield lo, hi, g, np.zeros(len(g), dtype=np.int32)
            continue
        own = at[lo : hi + 1] - at[lo]
        size = np.diff(own)
        # every text gets an end byte and the context of the next one's beginning
        begin = own[:-1] + depth * np.arange(1, n + 1)
        padded = np.full(depth * (n + 1) + len(low), END, dtype=np.uint8)
        padded[np.arange(len(low)) + np.repeat(depth * np.arange(1, n + 1), size)] = low
        edge = np.zeros(len(padded) - depth + 1, dtype=np.int8)  # from each text's first byte to its end byte
        edge[begin - depth] += 1
        edge[begin + size + 1 - depth] -= 1
        yield lo, hi, ctw.grams(padded, depth)[np.cumsum(edge[:-1], dtype=np.int8) > 0], np.repeat(np.arange(n, dtype=np.int32), size + 1)


def _words(at: np.ndarray, data: np.ndarray, depth: int):
    """The same with the hashes of words."""
    for lo, hi in slices(at, AT_ONCE):
        low = lowered(data[at[lo] : at[hi]])
        starts, ends, first = word_spans(low, at[lo : hi + 1] - at[lo])
        yield lo, hi, word_hashes(low, starts, ends), np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(first))


def _bucketed(keys: np.ndarray, n: int, word: bool, depth: int) -> np.ndarray:
    h = keys >> np.uint64(40) if word else keys >> np.uint64(8 * (depth - 1))
    return (mixed(h, np.full(len(h), 7, np.uint64)) % np.uint64(n)).astype(np.int64) + n * word


def _split(keys: np.ndarray, counts: np.ndarray, n: int, word: bool, depth: int):
    """Keys and counts of each bucket that has some."""
    of = _bucketed(keys, n, word, depth)
    order = np.argsort(of, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]])) if len(of) else np.zeros(0, np.int64)
    for lo, hi in zip(cut, [*cut[1:], len(of)], strict=True):
        yield int(of[order[lo]]), keys[order[lo:hi]], counts[order[lo:hi]]


def _by_block(batches):
    """Runs of rows of one block, as lists of record batches."""
    now, held = None, []
    for b in batches:
        block = b.column("block").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
        for lo, hi in zip(cut, [*cut[1:], len(block)], strict=True):
            if block[lo] != now:
                if held:
                    yield now, held
                now, held = int(block[lo]), []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, held


def _column(batches: list[pa.RecordBatch], name: str):
    return pa.chunked_array([b.column(name) for b in batches]).combine_chunks()


def _gathered(batches, n: int, depth: int):
    """Each block's distinct grams and words, by bucket, with their counts in training."""
    for block, rows in _by_block(batches):
        at, data = utf8(_column(rows, "text"))
        training = ~_column(rows, "held_out").to_numpy(zero_copy_only=False)
        for word in (False, True):
            parts, size = [], 0
            for lo, _, keys, of in (_words if word else _grams)(at, data, depth):
                own = training[lo + of]
                for chosen, count in ((own, 1), (~own, 0)):
                    k, c = np.unique(keys[chosen], return_counts=True)
                    parts.append((k, c * count))
                    size += len(k)
                if size > PENDING:
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
            for bucket, k, c in _split(*_summed(parts), n, word, depth):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([_coded(k)], pa.binary()), pa.array([c.astype(np.uint32).tobytes()], pa.binary())], schema=_PART)


def _merged(batches):
    """One row for each bucket: all blocks' counts added up."""
    now, parts, size = None, [], 0

    def done():
        k, c = _summed(parts)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_coded(k)], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([int(c.sum())]), pa.array([int((c > 0).sum())])], names=["bucket", "keys", "counts", "total", "distinct"])

    for b in batches:
        for bucket, keys, counts in zip(b.column("bucket").to_pylist(), b.column("keys"), b.column("counts"), strict=True):
            if bucket != now:
                if parts:
                    yield done()
                now, parts, size = bucket, [], 0
            parts.append((_decoded(keys.as_buffer()), np.frombuffer(counts.as_buffer(), dtype=np.uint32).astype(np.int64)))
            size += len(parts[-1][0])
            if size > PENDING and len(parts) > 1:
                parts = [_summed(parts)]
                size = len(parts[0][0]) // 2
    if parts:
        yield done()


def _tops(batches, depth: int):
    """What each bucket's sub-trees say about the nodes above: (context byte, choice, zeros, ones, log of weighted)."""
    for b in batches:
        for keys, counts in zip(b.column("keys"), b.column("counts"), strict=True):
            for near, choice, zeros, ones, below in ctw.tops(_decoded(keys.as_buffer()), np.frombuffer(counts.as_buffer(), dtype=np.int64), depth):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (near, choice, zeros, ones, below)], names=["near", "choice", "zeros", "ones", "below"])


def _answered(batches, n: int, depth: int, tables):
    """To each block's keys in a bucket, in order: the grams' log10 probabilities or the words' counts."""
    now, keys, values = None, None, None
    for b in batches:
        for bucket, block, own, counts in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), b.column("keys"), b.column("counts"), strict=True):
            k = _decoded(own.as_buffer())
            if block is None:
                now, keys = bucket, k
                c = np.frombuffer(counts.as_buffer(), dtype=np.int64)
                values = c if bucket >= n else ctw.log_probabilities(k, c, tables, depth)
                continue
            assert bucket == now
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([values[np.searchsorted(keys, k)].tobytes()], pa.binary())], names=["block", "bucket", "answer"])


def _scored(batches, n: int, depth: int, total: int, distinct: int, ends: int):
    """Documents' scores; a block's answers come first, in order of buckets."""
    log_z = np.log10(total + distinct + 1)
    for _, rows in _by_block(batches):
        rows = pa.Table.from_batches(rows)
        answers = rows.filter(pa.compute.is_valid(rows["answer"]))
        docs = rows.filter(pa.compute.is_null(rows["answer"])).combine_chunks()
        at, data = utf8(docs["text"])
        size = docs.num_rows
        result = {"score": np.zeros(size), "base": np.full(size, np.log10(ends + 1) - log_z), "tokens": np.ones(size, np.int64), "known": np.full(size, int(ends > 0))}
        got = dict(zip(answers["bucket"].to_pylist(), answers["answer"], strict=True))
        for word in (False, True):
            seen, keys = [], np.zeros(0, np.uint64)
            for lo, hi, k, of in (_words if word else _grams)(at, data, depth):
                x, where = np.unique(k, return_inverse=True)
                seen.append((lo, hi, x, where.astype(np.int32), np.bincount(of, minlength=hi - lo)))
                keys = np.union1d(keys, x)
            values = np.zeros(len(keys))
            of = _bucketed(keys, n, word, depth)
            order = np.argsort(of, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]])) if len(of) else np.zeros(0, np.int64)
            for lo, hi in zip(cut, [*cut[1:], len(of)], strict=True):
                values[order[lo:hi]] = np.frombuffer(got[int(of[order[lo]])].as_buffer(), dtype=np.int64 if word else np.float64)
            for lo, hi, x, where, each in seen:
                of = np.repeat(np.arange(hi - lo, dtype=np.int32), each)
                v = values[np.searchsorted(keys, x)]
                add = lambda weights: np.bincount(of, weights=weights, minlength=hi - lo)  # noqa: B023, E731
                if word:
                    result["base"][lo:hi] += add((np.log10(v + 1) - log_z)[where])
                    result["tokens"][lo:hi] += add(None)
                    result["known"][lo:hi] += add((v > 0)[where]).astype(np.int64)
                else:
                    result["score"][lo:hi] += add(v[where])
        yield pa.RecordBatch.from_arrays([docs["doc_id"].combine_chunks(), docs["held_out"].combine_chunks(), pa.array(result["tokens"]), pa.array(result["known"]), pa.array(np.full(size, total)), pa.array(result["base"]), pa.array(result["score"]), pa.array(np.diff(at))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])


def score(docs: DataFrame, held_out, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """Scores of all documents, learned from those for which the column held_out is not true.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability) and bits_per_byte.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be from 2 to 7")
    bounded(docs.sparkSession)
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_blocks = max(1, -(-n_docs // block), -(-n_bytes // BLOCK_BYTES))
    n = max(64, n_blocks)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))
    dealt = d.select("block", "held_out", "text").repartition("block").sortWithinPartitions("block")
    parts = written(dealt.mapInArrow(partial(_gathered, n=n, depth=depth), "block long, bucket int, keys binary, counts binary"), "grams")
    model = written(parts.select("bucket", "keys", "counts").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged, "bucket int, keys binary, counts binary, total long, distinct long"), "model")
    tops = model.where(F.col("bucket") < n).select("keys", "counts").mapInArrow(partial(_tops, depth=depth), "near long, choice long, zeros long, ones long, below double")
    tops = tops.groupBy("near", "choice").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    tables = ctw.above({(r.near, r.choice): (r.zeros, r.ones, r.below) for r in tops.collect()})  # 256 * 255 rows at most
    words = model.where(F.col("bucket") >= n).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct")).first()
    ends = d.where(~F.col("held_out")).count()
    asked = model.select("bucket", F.lit(None).cast("long").alias("block"), "keys", "counts").union(parts.select("bucket", "block", "keys", F.lit(None).cast("binary")))
    asked = asked.repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("block"))
    answers = written(asked.mapInArrow(partial(_answered, n=n, depth=depth, tables=tables), "block long, bucket int, answer binary"), "answers")
    none = lambda t: F.lit(None).cast(t)
    both = answers.select("block", "bucket", "answer", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("string").alias("text")).union(d.select("block", none("int"), none("binary"), "doc_id", "held_out", "text"))
    both = both.repartition("block").sortWithinPartitions("block", F.asc_nulls_last("bucket"))
    total, distinct = words.total + ends, words.distinct + (ends > 0)
    out = both.mapInArrow(partial(_scored, n=n, depth=depth, total=total, distinct=distinct, ends=ends), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.greatest(F.col("n_bytes") + 1, F.lit(1))
    return out.withColumn("bits_per_byte", bits).drop("n_bytes")
