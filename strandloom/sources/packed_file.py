"""The packed graph file: 64-bit words of twelve 5-bit edges, five running symbol counts, then k, all little-endian.

Writing takes (block_no, word) rows, sorted in range partitions; each partition writes its words at their own place in one
file, so parts need no merging. The footer comes as options. Reading is split into ranges of words.
"""

from __future__ import annotations

import os
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed value of the format: words after the last edge word.
FOOTER_WORDS = 6
RANGE, AT_ONCE = 1 << 22, 1 << 16


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def footer(path: str) -> tuple[list[int], int]:
    """The running counts of the five symbols, and k."""
    path = _local(path)
    size = os.path.getsize(path)
    if size < 8 * FOOTER_WORDS or size % 8:
        raise ValueError(f"not a packed graph: {path}")
    with open(path, "rb") as f:
        f.seek(size - 8 * FOOTER_WORDS)
        *counts, k = struct.unpack(f"<{FOOTER_WORDS}Q", f.read())
    return counts, k


class _Range(InputPartition):
    def __init__(self, first: int, n: int):
        self.first, self.n = first, n


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = _local(path)
        footer(self.path)

    def partitions(self):
        n = os.path.getsize(self.path) // 8 - FOOTER_WORDS
        return [_Range(lo, min(RANGE, n - lo)) for lo in range(0, n, RANGE)] or [_Range(0, 0)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        with open(self.path, "rb") as f:
            f.seek(8 * partition.first)
            for lo in range(0, partition.n, AT_ONCE):
                words = np.frombuffer(f.read(8 * min(AT_ONCE, partition.n - lo)), dtype="<i8")
                first = partition.first + lo
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(words))), pa.array(words)], names=["block_no", "word"])


class _Done(WriterCommitMessage):
    pass


class _Writer(DataSourceWriter):
    """Words go to their own places in a hidden file beside the target, which takes its name only when all are there."""

    def __init__(self, path: str, size: int, tail: bytes):
        self.path, self.size, self.tail = _local(path), size, tail
        folder, name = os.path.split(self.path)
        self.made = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
        os.makedirs(folder or ".", exist_ok=True)
        with open(self.made, "wb") as f:
            f.truncate(size)

    def write(self, iterator):
        with open(self.made, "r+b") as f:
            for block, word in iterator:
                f.seek(8 * block)
                f.write(struct.pack("<q", word))
        return _Done()

    def commit(self, messages):
        with open(self.made, "r+b") as f:
            f.truncate(self.size)
            f.seek(self.size)
            f.write(self.tail)
        os.replace(self.made, self.path)

    def abort(self, messages):
        if os.path.exists(self.made):
            os.unlink(self.made)


class PackedGraphSource(DataSource):
    @classmethod
    def name(cls):
        return "packed_graph"

    def schema(self):
        return "block_no long, word long"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        if "bytes" in self.options:
            return _Writer(self.options["path"], int(self.options["bytes"]), b"")
        counts = [int(x) for x in self.options["counts"].split(",")]
        return _Writer(self.options["path"], 8 * -(-counts[-1] // 12), struct.pack(f"<{FOOTER_WORDS}Q", *counts, int(self.options["k"])))


def write_packed(graph, path: str) -> None:
    """A graph's packed file."""
    from ..operators import packed

    counts = [r.running for r in packed.f_table(graph.edges).orderBy("f").collect()]  # five rows
    words = packed.words(graph.edges).repartitionByRange("block_no").sortWithinPartitions("block_no").select("block_no", "word")
    words.write.format("packed_graph").option("counts", ",".join(map(str, counts))).option("k", graph.k).mode("append").save(path)


def write_lcs(graph, path: str) -> None:
    """A graph's common suffix lengths, one byte an edge."""
    from ..operators import packed

    if graph.k > 256:
        raise ValueError("common suffixes of k over 256 don't fit in a byte")
    n = graph.edges.count()
    words = packed.lcs_words(graph.edges).repartitionByRange("block_no").sortWithinPartitions("block_no").select("block_no", "word")
    words.write.format("packed_graph").option("bytes", n).mode("append").save(path)


def read_packed(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(pos, w, node_first, end_first) of a packed file, and k."""
    from ..operators import packed

    counts, k = footer(path)
    return packed.unpack(spark.read.format("packed_graph").load(path), counts[-1]), k
