"""The k-mer counter's binary file: a header (bits, k) and records of a 2-bit packed k-mer and a count, little-endian.

A k-mer of up to 32 symbols has 64 bits, one of up to 64 symbols 128 bits with the low word first. The first symbol is the
most significant; the symbol order is a, c, t, g. Reading is split into record-aligned byte ranges; a folder of such files
reads as one. Writing makes a file for each partition. Paths are of a file system that driver and executors share.
"""

from __future__ import annotations

import os
import struct
import uuid
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed value of the format: the symbol of each 2-bit code.
CODE = "actg"
RANGE, AT_ONCE = 64 << 20, 1 << 16


class DskError(ValueError):
    pass


def files(path: str) -> list[str]:
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if os.path.isdir(path):
        return sorted(str(p) for p in Path(path).iterdir() if p.is_file() and not p.name.startswith(("_", ".")))
    if not os.path.exists(path):
        raise DskError(f"no such file: {path}")
    return [path]


def header(path: str) -> tuple[int, int, int]:
    """Bits, k and the number of records; raises on what cannot be read."""
    with open(path, "rb") as f:
        head = f.read(8)
    if len(head) < 8:
        raise DskError(f"no header: {path}")
    bits, k = struct.unpack("<II", head)
    if bits not in (64, 128):
        raise DskError(f"k-mers of {bits} bits are not supported: {path}")
    if not 2 <= k <= bits // 2:
        raise DskError(f"k = {k} does not fit in {bits} bits: {path}")
    n = (os.path.getsize(path) - 8) // (bits // 8 + 4)
    if not n:
        raise DskError(f"no records: {path}")
    return bits, k, n


def decode(value: int, k: int) -> str:
    return "".join(CODE[value >> 2 * i & 3] for i in range(k - 1, -1, -1))


def encode(kmer: str) -> int:
    value = 0
    for c in kmer:
        value = value << 2 | CODE.index(c)
    return value


def _decoded(block: bytes, bits: int, k: int):
    """Records as an Arrow batch; symbols are looked up for all records at once."""
    import numpy as np
    import pyarrow as pa

    words = [(f"w{i}", "<u8") for i in range(bits // 64)]
    records = np.frombuffer(block, dtype=np.dtype([*words, ("count", "<u4")]))
    symbols, letters = np.empty((len(records), k), dtype=np.uint8), np.frombuffer(CODE.encode(), dtype=np.uint8)
    for i in range(k):
        at = 2 * (k - 1 - i)
        symbols[:, i] = letters[(records[f"w{at // 64}"] >> np.uint64(at % 64) & np.uint64(3)).astype(np.int64)]
    offsets = pa.array(np.arange(len(records) + 1, dtype=np.int32) * k)
    kmers = pa.StringArray.from_buffers(len(records), offsets.buffers()[1], pa.py_buffer(symbols.tobytes()))
    return pa.RecordBatch.from_arrays([kmers, pa.array(records["count"].astype(np.int64))], names=["kmer", "count"])


class _Range(InputPartition):
    def __init__(self, path: str, bits: int, k: int, first: int, n: int):
        self.path, self.bits, self.k, self.first, self.n = path, bits, k, first, n


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        out = []
        for p in files(self.path):
            bits, k, n = header(p)
            step = RANGE // (bits // 8 + 4)
            out += [_Range(p, bits, k, lo, min(step, n - lo)) for lo in range(0, n, step)]
        if not out:
            raise DskError(f"no files: {self.path}")
        return out

    def read(self, partition):
        size = partition.bits // 8 + 4
        with open(partition.path, "rb") as f:
            f.seek(8 + partition.first * size)
            left = partition.n
            while left:
                block = f.read(size * min(left, AT_ONCE))
                yield _decoded(block, partition.bits, partition.k)
                left -= len(block) // size


class _Done(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class _Writer(DataSourceWriter):
    def __init__(self, path: str, k: int, overwrite: bool):
        self.path, self.k, self.overwrite = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:"), k, overwrite
        if not 2 <= k <= 64:
            raise DskError("k must be from 2 to 64")

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        name, n = f".{uuid.uuid4().hex}", 0
        bits = 64 if self.k <= 32 else 128
        with open(os.path.join(self.path, name), "wb") as f:
            f.write(struct.pack("<II", bits, self.k))
            for row in iterator:
                if len(row[0]) != self.k:
                    raise DskError(f"not a {self.k}-mer: {row[0]}")
                value, count = encode(row[0]), row[1]
                if not 0 <= count < 2**32:
                    raise DskError(f"a count of {count} does not fit in 32 bits: {row[0]}")
                f.write(struct.pack("<QI", value, count) if bits == 64 else struct.pack("<QQI", value & 2**64 - 1, value >> 64, count))
                n += 1
        if not n:
            os.unlink(os.path.join(self.path, name))
        return _Done(name if n else None)

    def commit(self, messages):
        kept = {m.name for m in messages if m and m.name}
        old = [p for p in Path(self.path).iterdir() if self.overwrite and p.name.startswith("part-")]
        for i, name in enumerate(sorted(kept)):
            os.rename(os.path.join(self.path, name), os.path.join(self.path, f"part-{i:05d}-{name[1:]}.dsk"))
        for p in old:
            p.unlink()

    def abort(self, messages):
        for m in messages:
            if m and m.name:
                Path(self.path, m.name).unlink(missing_ok=True)


class DskSource(DataSource):
    """spark.read.format("dsk").load(path); df.select("kmer", "count").write.format("dsk").option("k", k).save(path)."""

    @classmethod
    def name(cls):
        return "dsk"

    def schema(self):
        return "kmer string, count long"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options["k"]), overwrite)
