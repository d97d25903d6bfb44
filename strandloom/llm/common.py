"""What several operators of this package share: the shared folder, written tables, Arrow text buffers."""

from __future__ import annotations

import ctypes
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import forget, shared_folder  # noqa: F401

#: ASCII upper case to lower case, and nothing else.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: True at the six bytes that separate words: space and 0x09-0x0D.
IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def bounded(spark: SparkSession) -> None:
    """Arrow batches of texts go by bytes, so that a batch of long texts needs no more memory than one of short texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Seconds between two times that the driver gives memory back.
RELEASE_S = 15
_last = [0.0]


def _trimmed(spark: SparkSession) -> str:
    """Have the driver's JVM give back what malloc keeps of freed memory; what it says, or nothing if it has no such command (before Java 17.0.9, or not on glibc)."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        named, kinds = jvm.java.lang.Class.forName, array(jvm.java.lang.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        # by the interface's method, as the server's own class isn't open to reflection
        return str(named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args))
    except Exception:
        return ""


def released(spark: SparkSession) -> None:
    """Give back memory that the driver has freed but holds, at most every RELEASE_S seconds.

    Hundreds of small jobs leave little alive (some 100 MB), yet the heap's free part and what malloc keeps of the JVM's compilers, of Arrow and of numpy
    only grow. Spark's own cleaner asks for a collection every half hour.
    """
    if time.monotonic() - _last[0] < RELEASE_S:
        return
    spark._jvm.java.lang.System.gc()
    _trimmed(spark)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass
    _last[0] = time.monotonic()


def written(df: DataFrame, name: str = "table", dictionary: bool = True) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and fixes what was not deterministic.

    The shuffle files behind the table are of no more use and go at once, and the driver gives back what it has freed (see released). Without dictionary, for columns whose values seldom repeat.
    """
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_folder(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    released(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def free_name(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a bit table, as a power of two; a row has 64 bits.
TABLE = 17


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - TABLE).cast("int")


def _asked(df: DataFrame, h: Column, hashes: DataFrame, how: str) -> tuple[DataFrame, Column]:
    word, bits, at = (free_name(df, x) for x in ("bits_word", "bits", "bits_at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    table = hashes.select(_word(F.col("h")).alias(word), bit.alias("bit")).groupBy(word).agg(F.bit_or("bit").alias(bits))
    asked = df.withColumn(word, _word(h)).withColumn(at, h.bitwiseAND(F.lit(63)).cast("int"))
    return asked.join(F.broadcast(table), word, how), F.call_function("shiftright", F.col(bits), F.col(at)).bitwiseAND(F.lit(1)) == 1


def perhaps_in(df: DataFrame, h: Column, hashes: DataFrame) -> DataFrame:
    """The rows of df whose 64-bit hash h is among those in column h of hashes, and a few others: a join with a bit table of at most 2^17 rows (2 MB)."""
    found, there = _asked(df, h, hashes, "inner")
    return found.where(there).select(*df.columns)


def marked_in(df: DataFrame, h: Column, hashes: DataFrame, name: str) -> DataFrame:
    """df with a column of this name that is false only where the hash h isn't among those of hashes (see perhaps_in)."""
    found, there = _asked(df, h, hashes, "left")
    return found.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(there, F.lit(False)).alias(name))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string or binary column without copying; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and offsets.size else np.zeros(1, np.int64)
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, limit: int):
    """Ranges of rows holding about `limit` bytes each; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of this schema; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)
