import gc
import time

from strandloom.llm import common


def test_written_gives_driver_memory_back(spark, monkeypatch):
    """What the driver has freed goes when a table is written, not only when its heap is full."""
    monkeypatch.setattr(common, "_last", [time.monotonic() - 3600])
    jvm = spark._jvm
    block = jvm.java.nio.ByteBuffer.allocate(64 << 20)
    ref = jvm.java.lang.ref.WeakReference(block)
    del block
    gc.collect()
    time.sleep(1)  # Python's hold on it goes in a thread
    assert common.written(spark.range(10)).count() == 10
    assert ref.get() is None


def test_not_at_every_table(spark, monkeypatch):
    monkeypatch.setattr(common, "_last", [time.monotonic() - 3600])
    seen = []
    monkeypatch.setattr(common, "_trimmed", seen.append)
    for _ in range(3):
        common.released(spark)
    assert len(seen) == 1


def test_trims_what_malloc_keeps(spark):
    java = str(spark._jvm.java.lang.System.getProperty("java.version")).split(".")
    if (int(java[0]), int(java[2].split("_")[0]) if len(java) > 2 else 0) >= (17, 9):
        assert "rim" in common._trimmed(spark)
    else:
        assert common._trimmed(spark) == ""
