"""Binary sources and sinks as Python data sources: `dsk` and `packed_graph`."""

from pyspark.sql import SparkSession

from .dsk import DskSource
from .packed_file import PackedGraphSource


def register(spark: SparkSession) -> None:
    for source in (DskSource, PackedGraphSource):
        spark.dataSource.register(source)
