"""Patterns that arrive while a scan is being taken.

Operators on single patterns are stateless, so they work on a stream as they do on a table. Here are those that need more:
indexing against a fixed dictionary, and running statistics of a scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanloom.operators.indexing import SimilarityMetric, dictionary_indexing


def read_patterns(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 100) -> DataFrame:
    """A stream of the Parquet files that are put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def index_stream(patterns: DataFrame, dictionary: DataFrame, n_pixels: int, metric: str | SimilarityMetric = "ncc", keep_n: int = 20) -> DataFrame:
    """Matches for each pattern of a stream. The dictionary is a table; it is prepared once, when the query is defined."""
    return dictionary_indexing(patterns, dictionary, n_pixels, metric, keep_n)


def quality_by_window(patterns: DataFrame, quality: Callable[[DataFrame], DataFrame], ts: str = "ts", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Count, mean and least quality (column ``iq``) of the patterns of each time window; a window closes ``late`` after
    its end has been seen, and its state is dropped."""
    scored = quality(patterns.withWatermark(ts, late))
    by = scored.groupBy(F.window(ts, window).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.avg("iq").alias("mean_iq"), F.min("iq").alias("least_iq")).select("w.start", "w.end", "n", "mean_iq", "least_iq")


def write_patterns(patterns: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Append a stream to Parquet, each row once. available_now: take what is there, then end."""
    out = patterns.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
