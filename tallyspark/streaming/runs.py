"""Run files and new texts as they arrive.

The queries of the batch side have no event time, so nothing here needs a watermark: aggregates are restated as a
whole, and what is new is told from what is known by key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyspark.operators.coverage import missing
from tallyspark.operators.summaries import summary


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they appear below the folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def live_summary(runs: DataFrame, by: Sequence[str], name: str, checkpoint: str) -> StreamingQuery:
    """The grouped summary of all runs so far, restated at each trigger in the in-memory table `name`.

    The median needs all values of a group, so state grows with the input; for unbounded streams group by what ends."""
    return summary(runs, by).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def only_new(rows: DataFrame, cache: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "cache_key") -> StreamingQuery:
    """Computes what the Parquet cache lacks, by key, and appends it.  A batch that is run again finds its keys there, so no key is computed into the cache twice."""

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(cache)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        todo = batch.dropDuplicates([key])
        compute(todo if known is None else missing(todo, known, key)).write.mode("append").parquet(cache)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
