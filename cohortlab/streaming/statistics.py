"""Statistical files read a few at a time, with the same filters and means as the whole-source scan.

The running state is one row per (year, region): both candidate means of the measure choice. The
choice itself is made when the table is read, over everything seen so far.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cohortlab.operators.measure import candidate_means, choose_measure
from cohortlab.sources.settings import BIRTH_REGIONS, INDICATORS
from cohortlab.sources.statistics import KEYS, harmonised_rows


def stream_statistics(
    spark: SparkSession, folder: str, schema: str, indicator: str, out: str, state: str, files_per_batch: int = 100,
    mapping: Mapping[str, str] = BIRTH_REGIONS, sep: str = ",", encoding: str = "ISO-8859-1",
) -> StreamingQuery:
    """Take in every file of ``folder`` not seen before and stop; ``out`` then holds the group table.

    ``state`` is the shared folder of the stream's progress: a restart goes on where it stopped.
    """
    name, preferred, fallback = INDICATORS[indicator]
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).csv(
        folder, header=True, sep=sep, encoding=encoding)
    rows, _, ordinary = harmonised_rows(raw, indicator, mapping)
    groups = candidate_means(rows, KEYS, name, "observations", preferred, fallback, ordinary)

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = groups.writeStream.outputMode("complete").foreachBatch(store)
    return writer.option("checkpointLocation", state).trigger(availableNow=True).start()


def read_statistics(spark: SparkSession, out: str, indicator: str) -> DataFrame:
    """(year, region, value) over everything the stream has taken in."""
    return choose_measure(spark.read.parquet(out), KEYS, INDICATORS[indicator][0])
