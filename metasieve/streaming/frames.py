"""Streams of records. A filter keeps no state, so the batch column serves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.filtering import apply_filter
from ..operators.layouts import Layout
from ..operators.validation import free_name, split_valid
from ..plans.filters import MetadataFilter
from ..plans.schema import MetadataSchema


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_a_batch: int = 1000) -> DataFrame:
    """Parquet files under ``path`` as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def filter_stream(stream: DataFrame, f: MetadataFilter, layout: Layout | None = None) -> DataFrame:
    return apply_filter(stream, f, layout)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that is there now to Parquet, then stops; ``checkpoint`` lets the next call go on from here."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_split(stream: DataFrame, schema: MetadataSchema, good_path: str, bad_path: str, checkpoint: str, layout: Layout | None = None) -> None:
    """Valid records to one folder, the others with their errors to another, batch by batch.

    A batch has a folder of its own, ``batch_id=...`` (read back as a column;
    with underscores in front where the records have that name), which is
    written anew when the batch is: one that is repeated leaves no row twice.
    """

    def both(batch: DataFrame, batch_id: int) -> None:
        folder = f"{free_name('batch_id', batch.columns)}={batch_id}"
        batch = batch.persist()  # read once for both
        try:
            for rows, path in zip(split_valid(batch, schema, layout), (good_path, bad_path), strict=True):
                rows.write.mode("overwrite").parquet(f"{path}/{folder}")
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
