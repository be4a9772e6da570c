"""The shared folder, intermediate tables and column helpers of the operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared_root


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses; what is there when the driver ends goes."""
    path = f"{shared_root(spark)}/metasieve/{tag}-{uuid.uuid4().hex}"
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    return path


#: Rows of an Arrow batch of whole texts at most, and Spark's setting of it.
MOST_ROWS, _BATCH = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts_to_python(spark: SparkSession) -> None:
    """Sees that whole texts go to Python ``MOST_ROWS`` at a time at most: it lowers the session's setting.

    A worker and the JVM beside it hold a batch or two; Spark's own 10,000 rows
    would make that a hundred MB for each running task.
    """
    if not 0 < int(spark.conf.get(_BATCH, "10000")) <= MOST_ROWS:
        spark.conf.set(_BATCH, str(MOST_ROWS))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, which gives the worker's free memory back to the system at its end.

    Spark keeps workers for later tasks; what a task has freed would stay theirs.
    """

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


#: Spark's setting that deletes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The schema is given on reading, so an empty table is as good as any other.
    The shuffle files of this step go when it is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._metasieve_path = path
    return out


#: Rows of ids and other numbers that are broadcast at most.
MOST_BROADCAST = 1 << 20


def broadcast_if_small(table: DataFrame, most: int | None = None) -> DataFrame:
    """``table``, which must be a stored one, marked for broadcast if its counted rows are few; else a join shuffles it."""
    return F.broadcast(table) if table.count() <= (MOST_BROADCAST if most is None else most) else table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_metasieve_path", None)
        if path:
            files, at = _file_system(df.sparkSession, path)
            files.delete(at, True)


def fresh_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added until no column in ``taken`` has it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def id_bucket(col: str, modulus: int) -> Column:
    """CRC-32 of an id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(col).cast("string")) % modulus


def bounded_rows(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """``most`` rows at most, those with the least hashes of ``key``; rows with equal keys count once.

    The choice depends on nothing but the keys. A share of about twice as many
    is taken by hash first, so only that much is sorted.
    """
    n, hashed = rows.count(), fresh_name("hash_", rows.columns)
    rows = rows.withColumn(hashed, F.xxhash64(*key, F.lit("share")))
    if n > 2 * most:
        few = rows.filter(F.pmod(hashed, F.lit(1 << 30)) < int((2 * most + 100) / n * (1 << 30)))
        # rows with equal keys are one: where there are many, the share must be larger
        if few.select(hashed).distinct().count() >= most:
            rows = few
    return rows.dropDuplicates([hashed]).orderBy(F.pmod(hashed, F.lit(1 << 30)), hashed).limit(most).drop(hashed)
