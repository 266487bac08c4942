"""Running a stream into a table whose batches can be written again without harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def parquet_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1_000) -> DataFrame:
    """New parquet files at or below ``path``, oldest first. ``path`` may be a single file.

    A stream takes a plain path for a folder, so the last letter is made a pattern that matches only itself.
    """
    path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def batch_path(table: str, number: int) -> str:
    return f"{table}/batch={number}"


def prepare(spark: SparkSession, table: str, schema: str) -> None:
    """Give the table an empty batch -1, so it can be read before anything has arrived."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(batch_path(table, -1))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder nothing will read again; one that is not there is no matter."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folders(spark: SparkSession, table: str, *names: str) -> list[tuple[int, ...]]:
    """The numbers of the folders ``name=number/name=number`` below the table that hold files."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path("/".join([table, *(f"{n}=*" for n in names), "part-*"]))
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    paths = {f.getPath().getParent().toString() for f in found}
    return sorted(tuple(int(part.split("=")[1]) for part in path.split("/")[-len(names):]) for path in paths)


def written(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """All batches of the table, with the number of each in ``batch``."""
    return spark.read.schema(f"{schema}, batch long").parquet(table)


def run_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything available, batch by batch. ``write`` gets the rows and the batch number."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def batch_writer(table: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to its own folder, replacing what an earlier try of the same batch left there."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(batch_path(table, number))

    return write
