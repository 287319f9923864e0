"""Incremental and stateful processing with Structured Streaming.

Streams run with ``availableNow``: everything there is, in micro-batches. Offsets,
state and results lie in one folder, which the caller names; a run that is
interrupted goes on there where it stopped, and one that is started again reads
only what is new. Without a name a run has a new folder in the shared checkpoint
folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from graphloom.session import ensure_checkpoint_dir


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for one run in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{name}-{uuid.uuid4().hex[:12]}"


def read_table(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """The Parquet table ``name`` as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(f"{sf_dir}/{name}*")


def run_batches(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The finished versions of a table of versions, in order."""
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.partition("=")[2]) for n in found if n.startswith("version=") and fs.exists(jvm.Path(f"{folder}/{n}/_SUCCESS")))


def current(spark: SparkSession, folder: str, schema: StructType, below: int | None = None) -> DataFrame | None:
    """The rows of the newest finished version of each bucket, with the bucket."""
    done = [v for v in versions(spark, folder) if below is None or v < below]
    if not done:
        return None
    full = StructType([*schema.fields, StructField("version", IntegerType()), StructField("bucket", IntegerType())])
    rows = spark.read.schema(full).option("basePath", folder).parquet(*(f"{folder}/version={v}" for v in done))
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi").drop("version")


def upsert_stream(stream: DataFrame, key: str, order: list[str], name: str, *, folder: str | None = None, buckets: int = 64) -> DataFrame:
    """The last row of each key after all batches.

    Rows lie in buckets by key. A batch writes a new version of the buckets that it
    touches and leaves the others; a batch that is repeated after a failure replaces
    its own version. Of the driver's memory only the numbers of buckets are used.
    """
    spark = stream.sparkSession
    folder = folder or workspace(spark, name)
    data = f"{folder}/data"

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        old = current(spark, data, stream.schema, below=number)
        if old is not None:
            rows = rows.unionByName(old.where(F.col("bucket").isin(touched)))
        w = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
        rows = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{data}/version={number}")

    run_batches(stream, folder, merge)
    out = current(spark, data, stream.schema)
    return spark.createDataFrame([], stream.schema) if out is None else out.drop("bucket")


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, keys: list[str], name: str, folder: str | None = None) -> DataFrame:
    """Counts by tumbling window; rows later than ``late`` behind the watermark are dropped by the stream."""
    spark = stream.sparkSession
    folder = folder or workspace(spark, name)
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need an instant
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n").write.mode("overwrite").parquet(f"{folder}/result")

    run_batches(counts, folder, write, "complete")
    return spark.read.parquet(f"{folder}/result")


def last_n(stream: DataFrame, key: str, value: str, order: str, n: int, name: str, folder: str | None = None) -> DataFrame:
    """(key, value, order) of the last n rows of each key, kept as state from batch to batch."""
    spark = stream.sparkSession
    folder = folder or workspace(spark, name)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = f"`{key}` {kinds[key]}, `{value}` {kinds[value]}, at long, version long"

    def keep(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        values, times, version = state.get if state.exists else ([], [], 0)
        rows = list(zip(times, values))
        for frame in frames:
            rows += list(zip((int(x) for x in frame["at"]), (int(x) for x in frame[value])))
        rows = sorted(rows)[-n:]
        version += 1
        state.update(([v for _, v in rows], [t for t, _ in rows], version))
        yield pd.DataFrame({key: [group[0]] * len(rows), value: [v for _, v in rows], "at": [t for t, _ in rows], "version": version})

    timed = stream.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value, F.unix_micros(F.col(order).cast("timestamp")).alias("at"))
    held = timed.groupBy(key).applyInPandasWithState(keep, out, f"v array<long>, t array<long>, version long", "update", "NoTimeout")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{folder}/result")

    run_batches(held, folder, write, "update")
    rows = spark.read.parquet(f"{folder}/result")
    newest = rows.groupBy(key).agg(F.max("version").alias("version"))
    return rows.join(newest, [key, "version"]).select(key, value, "at")


def skip_done(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a finished status, for runs that resume."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def apply_changes(nodes: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """The nodes after a change set (file_path, status: A, M, D or R): those of touched files are purged, fresh ones added."""
    touched = changes.select("file_path").distinct()
    alive = changes.where("status <> 'D'").select("file_path").distinct()
    return nodes.join(touched, "file_path", "left_anti").unionByName(fresh.join(alive, "file_path", "left_semi").select(*nodes.columns))


def every(stream: DataFrame, folder: str, seconds: int, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """A query that looks for new rows every so many seconds, until it is stopped; it goes on where it stopped."""
    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=f"{seconds} seconds").start()
    )
