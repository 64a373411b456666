"""Streams run to the end of what is there, their results written as a table by each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinograph.sources.scratch import scratch


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with an event time."""
    path = f"{sf_dir}/events.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        rows = reader.parquet(path)
    else:  # a stream watches folders
        rows = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", rows["ts"].cast("timestamp")).where("ts IS NOT NULL AND user_id IS NOT NULL")


def drain(stream: DataFrame, label: str, mode: str, home: str | None = None) -> DataFrame:
    """Run ``stream`` over all that is there; the table that its batches wrote.

    A batch writes a folder of its own number, over what an earlier attempt left there, so that a restart
    repeats no rows; in complete mode the last batch is the result. With a ``home``, a folder of the caller's, a later call takes
    up where the last one ended, and gives what all calls wrote; without one nothing is taken up.
    """
    spark = stream.sparkSession
    home, last = home or scratch(spark, label), {}
    out, log = f"{home}/rows", f"{home}/log"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last["number"] = number

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        folders = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*")
        found = folders.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folders)
        numbers = [int(f.getPath().getName().removeprefix("batch=")) for f in found or []]
        if not numbers:
            return spark.createDataFrame([], stream.schema)
        last["number"] = max(numbers)
    path = f"{out}/batch={last['number']}" if mode == "complete" else f"{out}/batch=*"
    return spark.read.schema(stream.schema).parquet(path)
