"""Change detection as a stream: file sightings arrive, each micro-batch publishes what is new or changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.incremental import VersionedTarget, latest_sighting

SCANS = T.StructType([
    T.StructField("scan_id", T.LongType()), T.StructField("run_id", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("modified_at", T.LongType()),
    T.StructField("file_hash", T.BinaryType()), T.StructField("size_bytes", T.LongType()), T.StructField("scanned_at", T.TimestampNTZType()), T.StructField("loaded_at", T.TimestampNTZType()),
])


def refresh_stream(spark: SparkSession, folder: str, target: VersionedTarget, checkpoint: str, schema: T.StructType = SCANS):
    """Start a stream over the Parquet files of a folder. A run is the query's id, which its checkpoint keeps, and the epoch: a
    batch repeated after a failure finds its run published and adds nothing, and a new checkpoint on an old target,
    or one that batch runs fill too, doesn't take up the runs of others."""
    scans = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)

    def process(batch: DataFrame, epoch: int) -> None:
        seen = latest_sighting(batch.where(F.col("path").isNotNull()), target.keys, target.version, ["scanned_at", "scan_id"])
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query:
            raise RuntimeError("the micro-batch doesn't tell the id of its query")
        target.publish(epoch, target.pending(seen), source=f"stream {query}")

    return scans.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_per_window(scans: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sightings and distinct files per window of scanned_at; rows later than `late` are dropped by the watermark when streamed."""
    timed = scans.withColumn("at", F.col("scanned_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window)).agg(F.count(F.lit(1)).alias("n_scans"), F.approx_count_distinct("path").alias("n_paths"))
