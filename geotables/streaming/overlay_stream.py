"""Streaming jobs.

Range queries, WKT parsing, cells and the per-pair overlap area are row-local, so they apply to a streaming
DataFrame as they are. The overlay arg-max groups by parcel; parcels arrive once, so each micro-batch is overlaid
against the (static) zone table, which is prepared once before the stream starts, in ``foreachBatch`` and written under its own epoch directory. A replayed epoch
overwrites its own directory, which keeps the sink exactly-once after a failure.

Zones may come as a stream, too (``start_zone_stream``): every micro-batch of zones leaves the contenders of the parcels it
overlaps under its epoch, and ``running_classes`` decides among the contenders of all epochs so far. However the zones are split
over epochs, and if epochs are replayed, the result is that of all zones at once. ``compact_epochs`` merges the epochs written so
far into one, so that reading does not grow with their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geotables.operators.overlay import best_of_contenders, classes_of, contenders, parcel_side, zone_side
from geotables.operators.range_query import range_query


def stream_range_query(stream: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    return range_query(stream, xmin, ymin, xmax, ymax)


def _spread(batch: DataFrame) -> DataFrame:
    """A micro-batch over all cores: it comes in no more partitions than it has files."""
    return batch.repartition(batch.sparkSession.sparkContext.defaultParallelism)


def start_overlay_stream(parcels: DataFrame, zones: DataFrame, sink_path: str, checkpoint: str,
                         tag_name: str = "PDJB", available_now: bool = True) -> StreamingQuery:
    """Overlay each micro-batch of parcels against ``zones``; results go to ``sink_path/epoch=<n>``."""
    prepared = zone_side(zones, tag_name)

    def batch(df: DataFrame, epoch_id: int) -> None:
        classes_of(parcel_side(_spread(df)), prepared).write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch_id}")

    w = parcels.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


CONTENDERS = ("key STRING, oid STRING, pd_class STRING, overlap_area DOUBLE, zone_key STRING, tolerance DOUBLE, epoch BIGINT")


def start_zone_stream(zones: DataFrame, parcels: DataFrame, sink_path: str, checkpoint: str, tag_name: str = "PDJB",
                      available_now: bool = True) -> StreamingQuery:
    """Overlay each micro-batch of zones with ``parcels``, which are prepared once; the contenders go to
    ``sink_path/epoch=<n>``."""
    prepared = parcel_side(parcels)

    def batch(df: DataFrame, epoch_id: int) -> None:
        contenders(prepared, zone_side(_spread(df), tag_name)).write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch_id}")

    w = zones.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def running_classes(spark: SparkSession, sink_path: str, parcels: DataFrame) -> DataFrame:
    """(oid, pd_class, overlap_area) for every parcel by all zones that have come so far."""
    rows = spark.read.schema(CONTENDERS).parquet(sink_path).drop("epoch")
    return best_of_contenders(rows, parcels.selectExpr("key AS p_key", "oid AS p_oid")).select("oid", "pd_class", "overlap_area")


def compact_epochs(spark: SparkSession, sink_path: str, into: str) -> None:
    """The contenders of all epochs under ``sink_path`` that still are, as one epoch under ``into`` with the number of the last
    one. Later epochs may be written there; the old folder stays as it is."""
    rows = spark.read.schema(CONTENDERS).parquet(sink_path)
    last = rows.agg(F.max("epoch")).first()[0]
    if last is None:
        return
    rows = rows.drop("epoch").distinct().repartition("key")
    top = rows.groupBy("key").agg(F.max("overlap_area").alias("_top"))
    rows.join(top, "key").where("overlap_area >= _top - tolerance").drop("_top").write.mode("overwrite").parquet(
        f"{into}/epoch={last}")
