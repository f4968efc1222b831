"""Structured Streaming form of the change feed: every event once, by an index of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from placeloom.sources.files import names_in

#: Ids of a folder of the target: a batch reads the ids of those folders only that it has ids in.
ID_RANGE = 100_000


def change_feed(spark: SparkSession, folder: str, schema: StructType, since: int) -> DataFrame:
    """The events of a folder after a cursor. A consumer's checkpoint is its cursor from then on."""
    return spark.readStream.schema(schema).parquet(folder).where(F.col("event_id") > since)


def id_range(ids: int = ID_RANGE) -> F.Column:
    return F.floor(F.col("event_id") / ids).cast("long")


def known_ids(batch: DataFrame, target: str, ids: int = ID_RANGE) -> DataFrame | None:
    """event_id of the events in `target` that could be in batch: only folders of ranges that it has ids in are read.

    Null if there are none. The ranges of a batch are one row each: as many as it has ids at most, and few for a feed.
    """
    spark = batch.sparkSession
    there = set(names_in(spark, target))
    wanted = [f"id_range={r.id_range}" for r in batch.select(id_range(ids).alias("id_range")).distinct().collect()]
    folders = [f"{target}/{name}" for name in wanted if name in there]
    return spark.read.schema("event_id long").parquet(*folders) if folders else None


def drain(stream: DataFrame, target: str, checkpoint: str, ids: int = ID_RANGE) -> None:
    """Append every event that is there now and not yet in the Parquet folder `target`, each id once, and stop.

    An event counts by its id alone, however old its time: late and backfilled ones come through, replays and
    a batch that is run again add nothing. The target lies in folders by ranges of `ids` ids, which are the index: a
    batch of new events reads the last folder, a late one those of its own ids.
    """

    def append(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["event_id"])
        known = known_ids(batch, target, ids)
        if known is not None:
            fresh = fresh.join(known, "event_id", "left_anti").select(*batch.columns)
        fresh.withColumn("id_range", id_range(ids)).write.mode("append").partitionBy("id_range").parquet(target)

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
