"""The event log as stored tables, laid out for the scans the operators do.

Events and relations are partitioned by event type and objects by object type, so an
operator that names a type reads only its partitions; relations are stored denormalised,
so rules need no join to learn types, times or sessions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ocelens.model import EventLog


def write_log(log: EventLog, path: str, mode: str = "errorifexists") -> None:
    log.events.write.mode(mode).partitionBy("event_type").parquet(f"{path}/events")
    log.objects.write.mode(mode).partitionBy("object_type").parquet(f"{path}/objects")
    log.relations.write.mode(mode).partitionBy("event_type").parquet(f"{path}/relations")
    log.o2o.write.mode(mode).parquet(f"{path}/o2o")


def read_log(spark: SparkSession, path: str) -> EventLog:
    def table(name: str):
        return spark.read.parquet(f"{path}/{name}")

    events = table("events").select("event_id", "event_type", "ts", "attrs")
    objects = table("objects").select("object_id", "object_type", "attrs")
    return EventLog(events, objects, None, table("o2o"), table("relations"))
