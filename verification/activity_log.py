"""An event log projected from the ``events`` table: users and days as objects.

A user has many events and a day many users, so flattening on either shows
convergence and divergence. There are no sessions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ocelens.functions.attributes import attribute_map, float_value, string_value
from ocelens.model import ATTRS_TYPE, EventLog


def activity_log(spark: SparkSession, sf_dir: str, where: str = "true") -> EventLog:
    rows = (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .where(where)
        .selectExpr(
            "concat('EV-', event_id) AS event_id",
            "event_type",
            "ts",
            "value",
            "props",
            "concat('USR-', user_id) AS user_id",
            "concat('DAY-', date_format(ts, 'yyyyMMdd')) AS day",
        )
    )
    relations = rows.selectExpr(
        "event_id",
        "event_type",
        "ts",
        "CAST(NULL AS STRING) AS session_id",
        "inline(array(named_struct('object_id', user_id, 'object_type', 'User', 'qualifier', 'performed_by'), "
        "named_struct('object_id', day, 'object_type', 'Day', 'qualifier', 'concerns')))",
    )
    events = rows.select(
        "event_id",
        "event_type",
        "ts",
        attribute_map(value=float_value(F.col("value")), props=string_value(F.col("props"))).alias("attrs"),
    )
    objects = (
        relations.select("object_id", "object_type")
        .distinct()
        .withColumn("attrs", F.lit(None).cast(ATTRS_TYPE))
    )
    o2o = relations.selectExpr("object_id AS source_id", "object_id AS target_id", "qualifier").limit(0)
    return EventLog(events, objects, None, o2o, relations)
