"""The event-log model: four relations plus one denormalised view.

    events    (event_id, event_type, ts TIMESTAMP, attrs MAP<STRING, VALUE>)
    objects   (object_id, object_type, attrs MAP<STRING, VALUE>)
    e2o       (event_id, object_id, qualifier)
    o2o       (source_id, target_id, qualifier)
    relations (event_id, event_type, ts, session_id, object_id, object_type, qualifier)

VALUE is STRUCT<kind, text>: the kind keeps values type-strict (true, 1 and 1.0
differ) and the text is the value's one canonical spelling, so values can be
compared, grouped and hashed, which VARIANT cannot.

``relations`` is what nearly every operator scans. A source that knows the types
and the session of each edge supplies it; otherwise it is derived once by joins.
Stored logs keep it partitioned by event type (see ``sources.tables``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocelens.session import materialise

VALUE_TYPE = "struct<kind:string,text:string>"
ATTRS_TYPE = f"map<string,{VALUE_TYPE}>"

EVENTS_SCHEMA = f"event_id string, event_type string, ts timestamp, attrs {ATTRS_TYPE}"
OBJECTS_SCHEMA = f"object_id string, object_type string, attrs {ATTRS_TYPE}"
E2O_SCHEMA = "event_id string, object_id string, qualifier string"
O2O_SCHEMA = "source_id string, target_id string, qualifier string"
VIOLATION_COLUMNS = (
    "constraint_id",
    "ocel_event_ids",
    "ocel_object_ids",
    "session_id",
    "severity",
    "detail",
)
VIOLATIONS_SCHEMA = (
    "constraint_id string, ocel_event_ids array<string>, ocel_object_ids array<string>, "
    "session_id string, severity string, detail string"
)
FINDINGS_SCHEMA = "check_id string, key string, detail string"


def session_of_event(e2o_typed: DataFrame) -> DataFrame:
    """The session an event is ``within``: the first Session object by id."""
    return (
        e2o_typed.where("qualifier = 'within' AND object_type = 'Session'")
        .groupBy("event_id")
        .agg(F.min("object_id").alias("session_id"))
    )


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Partitioned:
    """A table kept as one DataFrame per type, so naming a type builds and reads only that part."""

    def __init__(self, column: str, parts: Mapping[str, Callable[[], DataFrame]]) -> None:
        self.column = column
        self._makers = dict(parts)
        self._made: dict[str, DataFrame] = {}

    def _part(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def all(self) -> DataFrame:
        return _union(self._part(name) for name in self._makers)

    def only(self, *types: str) -> DataFrame:
        chosen = [self._part(t) for t in types if t in self._makers]
        return _union(chosen) if chosen else self._part(next(iter(self._makers))).limit(0)


class Whole:
    """A table kept as one DataFrame; naming a type filters it (a partition filter on disk)."""

    def __init__(self, column: str, df: DataFrame) -> None:
        self.column = column
        self.df = df

    def all(self) -> DataFrame:
        return self.df

    def only(self, *types: str) -> DataFrame:
        return self.df.where(F.col(self.column).isin(list(types)))


def _table(column: str, table: DataFrame | Partitioned | Whole) -> Partitioned | Whole:
    return Whole(column, table) if isinstance(table, DataFrame) else table


class EventLog:
    """One log as DataFrames; nothing is sorted, validated or even planned on construction."""

    def __init__(
        self,
        events: DataFrame | Partitioned,
        objects: DataFrame | Partitioned,
        e2o: DataFrame | None,
        o2o: DataFrame | Callable[[], DataFrame],
        relations: DataFrame | Partitioned | None = None,
        touches: Callable[[], DataFrame] | None = None,
    ) -> None:
        if e2o is None and relations is None:
            raise ValueError("an event log needs e2o edges or the relations view")
        self._events = _table("event_type", events)
        self._objects = _table("object_type", objects)
        self._e2o = e2o
        self._o2o = o2o
        self._relations = None if relations is None else _table("event_type", relations)
        self._touches = touches
        self._from_relations = e2o is None

    @property
    def spark(self) -> SparkSession:
        return SparkSession.active()

    @property
    def e2o(self) -> DataFrame:
        if self._e2o is None:
            self._e2o = self.relations.select("event_id", "object_id", "qualifier")
        return self._e2o

    @property
    def o2o(self) -> DataFrame:
        if not isinstance(self._o2o, DataFrame):
            self._o2o = self._o2o()
        return self._o2o

    @property
    def events(self) -> DataFrame:
        return self._events.all()

    @property
    def objects(self) -> DataFrame:
        return self._objects.all()

    @property
    def has_relations(self) -> bool:
        """Whether the relations view is the log's own table and its e2o edges follow from it."""
        return self._from_relations

    @property
    def relations(self) -> DataFrame:
        """Every event-object edge with both types, the timestamp and the session."""
        return self._relation_table().all()

    @property
    def touches(self) -> DataFrame:
        """(object_type, object_id, first_ts, last_ts, events): edges of an object, folded where a source meets
        several together; else each edge is a row."""
        if self._touches is not None:
            return self._touches()
        return self.relations.select(
            "object_type", "object_id", F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), F.lit(1).cast("long").alias("events")
        )

    def events_of(self, *event_types: str) -> DataFrame:
        return self._events.only(*event_types)

    def objects_of(self, *object_types: str) -> DataFrame:
        return self._objects.only(*object_types)

    def relations_of(self, *event_types: str) -> DataFrame:
        return self._relation_table().only(*event_types)

    def _relation_table(self) -> Partitioned | Whole:
        if self._relations is None:
            typed = self.e2o.join(
                self.objects.select("object_id", "object_type"), "object_id"
            ).join(self.events.select("event_id", "event_type", "ts"), "event_id")
            self._relations = Whole(
                "event_type",
                typed.join(session_of_event(typed), "event_id", "left").select(
                    "event_id",
                    "event_type",
                    "ts",
                    "session_id",
                    "object_id",
                    "object_type",
                    "qualifier",
                ),
            )
        return self._relations

    def stored(self) -> EventLog:
        """The log written once to the shared folder, for a run that reads it many times."""
        return EventLog(
            materialise(self.events, "zstd"),
            materialise(self.objects, "zstd"),
            None,
            materialise(self.o2o, "zstd"),
            materialise(self.relations, "zstd"),
        )


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
