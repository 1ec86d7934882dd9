"""OCEL 2.0 JSON and XML documents: typed decoding by registry, and ordered export.

A document is one file and is parsed by one task, as the formats demand; many documents
parse in parallel. Export never gathers a log: it yields the document's lines in order,
so the written parts, concatenated, are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ocelens.functions.attributes import (
    BOOLEAN,
    FLOAT,
    INTEGER,
    STRING,
    STRING_LIST,
    float_text,
    variant_value,
)
from ocelens.functions.canonical import json_list, json_object, json_string, utc_text
from ocelens.functions.ordering import with_rank
from ocelens.model import EventLog
from ocelens.operators.findings import finding, union
from ocelens.session import materialise
from ocelens.vocabulary import CREDIT, Vocabulary

# How the standard spells attribute kinds, and its "unchanging" timestamp.
KIND_TO_TYPE = {
    "string": "string",
    "boolean": "boolean",
    "integer": "integer",
    "float": "float",
    "string_list": "string",
}
STATIC_TIME = "1970-01-01T00:00:00Z"
MAX_EXACT = 2**53 - 1

_REFS = "array<struct<objectId:string,qualifier:string>>"
JSON_SCHEMA = (
    "events array<struct<id:string,type:string,time:string,"
    f"attributes:array<struct<name:string,value:variant>>,relationships:{_REFS}>>, "
    "objects array<struct<id:string,type:string,"
    f"attributes:array<struct<name:string,time:string,value:variant>>,relationships:{_REFS}>>"
)
_XML_REF = "struct<`_object-id`:string,_qualifier:string>"
_XML_REFS = f"struct<object:array<{_XML_REF}>,relationship:array<{_XML_REF}>>"
_XML_ATTRS = "struct<attribute:array<struct<_name:string,_time:string,_VALUE:string>>>"
XML_SCHEMA = (
    "events struct<event:array<struct<_id:string,_type:string,_time:string,"
    f"attributes:{_XML_ATTRS},objects:{_XML_REFS}>>>, "
    "objects struct<object:array<struct<_id:string,_type:string,"
    f"attributes:{_XML_ATTRS},objects:{_XML_REFS}>>>"
)


def decode_value(value: Column, kind: Column) -> Column:
    """A raw VARIANT as VALUE of the registered kind; null when it cannot be one.

    Strings stay strings. Numbers may arrive typed or as text; integral floats count as
    integers within the exact range, booleans never as numbers. Lists are JSON text.
    """
    shape = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    is_text = shape == "STRING"
    is_number = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
    as_double = F.try_variant_get(value, "$", "double")
    whole = (as_double == F.floor(as_double)) & (F.abs(as_double) <= MAX_EXACT)
    integer = (
        F.when(shape == "BIGINT", text)
        .when(is_number & whole, as_double.cast("bigint").cast("string"))
        .when(is_text, F.trim(text).try_cast("bigint").cast("string"))
    )
    number = F.when(is_number, as_double).when(is_text, text.try_cast("double"))
    lowered = F.lower(F.trim(text))
    boolean = F.when(shape == "BOOLEAN", text).when(is_text & lowered.isin("true", "false"), lowered)
    a_list = variant_value(F.try_parse_json(F.when(is_text, text)))
    a_list = F.when(a_list["kind"] == STRING_LIST, a_list["text"])
    decoded = (
        F.when(kind == STRING, F.when(is_text, text))
        .when(kind == BOOLEAN, boolean)
        .when(kind == INTEGER, integer)
        .when(kind == FLOAT, float_text(number))
        .when(kind == STRING_LIST, a_list)
    )
    return F.when(decoded.isNotNull(), F.struct(kind.alias("kind"), decoded.alias("text")))


def _assemble(
    events: DataFrame, objects: DataFrame, vocabulary: Vocabulary
) -> tuple[EventLog, DataFrame]:
    """events (id, type, time, attributes, relationships) and objects (without time)."""
    spark = events.sparkSession
    known = F.broadcast(vocabulary.attribute_frame(spark))

    def decoded(rows: DataFrame, scope: str) -> DataFrame:
        return (
            rows.select("id", "type", F.inline("attributes"))
            .join(
                known.where(F.col("scope") == scope).select("type", "name", F.col("kind").alias("expected")),
                ["type", "name"],
                "left",
            )
            .withColumn("decoded", decode_value(F.col("value"), F.col("expected")))
        )

    event_values, object_values = decoded(events, "event"), decoded(objects, "object")

    def attrs(rows: DataFrame, values: DataFrame) -> DataFrame:
        kept = values.where("decoded IS NOT NULL").groupBy("id").agg(
            F.map_from_entries(
                F.array_sort(F.array_distinct(F.collect_list(F.struct("name", "decoded"))))
            ).alias("attrs")
        )
        return rows.join(kept, "id", "left").withColumn(
            "attrs", F.coalesce("attrs", F.expr("CAST(map() AS map<string,struct<kind:string,text:string>>)"))
        )

    stamp = F.try_to_timestamp("time")
    log = EventLog(
        events=attrs(events, event_values).select(
            F.col("id").alias("event_id"), F.col("type").alias("event_type"), stamp.alias("ts"), "attrs"
        ),
        objects=attrs(objects, object_values).select(
            F.col("id").alias("object_id"), F.col("type").alias("object_type"), "attrs"
        ),
        e2o=events.select(F.col("id").alias("event_id"), F.inline("relationships")).toDF(
            "event_id", "object_id", "qualifier"
        ),
        o2o=objects.select(F.col("id").alias("source_id"), F.inline("relationships")).toDF(
            "source_id", "target_id", "qualifier"
        ),
    )

    def value_findings(values: DataFrame, scope: str) -> DataFrame:
        key = F.concat_ws(" ", F.lit(scope), "id")
        return union(
            [
                finding(values.where("expected IS NULL"), "attribute_unknown", key, F.col("name")),
                finding(
                    values.where("expected IS NOT NULL AND decoded IS NULL"),
                    "attribute_undecodable",
                    key,
                    F.col("name"),
                ),
            ]
        )

    changing = objects.select("id", F.inline("attributes")).where(
        F.col("time").isNotNull() & ~F.try_to_timestamp("time").eqNullSafe(F.to_timestamp(F.lit(STATIC_TIME)))
    )
    qualifiers = [*vocabulary.e2o_qualifiers, "declares", *vocabulary.o2o_endpoints]
    findings = union(
        [
            value_findings(event_values, "event"),
            value_findings(object_values, "object"),
            finding(
                events.where(stamp.isNull() | ~F.date_trunc("second", stamp).eqNullSafe(stamp)),
                "timestamp_form",
                "id",
                F.coalesce("time", F.lit("")),
            ),
            finding(changing, "dynamic_attribute", "id", F.col("name")),
            finding(
                log.e2o.where(~F.coalesce(F.col("qualifier").isin(qualifiers), F.lit(False))),
                "qualifier_unknown",
                "event_id",
                F.coalesce("qualifier", F.lit("")),
            ),
            finding(
                events.where(~F.coalesce(F.col("type").isin(list(vocabulary.event_attributes)), F.lit(False))),
                "event_type_unknown",
                "id",
                F.coalesce("type", F.lit("")),
            ),
            finding(
                objects.where(~F.coalesce(F.col("type").isin(list(vocabulary.object_attributes)), F.lit(False))),
                "object_type_unknown",
                "id",
                F.coalesce("type", F.lit("")),
            ),
        ]
    )
    return log, findings


def read_ocel_json(
    spark: SparkSession, path: str, vocabulary: Vocabulary = CREDIT
) -> tuple[EventLog, DataFrame]:
    """(log, findings) of OCEL 2.0 JSON documents."""
    # both halves read the document, so it is parsed once
    document = spark.read.schema(JSON_SCHEMA).option("multiLine", True).json(path)
    events = materialise(document.select(F.inline("events")))
    objects = materialise(document.select(F.inline("objects")))
    return _assemble(events, objects, vocabulary)


def read_ocel_xml(
    spark: SparkSession, path: str, vocabulary: Vocabulary = CREDIT
) -> tuple[EventLog, DataFrame]:
    """(log, findings) of OCEL 2.0 XML documents; an absent or "None" text is empty."""
    document = (
        spark.read.format("xml")
        .option("rowTag", "log")
        .option("valueTag", "_VALUE")
        .option("attributePrefix", "_")
        .option("ignoreSurroundingSpaces", False)
        .schema(XML_SCHEMA)
        .load(path)
    )
    shaped = lambda a: F.struct(
        a["_name"].alias("name"),
        a["_time"].alias("time"),
        F.to_variant_object(F.struct(_xml_text(a["_VALUE"]).alias("v"))).alias("boxed"),
    )

    def unbox(values: str) -> Column:
        return F.transform(
            F.transform(F.coalesce(F.col(values), F.array()), shaped),
            lambda a: F.struct(
                a["name"].alias("name"),
                a["time"].alias("time"),
                F.variant_get(a["boxed"], "$.v", "variant").alias("value"),
            ),
        )

    def refs() -> Column:
        none = F.array().cast(f"array<{_XML_REF}>")
        both = F.concat(F.coalesce("objects.object", none), F.coalesce("objects.relationship", none))
        return F.transform(
            both, lambda r: F.struct(r["_object-id"].alias("objectId"), r["_qualifier"].alias("qualifier"))
        )

    def shape(rows: DataFrame, *more: Column) -> DataFrame:
        return materialise(
            rows.select(
                F.col("_id").alias("id"),
                F.col("_type").alias("type"),
                *more,
                unbox("attributes.attribute").alias("attributes"),
                refs().alias("relationships"),
            )
        )

    events = shape(document.select(F.inline("events.event")), F.col("_time").alias("time"))
    objects = shape(document.select(F.inline("objects.object")))
    return _assemble(events, objects, vocabulary)


def _xml_text(value: Column) -> Column:
    return F.when(value.isNull() | (value == "None"), F.lit("")).otherwise(value)


def ordered_lines(sections: list[tuple[str, DataFrame | None]]) -> DataFrame:
    """(section, position, value): literal lines and comma-joined member rows, in order.

    A section is (text, None) for a literal or (name, members) with columns ``order_key``
    and ``member``; every member but the first of its section starts with a comma.
    """
    out = None
    for number, (text, members) in enumerate(sections):
        if members is None:
            spark = SparkSession.active()
            rows = spark.createDataFrame([(number, 0, text)], "section int, position long, value string")
        else:
            rows = with_rank(members, ["order_key", "member"], "position").select(
                F.lit(number).alias("section"),
                "position",
                F.concat(F.when(F.col("position") > 0, F.lit(",")).otherwise(F.lit("")), "member").alias("value"),
            )
        out = rows if out is None else out.unionByName(rows)
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ordered lines as text parts; concatenated in name order they are the document."""
    lines.orderBy("section", "position").select("value").write.text(path)


def _type_members(table: dict, log_types: list[str]) -> str:
    entries = []
    for kind in sorted(log_types):
        attrs = ",".join(
            f'{{"name":"{n}","type":"{KIND_TO_TYPE[k]}"}}' for n, k in sorted(table.get(kind, {}).items())
        )
        entries.append(f'{{"name":"{kind}","attributes":[{attrs}]}}')
    return ",".join(entries)


def ocel_json_lines(log: EventLog, vocabulary: Vocabulary = CREDIT) -> DataFrame:
    """The log as the ordered lines of one OCEL 2.0 JSON document, all values as strings."""
    if log.events.isEmpty():
        raise ValueError("an empty log has no OCEL document")

    def members(value_time: bool) -> Column:
        extra = {"time": json_string(F.lit(STATIC_TIME))} if value_time else {}
        return json_list(
            F.transform(
                F.array_sort(F.map_entries(F.coalesce("attrs", F.expr("CAST(map() AS map<string,struct<kind:string,text:string>>)")))),
                lambda e: json_object(name=json_string(e["key"]), value=json_string(e["value"]["text"]), **extra),
            )
        )

    def references(edges: DataFrame, key: str, target: str) -> DataFrame:
        return edges.groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct(target, "qualifier"))).alias("refs")
        )

    def ref_list(target: str) -> Column:
        return json_list(
            F.transform(
                F.coalesce("refs", F.array().cast(f"array<struct<{target}:string,qualifier:string>>")),
                lambda r: json_object(objectId=json_string(r[target]), qualifier=json_string(r["qualifier"])),
            )
        )

    events = log.events.join(references(log.e2o, "event_id", "object_id"), "event_id", "left").select(
        F.concat_ws(" ", utc_text(F.col("ts")), "event_id").alias("order_key"),
        json_object(
            attributes=members(False),
            id=json_string(F.col("event_id")),
            relationships=ref_list("object_id"),
            time=json_string(utc_text(F.col("ts"))),
            type=json_string(F.col("event_type")),
        ).alias("member"),
    )
    objects = log.objects.join(
        references(log.o2o.withColumnRenamed("source_id", "object_id"), "object_id", "target_id"),
        "object_id",
        "left",
    ).select(
        F.concat_ws(" ", "object_type", "object_id").alias("order_key"),
        json_object(
            attributes=members(True),
            id=json_string(F.col("object_id")),
            relationships=ref_list("target_id"),
            type=json_string(F.col("object_type")),
        ).alias("member"),
    )
    head = (
        '{"objectTypes":['
        + _type_members(vocabulary.object_attributes, list(vocabulary.object_attributes))
        + '],"eventTypes":['
        + _type_members(vocabulary.event_attributes, list(vocabulary.event_attributes))
        + '],"events":['
    )
    return ordered_lines([(head, None), ("events", events), ('],"objects":[', None), ("objects", objects), ("]}", None)])
