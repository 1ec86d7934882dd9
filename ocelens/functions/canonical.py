"""Canonical JSON text and content hashes as Column expressions.

The canonical form is compact JSON with sorted keys and unescaped non-ASCII text.
Objects are assembled from already encoded members, so callers list keys in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocelens.functions.attributes import STRING
from ocelens.functions.ordering import dealt

#: Hex digits of the row hash that the nodes of each level share; the same for every size,
#: so a digest depends on its rows alone. Leaves stay small up to some 10^10 rows.
HASH_PREFIXES = (6, 3, 0)
#: Characters that a JSON string escapes.
_ESCAPED = r'["\\\x00-\x1f]'


def json_string(col: Column) -> Column:
    """A string as a JSON literal; null stays null."""
    text = col.cast("string")
    # most strings hold nothing to escape and need no JSON writer
    return F.when(text.rlike(_ESCAPED), _strip_brackets(F.to_json(F.array(text)))).when(
        text.isNotNull(), F.concat(F.lit('"'), text, F.lit('"'))
    )


def _strip_brackets(encoded: Column) -> Column:
    return F.substring(encoded, F.lit(2), F.length(encoded) - 2)


def json_value(value: Column) -> Column:
    """A VALUE as a JSON literal (strings quoted, the rest already spelled)."""
    return F.when(value["kind"] == STRING, json_string(value["text"])).otherwise(value["text"])


def json_strings(col: Column) -> Column:
    """An array of strings as a JSON array."""
    return F.to_json(col)


def json_list(encoded_items: Column) -> Column:
    """An array of encoded members as a JSON array."""
    return F.concat(F.lit("["), F.array_join(encoded_items, ","), F.lit("]"))


def json_object(**members: Column) -> Column:
    """Encoded members as a JSON object with sorted keys; null members are dropped."""
    parts = [
        F.concat(F.lit(f'"{key.rstrip("_")}":'), members[key])
        for key in sorted(members, key=lambda k: k.rstrip("_"))
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_attrs(attrs: Column) -> Column:
    """An attribute map as a JSON object, keys sorted."""
    entries = F.array_sort(F.map_entries(attrs))
    members = F.transform(
        entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_value(e["value"]))
    )
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def json_text_map(mapping: Column) -> Column:
    """A MAP<STRING, STRING> as a JSON object, keys sorted."""
    members = F.transform(
        F.array_sort(F.map_entries(mapping)),
        lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_string(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def utc_text(ts: Column) -> Column:
    """A timestamp as whole-second UTC text with a literal Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _merged_copies(groups: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Equal hashes of a batch become one row, so that no number of copies meets in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = pa.Table.from_batches([batch]).group_by([*groups, "_row"]).aggregate([("_copies", "sum")])
            names = [*groups, "_row", "_copies_sum"]
            yield from merged.select(names).rename_columns(batch.schema.names).cast(batch.schema).combine_chunks().to_batches()

    return run


def content_digest(
    hashes: DataFrame, *groups: str, row_hash: str = "row_sha256", rows: int | None = None
) -> DataFrame:
    """Order- and partition-independent sha256 of a multiset of row hashes, per group.

    One byte stream cannot be hashed in parallel, so equal rows first collapse to
    (hash, copies) and the distinct hashes are then folded through a prefix tree:
    each level hashes the sorted digests below it. The tree has one fixed depth, so a
    group's digest does not depend on what else is digested, and inner nodes have at most
    16**3 children, whatever the copies of the input. Told how many ``rows`` there are, about, it
    deals them to more tasks where the shuffle partitions would hold too many.
    """
    length, *above = HASH_PREFIXES
    hashed = hashes.select(*groups, F.unhex(row_hash).alias("_row"), F.lit(1).cast("long").alias("_copies"))
    prefix = F.substring("_row", 1, length // 2)
    # one exchange brings copies and the leaves of a node together
    counted = (
        dealt(hashed.mapInArrow(_merged_copies(groups), hashed.schema), *groups, prefix, rows=rows or 0)
        .withColumn("prefix", prefix)
        .groupBy(*groups, "prefix", "_row")
        .agg(F.sum("_copies").alias("_copies"))
    )
    leaf = sha256(F.concat_ws(":", F.lower(F.hex("_row")), F.col("_copies").cast("string")))
    level = counted.groupBy(*groups, "prefix").agg(
        sha256(F.array_join(F.array_sort(F.collect_list(leaf)), "")).alias("digest")
    )
    level = level.withColumn("prefix", F.lower(F.hex("prefix")))
    for length in above:
        # children are moved as bytes, half of what their digits take
        children = F.transform(F.array_sort(F.collect_list(F.unhex("digest"))), lambda d: F.lower(F.hex(d)))
        level = (
            level.withColumn("prefix", F.substring("prefix", 1, length))
            .groupBy(*groups, "prefix")
            .agg(sha256(F.array_join(children, "")).alias("digest"))
        )
    return level.drop("prefix")
