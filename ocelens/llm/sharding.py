"""Proportional stratified interleaving of documents into shards (operator 10).

Rows are ranked in a seeded shuffle of their source; the fractional rank, half a step into
the row's share of its source, sorts all sources into one another, and equal cuts of that
order are shards with the mixture of the whole. Both ranks come from range-partitioned
sorts of narrow rows, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocelens.functions.ordering import with_rank
from ocelens.session import materialise


def interleave(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot); shards differ by one row at most.

    Columns read: doc_id, text, source. Size is the UTF-8 bytes of the text (null: none)
    and 16. Null sources are a source of their own; a repeated row gets a place of its own;
    an empty table gives no rows. The order within a source follows a hash of seed, doc_id
    and text, so it is the same in any partitioning.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        (F.length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_shuffled"),
    )
    ties = ["_shuffled", "doc_id", "text_crc32", "size"]
    ranked = materialise(with_rank(materialise(rows), ["source", *ties], "_rank"))
    # one row per source; the join below is skewed on purpose and left to AQE
    sources = ranked.groupBy("source").agg(F.count("*").alias("_rows"), F.min("_rank").alias("_first")).withColumnRenamed("source", "_source")
    total = ranked.count()
    mixed = ranked.join(materialise(sources), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "text_crc32", "_shuffled",
        ((2 * (F.col("_rank") - F.col("_first")) + 1).cast("double") / (2 * F.col("_rows")).cast("double")).alias("_fraction"),
    )
    placed = with_rank(mixed, ["_fraction", "source", *ties], "_place")
    # integer arithmetic: place * shards fits a long far beyond any corpus
    shard = F.expr(f"(_place * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"((_place * {shards}L) div {max(total, 1)}L * {total}L + {shards - 1}L) div {shards}L")
    return placed.select("doc_id", "source", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("_place") - first).alias("slot"))
