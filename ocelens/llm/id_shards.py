"""Token ids as raw binary shards with a minimal perfect hash index (operator 6).

A store is a folder with two Parquet tables, written by Spark's own writer so that it may
lie in any file system and survives lost executors:

* ``payload``, a folder for each shard, (shard, block, width, doc_ids, copies, lengths, ids): blocks of about a megabyte of
  raw little-endian ids, of 16 bits where the vocabulary allows it, else of 32. Documents
  follow in ascending doc_id, shards are consecutive ranges of doc_id.
* ``index`` (part, levels, bits, fingerprints, shards, blocks, offsets, lengths,
  starts): the hash of a key tells the part, the part's perfect hash the slot, and the slot
  holds a fingerprint and the place of the document's ids. A lookup is a constant number of
  steps however many documents there are.

A key is (doc_id, copy); copies number the rows of one doc_id from 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocelens.llm.arrow import map_arrow, ship, slices, texts
from ocelens.llm.encoders import by_library, vocabulary
from ocelens.llm.perfect_hash import PerfectHash
from ocelens.llm.words import mix
from ocelens.session import materialise

#: Ids in a block, and text behind a shard, about.
BLOCK_BYTES, SHARD_BYTES = 1 << 20, 128 << 20
KEYS_PER_PART = 20_000
#: So many shards are named in a filter on the payload's folders; beyond that all are read.
_FEW_SHARDS = 100

_PAYLOAD = "shard int, block int, width int, doc_ids array<long>, copies array<long>, lengths array<long>, ids binary"
_INDEX = (
    "part long, levels array<long>, bits binary, fingerprints binary, shards array<int>, blocks array<int>, "
    "offsets array<long>, lengths array<long>, starts array<long>"
)


def _keyed(df: DataFrame) -> DataFrame:
    """With two hashes of the key; a null doc_id is a key like any other."""
    return df.withColumn("_key", F.xxhash64("doc_id", "copy")).withColumn("_salt", F.xxhash64(F.lit(1), "doc_id", "copy", F.col("doc_id").isNull()))


def _fingerprints(keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return (mix(salts ^ mix(keys)) >> np.uint64(32)).astype(np.uint32)


def _borders(docs: DataFrame, shards: int) -> np.ndarray:
    """Ids that split the documents into about equal shards; they only set the sizes."""
    if shards < 2:
        return np.empty(0, np.int64)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    found = ids.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.25 / shards)
    return np.unique(np.array(found, np.float64)).astype(np.int64)


def _encoded(docs: DataFrame, path: str, end_id: int, width: int, borders: np.ndarray) -> DataFrame:
    """(shard, doc_id, ids): raw ids of every whole text with the end id, ``width`` bytes each."""
    get = by_library(docs.sparkSession, path)
    end, kind = end_id.to_bytes(4, "little"), f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for part in slices(batches, "text"):
            found = [np.frombuffer(encoder.encode(t) + end, "<u4").astype(kind).tobytes() for t in texts(part, "text")]
            ids = part.column("doc_id")
            # null ids come first
            known = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
            shard = np.searchsorted(borders, known, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), ids, pa.array(found, pa.binary())], ["shard", "doc_id", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(source, run, "shard int, doc_id long, ids binary")


def _write_payload(encoded: DataFrame, folder: str, width: int) -> None:
    """Blocks of a shard in order; ids are narrower than texts, so these are what is moved and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, last, copy = None, 0, None, -1
        ids, copies, lengths, parts, held = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            values = ([shard], [number], [width], [ids], [copies], [lengths], [b"".join(parts)])
            kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary())
            names = [f.split()[0] for f in _PAYLOAD.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for part in slices(batches, "ids"):
            for now, doc, found in zip(*(part.column(c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if now != shard or held >= BLOCK_BYTES:
                    if ids:
                        yield block()
                    number = number + 1 if now == shard else 0
                    ids, copies, lengths, parts, held = [], [], [], [], 0
                    if now != shard:
                        shard, last, copy = now, None, -1
                copy = copy + 1 if copy >= 0 and doc == last else 0
                last = doc
                ids.append(doc)
                copies.append(copy)
                lengths.append(len(found) // width)
                parts.append(found)
                held += len(found)
        if ids:
            yield block()

    # the ids settle ties, so that a task that runs again writes the same blocks
    ordered = encoded.repartition("shard").sortWithinPartitions("shard", "doc_id", "ids")
    map_arrow(ordered, run, _PAYLOAD).write.partitionBy("shard").option("compression", "zstd").parquet(f"{folder}/payload")


def _directory(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, copy, shard, block, offset, length, start) of all documents, offsets in ids."""
    blocks = spark.read.schema(_PAYLOAD).parquet(f"{folder}/payload").select("shard", "block", "doc_ids", "copies", "lengths")
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sized = materialise(blocks.select("shard", "block", total.alias("tokens")))
    earlier = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # windows over blocks within a shard, and over one row per shard
    in_shard = sized.select("shard", "block", earlier(Window.partitionBy("shard").orderBy("block")).alias("_in_shard"))
    shards = sized.groupBy("shard").agg(F.sum("tokens").alias("tokens")).select("shard", earlier(Window.orderBy("shard")).alias("_before"))
    starts = in_shard.join(shards, "shard").select("shard", "block", (F.col("_in_shard") + F.col("_before")).alias("_start"))
    located = _offsets(blocks)
    return located.join(starts, ["shard", "block"]).select("doc_id", "copy", "shard", "block", "offset", "length", (F.col("_start") + F.col("offset")).alias("start"))


def _offsets(blocks: DataFrame) -> DataFrame:
    """One row per document of a block, with the number of ids before it there."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.asarray(row["lengths"], np.int64)
                n = len(lengths)
                columns = [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["copies"], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.cumsum(lengths) - lengths), pa.array(lengths)], ["shard", "block", "doc_id", "copy", "offset", "length"])

    return map_arrow(blocks, run, "shard int, block int, doc_id long, copy long, offset long, length long")


def _write_index(spark: SparkSession, folder: str) -> None:
    entries = materialise(_keyed(_directory(spark, folder)))
    parts = entries.count() // KEYS_PER_PART + 1
    entries = entries.withColumn("part", F.pmod("_key", F.lit(parts)))

    def build(table: pa.Table) -> pa.Table:
        keys, salts = (table.column(c).to_numpy().view(np.uint64) for c in ("_key", "_salt"))
        perfect = PerfectHash.build(keys, salts)
        slot = np.argsort(perfect.places(keys, salts))
        lists = {c: table.column(c).to_numpy()[slot] for c in ("shard", "block", "offset", "length", "start")}
        row = {
            "part": [table.column("part")[0].as_py()],
            "levels": pa.array([list(perfect.sizes)], pa.list_(pa.int64())),
            "bits": pa.array([perfect.bits], pa.binary()),
            "fingerprints": pa.array([_fingerprints(keys, salts)[slot].astype("<u4").tobytes()], pa.binary()),
            **{f"{c}s": pa.array([v], pa.list_(pa.int32() if c in ("shard", "block") else pa.int64())) for c, v in lists.items()},
        }
        return pa.table(row)

    ship(spark)
    entries.drop("doc_id", "copy").groupBy("part").applyInArrow(build, _INDEX).write.parquet(f"{folder}/index")
    spark.createDataFrame([(parts,)], "parts long").write.parquet(f"{folder}/parts")


def write_store(docs: DataFrame, path: str, folder: str, end_id: int) -> None:
    """Encode every whole text, append ``end_id`` and write payload and index to a new folder.

    Columns read: doc_id (integer), text. A null or empty text has the end id alone; null
    doc_ids come first; an empty table gives an empty store. A text of any length is
    encoded as a whole and stands in one block.
    """
    rules = json.loads(vocabulary(path))
    largest = max([end_id, *rules["model"]["vocab"].values(), *(t["id"] for t in rules.get("added_tokens") or [])])
    width = 2 if largest < 1 << 16 else 4
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1)
    _write_payload(_encoded(docs, path, end_id, width, _borders(docs, shards)), folder, width)
    _write_index(docs.sparkSession, folder)


def locate(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, shard, block, offset, length, start) of the distinct keys (doc_id, copy) that the store has.

    A key that is absent is taken for another one once in four billion times: the index
    knows keys by a 32-bit fingerprint.
    """
    parts = spark.read.parquet(f"{folder}/parts").first()[0]
    asked = _keyed(keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("long").alias("copy")).distinct())
    asked = asked.withColumn("part", F.pmod("_key", F.lit(parts)))
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    out = "doc_id long, copy long, shard int, block int, offset long, length long, start long"

    def look(wanted: pa.Table, stored: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in out.split(", ")]
        if not stored.num_rows or not wanted.num_rows:
            return pa.table({n: pa.array([], pa.int32() if n in ("shard", "block") else pa.int64()) for n in names})
        row = {c: stored.column(c)[0] for c in stored.column_names}
        keys_, salts = (wanted.column(c).to_numpy().view(np.uint64) for c in ("_key", "_salt"))
        place = PerfectHash(tuple(row["levels"].as_py()), row["bits"].as_py()).places(keys_, salts)
        prints = np.frombuffer(row["fingerprints"].as_py(), "<u4")
        known = (place >= 0) & (prints[place] == _fingerprints(keys_, salts))
        place = place[known]
        mine = wanted.filter(pa.array(known))
        found = [pa.array(row[f"{c}s"].values.to_numpy()[place]) for c in names[2:]]
        return pa.table([mine.column("doc_id"), mine.column("copy"), *found], names)

    ship(spark)
    return asked.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(look, out)


def fetch(spark: SparkSession, folder: str, located: DataFrame) -> DataFrame:
    """(doc_id, copy, start, ids): the raw ids, little-endian 32 bits, of located documents.

    Requests meet at their block, which bounds how many there are. If they name few shards,
    only the files of these are read.
    """
    named = [r[0] for r in located.select("shard").distinct().limit(_FEW_SHARDS + 1).collect()]
    requests = located.groupBy("shard", "block").agg(F.collect_list(F.struct("doc_id", "copy", "offset", "length", "start")).alias("_asked"))
    payload = spark.read.schema(_PAYLOAD).parquet(f"{folder}/payload").select("shard", "block", "width", "ids")
    if len(named) <= _FEW_SHARDS:
        payload = payload.where(F.col("shard").isin(named))
    joined = payload.join(requests, ["shard", "block"]).select("width", "ids", "_asked")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                width, raw = batch.column("width")[row].as_py(), batch.column("ids")[row].as_buffer()
                asked = batch.column("_asked")[row].values
                fields = {c: asked.field(c) for c in ("doc_id", "copy", "offset", "length", "start")}
                ids = np.frombuffer(raw, f"<u{width}")
                where = zip(fields["offset"].to_pylist(), fields["length"].to_pylist(), strict=True)
                parts = [ids[a : a + n].astype("<u4").tobytes() for a, n in where]
                yield pa.RecordBatch.from_arrays([fields["doc_id"], fields["copy"], fields["start"], pa.array(parts, pa.binary())], ["doc_id", "copy", "start", "ids"])

    return map_arrow(joined, run, "doc_id long, copy long, start long, ids binary")
