"""Shortest-pack-first packing over the length histogram (operator 5).

Documents are cut into pieces of at most ``limit`` tokens. Packing looks only at the
histogram of piece lengths, at most ``limit`` numbers whatever the corpus: lengths are
placed longest first, each into the packs that are shortest so far, and a whole count of
equal packs moves at once. The outcome is a short table of patterns with counts. A piece
finds its place through its rank among the pieces of its length: slots own ranges of
ranks. Ranks come from a range-partitioned sort, so a length that most pieces share is
spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocelens.functions.ordering import with_rank
from ocelens.llm.arrow import map_arrow, slices, texts
from ocelens.llm.encoders import by_library, pieces
from ocelens.session import materialise


def cut(docs: DataFrame, path: str, limit: int, end_id: int, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids_crc32[, ids]): the pieces of every document.

    Columns read: doc_id, text. The ids of the whole text by the tokenizers file at
    ``path``, then ``end_id``, cut every ``limit`` ids; a null or empty text is a single
    end id. ``ids`` (little-endian 32-bit integers) is left out unless asked for.
    """
    get = by_library(docs.sparkSession, path)
    end = end_id.to_bytes(4, "little")
    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
    fields += [T.StructField("doc_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] if keep_ids else []
    names = [f.name for f in fields]

    def run(batches):
        encoder = get()
        for part in slices(batches, "text"):
            rows, starts, lengths, totals, sums, kept = [], [], [], [], [], []
            for row, text in enumerate(texts(part, "text")):
                ids = encoder.encode(text) + end
                for start, piece in pieces(ids, limit):
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    totals.append(len(ids) // 4)
                    sums.append(zlib.crc32(piece))
                    if keep_ids:
                        kept.append(piece)
            out = [part.column("doc_id").take(pa.array(rows, pa.int32())), *(pa.array(v, pa.int64()) for v in (starts, lengths, totals, sums))]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(kept, pa.binary())] if keep_ids else []), names)

    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, T.StructType(fields))


def shortest_pack_first(histogram: Mapping[int, int], limit: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """[(packs, ((length, times), ...))]: the patterns and how many packs follow each.

    Every length, longest first, goes piece by piece into the pack with the most room;
    only if none has room for it a new pack is opened.
    """
    room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}

    def put(free: int, packs: int, runs: tuple[tuple[int, int], ...]) -> None:
        if packs:
            room.setdefault(free, []).append((packs, runs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = max(room, default=0)
            if free < length:  # a new pack is the shortest one until it is full
                each = limit // length
                put(limit - each * length, left // each, ((length, each),))
                put(limit - left % each * length, int(left % each > 0), ((length, left % each),))
                break
            packs, runs = room[free].pop()
            if not room[free]:
                del room[free]
            used = min(packs, left)
            put(free, packs - used, runs)
            last, times = runs[-1]
            put(free - length, used, (*runs[:-1], (last, times + 1)) if last == length else (*runs, (length, 1)))
            left -= used
    return [one for free in sorted(room) for one in room[free]]


def pack(cut_pieces: DataFrame, limit: int) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, both gapless from 0.

    Columns read: doc_id, start, length (1 to ``limit``); all others are carried along,
    old columns of the two new names are replaced. Equal pieces get different places.
    """
    spark = cut_pieces.sparkSession
    stored = materialise(cut_pieces.drop("sequence_id", "offset"))
    # at most ``limit`` rows
    histogram = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= length <= limit for length in histogram):
        raise ValueError(f"pieces must have 1 to {limit} tokens")
    slots, sequence, taken = [], 0, dict.fromkeys(histogram, 0)
    for packs, runs in shortest_pack_first(histogram, limit):
        offset = 0
        for length, times in runs:
            slots.append((length, taken[length], taken[length] + packs * times, sequence, offset, times))
            taken[length] += packs * times
            offset += length * times
        sequence += packs
    bases, before = {}, 0
    for length in sorted(histogram):
        bases[length] = before
        before += histogram[length]
    # a few slots for each length: the size follows from ``limit``, not from the corpus
    table = spark.createDataFrame(
        [(length, bases[length] + a, bases[length] + b, seq, offset, times) for length, a, b, seq, offset, times in slots],
        "_length long, _from long, _to long, _sequence long, _offset long, _times long",
    )
    ranked = with_rank(stored, ["length", "doc_id", "start"], "_rank")
    inside = F.col("_rank") - F.col("_from")
    return ranked.join(
        F.broadcast(table),
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
    ).select(
        *stored.columns,
        (F.col("_sequence") + F.floor(inside / F.col("_times"))).alias("sequence_id"),
        (F.col("_offset") + inside % F.col("_times") * F.col("length")).alias("offset"),
    )


def sequences(placed: DataFrame, limit: int, pad_id: int) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, padded to ``limit``.

    Needs pieces that kept their ids. A group is one sequence, so at most ``limit`` ids.
    """
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    filled = F.aggregate(joined, F.unhex(F.lit("")), lambda all_, one: F.concat(all_, one["ids"]))
    padding = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(limit) - F.length("ids") / 4).cast("int")))
    return placed.groupBy("sequence_id").agg(filled.alias("ids")).select("sequence_id", F.concat("ids", padding).alias("ids"))
