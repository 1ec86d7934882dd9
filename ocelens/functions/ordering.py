"""Order-dependent primitives that never put one group, or the whole table, in one task.

A plain window over (group, order) sends a hot group to a single task, and a global
``row_number`` sends everything there. Here rows are range-partitioned on the *full*
sort key instead, so a hot group spreads over many partitions; what crosses a
partition boundary is carried by a table with one row per partition. The ranges come
from sampling, so the placed rows are written to the shared checkpoint folder once and
every later step reads that copy. Neighbours are met inside the sorted partitions, in
Arrow batches, so there is one exchange of the rows and no second one for a window.
Most logs have many small groups and few large ones; those that a count shows to be
small go through a plain window, which shuffles them once and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocelens.session import materialise

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits
#: Classes in which groups are counted, and bounds of the rows from which a class is large.
_BUCKETS, _LEAST_LARGE, _MOST_IN_WINDOW = 1 << 16, 1000, 1_000_000
#: Rows that a task groups at most, about; beyond that there are more tasks, not larger ones.
_ROWS_IN_TASK = 1_000_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """The rows dealt by ``keys`` to so many tasks that the memory of one does not grow with the table.

    Groupings by these and further keys need no other exchange. Where the shuffle partitions of
    the session do, ``df`` stays as it is. Without ``rows`` it is computed once more to count them.
    """
    tasks = (df.count() if rows is None else rows) // _ROWS_IN_TASK + 1
    return df if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(tasks, *keys)


def dealt(df: DataFrame, *keys: Column | str, rows: int) -> DataFrame:
    """The rows in one exchange by ``keys``, with more tasks than shuffle partitions where these would hold too many."""
    tasks = rows // _ROWS_IN_TASK + 1
    few = tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(*keys) if few else df.repartition(tasks, *keys)


def _place(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    placed = (
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    frozen = materialise(placed)
    return frozen.select(
        *df.columns,
        F.shiftright("_at", _ROW_BITS).alias("_part"),
        F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1).alias("_row"),
    )


def _across_partitions() -> Window:
    """Runs over one row per partition, never over data rows."""
    return Window.orderBy("_part")


def with_rank(df: DataFrame, keys: Sequence[str], name: str = "rank") -> DataFrame:
    """The 0-based position of each row in the total order of ``keys``."""
    placed = _place(df, keys)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_size").over(_across_partitions().rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .drop("_part", "_row", "_offset")
    )


def _large(df: DataFrame, group: Sequence[str]) -> Column | None:
    """Whether a row is of a large group; None if there is none.

    Groups are counted in ``_BUCKETS`` classes of their hash, of which a task sends one row
    each. A class is large from a quarter of a mean shuffle partition on, so that all others
    can be met in a plain window without a task that stands out.
    """
    bucket = F.pmod(F.xxhash64(*group), F.lit(_BUCKETS)).cast("int")
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(F.lit(1)))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = F.greatest(F.lit(_LEAST_LARGE), F.least(F.lit(_MOST_IN_WINDOW), total / (4 * tasks)))
    found = [row["_bucket"] for row in sizes.withColumn("_least", least).where("_n > _least").select("_bucket").collect()]
    return bucket.isin(found) if found else None


def with_rank_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position", *, by_ranges: bool = False
) -> DataFrame:
    """The 0-based position of each row inside its group; rows without a group are left out.

    The rows of large groups are placed by ranges, all others numbered in a window; ``df`` is
    computed once more to find them. ``by_ranges`` places all rows so.
    """
    if by_ranges:
        return _rank_in_group_by_range(df, group, order, name)
    df = df.where(" AND ".join(f"`{g}` IS NOT NULL" for g in group))
    large = _large(df, group)
    window = Window.partitionBy(*group).orderBy(*order)
    few = df if large is None else df.where(~large)
    few = few.withColumn(name, (F.row_number().over(window) - 1).cast("long"))
    return few if large is None else few.unionByName(_rank_in_group_by_range(df.where(large), group, order, name))


def _rank_in_group_by_range(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    ranked = with_rank(df, [*group, *order], "_rank")
    starts = ranked.groupBy(*group).agg(F.min("_rank").alias("_start"))
    return (
        ranked.join(starts, list(group))
        .withColumn(name, F.col("_rank") - F.col("_start"))
        .drop("_rank", "_start")
    )


def with_neighbours(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    *,
    previous: str | None = None,
    following: str | None = None,
    carry: Sequence[str],
) -> DataFrame:
    """Attach the adjacent row of the same group as a struct of the ``carry`` columns.

    ``previous`` / ``following`` name the struct columns to add; the struct is null at
    the group's ends. The rows of large groups are placed by ranges, all others met in a
    window. ``df`` is computed once more to find them.
    """
    sides = {"_prev": previous, "_next": following}
    large = _large(df, group) if group else F.lit(True)
    few = None
    if not group or large is not None:
        many = _neighbours_by_range(df.where(large), group, order, sides, carry)
    if group:
        value = F.struct(*[F.col(c) for c in carry])
        window = Window.partitionBy(*group).orderBy(*order)
        few = df if large is None else df.where(~large)
        step = {"_prev": F.lag, "_next": F.lead}
        few = few.select("*", *[step[side](value).over(window).alias(name) for side, name in sides.items() if name])
    if few is None:
        return many
    return few if large is None else few.unionByName(many)


def with_rank_and_previous(
    df: DataFrame, keys: Sequence[str], *, rank: str, previous: str, carry: Sequence[str], stored: bool = False
) -> DataFrame:
    """Position and predecessor in the total order of ``keys``, from one exchange of the rows.

    ``stored`` says that ``df`` does no more than read rows that are written, so they are not written again.
    """
    return _neighbours_by_range(df, [], keys, {"_prev": previous, "_next": None}, carry, rank, stored)


def _neighbours_by_range(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sides: dict[str, str | None],
    carry: Sequence[str],
    rank: str | None = None,
    stored: bool = False,
) -> DataFrame:
    keys = [*group, *order]
    cell = F.struct(
        F.struct(*[F.col(c) for c in group]).alias("g") if group else F.lit(0).alias("g"),
        F.struct(*[F.col(c) for c in carry]).alias("v"),
    )
    # written first: the ranges come from a sample, which else would compute the rows twice
    placed = (
        (df if stored else materialise(df, "zstd"))
        .repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .select("*", cell.alias("_cell"), F.monotonically_increasing_id().alias("_at"))
    )
    wanted = [side for side, name in sides.items() if name]
    kind = placed.schema["_cell"].dataType
    schema = T.StructType([*placed.schema.fields, *[T.StructField(side, kind) for side in wanted], T.StructField("_last", T.BooleanType())])

    def same_group(neighbour: Column) -> Column:
        return F.when(neighbour["g"] == F.col("_cell")["g"], neighbour["v"])

    row = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    # cells are kept of the outermost rows of each partition only
    beside = placed.mapInArrow(_beside(wanted), schema).select(
        *df.columns, *[same_group(F.col(side)).alias(side) for side in wanted], "_last",
        F.when((row == 0) | F.col("_last"), F.col("_cell")).alias("_cell"),
        F.shiftright("_at", _ROW_BITS).alias("_part"),
        row.alias("_row"),
    )
    here = materialise(beside, "zstd")
    heads = here.where("_row = 0").select("_part", F.col("_cell").alias("_first"))
    tails = here.where("_last").select("_part", F.col("_cell").alias("_end"), (F.col("_row") + 1).alias("_size"))
    above = _across_partitions().rowsBetween(Window.unboundedPreceding, -1)
    edges = heads.join(tails, "_part").select(
        "_part",
        F.lag("_end").over(_across_partitions()).alias("_before"),
        F.lead("_first").over(_across_partitions()).alias("_after"),
        F.coalesce(F.sum("_size").over(above), F.lit(0)).alias("_offset"),
    )
    out = here.join(F.broadcast(edges), "_part")
    if sides["_prev"]:
        out = out.withColumn(sides["_prev"], F.when(F.col("_row") == 0, same_group(F.col("_before"))).otherwise(F.col("_prev")))
    if sides["_next"]:
        out = out.withColumn(sides["_next"], F.when(F.col("_last"), same_group(F.col("_after"))).otherwise(F.col("_next")))
    if rank:
        out = out.withColumn(rank, F.col("_offset") + F.col("_row"))
    return out.drop("_part", "_row", "_cell", "_prev", "_next", "_before", "_after", "_last", "_offset")


def _beside(wanted: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the cells before and behind each row within a sorted partition, and marks its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(batch: pa.RecordBatch, before: pa.Array, after: pa.Array | None) -> pa.RecordBatch:
            cells, n = batch.column("_cell"), batch.num_rows
            behind = pa.nulls(1, cells.type) if after is None else after
            shifted = {"_prev": [before, cells.slice(0, n - 1)], "_next": [cells.slice(1), behind]}
            columns = [pa.concat_arrays(shifted[side]) for side in wanted]
            last = pa.array([False] * (n - 1) + [after is None])
            return pa.RecordBatch.from_arrays([*batch.columns, *columns, last], [*batch.schema.names, *wanted, "_last"])

        held, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("_cell")
            if held is not None:
                yield told(held, before, cells.slice(0, 1))
                before = held.column("_cell").slice(held.num_rows - 1)
            else:
                before = pa.nulls(1, cells.type)
            held = batch
        if held is not None:
            yield told(held, before, None)

    return run
