"""Near-duplicate vectors by counting collisions on sorted projections (operator 3).

Vectors are projected on random lines. On a line a near pair lies closer than a window,
centred on the query, with a known chance; so many lines that a near pair collides on
are counted, and a pair that reaches the calibrated count is verified in double precision.

The first line sorts all vectors into blocks of equal size; two blocks are compared if a
window reaches from one into the other, in a task of its own. Within a pair of blocks all
lines are counted at once on arrays of small integers, and a task gives back one row for
each vector (its links, and one link of its component), however many pairs it has found.
Equal vectors are one vector with a weight from the start.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocelens.functions.ordering import with_rank
from ocelens.llm.arrow import map_arrow, ship
from ocelens.llm.components import components
from ocelens.session import materialise

_STEPS = 1 << 11  # integer steps for one unit of a projection


@dataclass(frozen=True)
class Projections:
    """Lines and windows for a cosine; the chances hold at exactly that cosine.

    A pair is missed on the sorted line with ``miss`` at most and by the count with
    ``miss`` at most.
    """

    cosine: float = 0.95
    lines: int = 24
    collision: float = 0.9  # chance of a near pair to collide on one counted line
    miss: float = 1e-4
    block: int = 4096
    seed: int = 7

    @property
    def distance(self) -> float:
        return math.sqrt(2 - 2 * self.cosine)

    @property
    def sorted_window(self) -> float:
        return self.distance * _normal_quantile(1 - self.miss / 2)

    @property
    def counted_window(self) -> float:
        return self.distance * _normal_quantile(0.5 + self.collision / 2)

    @property
    def least_count(self) -> int:
        """The largest count that a near pair falls short of with ``miss`` at most."""
        below = 0.0
        for k in range(self.lines + 1):
            below += math.comb(self.lines, k) * self.collision**k * (1 - self.collision) ** (self.lines - k)
            if below > self.miss:
                return k
        return self.lines

    def directions(self, dimensions: int) -> np.ndarray:
        """The sorted line first, then the counted ones."""
        return np.random.default_rng([self.seed, dimensions]).standard_normal((dimensions, self.lines + 1))


def _normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Double-precision directions; scaled first, so that no square over- or underflows."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _projected(vectors: DataFrame, how: Projections) -> DataFrame:
    """(id, weight, vector, at, marks): usable vectors as bytes with their projections."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                lists = part.column("vector")
                rows, raw, at, marks = [], [], [], []
                for row in range(part.num_rows):
                    values = lists[row].values
                    if values is None or len(values) == 0 or values.null_count:
                        continue
                    one = values.to_numpy()
                    if np.isfinite(one).all() and one.any():
                        rows.append(row)
                        raw.append(one)
                for dims in sorted({len(v) for v in raw}):
                    these = [i for i, v in enumerate(raw) if len(v) == dims]
                    lines = _unit(np.stack([raw[i] for i in these])) @ how.directions(dims)
                    steps = np.clip(np.rint(lines[:, 1:] * _STEPS), -32768, 32767).astype(np.int16)
                    for i, line, step in zip(these, lines[:, 0], steps, strict=True):
                        at.append((i, float(line), step.tobytes()))
                at.sort()
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(take), part.column("weight").take(take), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array([a[1] for a in at], pa.float64()), pa.array([a[2] for a in at], pa.binary())],
                    ["id", "weight", "vector", "at", "marks"],
                )

    return map_arrow(vectors, run, "id long, weight long, vector binary, at double, marks binary")


def _compare(how: Projections, element: str):
    """The function for one pair of blocks: (id, links, to) for every vector with a link in it."""
    kind = np.dtype(element)
    window, least, reach = np.uint16(int(how.counted_window * _STEPS) + 2), how.least_count, how.sorted_window

    def links(left: dict, right: dict, same: bool):
        """(rows of left, rows of right) of the verified links, some at a time."""
        for begin in range(0, len(left["at"]), 128):
            rows = slice(begin, begin + 128)
            at = left["at"][rows]
            low = np.searchsorted(right["at"], at[0] - reach, "left")
            high = np.searchsorted(right["at"], at[-1] + reach, "right")
            if high <= low:
                continue
            count = np.zeros((len(at), high - low), np.uint8)
            for line in range(how.lines):
                # unsigned and wrapping, so one comparison tells a place inside the window
                above = right["marks"][line, low:high] - (left["marks"][line, rows] - window)[:, None]
                count += above <= 2 * window
            near = count >= least
            near &= np.abs(right["at"][low:high] - at[:, None]) <= reach
            i, j = np.nonzero(near)
            i, j = (i + begin).astype(np.int32), (j + low).astype(np.int32)
            if same:
                i, j = i[i < j], j[i < j]
            for cut in range(0, len(i), 65_536):
                a, b = i[cut : cut + 65_536], j[cut : cut + 65_536]
                close = np.einsum("ij,ij->i", left["unit"][a], right["unit"][b]) >= how.cosine
                yield a[close], b[close]

    def block(table: pa.Table, side: int) -> dict:
        part = table.filter(pc.equal(table.column("side"), side))
        at = part.column("at").to_numpy()
        order = np.argsort(at, kind="stable")
        raw = np.frombuffer(b"".join(part.column("vector").to_pylist()), kind).reshape(part.num_rows, -1)[order]
        marks = np.frombuffer(b"".join(part.column("marks").to_pylist()), np.uint16).reshape(part.num_rows, -1)[order]
        return {"id": part.column("id").to_numpy()[order], "weight": part.column("weight").to_numpy()[order], "at": at[order], "unit": _unit(raw), "marks": np.ascontiguousarray(marks.T)}

    def run(table: pa.Table) -> pa.Table:
        same = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        if not same and pc.count_distinct(table.column("side")).as_py() < 2:  # lengths that one block has
            return table.select(["id"]).slice(0, 0).append_column("links", pa.array([], pa.int64())).append_column("to", pa.array([], pa.int64()))
        left = block(table, 0)
        right = left if same else block(table, 1)
        links_l, links_r = np.zeros(len(left["id"]), np.int64), np.zeros(len(right["id"]), np.int64)
        to_l, to_r = left["id"].copy(), right["id"].copy()
        if same:
            links_r, to_r = links_l, to_l
        found = list(links(left, right, same))
        for a, b in found:
            np.add.at(links_l, a, right["weight"][b])
            np.add.at(links_r, b, left["weight"][a])
        moved = True
        while moved and found:  # the smallest id that the links of this task reach
            before = to_l.sum() + to_r.sum()
            for a, b in found:
                np.minimum.at(to_l, a, to_r[b])
                np.minimum.at(to_r, b, to_l[a])
            moved = to_l.sum() + to_r.sum() != before
        sides = [(left, links_l, to_l)] if same else [(left, links_l, to_l), (right, links_r, to_r)]
        columns = [np.concatenate(c) for c in zip(*((s["id"][n > 0], n[n > 0], t[n > 0]) for s, n, t in sides), strict=True)]
        return pa.table(dict(zip(("id", "links", "to"), columns, strict=True)))

    return run


def links(vectors: DataFrame, how: Projections | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector.

    Columns read: vec_id (integer), embedding (array of float or double). A link needs a
    cosine of at least ``how.cosine`` in double precision and vectors of one length. A
    vector that is null, empty or zero, or holds a null or a non-finite number, has none,
    and is its own component. Rows are vectors: equal vectors link, also under one vec_id,
    and several vectors of one vec_id are linked each for itself. An empty table gives none.
    A component is named by its smallest vec_id. A null vec_id is as linked as its equals
    with an id; without such it has no links and the component null.
    """
    how = how or Projections()
    kind = vectors.schema["embedding"].dataType.elementType
    element = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    cast = F.col("embedding").cast("array<float>" if element == "<f4" else "array<double>")
    # hashes pass over nulls, so arrays that hold one are set apart first
    typed = F.when(~F.exists(cast, lambda x: x.isNull()), cast)
    # twice 64 bits name a vector; a name for copies, never a proof of similarity
    names = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), typed.alias("vector")).select("*", *names)
    groups = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")).where("first is not null")
    # a vec_id may have several vectors, so groups have numbers of their own, in the order of their smallest vec_id
    groups = with_rank(materialise(groups), ["first", "h1", "h2"], "id")
    groups = materialise(groups.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "id", "first", "weight"))
    same_vector = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    distinct = rows.join(groups, same_vector & (F.col("vec_id") == F.col("first"))).select("id", "weight", "vector").dropDuplicates(["id"])
    points = materialise(with_rank(materialise(_projected(distinct, how)), ["at", "id"], "_rank"))
    blocked = points.withColumn("block", F.expr(f"_rank div {how.block}L"))
    # one row per block: which blocks does a window reach
    edges = blocked.groupBy("block").agg(F.min("at").alias("low_at"), F.max("at").alias("high_at"))
    cell = lambda c: F.floor(c / how.sorted_window)
    spread = edges.select("block", "low_at", "high_at", F.explode(F.sequence(cell(F.col("low_at")) - 1, cell(F.col("high_at")) + 1)).alias("cell"))
    after = spread.select(F.col("block").alias("high"), F.col("low_at").alias("_next"), "cell")
    pairs = spread.join(after, "cell").where((F.col("block") <= F.col("high")) & (F.col("_next") - F.col("high_at") <= how.sorted_window))
    pairs = materialise(pairs.select(F.col("block").alias("low"), "high").distinct())
    columns = ["id", "weight", "at", "vector", "marks"]
    sides = [blocked.join(pairs, F.col("block") == F.col(c)).select("low", "high", F.lit(s).alias("side"), *columns) for s, c in ((0, "low"), (1, "high"))]
    dealt = sides[0].unionByName(sides[1].where("low <> high")).withColumn("dims", F.length("vector"))
    ship(vectors.sparkSession)
    found = materialise(dealt.groupBy("low", "high", "dims").applyInArrow(_compare(how, element), "id long, links long, to long"))

    reached = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    usable = points.select("id", "weight").join(counts, "id", "left").join(reached, "id", "left")
    answers = materialise(usable.select(
        "id",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("_links"),
        F.coalesce("component", "id").alias("_root"),
    ))
    names_of = groups.select(F.col("id").alias("_root"), F.col("first").alias("_component"))
    named = groups.join(answers, "id").join(names_of, "_root").select("_h1", "_h2", "_links", "_component")
    return rows.join(materialise(named), same_vector, "left").select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_component", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
