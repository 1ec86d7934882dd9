"""Iterative graph steps on edge tables: nearest marked ancestor and edges on cycles.

State stays linear in the edges (no transitive closure is ever built), each step is a
join plus an aggregate, and the lineage is cut after every step. Pointers double, so
chains take a number of steps that grows with the logarithm of their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocelens.session import materialise

#: Distinct edges up to which a graph is looked at in one row.
_SMALL = 16


def nearest_marked_ancestor(nodes: DataFrame) -> DataFrame:
    """Resolve every unmarked node to its closest marked ancestor by pointer jumping.

    Input: (tree, node, parent, marked). Output: (tree, node, ancestor) for the unmarked
    nodes; ``ancestor`` is null where the climb ends in a cycle or a missing parent.
    The pointer distance doubles per round, so rounds grow with log2 of the depth.
    """
    marked = nodes.where("marked").select("tree", F.col("node").alias("parent"))
    state = materialise(
        nodes.where("NOT marked")
        .join(marked.withColumn("resolved", F.lit(True)), ["tree", "parent"], "left")
        .select("tree", "node", F.col("parent").alias("at"), F.coalesce("resolved", F.lit(False)).alias("resolved"))
    )
    open_rows = state.where("NOT resolved").count()
    while open_rows:
        jump = state.select(
            "tree",
            F.col("node").alias("at"),
            F.col("at").alias("next_at"),
            F.col("resolved").alias("next_resolved"),
        )
        moved = (
            state.where("NOT resolved AND at IS NOT NULL")
            .join(jump, ["tree", "at"], "left")
            .select(
                "tree",
                "node",
                F.col("next_at").alias("at"),
                F.coalesce("next_resolved", F.lit(False)).alias("resolved"),
            )
        )
        state = materialise(
            state.where("resolved OR at IS NULL").unionByName(moved)
        )
        # a finite climb shortens every round; a standstill means only cycles are left
        still_open = state.where("NOT resolved").count()
        if still_open == open_rows:
            break
        open_rows = still_open
    return state.select("tree", "node", F.when(F.col("resolved"), F.col("at")).alias("ancestor"))


def _degrees(edges: DataFrame) -> DataFrame:
    """(g, n, arriving, leaving, before, after): the neighbours are meant where there is one."""
    ends = edges.select("g", F.col("u").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast(edges.schema["u"].dataType).alias("p"), F.col("v").alias("s"))
    ends = ends.unionByName(edges.select("g", F.col("v").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("u").alias("p"), F.lit(None).cast(edges.schema["v"].dataType).alias("s")))
    return ends.groupBy("g", "n").agg(F.sum("i").alias("arriving"), F.sum("o").alias("leaving"), F.max("p").alias("before"), F.max("s").alias("after"))


def _compressed(edges: DataFrame) -> DataFrame:
    """(g, u, v, start, stop): each edge with the ends of the chain it lies on, without dead ends.

    A chain passes through nodes with one edge in and one out; an edge outside chains is its
    own. Both ends are null on a cycle that is nothing but a chain. Edges are left out if
    nothing arrives where their chain starts, or nothing leaves where it stops.
    """
    nodes = materialise(_degrees(edges).withColumn("kept", (F.col("arriving") != 1) | (F.col("leaving") != 1)))
    # both directions climb together, as trees of their own
    climbs = [nodes.select(F.struct("g", F.lit(way).alias("way")).alias("tree"), F.col("n").alias("node"), F.col(to).alias("parent"), F.col("kept").alias("marked")) for way, to in ((0, "before"), (1, "after"))]
    ends = nearest_marked_ancestor(climbs[0].unionByName(climbs[1]))
    ends = ends.select(F.col("tree.g").alias("g"), F.col("tree.way").alias("way"), F.col("node").alias("n"), F.col("ancestor").alias("end"))
    out = edges
    for way, at, name, count in ((0, "u", "start", "arriving"), (1, "v", "stop", "leaving")):
        own = nodes.where("kept").select("g", "n", F.col("n").alias("end"))
        through = ends.where(F.col("way") == way).select("g", "n", "end")
        dead = nodes.where(F.col(count) == 0).select("g", F.col("n").alias("end"))
        reached = own.unionByName(through).join(dead, ["g", "end"], "left_anti").select("g", F.col("n").alias(at), F.col("end").alias(name))
        out = out.join(reached, ["g", at])
    return materialise(out.select("g", "u", "v", "start", "stop"))


def _largest_reaching(edges: DataFrame) -> DataFrame:
    """(g, n, best): the largest node from which a path leads to n, n included.

    What reaches the best node so far reaches n too, so each step also jumps there.
    """
    state = materialise(edges.select("g", F.col("u").alias("n")).union(edges.select("g", "v")).distinct().withColumn("best", F.col("n")))
    while True:
        pushed = edges.join(state.select("g", F.col("n").alias("u"), "best"), ["g", "u"]).select("g", F.col("v").alias("n"), "best")
        jumped = state.join(state.select("g", F.col("n").alias("best"), F.col("best").alias("_far")), ["g", "best"]).select("g", "n", F.col("_far").alias("best"))
        offers = pushed.unionByName(jumped).withColumn("old", F.lit(None).cast(state.schema["best"].dataType))
        best = offers.unionByName(state.withColumn("old", F.col("best"))).groupBy("g", "n").agg(F.max("best").alias("best"), F.max("old").alias("old"))
        moved = materialise(best)
        if moved.where("best > old").isEmpty():
            return moved.select("g", "n", "best")
        state = moved.select("g", "n", "best")


def _components_of_colours(edges: DataFrame) -> DataFrame:
    """(g, u, v, cyclic): one colour round; edges of settled components that are on no cycle are left out.

    Nodes take the colour of the largest node that reaches them. The nodes of a colour
    that reach this node are its strongly connected component.
    """
    colours = _largest_reaching(edges)
    both = edges.join(colours.select("g", F.col("n").alias("u"), F.col("best").alias("cu")), ["g", "u"])
    both = materialise(both.join(colours.select("g", F.col("n").alias("v"), F.col("best").alias("cv")), ["g", "v"]))
    inner = materialise(both.where("cu = cv").select("g", F.col("v").alias("u"), F.col("u").alias("v"), F.col("cu").alias("colour")))
    # the root is the largest of its colour, so a node reaches it if that is the largest it reaches
    back = _largest_reaching(inner.select("g", "u", "v"))
    member = materialise(back.join(colours.withColumnRenamed("best", "colour"), ["g", "n"]).where("best = colour").select("g", "n", "colour"))
    joined = both.join(member.select("g", F.col("n").alias("u"), F.col("colour").alias("ru")), ["g", "u"], "left")
    joined = joined.join(member.select("g", F.col("n").alias("v"), F.col("colour").alias("rv")), ["g", "v"], "left")
    cyclic = F.coalesce(F.col("ru") == F.col("rv"), F.lit(False))
    return joined.withColumn("cyclic", cyclic).where("cyclic or (ru is null and rv is null)").select("g", "u", "v", "cyclic")


def _cyclic_in_small(edges: DataFrame) -> DataFrame:
    """The same for graphs of a few edges, each looked at in a row: what an edge leads to leads back to it."""
    reached = """aggregate(sequence(1, size(es)), array(e.v), (acc, i) ->
        array_union(acc, transform(filter(es, x -> array_contains(acc, x.u)), x -> x.v)))"""
    return (
        edges.where("u is not null and v is not null")
        .groupBy("g")
        .agg(F.collect_list(F.struct("u", "v")).alias("es"))
        .selectExpr("g", f"inline(filter(es, e -> array_contains({reached}, e.u)))")
    )


def cyclic_edges(edges: DataFrame, *, small: int = _SMALL) -> DataFrame:
    """The distinct edges (g, u, v) that lie on a directed cycle of their graph ``g``.

    Graphs of at most ``small`` edges are decided at once, the others in rounds. Rake and compress: edges to or from dead ends go, and chains become one edge, so trees
    and paths vanish in a number of rounds that grows with the logarithm of their size. What neither
    changes is coloured, which settles the component of every colour's root. An edge of a
    chain is on a cycle if the edge that stands for the chain is. Copies of an edge
    collapse first; an edge from a node to itself is a cycle. All graphs proceed together.
    """
    left = materialise(edges.select("g", "u", "v").distinct())
    large = materialise(left.groupBy("g").count().where(F.col("g").isNull() | (F.col("count") > small)).select("g"))
    decided = _cyclic_in_small(left.where("g is not null").join(large, "g", "left_anti"))
    if large.isEmpty():
        return decided
    return decided.unionByName(_cyclic_in_rounds(left.join(large, left["g"].eqNullSafe(large["g"]), "left_semi")))


def _cyclic_in_rounds(left: DataFrame) -> DataFrame:
    found, levels = [], []  # cyclic edges of each level, and its edges with those of the next
    while not left.isEmpty():
        loops, rest = left.where("u = v"), left.where("u <> v")
        level = _compressed(rest)
        cyclic, level = loops.unionByName(level.where("start is null").select("g", "u", "v")), level.where("start is not null")
        following = materialise(level.select("g", F.col("start").alias("u"), F.col("stop").alias("v")).distinct())
        if not following.isEmpty() and following.count() == left.count():
            coloured = materialise(_components_of_colours(following))
            cyclic = cyclic.unionByName(coloured.where("cyclic").select("g", "u", "v"))
            level = coloured.where("not cyclic").select("g", "u", "v", F.col("u").alias("start"), F.col("v").alias("stop"))
            following = level.select("g", "u", "v")
        found.append(cyclic)
        levels.append(level)
        left = following
    if not found:
        return left
    out = found.pop()
    levels.pop()
    while found:
        beyond = out.select("g", F.col("u").alias("start"), F.col("v").alias("stop"))
        within = levels.pop().join(beyond, ["g", "start", "stop"], "left_semi").select("g", "u", "v")
        out = found.pop().unionByName(within)
    return out
