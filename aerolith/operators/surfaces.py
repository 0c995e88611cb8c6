"""Boundary loops, hole filling and decimation of meshes of any size: rounds of joins, in which no task or group holds a mesh.

Faces are (fid, i0, i1, i2) with distinct corners, vertices (vid, x, y, z). A half-edge is a side of a face in its own
direction; where no face has the opposite one it is a boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.operators.meshes import edge_kinds, with_corners
from aerolith.operators.patches import collapsed, pitch
from aerolith.operators.scratch import Workspace

#: Holes of this many vertices and this diameter are filled; shares of faces of the levels of detail; the fewest faces of one.
HOLE_VERTICES = (3, 24)
HOLE_DIAMETER = 2.0
RATIOS = (0.35, 0.10)
FEWEST_FACES = 4
#: The share of faces above the target that may stay, and the share of those to go that a round within patches must remove to be followed by another.
SLACK = 0.005
LEAST_PROGRESS = 0.1
_AXES = ("x", "y", "z")


def half_edges(faces: DataFrame) -> DataFrame:
    """u, v, w (the third corner), fid; a side that several faces have in one direction is left out."""
    sides = F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v"), F.col(r).alias("w")) for p, q, r in (("i0", "i1", "i2"), ("i1", "i2", "i0"), ("i2", "i0", "i1"))])
    rows = faces.select("fid", F.explode(sides).alias("s")).select("s.u", "s.v", "s.w", "fid")
    return rows.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w"), F.max("fid").alias("fid")).filter("n = 1").drop("n")


def _boundary_next(sides: DataFrame, w: Workspace) -> DataFrame:
    """u, v, nu, nv: the boundary side that follows each boundary side, around the corner of the faces at v.

    From the next side of its own face one turns about v across shared sides until one isn't shared; turns are
    doubled, so that a vertex of d faces takes log d rounds.
    """
    twins = sides.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("w").alias("turn"))
    turned = sides.join(twins, ["u", "v"], "left")
    border = w.cut(turned.filter("turn is null").select("u", "v", "w"), "border")
    around = border.select(F.col("v").alias("c")).distinct()
    spokes = w.cut(turned.select(F.col("u").alias("c"), F.col("v").alias("at"), F.coalesce("turn", "v").alias("to"), F.col("turn").isNull().alias("ends")).join(around, "c"), "spokes")
    while not spokes.filter("not ends").isEmpty():
        on = spokes.select("c", F.col("at").alias("to"), F.col("to").alias("far"), F.col("ends").alias("far_ends"))
        step = spokes.filter("not ends").join(on, ["c", "to"])
        step = step.filter("far <> at or far_ends").select("c", "at", F.col("far").alias("to"), F.col("far_ends").alias("ends"))  # a full turn never ends
        spokes = w.cut(spokes.filter("ends").unionByName(step), "spokes")
    ends = spokes.select(F.col("c").alias("v"), F.col("at").alias("w"), F.col("to").alias("nv"))
    return border.join(ends, ["v", "w"]).select("u", "v", F.col("v").alias("nu"), "nv")


def boundary_loops(faces: DataFrame) -> DataFrame:
    """loop_u, loop_v, place, length, u, v for each boundary side of a closed loop, written.

    A loop is named by its least side, which has place 0. The least side of a loop and the distance to its end are found by pointer
    doubling: 2^k sides are known after k rounds, so that a boundary of a billion sides takes some thirty.
    """
    with Workspace(faces.sparkSession) as w:
        sides = w.cut(half_edges(faces), "sides")
        follow = w.cut(_boundary_next(sides, w).select(F.struct("u", "v").alias("h"), F.struct(F.col("nu").alias("u"), F.col("nv").alias("v")).alias("to")), "follow")
        if follow.isEmpty():
            none = faces.sparkSession.createDataFrame([], "loop_u long, loop_v long, place long, length long, u long, v long")
            return w.keep(none, "loops")
        state = follow.select("h", "to", F.least("h", "to").alias("least"))
        while True:
            ahead = state.select(F.col("h").alias("to"), F.col("to").alias("far"), F.col("least").alias("far_least"))
            moved = state.join(ahead, "to").select("h", F.col("far").alias("to"), F.least("least", "far_least").alias("new"), (F.col("far_least") < F.col("least")).alias("changed"))
            moved = w.cut(moved, "least")
            state = moved.select("h", "to", F.col("new").alias("least"))
            if moved.filter("changed").isEmpty():
                break
        named = follow.join(state.select("h", "least"), "h")
        rank = w.cut(named.select("h", "least", F.when(F.col("to") == F.col("least"), F.lit(None)).otherwise(F.col("to")).alias("to"), F.when(F.col("to") == F.col("least"), 0).otherwise(1).cast("long").alias("left")), "rank")
        while not rank.filter("to is not null").isEmpty():
            ahead = rank.select(F.col("h").alias("to"), F.col("to").alias("far"), F.col("left").alias("more"))
            rank = w.cut(rank.join(ahead, "to", "left").select("h", "least", F.col("far").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "rank")
        lengths = rank.groupBy("least").agg(F.count(F.lit(1)).alias("length"))
        rows = rank.join(lengths, "least")
        out = rows.select(F.col("least.u").alias("loop_u"), F.col("least.v").alias("loop_v"), (F.col("length") - 1 - F.col("left")).alias("place"), "length", "h.u", "h.v")
        return w.keep(out, "loops")


def fill_holes(faces: DataFrame, vertices: DataFrame, sizes: tuple[int, int] = HOLE_VERTICES, widest: float = HOLE_DIAMETER) -> DataFrame:
    """loop_u, loop_v, k, i0, i1, i2: fans about the first vertex of each loop of so many vertices and at most this diameter.

    The new faces run against the loop, as the mesh does on its other side. A loop is gathered only once it is
    known to be short.
    """
    loops = boundary_loops(faces).filter(F.col("length").between(*sizes))
    points = loops.join(vertices.select(F.col("vid").alias("u"), *_AXES), "u")
    rings = points.groupBy("loop_u", "loop_v", "length").agg(F.array_sort(F.collect_list(F.struct("place", "u", *_AXES))).alias("ring")).filter(F.size("ring") == F.col("length"))

    def apart(a: Column, b: Column) -> Column:
        return F.sqrt(sum((F.pow(a[c] - b[c], 2) for c in _AXES[1:]), F.pow(a["x"] - b["x"], 2)))

    wide = F.array_max(F.transform("ring", lambda a: F.array_max(F.transform("ring", lambda b: apart(a, b)))))
    rows = rings.filter(wide <= widest).select("loop_u", "loop_v", "ring", F.explode(F.expr("sequence(1L, length - 2)")).alias("k"))
    return rows.select("loop_u", "loop_v", "k", *[F.expr(f"ring[cast({at} as int)].u").alias(c) for c, at in (("i0", "0"), ("i1", "k + 1"), ("i2", "k"))])


def _collapsible(faces: DataFrame, w: Workspace) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, pa, pb, length) that may collapse without making a non-manifold edge, and the links (v, x) of all edges, both ways.

    The ends may share no neighbours but the corners opposite the edge, and may not both lie on the boundary unless the edge does.
    Shared neighbours are searched from the end with fewer of them, so that a hub isn't unfolded for each of its edges.
    """
    corners = [F.struct(F.col(f"i{k}").alias("v"), F.col(f"p{k}").alias("p")) for k in range(3)]
    ends = [F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in ((corners[0], corners[1]), (corners[1], corners[2]), (corners[2], corners[0]))]
    rows = faces.select(F.explode(F.array(*ends)).alias("e")).groupBy(F.col("e.a.v").alias("a"), F.col("e.b.v").alias("b"))
    sides = w.cut(rows.agg(F.count(F.lit(1)).alias("n"), F.min("e.a.p").alias("pa"), F.min("e.b.p").alias("pb")), "edges")
    links = sides.select("n", F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("x")), F.struct(F.col("b").alias("v"), F.col("a").alias("x")))).alias("l")).select("l.v", "l.x", "n")
    info = links.groupBy("v").agg(F.count(F.lit(1)).alias("degree"), F.max((F.col("n") == 1).cast("int")).alias("border"), F.max((F.col("n") > 2).cast("int")).alias("odd"))
    rows = sides.filter("n <= 2")
    for c in "ab":
        rows = rows.join(info.select(F.col("v").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("degree", "border", "odd")]), c)
    rows = rows.filter("odd_a = 0 and odd_b = 0 and (border_a = 0 or border_b = 0 or n = 1)")
    length = F.sqrt(sum((F.pow(F.col("pa")[c] - F.col("pb")[c], 2) for c in _AXES[1:]), F.pow(F.col("pa.x") - F.col("pb.x"), 2)))
    less = F.struct("degree_a", "a") <= F.struct("degree_b", "b")
    rows = rows.select("a", "b", "n", "pa", "pb", length.alias("length"), F.when(less, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("many"))
    shared = rows.join(links.select(F.col("v").alias("few"), "x"), "few").join(links.select(F.col("v").alias("many"), "x"), ["many", "x"])
    good = shared.groupBy("a", "b", "pa", "pb", "length", "n").agg(F.count(F.lit(1)).alias("both")).filter("both = n").select("a", "b", "pa", "pb", "length")
    return w.cut(good, "good"), links.select("v", "x")


def _independent(good: DataFrame, links: DataFrame, w: Workspace, passes: int = 2) -> DataFrame:
    """Edges no two of which touch or have ends that do: those of which every other at their ends or at a neighbour of their ends is
    longer, and again, without what touches them."""
    cost = F.struct("length", F.xxhash64("a", "b").alias("h"), "a", "b", "pa", "pb")
    chosen = None
    for _ in range(passes):
        ends = good.select(F.explode(F.array("a", "b")).alias("v"), cost.alias("cost")).groupBy("v").agg(F.min("cost").alias("cost"))
        near = links.join(ends.withColumnRenamed("v", "x"), "x").select("v", "cost").unionByName(ends).groupBy("v").agg(F.min("cost").alias("cost"))
        least = near.filter("v = cost.a or v = cost.b").groupBy("cost").agg(F.count(F.lit(1)).alias("k")).filter("k = 2")
        found = w.cut(least.select("cost.a", "cost.b", "cost.pa", "cost.pb", "cost.length"), "independent")
        chosen = found if chosen is None else chosen.unionByName(found)
        taken = found.select(F.explode(F.array("a", "b")).alias("x"))
        taken = taken.join(links, "x").select("v").unionByName(taken.toDF("v")).distinct()
        for c in "ab":
            good = good.join(taken.toDF(c), c, "left_anti")
    return chosen


def _cheapest(chosen: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the chosen edges, the shortest: a quantile of lengths, with ties drawn by hash."""
    total = chosen.count()
    if total <= most:
        return chosen
    cut = chosen.agg(F.percentile_approx("length", min(1.0, most / total), 100_000)).first()[0]
    below, at = chosen.agg(F.count_if(F.col("length") < cut), F.count_if(F.col("length") == cut)).first()
    draw = F.pmod(F.xxhash64("a", "b", F.lit("tie")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return chosen.filter((F.col("length") < cut) | ((F.col("length") == cut) & (draw < max(most - below, 1) / max(at, 1))))


def decimate(faces: DataFrame, vertices: DataFrame, target: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """faces (fid, i0, i1, i2, carry) and vertices with about ``target`` faces left, written; the mesh itself if it has no more.

    Rounds of edge collapses to midpoints. First every patch of a shifting grid takes its share of the shortest edges inside it, each round
    one shuffle. What is left when patches get no further goes by joins by vertex or edge: in a round an edge collapses if it is the shortest
    within two rings of its ends, so that collapses don't meet and no edge gets a third face. It ends
    early if no edge may collapse. A face keeps its fid and what is carried; one with a missing vertex goes.
    """
    with Workspace(faces.sparkSession) as w:
        placed = with_corners(faces.select("fid", "i0", "i1", "i2", *carry), vertices)
        placed = w.cut(placed, "faces")
        count = placed.count()
        size, turn = pitch(placed) if count > target >= FEWEST_FACES else None, 0
        while size and count > target * (1 + SLACK):
            placed = w.cut(collapsed(placed, target, count, size, turn), "faces")
            before, count, turn = count, placed.count(), turn + 1
            if before - count < (before - target) * LEAST_PROGRESS:
                break
        while count > target * (1 + SLACK) and target >= FEWEST_FACES:
            with Workspace(faces.sparkSession) as v:
                good, links = _collapsible(placed, v)
                chosen = _cheapest(_independent(good, links, v), max(1, (count - target + 1) // 2))
                middle = F.named_struct(*[x for c in _AXES for x in (F.lit(c), (F.col("pa")[c] + F.col("pb")[c]) / 2)])
                moves = v.cut(chosen.select(F.explode(F.array("a", "b")).alias("old"), F.named_struct(F.lit("v"), F.col("a"), F.lit("p"), middle).alias("new")), "moves")
                if moves.isEmpty():
                    break
                moved = placed
                for k in range(3):
                    moved = moved.join(moves.select(F.col("old").alias(f"i{k}"), F.col("new").alias(f"new{k}")), f"i{k}", "left")
                    moved = moved.withColumns({f"i{k}": F.coalesce(f"new{k}.v", f"i{k}"), f"p{k}": F.coalesce(f"new{k}.p", f"p{k}")}).drop(f"new{k}")
                placed = w.cut(moved.filter("i0 <> i1 and i1 <> i2 and i2 <> i0").select(*placed.columns), "faces")
            count = placed.count()
        corners = F.array(*[F.struct(F.col(f"i{k}").alias("vid"), F.col(f"p{k}").alias("p")) for k in range(3)])
        used = placed.select(F.explode(corners).alias("c")).groupBy("c.vid").agg(F.min("c.p").alias("p")).select("vid", *[F.col("p")[c].alias(c) for c in _AXES])
        return w.keep(placed.drop("p0", "p1", "p2").select("fid", "i0", "i1", "i2", *carry), "decimated"), w.keep(used, "decimated")


def levels_of_detail(faces: DataFrame, vertices: DataFrame, ratios: tuple[float, ...] = RATIOS) -> list[tuple[DataFrame, DataFrame]]:
    """The mesh and its coarser levels, each made from the one before: faces and vertices of each."""
    total = faces.count()
    levels = [(faces, vertices)]
    for ratio in ratios:
        levels.append(decimate(*levels[-1], max(FEWEST_FACES, round(total * ratio))))
    return levels


def level_report(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """level, faces, vertices, ratio (of the faces of level 0), boundary and non_manifold edges of each level."""
    out = None
    for k, (faces, vertices) in enumerate(levels):
        kinds = edge_kinds(faces).agg(F.count_if(F.col("kind") == "boundary").alias("boundary"), F.count_if(F.col("kind") == "non-manifold").alias("non_manifold"))
        row = faces.agg(F.count(F.lit(1)).alias("faces")).crossJoin(F.broadcast(vertices.agg(F.count(F.lit(1)).alias("vertices")))).crossJoin(F.broadcast(kinds)).withColumn("level", F.lit(k))
        out = row if out is None else out.unionByName(row)
    first = levels[0][0].agg(F.count(F.lit(1)).alias("whole"))
    ratio = F.when(F.col("whole") > 0, F.col("faces") / F.col("whole")).otherwise(0.0)
    return out.crossJoin(F.broadcast(first)).select("level", "faces", "vertices", ratio.alias("ratio"), "boundary", "non_manifold")
