"""Boundary loops, hole filling and decimation against plain versions on small meshes."""

from collections import Counter, defaultdict

import pytest

from aerolith.operators import surfaces

FACE, VERTEX = "fid long, i0 long, i1 long, i2 long", "vid long, x double, y double, z double"


def grid(across, down, missing=(), pitch=0.5):
    at = lambda c, r: r * across + c
    vertices = [(at(c, r), c * pitch, r * pitch, ((c * 7 + r * 13) % 10) / 50) for r in range(down) for c in range(across) if (c, r) not in missing]
    faces = []
    for r in range(down - 1):
        for c in range(across - 1):
            if not {(c, r), (c + 1, r), (c, r + 1), (c + 1, r + 1)} & set(missing):
                faces += [(at(c, r), at(c + 1, r), at(c + 1, r + 1)), (at(c, r), at(c + 1, r + 1), at(c, r + 1))]
    return [(k, *f) for k, f in enumerate(faces)], vertices


def sides(faces):
    return [(f[k], f[1 + k % 3]) for f in faces for k in (1, 2, 3)]


def plain_loops(faces):
    every = set(sides(faces))
    third = {(f[k], f[1 + k % 3]): f[1 + (k + 1) % 3] for f in faces for k in (1, 2, 3)}
    border = {s for s in every if s[::-1] not in every}

    def follow(s):
        v, at = s[1], third[s]
        while (v, at) not in border:
            at = third[at, v]
        return v, at

    out, left = set(), set(border)
    while left:
        s = min(left)
        loop = [s]
        while (n := follow(loop[-1])) != s:
            loop.append(n)
        left -= set(loop)
        out.update((*s, k, len(loop), *x) for k, x in enumerate(loop))
    return out


def edge_counts(faces):
    return Counter(tuple(sorted(s)) for s in sides(faces))


@pytest.fixture(scope="module")
def holed():
    # a hole of one vertex, one of two, one that is too wide, and two that touch at a corner
    return grid(16, 14, {(3, 3), (7, 3), (8, 3), (11, 2), (12, 3), (3, 9), *((c, r) for c in range(8, 13) for r in range(8, 12))})


def test_loops_and_fans(spark, holed):
    faces, vertices = holed
    f, v = spark.createDataFrame(faces, FACE), spark.createDataFrame(vertices, VERTEX)
    want = plain_loops(faces)
    assert {tuple(r) for r in surfaces.boundary_loops(f).collect()} == want
    by_loop = defaultdict(dict)
    for u, w, place, length, a, _ in want:
        by_loop[u, w, length][place] = a
    at = {p[0]: p[1:] for p in vertices}
    fans = set()
    for (u, w, length), ring in by_loop.items():
        points = [at[a] for a in ring.values()]
        wide = max(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for p in points for q in points) ** 0.5
        if 3 <= length <= 24 and wide <= 2:
            fans.update((u, w, k, ring[0], ring[k + 1], ring[k]) for k in range(1, length - 1))
    got = {tuple(r) for r in surfaces.fill_holes(f, v).collect()}
    assert got == fans and len({x[:2] for x in got}) >= 3
    whole = set(sides(faces))
    new = sides([(0, *x[3:]) for x in got])
    assert not whole & set(new)  # the new faces run the other way
    assert len(plain_loops(faces)) > len({s for s in whole | set(new) if s[::-1] not in whole | set(new)})


def test_closed_and_empty_meshes_have_no_loops(spark):
    tetrahedron = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 3, 1), (3, 1, 3, 2)], FACE)
    assert surfaces.boundary_loops(tetrahedron).collect() == []
    assert surfaces.boundary_loops(tetrahedron.limit(0)).collect() == []
    single = spark.createDataFrame([(0, 5, 6, 7)], FACE)
    assert {tuple(r) for r in surfaces.boundary_loops(single).collect()} == {(5, 6, 0, 3, 5, 6), (5, 6, 1, 3, 6, 7), (5, 6, 2, 3, 7, 5)}


def euler(faces):
    return len({i for f in faces for i in f[1:]}) - len(edge_counts(faces)) + len(faces)


def test_decimation_keeps_the_surface(spark, holed):
    faces, vertices = holed
    f = spark.createDataFrame(faces, FACE).selectExpr("*", "fid % 3 AS cls")
    target = round(len(faces) * 0.35)
    small, points = surfaces.decimate(f, spark.createDataFrame(vertices, VERTEX), target, ("cls",))
    rows = [tuple(r) for r in small.collect()]
    left = [r[:4] for r in rows]
    assert abs(len(left) - target) <= max(2, 0.05 * target)
    assert set(edge_counts(left).values()) <= {1, 2}
    assert all(r[4] == r[0] % 3 for r in rows) and {r[0] for r in rows} <= {x[0] for x in faces}
    assert {r["vid"] for r in points.collect()} == {i for x in left for i in x[1:]}
    assert euler(left) == euler(faces)  # no hole closed, none made, nothing torn
    low = [min(v[k] for v in vertices) for k in (1, 2, 3)]
    high = [max(v[k] for v in vertices) for k in (1, 2, 3)]
    assert all(low[k] <= r[k + 1] <= high[k] for r in points.collect() for k in range(3))


def test_independent_edges_have_nothing_in_common(spark):
    from aerolith.operators.meshes import with_corners
    from aerolith.operators.scratch import Workspace

    faces, vertices = grid(14, 14)
    near = defaultdict(set)
    for a, b in sides(faces):
        near[a].add(b)
        near[b].add(a)
    with Workspace(spark) as w:
        placed = w.cut(with_corners(spark.createDataFrame(faces, FACE), spark.createDataFrame(vertices, VERTEX)), "placed")
        good, links = surfaces._collapsible(placed, w)
        border = {v for e, n in edge_counts(faces).items() if n == 1 for v in e}
        allowed = {e for e, n in edge_counts(faces).items() if len(near[e[0]] & near[e[1]]) == n and (n == 1 or not set(e) <= border)}
        assert {(r["a"], r["b"]) for r in good.collect()} == allowed
        chosen = [(r["a"], r["b"]) for r in surfaces._independent(good, links, w).collect()]
    assert len(chosen) >= 12
    for i, e in enumerate(chosen):
        for o in chosen[:i]:
            assert not set(e) & set(o) and not (near[e[0]] | near[e[1]]) & set(o)


def test_a_tetrahedron_is_left_as_it_is(spark):
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 3, 1), (3, 1, 3, 2)], FACE)
    v = spark.createDataFrame([(i, float(i == 1), float(i == 2), float(i == 3)) for i in range(4)], VERTEX)
    assert surfaces.decimate(f, v, 4)[0].count() == 4
    assert surfaces.level_report(surfaces.levels_of_detail(f, v)).select("faces").collect() == [(4,)] * 3


def test_atlas_of_large_and_degenerate_faces(spark, monkeypatch):
    from aerolith.operators import textures

    rng = __import__("random").Random(3)
    size = 40
    vertices = [(i, float(rng.randrange(size)), float(rng.randrange(size)), 0.0, rng.randrange(256), rng.randrange(256), rng.randrange(256)) for i in range(12)]
    vertices += [(100, 0.0, 0.0, 0.0, 1, 2, 3), (101, size - 1.0, size - 1.0, 0.0, 1, 2, 3)]
    faces = [(k, *rng.sample(range(12), 3), bool(k % 2)) for k in range(9)] + [(20, 3, 3, 4, False), (21, 5, 5, 5, True), (22, 0, 1, 77, True)]
    at = {v[0]: v for v in vertices}
    want = {(v, u): (160, 160, 160, 220) for v in range(size) for u in range(size)}
    for _, *corners, inferred in sorted(faces):
        if all(c in at for c in corners):
            p = [(int(at[c][1]), int(at[c][2])) for c in corners]
            colour = tuple(sum(at[c][4 + k] for c in corners) // 3 for k in range(3))
            for v in range(min(y for _, y in p), max(y for _, y in p) + 1):
                for u in range(min(x for x, _ in p), max(x for x, _ in p) + 1):
                    s = [(p[(k + 1) % 3][0] - p[k][0]) * (v - p[k][1]) - (p[(k + 1) % 3][1] - p[k][1]) * (u - p[k][0]) for k in range(3)]
                    if min(s) >= 0 or max(s) <= 0:
                        want[v, u] = (*colour, 80 if inferred else 240)
    f = spark.createDataFrame(faces, FACE + ", inferred boolean")
    v = spark.createDataFrame(vertices, VERTEX + ", r int, g int, b int")
    for square in (64, 7):
        monkeypatch.setattr(textures, "SQUARE", square)
        assert {(r["v"], r["u"]): tuple(r)[2:] for r in textures.bake(f, v, size).collect()} == want
