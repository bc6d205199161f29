"""Orders, pivots, walks, floods, communities and layouts against plain versions of themselves."""

import collections
import itertools
import math
import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.operators import clusters, field, layout, neighbors, pivots, pseudotime, walks
from trellis.plans import order
from trellis.plans.scratch import Scratch


def scratch(spark):
    return Scratch(spark, f"test-{uuid.uuid4().hex}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# order ---------------------------------------------------------------------------------------------


@pytest.fixture
def parted(spark):
    """Small tables stay in several partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_global_order_equals_sorting(spark, parted):
    rng = random.Random(1)
    rows = [(i, rng.choice([0.5, 1.0, 2.0, rng.random()]), rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, x double, v double").repartition(7)
    r = order.ranked(df, [F.desc("x"), "k"], scratch(spark))
    want = sorted(rows, key=lambda t: (-t[1], t[0]))
    assert [(t.k, t["rank"]) for t in r.orderBy("rank").collect()] == [(t[0], i + 1) for i, t in enumerate(want)]
    assert r.select("part").distinct().count() > 1
    v = np.array([t[2] for t in want])
    for how, reverse, plain in (("sum", False, np.cumsum(v)), ("max", False, np.maximum.accumulate(v)), ("min", True, np.minimum.accumulate(v[::-1])[::-1])):
        out = order.running(r, F.col("v"), how, "y", reverse)
        assert np.allclose([t.y for t in out.orderBy("rank").collect()], plain)
        # every window has a key: none gathers all rows
        assert all("windowspecdefinition(part" in w for w in plan(out).split("Window [")[1:])
    s = order.shifted(r, 3, {"v": "next"}).orderBy("rank").collect()
    assert [t.next for t in s] == [*v[3:], None, None, None]
    assert abs(order.quantile(df, "x", 0.75, scratch(spark)) - np.quantile([t[1] for t in rows], 0.75)) < 1e-12
    assert order.quantile(df.limit(0), "x", 0.75, scratch(spark)) is None
    assert order.ranked(df.limit(0), ["x"], scratch(spark)).count() == 0


# pivots --------------------------------------------------------------------------------------------


def clustered(n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 10, (12, d))
    x = centers[rng.integers(12, size=n)] + rng.normal(0, 1, (n, d))
    x = np.concatenate([x, np.repeat(x[:1], copies, axis=0)])
    return np.round(x, 3)


@pytest.mark.parametrize("copies", [0, 120])
def test_neighbors_by_pivots_equal_all_pairs(spark, copies, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 50)
    monkeypatch.setattr(pivots, "FEW", 0)
    x = clustered(600, 3, 5, copies)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [1.0])], "cell long, vec array<double>")
    found, index = pivots.knn(df, 6, scratch(spark))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = collections.defaultdict(list)
    for r in found.orderBy("cell", "rank").collect():
        got[r.cell].append((round(r.dist, 9), r.nbr))
    want = {i: [(round(float(d[i, j]), 9), j) for j in sorted(range(len(x)), key=lambda j: (d[i, j], j))[:6]] for i in range(len(x))}
    assert got == want
    assert index.compared < 0.1 * len(x) ** 2
    monkeypatch.setattr(pivots, "FEW", 10_000)  # few rows are compared in blocks, with the same result
    again, index = pivots.knn(df, 6, scratch(spark))
    assert index is None and sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


def test_neighbors_of_few_and_no_rows(spark):
    none = spark.createDataFrame([], "cell string, vec array<double>")
    assert neighbors.knn_exact(none, 3, scratch(spark)).count() == 0
    three = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [-0.0])], "cell string, vec array<double>")
    assert {tuple(r) for r in neighbors.knn_exact(three, 5, scratch(spark)).collect()} == {("a", 1, "c", 0.0), ("a", 2, "b", 1.0), ("b", 1, "a", 1.0), ("b", 2, "c", 1.0), ("c", 1, "a", 0.0), ("c", 2, "b", 1.0)}


def test_tip_potential_by_pivots_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 64)
    x = clustered(500, 2, 6, 80)
    t = np.round(np.random.default_rng(1).random(len(x)), 2)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell long, vec array<double>")
    pt = spark.createDataFrame([(i, float(t[i])) for i in range(len(x))] + [(9999, None)], "cell long, pseudotime double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, -1)
    for low, high in ((2.0, 9.0), (0.0, 1.5)):
        got = {r.cell: r.tip_potential for r in pseudotime.tip_potential(v, pt, low, high, scratch(spark)).collect()}
        ok = (d >= low) & (d <= high)
        want = {i: float((t[ok[i]] <= t[i]).mean()) for i in range(len(x)) if ok[i].any()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_a_query_is_copied_once_a_block_not_once_a_home(spark, monkeypatch):
    """Vectors without structure far from the origin: every home must be visited."""
    monkeypatch.setattr(pivots, "BLOCK", 150)
    monkeypatch.setattr(pivots, "FEW", 0)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (450, 24)), 3) + 1000
    x[7::50] = x[7] + 0.001 * np.arange(9)[:, None]
    t = rng.random(len(x))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = d + np.diag(np.full(len(x), np.inf))
    v = spark.createDataFrame([(f"c{i:03}", r.tolist()) for i, r in enumerate(x)], "cell string, vec array<double>")

    def written(s):
        """The most rows of a table that was kept on the way."""
        folder = s.base.removeprefix("file://")
        return max(spark.read.parquet(f"file://{folder}/{name}").count() for name in os.listdir(folder))

    of = scratch(spark)
    found, index = pivots.knn(v, 5, of)
    got = collections.defaultdict(list)
    for r in found.orderBy("cell", "rank").collect():
        got[r.cell].append(r.nbr)
    assert got == {f"c{i:03}": [f"c{j:03}" for j in sorted(range(len(x)), key=lambda j: (near[i, j], j))[:5]] for i in range(len(x))}
    assert len(index.size) > 40 and index.compared > 0.9 * len(x) ** 2 and written(of) <= 6 * len(x)
    of = scratch(spark)
    pt = spark.createDataFrame([(f"c{i:03}", float(t[i])) for i in range(len(x))], "cell string, pseudotime double")
    found = {r.cell: r.tip_potential for r in pseudotime.tip_potential(v, pt, 6.0, 7.0, of).collect()}
    ok = (near >= 6) & (near <= 7)
    want = {f"c{i:03}": float((t[ok[i]] <= t[i]).mean()) for i in range(len(x)) if ok[i].any()}
    assert found.keys() == want.keys() and all(abs(found[c] - want[c]) < 1e-12 for c in want) and written(of) <= 6 * len(x)


# walks and floods ----------------------------------------------------------------------------------


def test_walks_end_in_roots_and_repeat(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "b", 1.0), ("b", "a", 1.0), ("c", "dead", 0.0)], "i string, j string, w double")
    tips = spark.createDataFrame([("t", "c"), ("t", "nowhere")], "tip string, cell string")
    one, two = (sorted(map(tuple, walks.random_walks(e, tips, ["a"], 20, scratch(spark), block=b).collect())) for b in (100, 2))
    assert one == two and {w[1] for w in one} == set(range(20))  # the blocks change nothing
    for _, path in itertools.groupby(one, key=lambda w: w[1]):
        cells = [w[3] for w in path]
        assert cells[0] == "c" and cells[-1] == "a" and "a" not in cells[:-1]
        assert all({x, y} in ({"a", "b"}, {"b", "c"}) for x, y in zip(cells, cells[1:]))


def test_walks_visit_as_the_chain_says(spark, monkeypatch):
    monkeypatch.setattr(walks, "ROUND_STEPS", 6000)  # rounds that are full before a block is left
    rng = np.random.default_rng(2)
    n, per = 12, 3000
    w = {(i, j): float(rng.random()) * (4 if j < i else 1) for i in range(n) for j in range(n) if i != j and abs(i - j) < 4}
    e = spark.createDataFrame([(i, j, x) for (i, j), x in w.items()], "i int, j int, w double")
    p = np.zeros((n, n))
    for (i, j), x in w.items():
        p[i, j] = x
    p /= p.sum(1, keepdims=True)
    expected = np.linalg.inv(np.eye(n - 1) - p[1:, 1:])[n - 2]  # visits of cells 1.. from the last one until cell 0
    made = walks.random_walks(e, spark.createDataFrame([("t", n - 1)], "tip string, cell int"), [0], per, scratch(spark), order=spark.createDataFrame([(i, float(i)) for i in range(n)], "cell int, key double"), block=6)
    rows = made.collect()
    visits = np.bincount([r.cell for r in rows], minlength=n)
    assert visits[0] == per and len({(r.walk, r.pos) for r in rows}) == len(rows)
    assert np.abs(visits[1:] / per / expected - 1).max() < 0.1
    steps = sorted((r.walk, r.pos, r.cell) for r in rows)
    assert all((a[2], b[2]) in w and b[1] == a[1] + 1 for a, b in zip(steps, steps[1:]) if a[0] == b[0])


def test_walks_that_are_too_long_are_left_out(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)], "i int, j int, w double")
    tips = spark.createDataFrame([(1, 0), (2, 20)], "tip int, cell int")
    made = walks.random_walks(e, tips, [30], 3, scratch(spark), max_steps=15, block=4).collect()
    assert {r.tip for r in made} == {2} and len(made) == 3 * 11
    assert walks.random_walks(e, tips, [5], 3, scratch(spark), block=4).where("tip = 2").count() == 0  # it ends where no way goes on


def test_flood_goes_against_the_edges_to_the_visited(spark):
    # cell i is reached from a visited j by the edge (i, j)
    e = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), (0, 3, 1.0), (4, 4, 1.0)], "i int, j int, w double")
    got = {(r.cell, r.step) for r in pseudotime.flood(e, [0], 2, scratch(spark), least_new=1).collect()}
    assert got == {(0, 0), (1, 1), (2, 2)}


def test_flood_has_no_limit_of_steps_and_the_right_chances(spark):
    e = spark.createDataFrame([(i, i - 1, 1.0) for i in range(1, 40)], "i int, j int, w double")
    got = {(r.cell, r.step) for r in pseudotime.flood(e, [0], 1, scratch(spark), least_new=1).collect()}
    assert got == {(i, i) for i in range(39)}  # all but one
    e = spark.createDataFrame([(2, 0, 0.5), (2, 1, 0.4), (3, 0, 0.1), (4, 3, 1.0), (5, 5, 0.1)], "i int, j int, w double")
    roots = spark.createDataFrame([(0,), (1,)], "cell int")
    assert {r.cell: round(r.chance, 12) for r in pseudotime.flood_chances(e, roots).collect()} == {2: 0.7, 3: 0.1}
    first = pseudotime.flood(e, [0, 1], 4000, scratch(spark)).where("step = 1").groupBy("cell").count()
    assert {r.cell: r["count"] / 4000 for r in first.collect()} == pytest.approx({2: 0.7, 3: 0.1}, abs=0.04)


# communities ---------------------------------------------------------------------------------------


def sequential(edges, seed=1):
    """Modularity moves one node at a time, level by level."""
    graph = collections.defaultdict(lambda: collections.defaultdict(float))
    for a, b, w in edges:
        graph[a][b] += w
        graph[b][a] += w
    graph = {v: dict(g) for v, g in graph.items()}
    member = {v: v for v in graph}
    rng = random.Random(seed)
    while True:
        label, degree = {v: v for v in graph}, {v: sum(g.values()) for v, g in graph.items()}
        total, weight, changed, again = sum(degree.values()), dict(degree), False, True
        while again:
            again = False
            for v in rng.sample(sorted(graph), len(graph)):
                to = collections.defaultdict(float)
                for u, w in graph[v].items():
                    if u != v:
                        to[label[u]] += w
                own = label[v]
                weight[own] -= degree[v]
                gain = lambda c, v=v, to=to: to[c] - degree[v] * weight[c] / total
                best = max(sorted(to), key=gain, default=own)
                if gain(best) <= gain(own) + 1e-12:
                    best = own
                weight[best] += degree[v]
                if best != own:
                    label[v], again, changed = best, True, True
        if not changed:
            return member
        member = {v: label[c] for v, c in member.items()}
        merged = collections.defaultdict(lambda: collections.defaultdict(float))
        for v, g in graph.items():
            for u, w in g.items():
                merged[label[v]][label[u]] += w
        graph = {v: dict(g) for v, g in merged.items()}


def plain_quality(edges, of):
    m2 = 2 * sum(w for _, _, w in edges)
    d, inside, node = collections.Counter(), collections.Counter(), collections.Counter()
    for a, b, w in edges:
        for v in (a, b):
            d[of[v]] += w
            node[v] += w
        inside[of[a]] += 2 * w * (of[a] == of[b])
    h = lambda x: x * math.log2(x) if x > 1e-15 else 0.0
    q = {c: (d[c] - inside[c]) / m2 for c in d}
    return sum(inside[c] / m2 - (d[c] / m2) ** 2 for c in d), h(sum(q.values())) - 2 * sum(map(h, q.values())) - sum(h(x / m2) for x in node.values()) + sum(h(q[c] + d[c] / m2) for c in d)


def planted(groups, size, inside, between, seed):
    rng, n = random.Random(seed), groups * size
    return [(a, b, 1.0) for a in range(n) for b in range(a) if rng.random() < (inside if a // size == b // size else between)]


@pytest.mark.parametrize("method", ["modularity", "codelength"])
def test_communities_find_cliques(spark, method):
    rows = [(a, b, 1.0) for g in (range(5), range(5, 9)) for a in g for b in g if a < b] + [(0, 5, 0.1)]
    c = {r.cell: r.cluster for r in clusters.communities(spark.createDataFrame(rows, "a int, b int, w double"), scratch(spark), method).collect()}
    assert {c[i] for i in range(5)} == {1} and {c[i] for i in range(5, 9)} == {2}


def test_communities_are_as_good_as_sequential_ones(spark):
    edges = planted(6, 25, 0.35, 0.02, 3)
    df = spark.createDataFrame(edges, "a int, b int, w double")
    best = plain_quality(edges, sequential(edges))[0]
    got = clusters.communities(df, scratch(spark))
    of = {r.cell: r.cluster for r in got.collect()}
    mine = plain_quality(edges, of)
    assert mine[0] >= 0.98 * best
    assert len({tuple(sorted(v for v in of if of[v] == c)) for c in set(of.values())} & {tuple(range(25 * k, 25 * k + 25)) for k in range(6)}) >= 5
    stated = clusters.quality(df, got).first()
    assert abs(stated.modularity - mine[0]) < 1e-9 and abs(stated.codelength - mine[1]) < 1e-9 and stated.clusters == len(set(of.values()))


def test_communities_of_nothing_and_loops(spark):
    none = spark.createDataFrame([], "a int, b int, w double")
    assert clusters.communities(none, scratch(spark)).count() == 0
    one = spark.createDataFrame([(1, 1, 2.0), (2, 3, 1.0)], "a int, b int, w double")
    assert {(r.cell, r.cluster) for r in clusters.communities(one, scratch(spark)).collect()} == {(2, 1), (3, 1), (1, 2)}


# layout --------------------------------------------------------------------------------------------


def test_field_equals_adding_up_all_nodes():
    rng = np.random.default_rng(1)
    box = field.Box(9, (-1.0, -1.0), 2.0)
    mass = rng.random((9, 9))
    kernel = lambda x, y: x / (x * x + y * y + 0.1)
    got = box.convolve(mass, kernel)
    at = np.arange(9) * box.step
    want = [[sum(mass[k, m] * kernel(at[i] - at[k], at[j] - at[m]) for k in range(9) for m in range(9)) for j in range(9)] for i in range(9)]
    assert np.allclose(got, want)


def test_peeling_equals_plain_loop(spark):
    rng = random.Random(5)
    edges = [(a, b, rng.choice([0.0, 1.0, 2.0])) for a in range(40) for b in rng.sample(range(50), rng.randint(1, 5)) if a != b]
    now = list(edges)
    while True:
        k = collections.Counter(a for a, _, d in now if d > 0)
        if all(k[a] >= 3 for a, _, _ in now):
            break
        now = [e for e in now if k[e[0]] >= 3 and k[e[1]] >= 3]
    got = layout.peel(spark.createDataFrame(edges, "a int, b int, dist double"), 3, scratch(spark))
    assert sorted(map(tuple, got.collect())) == sorted(now)


def test_tree_distances(spark):
    joins = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("c", "d")], "parent string, child string")
    pairs = spark.createDataFrame([("d", "b"), ("d", "d"), ("r", "d"), ("a", "b"), ("x", "a")], "s string, t string")
    assert {(r.s, r.t): r.tree_dist for r in layout.tree_distance(joins, pairs, "s", "t").collect()} == {("d", "b"): 4, ("d", "d"): 0, ("r", "d"): 3, ("a", "b"): 2}


def test_force_layout_lowers_its_energy_and_repeats(spark):
    edges = planted(3, 12, 0.6, 0.02, 8)
    graph = layout.undirected(spark.createDataFrame(edges, "a int, b int, weight double"))
    begin = layout.start_places(graph)
    one = layout.force_layout(graph, scratch(spark), rounds=25)
    before, after = layout.energy(graph, begin), layout.energy(graph, one)
    assert after < before
    place = {r.cell: (r.x, r.y) for r in one.collect()}
    again = {r.cell: (r.x, r.y) for r in layout.force_layout(graph, scratch(spark), rounds=25).collect()}
    assert len(place) == 36 and all(np.allclose(place[c], again[c], atol=1e-6) for c in place)
    dist = lambda a, b: math.dist(place[a], place[b])
    near = np.mean([dist(a, b) for a in range(36) for b in range(a) if a // 12 == b // 12])
    far = np.mean([dist(a, b) for a in range(36) for b in range(a) if a // 12 != b // 12])
    assert far > 1.5 * near


def test_profiles_and_neighbor_times(spark):
    visits = spark.createDataFrame([("t", 1, 3.0), ("u", 1, 1.0), ("t", 2, 3.0), ("u", 2, 1.0), ("t", 3, 0.1), ("t", 4, 5.0)], "tip string, cell int, v double")
    pt = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.2), (4, None), (5, 2.0)], "cell int, pseudotime double")
    got = {r.cell: [round(x, 6) for x in r.vec] for r in layout.visit_profiles(visits, pt).collect()}
    assert got == {1: [round(3 / 4.5, 6), round(1 / 4.5, 6), round(0.5 / 4.5, 6)], 5: [0.0, 0.0, 1.0]}
    knn = spark.createDataFrame([(1, 2, 0.0), (1, 3, 0.5), (1, 5, 1.0)], "cell int, nbr int, dist double")
    # at distance zero the weight is that of all others, two and one
    assert abs(layout.neighbor_time(knn, pt).first().neighbor_pt - (3 * 0.5 + 2 * 0.2 + 1 * 2.0) / 6) < 1e-12
