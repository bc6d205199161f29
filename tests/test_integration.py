"""Embedding, batches, mixtures, dips, trees as a whole, and small operators, against plain versions."""

import collections
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.functions import stats
from trellis.operators import curves, embed, expression, integrate, neighbors, stages, tree, views
from trellis.plans.scratch import Scratch
from trellis.sources import ingest


def scratch(spark):
    return Scratch(spark, f"test-{uuid.uuid4().hex}")


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "cell long, vec array<double>")


# embedding -----------------------------------------------------------------------------------------


def test_embedding_keeps_planted_groups_apart(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 8, (3, 5))
    x = centers[np.repeat(np.arange(3), 20)] + rng.normal(0, 1, (60, 5))
    knn = scratch(spark).table(neighbors.knn_exact(frame(spark, x), 15, scratch(spark)), "knn")
    p = scratch(spark).table(embed.affinities(knn, 6.0), "p")
    assert abs(p.agg(F.sum("p")).first()[0] - 1) < 1e-9
    # the perplexity is met
    beta = {r.cell: r.beta for r in embed.precisions(knn, 6.0).collect()}
    d2 = collections.defaultdict(list)
    for r in knn.collect():
        d2[r.cell].append(r.dist**2)
    for c, d in d2.items():
        w = np.exp(-beta[c] * (np.array(d) - min(d)))
        w /= w.sum()
        assert abs(math.exp(-(w * np.log(w)).sum()) - 6) < 1e-6
    early = embed.tsne(p, scratch(spark), rounds=1)
    late = embed.tsne(p, scratch(spark), rounds=30)
    assert embed.divergence(p, late) < 0.7 * embed.divergence(p, early)
    y = np.array([[r.x, r.y] for r in late.orderBy("cell").collect()])
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(2))
    nearest = np.argsort(d + np.eye(60) * 1e9, axis=1)[:, :5] // 20
    assert (nearest == np.arange(60)[:, None] // 20).mean() > 0.95


def test_width_of_the_kernel(spark):
    knn = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (2, 1, 1.0), (2, 3, 2.5), (3, 1, 2.0), (3, 2, 2.5)], "cell int, nbr int, dist double")
    rows = neighbors.kernel_sweep(knn, 9).orderBy("step").collect()
    d = {1: [1, 2], 2: [1, 2.5], 3: [2, 2.5]}
    plain = [np.mean([math.log10(1 + sum(math.exp(-v * v / (2 * r.sigma**2)) for v in x)) for x in d.values()]) for r in rows]
    assert np.allclose([r.mean_log for r in rows], plain) and sum(r.chosen for r in rows) == 1
    k = int(np.argmax(np.diff(plain)))
    assert rows[k].chosen and abs(neighbors.optimal_sigma(knn, 9) - math.sqrt(rows[k].sigma * rows[k + 1].sigma)) < 1e-12
    assert neighbors.optimal_sigma(knn.limit(0)) is None
    assert [neighbors.neighbors_for(n) for n in (1, 50, 1000, 10_000, 50_000)] == [1, 49, 999, 100, 500]
    assert 100 < neighbors.neighbors_for(3000) < 999


# dips ----------------------------------------------------------------------------------------------


def unimodal_within(u, lo, hi, d):
    """Whether a function that is convex up to some step and concave from there on stays within d of the steps: by
    the least value a convex one can end with and the largest a concave one can begin with."""

    def ends(u, lo, hi):
        out = []
        for m in range(len(u)):
            ok = all(hi[b] - d <= lo[b] + d + 1e-12 for b in range(m))
            ok &= all(hi[b] - d <= lo[a] + d + (lo[c] - lo[a]) * (u[b] - u[a]) / (u[c] - u[a]) + 1e-12 for a in range(m) for b in range(a + 1, m) for c in range(b + 1, m + 1))
            v = max([lo[m] - d] + [hi[k] - d for k in range(m)] + [hi[k] - d + (hi[k] - lo[j] - 2 * d) / (u[k] - u[j]) * (u[m] - u[k]) for k in range(m) for j in range(k)])
            out.append(v if ok and v <= lo[m] + d + 1e-12 else np.inf)
        return np.array(out)

    return bool((ends(u, lo, hi) <= 1 - ends(-u[::-1], 1 - hi[::-1], 1 - lo[::-1])[::-1] + 1e-12).any())


def plain_dip(x):
    x = np.sort(np.asarray(x, float))
    n = len(x)
    u, at = np.unique(x, return_index=True)
    hi, lo = np.append(at[1:], n) / n, at / n
    low, high = 0.0, 0.5
    for _ in range(35):
        mid = (low + high) / 2
        low, high = (low, mid) if unimodal_within(u, lo, hi, mid) else (mid, high)
    return max(high, 1 / (2 * n))


def test_dip_equals_trying_all_modes():
    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 8, 11):
        for k in range(18):
            x = rng.random(n) if k % 3 == 0 else np.concatenate([rng.normal(0, 1, n // 2), rng.normal(4, 1, n - n // 2)]) if k % 3 == 1 else np.round(rng.normal(0, 1, n), 1)
            assert abs(stats.dip(x) - plain_dip(x)) < 1e-6, (n, k)
    assert stats.dip(np.zeros(9)) == 1 / 18 and stats.dip(np.zeros(0)) == 0.0


def test_dip_p_values(spark):
    null = tree.dip_null(spark, 1000)
    assert sorted(null) == list(stats.DIP_SIZES) and all(len(v) == 1000 for v in null.values())
    rng = np.random.default_rng(7)
    for n in (30, 100, 300):  # uniform values have uniform p-values, at sizes of the table and between
        p = np.sort([stats.dip_p(stats.dip(rng.random(n)), n, null) for _ in range(300)])
        assert np.abs(p - (np.arange(300) + 0.5) / 300).max() < 0.1
    two = np.concatenate([rng.normal(0, 0.1, 60), rng.normal(3, 0.1, 60)])
    assert stats.dip_p(stats.dip(two), 120, null) <= 0.001
    assert stats.dip_p(stats.dip(rng.normal(0, 1, 120)), 120, null) > 0.1


# batches and mixtures ------------------------------------------------------------------------------


def test_weighted_sums_make_no_row_for_each_cell_and_gene(spark, monkeypatch):
    monkeypatch.setattr(integrate, "SUM_CELLS", 7)
    rng = np.random.default_rng(4)
    w = {(c, f"b{b}"): float(rng.random()) for c in range(40) for b in rng.choice(30, 6, replace=False)}
    m = {(f"b{b}", f"g{g}"): float(rng.normal()) for b in range(28) for g in rng.choice(9, 5, replace=False)}
    weights = spark.createDataFrame([(c, b, x) for (c, b), x in w.items()], "cell long, b string, w double")
    moves = spark.createDataFrame([(b, g, x) for (b, g), x in m.items()], "b string, gene string, move double")
    want = collections.defaultdict(float)
    for (c, b), x in w.items():
        for (o, g), y in m.items():
            if o == b:
                want[c, g] += x * y
    out = integrate.weighted_sums(weights, moves)
    got = {(r.cell, r.gene): r.s for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]
    assert integrate.weighted_sums(weights.limit(0), moves).count() == 0


def test_mutual_neighbors_remove_a_planted_shift(spark):
    rng = np.random.default_rng(3)
    base = np.abs(np.concatenate([rng.normal(m, 0.2, (40, 6)) for m in ([3, 0.5, 0.5, 1, 1, 1], [0.5, 3, 1, 0.5, 1, 2])]))
    a, b = base[::2], base[1::2] + np.array([0, 0, 0.8, 0, 0, 0])
    one, other = frame(spark, a), frame(spark, b, 1000)
    expr = one.union(other).select("cell", F.posexplode("vec").alias("gene", "value")).where("value <> 0")
    fixed = integrate.mutual_correction(expr, one, other, scratch(spark), k=8, smooth=10)
    got = collections.defaultdict(dict)
    for r in fixed.collect():
        got[r.cell][r.gene] = r.value
    row = lambda c: np.array([got[c].get(g, 0.0) for g in range(6)])
    assert np.allclose([row(i) for i in range(len(a))], np.where(a >= 0.05, a, 0))  # the first batch stays
    moved = np.array([row(1000 + i) for i in range(len(b))])
    for g in (slice(0, 20), slice(20, 40)):  # within each group the third gene comes back
        assert abs(moved[g, 2].mean() - a[g, 2].mean()) < 0.25 < abs(b[g, 2].mean() - a[g, 2].mean())
        assert abs(moved[g, 0].mean() - b[g, 0].mean()) < 0.3
    pairs = {(r.a, r.b) for r in integrate.mutual_pairs(integrate.unit_vectors(one), integrate.unit_vectors(other), 3, scratch(spark)).collect()}
    ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    d = np.sqrt(((ua[:, None] - ub[None]) ** 2).sum(2))
    assert pairs == {(i, 1000 + j) for i in range(len(a)) for j in range(len(b)) if (d[i] < d[i, j]).sum() < 3 and (d[:, j] < d[i, j]).sum() < 3}


def test_mixtures_never_lose_likelihood_and_find_both_parts(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in np.concatenate([rng.normal(0.2, 0.05, 190), rng.normal(0.8, 0.05, 40)])] + [("b", float(v)) for v in np.concatenate([rng.normal(0.1, 0.03, 50), rng.normal(0.6, 0.1, 50)])] + [("one side", 0.1), ("one side", 0.2), (None, 0.3)]
    df = spark.createDataFrame(rows, "key string, x double")
    last = None
    for n in (1, 2, 4, 8):
        fit = {r.key: r for r in integrate.mixture_rounds(df, scratch(spark), 0.4, 0.5, rounds=n, tolerance=float("-inf")).collect()}
        assert set(fit) == {"a", "b"}
        assert last is None or all(fit[k].likelihood >= last[k].likelihood - 1e-9 for k in fit)
        last = fit
    done = integrate.mixture_rounds(df, scratch(spark), 0.4, 0.5)
    fit = {r.key: r for r in done.collect()}
    assert abs(fit["a"].mean_low - 0.2) < 0.02 and abs(fit["a"].mean_high - 0.8) < 0.03 and abs(fit["a"].weight_low - 190 / 230) < 0.03
    assert abs(fit["b"].mean_low - 0.1) < 0.02 and abs(fit["b"].mean_high - 0.6) < 0.05
    high = collections.Counter(r.key for r in integrate.members_of_high(df, done).collect())
    assert 38 <= high["a"] <= 42 and 47 <= high["b"] <= 53


# trees ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weighted", [True, False])
def test_tree_from_visits_to_layout(spark, weighted):
    rng = np.random.default_rng(3)
    rows, pts, tips = [], [], []
    for i in range(600):
        t = i / 600
        pts.append((i, t))
        side = i % 3
        for s in (1, 2, 3):
            near = t < 0.4 or (t < 0.7 and {s, side + 1} <= {1, 2}) or s == side + 1
            rows.append((s, i, float(rng.poisson(60 if near else 3))))
        if t > 0.95:
            tips.append((side + 1, i))
    v, pt, tip = spark.createDataFrame(rows, "segment long, cell long, v double"), spark.createDataFrame(pts, "cell long, pseudotime double"), spark.createDataFrame(tips, "tip long, cell long")
    t = tree.assemble(v, pt, tip, scratch(spark), weighted, threshold=0.5, node_size=30, cuts=20, width=3, method="preference")
    assert {(r.parent, r.child) for r in t.joins.collect()} == {(4, 1), (4, 2), (5, 3), (5, 4)} and t.root == 5
    limits = {r.segment: (r.start, r.end) for r in t.limits.collect()}
    assert limits[5][0] < 0.05 and 0.3 < limits[5][1] == limits[3][0] == limits[4][0] < 0.5 and 0.6 < limits[1][0] == limits[2][0] < 0.8
    of = {r.cell: r.segment for r in t.cells.collect()}
    right = sum(of.get(i) == (5 if i / 600 < limits[5][1] else 3 if i % 3 == 2 else 4 if i / 600 < limits[1][0] else i % 3 + 1) for i in range(600))
    assert right > 560
    lines = t.lines.collect()
    assert {r.node_1 for r in lines} >= {"5-0", "5-1"} and sum(r.do_mean for r in lines) == 4  # a corner at each child
    assert all(r.x1 == r.x2 or r.do_mean and r.y1 == r.y2 for r in lines)
    drawn = {r.cell: r for r in t.layout.collect()}
    assert drawn.keys() == of.keys() and all(abs(r.y - c / 600) < 1e-9 for c, r in drawn.items())


def test_names_of_segments(spark):
    names = spark.createDataFrame([("1", "heart"), ("2", "eye")], "segment string, name string")
    labels = spark.createDataFrame([("eye",), ("7",)], "label string")
    assert {tuple(r) for r in tree.translate(names, labels).collect()} == {("eye", "2"), ("7", "7")}
    merged = spark.createDataFrame([("9", "a"), ("9", "b"), ("3", "c")], "segment string, tip string")
    of = spark.createDataFrame([("a", "heart"), ("b", "blood"), ("c", "eye")], "tip string, name string")
    assert {tuple(r) for r in tree.name_terminals(merged, of).collect()} == {("9", "blood+heart"), ("3", "eye")}


# small operators -----------------------------------------------------------------------------------


def test_tables_side_by_side_and_reports(spark, tmp_path):
    a = spark.createDataFrame([("x", "c1", 1.0)], "gene string, cell string, count double")
    b = spark.createDataFrame([("y", "c2", 2.0)], "gene string, cell string, count double")
    assert {tuple(r) for r in ingest.combine([a, b]).collect()} == {("x", "c1", 1.0), ("y", "c2", 2.0)}
    (tmp_path / "r1.tsv").write_text("CELL_BARCODE\tNUM_GENES\nAC\t5\nGT\t7\n")
    (tmp_path / "n1.tsv").write_text("90\tAC\n")
    rows = ingest.read_stats(spark, [str(tmp_path / "r1.tsv")], ["s"], [str(tmp_path / "n1.tsv")]).collect()
    assert {(r.CELL, r.SAMPLE, r.NUM_GENES, r.NUM_READS) for r in rows} == {("s_AC", "s", "5", 90), ("s_GT", "s", "7", None)}
    edges = ingest.import_edges(spark.createDataFrame([(1, 2, 1)], "i int, j int, w int"))
    assert list(edges) == ["edges"] and tuple(edges["edges"].first()) == (1, 2, 1.0)
    meta = spark.createDataFrame([(i, i % 2, i) for i in range(200)], "cell int, batch int, depth int")
    assert ingest.discrete_columns(meta) == ["batch"]


def test_labels_and_columns(spark):
    meta = spark.createDataFrame([(1, 5.0)], "cell int, depth double")
    long = spark.createDataFrame([(1, "g", 2.0), (1, "h", 3.0)], "cell int, name string, value double")
    tables = {"meta": (meta, ["depth"]), "genes": (long, ["g", "h", "depth"])}
    assert [tuple(expression.label_catalog(tables, n).first()) for n in ("depth", "g")] == [(1, 5.0), (1, 2.0)]
    with pytest.raises(KeyError):
        expression.label_catalog(tables, "none")
    twice = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "b", 7.0)], "row int, name string, value double")
    assert {tuple(r) for r in expression.aggregate_columns(twice).collect()} == {(1, "a", 2.0), (1, "b", 7.0)}


def test_labels_are_found_in_their_order(spark):
    cells = spark.createDataFrame([(1,), (2,)], "cell int")
    meta = spark.createDataFrame([(1, "a", "1.5", True, 3), (2, "b", "2", None, 4)], "cell int, kind string, number string, flag boolean, depth int")
    tables = {"meta": meta, "group": spark.createDataFrame([(1, "7")], "cell int, kind string"), "gene": spark.createDataFrame([(1, "g", 2.0)], "cell int, gene string, value double"), "counts": spark.createDataFrame([(2, "g", 3), (2, "h", 7)], "cell int, gene string, count int")}
    get = lambda *a: (lambda d, discrete: ({r.cell: r.value for r in d.collect()}, discrete))(*views.plot_data(tables, cells, *a))
    assert get("kind") == ({1: "a", 2: "b"}, True) and get("kind", "group") == ({1: "7", 2: None}, True)
    assert get("number") == ({1: 1.5, 2: 2.0}, False) and get("depth") == ({1: 3.0, 2: 4.0}, False) and get("flag") == ({1: "true", 2: None}, True)
    assert get("g") == ({1: 2.0, 2: 0.0}, False) and get("g", "counts") == ({1: 0.0, 2: 2.0}, False) and get("h") == ({1: 0.0, 2: 3.0}, False)
    for a in (("none",), ("kind", "pca")):
        with pytest.raises(KeyError):
            get(*a)


def test_windows_of_equal_time(spark):
    rows = [(i, x) for i, x in enumerate([0.0, 0.1, 0.25, 0.5, 0.9, 1.0])] + [(9, None)]
    pt = spark.createDataFrame(rows, "cell int, pseudotime double")
    assert {r.cell: r.grp for r in tree.equal_times(pt, 0.24).collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 4, 5: 4}
    assert {r.grp for r in tree.equal_times(pt, 50.0).collect()} == {1} and tree.equal_times(pt.where("cell < 2").withColumn("pseudotime", F.lit(0.3)), 0.1).count() == 2
    w = tree.moving_windows(tree.equal_times(pt, 0.24), 2)
    assert {r.window: r.name for r in tree.window_names(w, "max").collect()} == {1: 0.5, 2: 0.5, 3: 1.0}
    assert {(r.window, r.cell) for r in tree.merged_windows(w, 0.6, "max").collect()} == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 4), (1, 5)}


def test_components_and_fits(spark):
    loadings = spark.createDataFrame([(g, 1, v) for g, v in (("a", 0.1), ("b", -0.9), ("c", 0.5))], "gene string, pc int, v double")
    assert [r.gene for r in neighbors.top_loadings(loadings, 2).orderBy("r").collect()] == ["b", "c"]
    assert [tuple(r) for r in views.scree([2.0, 1.0], [True, False], spark).collect()] == [(1, 2.0, True, 1.5), (2, 1.0, False, 1.5)]
    fit = lambda m: spark.createDataFrame([("g", w, float(w), m * w, m * w) for w in (1, 2, 3)], "gene string, window int, pt double, mean double, fit double")
    assert {r.window for r in curves.crop(fit(1.0), 1.5, 3.0).collect()} == {2, 3}
    both = curves.combine_fits({"one": fit(1.0), "two": fit(2.0)}).collect()
    assert {(r.type, r.window): round(r.scaled, 6) for r in both} == {(t, w): round(m * w / 6, 6) for t, m in (("one", 1), ("two", 2)) for w in (1, 2, 3)}
    nodes = spark.createDataFrame([(1, "n"), (2, "n")], "cell int, node string")
    at = curves.layout_cells(nodes, spark.createDataFrame([("n", 3.0)], "node string, x double"), spark.createDataFrame([(1, 0.5), (2, 0.6)], "cell int, pseudotime double")).collect()
    assert {r.cell: r.y for r in at} == {1: 0.5, 2: 0.6} and all(0.05 <= abs(r.x - 3) <= 0.2 for r in at)


# modules across stages -----------------------------------------------------------------------------


def test_modules_are_connected_across_stages(spark):
    one = [(0, 1, "p", "x", 0.6), (0, 1, "q", "x", 0.5), (0, 1, "q", "y", 0.25), (1, 2, "x", "u", 0.7), (1, 2, "y", "w", 0.28), (0, 1, "r", "z", 0.1)]
    two = [(0, 2, "p", "w", 0.55), (0, 2, "q", "u", 0.9), (0, 2, "r", "lone", 0.3), (0, 2, "q", "lone", 0.3), (0, 2, "p", "none", 0.1)]
    schema = "from_stage int, to_stage int, a string, b string, score double"
    links = stages.connections(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema))
    # w goes two stages back as that is strong and the other weak, lone as it has nothing else; of equals the first name
    want = {(0, "p", 1, "x", 0.6), (0, "q", 1, "y", 0.25), (1, "x", 2, "u", 0.7), (0, "p", 2, "w", 0.55), (0, "q", 2, "lone", 0.3)}
    assert {tuple(r) for r in links.collect()} == want
    got = collections.defaultdict(set)
    for r in stages.chains(links, scratch(spark), 0.5).collect():
        got[r.end_stage, r.end, round(r.mean_score, 6)].add((r.stage, r.module))
    assert got == {(2, "u", 0.65): {(0, "p"), (1, "x"), (2, "u")}, (2, "w", 0.55): {(0, "p"), (2, "w")}}
    levels = spark.createDataFrame([(0, "p", "c", 2.0), (0, "p", "d", 4.0), (1, "x", "c", 5.0), (2, "w", "e", 1.0)], "stage int, module string, cell string, v double")
    sums = {(r.end, r.cell): r.level for r in stages.programmes(stages.chains(links, scratch(spark), 0.5), levels).collect()}
    assert sums == {("u", "c"): 1.5, ("u", "d"): 1.0, ("w", "c"): 0.5, ("w", "d"): 1.0, ("w", "e"): 1.0}
    assert stages.chains(links.limit(0), scratch(spark)).count() == 0


def test_long_chains_are_followed_to_their_root(spark):
    links = spark.createDataFrame([(k, "m", k + 1, "m", 0.5) for k in range(11)], "from_stage int, a string, to_stage int, b string, score double")
    rows = stages.chains(links, scratch(spark)).collect()
    assert {(r.end_stage, r.stage) for r in rows} == {(11, k) for k in range(12)} and all(abs(r.mean_score - 0.5) < 1e-12 for r in rows)


def test_overlap_of_leading_genes(spark):
    rows = [(0, "a", "g", 2.0), (0, "a", "h", 1.0), (0, "a", "only", 9.0), (1, "b", "g", 4.0), (1, "b", "k", 3.0), (1, "b", "h", 1.0), (0, "z", "k", 1.0)]
    got = {(r.a, r.b): r.score for r in stages.overlaps(spark.createDataFrame(rows, "stage int, module string, gene string, w double"), 1, 2).collect()}
    # of the shared genes a has g 1, h 1/2 in front, b has g 1, k 3/4
    assert got == pytest.approx({("a", "b"): (1 + 1) / (1.5 + 1.75), ("z", "b"): (1 + 0.75) / (1 + 1.75)})
