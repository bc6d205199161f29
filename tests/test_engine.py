import collections
import glob
import math
import os
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis import registry
from trellis.functions import expr as X
from trellis.functions import stats
from trellis.operators import along_tree, curves, markers, neighbors, pseudotime, tree
from trellis.plans.scratch import Scratch
from trellis.sources import ingest


VIEWS = ["labelled_points", "drawn_edges", "two_colors", "dimension_pairs", "groups_near", "labels_by_group", "group_histograms", "density_grid", "tree_values", "color_limits", "module_thresholds", "module_pair_values", "heatmap_rows", "time_marks", "window_visits", "window_preferences", "faded_points"]


def scratch(spark):
    return Scratch(spark, f"test-{uuid.uuid4().hex}")


def _norm(v):
    if v is None or v != v:
        return "~"
    return f"{v:.8g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", ["create_filter_normalize", "markers_auc_pr", "knn_exact", "jaccard_edges", "doublet_module_pairs", "walk_visits_prefix", "weighted_edges", "segment_parents_all", "near_equal_nodes", "moving_windows", "holm_adjust", "decode_barcode", "read_knee_curve", "impulse_derivatives", "inverse_curves", "scalar_math", "comparisons_along_tree", "collapsed_segments", "without_only_children", "tree_nodes", "edges_of_cells", "layout_density", "tip_labels", "tip_cells", "modules_in_cells", "batch_corrected", "doublet_cells", "markers_binomial", "welch_statistics", "binom_along_tree", "aucpr_along_tree", "modules_along_tree", "aucpr_by_factor", "cluster_de", "flood_chances", "bh_adjust", "logistic_params", "stability_total_change", "tip_potential", "cluster_quality", "force_edges", "force_graph", "neighbor_times", "kernel_sweep", "tsne_affinities", "mutual_neighbors", "mutual_corrected", "module_mixtures", "elaborated_tree", "window_divergence", "variable_genes", "assigned_segments", "module_overlaps", "module_links", "module_chains", "module_programmes", "windows_of_time", "windows_merged", "dot_values", "plotted_counts", "batch_corrected_reference", "tree_two_colors", *VIEWS])
def test_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = sorted(tuple(_norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert sorted(names) == cols and got == want


def test_logistic_of_the_published_run(spark):
    back, forward = 0.0141877922631169, -0.00707556824669169
    x0 = (back + forward) / 2
    k = math.log(0.01) / (x0 - forward)
    assert abs(spark.range(1).select(X.logistic(F.lit(0.0), x0, k)).first()[0] - 0.823515) < 1e-5


def test_small_expressions(spark):
    d = spark.createDataFrame([(0.0, 0.5), (1.0, 0.5), (2.0, None)], "x double, p double")
    r = d.agg(X.mean_of_logs("x"), X.combine_probs("p"), X.output_uniform("p"), X.output_uniform("p", True)).first()
    assert abs(r[0] - 1.222392) < 1e-6 and abs(r[1] - 0.75) < 1e-12 and r[2] is None and r[3] == 0.5
    b = spark.createDataFrame([(27,)], "x long").select(X.decode_barcode("x")).first()[0]
    assert b == "A" * 12 + "ACGT"


def test_adjustments(spark):
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double")
    assert [round(r.p_adj, 6) for r in markers.adjust_holm(p, "p", scratch=scratch(spark)).orderBy("p").collect()] == [0.03, 0.06, 0.06]
    assert [round(r.p_adj, 6) for r in markers.adjust_bh(p, "p", scratch=scratch(spark)).orderBy("p").collect()] == [0.03, 0.04, 0.04]
    q = p.withColumn("k", F.lit(1))
    assert [round(r.p_adj, 6) for r in markers.adjust_holm(q, "p", ["k"]).orderBy("p").collect()] == [0.03, 0.06, 0.06]


def test_area(spark):
    c = spark.createDataFrame([("g", 3.0, 1, 0), ("g", 2.0, 1, 0), ("g", 1.0, 0, 1), ("g", 0.0, 0, 1)], "gene string, value double, p long, n long")
    assert markers.area_pr(c, ["gene"]).first()["auc"] == 0.5


def test_breakpoints():
    """Ten cells a group at pseudotime g / 10; windows of two groups."""

    def of(flags, width=2):
        return tree.breakpoint_of([{"different": x, "min_pt": (i + 1) / 10, "mean_pt": 0.0, "max_pt": (i + width) / 10, "groups": list(range(i + 1, i + 1 + width)), "sums": [float(g) for g in range(i + 1, i + 1 + width)], "counts": [10] * width} for i, x in enumerate(flags)])

    f, t = False, True
    assert of([f, f, t, t]) == pytest.approx(0.3)  # the group that the second and the third window share
    assert of([f, f, t, f, t, t, t], 3) == pytest.approx(0.45)  # of windows 3 and 4 the groups 4 and 5
    assert of([t, t]) == 0.1 and of([f, f]) == pytest.approx(0.3)
    assert of([t, f]) is None and of([]) is None


def test_tree_reshaping():
    joins = [("r", "a", 0.1), ("r", "b", 0.1), ("a", "c", 0.2), ("a", "d", 0.2), ("c", "e", 0.5)]
    limits = {"r": (0.0, 0.1), "a": (0.1, 0.2), "b": (0.1, 0.9), "c": (0.2, 0.5), "d": (0.2, 0.8), "e": (0.5, 1.0)}
    cells = dict.fromkeys(limits, 5) | {"a": 0}
    j, lim = tree.collapse_short(joins, limits, cells, "r")
    assert sorted(j) == [("c", "e", 0.5), ("r", "b", 0.2), ("r", "c", 0.2), ("r", "d", 0.2)]
    assert lim["r"] == (0.0, 0.2) and lim["b"] == (0.2, 0.9) and lim["c"] == (0.2, 0.5) and "a" not in lim
    j, lim = tree.remove_unary(j, lim)
    assert sorted(j) == [("r", "b", 0.2), ("r", "c", 0.2), ("r", "d", 0.2)] and lim["c"] == (0.2, 1.0) and "e" not in lim


def test_diffusion_components(spark, tmp_path):
    rng = np.random.default_rng(5)
    a = rng.random((12, 12))
    a = a @ a.T / 40
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(12)], "i long, j long, w double")
    values, vectors = neighbors.diffusion_components(edges, 3, Scratch(spark, "diffusion"), rounds=12)
    want, full = np.linalg.eigh(a)
    assert np.allclose(values, want[::-1][:3], atol=1e-8)
    got = {(r["cell"], r["k"]): r["v"] for r in vectors.collect()}
    for k in range(3):
        v = full[:, 11 - k] * np.sign(full[np.abs(full[:, 11 - k]).argmax(), 11 - k])
        assert np.allclose([got[i, k + 1] for i in range(12)], v, atol=1e-4)


def test_siblings_are_dealt_by_what_comes_out(spark, monkeypatch):
    """A small table of one segment with many children makes many pairs, which one task must not make alone."""
    monkeypatch.setattr(tree, "SIBLINGS", 20, raising=False)
    monkeypatch.setattr(tree, "PAIRS_A_TASK", 1000, raising=False)
    rows = [("r", f"a{i}") for i in range(120)] + [("a1", "x"), ("a1", "y"), (None, "r")]
    joins = spark.createDataFrame(rows, "parent string, child string")
    found = tree.siblings(joins, include_self=False).withColumn("task", F.spark_partition_id()).collect()
    want = sorted((a, b) for p, a in rows for q, b in rows if p is not None and p == q and a != b)
    assert sorted((r.segment, r.sibling) for r in found) == want
    counts = collections.Counter(r.task for r in found)
    assert len(counts) >= 4 and max(counts.values()) < 0.6 * len(want)
    assert tree.siblings(joins.where("parent = 'a1'")).count() == 4 and tree.siblings(joins.limit(0)).count() == 0


def test_comparisons_join_the_siblings_of_the_path_only(spark, monkeypatch):
    """A tree of many leaves, whose siblings all with all are quadratic: these are not listed."""
    listed = []
    monkeypatch.setattr(tree, "siblings", lambda joins, **_: listed.append(joins) or joins.crossJoin(joins))
    joins = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "t"), *[("b", f"b{i}") for i in range(300)], *[("a", f"a{i}") for i in range(5)]], "parent string, child string")
    segment = spark.createDataFrame([("x", "t"), ("y", "a"), ("z", "a3"), ("v", "b7"), ("late", "b9")], "cell string, segment string")
    pt = spark.createDataFrame([("x", 0.9), ("y", 0.5), ("z", 0.5), ("v", 0.2), ("late", 0.8)], "cell string, pseudotime double")
    limits = spark.createDataFrame([("a", 0.0, 0.7), ("t", 0.1, 0.7)], "segment string, start double, end double")
    got = sorted(tuple(r) for r in along_tree.comparisons(joins, limits, segment, pt, "t").collect())
    assert got == sorted([(1, "a", "b", "y", 1), (1, "a", "b", "v", 2), (0, "t", "a3", "z", 2), *[(0, "t", f"a{i}", "x", 1) for i in range(5)]])
    assert not listed


def test_along_tree(spark):
    """One gene marks the tip's segment, one its sibling, one the parent against the other branch but not the tip."""
    joins = spark.createDataFrame([("r", "p"), ("r", "q"), ("p", "t"), ("p", "s")], "parent string, child string")
    segment = spark.createDataFrame([(f"{s}{i}", s) for s in "pqts" for i in range(20)], "cell string, segment string")
    pt = segment.select("cell", F.lit(0.5).alias("pseudotime"))
    limits = spark.createDataFrame([(s, 0.0, 1.0) for s in "pqts"], "segment string, start double, end double")
    c = along_tree.comparisons(joins, limits, segment, pt, "t")
    assert {(r["segment"], r["opposing"], r["depth"], r["side"], r["n"]) for r in c.groupBy("segment", "opposing", "depth", "side").agg(F.count("*").alias("n")).collect()} == {("t", "s", 0, 1, 20), ("t", "s", 0, 2, 20), ("p", "q", 1, 1, 20), ("p", "q", 1, 2, 20)}
    rows = [(g, f"{s}{i}", 1.0 + i / 50) for g, on in (("tip", "t"), ("sib", "sp"), ("way", "pt")) for s in on for i in range(20)]
    expr = spark.createDataFrame(rows, "gene string, cell string, value double")
    got = {r["gene"]: r for r in along_tree.auc_pr(expr, c, Scratch(spark, "along")).collect()}
    assert set(got) == {"tip", "way"}  # the sibling's marker is depleted at the tip, so the parent's is none
    assert got["tip"]["segment_max"] == "t-s" and got["way"]["segment_max"] in ("t-s", "p-q")
    counts = expr.select("gene", "cell", F.lit(1.0).alias("count"))
    both = {r["gene"]: r for r in along_tree.binom(expr, counts, c, Scratch(spark, "along-b"), effect=0.1, p_max=0.05).collect()}
    assert set(both) == {"tip", "way", "sib"} and both["sib"]["segment_max"] == "t-s" and both["sib"]["log_effect_max"] < 0
    dense = segment.select("cell").crossJoin(spark.createDataFrame([("tip",), ("sib",), ("way",)], "name string")).join(expr.toDF("name", "cell", "x"), ["name", "cell"], "left")
    values = dense.select("name", "cell", (F.coalesce("x", F.lit(0.0)) + F.pmod(F.xxhash64("cell"), F.lit(10)) / 100 + 0.2).alias("v"))
    states = along_tree.modules(values, segment.select("cell"), c, Scratch(spark, "along-m"), effect=0.3)
    assert {(r["name"], r["state"]) for r in states.collect()} == {("tip", "up"), ("way", "up"), ("sib", "up"), ("sib", "down")}
    members = spark.createDataFrame([("tip", "g1"), ("sib", "g2"), ("way", "g2"), ("way", "g3")], "name string, gene string")
    assert {r["gene"] for r in along_tree.module_genes(states, members).collect()} == {"g1", "g3"}
    sets = segment.where("segment in ('t', 's', 'q')").select(F.when(F.col("segment") == "t", "one").otherwise(F.col("segment")).alias("name"), "cell")
    factor = segment.select("cell", F.when(F.substr("cell", F.lit(2)).cast("int") < 10, "low").otherwise("high").alias("grp"))
    got = {r["gene"]: r["groups_marked"] for r in along_tree.auc_pr_by_factor(expr, sets, factor, Scratch(spark, "factor")).collect()}
    assert got == {"tip": 2, "way": 2}


def test_special_functions():
    assert stats.binom_upper([3, 0, 11], [10, 10, 10], [0.5, 0.5, 0.5]) == pytest.approx([0.9453125, 1, 0])
    assert stats.t_two_sided(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.0733880, abs=1e-6)
    assert stats.digamma(1.0) == pytest.approx(-0.5772156649)
    x = np.random.default_rng(1).gamma(3.0, 0.5, 20000)
    shape, rate = stats.gamma_fit(x.mean(), np.log(x).mean())
    assert abs(shape - 3) < 0.15 and abs(rate - 2) < 0.15
    uni, two = stats.dip(np.linspace(0, 1, 101)), stats.dip(np.concatenate([np.linspace(0, 0.1, 50), np.linspace(0.9, 1, 50)]))
    assert uni < 0.02 and two > 0.15


def test_impulse_and_lowess():
    x = np.linspace(0, 1, 40)
    r = curves.impulse(x, 1 / (1 + np.exp(-25 * (x - 0.4))))
    half = math.log((2 + math.sqrt(2)) / (2 - math.sqrt(2))) / 25  # before its middle a logistic has half the slope
    assert r["type"] == 1 and abs(r["time_on"] - 0.4 + half) < 0.01 and r["time_off"] == math.inf
    r = curves.impulse(x, 1 / (1 + np.exp(25 * (x - 0.4))))
    assert r["type"] == 1 and abs(r["time_off"] - 0.4 + half) < 0.01 and r["time_on"] == -math.inf
    r = curves.impulse(x, 1 / (1 + np.exp(-30 * (x - 0.3))) / (1 + np.exp(30 * (x - 0.7))))
    assert r["type"] == 2 and abs(r["time_on"] - 0.24) < 0.03 and abs(r["time_off"] - 0.64) < 0.03
    r = curves.impulse(x, 0.2 + 0.5 * x)
    assert r["type"] == 0 and abs(r["time_on"] + 0.4) < 1e-6
    assert curves.impulse(x, np.zeros(40))["time_off"] == math.inf


@pytest.mark.parametrize("low, high, found", [(0.0, 0.0, True), (0.85, 0.0, True), (0.95, 0.0, False), (0.0, 0.95, False)])
def test_pulses_stand_out_at_both_ends(low, high, found):
    """A planted curve that rises from one level to one and falls to another."""
    p = (-30.0, 30.0, low, 1.0, high, 0.3, 0.7)
    assert curves.is_pulse(lambda v: curves._double(v, p), lambda v: curves._slope_double(v, p), 0.0, 1.0) is found


def test_monotone_and_flat_curves_are_no_pulses():
    up = (-20.0, 0.0, 1.0, 0.5)
    assert not curves.is_pulse(lambda v: curves._single(v, up), lambda v: curves._slope(v, up), 0.0, 1.0)
    assert not curves.is_pulse(lambda v: 0.0, lambda v: 0.0, 0.0, 1.0)
    # turning points are found to rounding, and the half slope is solved for on each piece
    cuts = curves.monotone_pieces(np.cos, 0.0, 7.0)
    assert np.allclose([c[1] for c in cuts], [math.pi / 2, 3 * math.pi / 2, 7.0])
    on, off = curves.change_times(np.sin, np.cos, -math.pi / 2, 3 * math.pi / 2)
    assert np.allclose(on, [-math.pi / 3], atol=1e-3) and np.allclose(off, [2 * math.pi / 3], atol=1e-3)
    # an end that covers little of the range counts for nothing
    on, off = curves.change_times(np.sin, np.cos, -0.2, math.pi / 2 + 0.3)
    assert off == [math.inf] and len(on) == 1


def test_binomial_test_counts_all_genes_and_has_infinite_effects(spark):
    cells = [(f"a{i}", 1) for i in range(20)] + [(f"b{i}", 2) for i in range(20)]
    sides = spark.createDataFrame([("x", c, s) for c, s in cells], "cmp string, cell string, side int")
    rows = [("only", f"a{i}") for i in range(10)] + [("both", c) for c, _ in cells[::2]] + [("elsewhere", "z")]
    expr = spark.createDataFrame([(g, c, 1.0) for g, c in rows], "gene string, cell string, value double")
    counts = expr.withColumnRenamed("value", "count")
    got = {r.gene: r for r in markers.markers_binom(expr, counts, sides, effect=0.5, p_max=1.0).collect()}
    tail = sum(math.comb(20, j) * 0.05**j * 0.95 ** (20 - j) for j in range(10, 21))
    # three genes are tested, though one of them no cell of either side expresses
    assert set(got) == {"only"} and got["only"].log_effect == math.inf and abs(got["only"].p_adj - 3 * tail) < 1e-12
    assert (got["only"].frac_1, got["only"].frac_2, got["only"].trans_1) == (0.5, 0.0, 0.5)
    flipped = sides.withColumn("side", 3 - F.col("side"))
    assert {r.gene: r.log_effect for r in markers.markers_binom(expr, counts, flipped, effect=0.5, p_max=1.0).collect()} == {"only": -math.inf}
    assert markers.markers_binom(expr, counts, flipped, effect=0.5, p_max=1.0, either=False).count() == 0  # the rest alone expresses it


def test_fits_keep_their_bounds():
    x = np.linspace(0, 1, 30)
    p, _ = curves.fit_curve(curves._single, x, 5 * x, [(-1.0, 0.0, 1.0, 0.5)], (-20, -1, -1, 0), (20, 2, 2, 1))
    assert (p >= [-20, -1, -1, 0]).all() and (p <= [20, 2, 2, 1]).all()


def test_spline_is_the_best_of_all_penalties():
    rng = np.random.default_rng(4)
    x = np.round(np.sort(rng.random(40)), 1 + 1)
    y = np.sin(6 * x) + rng.normal(0, 0.2, 40)
    u, fit = curves.smoothing_spline(x, y)
    n, knots = len(u), np.diff(u)
    # brute force: the penalty is the integral of the squared second derivative of the natural spline through f
    second = np.zeros((n, n))
    a = np.eye(n)
    for j in range(1, n - 1):
        a[j, j - 1 : j + 2] = knots[j - 1] / 6, (knots[j - 1] + knots[j]) / 3, knots[j] / 6
        second[j, j - 1 : j + 2] = 1 / knots[j - 1], -1 / knots[j - 1] - 1 / knots[j], 1 / knots[j]
    m = np.linalg.solve(a, second)
    gram = np.zeros((n, n))
    for j in range(n - 1):
        gram[j : j + 2, j : j + 2] += knots[j] / 6 * np.array([[2, 1], [1, 2]])
    k = m.T @ gram @ m
    b = (x[:, None] == u[None, :]).astype(float)
    best = None
    for lam in np.exp(np.linspace(-18, 2, 2000)):
        hat = b @ np.linalg.solve(b.T @ b + lam * k, b.T)
        gcv = ((y - hat @ y) ** 2).sum() / (1 - np.trace(hat) / len(x)) ** 2
        if best is None or gcv < best[0]:
            best = gcv, np.linalg.solve(b.T @ b + lam * k, b.T @ y)
    assert np.abs(fit - best[1]).max() < 5e-3
    assert np.abs(curves.smoothing_spline(x, 2 * x + 1)[1] - (2 * u + 1)).max() < 1e-6


def test_lowess_of_equal_x_equals_the_plain_one_and_is_quick():
    def plain(x, y, f):
        n, r = len(x), max(2, min(len(x), int(f * len(x) + 1e-7)))
        robust, fit = np.ones(n), np.zeros(n)
        for _ in range(4):
            for i in range(n):
                d = np.abs(x - x[i])
                w = np.clip(1 - (d / max(np.sort(d)[r - 1], 1e-12)) ** 3, 0, None) ** 3 * robust
                if w.sum() <= 0:
                    fit[i] = y[i]
                    continue
                mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
                v = (w * (x - mx) ** 2).sum()
                fit[i] = my + ((w * (x - mx) * (y - my)).sum() / v * (x[i] - mx) if v > 1e-12 else 0)
            res = np.abs(y - fit)
            if 6 * np.median(res) < 1e-12:
                break
            robust = np.clip(1 - (res / (6 * np.median(res))) ** 2, 0, None) ** 2
        return fit

    rng = np.random.default_rng(5)
    for n, decimals, f in ((7, 1, 0.5), (80, 1, 0.3), (120, 3, 2 / 3), (90, 9, 0.1)):
        x = np.round(rng.normal(0, 1, n), decimals)
        y = np.where(rng.random(n) < 0.2, 0, np.sin(x)) + rng.normal(0, 0.1, n)
        assert np.abs(curves.lowess(x, y, f) - plain(x, y, f)).max() < 1e-9
    x, began = np.round(rng.normal(0, 0.13, 20_000), 3), time.process_time()
    assert np.abs(curves.lowess(x, 2 * x + 1) - (2 * x + 1)).max() < 1e-9
    curves.lowess(x, np.sin(x) + rng.normal(0, 0.1, len(x)))
    assert time.process_time() - began < 20


def test_lowess():
    x = np.linspace(0, 1, 40)
    assert np.abs(curves.lowess(x, 2 * x + 1) - (2 * x + 1)).max() < 1e-9


def test_readers(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("GENE\ta_1\ta_2\nx\t0\t3\ny\t1\t2\n")
    assert {tuple(r) for r in ingest.read_dense(spark, str(tmp_path / "d.tsv"), "p").collect()} == {("x", "p_a_2", 3.0), ("y", "p_a_1", 1.0), ("y", "p_a_2", 2.0)}
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket\n2 2 3\n1 1 5\n2 1 2\n2 2 7\n")
    (tmp_path / "barcodes.tsv").write_text("AC-1\nGT-1\n")
    (tmp_path / "genes.tsv").write_text("e1\tA\ne2\tA\n")
    assert {tuple(r) for r in ingest.read_sparse(spark, str(tmp_path)).collect()} == {("A", "AC", 7.0), ("A", "GT", 7.0)}


def test_flood_reaches_all_with_sure_edges(spark):
    from trellis.plans.scratch import Scratch

    e = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in (i - 1, i + 1) if 0 <= j < 6], "i int, j int, w double")
    f = pseudotime.flood(e, [0], 2, Scratch(spark, "t-flood"), least_new=1)
    assert {(r.cell, r.step) for r in f.collect() if r.cell < 5} == {(i, i) for i in range(5)}


def test_tree_is_built(spark):
    from trellis.plans.scratch import Scratch

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
    v = spark.createDataFrame(rows, "segment long, cell long, v double")
    joins, _ = tree.build(v, spark.createDataFrame(pts, "cell long, pseudotime double"), spark.createDataFrame(tips, "tip long, cell long"), Scratch(spark, "t-tree"), cuts=20, width=3, threshold=0.5, method="preference")
    assert {c for p, c, _ in joins if p == 4} == {1, 2} and {c for p, c, _ in joins if p == 5} == {3, 4}
    assert curves.dendrogram(joins)[5] == (curves.dendrogram(joins)[3] + curves.dendrogram(joins)[4]) / 2


def test_nearest_groups_and_their_markers(spark):
    means = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.1), ("c", "y", 5.0)], "grp string, gene string, m double")
    assert {tuple(r) for r in markers.nearest_groups(means).collect()} == {("a", "b"), ("a", "c")}
    groups = spark.createDataFrame([(f"{g}{i}", g) for g in "abc" for i in range(20)], "cell string, grp string")
    rows = groups.where("grp = 'c'").select("cell", F.lit("y").alias("gene"), F.lit(5.0).alias("value"))
    pairs, genes = markers.cluster_de(rows, rows.withColumnRenamed("value", "count"), groups, means)
    assert {tuple(r) for r in pairs.collect()} == {("a", "b", 0), ("a", "c", 1)}
    assert [(r.cmp, r.gene) for r in genes.collect()] == [("a-c", "y")]
