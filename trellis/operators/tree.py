"""The branching tree: navigation, membership, windows, breakpoints, nodes, and its building."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.functions.stats import DIP_SIZES, dip, dip_p, ks_asymptotic
from trellis.plans.order import ranked

#: Children of one segment that meet all others in one group, and pairs that a task should make.
SIBLINGS, PAIRS_A_TASK = 256, 2_000_000


def ancestors(joins: DataFrame) -> DataFrame:
    """(segment, ancestor, depth) for all segments of (parent, child), a join for each level of the tree."""
    up = joins.select(F.col("child").alias("ancestor"), F.col("parent").alias("next"))
    level = joins.select(F.col("child").alias("segment"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    out, depth = level, 1
    while not level.isEmpty():
        depth += 1
        level = level.join(up, "ancestor").select("segment", F.col("next").alias("ancestor"), F.lit(depth).alias("depth"))
        out = out.union(level)
    return out


def siblings(joins: DataFrame, include_self: bool = True) -> DataFrame:
    """(segment, sibling) of (parent, child): quadratic in the children of one segment, so these are dealt in blocks
    over tasks by the rows that come out, not by the few that go in."""
    sizes = joins.groupBy("parent").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / SIBLINGS).cast("int"))
    total, groups = sizes.agg(F.sum(F.col("n") * F.col("n")), F.sum("blocks")).first()
    tasks = max(1, min(math.ceil((total or 0) / PAIRS_A_TASK), groups or 1))
    dealt = joins.select("parent", "child").join(sizes, "parent")
    a = dealt.select("parent", F.col("child").alias("segment"), F.coalesce(F.pmod(F.xxhash64("child"), "blocks"), F.lit(0)).cast("int").alias("block")).repartition(tasks, "parent", "block")
    b = dealt.select("parent", F.col("child").alias("sibling"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).repartition(tasks, "parent", "block")
    out = a.join(b, ["parent", "block"]).select("segment", "sibling")
    return out if include_self else out.where("segment <> sibling")


def terminals(joins: DataFrame) -> DataFrame:
    return joins.select(F.col("child").alias("segment")).join(joins.select(F.col("parent").alias("segment")), "segment", "left_anti").distinct()


def cells_along_lineage(joins: DataFrame, cell_segment: DataFrame, segments: list, remove_root: bool = True) -> DataFrame:
    """Cells of the segments and all their ancestors, without the root's if asked."""
    up = ancestors(joins).where(F.col("segment").isin(segments)).select(F.col("ancestor").alias("segment"))
    own = joins.select(F.col("child").alias("segment")).where(F.col("segment").isin(segments))
    chain = up.union(own).distinct()
    if remove_root:
        chain = chain.join(joins.select(F.col("child").alias("segment")), "segment", "left_semi")
    return cell_segment.join(chain, "segment", "left_semi").select("cell").distinct()


def translate(names: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.join(names, labels["label"] == names["name"], "left").select("label", F.coalesce("segment", "label").alias("segment"))


def name_terminals(merged: DataFrame, names: DataFrame, sep: str = "+") -> DataFrame:
    """A terminal's name: the sorted names of the tips merged into it."""
    return merged.join(names, "tip").groupBy("segment").agg(F.array_join(F.array_sort(F.collect_list("name")), sep).alias("name"))


def combine_tips(visits: DataFrame, tip_cells: DataFrame, first: str, second: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Two tips as one: visits by the size-weighted mean, cells by union."""
    size = tip_cells.groupBy("tip").agg(F.count("*").alias("n"))
    to = F.when(F.col("tip").isin(first, second), F.lit(new)).otherwise(F.col("tip")).alias("tip")
    cells = tip_cells.select(to, "cell").distinct()
    both = visits.join(size, "tip").select(to, "cell", "v", "n")
    total = size.select(to, "n").groupBy("tip").agg(F.sum("n").alias("all"))
    return both.groupBy("tip", "cell").agg(F.sum(F.col("v") * F.col("n")).alias("s")).join(total, "tip").select("tip", "cell", (F.col("s") / F.col("all")).alias("v")), cells


def membership(visits: DataFrame, least: float, threshold: float) -> DataFrame:
    """(cell, segment) wherever a segment has enough of the cell's largest visits."""
    top = F.max("v").over(W.partitionBy("cell"))
    return visits.withColumn("top", top).where((F.col("top") >= least) & (F.col("v") >= threshold * F.col("top"))).select("cell", "segment")


def near_equal(df: DataFrame, keys: list[str], order: list, size: int, name: str = "grp", scratch=None) -> DataFrame:
    """Runs of near-equal length: n = max(round(rows / size), 1) groups with cuts at round(rows / n * g). Without
    ``keys`` the runs are those of the whole table, whose order is kept over range partitions in ``scratch``."""
    if keys:
        by = W.partitionBy(*keys)
        d = df.withColumns({"_r": F.row_number().over(by.orderBy(*order)), "_m": F.count("*").over(by)})
    else:
        d = ranked(df, order, scratch, "runs", "_r").drop("part").withColumn("_m", F.lit(df.count()))
    d = d.withColumn("_n", F.greatest(F.bround(F.col("_m") / size), F.lit(1)).cast("int"))
    # the first group whose cut is not before the row; rounding moves it by one from r * n / m at most
    guess = F.ceil(F.col("_r") * F.col("_n") / F.col("_m"))
    near = F.sequence(F.greatest(guess - 1, F.lit(1)), F.least(guess + 1, F.col("_n")))
    group = F.array_min(F.filter(near, lambda g: F.bround(F.col("_m") / F.col("_n") * g) >= F.col("_r")))
    return d.withColumn(name, group.cast("int")).drop("_r", "_m", "_n")


def nodes(cell_segment: DataFrame, pt: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(node of each cell, node summary) along each segment."""
    d = near_equal(cell_segment.join(pt, "cell"), ["segment"], ["pseudotime", "cell"], size, "k")
    d = d.withColumn("node", F.concat_ws("-", F.col("segment").cast("string"), "k"))
    return d.select("cell", "segment", "node"), d.groupBy("node", "segment", "k").agg(F.avg("pseudotime").alias("mean_pt"), F.max("pseudotime").alias("max_pt"), F.count("*").alias("n"))


def node_edges(summary: DataFrame, joins: DataFrame) -> DataFrame:
    """Along segments, and from a segment's last node to its children's first."""
    w = W.partitionBy("segment").orderBy("k")
    along = summary.withColumn("b", F.lead("node").over(w)).where("b is not null").select(F.col("node").alias("a"), "b")
    last = summary.groupBy("segment").agg(F.max_by("node", "k").alias("a"))
    first = summary.where("k = 1").select(F.col("segment").alias("child"), F.col("node").alias("b"))
    return along.union(joins.join(last, joins["parent"] == last["segment"]).join(first, "child").select("a", "b"))


def moving_windows(groups: DataFrame, width: int, keys: list[str] | None = None) -> DataFrame:
    """Every run of ``width`` successive groups is a window, named by its first group."""
    keys = keys or []
    last = groups.groupBy(*keys).agg(F.max("grp").alias("_top")) if keys else groups.agg(F.max("grp").alias("_top"))
    d = groups.join(last, keys) if keys else groups.crossJoin(F.broadcast(last))
    starts = F.filter(F.sequence(F.col("grp") - width + 1, F.col("grp")), lambda s: (s >= 1) & (s <= F.col("_top") - width + 1))
    return d.withColumn("window", F.explode(starts)).drop("_top")


def equal_times(pt: DataFrame, width: float, name: str = "grp") -> DataFrame:
    """(cell, pseudotime, ...) with the stretch of pseudotime each cell lies in: as many equal ones as have a length of
    about ``width``, one at least, closed to the right. Cells without pseudotime are left out."""
    r = pt.agg(F.min("pseudotime").alias("_lo"), F.max("pseudotime").alias("_hi"))
    d = pt.where("pseudotime is not null").crossJoin(F.broadcast(r)).withColumn("_n", F.greatest(F.bround((F.col("_hi") - F.col("_lo")) / width), F.lit(1)).cast("int"))
    at = F.ceil(F.try_divide((F.col("pseudotime") - F.col("_lo")) * F.col("_n"), F.col("_hi") - F.col("_lo")))
    return d.withColumn(name, F.least(F.greatest(F.coalesce(at, F.lit(1)), F.lit(1)), F.col("_n")).cast("int")).drop("_lo", "_hi", "_n")


def window_names(windows: DataFrame, by: str = "mean") -> DataFrame:
    """(window, name): the mean, least or greatest pseudotime of a window's cells, to three decimals."""
    fold = {"mean": F.avg, "min": F.min, "max": F.max}[by]
    return windows.groupBy("window").agg(F.round(fold("pseudotime"), 3).alias("name"))


def merged_windows(windows: DataFrame, width: float, by: str = "mean") -> DataFrame:
    """Windows of cells whose names lie in the same stretch of pseudotime of the ``width`` become one, named by the
    stretch: (window, cell, pseudotime), each cell once."""
    at = window_names(windows, by).select("window", F.floor(F.col("name") / width).cast("int").alias("to"))
    return windows.join(at, "window").select(F.col("to").alias("window"), "cell", "pseudotime").distinct()


def dip_null(spark, draws: int = 2000, seed: int = 1) -> dict[int, np.ndarray]:
    """Sorted dips of uniform values for ``DIP_SIZES`` numbers of values. Draws are dealt over tasks, each with a
    generator of its own; the table's size is fixed by the parameters."""
    chunk = 100

    def run(batches):
        for b in batches:
            for n, c in zip(b["n"], b["c"], strict=True):
                rng = np.random.default_rng((seed, int(n), int(c)))
                yield pd.DataFrame({"n": int(n), "dip": [dip(rng.random(int(n))) for _ in range(chunk)]})

    jobs = spark.createDataFrame([(n, c) for n in DIP_SIZES for c in range(max(1, draws // chunk))], "n int, c int").repartition(spark.sparkContext.defaultParallelism * 2, "n", "c")
    rows = jobs.mapInPandas(run, "n int, dip double").collect()
    return {n: np.sort([r["dip"] for r in rows if r["n"] == n]) for n in DIP_SIZES}


def divergence(visits: DataFrame, pt: DataFrame, pairs: DataFrame, least: float = 10, threshold: float = 0.7, cuts: int = 80, width: int = 5, p_max: float = 0.01, method: str = "ks", pref_max: float = 0.5, null: dict[int, np.ndarray] | None = None) -> DataFrame:
    """Window tests of all segment pairs at once: (s1, s2, window, p, p_adj, different, mean_pt, min_pt,
    max_pt), and of each group of cells in the window its number, sum of pseudotimes and size.

    One window's cells are one group; its size is bounded by cuts times width. ``method``: "ks" compares the
    visits of both sides, "preference" asks whether the preference for one of them has two modes, by the
    dip against ``null``, the dips of uniform values (``dip_null``, drawn here if not given).
    """
    from trellis.operators.markers import adjust_holm

    seg = membership(visits, least, threshold)
    side = lambda s: seg.select("cell", F.col("segment").alias(s))
    in_pair = pairs.join(side("s1"), "s1").select("s1", "s2", "cell").union(pairs.join(side("s2"), "s2").select("s1", "s2", "cell")).distinct()
    v = in_pair.join(visits.toDF("s1", "cell", "v1"), ["s1", "cell"]).join(visits.toDF("s2", "cell", "v2"), ["s2", "cell"]).join(pt, "cell")
    grouped = near_equal(v, ["s1", "s2"], ["pseudotime", "cell"], cuts)
    windows = moving_windows(grouped, width, ["s1", "s2"])
    kind = visits.schema["segment"].dataType.simpleString()

    if method != "ks" and null is None:
        null = dip_null(visits.sparkSession)

    def test(d: pd.DataFrame) -> pd.DataFrame:
        a, b = d["v1"].to_numpy(float), d["v2"].to_numpy(float)
        if method == "ks":
            p, pref = ks_asymptotic(a, b)[1], 0.0
        else:
            x = np.where(a + b > 0, (a - b) / np.maximum(a + b, 1e-300), 0)
            p, pref = dip_p(dip(x), len(x), null), float(np.abs(x).mean())
        t = d["pseudotime"]
        of = t.groupby(d["grp"]).agg(["sum", "count"])
        return pd.DataFrame({"groups": [of.index.tolist()], "sums": [of["sum"].tolist()], "counts": [of["count"].tolist()], "s1": [d["s1"].iloc[0]], "s2": [d["s2"].iloc[0]], "window": [d["window"].iloc[0]], "p": [p], "pref": [pref], "mean_pt": [t.mean()], "min_pt": [t.min()], "max_pt": [t.max()]})

    out = windows.groupBy("s1", "s2", "window").applyInPandas(test, f"s1 {kind}, s2 {kind}, window int, p double, pref double, mean_pt double, min_pt double, max_pt double, groups array<int>, sums array<double>, counts array<long>")
    return adjust_holm(out, "p", ["s1", "s2"]).withColumn("different", (F.col("p_adj") <= p_max) | (F.col("pref") > pref_max))


def breakpoint_of(windows: list[dict]) -> float | None:
    """Pseudotime at which two segments part, from their windows in order.

    All alike ends at the last, all different starts at the first. Otherwise it is the mean
    pseudotime of the cells in the groups that most of the uncertain windows share, those between the
    longest alike stretch and the longest different one; the last alike and the first different
    window, where nothing is between. None if the different stretch comes first.
    """
    if not windows:
        return None
    flags = [w["different"] for w in windows]
    if not any(flags):
        return windows[-1]["max_pt"]
    if all(flags):
        return min(w["min_pt"] for w in windows)
    runs, at = [], 0
    for i in range(1, len(flags) + 1):
        if i == len(flags) or flags[i] != flags[at]:
            runs.append((flags[at], at, i))
            at = i
    alike, apart = (max((r for r in runs if r[0] == kind), key=lambda r: r[2] - r[1]) for kind in (False, True))
    if alike[2] > apart[1]:
        return None
    between = windows[alike[2] : apart[1]] or windows[alike[2] - 1 : alike[2] + 1]
    times = Counter(g for w in between for g in w["groups"])
    most = max(times.values())
    cells = {g: (s, n) for w in between for g, s, n in zip(w["groups"], w["sums"], w["counts"], strict=True) if times[g] == most}
    if len(between) == 2 and not windows[alike[2] : apart[1]] and most < 2:
        return None
    return sum(s for s, _ in cells.values()) / sum(n for _, n in cells.values())


def elaborate_layout(edges: DataFrame, summary: DataFrame, places: DataFrame, root, limits: DataFrame | None = None) -> DataFrame:
    """(node_1, node_2, segment_1, segment_2, x1, y1, x2, y2, do_mean): a line for each edge of the tree of nodes.

    ``edges``: (a, b); ``summary``: (node, segment, k, max_pt); ``places``: (segment, x). A line goes from the
    pseudotime of one node to that of the next; a stub leads from zero to the first node of ``root``.
    Where a node has no pseudotime, its segment begins or ends by ``limits`` (segment, start, end). An edge
    between segments at unlike places has a corner: across at the first node's time to a node of number
    zero, marked ``do_mean``, and from there on along the second segment.
    """
    node = lambda n: summary.select(F.col("node").alias(f"node_{n}"), F.col("segment").alias(f"segment_{n}"), F.col("max_pt").alias(f"y{n}"))
    x = lambda n: places.select(F.col("segment").alias(f"segment_{n}"), F.col("x").alias(f"x{n}"))
    lines = edges.toDF("node_1", "node_2").join(node(1), "node_1").join(node(2), "node_2")
    first = summary.where((F.col("segment") == F.lit(root)) & (F.col("k") == 1))
    stub = first.select(F.concat_ws("-", F.col("segment").cast("string"), F.lit("0")).alias("node_1"), F.col("node").alias("node_2"), F.col("segment").alias("segment_1"), F.lit(0.0).alias("y1"), F.col("segment").alias("segment_2"), F.col("max_pt").alias("y2"))
    lines = lines.select(*stub.columns).union(stub)
    if limits is not None:
        lines = lines.join(limits.select(F.col("segment").alias("segment_1"), F.col("start").alias("_s")), "segment_1", "left").join(limits.select(F.col("segment").alias("segment_2"), F.col("end").alias("_e")), "segment_2", "left")
        lines = lines.withColumns({"y1": F.coalesce("y1", "_s"), "y2": F.coalesce("y2", "_e")})
    lines = lines.join(x(1), "segment_1").join(x(2), "segment_2")
    corner = F.concat_ws("-", F.col("segment_2").cast("string"), F.lit("0"))
    row = lambda **over: F.struct(*[(over[c] if c in over else F.col(c)).alias(c) for c in ("node_1", "node_2", "segment_1", "segment_2", "x1", "y1", "x2", "y2")], over.get("do_mean", F.lit(False)).alias("do_mean"))
    across, along = row(node_2=corner, y2=F.col("y1"), do_mean=F.lit(True)), row(node_1=corner, x1=F.col("x2"), segment_1=F.col("segment_2"))
    return lines.select(F.explode(F.when(F.col("x1") != F.col("x2"), F.array(across, along)).otherwise(F.array(row()))).alias("l")).select("l.*")


def interleaved(joins: DataFrame) -> DataFrame:
    """(parent, child, pseudotime) from joins of two children a row."""
    return joins.select("parent", F.explode(F.array("child_1", "child_2")).alias("child"), "pseudotime")


Joins = list[tuple]
Limits = dict


def collapse_short(joins: Joins, limits: Limits, cells: dict, root, min_cells: int = 1, min_length: float = 0.01, collapse_root: bool = False) -> tuple[Joins, Limits]:
    """Segments with too few cells or too short a stretch go; their children hang on their parent, and
    all children of that one start where the latest of the joins was. The tree is small and each step
    depends on the last, so this runs on (parent, child, pseudotime) rows on the driver."""
    joins, limits = list(joins), dict(limits)
    short = [s for s, (lo, hi) in limits.items() if cells.get(s, 0) < min_cells or abs(hi - lo) < min_length]
    for s in short:
        own = next((j for j in joins if j[1] == s), None)
        if own is None or (s == root and not collapse_root):
            continue
        parent = own[0]
        at = max([own[2], *(pt for p, _, pt in joins if p == s)])
        moved = [(parent if p == s else p, c, pt) for p, c, pt in joins if c != s]
        joins = [(p, c, at if p == parent else pt) for p, c, pt in moved]
        del limits[s]
        if parent in limits:
            limits[parent] = (limits[parent][0], at)
        for p, c, _ in joins:
            if p == parent and c in limits:
                limits[c] = (at, limits[c][1])
    return joins, limits


def remove_unary(joins: Joins, limits: Limits) -> tuple[Joins, Limits]:
    """An only child becomes part of its parent, which takes over its end and its children."""
    joins, limits = list(joins), dict(limits)
    families = Counter(p for p, _, _ in joins)
    for s in [c for p, c, _ in joins if families[p] == 1]:
        parent = next(p for p, c, _ in joins if c == s)
        joins = [(parent if p == s else p, c, pt) for p, c, pt in joins if c != s]
        if s in limits:
            end = limits.pop(s)[1]
            if parent in limits:
                limits[parent] = (limits[parent][0], end)
    return joins, limits


def assign_cells(visits: DataFrame, pt: DataFrame, limits: DataFrame, tip_cells: DataFrame | None = None) -> DataFrame:
    """(cell, segment): the most visited segment whose limits hold the cell; tip cells keep theirs."""
    v = visits.join(pt, "cell").join(limits, "segment").withColumn("v", F.when(F.col("pseudotime").between(F.col("start"), F.col("end")), F.col("v")).otherwise(0.0))
    if tip_cells is not None:
        v = v.join(tip_cells.select(F.col("tip").alias("segment"), "cell", F.lit(True).alias("own")), ["segment", "cell"], "left").withColumn("v", F.when(F.col("own"), F.lit(float("inf"))).otherwise(F.col("v")))
    top = v.groupBy("cell").agg(F.max_by("segment", F.struct("v", F.xxhash64("segment"))).alias("segment"), F.max("v").alias("v"))
    return top.where("v > 0").select("cell", "segment")


def build(visits: DataFrame, pt: DataFrame, tip_cells: DataFrame, scratch, weighted: bool = True, **options) -> tuple[list[tuple[int, int, float]], DataFrame]:
    """(joins, visits of all segments): the pair that parts latest is joined, again and again. The visits of a new
    segment are the mean of its tips', weighted by their cells or, if not ``weighted``, alike.

    Segments are few, so the loop over them runs on the driver; each round's tests are one job
    over the new pairs only.
    """
    ids = sorted(int(r["segment"]) for r in visits.select("segment").distinct().collect())
    size = {int(r["tip"]): int(r["n"]) for r in tip_cells.groupBy("tip").agg(F.count("*").alias("n")).collect()}
    spark, known, joins, alive, now = visits.sparkSession, {}, [], list(ids), visits
    if options.get("method", "ks") != "ks" and "null" not in options:
        options["null"] = dip_null(spark)
    following, tips = max(ids) + 1, {}
    while len(alive) > 1:
        todo = [(a, b) for a in alive for b in alive if a < b and (a, b) not in known]
        rows = divergence(now, pt, spark.createDataFrame(todo, "s1 long, s2 long"), **options).toPandas()
        for a, b in todo:
            d = rows[(rows["s1"] == a) & (rows["s2"] == b)].sort_values("window")
            known[a, b] = breakpoint_of(d.to_dict("records"))
        a, b = max(((x, y) for x in alive for y in alive if x < y), key=lambda k: (known[k] or 0.0, -k[0], -k[1]))
        new, following = following, following + 1
        joins += [(new, a, known[a, b] or 0.0), (new, b, known[a, b] or 0.0)]
        na, nb = (size.get(a, 1), size.get(b, 1)) if weighted else (tips.pop(a, 1), tips.pop(b, 1))
        size[new] = tips[new] = na + nb
        two = now.where(F.col("segment").isin(a, b)).withColumn("n", F.when(F.col("segment") == a, na).otherwise(nb))
        merged = two.groupBy("cell").agg((F.sum(F.col("v") * F.col("n")) / (na + nb)).alias("v")).select(F.lit(new).cast("long").alias("segment"), "cell", "v")
        now = scratch.table(now.union(merged), f"tree{new}")
        alive = [x for x in alive if x not in (a, b)] + [new]
    return joins, now


def tip_cells(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tip, cell), (tip, n)) from a grouping (cell, grp) used as tips; cells without a group are in none."""
    cells = groups.where("grp is not null").select(F.col("grp").alias("tip"), "cell")
    return cells, cells.groupBy("tip").agg(F.count("*").alias("n"))


@dataclass
class Tree:
    """A tree and all that lies on it; every field but ``root`` is a DataFrame."""

    root: int
    joins: DataFrame  # (parent, child, pseudotime)
    limits: DataFrame  # (segment, start, end)
    cells: DataFrame  # (cell, segment)
    nodes: DataFrame  # (cell, segment, node)
    summary: DataFrame  # (node, segment, k, mean_pt, max_pt, n)
    edges: DataFrame  # (a, b) of nodes
    places: DataFrame  # (segment, x)
    lines: DataFrame  # as of elaborate_layout
    layout: DataFrame  # (cell, x, y)


def assemble(visits: DataFrame, pt: DataFrame, tip_cells: DataFrame, scratch, weighted: bool = True, least: float = 10, threshold: float = 0.7, min_cells: int = 1, min_length: float = 0.01, node_size: int = 100, jitter: float = 0.15, push: float = 0.05, **options) -> Tree:
    """The tree of (segment, cell, v) of the tips, from joining to layout.

    Tips are joined, each cell goes to the most visited segment whose pseudotimes hold it, segments with
    too few cells or too short a stretch and only children are taken out, cells are assigned again to
    what is left and strung into nodes, and all is laid out. Only what is as small as the tree itself
    comes to the driver: joins, limits, numbers of cells.
    """
    from trellis.operators.curves import dendrogram, layout_cells

    spark = visits.sparkSession
    joins, every = build(visits, pt, tip_cells, scratch, weighted, least=least, threshold=threshold, **options)
    spans = membership(visits, least, threshold).join(pt, "cell").groupBy("segment").agg(F.min("pseudotime").alias("lo"), F.max("pseudotime").alias("hi")).collect()
    limits: Limits = {int(r["segment"]): (r["lo"], r["hi"]) for r in spans}
    for k in range(0, len(joins), 2):
        (new, a, at), (_, b, _) = joins[k : k + 2]
        known = [limits[x] for x in (a, b) if x in limits]
        limits[new] = (min((lo for lo, _ in known), default=0.0), at)
        for x in (a, b):
            limits[x] = (at, limits.get(x, (at, at))[1])
    root = joins[-1][0] if joins else next(iter(limits))
    frame = lambda held: spark.createDataFrame([(s, float(lo), float(hi)) for s, (lo, hi) in held.items()], "segment long, start double, `end` double")
    place = lambda held: assign_cells(every.join(frame(held).select("segment"), "segment", "left_semi"), pt, frame(held), tip_cells)
    sizes = {int(r["segment"]): r["n"] for r in place(limits).groupBy("segment").agg(F.count("*").alias("n")).collect()}
    joins, limits = remove_unary(*collapse_short(joins, limits, sizes, root, min_cells, min_length))
    cells = scratch.table(place(limits), "cells")
    joined = spark.createDataFrame([(int(p), int(c), float(t)) for p, c, t in joins], "parent long, child long, pseudotime double")
    of, summary = nodes(cells, pt, node_size)
    summary = scratch.table(summary, "summary")
    edges = scratch.table(node_edges(summary, joined).select("a", "b"), "edges")
    places = spark.createDataFrame([(int(s), float(x)) for s, x in (dendrogram(joins) if joins else {root: 0.0}).items()], "segment long, x double")
    lines = elaborate_layout(edges, summary, places, root, frame(limits))
    node_x = summary.join(places, "segment").select("node", "x")
    return Tree(root, joined, frame(limits), cells, of, summary, edges, places, lines, layout_cells(of.select("cell", "node"), node_x, pt, jitter, push))
