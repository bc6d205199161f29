"""The data behind the plots, ready to draw: one row a mark. Absent expression is zero, as everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.functions.expr import mean_of_logs, preference


def labelled(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Points of an embedding with their label; those without one stay, with a null."""
    return points.join(labels, "cell", "left")


#: Where a label is looked for, in this order; which kinds are always discrete, or asked about.
LABEL_ORDER = ("meta", "group", "sig", "gene", "counts", "pseudotime", "nmf", "pca", "diff.data")
DISCRETE = {"group": True, "meta": None}


def plot_data(tables: dict[str, DataFrame], cells: DataFrame, label: str, kind: str = "search") -> tuple[DataFrame, bool]:
    """((cell, value), whether it is discrete) of a label for the ``cells``.

    ``tables`` by kind: wide ones (cell, and a column a label), or long ones (cell, gene, value) and (cell, gene,
    count) for "gene" and "counts", whose absent rows are zeros. "search" takes the first kind that has the label.
    Counts are given as log2(count + 1). Of "meta", text that is no number is discrete, numbers are not.
    Values are numbers unless discrete.
    """
    long = {"gene": "value", "counts": "count"}
    has = lambda k: k in tables and (label in tables[k].columns if k not in long else not tables[k].where(F.col("gene") == label).isEmpty())
    found = next((k for k in (LABEL_ORDER if kind == "search" else [kind.lower()]) if has(k)), None)
    if found is None:
        raise KeyError(label)
    own = tables[found]
    if found in long:
        value = F.coalesce(F.col(long[found]).cast("double"), F.lit(0.0))
        rows = cells.select("cell").join(own.where(F.col("gene") == label), "cell", "left")
        return rows.select("cell", (F.log2(value + 1) if found == "counts" else value).alias("value")), False
    rows = cells.select("cell").join(own.select("cell", F.col(f"`{label}`").alias("value")), "cell", "left")
    discrete = DISCRETE.get(found, False)
    if discrete is None:
        text = F.col("value").cast("string")
        discrete = own.schema[label].dataType.simpleString() in ("string", "boolean") and not rows.where(text.isNull() | text.try_cast("double").isNull()).isEmpty()
    return rows.select("cell", F.col("value").cast("string" if discrete else "double").alias("value")), discrete


def drawn_edges(points: DataFrame, edges: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(a, b, x1, y1, x2, y2, alpha) of (a, b, w): an edge is as opaque as its weight is near the largest."""
    end = lambda k, name: points.select(F.col("cell").alias(name), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    top = edges.agg(F.max("w").alias("_top"))
    placed = edges.join(end(1, "a"), "a").join(end(2, "b"), "b").crossJoin(F.broadcast(top))
    return placed.select("a", "b", "x1", "y1", "x2", "y2", (F.try_divide("w", "_top") * alpha).alias("alpha"))


def two_colors(values: DataFrame, red: str = "red", green: str = "green", share: float = 0.975) -> DataFrame:
    """``values`` with both columns scaled to 0 to 1, where 1 is the quantile ``share`` of what is positive.

    The exact quantile counts distinct values; normalised expression, which has two decimals, has few.
    """
    top = values.agg(*[F.percentile(F.when(F.col(c) > 0, F.col(c)), F.lit(share)).alias(f"_{c}") for c in (red, green)])
    fit = lambda c: F.least(F.greatest(F.try_divide(c, f"_{c}"), F.lit(0.0)), F.lit(1.0))
    scaled = values.crossJoin(F.broadcast(top)).withColumns({c: fit(c) for c in (red, green)})
    return scaled.select(*values.columns)


def dimension_pairs(vectors: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(cell, dim_x, dim_y, x, y): each cell once for each pair of dimensions, counted from 1, in one pass."""
    panels = [F.struct(F.lit(a).alias("dim_x"), F.lit(b).alias("dim_y"), F.get("vec", a - 1).alias("x"), F.get("vec", b - 1).alias("y")) for a, b in pairs]
    return vectors.select("cell", F.explode(F.array(*panels)).alias("p")).select("cell", "p.*")


def groups_near(points: DataFrame, x: float, y: float, n: int = 20) -> DataFrame:
    """(grp, n) of the ``n`` points nearest to a place, the commonest first."""
    near = points.orderBy(F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2), "cell").limit(n)
    return near.groupBy("grp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "grp")


def by_group(values: DataFrame, labels: list[str], groups: DataFrame) -> DataFrame:
    """(cell, grp, label, value): several labels one below the other, by group."""
    return values.join(groups, "cell").unpivot(["cell", "grp"], labels, "label", "value")


def group_histograms(values: DataFrame, bins: int = 50) -> DataFrame:
    """(grp, bin, at, n, share) of (grp, value): how the values of each group spread over the common range,
    in ``bins`` of equal width. The largest value belongs to the last bin; nulls to none."""
    span = values.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    v = values.where(F.col("value").isNotNull()).crossJoin(F.broadcast(span))
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    at = F.col("_lo") + (place + 0.5) * (F.col("_hi") - F.col("_lo")) / bins
    n = v.groupBy("grp", place.alias("bin")).agg(F.first(at).alias("at"), F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("grp")))


def density_grid(points: DataFrame, bandwidth: float = 1.0, bins: int = 128, origin: bool = False, power: float = 0.25, reach: float = 3.4) -> DataFrame:
    """(i, j, x, y, density): Gaussian density of (x, y) on a grid, raised to ``power``; absent cells are zero.

    A bandwidth is a thirtieth of the range of the middle nine tenths (1 where that is zero); the grid
    reaches one and a half of it beyond the data; each point is dealt linearly over the four grid points
    round it. Only the grid, of a fixed size, is smoothed: first along x, then along y.
    """
    p = points.where("x is not null and y is not null").where(F.lit(origin) | (F.col("x") > 0) | (F.col("y") > 0)).select(F.col("x").cast("double"), F.col("y").cast("double"))
    width = lambda c: F.element_at(F.percentile(c, F.array(F.lit(0.05), F.lit(0.95))), 2) - F.element_at(F.percentile(c, F.array(F.lit(0.05), F.lit(0.95))), 1)
    s = p.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max), ("h", width))])
    s = s.withColumns({f"h{c}": F.when(F.col(f"h{c}") == 0, 1.0).otherwise(F.col(f"h{c}") / 30 * bandwidth) for c in "xy"})
    s = s.withColumns({f"lo{c}": F.col(f"lo{c}") - 1.5 * F.col(f"h{c}") for c in "xy"} | {f"hi{c}": F.col(f"hi{c}") + 1.5 * F.col(f"h{c}") for c in "xy"})
    s = s.withColumns({f"d{c}": (F.col(f"hi{c}") - F.col(f"lo{c}")) / (bins - 1) for c in "xy"})
    s = s.withColumns({f"l{c}": F.least(F.floor(reach * F.col(f"h{c}") / F.col(f"d{c}")), F.lit(bins - 1)).cast("int") for c in "xy"})

    u = {c: (F.col(c) - F.col(f"lo{c}")) / F.col(f"d{c}") for c in "xy"}
    dealt = p.crossJoin(F.broadcast(s)).select(*[e for c in "xy" for e in (F.floor(u[c]).cast("int").alias(f"g{c}"), (u[c] - F.floor(u[c])).alias(f"w{c}"))])
    part = lambda c, k: F.col(f"w{c}") if k else 1 - F.col(f"w{c}")
    corners = [F.struct((F.col("gx") + a).alias("i"), (F.col("gy") + b).alias("j"), (part("x", a) * part("y", b)).alias("w")) for a in (0, 1) for b in (0, 1)]
    grid = dealt.select(F.explode(F.array(*corners)).alias("c")).select("c.*").where("w > 0").groupBy("i", "j").agg(F.sum("w").alias("w"))

    for c, axis, other in (("x", "i", "j"), ("y", "j", "i")):
        bell = F.exp(-((F.col("k") * F.col(f"d{c}") / F.col(f"h{c}")) ** 2) / 2)
        kernel = s.select(f"d{c}", f"h{c}", F.explode(F.sequence(-F.col(f"l{c}"), F.col(f"l{c}"))).alias("k")).select("k", bell.alias("e"), f"d{c}")
        kernel = kernel.crossJoin(F.broadcast(kernel.agg(F.sum("e").alias("t")))).select("k", (F.col("e") / (F.col("t") * F.col(f"d{c}"))).alias("kap"))
        spread = grid.crossJoin(F.broadcast(kernel)).select((F.col(axis) + F.col("k")).alias(axis), other, (F.col("w") * F.col("kap")).alias("w"))
        grid = spread.where(F.col(axis).between(0, bins - 1)).groupBy("i", "j").agg(F.sum("w").alias("w"))
    out = grid.crossJoin(F.broadcast(s))
    return out.select("i", "j", (F.col("lox") + F.col("i") * F.col("dx")).alias("x"), (F.col("loy") + F.col("j") * F.col("dy")).alias("y"), F.pow(F.col("w") / F.col("n"), F.lit(power)).alias("density"))


def tree_values(values: DataFrame, cell_node: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, value) of tree edges (a, b), coloured by the node where they end: the mean of logs over all
    cells of that node, of (cell, value). Nodes without cells give null."""
    m = cell_node.join(values, "cell", "left").groupBy("node").agg(mean_of_logs(F.coalesce("value", F.lit(0.0))).alias("value"))
    return edges.join(m.withColumnRenamed("node", "b"), "b", "left").select("a", "b", "value")


def tree_two_colors(red: DataFrame, green: DataFrame, cell_node: DataFrame, edges: DataFrame, share: float = 0.975) -> DataFrame:
    """(a, b, red, green) of tree edges: two labels' values at the node where an edge ends, each scaled as in ``two_colors``."""
    one, other = (tree_values(v, cell_node, edges).withColumnRenamed("value", c) for v, c in ((red, "red"), (green, "green")))
    return two_colors(one.join(other, ["a", "b"]), share=share)


def color_limits(values: DataFrame) -> DataFrame:
    """(low, high) of (value): the range, symmetric about zero if there are negative values."""
    far = F.greatest(F.abs(F.min("value")), F.abs(F.max("value")))
    return values.agg(F.when(F.min("value") < 0, -far).otherwise(F.min("value")).alias("low"), F.when(F.min("value") < 0, far).otherwise(F.max("value")).alias("high"))


def scree(sdev: list[float], significant: list[bool], spark) -> DataFrame:
    """(pc, sdev, significant, cutoff): the cutoff lies half a component after the last significant one."""
    cut = max((i + 1 for i, s in enumerate(significant) if s), default=0) + 0.5
    rows = [(i + 1, float(v), bool(s), cut) for i, (v, s) in enumerate(zip(sdev, significant))]
    return spark.createDataFrame(rows, "pc int, sdev double, significant boolean, cutoff double")


def pair_thresholds(pairs: DataFrame, frac_max: float, diff_max: float, highlight: list | None = None) -> DataFrame:
    """(m1, m2, frac_high, frac_diff, chosen, highlighted): module pairs about the two cut lines."""
    marked = F.col("m1").isin(highlight) & F.col("m2").isin(highlight) if highlight else F.lit(False)
    return pairs.select("m1", "m2", "frac_high", "frac_diff", ((F.col("frac_high") <= frac_max) & (F.col("frac_diff") <= diff_max)).alias("chosen"), marked.alias("highlighted"))


def pair_values(modules: DataFrame, cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cell, m1, m2, v1, v2): the cells seen in both modules of each pair, absent values as zero."""
    side = lambda k: modules.select("cell", F.col("module").alias(f"m{k}"), F.col("v").alias(f"v{k}"))
    a = pairs.select("m1", "m2").join(side(1), "m1").select("cell", "m1", "m2", "v1")
    b = pairs.select("m1", "m2").join(side(2), "m2").select("cell", "m1", "m2", "v2")
    both = a.join(b, ["cell", "m1", "m2"], "full").na.fill(0.0, ["v1", "v2"])
    return both.join(cells.select("cell"), "cell", "left_semi")


def fit_points(fits: dict[str, DataFrame], genes: list[str] | None = None, scaled: bool = False) -> DataFrame:
    """(type, gene, pt, what, value): data and fitted curve of one or several named fits, as rows."""
    value, fit = ("scaled", "fit_scaled") if scaled else ("mean", "fit")
    every = reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("type"), "gene", "pt", F.col(value).alias("data"), F.col(fit).alias("fit")) for n, d in fits.items()])
    if genes is not None:
        every = every.where(F.col("gene").isin(genes))
    return every.unpivot(["type", "gene", "pt"], ["data", "fit"], "what", "value")


def heatmap_rows(timing: DataFrame) -> DataFrame:
    """Adds ``row``, the gene's place by onset, then offset. Unknown onsets come first, but last where the
    offset is infinite. There is one row a gene, so one task can number them."""
    endless = F.col("time_on").isNull() & (F.abs("time_off") == float("inf"))
    on = F.when(endless, float("inf")).otherwise(F.col("time_on"))
    return timing.withColumn("row", F.row_number().over(W.orderBy(on.asc_nulls_first(), F.col("time_off").asc_nulls_first(), "gene")))


def time_marks(windows: DataFrame, times: list[float]) -> DataFrame:
    """(window, mark) of (window, pt): each time marks the first window that reaches it; the later wins."""
    marks = F.explode(F.array(*[F.lit(float(t)) for t in times]))
    hit = windows.select("window", "pt", marks.alias("t")).where("pt >= t").groupBy("t").agg(F.min("window").alias("window"))
    return hit.groupBy("window").agg(F.max("t").alias("mark"))


def _in_windows(visits: DataFrame, windows: DataFrame, s1, s2) -> DataFrame:
    both = visits.where(F.col("segment").isin([s1, s2])).groupBy("cell")
    at = lambda s: F.coalesce(F.max(F.when(F.col("segment") == s, F.col("v"))), F.lit(0))
    return windows.select("cell", "window").join(both.agg(at(s1).alias("v1"), at(s2).alias("v2")), "cell")


def window_visits(visits: DataFrame, windows: DataFrame, s1, s2) -> DataFrame:
    """(cell, window, segment, v): visits to two segments by the cells of each divergence window."""
    long = _in_windows(visits, windows, s1, s2).unpivot(["cell", "window"], ["v1", "v2"], "segment", "v")
    return long.withColumn("segment", F.when(F.col("segment") == "v1", F.lit(s1)).otherwise(F.lit(s2)))


def window_preferences(visits: DataFrame, windows: DataFrame, s1, s2) -> DataFrame:
    """(cell, window, preference): to which of two segments the cells of each window lean."""
    return _in_windows(visits, windows, s1, s2).select("cell", "window", preference("v1", "v2", signed=True).alias("preference"))


def faded(values: DataFrame, alpha: float = 0.8, least: float = 0.1, below: float = 2 / 9) -> DataFrame:
    """Adds ``alpha`` to (value): points in the lowest share ``below`` of the range fade towards ``least``."""
    v = F.abs("value")
    span = values.agg(F.min(v).alias("_lo"), ((F.max(v) - F.min(v)) * below + F.min(v)).alias("_fade"))
    fade = F.greatest(F.coalesce(F.try_divide(F.col("_fade") - v + F.col("_lo"), "_fade"), F.lit(0.0)), F.lit(0.0))
    return values.crossJoin(F.broadcast(span)).withColumn("alpha", alpha - (alpha - least) * fade).drop("_lo", "_fade")


def thinned(points: DataFrame) -> DataFrame:
    """Multiplies ``alpha`` by the square root of n_dist over its median, so that crowded points show less."""
    middle = points.agg(F.percentile(F.sqrt("n_dist"), F.lit(0.5)).alias("_m"))
    return points.crossJoin(F.broadcast(middle)).withColumn("alpha", F.col("alpha") * F.try_divide(F.sqrt("n_dist"), "_m")).drop("_m")
