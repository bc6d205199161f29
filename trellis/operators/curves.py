"""Expression along pseudotime: smoothing, impulse fits, cascades; and coordinates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window_means(expr: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean of logs of each gene in each window of (cell, window, pseudotime), and over its largest."""
    names = windows.groupBy("window").agg(F.round(F.avg("pseudotime"), 3).alias("pt"), F.count("*").alias("n"))
    m = expr.join(windows.select("cell", "window"), "cell").groupBy("gene", "window").agg(F.sum(F.pow(F.lit(2.0), "value") - 1).alias("u"))
    every = m.select("gene").distinct().crossJoin(F.broadcast(names)).join(m, ["gene", "window"], "left")
    every = every.withColumn("mean", F.log2(F.coalesce("u", F.lit(0.0)) / F.col("n") + 1))
    return every.withColumn("scaled", F.coalesce(F.try_divide("mean", F.max("mean").over(W.partitionBy("gene"))), F.lit(0.0))).select("gene", "window", "pt", "mean", "scaled")


def lowess(x: np.ndarray, y: np.ndarray, f: float = 2 / 3, rounds: int = 3) -> np.ndarray:
    """Cleveland's robust locally weighted regression. Equal x have one line, so points are added up by x and a
    round is quadratic in the different x alone, in strips of bounded size."""
    n = len(x)
    if n < 3:
        return y.astype(float)
    r = max(2, min(n, int(f * n + 1e-7)))
    u, at = np.unique(x.astype(float), return_inverse=True)
    # the r nearest points of each x are a run of the sorted ones
    points, low, start = np.sort(x.astype(float)), np.zeros(len(u), np.int64), 0
    for k, v in enumerate(u):
        while start + r < n and points[start + r] - v < v - points[start]:
            start += 1
        low[k] = start
    h = np.maximum(np.maximum(u - points[low], points[low + r - 1] - u), 1e-12)
    first, last = np.searchsorted(u, u - h, "left"), np.searchsorted(u, u + h, "right")
    robust, line, empty = np.ones(n), np.zeros(len(u)), np.zeros(len(u), bool)
    for _ in range(rounds + 1):
        some, total = np.bincount(at, robust, len(u)), np.bincount(at, robust * y, len(u))
        k = 0
        while k < len(u):
            rows = slice(k, k + max(1, 500_000 // max(last[k] - first[k], 1)))
            near = slice(first[rows].min(), last[rows].max())
            d = (u[None, near] - u[rows, None]) / h[rows, None]
            w = np.abs(d)
            w = np.clip(1 - w * w * w, 0, None)
            w = w * w * w
            s = w @ some[near]
            empty[rows] = s <= 0
            s = np.where(empty[rows], 1, s)
            my, mx = w @ total[near] / s, (w * d) @ some[near] / s
            d -= mx[:, None]
            v = (w * d * d) @ some[near]
            cov = (w * d) @ total[near] - my * ((w * d) @ some[near])
            flat = v * h[rows] ** 2 <= 1e-12
            line[rows] = my - np.where(flat, 0, cov / np.where(flat, 1, v) * mx)
            k = rows.stop
        fit = np.where(empty[at], y, line[at])
        res = np.abs(y - fit)
        m = 6 * np.median(res)
        if m < 1e-12:
            break
        robust = np.clip(1 - (res / m) ** 2, 0, None) ** 2
    return fit


def smoothing_spline(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural cubic smoothing spline at the different x, as smooth as generalised cross-validation asks.
    Equal x are one point of their mean, weighted by their number."""
    u, at, w = np.unique(x, return_inverse=True, return_counts=True)
    mean = np.bincount(at, y) / w
    n = len(u)
    if n < 4:
        return u, mean
    h = np.diff(u)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 3 < n:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    root = np.sqrt(w)
    d, vec = np.linalg.eigh((q @ np.linalg.solve(r, q.T)) / np.outer(root, root))
    d, z, within = np.maximum(d, 0), vec.T @ (root * mean), float(((y - mean[at]) ** 2).sum())
    d[:2] = 0  # a line costs nothing

    def score(log_lam: float) -> float:
        keep = 1 / (1 + np.exp(log_lam) * d)
        return (float((((1 - keep) * z) ** 2).sum()) + within) / (1 - keep.sum() / len(x)) ** 2

    tried = np.linspace(-np.log(d[-1]) - 7, -np.log(d[2]) + 7, 60)  # from hardly any smoothing to nearly a line
    k = int(np.argmin([score(t) for t in tried]))
    low, high = tried[max(k - 1, 0)], tried[min(k + 1, 59)]
    for _ in range(40):
        third = (high - low) / 3
        low, high = (low, high - third) if score(low + third) < score(high - third) else (low + third, high)
    return u, vec @ (z / (1 + np.exp((low + high) / 2) * d)) / root


def smooth(means: DataFrame, f: float = 2 / 3, method: str = "lowess") -> DataFrame:
    """Adds ``fit`` and ``fit_scaled``; a gene's windows are one group. A spline leaves one row for each
    pseudotime, the one of the first window there."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["pt", "window"])
        x = d["pt"].to_numpy(float)
        fit = [smoothing_spline(x, d[c].to_numpy(float))[1] if method == "spline" else lowess(x, d[c].to_numpy(float), f) for c in ("mean", "scaled")]
        if method == "spline":
            d = d.drop_duplicates("pt")
        return d.assign(fit=fit[0], fit_scaled=fit[1])

    return means.groupBy("gene").applyInPandas(run, "gene string, window int, pt double, mean double, scaled double, fit double, fit_scaled double")


def crop(fits: DataFrame, low: float = -math.inf, high: float = math.inf) -> DataFrame:
    return fits.where(F.col("pt").between(low, high))


def combine_fits(fits: dict[str, DataFrame]) -> DataFrame:
    """Fits side by side, scaled to the largest mean of a gene over all."""
    from functools import reduce

    all_ = reduce(DataFrame.unionByName, [d.withColumn("type", F.lit(n)) for n, d in fits.items()])
    top = F.max("mean").over(W.partitionBy("gene"))
    return all_.withColumns({"scaled": F.coalesce(F.try_divide("mean", top), F.lit(0.0)), "fit_scaled": F.coalesce(F.try_divide("fit", top), F.lit(0.0))})


def _single(x, p):
    return p[1] + (p[2] - p[1]) / (1 + np.exp(np.clip(p[0] * (x - p[3]), -60, 60)))


def _double(x, p):
    b1, b2, h0, h1, h2, t1, t2 = p
    return _single(x, (b1, h0, h1, t1)) * _single(x, (b2, h2, h1, t2)) / (h1 if abs(h1) > 1e-9 else 1e-9)


def _slope(x, p):
    s = 1 / (1 + np.exp(np.clip(p[0] * (x - p[3]), -60, 60)))
    return p[0] * (p[1] - p[2]) * s * (1 - s)


def _slope_double(x, p):
    b1, b2, h0, h1, h2, t1, t2 = p
    up, down = (b1, h0, h1, t1), (b2, h2, h1, t2)
    return (_slope(x, up) * _single(x, down) + _single(x, up) * _slope(x, down)) / (h1 if abs(h1) > 1e-9 else 1e-9)


def fit_curve(f, x: np.ndarray, y: np.ndarray, starts: list, low=-math.inf, high=math.inf, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Best of several Levenberg-Marquardt fits whose parameters stay between ``low`` and ``high``."""
    best, least = np.clip(np.array(starts[0], float), low, high), math.inf
    for p in starts:
        p, lam = np.clip(np.array(p, float), low, high), 1e-2
        r = f(x, p) - y
        sse = float(r @ r)
        for _ in range(rounds):
            j = np.stack([(f(x, p + e) - f(x, p - e)) / 2e-5 for e in np.eye(len(p)) * 1e-5], 1)
            a, g = j.T @ j, j.T @ r
            step = np.linalg.lstsq(a + lam * np.diag(np.diag(a) + 1e-9), -g, rcond=None)[0]
            q = np.clip(p + step, low, high)
            r2 = f(x, q) - y
            s2 = float(r2 @ r2)
            if s2 < sse:
                done = sse - s2 < 1e-10 * (1 + sse)
                p, r, sse, lam = q, r2, s2, lam / 3
                if done:
                    break
            else:
                lam *= 4
                if lam > 1e8:
                    break
        if sse < least:
            best, least = p, sse
    return best, least


def _root(f, lo: float, hi: float) -> float:
    """Where ``f``, of unlike signs at both ends, is zero: by halving."""
    below = f(lo) < 0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (f(mid) < 0) == below else (lo, mid)
    return (lo + hi) / 2


def _along(f, x: np.ndarray) -> np.ndarray:
    return np.broadcast_to(np.asarray(f(x), float), x.shape)


def monotone_pieces(slope, first: float, last: float, probes: int = 512) -> list[tuple[float, float]]:
    """The stretches between the zeros of a slope, and the ends."""
    x = np.linspace(first, last, probes)
    sign = np.sign(_along(slope, x))
    known = np.flatnonzero(sign)
    turns = [(x[i], x[j]) for i, j in zip(known, known[1:]) if sign[i] != sign[j]]
    ends = [first, *(_root(slope, i, j) for i, j in turns), last]
    return list(zip(ends, ends[1:]))


def _steepest(slope, start: float, end: float, probes: int = 128) -> tuple[float, float]:
    """(place, slope) where a monotone piece is steepest."""
    x = np.linspace(start, end, probes)
    d = _along(slope, x)
    k = int(np.abs(d).argmax())
    return float(x[k]), float(d[k])


def is_pulse(value, slope, first: float, last: float, min_slope: float = 0.1) -> bool:
    """Whether a curve rises and falls, or falls and rises: steeply enough both ways, and with turning points
    that stand out. One stands out by what it differs from the next turning point, of which a quarter
    of the curve's range is asked, and from an end, of which a tenth is."""
    cut = monotone_pieces(slope, first, last)
    steep = [_steepest(slope, *c)[1] for c in cut]
    if max(steep) < min_slope or min(steep) > -min_slope:
        return False
    levels = np.array([float(value(v)) for v in (cut[0][0], *(c[1] for c in cut))])
    height, span = np.abs(np.diff(levels)), float(np.ptp(levels))
    asked = np.full(len(cut), 0.25)
    asked[[0, -1]] = 0.1
    inner = slice(None) if len(cut) == 2 else slice(1, -1)  # beside two turning points the ends may be low
    return bool((height[inner] >= asked[inner] * span).all())


def change_times(value, slope, first: float, last: float) -> tuple[list[float], list[float]]:
    """(onsets, offsets): in each piece that rises or falls, the time at which the slope has grown to half of its
    steepest. Of several pieces the first and the last count if they cover more than a quarter of the
    curve's range. Minus infinity and infinity stand for none."""
    cut = monotone_pieces(slope, first, last)
    ends = [float(value(v)) for v in (cut[0][0], *(c[1] for c in cut))]
    span = max(ends) - min(ends)
    found: dict[bool, list[float]] = {True: [], False: []}
    for k, (start, end) in enumerate(cut):
        if len(cut) > 1 and k in (0, len(cut) - 1) and abs(ends[k + 1] - ends[k]) <= 0.25 * span:
            continue
        at, most = _steepest(slope, start, end)
        if not most:
            continue
        lacks = lambda v, most=most: abs(float(slope(v))) - abs(most) / 2
        found[most > 0].append(_root(lacks, start, at) if lacks(start) < 0 else start)
    return found[True] or [-math.inf], found[False] or [math.inf]


def impulse(x: np.ndarray, y: np.ndarray, starts: int = 8, seed: int = 1, pulse_only: bool = True, min_slope: float = 0.1) -> dict:
    """Line (0), one step (1) or two (2), whichever leaves the least error; two steps that make no pulse
    give way to the next best. Onsets and offsets are those of ``change_times``, for a line where it meets
    zero; of several, ``time_on`` is the first and ``time_off`` the last."""
    rng = np.random.default_rng(seed)
    line = np.polyfit(x, y, 1) if len(x) > 1 else np.array([0.0, float(y[0])])
    lo, hi, first, last = (float(v) for v in (y.min(), y.max(), x.min(), x.max()))
    span, reach = max(last - first, 1e-6), hi - lo
    draw = lambda: first + span * float(rng.random())
    inf = math.inf
    s1 = [(s * 10 / span, lo, hi, draw()) for _ in range(starts) for s in (-1, 1)]
    s2 = [(-10 / span, 10 / span, float(y[0]), hi, float(y[-1]), *sorted((draw(), draw()))) for _ in range(starts)]
    one, error_1 = fit_curve(_single, x, y, s1, (-inf, lo - reach / 2, lo - reach / 2, first - 1), (inf, hi + reach / 2, hi + reach / 2, last + 1))
    two, error_2 = fit_curve(_double, x, y, s2, (-inf, -inf, *[lo - reach] * 3, first - 1, first - 1), (inf, inf, *[hi + reach] * 3, last + 1, last + 1))
    fits = [
        (float(((np.polyval(line, x) - y) ** 2).sum()), 0, None, None),
        (error_1, 1, lambda v: _single(v, one), lambda v: _slope(v, one)),
        (error_2, 2, lambda v: _double(v, two), lambda v: _slope_double(v, two)),
    ]
    for sse, kind, value, slope in sorted(fits, key=lambda f: f[0]):
        if kind < 2 or not pulse_only or is_pulse(value, slope, first, last, min_slope):
            break
    if kind:
        on, off = change_times(value, slope, first, last)
    else:
        at = [float(-line[1] / line[0])] if line[0] else []
        on, off = (at, []) if line[0] > 0 else ([], at)
    on, off = on or [-inf], off or [inf]
    return {"type": kind, "time_on": min(on), "time_off": max(off), "times_on": on, "times_off": off, "sse": sse}


def cascade(means: DataFrame, starts: int = 8) -> DataFrame:
    """(gene, type, time_on, time_off, times_on, times_off, sse), in order of onset and offset."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("pt")
        r = impulse(d["pt"].to_numpy(float), d["scaled"].to_numpy(float), starts)
        return pd.DataFrame({"gene": [d["gene"].iloc[0]], **{k: [v] for k, v in r.items()}})

    return means.groupBy("gene").applyInPandas(run, "gene string, type int, time_on double, time_off double, times_on array<double>, times_off array<double>, sse double").orderBy("time_on", "time_off", "gene")


# coordinates ----------------------------------------------------------------------------------


def rotate(x: str | Column, y: str | Column, z: str | Column, angle: float, axis: str) -> list[Column]:
    """Row vectors times the rotation matrix about an axis."""
    c, s = math.cos(angle), math.sin(angle)
    x, y, z = (F.col(v) if isinstance(v, str) else v for v in (x, y, z))
    return {"x": [x, y * c + z * s, z * c - y * s], "y": [x * c - z * s, y, x * s + z * c], "z": [x * c + y * s, y * c - x * s, z]}[axis]


def subtree_cells(joins: DataFrame, cell_segment: DataFrame, segment) -> DataFrame:
    """(cell) of a segment and of all below it."""
    from trellis.operators.tree import ancestors

    below = ancestors(joins).where(F.col("ancestor") == F.lit(segment)).select("segment")
    own = cell_segment.where(F.col("segment") == F.lit(segment)).select("cell")
    return own.union(cell_segment.join(below, "segment", "left_semi").select("cell")).distinct()


def by_age(cells: DataFrame, pt: DataFrame, n: int) -> DataFrame:
    """(cell, pseudotime) of the ``n`` cells of least pseudotime, ties by cell; the driver asks for so few."""
    return cells.select("cell").distinct().join(pt.where("pseudotime is not null").select("cell", "pseudotime"), "cell").orderBy("pseudotime", "cell").limit(n)


def rotate_cells(points: DataFrame, angle: float, axis: str = "z", cells: DataFrame | None = None, around=None, pt: DataFrame | None = None, spare: int = 0) -> DataFrame:
    """``points`` (cell, x, y, z, ...) with some of them turned about an axis through a cell, or through the origin.

    ``cells``: which are turned, all if not given, but for the ``spare`` youngest of them. ``around``: a cell's name
    in a list of one, or a whole number k for the k-th youngest of those turned.
    """
    chosen = points.select("cell") if cells is None else cells.select("cell").distinct().join(points.select("cell"), "cell", "left_semi")
    if spare:
        chosen = chosen.join(by_age(chosen, pt, spare), "cell", "left_anti")
    at = (0.0, 0.0, 0.0)
    if around is not None:
        name = by_age(chosen, pt, around).orderBy(F.desc("pseudotime"), F.desc("cell")).first()["cell"] if isinstance(around, int) else around[0]
        at = tuple(points.where(F.col("cell") == F.lit(name)).select("x", "y", "z").first())
    turned = dict(zip("xyz", rotate(*[F.col(c) - v for c, v in zip("xyz", at)], angle, axis), strict=True))
    met = points.join(chosen.select("cell", F.lit(True).alias("_turn")), "cell", "left")
    return met.withColumns({c: F.when(F.col("_turn"), turned[c] + v).otherwise(F.col(c)) for c, v in zip("xyz", at)}).drop("_turn")


def translate(df: DataFrame, chosen: Column, dx: float = 0, dy: float = 0, dz: float = 0) -> DataFrame:
    return df.withColumns({c: F.when(chosen, F.col(c) + d).otherwise(F.col(c)) for c, d in (("x", dx), ("y", dy), ("z", dz))})


def stretch(df: DataFrame, chosen: Column, factor: float, start: int = 20, ramp: float = 0.1) -> DataFrame:
    """Heights of chosen rows scaled about the ``start``-th lowest, ramping up to ``factor``."""
    low = df.where(chosen).orderBy("z").limit(start).agg(F.max("z").alias("_z0"))
    d = df.crossJoin(F.broadcast(low))
    up = F.col("z") - F.col("_z0")
    f = 1 + (factor - 1) * F.least(F.greatest(up / ramp, F.lit(0.0)), F.lit(1.0))
    return d.withColumn("z", F.when(chosen & (up > 0), F.col("_z0") + up * f).otherwise(F.col("z"))).drop("_z0")


def interpolate_points(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for c, w in weights.items():
        out = out + F.col(c) * w
    return out


def dendrogram(joins: list[tuple[int, int, float]]) -> dict[int, float]:
    """x of each segment: leaves side by side, a parent in the middle of its children."""
    children: dict[int, list[int]] = {}
    for p, c, _ in joins:
        children.setdefault(p, []).append(c)
    root = next(iter(set(children) - {c for _, c, _ in joins}), None)
    x: dict[int, float] = {}
    stack, leaf = [(root, False)] if root is not None else [], 0
    while stack:
        s, done = stack.pop()
        if s not in children:
            x[s] = float(leaf)
            leaf += 1
        elif done:
            x[s] = sum(x[c] for c in children[s]) / len(children[s])
        else:
            stack += [(s, True), *((c, False) for c in reversed(sorted(children[s])))]
    return x


def layout_cells(cell_node: DataFrame, node_x: DataFrame, pt: DataFrame, jitter: float = 0.15, push: float = 0.05, seed: int = 1) -> DataFrame:
    u = (F.pmod(F.xxhash64(F.lit(seed), "cell"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    side = F.when(F.pmod(F.xxhash64(F.lit(seed + 1), "cell"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return cell_node.join(node_x, "node").join(pt, "cell").select("cell", (F.col("x") + side * (push + jitter * u)).alias("x"), F.col("pseudotime").alias("y"))


def branch_preference(visits: DataFrame, pt: DataFrame, side1: list, side2: list, parent: list, opposite: list, min_visit: float = 0.0) -> DataFrame:
    """Signed preference for one of two lineages and for their parent over what is opposite."""
    from trellis.functions.expr import preference

    most = lambda s: F.coalesce(F.max(F.when(F.col("segment").isin(s), F.col("v"))), F.lit(0.0))
    g = visits.groupBy("cell").agg(most(side1).alias("v1"), most(side2).alias("v2"), most(parent).alias("vp"), most(opposite).alias("vo"))
    g = g.withColumns({"preference": preference("v1", "v2", signed=True), "parent_preference": preference("vp", "vo", signed=True), "visited": F.log10(F.col("v1") + F.col("v2") + 1)})
    return g.where((F.col("parent_preference") >= 0.1) & (F.col("visited") >= min_visit)).join(pt, "cell").select("cell", "preference", "parent_preference", "visited", "pseudotime")


def layout_density(points: DataFrame, scratch, neighbor: int = 10) -> DataFrame:
    """(cell, n_dist): distance to the ``neighbor``-th nearest of all points (x, y, z), itself the first."""
    from trellis.operators.neighbors import knn_exact

    near = knn_exact(points.select("cell", F.array("x", "y", "z").alias("vec")), neighbor - 1, scratch)
    return near.where(F.col("rank") == neighbor - 1).select("cell", F.col("dist").alias("n_dist"))


def tip_labels(points: DataFrame, spacing: float = 5.0) -> DataFrame:
    """(segment, x, y, z) from (cell, segment, pseudotime, x, y, z): ``spacing`` from the last cell of each
    segment, in the direction of its fifth last. Segments of fewer cells, or without a direction, have none."""
    w = W.partitionBy("segment").orderBy(F.desc("pseudotime"), "cell")
    at = lambda r: F.max(F.when(F.col("r") == r, F.struct("x", "y", "z"))).alias(f"p{r}")
    ends = points.withColumn("r", F.row_number().over(w)).where("r in (1, 5)").groupBy("segment").agg(at(1), at(5))
    step = {c: F.col(f"p5.{c}") - F.col(f"p1.{c}") for c in "xyz"}
    far = F.sqrt(step["x"] * step["x"] + step["y"] * step["y"] + step["z"] * step["z"])
    return ends.where(far > 0).select("segment", *[(F.col(f"p1.{c}") + step[c] * spacing / far).alias(c) for c in "xyz"])
