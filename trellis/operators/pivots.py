"""Exact neighbours and ranges of distances by pivots.

Every vector belongs to the nearest of some pivots. What is known of such a home, its radius and size,
bounds the distance from any vector to all it holds; a home that cannot matter is not visited,
one that matters as a whole is counted without a comparison. Pivots follow the square root of the
number of vectors within a fixed number of bytes, so their table can go to every task.

Queries of near homes make blocks of a fixed size. A task holds one block, and the members of all homes
that any of its queries needs pass by it in Arrow batches; so a member is copied once a block, not
once a query, and what a task holds does not grow with the table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIVOT_BYTES = 32 << 20
#: Queries that a task holds at once, and the bytes of their vectors.
BLOCK, BLOCK_BYTES = 16_384, 8 << 20
#: Members of one home that a block meets at once, distances that are looked at together, pairs that are told exactly together.
STRIP, CELLS, PAIRS = 1024, 1 << 21, 100_000
#: Rounding of distances, on the safe side of every bound: relative, and of squares as a share of the squared lengths.
SLACK, SQUARE = 1e-9, 1e-11
#: Up to so many rows comparing all of them, in blocks, costs less than the jobs that pivots take; results are the same.
FEW = 10_000


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = x @ y.T
    out *= -2
    out += (x * x).sum(1)[:, None]
    out += (y * y).sum(1)[None, :]
    return out


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(_squares(x, y), 0))


def _rounding(x: np.ndarray, y: np.ndarray) -> float:
    """What a distance by a difference of squares can be wrong by."""
    return 1e-6 * math.sqrt(max((x * x).sum(1).max(initial=0), (y * y).sum(1).max(initial=0)))


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _strips(b: pd.DataFrame, width: int):
    """(part, vectors) of a batch, so that a table of a part by ``width`` stays small."""
    for at in range(0, len(b), step := max(1, CELLS // max(width, 1))):
        yield (part := b.iloc[at : at + step]), _rows(part["vec"])


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (i, j), exact sums in pieces."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        s = slice(at, at + PAIRS)
        out[s] = np.sqrt(((x[i[s]] - y[j[s]]) ** 2).sum(1))
    return out


class _Block:
    """Queries of one task, and what is known of their distances to homes."""

    def __init__(self, batches: list[pa.RecordBatch], held):
        self.ids = pa.concat_arrays([b["id"] for b in batches])
        self.x, self.home, self.value = _vectors(batches), *(np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in batches]) for c in ("home", "value"))
        self.xx, self.held, self.compared = (self.x * self.x).sum(1), held, 0
        self.wide = np.concatenate([-2 * self.x, np.ones((len(self.x), 1))], axis=1)
        if held is not None:
            pivots = held.value[0]
            self.off = _rounding(self.x, pivots)
            own = pivots[self.home]
            self.own, self.at = np.sqrt(((self.x - own) ** 2).sum(1)), np.unique(self.home, return_inverse=True)

    def beside(self, y: np.ndarray, q) -> np.ndarray:
        """Squares of the distances from the queries ``q`` to ``y``, less those of the queries' lengths; one product."""
        return self.wide[q] @ np.concatenate([y, (y * y).sum(1)[:, None]], axis=1).T

    def reach(self, home: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest distance from each query to what a home holds."""
        pivots, _, radius = self.held.value
        d = np.sqrt(np.maximum(self.beside(pivots[home : home + 1], slice(None))[:, 0] + self.xx, 0))
        low = d - radius[home]
        # all in another home are nearer to its pivot than to a query's own
        homes, of = self.at
        apart = np.sqrt(((pivots[homes] - pivots[home]) ** 2).sum(1))[of]
        plane = np.where(apart > self.off, (d * d - self.own * self.own) / np.where(apart > self.off, 2 * apart, np.inf), -np.inf)
        return np.maximum(low, plane) * (1 - SLACK) - self.off, (d + radius[home]) * (1 + SLACK) + self.off


class _Nearest(_Block):
    """The ``k`` nearest of all members that pass, by distance, then id; ``value`` bounds the distance of the kth."""

    schema = staticmethod(lambda q, m: f"id {q}, nbr {m}, dist double")

    def __init__(self, batches, held, k: int):
        super().__init__(batches, held)
        self.k, self.bound = k, self.value.copy()
        self.best: list[tuple] = []  # (query, distance, name) of candidates
        self.kept = self.waiting = 0

    def meet(self, home: int, y: np.ndarray, names: np.ndarray, _: np.ndarray) -> None:
        active = np.arange(len(self.x)) if self.held is None else np.flatnonzero(self.reach(home)[0] <= self.bound)
        yy, self.compared = (y * y).sum(1).max(), self.compared + len(active) * len(y)
        for at in range(0, len(active), step := max(1, CELLS // len(y))):
            q = active[at : at + step]
            d2, xx = self.beside(y, q), self.xx[q]
            off = SQUARE * (xx + yy)
            i, j = np.nonzero(d2 <= (self.bound[q] ** 2 * (1 + SLACK) + off - xx)[:, None])
            many = np.flatnonzero(np.bincount(i, minlength=len(q)) > self.k)
            if len(many):
                kth = np.partition(d2[many], self.k - 1, axis=1)[:, self.k - 1] + xx[many]
                self.bound[q[many]] = np.minimum(self.bound[q[many]], np.sqrt(np.maximum(kth, 0) + 2 * off[many]))
                near = d2[i, j] <= (self.bound[q] ** 2 * (1 + SLACK) + off - xx)[i]
                i, j = i[near], j[near]
            for s in range(0, len(i), PAIRS):
                a, b = i[s : s + PAIRS], j[s : s + PAIRS]
                self.best.append((q[a], _exact(self.x, y, q[a], b), names[b]))
                self.waiting += len(a)
                if self.waiting > max(self.kept, self.k * len(self.x)):
                    self.merge()

    def merge(self) -> None:
        if not self.best:
            return
        q, d, names = (np.concatenate(c) for c in zip(*self.best, strict=True))
        order = np.lexsort((np.unique(names, return_inverse=True)[1] if names.dtype == object else names, d, q))
        q = q[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, full = order[nth < self.k], q[nth < self.k], nth[nth < self.k] == self.k - 1
        d, names = d[order], names[order]
        self.bound[q[full]] = np.minimum(self.bound[q[full]], d[full])
        self.best, self.kept, self.waiting = [(q, d, names)], len(q), 0

    def result(self, kinds: tuple) -> pa.RecordBatch | None:
        self.merge()
        if self.best:
            q, d, names = self.best[0]
            return pa.RecordBatch.from_arrays([self.ids.take(pa.array(q)), pa.array(names, kinds[1]), pa.array(d)], names=["id", "nbr", "dist"])


class _Within(_Block):
    """How many members lie at distances of ``low`` to ``high``, and how many of them have no later time, the ``value``."""

    schema = staticmethod(lambda q, m: f"id {q}, n long, earlier long")

    def __init__(self, batches, held, low: float, high: float):
        super().__init__(batches, held)
        self.low, self.high, self.names = low, high, self.ids.to_numpy(zero_copy_only=False)
        self.n, self.earlier = (np.zeros(len(self.x), np.int64) for _ in range(2))

    def meet(self, home: int, y: np.ndarray, names: np.ndarray, times: np.ndarray) -> None:
        least, most = self.reach(home)
        # a home wholly within has no distance zero in it unless the range begins there
        whole = (least > self.low) & (most < self.high) & (self.low > 0)
        if whole.any():
            self.n[whole] += len(y)
            self.earlier[whole] += np.searchsorted(np.sort(times), self.value[whole], "right")
        active = np.flatnonzero(~whole & (most >= self.low) & (least <= self.high))
        yy, self.compared = (y * y).sum(1).max(), self.compared + len(active) * len(y)
        for at in range(0, len(active), step := max(1, CELLS // len(y))):
            q = active[at : at + step]
            d2, xx = self.beside(y, q), self.xx[q]
            off = SQUARE * (xx + yy)
            low, high = self.low**2 - xx, self.high**2 - xx
            ok = (d2 >= (low - off)[:, None]) & (d2 <= (high + off)[:, None])
            # what rounding leaves open, by exact sums; a row is no neighbour of itself, at a distance of nothing
            i, j = np.nonzero(ok & ((d2 <= (low + off)[:, None]) | (d2 >= (high - off)[:, None])))
            d = _exact(self.x, y, q[i], j)
            ok[i, j] = (d >= self.low) & (d <= self.high) & (self.names[q[i]] != names[j])
            self.n[q] += np.count_nonzero(ok, axis=1)
            ok &= times[None, :] <= self.value[q][:, None]
            self.earlier[q] += np.count_nonzero(ok, axis=1)

    def result(self, kinds: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.ids, pa.array(self.n), pa.array(self.earlier)], names=["id", "n", "earlier"])


def _vectors(batches: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([b["vec"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in batches])


def _passed(visitors: DataFrame, members: DataFrame, block: type, options: tuple, held, tasks: int, compared=None) -> DataFrame:
    """What ``block`` makes of ``visitors`` (block, slice, id, vec, home, value) and the ``members`` (block, slice, far, id, vec, home, value)
    that pass them, the nearest first; one row a query and slice."""
    q, m = (df.schema["id"].dataType.simpleString() for df in (visitors, members))
    one = visitors.select("block", "slice", F.lit(None).cast("double").alias("far"), "id", F.lit(None).cast(m).alias("nbr"), "vec", "home", "value", F.lit(False).alias("passes"))
    other = members.select("block", "slice", "far", F.lit(None).cast(q).alias("id"), F.col("id").alias("nbr"), "vec", "home", "value", F.lit(True).alias("passes"))
    met = one.union(other).repartition(tasks, "block", "slice").sortWithinPartitions("block", "slice", "passes", "far", "home")

    def ends(*columns: np.ndarray) -> np.ndarray:
        """Where runs of equal values begin, and the end."""
        new = np.zeros(len(columns[0]), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[:1] = True
        return np.append(np.flatnonzero(new), len(new))

    def end(now: _Block, kinds: tuple):
        if compared is not None:
            compared.add(now.compared)
        if (out := now.result(kinds)) is not None:
            yield out

    def run(batches):
        key, waiting, now, kinds = None, [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            kinds = (b["id"].type, b["nbr"].type)
            blocks, parts, passes, homes = (b[c].to_numpy(zero_copy_only=False) for c in ("block", "slice", "passes", "home"))
            at = ends(blocks, parts, passes, homes if passes.any() else blocks)
            for s, e in zip(at[:-1], at[1:], strict=True):
                if key != (blocks[s], parts[s]):
                    if now is not None:
                        yield from end(now, kinds)
                    key, waiting, now = (blocks[s], parts[s]), [], None
                if not passes[s]:
                    waiting.append(b.slice(s, e - s))
                    continue
                if now is None:
                    if not waiting:
                        continue
                    now, waiting = block(waiting, held, *options), []
                for t in range(s, e, STRIP):
                    c = b.slice(t, min(STRIP, e - t))
                    now.meet(int(homes[s]), _vectors([c]), c["nbr"].to_numpy(zero_copy_only=False), c["value"].to_numpy(zero_copy_only=False))
        if now is not None:
            yield from end(now, kinds)

    return met.mapInArrow(run, block.schema(q, m))


def _sizes(n: int, width: int, cores: int) -> tuple[int, int, int]:
    """(queries a block, slices of members, tasks): several tasks a core, few copies of a row."""
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(width, 1))))
    size = max(1, min(most, max(math.ceil(n / cores), min(most, 1000))))
    blocks = max(1, math.ceil(n / size))
    return size, max(1, min(4, math.ceil(2 * cores / blocks))), blocks


def _top(found: DataFrame, k: int) -> DataFrame:
    top = W.partitionBy("id").orderBy("dist", "nbr")
    return found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("id", "nbr", "dist")


def _part(slices: int):
    return F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")


def all_pairs(queries: DataFrame, members: DataFrame, k: int, n: int, width: int = 1) -> DataFrame:
    """What ``Index.nearest`` gives, by comparing all of few rows in blocks."""
    size, slices, blocks = _sizes(n, width, members.sparkSession.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    plain = lambda df, value: df.select("id", "vec", F.lit(-1).alias("home"), F.lit(value).alias("value"))
    v = plain(queries, float("inf")).withColumn("block", _part(blocks)).withColumn("slice", every(slices))
    m = plain(members, 0.0).withColumns({"far": F.lit(0.0), "slice": _part(slices)}).withColumn("block", every(blocks))
    return _top(_passed(v, m, _Nearest, (k,), None, blocks * slices), k)


class Index:
    """(id, vec, ...) by home, written once. ``compared`` adds up the pairs that were compared, as tasks end."""

    def __init__(self, rows: DataFrame, scratch, name: str = "homes", pivots: int | None = None):
        self.scratch, self.name, self.passes = scratch, name, 0
        self.pairs = rows.sparkSession.sparkContext.accumulator(0)
        # 0.0 and -0.0 are one value
        rows = rows.withColumn("vec", F.transform("vec", lambda x: x.cast("double") + F.lit(0.0)))
        n = rows.count()
        m = pivots or math.ceil(2 * math.sqrt(max(n, 1)))
        one = rows.select("vec").limit(1).collect()
        m = max(1, min(m, PIVOT_BYTES // (8 * max(1, len(one[0]["vec"]) if one else 1))))
        found = [tuple(r["vec"]) for r in rows.orderBy(F.xxhash64("vec"), "id").select("vec").limit(m).collect()]
        self.pivots = np.array(sorted(set(found)), float).reshape(len(set(found)), len(found[0]) if found else 0)
        if len(self.pivots) > 2:  # near ones beside each other, so that blocks of successive homes are narrow
            lead = self.pivots[:: max(1, round(math.sqrt(len(self.pivots))))]
            self.pivots = self.pivots[np.argsort(_far(self.pivots, lead).argmin(1), kind="stable")]
        held = rows.sparkSession.sparkContext.broadcast(self.pivots)

        def home(batches):
            for b in batches:
                for part, x in _strips(b, len(held.value)):
                    at = _squares(x, held.value).argmin(1)
                    yield part.assign(home=at.astype(np.int32), to_home=np.sqrt(((x - held.value[at]) ** 2).sum(1)))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", home int, to_home double"
        self.table = scratch.table(rows.mapInPandas(home, schema), name)
        self.size, self.radius = np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots))
        for r in self.table.groupBy("home").agg(F.count("*").alias("n"), F.max("to_home").alias("r")).collect():
            self.size[r["home"]], self.radius[r["home"]] = r["n"], r["r"]
        self.held = rows.sparkSession.sparkContext.broadcast((self.pivots, self.size, self.radius))

    @property
    def compared(self) -> int:
        return self.pairs.value

    def _meet(self, queries: DataFrame, needs, value: str | None, block: type, options: tuple) -> DataFrame:
        """``queries`` (id, vec, home, value) in blocks of near homes, each with the members of the homes that ``needs`` gives:
        the least distance of every home from the vectors of a strip, infinite where it does not matter."""
        spark, held, self.passes = self.table.sparkSession, self.held, self.passes + 1
        asked = np.zeros(len(self.size), np.int64)
        for r in queries.groupBy("home").agg(F.count("*").alias("n")).collect():
            asked[r["home"]] = r["n"]
        size, slices, _ = _sizes(int(asked.sum()), self.pivots.shape[1], spark.sparkContext.defaultParallelism)
        # a home of many queries has blocks of its own; others share one
        first, parts, at, room = [], [], 0, size
        for n in asked.tolist():
            if n > room and room < size:
                at, room = at + 1, size
            first.append(at)
            parts.append(max(1, math.ceil(n / size)))
            at, room = (at + parts[-1], size) if n > size else (at, room - n)
        blocks = at + 1
        cut = F.broadcast(spark.createDataFrame([(h, first[h], parts[h]) for h in np.flatnonzero(asked).tolist()], "home int, start int, parts int"))  # a row a pivot
        visitors = queries.join(cut, "home").withColumn("block", (F.col("start") + F.pmod(F.xxhash64("id"), "parts")).cast("int"))
        visitors = self.scratch.table(visitors.select("block", "id", "vec", "home", "value"), f"{self.name}-asked-{self.passes}")

        def met(batches):
            """The homes that the queries of a batch need, by block, with the least distance."""
            for b in batches:
                least: dict[int, np.ndarray] = {}
                for part, x in _strips(b, len(held.value[1])):
                    low, blocks = needs(part, x, held.value), part["block"].to_numpy()
                    for k in np.unique(blocks).tolist():
                        now = low[blocks == k].min(0)
                        least[k] = np.minimum(least[k], now) if k in least else now
                for k, low in least.items():
                    at = np.flatnonzero(np.isfinite(low))
                    yield pd.DataFrame({"block": np.int32(k), "home": at.astype(np.int32), "far": low[at]})

        pairs = visitors.select("block", "vec", "home", "value").mapInPandas(met, "block int, home int, far double").groupBy("block", "home").agg(F.min("far").alias("far"))
        pairs = self.scratch.table(pairs, f"{self.name}-pairs-{self.passes}")
        value = F.col(value) if value else F.lit(0.0)
        members = self.table.select("id", "vec", "home", value.cast("double").alias("value")).withColumn("slice", _part(slices)).join(pairs, "home")
        visitors = visitors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        return _passed(visitors, members, block, options, held, blocks * slices, self.pairs)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(id, nbr, dist): the ``k`` nearest of the indexed rows to each query (id, vec), by distance, then id."""
        held, kind = self.held, queries.schema["id"].dataType.simpleString()

        def first(batches):
            """The home of a query, and a distance within which there are k."""
            pivots, size, radius = held.value
            for b in batches:
                for part, x in _strips(b, len(pivots)):
                    d = _far(x, pivots)
                    reach = d + radius[None, :]
                    order = np.argsort(reach, axis=1)
                    enough = (np.cumsum(size[order], axis=1) >= k).argmax(1)
                    at = np.arange(len(part))
                    bound = reach[at, order[at, enough]] if size.sum() >= k else np.full(len(part), np.inf)
                    yield part.assign(home=np.where(size[None, :] > 0, d, np.inf).argmin(1).astype(np.int32), value=bound * (1 + SLACK) + _rounding(x, pivots))

        def needs(b: pd.DataFrame, x: np.ndarray, held: tuple) -> np.ndarray:
            pivots, size, radius = held
            d, off = _far(x, pivots), _rounding(x, pivots)
            home = b["home"].to_numpy()
            low = d - radius[None, :]
            for h in np.unique(home):  # all in another home are nearer to its pivot than to this one
                of = np.flatnonzero(home == h)
                apart = np.sqrt(((pivots - pivots[h]) ** 2).sum(1))
                plane = (d[of] ** 2 - d[of, h][:, None] ** 2) / np.where(apart > off, 2 * apart, np.inf)[None, :]
                low[of] = np.maximum(low[of], np.where(apart > off, plane, -np.inf))
            low = low * (1 - SLACK) - off
            return np.where((low <= b["value"].to_numpy()[:, None]) & (size[None, :] > 0), low, np.inf)

        fields = f"id {kind}, vec array<double>, home int, value double"
        near_home = self.scratch.table(queries.select("id", F.transform("vec", lambda x: x.cast("double") + F.lit(0.0)).alias("vec")).mapInPandas(first, fields), f"{self.name}-first")
        return _top(self._meet(near_home, needs, None, _Nearest, (k,)), k)

    def earlier_within(self, queries: DataFrame, low: float, high: float) -> DataFrame:
        """(id, n, earlier): how many other rows lie at distances of ``low`` to ``high`` from each query (id, vec, t),
        and how many of them have no later ``t``. Homes wholly within are counted by sorting their ``t``."""
        held, kind = self.held, queries.schema["id"].dataType.simpleString()

        def first(batches):
            for b in batches:
                for part, x in _strips(b, len(held.value[0])):
                    yield part[["id", "vec"]].assign(home=_squares(x, held.value[0]).argmin(1).astype(np.int32), value=part["t"].astype(float))

        def needs(b: pd.DataFrame, x: np.ndarray, held: tuple) -> np.ndarray:
            pivots, size, radius = held
            d, off = _far(x, pivots), _rounding(x, pivots)
            least, most = d - radius[None, :], d + radius[None, :]
            return np.where((most >= low - off) & (least <= high + off) & (size[None, :] > 0), 0.0, np.inf)

        asked = self.scratch.table(queries.select("id", F.transform("vec", lambda x: x.cast("double") + F.lit(0.0)).alias("vec"), "t").mapInPandas(first, f"id {kind}, vec array<double>, home int, value double"), f"{self.name}-times")
        out = self._meet(asked, needs, "t", _Within, (low, high))
        return out.groupBy("id").agg(F.sum("n").alias("n"), F.sum("earlier").alias("earlier"))


def knn(vectors: DataFrame, k: int, scratch, pivots: int | None = None) -> tuple[DataFrame, Index | None]:
    """((cell, rank, nbr, dist), the index used, none for few rows) of (cell, vec): exact Euclidean neighbours, ties by nbr.

    Equal vectors are one query and at most ``k + 1`` of them, the smallest, are indexed; so a vector that
    very many cells share costs no more than any other. Null vectors and those of another length than the
    commonest are left out.
    """
    rows = scratch.table(vectors.where("vec is not null").select(F.col("cell").alias("id"), F.transform("vec", lambda x: x.cast("double") + F.lit(0.0)).alias("vec")), "vectors")
    widths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width, n = (widths[0]["d"], widths[0]["count"]) if widths else (0, 0)
    rows = rows.where(F.size("vec") == width)
    few = rows.withColumn("c", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("c") <= k + 1).select("id", "vec")
    one = rows.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")
    if n <= FEW and pivots is None:
        index, near = None, all_pairs(one, few, k + 1, n, width)
    else:
        index = Index(few, scratch, pivots=pivots)
        near = scratch.table(index.nearest(one, k + 1), "near")
    members = rows.join(one.select(F.col("id").alias("q"), "vec"), "vec").select(F.col("id").alias("cell"), "q")
    met = members.join(near.withColumnRenamed("id", "q"), "q").where("cell <> nbr")
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("cell").orderBy("dist", "nbr")))
    return ranked.where(F.col("rank") <= k).select("cell", "rank", "nbr", "dist"), index
