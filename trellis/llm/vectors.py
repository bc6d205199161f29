"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors by the concatenated signs of their projections on random directions
and compares each vector with those at most ``window`` places before it. Ranks of all passes
travel with a vector, so a task knows for any pair whether an earlier pass has met it: links are
counted once without gathering pairs. A task hands on only counts and a spanning forest of the
links it found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.llm.common import Scratch
from trellis.llm.components import connected_components


def _keys(matrix: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """One 63-bit number a row and pass: the signs of 63 projections, the first one highest."""
    weights = 1 << np.arange(62, -1, -1, dtype=np.int64)
    out = []
    for p in range(passes):
        directions = np.random.default_rng((seed, p, matrix.shape[1])).standard_normal((matrix.shape[1], 63))
        out.append(((matrix @ directions) > 0).astype(np.int64) @ weights)
    return np.stack(out, axis=1)


def _matrices(vectors: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of unit vectors) for each number of dimensions."""
    n = np.array([len(v) for v in vectors])
    for d in np.unique(n):
        at = np.flatnonzero(n == d)
        m = np.stack([np.asarray(vectors[i], np.float64) for i in at])
        m /= np.abs(m).max(axis=1, keepdims=True)  # no overflow in the norm
        yield at, m / np.linalg.norm(m, axis=1, keepdims=True)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def passes_for(n: int, cosine: float, window: int, least: int = 8, missed: float = 0.05) -> int:
    """Passes after which a pair at the threshold is missed with at most that probability: two
    vectors agree on a sign with one minus their angle over pi, and meet where they agree on as many
    leading signs as n vectors need to stand ``window`` apart."""
    signs = max(math.log2(max(n, 1) / window), 0.0)
    meet = (1 - math.acos(cosine) / math.pi) ** signs
    return least if meet >= 1 else max(least, math.ceil(math.log(missed) / math.log1p(-meet)))


def near_duplicates(rows: DataFrame, scratch: Scratch, cosine: float = 0.9, passes: int | None = None, window: int = 512, block: int = 2048, seed: int = 7, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row a vector: id_col, n_links, component_id, kept.

    Equal vectors are folded into a class before anything is compared; a class of m gives each
    member m - 1 links to its copies. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different length with each other,
    nor rows without an id. Without ``passes`` their number follows that of the vectors, so that
    recall does not fall with it. In a cluster of more vectors than all windows hold ``n_links`` counts
    those that met, fewer than there are; its component is whole. An empty table gives an empty result; other columns are ignored.
    """
    v = F.col(vector)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    # 0.0 and -0.0 are one value
    source = rows.select(F.col(id_col).alias("id"), F.when(sound & F.col(id_col).isNotNull(), F.transform(v, lambda x: x.cast("double") + F.lit(0.0))).alias("v"))
    classes = source.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    classes = scratch.table(classes, "classes")
    kind = classes.schema["rep"].dataType.simpleString()
    passes = passes or passes_for(classes.count(), cosine, window)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [np.asarray(x.values) for x in b.column(1)]
            keys = np.zeros((len(vectors), passes), np.int64)
            for at, m in _matrices(vectors):
                keys[at] = _keys(m, passes, seed)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, passes), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in vectors], pa.int32()), flat], names=["rep", "d", "keys"])

    keyed = classes.select("rep", "v").mapInArrow(hashed, f"rep {kind}, d int, keys array<bigint>")
    placed = keyed.select("rep", "d", F.posexplode("keys").alias("p", "key")).repartitionByRange("p", "d", "key", "rep").sortWithinPartitions("p", "d", "key", "rep")
    placed = scratch.table(placed.select("rep", "p", F.monotonically_increasing_id().alias("at")), "placed")
    part = F.shiftright("at", 33).alias("part")
    # one row for each range partition and pass
    sizes = placed.groupBy("p", part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    sizes = sizes.withColumn("before", F.sum("n").over(W.partitionBy("p").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    ranked = placed.withColumn("part", part).join(sizes, ["p", "part"]).select("rep", "p", (F.coalesce("before", F.lit(0)) + F.col("at") - F.col("first")).alias("rank"))
    ranks = ranked.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "rank"))), lambda x: x["rank"]).alias("ranks"))
    full = scratch.table(classes.join(ranks, "rep"), "ranked")

    rank = F.element_at("ranks", F.col("p") + 1)
    own = F.floor(rank / block)
    dealt = full.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("k", F.explode(F.when(rank % block >= block - window, F.array(own, own + 1)).otherwise(F.array(own))))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        p, k = (x.as_py() for x in key)
        table = table.combine_chunks()
        vectors = [np.asarray(x.values) for x in table["v"]]
        r = np.array(table["ranks"].to_pylist(), np.int64).reshape(-1, passes)
        m = table["m"].to_numpy()
        links = np.zeros(len(m), np.int64)
        ends_a, ends_b = [], []
        for at, x in _matrices(vectors):
            order = at[np.argsort(r[at, p])]
            x = x[np.argsort(r[at, p])]
            for s in range(0, len(order), 512):
                lo = max(0, s - window)
                near = x[s : s + 512] @ x[lo : s + 512].T
                i, j = np.nonzero(near >= cosine)
                a, b = order[i + s], order[j + lo]
                gap = r[a, p] - r[b, p]
                ok = (gap > 0) & (gap <= window) & (r[a, p] // block == k)
                a, b = a[ok], b[ok]
                ends_a.append(a)
                ends_b.append(b)
                fresh = ~(np.abs(r[a, :p] - r[b, :p]) <= window).any(axis=1)
                links += np.bincount(a[fresh], m[b[fresh]], minlength=len(m)).astype(np.int64)
                links += np.bincount(b[fresh], m[a[fresh]], minlength=len(m)).astype(np.int64)
        a, b = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in (ends_a, ends_b))
        root = _forest(len(m), a, b)
        used = np.flatnonzero((links > 0) | (root != np.arange(len(m))))
        rep = table["rep"].combine_chunks() if isinstance(table["rep"], pa.ChunkedArray) else table["rep"]
        return pa.table([rep.take(pa.array(used)), pa.array(links[used]), rep.take(pa.array(root[used]))], names=["rep", "links", "root"])

    found = dealt.select("p", "k", "rep", "v", "m", "ranks").groupBy("p", "k").applyInArrow(compare, f"rep {kind}, links long, root {kind}")
    found = scratch.table(found, "found")
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(parts, "rep", "left").select("v", F.col("m") - 1 + F.coalesce("links", F.lit(0)), F.coalesce("component", "rep")).toDF("v", "n", "c")
    return source.join(known, "v", "left").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
