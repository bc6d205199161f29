"""Biased random walks whose graph stays where it is.

Cells are dealt into blocks along an order, such as pseudotime, in which walks move slowly. The
graph is a table bucketed by block, so it is never shuffled again; in a round a task takes one block
with the walkers that stand in it and lets them walk until they leave it. Only walkers that cross into
another block go through the next shuffle, so rounds follow crossings, not steps.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.plans.order import ranked

#: Steps that all walkers of a block may make in one round: what a task holds.
ROUND_STEPS = 2_000_000


def _uniform(key: np.ndarray, step: np.ndarray) -> np.ndarray:
    """A number in [0, 1) of a walker and its step, the same wherever and whenever it is drawn."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + (step.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / float(1 << 53)


class BlockGraph:
    """(i, j, w) as rows of neighbours by cell, bucketed by the block the cell lies in."""

    def __init__(self, edges: DataFrame, scratch, order: DataFrame | None = None, block: int = 20_000):
        spark = edges.sparkSession
        e = edges.where("w > 0")
        cells = e.select(F.col("i").alias("cell")).union(e.select("j")).distinct()
        key = cells.withColumn("key", F.xxhash64("cell").cast("double")) if order is None else cells.join(order.toDF("cell", "key"), "cell", "left")
        place = ranked(key, [F.asc_nulls_last("key"), "cell"], scratch, "places")
        self.cells = scratch.table(place.select("cell", F.floor((F.col("rank") - 1) / block).cast("int").alias("block")), "blocks")
        of = self.cells.toDF("j", "to_block")
        rows = e.join(of, "j").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "w", "to_block"))).alias("n"))
        rows = self.cells.withColumnRenamed("cell", "i").join(rows, "i", "left").select("block", F.col("i").alias("cell"), *[F.coalesce(F.col(f"n.{c}"), F.array().cast(f"array<{k}>")).alias(c) for c, k in (("j", edges.schema["j"].dataType.simpleString()), ("w", "double"), ("to_block", "int"))])
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.name = f"trellis_graph_{uuid.uuid4().hex}"
        rows.repartition(buckets, "block").write.format("parquet").bucketBy(buckets, "block").option("path", f"{scratch.base}/graph").saveAsTable(self.name)
        self.spark, self.scratch = spark, scratch

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.scratch.drop("graph")


def _walk_block(graph: dict, walkers: dict, roots: frozenset, root_visits: int, max_steps: int, round_steps: int) -> dict:
    """Steps of the walkers of one block until they leave it, end, or the round is full.

    A row a step: which walker, its position, the cell, the cell's block, roots met; ``state`` is null but
    for a walker's last row of the round: 0 goes on, 1 has met the roots, 2 is lost.
    """
    names, degree, to, to_block = (graph[c] for c in ("cell", "degree", "to", "to_block"))
    end = np.cumsum(degree)
    cum = np.concatenate([[0.0], np.cumsum(graph["w"])])
    here = np.minimum(np.searchsorted(names, to), len(names) - 1) if len(to) else np.zeros(0, np.int64)
    local = names[here] == to if len(to) else np.zeros(0, bool)
    is_root = np.array([x in roots for x in to.tolist()], bool)
    own = np.searchsorted(names, walkers["cell"])
    pos, met, key = (walkers[c].astype(np.int64) for c in ("pos", "met", "key"))
    alive, out = np.arange(len(own)), []
    block = graph["block"]
    for _ in range(max(1, round_steps // max(len(own), 1))):
        if not len(alive):
            break
        hi = end[own[alive]]
        lo = hi - degree[own[alive]]
        stuck = (hi == lo) | (pos[alive] > max_steps)
        if stuck.any():
            s = alive[stuck]
            out.append((s, pos[s], names[own[s]], np.full(len(s), block), met[s], np.full(len(s), 2)))
            alive, lo, hi = alive[~stuck], lo[~stuck], hi[~stuck]
        u = _uniform(key[alive], pos[alive])
        pick = np.searchsorted(cum, cum[lo] + u * (cum[hi] - cum[lo]), "right") - 1
        pick = np.clip(pick, lo, hi - 1)
        pos[alive] += 1
        met[alive] += is_root[pick]
        done, stays = met[alive] >= root_visits, local[pick]
        state = np.where(done, 1, np.where(stays, -1, 0))
        out.append((alive, pos[alive], to[pick], to_block[pick], met[alive], state))
        own[alive[stays]] = here[pick[stays]]
        alive = alive[~done & stays]
    if len(alive):  # the round is full
        out.append((alive, pos[alive], names[own[alive]], np.full(len(alive), block), met[alive], np.full(len(alive), 3)))
    who, at, cell, to_b, m, state = (np.concatenate(x) for x in zip(*out, strict=True))
    return {"who": who, "pos": at, "cell": cell, "block": to_b, "met": m, "state": state}


def random_walks(edges: DataFrame, tips: DataFrame, roots: list, per_tip: int, scratch, order: DataFrame | None = None, root_visits: int = 1, max_steps: int = 5000, seed: int = 1, block: int = 20_000) -> DataFrame:
    """(tip, walk, pos, cell): walks from each tip's cells until they have met the roots; those that make
    more than ``max_steps`` steps, or come to a cell without a way on, are left out.

    ``edges``: (i, j, w), the chance to go from i to j in proportion to w; ``tips``: (tip, cell); ``order``:
    (cell, key), along which blocks of ``block`` cells are cut. A task holds one block, its walkers and
    their steps of the round. A walk's draws depend on seed, tip and number alone.
    """
    spark = edges.sparkSession
    graph = BlockGraph(edges, scratch, order, block)
    kind, tip_kind = edges.schema["i"].dataType.simpleString(), tips.schema["tip"].dataType.simpleString()
    known = tips.join(graph.cells, "cell").select("tip", "cell", "block")
    starts = known.groupBy("tip").agg(F.array_sort(F.collect_list(F.struct("cell", "block"))).alias("cells"))
    walkers = spark.range(per_tip).withColumnRenamed("id", "walk").crossJoin(F.broadcast(starts)).withColumn("key", F.xxhash64(F.lit(seed), "tip", "walk"))
    first = F.element_at("cells", (F.pmod(F.xxhash64("key"), F.size("cells")) + 1).cast("int"))
    steps = walkers.select("tip", "walk", "key", F.lit(1).alias("pos"), first["cell"].alias("cell"), first["block"].alias("block"), F.lit(0).alias("met"), F.lit(0).alias("state"))
    ends, written, n = frozenset(roots), [], 0

    def run(g: pa.Table, at: pa.Table) -> pa.Table:
        kinds = pa.schema([("tip", at.schema.field("tip").type), ("walk", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("cell", at.schema.field("cell").type), ("block", pa.int32()), ("met", pa.int32()), ("state", pa.int32())])
        if not at.num_rows or not g.num_rows:
            return kinds.empty_table()
        g = g.take(pc.sort_indices(g, [("cell", "ascending")])).combine_chunks()
        plain = lambda c: c.to_numpy(zero_copy_only=False)
        graph = {"block": g["block"][0].as_py(), "cell": g["cell"].to_numpy(), "degree": pc.list_value_length(g["j"]).to_numpy().astype(np.int64)}
        graph |= {n: plain(pa.concat_arrays([x.flatten() for x in g[c].chunks])) for n, c in (("to", "j"), ("w", "w"), ("to_block", "to_block"))}
        out = _walk_block(graph, {c: at[c].to_numpy() for c in ("cell", "pos", "met", "key")}, ends, root_visits, max_steps, ROUND_STEPS)
        who = pa.array(out.pop("who"))
        columns = {c: at[c].take(who) for c in ("tip", "walk", "key")} | out
        return pa.table([columns[f.name] if f.name in ("tip", "walk", "key") else pa.array(columns[f.name], f.type) for f in kinds], schema=kinds)

    schema = f"tip {tip_kind}, walk long, key long, pos int, cell {kind}, block int, met int, state int"
    try:
        now = scratch.table(steps, "steps0")
        while True:
            # 0 stands in another block, 3 goes on in its own: its last row is there already
            active = now.where("state in (0, 3)").select("tip", "walk", "key", "pos", "cell", "block", "met")
            if active.isEmpty():
                break
            n += 1
            moved = graph.table().groupBy("block").cogroup(active.groupBy("block")).applyInArrow(run, schema)
            now = scratch.table(moved, f"steps{n}")
        written = [f"{scratch.base}/steps{k}" for k in range(n + 1)]
    finally:
        graph.close()
    every = spark.read.schema(schema).parquet(*written)
    done = every.where("state = 1").select("tip", "walk")
    return every.where("state not in (2, 3)").join(done, ["tip", "walk"], "left_semi").select("tip", "walk", "pos", "cell")
