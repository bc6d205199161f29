"""SimHash near-duplicates by pigeonhole blocks.

The 64 bits are split into blocks; two fingerprints that differ in few bits agree on all but
that few blocks, so they meet in a join on the agreeing ones, and the Hamming distance decides.
Exact copies of a fingerprint are folded before the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import Scratch, slices
from trellis.llm.components import connected_components

#: Fixed value: the seed of the shingle hash.
SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bits set in more than half of the shingle hashes; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    h64 = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()  # shingles are slices of the joined words
    stops = ends[min(width, len(words)) - 1 :].tolist()
    for at in range(0, n, 65536):  # bounded memory on very long texts
        part = slice(at, at + 65536)
        hashes = np.array([h64(joined[s:e], SEED) for s, e in zip(starts[part], stops[part], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole)):
        fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit number."""
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(_fingerprints, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask for each choice of blocks that agree when at most ``distance`` bits differ; signed."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    bits = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(bits[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_pairs(fps: DataFrame, scratch: Scratch, distance: int = 3, blocks: int = 6, hot: int = 256) -> DataFrame:
    """Links (a, b) that connect exactly what all pairs within ``distance`` bits connect.

    ``fps`` holds distinct values ``fp``. A bucket of at most ``hot`` fingerprints is joined with
    itself, so a row meets a bounded number of others. The fingerprints of larger buckets are
    linked through hubs instead: all values within one bit of a fingerprint are its near hubs,
    those within ``distance`` - 1 its far hubs; whoever has v as far hub is within ``distance`` of
    whoever has v as near hub, and two of the latter are within two bits, so a link from each to
    the smallest of the latter is a true link and loses no connection. That costs a fixed number
    of rows for a fingerprint, whatever the bucket holds.
    """
    if distance != 3:
        hot = 1 << 62
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(block_masks(blocks, distance))]))
    rows = fps.select("fp", keys.alias("b")).select("b.c", "b.k", "fp")
    sizes = rows.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.table(rows.join(sizes, ["c", "k"]), "shared")
    cold = shared.where(F.col("n") <= hot).select("c", "k", "fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = cold.withColumnRenamed("fp", "a").join(cold.withColumnRenamed("fp", "b"), ["c", "k"]).where("a < b").where(near).select("a", "b").distinct()
    members = shared.where(F.col("n") > hot).select("fp").distinct()
    if members.isEmpty():
        return pairs
    one = [0] + [1 << i for i in range(64)]
    two = one + [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    hubs = lambda flips: members.select("fp", F.explode(F.transform(F.array(*[F.lit(_signed(x)) for x in flips]), lambda x: F.col("fp").bitwiseXOR(x))).alias("v"))
    centre = hubs(one).groupBy("v").agg(F.min("fp").alias("a"))
    return pairs.union(hubs(two).join(centre, "v").select("a", F.col("fp").alias("b")).where("a <> b").distinct())


def near_duplicates(docs: DataFrame, scratch: Scratch, distance: int = 3, blocks: int = 6, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, fp, component_id) for every row: the smallest id reachable by links of fingerprints.

    Null and blank texts share fingerprint zero and are linked like any other. Equal texts are
    always together. Ids can be of any orderable type. A task holds about 8 MB of texts at once, or
    one text. An empty table gives an empty result; other columns of the input are ignored.
    """
    fp = scratch.table(fingerprints(docs, id_col, text), "fp")
    groups = scratch.table(fp.groupBy("fp").agg(F.min("id").alias("first")), "groups")
    parts = connected_components(near_pairs(groups.select("fp"), scratch, distance, blocks), scratch)
    # the smallest id of a component, not of its smallest fingerprint
    named = groups.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    lowest = named.groupBy("part").agg(F.min("first").alias("component_id"))
    ids = named.join(lowest, "part").select("fp", "component_id")
    return fp.join(ids, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
