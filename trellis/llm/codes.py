"""Vectors as short codes: each part of a vector is the index of its nearest codebook entry.

Lloyd's rounds with resident members: parts lie in a table bucketed by (position, entry, salt), so
the owner of an entry adds up the members that are already there, without a shuffle. After a
round a part that keeps its entry is written back into its own bucket by the task that read it; only
parts that change entry go through the next shuffle. Salts follow the number of vectors, so an
entry that holds most of them has many owners.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import Scratch, join_spread

#: Components are kept within this, so that squared distances fit 64 bits; at a scale of 4096 that is 16,384.
LIMIT = 1 << 26
OWNED = 10_000  # members of an owner, about, while salts are few enough
MOST_SALTS = 4096
BUCKET_ROWS = 1_000_000


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row, ties to the lower index, in exact integers."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for k, e in enumerate(entries):
        d = ((x - e) ** 2).sum(axis=1)
        closer = d < best
        best[closer], at[closer] = d[closer], k
    return at, best


def cut(width: int, parts: int) -> list[tuple[int, int]]:
    """Where each part begins and ends; equal parts where ``parts`` divides the width."""
    return [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]


def quantized(rows: DataFrame, scratch: Scratch, scale: int, id_col: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """(row, id, label, q) of the sound vectors of the commonest length, and that length."""
    v = F.col(vector)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    to_int = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int")
    kept = rows.where(sound).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label).alias("label"), F.transform(v, to_int).alias("q"))
    kept = scratch.table(kept, "kept")
    width = kept.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (kept, 0) if width is None else (kept.where(F.size("q") == width["d"]), width["d"])


class Residents:
    """Parts by owner: generations of a table bucketed by (pos, entry, salt) in the shared folder."""

    def __init__(self, scratch: Scratch, salts: int, buckets: int):
        self.scratch, self.salts, self.buckets, self.number, self.name = scratch, salts, buckets, 0, None

    def _write(self, df: DataFrame, name: str, place: str) -> None:
        df.write.format("parquet").bucketBy(self.buckets, "pos", "entry", "salt").option("path", f"{self.scratch.base}/{place}").mode("append").saveAsTable(name)

    def next(self, stay: DataFrame | None, move: DataFrame) -> None:
        """A new generation: who stays is written where it is read, who moves is shuffled to its owner."""
        place, name = f"owned{self.number}", f"trellis_owned_{uuid.uuid4().hex}"
        columns = ["row", "pos", "x", "entry", "salt"]
        self._write(move.select(*columns).repartition(self.buckets, "pos", "entry", "salt"), name, place)
        if stay is not None:
            self._write(stay.select(*columns), name, place)
        self.close()
        self.number, self.name = self.number + 1, name

    def table(self) -> DataFrame:
        return self.scratch.spark.table(self.name)

    def sums(self, width: int) -> DataFrame:
        """(pos, entry, n, s) of the members: first by owner, where they lie, then over the salts."""
        each = [F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width)]
        owned = self.table().groupBy("pos", "entry", "salt").agg(F.count("*").alias("n"), *each)
        return owned.groupBy("pos", "entry").agg(F.sum("n").alias("n"), F.array(*[F.coalesce(F.sum(f"s{i}"), F.lit(0)) for i in range(width)]).alias("s"))

    def close(self) -> None:
        if self.name:
            self.scratch.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.scratch.drop(f"owned{self.number - 1}")
            self.name = None


def _assigned(parts: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The parts with the entry that is nearest by ``books``, and whether it is another one than before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, old = b.column(1).to_numpy(), b.column(3).to_numpy()
            new = np.zeros(len(pos), np.int64)
            for p in np.unique(pos):
                at = np.flatnonzero(pos == p)
                new[at] = nearest(_matrix(b.column(2).take(pa.array(at)), books[p].shape[1]), books[p])[0]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(new, pa.int32()), b.column(4), pa.array(new != old)], names=["row", "pos", "x", "entry", "salt", "moved"])

    return parts.select("row", "pos", "x", "entry", "salt").mapInArrow(run, "row long, pos int, x array<int>, entry int, salt int, moved boolean")


def train(kept: DataFrame, width: int, scratch: Scratch, parts: int = 8, entries: int = 16, rounds: int = 6) -> list[np.ndarray]:
    """A codebook for each part: (entries, width of the part) integers, from (row, id, q).

    Each starts as that part of the vectors of smallest id, ties by a hash of the vector; nulls come
    last. An entry becomes the floored mean of the parts nearest to it, and stays if there is none. Only
    codebooks, whose size is fixed by the parameters, come to the driver.
    """
    edges = cut(width, parts)
    first = [r.q for r in kept.orderBy(F.asc_nulls_last("id"), F.xxhash64("q"), "row").limit(entries).collect()]
    first = np.array(first, np.int64).reshape(len(first), width)
    books = [first[:, a:b].copy() for a, b in edges]
    n = kept.count()
    salts = min(MOST_SALTS, max(1, math.ceil(n / OWNED)))
    shuffles = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    owned = Residents(scratch, salts, min(50_000, max(shuffles, math.ceil(n * parts / BUCKET_ROWS))))
    pieces = F.posexplode(F.array(*[F.slice("q", a + 1, b - a) for a, b in edges])).alias("pos", "x")
    now = kept.select("row", pieces).select("row", "pos", "x", F.lit(-1).alias("entry"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"))
    for k in range(rounds):
        assigned = _assigned(now, books)
        if k:
            owned.next(assigned.where("not moved"), assigned.where("moved"))
        else:
            owned.next(None, assigned)
        for r in owned.sums(max(b - a for a, b in edges)).collect():
            a, b = edges[r.pos]
            books[r.pos][r.entry] = [s // r.n for s in r.s[: b - a]]
        now = owned.table()
    owned.close()
    return books


def encode(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error): indexes of the nearest entries as two hex digits each, and the squared
    distances added up, from (id, label, q); no shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    width = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at, error, code = _matrix(b.column(2), width), 0, np.zeros(b.num_rows, np.int64), []
            for book in books:
                k, d = nearest(x[:, at : at + book.shape[1]], book)
                code.append(k.astype(np.uint8))
                error += d
                at += book.shape[1]
            digits = np.stack(code, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in digits], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return kept.select("id", "label", "q").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compressed(rows: DataFrame, scratch: Scratch, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256), one row a sound vector.

    Vectors that are null or hold null or non-finite components are left out, and so are those of
    another length than the commonest (of equally common ones the longest). Components become
    floor(scale * x), kept within 2^26. Rows that repeat an id are vectors of their own. Where
    ``parts`` does not divide the length, parts differ by one component; parts of no component are at
    distance zero. ``label_error`` adds up the errors of equal labels, nulls together. An empty table
    gives an empty result; other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits a part: entries must be 1 to 256")
    kept, width = quantized(rows, scratch, scale, id_col, vector, label)
    if kept.isEmpty():
        books = [np.zeros((1, b - a), np.int64) for a, b in cut(width, parts)]
    else:
        books = train(kept, width, scratch, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    coded = scratch.table(encode(kept, books).withColumn("label", F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"))), "coded")
    coded = coded.select("id", "code", "error", F.col("label.none").alias("none"), F.col("label.name").alias("name"))
    total = coded.groupBy("none", "name").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = join_spread(coded, total, ["none", "name"], "n")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
