"""Variants of a word's spelling by rotations of terminator-marked words.

A word a x b, marked by a terminator, has the rotation x b $ a; without its first character it is
b $ a, the prefix under which every word a y b and the word a b itself stand among the sorted
rotations. So each word gives its rotations, and its rotations with one character skipped; sorted,
equal ones stand together: all words of such a group differ by one character at the same place. A
group has at most one word for each letter and one without it, whatever the corpus, and is
scanned once: each member hears how many others there are and which of them is the commonest, so no
pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import Scratch, lower_ascii, slices

#: Fixed value: the letters words are made of.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Prime moduli below 2^31 with a base each: a rotation is known by four remainders of a polynomial, 124 bits.
_FIELDS = ((2147483647, 1_103_515_245), (2147483629, 69_069_133), (2147483587, 1_664_525_077), (2147483579, 214_013_911))


@lru_cache(maxsize=1)
def _tables(log_size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, up to 2^log_size of them, by doubling."""
    out = []
    for m, base in _FIELDS:
        pair = []
        for b in (base, pow(base, -1, m)):
            p = np.ones(1, np.uint64)
            for k in range(log_size):
                p = np.concatenate([p, p * np.uint64(pow(b, 1 << k, m)) % np.uint64(m)])
            pair.append(p)
        out.append(tuple(pair))
    return out


def rotations(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first half of the key, second half, word, kind) of all rotations, in time linear in the letters.

    kind is 0 for whole rotations, 1 and 2 for those without a character: 1 unless the character is
    the same as the one before it, as taking out either leaves the same word.
    """
    n = np.array([len(w) for w in words], np.int64)
    x = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(2)  # the terminator is 1
    word = np.repeat(np.arange(len(words)), n)
    begin = np.cumsum(n) - n
    place = np.arange(len(x)) - begin[word]
    # prefix sums have one entry more a word
    at = np.arange(len(x)) + word
    of_all = np.repeat(np.arange(len(words)), n + 1)
    first = begin + np.arange(len(words))
    i = np.arange(len(of_all)) - first[of_all]
    length = n[of_all]
    low = np.ones(len(x), bool)
    low[1:] = x[1:] != x[:-1]
    low[begin[n > 0]] = True
    powers = _tables(max(4, int(n.max(initial=0) + 2).bit_length()))
    whole, skip = [], []
    for (m, _), (up, down) in zip(_FIELDS, powers, strict=True):
        m = np.uint64(m)
        term = np.zeros(len(of_all), np.uint64)
        term[at + 1] = x * up[place] % m
        total = np.cumsum(term)
        prefix = (total - total[first][of_all]) % m
        end = prefix[first + n][of_all]
        whole.append(((end + m - prefix) * down[i] % m + up[length - i] + up[length - i + 1] * prefix % m) % m)
        rest, before = (end[at] + m - prefix[at + 1]) % m, prefix[at]
        left = n[word] - place
        skip.append((rest * down[place + 1] % m + up[left - 1] + up[left] * before % m) % m)
    both = [np.concatenate(h) for h in zip(whole, skip, strict=True)]
    keys = [(both[k] | both[k + 1] << np.uint64(31)).astype(np.int64) for k in (0, 2)]
    kind = np.concatenate([np.zeros(len(of_all), np.int64), np.where(low, 1, 2)])
    return keys[0], keys[1], np.concatenate([of_all, word]), kind


def scan(k1: np.ndarray, k2: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, near words met first here, the commonest other) of groups of sorted rotations; marks are
    4 * word + kind, and words are numbered from the commonest."""
    start = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
    size = np.diff(np.append(start, len(mark)))
    kept = np.repeat(size > 1, size)
    start = start[size > 1]
    word, kind = mark >> 2, mark & 3
    if not len(start):
        return word[:0], word[:0], word[:0]
    best, second = word[start], word[start + 1]
    size = size[size > 1]
    word, kind = word[kept], kind[kept]
    g = np.repeat(np.arange(len(size)), size)
    at = np.cumsum(size) - size
    skips, whole, once = (np.add.reduceat(x.astype(np.int64), at) for x in (kind > 0, kind == 0, kind == 1))
    near = np.where(kind == 0, once[g], skips[g] - 1 + (kind == 1) * whole[g])
    other = best[g]
    other[at] = second
    return word, near, other


def spellings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", thinned: int = 97) -> DataFrame:
    """(word), one row a run of letters: A-Z lowered, and where ``thinned`` divides the crc32 of
    ``<id>:<run>``, without the code point at the crc32 modulo the run's length."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(LETTERS), 0)).alias("w"))
    runs = runs.select("d", F.when(F.octet_length("w") == F.char_length("w"), F.lower("w")).otherwise(lower_ascii(F.col("w"))).alias("w"))
    runs = runs.select("w", F.crc32(F.concat("d", F.lit(":"), "w")).alias("h"))
    at = F.pmod("h", F.char_length("w")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.char_length("w")))
    return runs.select(F.when(F.col("h") % thinned == 0, cut).otherwise(F.col("w")).alias("word"))


def variants(words: DataFrame, scratch: Scratch, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n).

    Two words are near if they differ by one character inserted, deleted or replaced. A word's form is
    its near word of largest n, ties to the smallest in code-point order, if that n is at least
    ``factor`` times its own; its root is where forms lead. Words of any length are compared, in time
    and rows linear in it, by 124-bit hashes of their rotations. Words that are null are left out; the
    empty word is near all words of one character. An empty table gives an empty result.
    """
    counted = scratch.table(words.where("word is not null").select("word", "n"), "counted")
    # numbered from the commonest: the smaller of two numbers is the better form
    numbered = counted.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("r"), "word", "n")
    numbered = scratch.table(numbered, "numbered")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1 << 20):
                k1, k2, word, kind = rotations(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(b.column(0).to_numpy()[word] * 4 + kind)], names=["k1", "k2", "mark"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            now = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns, strict=True)]
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            last = len(last) if last.all() else len(last) - int(np.argmin(last[::-1]))
            held = [x[last:] for x in now] if last < len(now[0]) else now
            if last < len(now[0]):
                yield found(*(x[:last] for x in now))
        if len(held[0]):
            yield found(*held)

    def found(*x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in scan(*x)], names=["r", "near", "best"])

    turned = numbered.select("r", "word").mapInArrow(turn, "k1 long, k2 long, mark long")
    ordered = turned.repartition("k1").sortWithinPartitions("k1", "k2", "mark")
    stats = ordered.mapInArrow(scanned, "r long, near long, best long").groupBy("r").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    other = numbered.toDF("best", "form", "form_n")
    formed = numbered.join(stats, "r", "left").join(other, "best", "left")
    good = F.col("form_n") >= factor * F.col("n")
    formed = formed.select("r", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(good, F.col(c)).alias(c) for c in ("best", "form", "form_n")])
    formed = scratch.table(formed, "formed")
    roots = _roots(formed.where("best is not null").select("r", F.col("best").alias("to")), scratch)
    named = numbered.select(F.col("r").alias("to"), F.col("word").alias("root"))
    out = formed.join(roots, "r", "left").join(named, "to", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(r, to) with ``to`` followed to its end: each round doubles the steps taken. A form is at least
    ``factor`` times as common as its word, so chains are short and have no cycle."""
    now, step = scratch.table(links, "links0"), 0
    while True:
        more = now.select(F.col("r").alias("to"), F.col("to").alias("further"))
        step += 1
        after = scratch.table(now.join(more, "to", "left").select("r", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), f"links{step}")
        scratch.drop(f"links{step - 1}")
        now = after.select("r", "to")
        if after.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, scratch: Scratch, least_chars: int = 5, least: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the words of whole texts that have at least ``least_chars`` code points and occur at
    least ``least`` times. Null and empty texts have no words, null ids count as empty; rows that
    repeat count again. Other columns are ignored."""
    words = spellings(docs, id_col, text).where(F.char_length("word") >= least_chars)
    return variants(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least), scratch)
