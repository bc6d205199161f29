"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts texts where their content says so, so texts that share passages share chunks.
A chunk is encoded once while it is remembered and its ids are copied wherever it occurs. A cut
can fall inside what the tokenizer would have kept together; each join is repaired by encoding
anew from the last place before it to the first place after it where the tokenizer splits in any
context, farther until both ends agree with token ends on either side. The ids are then those of
the whole text.

All steps work on the bytes of a batch of texts at once; what is remembered is bounded.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import slices

#: Bytes that Python takes for an entry of a memory besides its key and ids: objects, place in the dict, start.
ENTRY = 200
#: A cut falls where ten bits of the hash are zero: about 1 KB a chunk; at most this many bytes.
CUT_MASK, LONGEST = np.uint32(0x3FF << 16), 1 << 14


@lru_cache(maxsize=2)
def _gear() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(x: np.ndarray) -> np.ndarray:
    """Gear hash of the 16 bytes that end at each position, by doubling the window four times."""
    h = _gear()[x]
    for k in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k)
        h = h + shifted
    return h


def _marks(n: int, *positions: np.ndarray) -> np.ndarray:
    """Which of the positions 0 to n are among those given."""
    m = np.zeros(n + 2, bool)
    for p in positions:
        m[p] = True
    return m


def chunk_cuts(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Increasing cut positions over the bytes of texts that end at ``bounds`` (with 0 first); all
    bounds are among them, and no cut is inside a character."""
    cuts = np.flatnonzero((rolling_hash(x) & CUT_MASK) == 0) + 1
    cuts = np.flatnonzero(_marks(len(x), cuts[cuts < len(x)], bounds))
    wide = np.flatnonzero(np.diff(cuts) > LONGEST)
    if len(wide):
        cuts = np.flatnonzero(_marks(len(x), cuts, *[np.arange(cuts[i] + LONGEST, cuts[i + 1], LONGEST) for i in wide]))
    for _ in range(3):  # on to the next start of a character
        inside = (cuts < len(x)) & ((x[np.minimum(cuts, max(len(x) - 1, 0))] & 0xC0) == 0x80) if len(x) else np.zeros(len(cuts), bool)
        cuts = cuts + inside
    return np.flatnonzero(_marks(len(x), cuts))


def sure_splits(x: np.ndarray) -> np.ndarray:
    """Positions of single spaces between visible characters.

    Whatever is around, the tokenizer ends a token before such a space and the next one begins
    with it: no token runs over a space that follows a visible character, and the space joins what
    it precedes. Bytes that could belong to other white space count as not visible.
    """
    n = len(x)
    if n < 3:
        return np.zeros(0, np.int64)
    p = np.flatnonzero(x[1:-1] == 0x20) + 1
    before, after = x[p - 1], x[p + 1]
    second = x[np.minimum(p + 2, n - 1)]
    rare = lambda lead, nxt: ((lead == 0xC2) & ((nxt == 0x85) | (nxt == 0xA0))) | ((lead >= 0xE1) & (lead <= 0xE3) & ((nxt == 0x9A) | (nxt == 0x80) | (nxt == 0x81) | (nxt == 0xA0)))
    ok = (before > 0x20) & (before != 0x7F) & (after > 0x20) & (after != 0x7F) & ~rare(after, second)
    ok &= ~rare(x[np.maximum(p - 2, 0)], before) & ~rare(x[np.maximum(p - 3, 0)], x[np.maximum(p - 2, 0)])
    return p[ok]


@lru_cache(maxsize=2)
def _tables(path: str):
    """(tokenizer, byte length of each id, all token bytes end to end, where each begins)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {int(a["id"]): a["content"].encode() for a in json.loads(t.to_str())["added_tokens"]}
    raw = [b""] * t.get_vocab_size()
    for token, i in t.get_vocab().items():
        raw[i] = added[i] if i in added else bytes(of[c] for c in token)
    n = np.array([len(r) for r in raw], np.int64)
    return t, n, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(n)[:-1]])


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of begin, begin + 1, ... (n of them) end to end."""
    total = np.cumsum(n)
    return np.arange(total[-1] if len(n) else 0) - np.repeat(total - n - begin, n)


class Memory:
    """Ids of byte strings, appended to one flat array; starts anew when it takes too many bytes, all told."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def add(self, keys: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])
        self.size += self.bytes_of(keys) + 4 * len(ids)

    @staticmethod
    def bytes_of(keys: list[bytes]) -> int:
        return sum(map(len, keys)) + ENTRY * len(keys)

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.starts[at + 1] - self.starts[at]
        return self.flat[_spread(self.starts[at], n)], n


class ChunkCodec:
    def __init__(self, path: str, chunk_bytes: int = 48 << 20, unit_bytes: int = 64 << 20):
        self.t, self.length, self.raw, self.raw_at = _tables(path)
        self.chunks, self.units = Memory(chunk_bytes), Memory(unit_bytes)

    def _native(self, texts: list[str], step: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """A few texts at a time: the library's encodings take many times the bytes of their ids."""
        ids, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for s in range(0, len(texts), step):
            got = [e.ids for e in self.t.encode_batch_fast(texts[s : s + step], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
            n.append(np.fromiter(map(len, got), np.int64, len(got)))
        return np.concatenate(ids), np.concatenate(n)

    def _encode_units(self, keys: list[bytes], step: int = 256) -> None:
        """Units that begin with their space and end visibly can stand side by side, and so many
        are encoded in one call; their ids are told apart by byte lengths."""
        texts = [k.decode() for k in keys]
        free = [s[:1] == " " and len(s) > 1 and not s[1].isspace() and not s[-1].isspace() for s in texts]
        side, alone = [i for i, f in enumerate(free) if f], [i for i, f in enumerate(free) if not f]
        if side:
            ids, _ = self._native(["".join(texts[i] for i in side[s : s + step]) for s in range(0, len(side), step)])
            ends = np.cumsum([len(keys[i]) for i in side])
            at = np.cumsum(self.length[ids])
            k = np.searchsorted(at, ends)
            if (at[k] == ends).all():
                self.units.add([keys[i] for i in side], ids, np.diff(k + 1, prepend=0))
            else:
                alone = range(len(keys))
        if alone:
            self.units.add([keys[i] for i in alone], *self._native([texts[i] for i in alone]))

    def _lookup(self, memory: Memory, pieces: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each piece), through the memory; unknown pieces are encoded first."""
        coded = pieces.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        fresh = [k for k in keys if k not in memory.known]
        if fresh and memory.size + memory.bytes_of(fresh) > memory.most:
            memory.clear()
            fresh = keys
        if fresh:
            encode(fresh)
        place = np.fromiter(map(memory.known.__getitem__, keys), np.int64, len(keys))
        return memory.get(place[coded.indices.to_numpy(zero_copy_only=False)])

    @staticmethod
    def _pieces(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(x)])

    def _encode_chunks(self, keys: list[bytes]) -> None:
        x = np.frombuffer(b"".join(keys), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        # a space beside a chunk's edge is no sure split: what is over the edge is another chunk
        sure, edge = sure_splits(x), _marks(len(x), bounds)
        cuts = np.flatnonzero(_marks(len(x), sure[~(edge[sure - 1] | edge[sure] | edge[sure + 1])], bounds))
        ids, n = self._lookup(self.units, self._pieces(x, cuts), self._encode_units)
        total = np.concatenate([[0], np.cumsum(n)])
        self.chunks.add(keys, ids, np.diff(total[np.searchsorted(cuts, bounds)]))

    def encode(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids before each bound."""
        if not len(x):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        edge = _marks(len(x), bounds)
        edges = np.flatnonzero(edge)
        cuts = chunk_cuts(x, edges)
        ids, _ = self._lookup(self.chunks, self._pieces(x, cuts), self._encode_chunks)
        sure = sure_splits(x)
        split = _marks(len(x), sure[~(edge[sure] | edge[sure + 1])], edges)
        sure = np.flatnonzero(split)
        joins = cuts[~split[cuts]]
        back, on = 1, 0
        while len(joins):
            k = np.searchsorted(sure, joins)
            left, right = sure[np.maximum(k - back, 0)], sure[np.minimum(k + on, len(sure) - 1)]
            # never over the edge of a text
            e = np.searchsorted(edges, joins)
            left, right = np.maximum(left, edges[e - 1]), np.minimum(right, edges[e])
            spans = np.stack([left, right], 1)
            spans = spans[np.lexsort((right, left))]
            spans = spans[np.concatenate([[True], (spans[1:] != spans[:-1]).any(axis=1)])]
            if (spans[1:, 0] < spans[:-1, 1]).any():  # wider spans overlap: one of them all
                top = np.maximum.accumulate(spans[:, 1])
                first = np.concatenate([[True], spans[1:, 0] >= top[:-1]])
                spans = np.stack([spans[first, 0], np.maximum.reduceat(spans[:, 1], np.flatnonzero(first))], 1)
            stop = np.cumsum(self.length[ids])
            ends = _marks(len(x), stop)
            ends[0] = True
            agree = ends[spans[:, 0]] & ends[spans[:, 1]]
            if not agree.all():  # widen until both ends agree with ends of tokens
                back, on = back + 1, on + 1
                continue
            begin = stop - self.length[ids]
            of = np.searchsorted(spans[:, 0], begin, "right") - 1
            keep = (of < 0) | (begin >= spans[np.maximum(of, 0), 1])
            flat = np.ravel(spans)
            between = self._pieces(x, np.concatenate([flat, flat[-1:]])).take(pa.array(np.arange(0, len(flat), 2)))
            new, n = self._lookup(self.units, between, self._encode_units)
            own = self.length[new]
            at = np.cumsum(own) - own
            firsts = np.cumsum(n) - n
            at += np.repeat(spans[:, 0] - at[firsts], n)
            order = np.argsort(np.concatenate([begin[keep], at]), kind="stable")
            ids = np.concatenate([ids[keep], new])[order]
            break
        return ids, np.searchsorted(np.concatenate([[0], np.cumsum(self.length[ids])]), bounds)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.raw[_spread(self.raw_at[ids], self.length[ids])].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> ChunkCodec:
    """One for all tasks of a Python worker."""
    return ChunkCodec(path)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of every row.

    Null texts count as empty: no tokens, and the digests of nothing. Repeated rows get the same
    digests; an empty table gives an empty result; other columns of the input are ignored. No
    shuffle: a text's chunks are remembered by the worker that reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for whole in batches:
            for b in slices(whole, 2 << 20):
                t = b.column(1).cast(pa.string())  # 32-bit offsets; a slice is far from 2 GB
                bounds = np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + len(t) + 1].astype(np.int64)
                x = np.frombuffer(t.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
                bounds = bounds - bounds[0]
                ids, at = c.encode(x, bounds)
                sha = lambda d: hashlib.sha256(d).hexdigest()
                parts = [ids[at[i] : at[i + 1]] for i in range(len(t))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.diff(at)), pa.array([sha(p.astype("<u4").tobytes()) for p in parts], pa.string()), pa.array([sha(c.decode(p)) for p in parts], pa.string())],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, schema)
