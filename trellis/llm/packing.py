"""Order-preserving packing into windows of at most ``size`` tokens by dynamic programming.

Texts are encoded in the order of the input partition and cut where documents or sentences end.
The cut positions minimise padding plus penalties for cut documents; since the cost of a window is
its unused room, the best predecessor is a sliding-window minimum, kept in a monotone queue, so
each position costs amortised constant time. A partition is packed block by block in bounded
memory; no shuffle is needed.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import slices

#: Characters that end a sentence.
SENTENCE_ENDS = ".!?…。！？"
#: Bytes that Python takes for a remembered word besides its characters and ids: objects, place in the dict, start.
ENTRY = 200


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def _bare(path: str):
    """The same model behind a plain split at white space, and which ids carry the word-end mark."""
    from tokenizers import Tokenizer

    plan = json.loads(_tokenizer(path).to_str()) | {"normalizer": None, "added_tokens": []}
    plan["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    t = _tokenizer(path)
    ends = np.zeros(t.get_vocab_size(), bool)
    ends[[i for w, i in t.get_vocab().items() if w.endswith("</w>")]] = True
    return Tokenizer.from_str(json.dumps(plan)), ends


def _closed(w: str) -> bool:
    """Ends in a full stop or comma behind a letter or digit that stays one when normalised."""
    if w[-1:] not in {",", "."}:
        return False
    c = w[-2:-1]
    return c.isalnum() and (c.isascii() or (c.lower().isalnum() and is_normalized("NFC", c)))


class WordEncoder:
    """Ids of whole texts from ids of their words.

    Holds for tokenizers that drop white space and never join over it, as the word-end kind does:
    each distinct word is encoded once and its ids are copied. The memory of words takes at most
    ``most`` bytes, all told, or those of one slice; when it is full it starts anew. The tokenizer ignores case, so A-Z is lowered before words are told
    apart, except where a special token, which minds case, could be meant.
    """

    def __init__(self, path: str, most: int = 128 << 20):
        self.t, self.most = _tokenizer(path), most
        self.bare, self.word_end = _bare(path)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.size = 0

    @staticmethod
    def _bytes_of(words: list[str]) -> int:
        return sum(map(len, words)) + ENTRY * len(words)

    def _native(self, t, texts: list[str], step: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many of each text). ``step`` texts at a time: the library's encodings take many
        times the bytes of their ids."""
        ids, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for s in range(0, len(texts), step):
            got = [e.ids for e in t.encode_batch_fast(texts[s : s + step], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
            n.append(np.fromiter(map(len, got), np.int64, len(got)))
        return np.concatenate(ids), np.concatenate(n)

    def _append(self, words: list[str], flat: np.ndarray, n: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])
        self.size += self._bytes_of(words) + flat.nbytes

    def _learn(self, words: list[str]) -> None:
        """Encode unknown words. A word that is letters or digits before one closing full stop or
        comma is that word and that mark, for marks are tokens apart from letters and digits."""
        known = self.known
        fresh = [w for w in words if w not in known]
        if fresh and self.size + 2 * self._bytes_of(fresh) > self.most:
            self._reset()
            fresh, known = words, self.known
        if not fresh:
            return
        marked, rest = [], []
        for w in fresh:
            (marked if _closed(w) else rest).append(w)
        plain = list(dict.fromkeys(w for w in (*rest, *(w[:-1] for w in marked), ",", ".") if w not in known))
        letters = [w for w in plain if w.isalpha() and w.lower() == w and is_normalized("NFC", w)]
        if self._append_letters(letters):
            plain = [w for w in plain if w not in known]
        self._append(plain, *self._native(self.t, plain, 1024))
        if marked:
            core = np.fromiter((known[w[:-1]] for w in marked), np.int64, len(marked))
            mark = np.fromiter((self.flat[self.starts[known[w[-1]]]] for w in marked), np.uint32, len(marked))
            ids, n = self._copy(core)
            ends = np.cumsum(n)
            self._append(marked, np.insert(ids, ends, mark), n + 1)

    def _append_letters(self, words: list[str], step: int = 256) -> bool:
        """Encode words of lower-case letters many at a time. Normalisation leaves them as they
        are and each is one pre-token, so each gives one token with the word-end mark."""
        flat, _ = self._native(self.bare, [" ".join(words[i : i + step]) for i in range(0, len(words), step)], 8)
        stops = np.flatnonzero(self.word_end[flat]) + 1
        if len(stops) != len(words):
            return False
        self._append(words, flat, np.diff(stops, prepend=0))
        return True

    def _copy(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        total = np.cumsum(n)
        return self.flat[np.arange(total[-1] if len(n) else 0) - np.repeat(total - n - begin, n)], n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts)."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else a special token could come to be
            texts = pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(texts)
        lists = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        coded = lists.flatten().dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        self._learn(vocabulary)
        place = np.fromiter(map(self.known.__getitem__, vocabulary), np.int64, len(vocabulary))
        at = place[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        ids, n = self._copy(at)
        total = np.concatenate([[0], np.cumsum(n)])
        per_text = lists.value_lengths().fill_null(0).to_numpy()
        return ids, total[np.concatenate([[0], np.cumsum(per_text)])]


@lru_cache(maxsize=2)
def _encoder(path: str, most: int) -> WordEncoder:
    """One for all tasks of a Python worker."""
    return WordEncoder(path, most)


@lru_cache(maxsize=4)
def _sentence_end_ids(path: str) -> np.ndarray:
    t = _tokenizer(path)
    out = np.zeros(t.get_vocab_size(), bool)
    for token, i in t.get_vocab().items():
        out[i] = token.removesuffix("</w>")[-1:] in (*SENTENCE_ENDS, ".") and token.endswith("</w>")
    return out


def cut(positions: list[int], penalties: list[float], size: int) -> list[int]:
    """Windows' ends among increasing ``positions`` (from 0, excluded), at most ``size`` apart.

    Cost of a window: size - length, nothing when its length is a power of two; plus the penalty of
    its end. The last position ends the last window.
    """
    pos = [0, *positions]
    pen = [0.0, *penalties]
    best = [0.0] * len(pos)
    back = [0] * len(pos)
    where = {p: i for i, p in enumerate(pos)}
    q: deque[int] = deque([0])  # indices by increasing best + position
    powers = [1 << b for b in range(size.bit_length() - 1)]
    for i in range(1, len(pos)):
        p = pos[i]
        while q and p - pos[q[0]] > size:
            q.popleft()
        j = q[0]
        cost = best[j] + size - (p - pos[j])
        for length in powers:
            k = where.get(p - length)
            if k is not None and best[k] < cost:
                j, cost = k, best[k]
        best[i], back[i] = cost + pen[i], j
        value = best[i] + p
        while q and best[q[-1]] + pos[q[-1]] >= value:
            q.pop()
        q.append(i)
    ends, i = [], len(pos) - 1
    while i:
        ends.append(pos[i])
        i = back[i]
    return ends[::-1]


@lru_cache(maxsize=2)
def rests(size: int, most: int = 3) -> np.ndarray:
    """Sums of at most ``most`` different powers of two below ``size``: what is left of a stream can
    be cut there into windows without padding."""
    bits = [1 << b for b in range(size.bit_length() - 1)]
    return np.unique([sum(c) for k in range(1, most + 1) for c in combinations(bits, k)])


class Packer:
    """Rolling packing of a stream of documents: a block is cut by dynamic programming; its last
    window, the only one whose end it doesn't know, stays open for the next block."""

    def __init__(self, size: int, sentence_end: np.ndarray, end_id: int, sentence_penalty: float, hard_penalty: float, block: int):
        self.size, self.sentence_end, self.end_id = size, sentence_end, end_id
        self.sentence_penalty, self.hard_penalty, self.block = sentence_penalty, hard_penalty, block
        self.parts: list[tuple[object, int, int, np.ndarray]] = []  # doc, start, doc tokens, ids
        self.held, self.sequence = 0, 0

    def add(self, doc: object, ids: np.ndarray, start: int, whole: int) -> Iterator[tuple]:
        self.parts.append((doc, start, whole, ids))
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.concatenate([p[3] for p in self.parts])
        lengths = np.cumsum([len(p[3]) for p in self.parts])
        ends_doc = np.array([p[1] + len(p[3]) == p[2] for p in self.parts])
        penalty = np.full(len(ids) + 1, np.inf)
        penalty[np.flatnonzero(self.sentence_end[ids]) + 1] = self.sentence_penalty
        penalty[lengths[ends_doc]] = 0.0
        penalty[-1] = min(penalty[-1], self.hard_penalty)
        soft = np.flatnonzero(np.isfinite(penalty))
        gaps = np.diff(np.concatenate([[0], soft]))
        wide = np.flatnonzero(gaps > self.size // 16)  # long stretches without a sentence end can be cut anywhere in steps
        extra = [np.arange(soft[g] - gaps[g], soft[g], 32)[1:] for g in wide]
        if last:  # so near its end a stream can be cut anywhere that leaves windows without padding
            extra.append(len(ids) - rests(self.size))
        at = np.unique(np.concatenate([soft, *extra])).astype(np.int64)
        at = at[at > 0]
        pen = np.where(np.isfinite(penalty[at]), penalty[at], self.hard_penalty)
        ends = cut(at.tolist(), pen.tolist(), self.size)
        if not last:
            if len(ends) < 2:
                return
            ends.pop()
        yield from self._emit(ends, ids, lengths)

    def _emit(self, ends: list[int], ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple]:
        k, at = 0, 0
        keep: list[tuple[object, int, int, np.ndarray]] = []
        starts = np.concatenate([[0], lengths[:-1]])
        for end in ends:
            begin = at
            while at < end:
                doc, first, whole, _ = self.parts[k]
                stop = min(end, int(lengths[k]))
                piece = ids[at:stop]
                yield doc, first + at - int(starts[k]), stop - at, zlib.crc32(piece.astype("<u4").tobytes()), whole, self.sequence, at - begin
                at = stop
                if at == lengths[k]:
                    k += 1
            self.sequence += 1
        for i in range(k, len(self.parts)):
            doc, first, whole, own = self.parts[i]
            done = max(0, at - int(starts[i]))
            keep.append((doc, first + done, whole, own[done:]))
        self.parts, self.held = keep, len(ids) - at


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text: str = "text", sentence_penalty: float = 16.0, hard_penalty: float = 256.0, block: int = 1 << 19, memory: int = 256 << 20) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and blank texts are the end token alone. Documents keep the order of their input
    partition; repeated rows are packed once each; an empty table gives no pieces; other columns
    are ignored. The end of a partition is cut by the same programme, with more places to choose from:
    those that leave powers of two, which need no padding, each at the penalty of its cut. A very long text enters in slices of
    ``block`` ids. A worker remembers words within ``memory`` bytes and encodes slices of texts of a
    thirty-second of that; less takes more time and gives the same rows. Sequence ids hold the partition in their upper half, so a task that runs
    again gives the same rows.
    """
    fields = pa.schema([("doc", pa.from_numpy_dtype(np.int64))] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, memory)
        packer = Packer(size, _sentence_end_ids(tokenizer), end_id, sentence_penalty, hard_penalty, block)
        base = TaskContext.get().partitionId() << 32

        def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            cols[5] = [base + x for x in cols[5]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[id_col, *fields.names[1:]])

        kind = pa.int64()
        for b in batches:
            kind = b.column(0).type
            for part in slices(b, memory // 32):
                ids, offsets = encoder.encode(part.column(1))
                rows: list[tuple] = []
                for i, doc in enumerate(part.column(0).to_pylist()):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id))
                    for s in range(0, len(own), block):  # a very long text enters in slices
                        rows += packer.add(doc, own[s : s + block], s, len(own))
                if rows:
                    yield out(rows, kind)
        rows = list(packer.flush(True))
        if rows:
            yield out(rows, kind)

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, schema)
