"""Conversations as training text with a loss mask on tokens.

Each conversation is rendered whole, encoded once with offsets, and a token is learnt from where its
offsets meet a turn of the assistant: both are sorted, so a binary search finds the turn. The marks
of turns are tokens of their own, which no text can imitate or merge with; so where rows of one
conversation lie in several range partitions, or are very many, their parts are encoded one by one
and say, put together, exactly what the whole would.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import slices

#: What stands before and after the text of a turn, by role.
ROLES = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("", "</s>")}
#: Around the name and the text of any other role.
OTHER = ("[ROLE]", "[TEXT]", "[/TEXT]")
MARKS = tuple(m for pair in (*ROLES.values(), OTHER) for m in pair if m)

_MARK = re.compile("|".join(map(re.escape, MARKS)))
_TAILS = "|".join(sorted({re.escape(m[1:]) for m in MARKS}))
_ESCAPE = re.compile(rf"([\[<])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([\[<])\\(\\*)(?={_TAILS})")


def escape(text: str) -> str:
    """One backslash more inside all that looks like a mark, so that no mark is left in a text."""
    return _ESCAPE.sub(r"\1\\\2", text) if "[" in text or "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text of a turn, the text escaped, and what stands after it."""
    before, after = ROLES.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
    return before, escape(text), after


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, read back from formatted text."""
    ends = {after: role for role, (_, after) in ROLES.items()}
    at, role = 0, ""
    for m in _MARK.finditer(formatted):
        piece = formatted[at : m.start()]
        at = m.end()
        if m[0] == OTHER[1]:
            role = unescape(piece)
        elif m[0] == OTHER[2]:
            yield role, unescape(piece)
        elif m[0] in ends:
            yield ends[m[0]], unescape(piece)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer with the marks added; the strings of its own special tokens are plain text here."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    t.add_tokens([AddedToken(m, normalized=False, special=False) for m in MARKS])
    return t


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens, by (start, end) offsets in order, meet one of the sorted, disjoint spans."""
    if not len(offsets) or not len(spans):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 1], offsets[:, 0], "right")  # the first span that ends behind the token's start
    return (at < len(spans)) & (spans[np.minimum(at, len(spans) - 1), 0] < offsets[:, 1])


class _Part:
    """Turns of one conversation in their order."""

    def __init__(self, conv):
        self.conv, self.pieces, self.size, self.spans = conv, [], 0, []

    def add(self, role: str, text: str) -> None:
        before, body, after = render(role, text)
        start = self.size + len(before)
        if role == "assistant" and body:
            self.spans.append((start, start + len(body)))
        self.pieces += [before, body, after]
        self.size = start + len(body) + len(after)


def format_chats(rows: DataFrame, tokenizer_file: str, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = 1 << 20) -> DataFrame:
    """(id_col, part, whole, formatted, ids, mask): each conversation as formatted text, its token ids and
    which of them are learnt from.

    Nearly all conversations are one row. One that has more than about ``part_chars`` code points, or
    that lies across a border of range partitions, has several, in the order of ``part``; ``whole`` is
    true where a row is known to be all of its conversation. Memory holds one part and its longest turn.

    Rows of one turn number, or without one, come in the order of a hash of role and text, those
    without a number first; repeated rows are turns of their own. Null texts and roles count as empty,
    rows without an id are one conversation. Empty texts are turns without a token. An empty table
    gives an empty result; other columns are ignored.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    src = rows.select(F.col(id_col).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("r", "t"))
    ordered = src.repartitionByRange("c", "n", "h").sortWithinPartitions("c", "n", "h", "r", "t").select("c", "r", "t")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Part, bool]]:
        now, convs, cut = None, 0, False
        for whole in batches:
            for b in slices(whole, 4 << 20, column=2):
                for c, r, t in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if now is None or c != now.conv:
                        if now:
                            yield now, convs > 1 and not cut
                        now, convs, cut = _Part(c), convs + 1, False
                    elif now.size >= part_chars:
                        yield now, False
                        now, cut = _Part(c), True
                    now.add(r, t)
        if now:  # as the first one, it may go on in another partition
            yield now, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts(batches):
            held.append(part)
            size += part[0].size
            if size >= part_chars:
                yield encoded(held)
                held, size = [], 0
        if held:
            yield encoded(held)

    def encoded(held: list[tuple[_Part, bool]]) -> pa.RecordBatch:
        texts = ["".join(p.pieces) for p, _ in held]
        ids, masks = [], []
        for (p, _), e in zip(held, tokenizer(tokenizer_file).encode_batch(texts, add_special_tokens=False), strict=True):
            offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
            ids.append(np.array(e.ids, np.int32))
            masks.append(loss_mask(offsets, np.array(p.spans, np.int64).reshape(-1, 2)))
        ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (ids, masks)]
        first = pa.array([p.conv for p, _ in held], pa_kind)
        return pa.RecordBatch.from_arrays([first, pa.array([w for _, w in held], pa.bool_()), pa.array(texts, pa.string()), *lists], names=[id_col, "whole", "formatted", "ids", "mask"])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(rows.schema[id_col].dataType)
    out = ordered.mapInArrow(run, f"`{id_col}` {kind}, whole boolean, formatted string, ids array<int>, mask array<boolean>")
    return out.select(F.col(f"`{id_col}`"), F.monotonically_increasing_id().alias("part"), "whole", "formatted", "ids", "mask")


def learnt(ids: np.ndarray, mask: np.ndarray, t) -> Iterator[str]:
    """The text of each run of learnt tokens, decoded and unescaped."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    for a, b in edges.reshape(-1, 2):
        yield unescape(t.decode(ids[a:b].tolist(), skip_special_tokens=False))


def read_back(chats: DataFrame, tokenizer_file: str, id_col: str = "conv_id") -> DataFrame:
    """(id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from what
    ``format_chats`` returned: turns are parsed from the formatted text, what is learnt is decoded from
    the ids under the mask. Only conversations in several parts are shuffled; their digests go on from
    part to part, so that no conversation is held in memory."""
    kind = chats.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(kind)

    class Sum:
        def __init__(self, conv):
            self.conv, self.n, self.chars, self.all = conv, 0, 0, 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def row(self) -> tuple:
            return self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, now = tokenizer(tokenizer_file), None
        for b in batches:
            done = []
            for i in range(b.num_rows):
                conv = b.column(0)[i].as_py()
                if now is None or conv != now.conv:
                    if now:
                        done.append(now.row())
                    now = Sum(conv)
                formatted = b.column(1)[i].as_py()
                now.all += len(formatted)
                for role, text in turns(formatted):
                    now.n += 1
                    now.turns.update(f"{role}\n{text}\n".encode())
                ids, mask = b.column(2)[i].values, b.column(3)[i].values
                for text in learnt(ids.to_numpy(), mask.to_numpy(zero_copy_only=False), t):
                    now.chars += len(text)
                    now.loss.update(text.encode())
            if done:
                yield batch(done)
        if now:
            yield batch([now.row()])

    def batch(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    fields = [F.col(f"`{id_col}`"), "formatted", "ids", "mask"]
    schema = f"`{id_col}` {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    parts = chats.where("not whole").repartition(f"`{id_col}`").sortWithinPartitions(f"`{id_col}`", "part")
    return chats.where("whole").select(*fields).mapInArrow(run, schema).union(parts.select(*fields).mapInArrow(run, schema))
