"""Language-model scores from a subword lattice.

A word's probability is the sum over all its segmentations into pieces of an existing vocabulary,
weighted by its existing scores, by forward recursion in log space. No piece runs over a word's
start, so a text's is the product over its words and its end: the sum over all segmentations of
the whole text. Where it learns, the pieces' weights go on from those scores by expected counts
over the training texts, and each training word is a piece of its own that spans it alone. The base
score beside it is learnt, too: smoothed frequencies of whole words in the training texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import Scratch, slices

#: The marks of a word start and of the text's end in the vocabulary.
START, END = "▁", "</s>"
#: A key that no word can have, since words hold no white space.
END_KEY = " "
LN10 = math.log(10)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """(piece, prior probability) of a public vocabulary, learnt nowhere.

    A byte-pair vocabulary scores a piece by minus its rank, and frequency falls about as one over
    the rank; pieces with log probabilities as scores keep them.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(p.id_to_piece(i), p.get_score(i), p.is_byte(i)) for i in range(p.get_piece_size()) if not (p.is_unknown(i) or p.is_control(i))]
    ranked = min(s for _, s, _ in pieces) < -1000
    weight = {w: 1e-3 / 256 if byte else (1 / (2.7 - s) if ranked else math.exp(s)) for w, s, byte in pieces}
    weight[START] = max(weight.get(START, 0.0), 1e-4)
    weight[END] = 1e-3
    total = sum(weight.values())
    return tuple((w, x / total) for w, x in weight.items())


class Lattice:
    """Forward and backward sums over the segmentations of many words at once.

    The pieces form a trie; all words of a batch take each step through it together. Words of
    like length share a batch, so memory follows the batch's characters.
    """

    def __init__(self, weights: dict[str, float]):
        log = {w: math.log(p) for w, p in weights.items() if p > 0}
        nodes = {"": 0}
        for w in log:
            for k in range(1, len(w) + 1):
                nodes.setdefault(w[:k], len(nodes))
        self.names = list(nodes)
        edges = sorted(((nodes[w[:-1]] << 21) | ord(w[-1]), n) for w, n in nodes.items() if w)
        self.keys = np.array([k for k, _ in edges] + [1 << 62], np.int64)
        self.child = np.array([n for _, n in edges] + [0], np.int64)
        self.log = np.array([log.get(w, -np.inf) for w in nodes])
        self.log[0] = -np.inf
        self.bytes = np.array([log[f"<0x{x:02X}>"] for x in range(256)])
        self.byte_nodes = np.array([nodes[f"<0x{x:02X}>"] for x in range(256)])
        self.end = log[END]

    def batches(self, words: list[str], most: int = 60_000) -> Iterator[np.ndarray]:
        """Indices of words of like length, about ``most`` characters together."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(n, kind="stable")
        at = 0
        while at < len(order):
            stop = at + 1
            step = max(1, most // int(n[order[at]] + 2))
            stop = min(len(order), at + step)
            while stop > at + 1 and n[order[stop - 1]] > 2 * n[order[at]] + 4:
                stop = at + (stop - at) // 2
            yield order[at:stop]
            at = stop

    def _forward(self, words: list[str], arcs: list[tuple] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums up to each place, numbers of places, sums of whole words. Each use of a piece goes to
        ``arcs``: (words, from, to, weights, trie nodes, or -1 - character where it is spelt in bytes)."""
        texts = [START + w for w in words]
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        wide = int(n.max())
        code = np.zeros((len(texts), wide), np.int64)
        code[np.arange(wide)[None, :] < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        f = np.full((len(texts), wide + 1), -np.inf)
        f[:, 0] = 0.0
        for i in range(wide):
            row = np.flatnonzero(n > i)
            state = np.zeros(len(row), np.int64)
            for j in range(i, wide):
                key = (state << 21) | code[row, j]
                pos = np.searchsorted(self.keys, key)
                ok = self.keys[pos] == key
                if j == i:  # a character that no piece holds alone is spelt in bytes
                    single = np.full(len(row), -np.inf)
                    single[ok] = self.log[self.child[pos[ok]]]
                    odd = row[single == -np.inf]
                    if len(odd):
                        chars, which = np.unique(code[odd, i], return_inverse=True)
                        spelt = np.array([self.bytes[list(chr(c).encode("utf-8", "replace"))].sum() for c in chars])
                        f[odd, i + 1] = np.logaddexp(f[odd, i + 1], f[odd, i] + spelt[which])
                        if arcs is not None:
                            arcs.append((odd, i, i + 1, spelt[which], -1 - code[odd, i]))
                row, state = row[ok], self.child[pos[ok]]
                if not len(row):
                    break
                x = self.log[state]
                hit = x > -np.inf
                if hit.any():
                    r = row[hit]
                    f[r, j + 1] = np.logaddexp(f[r, j + 1], f[r, i] + x[hit])
                    if arcs is not None:
                        arcs.append((r, i, j + 1, x[hit], state[hit]))
                inside = n[row] > j + 1
                row, state = row[inside], state[inside]
                if not len(row):
                    break
        return f, n, f[np.arange(len(texts)), n]

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log of the summed probability of all segmentations of each word."""
        out = np.zeros(len(words))
        for at in self.batches(words):
            out[at] = self._forward([words[i] for i in at])[2]
        return out

    def expected(self, words: list[str], total: np.ndarray) -> None:
        """Add the expected uses of each piece over the words to ``total``, by trie node."""
        for at in self.batches(words):
            arcs: list[tuple] = []
            f, n, z = self._forward([words[i] for i in at], arcs)
            b = np.full_like(f, -np.inf)
            b[np.arange(len(n)), n] = 0.0
            for r, i, j, x, node in reversed(arcs):
                over = x + b[r, j]
                b[r, i] = np.logaddexp(b[r, i], over)
                p = np.exp(f[r, i] + over - z[r])
                if node[0] >= 0:
                    total += np.bincount(node, p, minlength=len(total))
                    continue
                for c, q in zip((-1 - node).tolist(), p.tolist(), strict=True):
                    for byte in chr(c).encode("utf-8", "replace"):
                        total[self.byte_nodes[byte]] += q


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased words of all texts as a dictionary array, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    flat, n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(flat, "")
    if pc.any(blank).as_py():  # a blank text is one empty word here; it has none
        keep = pc.invert(blank)
        at = np.repeat(np.arange(len(n)), n)[keep.to_numpy(zero_copy_only=False)]
        flat, n = flat.filter(keep), np.bincount(at, minlength=len(n)).astype(np.int64)
    return flat.dictionary_encode(), n


def count_words(texts: DataFrame, hold: int = 400_000) -> DataFrame:
    """(word, c) over the string column ``t``; END_KEY counts the texts.

    Each task adds up its own words before the shuffle, in a table of bounded size that is passed
    on whenever it is full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for b in batches:
            held[END_KEY] = held.get(END_KEY, 0) + b.num_rows
            for part in slices(b):
                coded, _ = _words(part.column(1))
                n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                for w, c in zip(coded.dictionary.to_pylist(), n.tolist(), strict=True):
                    held[w] = held.get(w, 0) + c
                if len(held) > hold:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return texts.select(F.lit(0).alias("z"), "t").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_pieces(counts: DataFrame, weights: dict[str, float], rounds: int, prior: float = 200.0) -> dict[str, float]:
    """Piece weights by expected counts over the training words (word, c), each round from the last weights.

    Every distinct word counts once, and so does the end: pieces spell what is new, and new words
    are like the many rare ones. ``prior`` uses are dealt by the first weights, so none becomes zero.
    Only a sum for each piece of the vocabulary reaches the driver.
    """
    first = weights
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], now: dict[str, float] = weights) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(now)
            total = np.zeros(len(lattice.names))
            for b in batches:
                lattice.expected([w for w in b.column(0).to_pylist() if w != END_KEY], total)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lattice.names[i] for i in used], pa.string()), pa.array(total[used])], names=["piece", "x"])

        seen = {r.piece: r.x for r in counts.mapInArrow(run, "piece string, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()}
        seen[END] = 1.0
        total = math.fsum(seen.values()) + prior
        weights = {w: (seen.get(w, 0.0) + prior * p) / total for w, p in first.items()}
    return weights


def score(docs: DataFrame, scratch: Scratch, vocabulary_path: str, held_out, id_col: str = "doc_id", text: str = "text", head: int = 100_000, rounds: int = 0) -> DataFrame:
    """One row a document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, prior_score.

    ``prior_score`` is the sum over segmentations by the vocabulary's existing scores; ``score`` is the
    same where ``rounds`` is 0. Else the pieces are fitted in so many rounds, and a training word is
    a piece with its count less a discount; what all discounts leave is the share of words spelt
    in pieces. So the scores are logs of probabilities that add up to no more than one.

    ``held_out`` is the Column that keeps a document out of training. ``head`` bounds what every
    task holds: the commonest training words, with their counts. All other words of the documents,
    whatever they are, are looked up by a shuffle join, so the split changes no result. Null and
    blank texts are their end alone. With nothing to train on, counts are zero. Repeated ids are each
    scored once a row. Texts are read in slices of about 8 MB, or one text; words of any length are
    scored in batches of like length, whose table is as large as their characters.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), held_out.alias("held_out"))
    counts = scratch.table(count_words(source.where("not held_out")), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n, v = total.n or 0, total.v or 0
    weights = dict(vocabulary(vocabulary_path))
    learns = rounds > 0 and n > 0
    fitted = fit_pieces(counts, weights, rounds) if learns else weights
    # absolute discount by the numbers of words seen once and twice; never all of a count, never none
    less = min(max(total.once / max(total.once + 2 * total.twice, 1), 0.1), 0.9)
    add = math.log10(n + v + 1)

    def priced(words: DataFrame) -> DataFrame:
        """(word, c) to (word, c, base, full, prior) in log10."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattices = [Lattice(weights), *[Lattice(fitted)] * learns]
            for b in batches:
                words, c = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(float)
                base = np.log10(c + 1) - add
                ends = [w == END_KEY for w in words]
                spelt = []
                for lattice in lattices:
                    x = lattice.score(words)
                    x[ends] = lattice.end
                    spelt.append(x)
                full = spelt[-1]
                if learns:
                    with np.errstate(divide="ignore"):
                        full = np.logaddexp(full + math.log(less * v / n), np.log(np.maximum(c - less, 0) / n))
                cols = [pa.array(x, pa.float64()) for x in (base, full / LN10, spelt[0] / LN10)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["word", "c", "base", "full", "prior"])

        return words.mapInArrow(run, "word string, c long, base double, full double, prior double")

    top = counts.where(F.col("word") != END_KEY).orderBy(F.desc("c"), "word").limit(head)
    end_count = counts.where(F.col("word") == END_KEY).select("word", "c").union(docs.sparkSession.createDataFrame([(END_KEY, 0)], "word string, c long")).groupBy("word").agg(F.max("c").alias("c"))
    near = priced(top.union(end_count)).toArrow()
    end = near.filter(pc.equal(near["word"], END_KEY)).to_pylist()[0]
    near = near.filter(pc.not_equal(near["word"], END_KEY))
    held = docs.sparkSession.sparkContext.broadcast((near["word"].to_pylist(), *[near[x].to_numpy() for x in ("base", "full", "prior")]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, *prices = held.value
        place = {w: i for i, w in enumerate(words)}
        prices = [np.append(x, 0.0) for x in prices]
        for whole in batches:
            for b in slices(whole):
                coded, per = _words(b.column(1))
                vocab = coded.dictionary.to_pylist()
                at = np.fromiter((place.get(w, -1) for w in vocab), np.int64, len(vocab))
                index = coded.indices.to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(per)), per)
                hit = at[index] if len(vocab) else np.zeros(0, np.int64)
                add_up = lambda x, doc=doc, n=len(per): np.bincount(doc, x, minlength=n).astype(float)
                tail = np.flatnonzero(hit < 0)
                starts = np.searchsorted(doc[tail], np.arange(len(per) + 1))
                rest = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), coded.dictionary.take(pa.array(index[tail])))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(per + 1, pa.int64()), pa.array(add_up((hit >= 0).astype(float)).astype(np.int64)), *[pa.array(add_up(x[hit])) for x in prices], rest],
                    names=["id", "held_out", "n_tokens", "n_known", "base", "full", "prior", "rest"],
                )

    kind = source.schema["id"].dataType.simpleString()
    first = source.withColumn("row", F.monotonically_increasing_id()).select(F.struct("id", "row").alias("id"), "t", "held_out")
    looked = scratch.table(first.mapInArrow(look, f"id struct<id:{kind},row:bigint>, held_out boolean, n_tokens long, n_known long, base double, full double, prior double, rest array<string>"), "looked")
    # words outside the head: once per document and word, then priced once per word
    far = looked.select("id", F.explode("rest").alias("word")).groupBy("id", "word").agg(F.count("*").alias("k"))
    far = scratch.table(far, "far")
    prices = priced(far.select("word").distinct().join(counts, "word", "left").select("word", F.coalesce("c", F.lit(0)).cast("long").alias("c")))
    sums = far.join(prices, "word").groupBy("id").agg(F.sum(F.col("k") * F.col("base")).alias("b"), F.sum(F.col("k") * F.col("full")).alias("f"), F.sum(F.col("k") * F.col("prior")).alias("p"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return looked.join(sums, "id", "left").select(
        F.col("id.id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("known") + F.lit(int(end["c"] > 0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") + F.lit(end["base"])).alias("base_score"),
        (F.col("full") + zero("f") + F.lit(end["full"])).alias("score"),
        (F.col("prior") + zero("p") + F.lit(end["prior"])).alias("prior_score"),
    )
