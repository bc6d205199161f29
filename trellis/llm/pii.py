"""Personal data: exact patterns, widened by a skip-chain conditional random field.

Patterns find the base spans. The field then labels the other candidate tokens: those with a digit
or an @, and words that are the local part of an address of the document; all others are outside
by definition. Its graph has chain edges between neighbouring candidates and skip edges between
successive occurrences of the same or a similarly written token, however far apart in the
document; loopy belief propagation makes their labels agree. So a number written without its
country code, the last digits of a card or an address without its domain get the label of their
full form. Base spans are observed evidence and always stay.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import slices

#: The kinds, in their order among spans that start together.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
#: The base patterns. The e-mail's local part is searched from its @ (see emails()).
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\s,;:!?\"'<>|#$%&*=]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_BUCKETS = 1024


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and domain.

    A local part runs up to its @, so it starts where the run of its characters does, or at the
    end of the match before; walking back from each @ is linear, unlike a search from the left.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers of at most 255. A maximal dotted run is cut from its left into fours,
    which is what a leftmost search gives, in linear time even on endless digits."""
    for m in DOTTED.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _plain(token: str) -> str:
    return re.sub(r"[\W_]+", "", token).lower()


def candidates(text: str, names: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Tokens with a digit or an @, or among ``names`` when stripped to letters and digits, without the
    punctuation around them."""
    out = []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while s < e and not (text[s].isalnum() or text[s] in "+("):
            s += 1
        while s < e and not (text[e - 1].isalnum() or text[e - 1] == ")"):
            e -= 1
        if s < e and (re.search("[0-9@]", text[s:e]) or (names and _plain(text[s:e]) in names)):
            out.append((s, e))
    return out


def likeness(token: str) -> list[str]:
    """What tokens have in common that skip edges join: all letters and digits, the last digits, the
    local part of an address. Short ones say nothing."""
    key, digits = _plain(token), re.sub("[^0-9]", "", token)
    out = [f"a{key}"] if len(key) >= 4 else []
    if len(digits) >= 7:
        out.append(f"d{digits[-7:]}")
    name = _plain(token.partition("@")[0])
    if len(name) >= 5:
        out.append(f"n{name}")
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every valid base match, in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(s, 1, e) for s, e in ips(text)]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() < 80 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _stable(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % _BUCKETS


def _features(text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """Feature buckets of a token: its own, and those of its context."""
    tok = text[start:end]
    digits = re.sub("[^0-9]", "", tok)
    shape = re.sub("a+", "a", re.sub("[^\\W\\d_]", "a", re.sub("[0-9]", "9", tok)))[:24]
    own = [f"shape={shape}", f"loose={re.sub('9+', '9', shape)}", f"n={len(digits)}", f"first={tok[0] if not tok[0].isalnum() else 'w'}", f"at={'@' in tok}", f"dots={tok.count('.')}", f"alpha={any(c.isalpha() for c in tok)}"]
    if 12 <= len(digits) <= 19 and len(digits) == len(tok):
        own.append(f"luhn={luhn(digits)}")
    near = lambda w: re.sub("[0-9]", "9", w.lower())[:16]
    context = ["bias", *(f"prev={near(w)}" for w in text[max(0, start - 24) : start].split()[-1:]), *(f"next={near(w)}" for w in text[end : end + 24].split()[:1])]
    return [_stable(n) for n in own], [_stable(n) for n in context]


@dataclass
class Graph:
    spans: list[tuple[int, int]]
    features: list[tuple[list[int], list[int]]]
    observed: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph(text: str, base: list[tuple[int, int, int]]) -> Graph:
    """Nodes and edges of one document. Each node has at most three skip edges to the left, so the
    number of edges is linear in the nodes however often a token repeats."""
    names = frozenset(n for s, k, e in base if k == 0 and len(n := _plain(text[s:e].partition("@")[0])) >= 5)
    spans = candidates(text, names)
    observed, k = [], 0
    for s, e in spans:
        while k < len(base) and base[k][2] <= s:
            k += 1
        hit = next((b for b in base[k : k + 4] if b[0] < e and b[2] > s), None)
        observed.append(hit[1] + 1 if hit else -1)
    last: dict[str, int] = {}
    chain, skip = [], []
    for i, (s, e) in enumerate(spans):
        if i and s - spans[i - 1][1] <= 3:
            chain.append((i - 1, i))
        keys = likeness(text[s:e])
        skip += [(j, i) for j in dict.fromkeys(last[key] for key in keys if key in last)]
        last.update(dict.fromkeys(keys, i))
    return Graph(spans, [_features(text, s, e) for s, e in spans], observed, chain, skip)


def _json(g: Graph) -> str:
    return json.dumps([g.features, g.observed, g.chain, g.skip])


@dataclass
class Field:
    """Log potentials: by feature bucket and label, for chain edges, for skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def train(graphs: list[list], epochs: int = 60, rate: float = 0.5, l2: float = 1e-3) -> Field | None:
    """Piecewise training on base labels: a softmax over features, and smoothed log ratios of how
    often labels meet across chain and skip edges. None if the sample has no personal data.

    A token that no pattern found but that is joined to one that was found has no label: it is
    what the field is to decide, so neither weights nor ratios learn from it. Every other token is
    seen twice, once as it is and once with the evidence of its own form hidden, so that the
    context learns to tell without it.
    """
    rows, labels = [], []
    meet = {"chain": np.ones((5, 5)), "skip": np.eye(5) * 4 + 0.25}
    for features, observed, chain, skip in graphs:
        unknown = {i for e in skip for i, j in (e, e[::-1]) if observed[i] < 0 <= observed[j]}
        lab = [max(o, 0) for o in observed]
        for i, (own, context) in enumerate(features):
            if i not in unknown:
                rows += [[*own, *context], context]
                labels += [lab[i]] * 2
        for name, edges in (("chain", chain), ("skip", skip)):
            for i, j in edges:
                if i not in unknown and j not in unknown:
                    meet[name][lab[i], lab[j]] += 1
                    if name == "skip":
                        meet[name][lab[j], lab[i]] += 1
    y = np.array(labels, dtype=int)
    if not len(y) or not y.any():
        return None
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.array(r) for r in rows])
    w = np.zeros((_BUCKETS, 5))
    goal = np.eye(5)[y]
    g2 = np.full_like(w, 1e-8)
    for _ in range(epochs):
        z = np.zeros((len(rows), 5))
        np.add.at(z, at, w[col])
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = np.zeros_like(w)
        np.add.at(grad, col, ((p - goal) / len(rows))[at])
        grad += l2 * w / len(rows)
        g2 += grad * grad
        w -= rate * grad / np.sqrt(g2)
    ratio = lambda m: np.log(m / m.sum()) - np.log(m.sum(1, keepdims=True) / m.sum()) - np.log(m.sum(0, keepdims=True) / m.sum())
    return Field(w, np.clip(ratio(meet["chain"]), -3, 3), np.clip(ratio(meet["skip"]), -6, 6))


def marginals(field: Field, graphs: list[Graph], rounds: int = 100, damping: float = 0.3) -> np.ndarray:
    """Loopy sum-product over all nodes of a batch of documents at once; one row a node. Each document
    stops when its own messages have settled, so the others of the batch don't matter to it."""
    first = np.cumsum([0, *[len(g.spans) for g in graphs]])
    phi = np.zeros((int(first[-1]), 5))
    a, b, kind, doc = [], [], [], []
    for d, (g, f0) in enumerate(zip(graphs, first, strict=False)):
        for i, ((own, context), seen) in enumerate(zip(g.features, g.observed, strict=True)):
            phi[f0 + i] = field.unary[own + context].sum(0) if seen < 0 else np.where(np.arange(5) == seen, 0.0, -50.0)
        for k, edges in ((0, g.chain), (1, g.skip)):
            a += [f0 + i for i, _ in edges]
            b += [f0 + j for _, j in edges]
            kind += [k] * len(edges)
            doc += [d] * len(edges)
    if not len(phi):
        return phi
    belief = phi.copy()
    on = np.arange(len(a))
    a_, b_, doc_ = np.array(a, int), np.array(b, int), np.array(doc, int)
    pot = np.stack([field.chain, field.skip])[np.array(kind, int)]
    ab, ba = np.zeros((len(a), 5)), np.zeros((len(a), 5))
    for _ in range(rounds):
        if not len(on):
            break
        i, j = a_[on], b_[on]
        to_b = np.logaddexp.reduce((belief[i] - ba[on])[:, :, None] + pot[on], axis=1)
        to_a = np.logaddexp.reduce((belief[j] - ab[on])[:, None, :] + pot[on], axis=2)
        to_b, to_a = (damping * old[on] + (1 - damping) * (new - new.max(1, keepdims=True)) for old, new in ((ab, to_b), (ba, to_a)))
        change = np.maximum(np.abs(to_b - ab[on]).max(1), np.abs(to_a - ba[on]).max(1))
        np.add.at(belief, j, to_b - ab[on])
        np.add.at(belief, i, to_a - ba[on])
        ab[on], ba[on] = to_b, to_a
        moved = np.zeros(len(graphs))
        np.maximum.at(moved, doc_[on], change)
        on = on[moved[doc_[on]] >= 1e-4]
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, g: Graph, p: np.ndarray, base: list[tuple[int, int, int]], sure: float) -> list[tuple[int, int, int]]:
    """Runs of equally labelled neighbours that the base left out; none overlaps a base span."""
    out: list[tuple[int, int, int]] = []
    near = {j for _, j in g.chain}
    for i, (s, e) in enumerate(g.spans):
        k = int(p[i].argmax())
        if k == 0 or g.observed[i] >= 0 or p[i, k] < sure:
            continue
        if out and i in near and out[-1][1] == k - 1 and out[-1][2] == g.spans[i - 1][1]:
            out[-1] = (out[-1][0], k - 1, e)
        else:
            out.append((s, k - 1, e))
    return [x for x in out if not any(b[0] < x[2] and b[2] > x[0] for b in base)]


def find(texts: list[str | None], field: Field | None, sure: float = 0.5) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    bases = [base_spans(t or "") for t in texts]
    if field is None:
        return [(b, b) for b in bases]
    graphs = [graph(t or "", b) for t, b in zip(texts, bases, strict=True)]
    p, at, out = marginals(field, graphs), 0, []
    for t, b, g in zip(texts, bases, graphs, strict=True):
        more = added_spans(t or "", g, p[at : at + len(g.spans)], b, sure)
        at += len(g.spans)
        out.append((b, sorted([*b, *more])))
    return out


def _worth_reading(text: str):
    """Only texts with a digit or an @ can hold any span; the others need not leave the JVM."""
    return F.when(F.col(text).rlike("[0-9@]"), F.col(text))


def fit(docs: DataFrame, sample_docs: int = 2000, id_col: str = "doc_id", text: str = "text") -> Field | None:
    """Train on the base labels of at most ``sample_docs`` documents with candidates, those of the
    smallest id hashes, whatever the size of the table. Only features and labels leave the tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            yield pa.RecordBatch.from_arrays([pa.array([_json(graph(t, base_spans(t))) for t in b.column(1).to_pylist()], pa.string())], names=["g"])

    rows = docs.select(F.col(id_col).alias("id"), _worth_reading(text).alias("t")).where("t is not null").select(F.xxhash64("id", "t").alias("h"), "t")
    # only hashes meet in one task; the largest of the smallest says which texts to read
    bound = rows.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    if bound is None:
        return None
    chosen = rows.where(F.col("h") <= bound).dropDuplicates(["h"]).select(F.lit(0).alias("z"), "t")
    return train([json.loads(r.g) for r in chosen.mapInArrow(read, "g string").collect()])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text: str = "text", sure: float = 0.5) -> DataFrame:
    """(id_col, base string, spans string, n_added long) of every row; null and blank texts have none.

    Repeated rows are treated alike, an empty table gives an empty result, other columns of the
    input are ignored. Labels that are equally likely go to the first kind. A task holds about 8 MB
    of texts at once, or one text; time and memory are linear in a text's candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            texts = b.column(1).to_pylist()
            hit = [i for i, t in enumerate(texts) if t]
            got: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
            for at in range(0, len(hit), 200):
                part = hit[at : at + 200]
                got.update(zip(part, find([texts[i] for i in part], field, sure), strict=True))
            pairs = [got[i] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_joined(x) for x, _ in pairs], pa.string()), pa.array([_joined(y) for _, y in pairs], pa.string()), pa.array([len(y) - len(x) for x, y in pairs], pa.int64())], names=[id_col, "base", "spans", "n_added"])

    return docs.select(F.col(id_col), _worth_reading(text).alias("t")).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, base string, spans string, n_added long")


def masked(docs: DataFrame, field: Field | None, text: str = "text", sure: float = 0.5) -> DataFrame:
    """The rows with each span replaced by [KIND]; all columns stay, null texts stay null."""
    names = docs.columns
    at = names.index(text)

    def mask(t: str, spans: list[tuple[int, int, int]]) -> str:
        out, end = [], 0
        for s, k, e in spans:
            if s >= end:
                out += [t[end:s], f"[{KINDS[k].upper()}]"]
            end = max(end, e)
        return "".join([*out, t[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, column=at)):
            texts = b.column(at).to_pylist()
            hit = [i for i, t in enumerate(texts) if t and re.search("[0-9@]", t)]
            for i, (_, spans) in zip(hit, find([texts[i] for i in hit], field, sure), strict=True):
                texts[i] = mask(texts[i], spans)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))], names=names)

    return docs.mapInArrow(run, docs.schema)
