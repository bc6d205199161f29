import collections
import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trellis.llm import bpe, html, lines, lm, packing, passages, pii, quality, registry, simhash, vectors
from trellis.llm.common import Scratch, load
from trellis.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp long, t string, id long, doc long, pos long, v double, kept boolean"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 700}," for i in range(30000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long, repeated rows and clashing columns."""
    texts = {1: None, 2: "", 3: " \t\n ", 4: LONG, 5: "one two three four five six.\nmail a.b@c.de now", 7: "x"}
    rows = [(i, t, "en", None, None, 1, 2, "t", 3, 4, 5, 0.5, True) for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[4]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def scratch(spark):
    return Scratch(spark, f"test-{uuid.uuid4().hex}")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    parent = list(range(600))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), scratch(spark)).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_pii_base_is_exact(spark, sf):
    def plain(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
        return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15])

    rng = random.Random(1)
    made = ["".join(rng.choice("ab@..-+ 0125()%_é") for _ in range(60)) for _ in range(3000)]
    for t in [*made, *(r.text or "" for r in load(spark, sf, "documents").collect()), "4111 1111 1111 1111 4111-1111-1111-1111", "9" * 5000]:
        assert pii.base_spans(t) == plain(t)


def planted_forms(n, seed):
    """(texts, partial forms that are personal data, look-alikes that are not): half the texts give a full form and, far on, part of it."""
    rng, texts, partial, clean = random.Random(seed), [], set(), set()
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for i in range(n):
        area, line, name = num(3), f"{num(3)}-{num(4)}", "".join(rng.choice("abcdefghijk") for _ in range(8))
        card = next(c for c in iter(lambda: num(16), None) if pii.luhn(c))
        full = {"phone": f"call +1 ({area}) {line} now", "card": f"paid with {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} today", "email": f"mail {name}@site{i}.com soon"}
        part = {"phone": line if i % 2 else line.replace("-", ""), "card": f"****{card[12:]}", "email": name}
        kind = rng.choice(list(full))
        other = f"{num(3)}-{num(4)}"
        words = " ".join(rng.choice(["the", "of", "and", f"item {num(3)}", f"on {num(2)}.{num(2)}", "it"]) for _ in range(150))
        texts.append(f"x{i} {full[kind]} {words} " + (f"as before: {part[kind]} again" if i % 2 else f"order {other} and order {other} again"))
        if i % 2:
            partial.add((i, part[kind].strip("*"), kind))
        else:
            clean |= {(i, other)}
    return texts, partial, clean


def test_pii_finds_partial_forms_of_what_it_knows():
    """The field's own gains and false alarms: partial forms of a full one in the same text are labelled, look-alikes are not."""
    sample = [[g.features, g.observed, g.chain, g.skip] for t in planted_forms(200, 1)[0] for g in [pii.graph(t, pii.base_spans(t))]]
    texts, partial, clean = planted_forms(200, 2)
    found = pii.find(texts, pii.train(sample))
    more = {(i, texts[i][s:e], pii.KINDS[k]) for i, (base, spans) in enumerate(found) for s, k, e in set(spans) - set(base)}
    assert all(set(base) <= set(spans) for base, spans in found)
    assert len(more & partial) >= 0.9 * len(partial) and len(more - partial) <= 0.02 * len(texts)
    assert not {(i, x) for i, x, _ in more} & clean


def test_pii_marginals_are_exact_on_trees():
    """Without loops belief propagation is exact: against the sum over all labellings."""
    rng = np.random.default_rng(3)
    field = pii.Field(rng.normal(size=(pii._BUCKETS, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    skip = [(0, 2), (1, 4)]
    g = pii.Graph([(0, 1)] * 5, [([int(x)], [int(y)]) for x, y in rng.integers(0, pii._BUCKETS, (5, 2))], [-1, -1, 3, -1, -1], [(0, 1), (2, 3)], skip)
    alone = pii.Graph([(0, 1)] * 2, [([1], [2]), ([3], [4])], [-1, -1], [(0, 1)], [])
    want = np.zeros((5, 5))
    for labels in itertools.product(range(5), repeat=5):
        if labels[2] != 3:
            continue
        score = sum(field.unary[own + ctx].sum(0)[k] for i, ((own, ctx), k) in enumerate(zip(g.features, labels, strict=True)) if i != 2)
        score += sum(field.chain[labels[i], labels[j]] for i, j in g.chain) + sum(field.skip[labels[i], labels[j]] for i, j in skip)
        want[range(5), labels] += np.exp(score)
    got = pii.marginals(field, [g])
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)
    assert np.array_equal(pii.marginals(field, [alone, g, alone])[2:7], got)  # whatever else is in the batch


def test_pii_odd_rows(spark, odd, none):
    got = [(r.doc_id, r.base) for r in pii.detect(odd, pii.fit(odd)).collect()]
    assert sorted(got) == sorted([(1, ""), (2, ""), (3, ""), (4, ""), (5, "email:34:42"), (5, "email:34:42"), (7, "")])
    assert pii.detect(none, pii.fit(none)).count() == 0
    assert {r.text for r in pii.masked(odd, None).where("doc_id = 5").collect()} == {"one two three four five six.\nmail [EMAIL] now"}


def brute_lines(docs, similarity=0.8, width=8):
    """(doc, pos) of all lines but the first of each component, by comparing all lines with all."""
    places = [(d, p, re.sub(r"[\x20\x09-\x0D]+", " ", x).strip().lower()) for d, t in sorted(docs) for p, x in enumerate((t or "").split("\n"))]
    places = [x for x in places if x[2]]
    texts = list(dict.fromkeys(x for _, _, x in places))
    sets = [{x[i : i + width] for i in range(len(x) - width + 1)} or {x} for x in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                root[find(i)] = find(j)
    of, first = {x: find(i) for i, x in enumerate(texts)}, {}
    for d, p, x in places:
        first.setdefault(of[x], (d, p))
    return {(d, p): first[of[x]] for d, p, x in places if first[of[x]] != (d, p)}


def found_lines(spark, docs, **k):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {(r.doc, r.pos): (r.kept_doc, r.kept_pos) for r in lines.near_duplicate_lines(df, scratch(spark), **k).collect()}


def test_lines(spark, odd, none):
    base = [f"the {i} quick brown foxes {i * 7} jump over {i * 13} lazy dogs by the river bank and never come back" for i in range(40)]
    docs = [(i, f"{b}\nno. {i}") for i, b in enumerate(base)] + [(100 + i, base[0].replace("river", "riven")) for i in range(30)] + [(200, base[1]), (201, "  " + base[1].replace(" ", "\t") + ".\n\n \nno. 7")]
    assert found_lines(spark, docs) == brute_lines(docs) | {(201, 3): (7, 1)}
    assert lines.near_duplicate_lines(none, scratch(spark)).count() == 0
    out = lines.without_lines(odd, lines.near_duplicate_lines(odd, scratch(spark)))
    assert out.count() == 7 and out.columns == odd.columns


def test_lines_match_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()]
    want, got = brute_lines(docs), found_lines(spark, docs)
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)


@pytest.mark.parametrize("kind", ["words appended", "word replaced", "one component"])
def test_lines_of_one_template_settle(spark, kind):
    """Large buckets of lines that are half alike, or nearly as alike as it takes: all their close pairs are found."""
    rng = random.Random(8)
    head = "every line of this report opens with the same few words and goes on like so:"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    own = [f"{head} {' '.join(word() for _ in range(9))}" for _ in range(500)]
    more = [x + " zyxzyxzyx zyxzyxzyx zyxzyx" if kind == "words appended" else x[:100] + word() + x[106:] for x in own[:200]]
    if kind == "one component":  # most are alike through the shortest of them
        own, more = [head + " " + head + f" number {rng.randrange(10**8)}" for _ in range(600)], [head + " " + head]
    docs = list(enumerate([*own, *more]))
    want, got = brute_lines(docs), found_lines(spark, docs)
    assert len(want) >= len(more) and set(got) <= set(want) and len(got) >= 0.95 * len(want)


def test_lines_crowd_join_loses_no_component(spark):
    """Every line in one crowd: components by the prefix filter are those of all pairs."""
    rng = random.Random(4)
    docs = []
    for i in range(400):
        t = list(f"the shared part of this line, number {i % 40}, and {rng.randrange(90)} more of it to read")
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice("abc ")
        docs.append((i, "".join(t)))
    want = brute_lines(docs)
    got = found_lines(spark, docs, small=1, bands=12, rows=1)
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)


def test_lines_of_common_shingles_only(spark):
    """All shingles are common and most lines unlike: no link of the crowd is lost, though few lines are like the first."""
    rng = random.Random(9)
    phrases = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2)) + ", " for _ in range(14)]
    chosen = rng.sample(list(itertools.combinations(phrases, 10)), 250)
    docs = [(2 * i + k, "".join(x)[: -2 - 3 * k]) for i, x in enumerate(chosen) for k in (0, 1)]
    want = brute_lines(docs)
    assert len(want) >= 250
    assert found_lines(spark, docs, small=1, bands=24, rows=1) == want


def test_crossing_pairs_are_all_that_can_be_alike(spark):
    """Over several blocks, against all pairs; pairs of one component are left out, and the bound drops no like pair."""
    rng = random.Random(3)
    sets = []
    for i in range(90):
        one = {rng.getrandbits(63) for _ in range(rng.randrange(20, 60))}
        sets += [one, {*sorted(one)[2:], rng.getrandbits(63)}]
    hashes = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id long, hs array<long>")
    hot = spark.createDataFrame([(t, i, len(x), i % 3 > 0) for i, x in enumerate(sets) for t in (5, 6)], "token long, id long, n int, front boolean")
    parts = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    got = {(r.a, r.b) for r in lines.crossing_pairs(hot, hashes, parts, scratch(spark), 0.8, block=7).collect()}
    order = lambda i: (len(sets[i]), i)
    want = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if order(b) < order(a) and b % 3 and {a, b} != {0, 1} and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(want) > 50 and want <= got and len(got) < 2 * len(want)


def test_crossing_pairs_of_long_lines_are_few(spark):
    """Sets of 600 that share 450 are not alike enough: sketches tell, at whatever number of common tokens, and each pair that is left is given once."""
    rng = random.Random(5)
    draw = lambda n: {rng.getrandbits(63) for _ in range(n)}
    common = draw(450)
    sets = [common | draw(150) for _ in range(40)]
    sets += [{*sorted(x)[20:]} | draw(20) for x in sets[:10]]
    hashes = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id long, hs array<long>")
    hot = spark.createDataFrame([(t, i, len(x), True) for i, x in enumerate(sets) for t in range(6)], "token long, id long, n int, front boolean")
    got = [(r.a, r.b) for r in lines.crossing_pairs(hot, hashes, spark.createDataFrame([], "node long, component long"), scratch(spark), 0.8, block=16).collect()]
    assert len(got) == len(set(got)) < 60 and {(40 + i, i) for i in range(10)} <= set(got)


def test_near_copies_meet_few_others(spark, monkeypatch):
    """Lines that are nearly all alike, where none is like the one of fewest rarer shingles: the pairs compared grow with the lines, not with their square."""
    crowd, seen = lines.crowd_pairs, {}

    def unlike(*args):
        stars, *rest = crowd(*args)
        return stars.where("false"), *rest

    class Counting(Scratch):
        def table(self, df, name):
            seen[name] = (out := super().table(df, name)).count()
            return out

    monkeypatch.setattr(lines, "crowd_pairs", unlike)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(40)]
    docs = [(i, " ".join(word() if j == at else w for j, w in enumerate(base))) for i, at in enumerate(rng.randrange(40) for _ in range(160))]
    found = lines.near_duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string"), Counting(spark, "counting"), small=1)
    assert {(r.doc, r.pos): (r.kept_doc, r.kept_pos) for r in found.collect()} == brute_lines(docs)
    assert seen["pairs"] < 5 * len(docs) and seen["stars"] < 10 * len(docs)


def test_lines_link_through_those_like_the_smallest(spark):
    """Of three lines the middle one is like both others, which are unlike each other: all are one component."""
    rng = random.Random(6)
    make = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n)]
    docs = []
    for i in range(60):
        mid = make(20)
        docs += [(3 * i, " ".join(make(1) + mid[1:])), (3 * i + 1, " ".join(mid)), (3 * i + 2, " ".join(mid[:10] + make(1) + mid[11:]))]
    got = {r.doc: r.kept_doc for r in lines.near_duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string"), scratch(spark), bands=5, rows=1).collect()}
    assert got == {3 * i + k: 3 * i for i in range(60) for k in (1, 2)}


def test_lattice_sums_all_segmentations():
    w = dict(lm.vocabulary(registry.tokenizer_path("piece_bpe_32k.model")))
    lattice = lm.Lattice(w)
    for word in ("the", "thereation", "ä🙂x", "日本語", "a" * 40):
        t = lm.START + word
        f = [1.0] + [0.0] * len(t)
        for i in range(len(t)):
            if t[i] not in w:
                f[i + 1] += f[i] * math.prod(w[f"<0x{b:02X}>"] for b in t[i].encode())
            for j in range(i + 1, len(t) + 1):
                f[j] += f[i] * w.get(t[i:j], 0.0)
        assert lattice.score([word])[0] == pytest.approx(math.log(f[-1]), abs=1e-9)


def test_lm_score_is_the_sum_over_segmentations_of_the_text(spark):
    """One recursion over all characters of the text, pieces free to lie anywhere, against the operator's score."""
    path = registry.tokenizer_path("piece_bpe_32k.model")
    w = dict(lm.vocabulary(path))
    texts = ["The cat sat", "unheard-of wordlings, 日本 x", "", "a\tb  c\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in lm.score(docs, scratch(spark), path, F.col("doc_id") == 0).collect():
        t = "".join(lm.START + x for x in texts[r.doc_id].lower().split())
        f = [1.0] + [0.0] * len(t)
        for i in range(len(t)):
            if t[i] not in w:
                f[i + 1] += f[i] * math.prod(w[f"<0x{b:02X}>"] for b in t[i].encode())
            for j in range(i + 1, min(len(t), i + 40) + 1):
                f[j] += f[i] * w.get(t[i:j], 0.0)
        assert r.score == pytest.approx(math.log10(f[-1] * w[lm.END]), abs=1e-9)


def test_lm_base(spark, sf, odd, none):
    out = (F.crc32(F.col("doc_id").cast("string")) % 7) == 2
    path = registry.tokenizer_path("piece_bpe_32k.model")
    docs = load(spark, sf, "documents")
    tokens = {r.doc_id: [w.translate(LOW) for w in words(r.text)] + [" "] for r in docs.collect()}
    c = collections.Counter(w for k, t in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for head in (50, 100000):
        for r in lm.score(docs, scratch(spark), path, out, head=head).collect():
            t = tokens[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in c for w in t), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) and r.score < 0
    assert {(r.doc_id, r.n_tokens) for r in lm.score(odd, scratch(spark), path, out).collect()} == {(1, 1), (2, 1), (3, 1), (4, 30001), (5, 10), (7, 2)}
    assert lm.score(none, scratch(spark), path, out).count() == 0


def test_lm_learns_from_training_texts(spark, sf, odd, none):
    """Held-out texts score near their base score, every text has a finite score, whatever the head holds; new held-out
    texts change no score; and words that are all there is have no more than the whole probability."""
    path = registry.tokenizer_path("piece_bpe_32k.model")
    rows = registry.op3_lattice_lm(spark, sf).collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    new = [r for r in rows if r.held_out]
    base, score, prior = (sum(r[c] for r in new) for c in ("base_score", "score", "prior_score"))
    assert score > 1.3 * base and prior < 2 * base  # the existing scores alone are far below
    out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    more = load(spark, sf, "documents").withColumn("text", F.when(out, F.lit("etwas ganz anderes 日本")).otherwise(F.col("text")))
    want = {r.doc_id: r.score for r in rows if not r.held_out}
    got = {r.doc_id: r.score for r in lm.score(more, scratch(spark), path, out, head=50, rounds=2).collect() if r.doc_id in want}
    assert got == pytest.approx(want)
    letters = ["".join(x) for n in (1, 2) for x in itertools.product("abcdefghijklmnopqrstuvwxyzé", repeat=n)]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(["a b a ab", "ab a", *letters, ""])], "doc_id long, text string")
    got = {r.doc_id: 10**r.score for r in lm.score(docs, scratch(spark), path, F.col("doc_id") > 1, rounds=2).collect()}
    end = got[len(letters) + 2]
    assert 0.5 < sum(got[i + 2] for i in range(len(letters))) / end + end <= 1 + 1e-9
    assert lm.score(odd, scratch(spark), path, F.col("doc_id") == 5, rounds=1).where("isnan(score) or score is null or score < -1e6").count() == 0
    assert lm.score(none, scratch(spark), path, F.lit(False), rounds=1).count() == 0


def test_quality(spark, sf, odd, none):
    def plain(t):
        w = words(t)
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = collections.Counter(g)
        rep = {i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)}
        ls = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum((t or "").count(x) for x in quality.SYMBOLS), len(ls) - len(set(ls)), len(rep)

    for df in (load(spark, sf, "documents"), odd):
        for r in quality.assess(df.select("doc_id", "text")).collect():
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got == plain(r.text) and r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
    assert quality.assess(none).count() == 0 and quality.assess(odd).count() == 7


def test_quality_takes_wide_gaps_in_its_stride(spark):
    gaps = [(i, (" " * 10).join(f"w{j}" for j in range(n)) * k) for i, (n, k) in enumerate([(11, 1), (4, 1), (40, 200)])]
    gaps.append((3, " " * 200_000))
    began = time.time()
    assert {r.doc_id: r.n_words for r in quality.assess(spark.createDataFrame(gaps, "doc_id long, text string")).collect()} == {0: 11, 1: 4, 2: 40 * 200 - 199, 3: 0}
    assert time.time() - began < 20


def test_quality_weighs_a_phrase_by_its_share_of_the_line(spark):
    body = "A sentence of some words that says a thing or two. " * 30
    rows = [(0, body + "click here"), (1, body + "\nclick here"), (2, body)]
    assert {r.doc_id: r.clean_text for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0: rows[0][1], 1: body, 2: body}


def test_html(spark):
    page = '<html><head><title>t</title><script>var a="<p>no";</script></head><body><nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First, a long paragraph, with commas, and more words.<p>Second&nbsp;one is   here,<br>and it goes on for a while too.<form>no</form><div class="comments"><p>Great article, really, I liked it, very much.</p></div></article><aside>side</aside><footer>foot</footer>'
    assert html.extract(page) == "Head & line\nFirst, a long paragraph, with commas, and more words.\nSecond one is here, and it goes on for a while too."
    plain = '<div id="header">Site</div><div class="w"><div class="post-content"><p>Hello, this is a fairly long paragraph, yes it is.<ul><li>a<li>b</ul></div><div class="sidebar">x</div></div>'
    assert html.extract(plain) == "Hello, this is a fairly long paragraph, yes it is.\na\nb"
    df = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (3, "u", "<p>" * 500 + "x", 1)], "page_id long, url string, html string, n_chars long")
    assert {(r.page_id, r.text, r.n_chars) for r in html.main_text(df).collect()} == {(1, "", 0), (2, "", 0), (3, "x", 1)}
    assert html.main_text(df.limit(0)).count() == 0


ARTICLE = "<p>First, a long paragraph, with commas, and more words here, yes.</p><p>Second paragraph, it goes on for a while, and then on.</p>"


@pytest.mark.parametrize("wrap", ['div class="content no-sidebar"', 'div class="main-content has-sidebar"', 'div class="ad-free"', 'div class="post social-share-enabled"', "form id=aspnet", 'div class="sidebar-layout"', 'div class="comments-open"', 'div class="widget"'])
def test_html_marks_that_name_the_page(wrap):
    """Class words of a wrapper of the whole page take nothing away; marked parts inside it still go."""
    inner = '<div class="sidebar"><p>Other stuff, junk of a sidebar.</p></div>' + ARTICLE + '<div class="comments"><p>Nice article, really, I mean it.</p></div>'
    assert html.extract(f"<body><{wrap}>{inner}</{wrap.split()[0]}></body>") == "\n".join(re.findall("<p>(.*?)</p>", ARTICLE))


COMMENT = "<p>Nice article, really, I mean it, and there is more.</p>"
STRUCTURES = {
    "comments outweigh the article": (f"<article><h1>T</h1><p>One sentence of an article.</p></article><section class='comments'>{COMMENT * 20}</section>", "T\nOne sentence of an article."),
    "comments outweigh unmarked prose": (f"<div class=x>{ARTICLE}</div><div id=comments>{COMMENT * 20}</div>", None),
    "comments are articles": (f"<article><p>One sentence of an article.</p></article><div class=comments><article>{COMMENT * 9}</article></div>", "One sentence of an article."),
    "nothing but comments": (f"<div class=comments>{COMMENT * 20}</div>", ""),
    "a sidebar outweighs the article": (f"<div class=sidebar>{COMMENT * 12}</div><div class=post>{ARTICLE}</div>", None),
    "a sidebar outweighs it in a marked wrapper": (f"<div class=sidebar-layout><div class=sidebar>{COMMENT * 12}</div>{ARTICLE}</div>", None),
    "an article in a marked wrapper": (f"<div class=widget><article>{ARTICLE}</article></div><div class=content><p>A copyright that is quite long, as such go.</p></div>", None),
    "a list outweighs the paragraphs": (f"<div id=content><h1>Title</h1>{ARTICLE}<ul>{'<li>An item, with words, and commas, and so on, one.' * 9}</ul></div>", "Title\n{}" + "\nAn item, with words, and commas, and so on, one." * 9),
    "a short second section": (f"<div class=a><h2>One</h2>{ARTICLE}</div><div class=b><h2>Two</h2><p>A short one.</p></div>", "One\n{}\nTwo\nA short one."),
    "equal containers": (f"<div><div class=a>{ARTICLE}</div></div><div><div class=b>{ARTICLE}</div></div>", None),
}


@pytest.mark.parametrize("name", STRUCTURES)
def test_html_marks_go_by_structure_not_size(name):
    page, want = STRUCTURES[name]
    text = "\n".join(re.findall("<p>(.*?)</p>", ARTICLE))
    assert html.extract(f"<body>{page}</body>") == (text if want is None else want.format(text))


def test_html_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, _html string, score double"
    long = "<article>" + ARTICLE * 20_000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", " \n "), (4, "u", long), (None, "u", ARTICLE), (5, "u", "<p>x"), (5, "u", "<p>x")]
    df = spark.createDataFrame([(*r, "mine", 7, "x", 0.5) for r in rows], schema)
    got = collections.Counter((r.page_id, r.n_chars, len(r.text)) for r in html.main_text(df).collect())
    n = len("\n".join(re.findall("<p>(.*?)</p>", ARTICLE)))
    assert got == {(1, 0, 0): 1, (2, 0, 0): 1, (3, 0, 0): 1, (4, 20_000 * (n + 1) - 1, 20_000 * (n + 1) - 1): 1, (None, n, n): 1, (5, 1, 1): 2}


@pytest.mark.parametrize("bad", ['<a href="', "<div class='x>", "<p", "<!-- x ", "< a ", '<b x="y>'])
def test_html_broken_markup_takes_linear_time(bad):
    took = []
    for n in (10_000, 40_000):
        began = time.process_time()
        assert "First" in html.extract(ARTICLE + bad * n)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5  # four times the length


def test_simhash(spark, odd, none):
    def brute(t):
        w = [x.translate(LOW) for x in words(t)]
        g = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [simhash.xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in (None, "", "A b", "A b c d e f a b c", LONG[:3000]):
        assert simhash.fingerprint(t) == brute(t)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == simhash.xxhash.xxh64_intdigest("a b c", 42)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd, scratch(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 7: 7}
    assert simhash.near_duplicates(none, scratch(spark)).count() == 0


@pytest.mark.parametrize("hot", [256, 2])
def test_simhash_links_all_close_pairs(spark, hot):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for x in base for _ in range(6)})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[find(b)] = find(a)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    sc = scratch(spark)
    pairs = simhash.near_pairs(spark.createDataFrame([(sign(f),) for f in fps], "fp long"), sc, hot=hot)
    for r in pairs.collect():
        assert find(r.a % (1 << 64)) == find(r.b % (1 << 64))
    got = {r.node % (1 << 64): r.component for r in connected_components(pairs, sc).collect()}
    groups = collections.defaultdict(set)
    for f in fps:
        groups[find(f)].add(got.get(f, f"alone {f}"))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.12 * rng.standard_normal(16)]) for i in range(300)] + [(300, [0.0] * 16), (301, None), (302, [float("nan")] * 16), (303, [1.0, None] * 8), (304, [])]
    rows += [(400 + i, rows[0][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.near_duplicates(df, scratch(spark), passes=8, window=64, block=128).collect()}
    ok = [(i, np.array(v)) for i, v in rows if v and not any(x is None or x != x for x in v) and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in ok])
    s = x @ x.T >= 0.9
    n = dict(zip([i for i, _ in ok], s.sum(1) - 1, strict=True))
    assert len(got) == len(rows) and all(got[i].n_links <= n.get(i, 0) for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n.values())
    assert all(got[i].kept and got[i].n_links == 0 for i in range(300, 305))
    assert vectors.near_duplicates(df.limit(0), scratch(spark)).count() == 0


def test_bpe_memory_counts_objects():
    """Many short units take many times the bytes of their keys: what is remembered stays within the limit all the same."""
    path, most = registry.tokenizer_path("byte_bpe_50k.json"), 8 << 20
    text = lambda i: " ".join(f"w{j:x}" for j in range(4000 * i, 4000 * i + 4000)).encode()
    c = bpe.ChunkCodec(path, chunk_bytes=1 << 20, unit_bytes=most)
    encoded = lambda x: c.encode(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0]
    encoded(text(0))
    tracemalloc.start()
    try:
        for i in range(1, 40):
            ids = encoded(text(i))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 1.25 * (most + (1 << 20))
    assert ids.tolist() == c.t.encode(text(39).decode(), add_special_tokens=False).ids


def test_bpe(spark, sf, odd, none):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(1)
    letters = ["a", " the", " ", "  ", "\n", "é", "<|endoftext|>", "'s", "1", "!", "　", "日", "à", "\t", "\x85", "、", "word "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(300)] + ["", "x" * 40000, LONG, "a " * 9000]
    old = bpe.CUT_MASK
    for mask in (0x3 << 16, 0x3FF << 16):
        bpe.CUT_MASK = np.uint32(mask)
        c = bpe.ChunkCodec(path, chunk_bytes=200_000, unit_bytes=20_000)
        raw = [s.encode() for s in texts]
        ids, at = c.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        for i, s in enumerate(texts):
            want = t.encode(s, add_special_tokens=False).ids
            assert ids[at[i] : at[i + 1]].tolist() == want and c.decode(ids[at[i] : at[i + 1]]).decode() == t.decode(want, skip_special_tokens=False)
    bpe.CUT_MASK = old
    got = {r.doc_id: r for r in bpe.digests(odd, path).collect()}
    assert got[1].n_tokens == 0 and got[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and got[4].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.digests(none, path).count() == 0


@pytest.mark.parametrize("batch", [1, 2, 3, 1000])
def test_first_and_last_occurrences_over_batches(spark, batch):
    """Every occurrence of a seed against brute force, wherever batches end; a null width of the longer words stays."""
    rng = random.Random(7)
    rows = sorted({(rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]), rng.randrange(6), rng.randrange(9)) for _ in range(60)} | {(100 + i, 1, 1) for i in range(5)})
    want = set()
    for n, d, p in rows:
        alike = [(a, b) for m, a, b in rows if m == n]
        at = alike.index((d, p))
        if len(alike) > 1:
            want.add((n, d, p, *(alike[0] if at else (None, None)), *(alike[at - 1] if at else (None, None))))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = passages.repeated_seeds(spark.createDataFrame(rows, "seed long, doc long, pos int")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_hashes_by_doubling():
    """Equal runs of words have equal hashes, at every place and from chosen places; others do not."""
    rng = np.random.default_rng(3)
    run = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    words = np.concatenate([run, rng.integers(0, 1 << 63, 7).astype(np.uint64), run])
    sums = passages.doubled(words, 50)
    for k in (1, 5, 42, 50):
        h = passages.kmer_hashes(sums, k)
        assert len(h) == len(words) - k + 1 and (h[: 60 - k + 1] == h[67 : 67 + 60 - k + 1]).all() and len(set(h.tolist())) == len(h) - (60 - k + 1)
        assert (passages.kmer_hashes(sums, k, np.array([3, 70])) == h[[3, 70]]).all()
    assert len(passages.kmer_hashes(passages.doubled(words[:3], 50), 5)) == 0


def test_passages(spark, odd, none):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = [word() for _ in range(70)]
    fuzzy = [w if i % 17 else word() for i, w in enumerate(shared)]
    docs = [(i, " ".join([word() for _ in range(200 + i)] + (fuzzy if i == 3 else shared) * (i < 12) + [word() for _ in range(100)])) for i in range(30)]
    got = collections.defaultdict(list)
    for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), scratch(spark)).collect():
        got[r.doc_id].append((r.start_word, r.end_word, r.ref_doc_id))
    assert set(got) == set(range(1, 12)) and all(200 + i <= s[0][0] + 4 and s[0][1] >= 264 + i and s[0][2] == 0 for i, s in got.items())
    assert passages.repeated_passages(none, scratch(spark)).count() == 0
    assert {(r.doc_id, r.ref_doc_id) for r in passages.repeated_passages(odd, scratch(spark)).collect()} == {(4, 4)}
    named = spark.createDataFrame([(f"d{i}", " ".join(f"w{j}" for j in range(80))) for i in range(3)], "doc_id string, text string")
    assert {(r.doc_id, r.ref_doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(named, scratch(spark)).collect()} == {("d1", "d0", 0, 80), ("d2", "d0", 0, 80)}


@pytest.mark.parametrize(("size", "replaced"), [(100, 17), (70, 10)])
def test_passages_that_are_fuzzy(spark, size, replaced):
    rng = random.Random(size)
    make = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    docs = []
    for i in range(60):
        one = make(size)
        two = list(one)
        for j in rng.sample(range(size), replaced):
            two[j] = make(1)[0]
        docs += [(2 * i, " ".join(make(60) + one + make(60))), (2 * i + 1, " ".join(make(60) + two + make(60)))]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), scratch(spark)).collect()
    assert all(r.doc_id == r.ref_doc_id + 1 for r in got) and len({r.doc_id for r in got}) >= 0.9 * 60


@pytest.mark.parametrize("gap", [60, 100, 200])
def test_passages_on_both_sides_of_a_rewritten_middle(spark, gap):
    rng = random.Random(gap)
    make = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    one, two = make(60), make(60)
    docs = [(i, " ".join(make(30) + one + make(gap) + two + make(30))) for i in range(2)]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), scratch(spark)).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.ref_doc_id, r.n_match) for r in got) == [(1, 30, 90, 0, 60), (1, 90 + gap, 150 + gap, 0, 60)]


@pytest.mark.parametrize(("size", "cut"), [(60, 30), (50, 25), (60, 45), (150, 49)])
def test_passages_whose_parts_occur_first_elsewhere(spark, size, cut):
    """Each part of a passage occurs first in another document; of the last two documents, one repeats the other."""
    rng = random.Random(size + cut)
    make = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    both = make(size)
    parts = [both[i : i + cut] for i in range(0, size, cut)]
    docs = [(i, " ".join(make(40) + p + make(40))) for i, p in enumerate([*parts, both, both])]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), scratch(spark)).collect()
    covered = {w for r in got if (r.doc_id, r.ref_doc_id) == (len(parts) + 1, len(parts)) for w in range(r.start_word, r.end_word)}
    assert covered >= set(range(40, 40 + size))


def test_passages_whose_first_and_last_occurrences_are_cut(spark):
    """The first and the last earlier occurrence lack the first word of 50: the whole passage between them is found."""
    rng = random.Random(12)
    make = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    docs = []
    for i in range(20):
        p = make(50)
        docs += [(4 * i + j, " ".join(make(30) + (p[1:] if j in (0, 2) else p) + make(30))) for j in range(4)]
    got = {(r.doc_id, r.start_word, r.end_word, r.ref_doc_id) for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), scratch(spark)).collect()}
    assert got == {(4 * i + 3, 30, 80, 4 * i + 1) for i in range(20)}


def test_matches_between_seeds():
    """As long as by the table of all pairs; two long gaps in little time."""
    rng = random.Random(8)

    def by_table(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    for _ in range(300):
        a, b = ([rng.choice("abcdeF") for _ in range(rng.randrange(80))] for _ in range(2))
        assert passages._matches(a, b) == by_table(a, b)
    a = [str(rng.randrange(500)) for _ in range(6000)]
    b = [w if i % 5 else "other" for i, w in enumerate(a)]
    began = time.process_time()
    assert passages._matches(a, b) == 4800
    assert time.process_time() - began < 0.5


def test_chains_are_best():
    x, y = [0, 10, 20, 30, 40], [5, 100, 25, 35, 45]
    assert passages.chains(x, y, 6.0, 0.05)[0] == [0, 2, 3, 4]


def test_packing_cuts_are_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        pos = sorted(rng.sample(range(1, 60), 12))
        pen = [rng.choice([0.0, 2.0]) for _ in pos[:-1]] + [0.0]
        pos = [p for p in pos]
        size = 16 if max(b - a for a, b in zip([0, *pos], pos, strict=False)) <= 16 else 32
        best = {0: 0.0}
        for p, q in zip(pos, pen, strict=True):
            best[p] = min(best[s] + (0 if p - s == size or (p - s).bit_count() == 1 else size - p + s) for s in best if p - s <= size) + q
        ends = packing.cut(pos, pen, size)
        cost, at = 0.0, 0
        for e in ends:
            cost += (0 if e - at == size or (e - at).bit_count() == 1 else size - e + at) + pen[pos.index(e)]
            at = e
        assert cost == pytest.approx(best[pos[-1]])


def test_packing_memory_counts_objects():
    """What is remembered of many short words stays within its limit of bytes, objects included."""
    from tokenizers import Tokenizer

    path, most = registry.tokenizer_path("word_bpe_49k.json"), 8 << 20
    text = lambda i: " ".join(f"w{j:x}" for j in range(4000 * i, 4000 * i + 4000))
    encoder = packing.WordEncoder(path, most=most)
    encoder.encode(pa.array([text(0)]))
    tracemalloc.start()
    try:
        for i in range(1, 40):
            ids, _ = encoder.encode(pa.array([text(i)]))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 1.25 * most
    assert ids.tolist() == Tokenizer.from_file(path).encode(text(39), add_special_tokens=False).ids


def test_packing(spark, sf, odd, none):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    encoder = packing.WordEncoder(path, most=500)
    odd_texts = ["", " ", "a,. b., 4.0. it's. É́. ², <|endoftext|>. A<|startoftext|>,", "HELLO. <|ENDOFTEXT|>. İ. ΑΣ. 日本,", "a\x1cb. c\x85d, e　.", ".,., '", "ﬁ ª ǅ 가 ı क़."]
    ids, at = encoder.encode(pa.array(odd_texts))
    for i, s in enumerate(odd_texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(s, add_special_tokens=False).ids
    docs = load(spark, sf, "documents").select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id = 4").select(F.lit(-1).cast("long"), "text"))
    rows = packing.pack(docs, path, block=20000).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert set(by) == set(texts)
    for k, v in by.items():
        own, at = np.array(t.encode(texts[k] or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(v, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            at += r.length
        assert at == len(own)
    pad = 0
    for v in seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        pad += 0 if at & (at - 1) == 0 else 4096 - at
    assert pad < 0.03 * sum(r.length for r in rows)
    assert packing.pack(odd, path).where("doc_id = 1").first()["doc_tokens"] == 1 and packing.pack(none, path).count() == 0


def test_pipeline(spark, sf, none, odd):
    import corpus_pipeline as p

    docs = load(spark, sf, "documents")
    for name, stage in p.STAGES:
        for df in (none, odd):
            out = stage(spark, df, sf)
            assert name == "packing" or out.columns == df.columns, name
            assert name == "quality rules" or (out.count() > 0) == (df is odd)
    good = p.quality_rules(spark, docs, sf)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.assess(docs).where("kept").collect()}
    kept = p.simhash_dedup(spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in simhash.near_duplicates(docs, scratch(spark)).collect()}
    # two unlike rows of one id both stay, with their own lines; equal rows are one
    rng = random.Random(2)
    one, two = ("\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(9)) for _ in range(9)) for _ in range(2))
    pair = spark.createDataFrame([(1, one), (1, two), (1, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in p.simhash_dedup(spark, pair, sf).collect()) == sorted([(1, one), (1, two)])
    lined = p.line_dedup(spark, pair, sf).collect()
    assert sorted(r.text for r in lined) == sorted([one, two, two])
    # columns named like those that stages make come out as they went in
    names = ["kept", "lost", "n_words", "clean_text", "_key", "_row", "h", "id", "t", "component_id", "fp", "doc", "__carried_0"]
    clash = docs.select("doc_id", "text", *[F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in names])
    for stage in (p.quality_rules, p.line_dedup, p.simhash_dedup, p.mask_personal_data):
        out = stage(spark, clash, sf)
        assert out.columns == clash.columns
        wrong = out.where(" or ".join(f"`{n}` <> concat('{n} of ', doc_id)" for n in names))
        assert out.count() > 0 and wrong.count() == 0
    masked = p.mask_personal_data(spark, docs, sf)
    assert not any(pii.base_spans(r.text) for r in masked.collect())
    assert p.run(spark, sf).count() > 0


def test_queries_derive_their_columns(spark, sf):
    """What the thin queries add to the operators: counts and digests of base spans, padded fingerprints, their SQL's columns."""
    import duckdb

    texts = {r.doc_id: r.text or "" for r in load(spark, sf, "documents").collect()}
    for r in registry.op1_pii_skip_chain(spark, sf).collect():
        base = pii.base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert set(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base) <= set(r.spans.split(",")) | {""}
    for r in registry.op6_simhash(spark, sf).collect():
        assert r.fingerprint == f"{simhash.fingerprint(texts[r.doc_id]):016x}"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sf)
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        order = lambda t: [(x is not None, x) for x in t]
        assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=order) == sorted(got.fetchall(), key=order)
