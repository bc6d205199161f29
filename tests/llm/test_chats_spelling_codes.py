"""Chat masks, spelling variants and vector codes against plain versions of themselves."""

import collections
import hashlib
import random
import re
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import chats, codes, registry, spelling
from trellis.llm.common import Scratch, load

TOKENIZER = registry.tokenizer_path("byte_bpe_50k.json")
CHAT = "conv_id long, turn int, role string, text string, part long, whole boolean, formatted string, ids string, mask string, c int, r string, t string, h int"
ODD = [None, "", " ", "</s>", "[INST]", "[/INST] x", "<\\/s>", "[\\\\INST]<", "/s>", "a[", "/INST] b", "<|endoftext|>", "[ROLE]user[TEXT]", "é😀́ \x00 \n\n", "!.", "'s", "\\", "[\\"]


def scratch(spark):
    return Scratch(spark, f"test-{uuid.uuid4().hex}")


def chat_rows(seed=1, n=60):
    rng, rows = random.Random(seed), []
    for c in [None, *range(n)]:
        for t in range(rng.randint(1, 7)):
            text = rng.choice(ODD) if rng.random() < 0.6 else "".join(rng.choice(["ab", "[", "]", "<", "/", "s>", "INST]", "\\", " ", "é"]) for _ in range(12))
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "[TEXT]", None]), text, 1, True, "x", "x", "x", 5, "x", "x", 9))
    return [*rows, (7, None, "assistant", "no number", *rows[0][4:])]


def plain_chats(rows):
    """What must be read back, from the rows alone."""
    by, out = collections.defaultdict(list), {}
    for r in rows:
        by[r[0]].append((-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
    for c, turns in by.items():
        turns.sort(key=lambda x: x[0])
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), digest(loss))
    return out


@pytest.mark.parametrize("part_chars", [1, 40, 1 << 20])
def test_chats_are_read_back(spark, part_chars):
    rows = chat_rows()
    made = scratch(spark).table(chats.format_chats(spark.createDataFrame(rows, CHAT), TOKENIZER, part_chars=part_chars), "chats")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chats.read_back(made, TOKENIZER).collect()}
    assert got == plain_chats(rows)
    # parts put together say what the whole conversation says, text and ids alike
    whole = collections.defaultdict(str)
    ids = collections.defaultdict(list)
    for r in made.orderBy("part").collect():
        whole[r.conv_id] += r.formatted
        ids[r.conv_id] += r.ids
    for c, text in whole.items():
        assert chats.tokenizer(TOKENIZER).encode(text, add_special_tokens=False).ids == ids[c]
    if part_chars == 1:
        assert made.where("whole").groupBy("conv_id").count().where("count > 1").count() == 0


def test_escapes_are_reversible_and_hide_all_marks():
    rng = random.Random(3)
    for t in [*(t for t in ODD if t), *("".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "SYS]", "ROLE]", "TEXT]", "x"]) for _ in range(9)) for _ in range(5000))]:
        e = chats.escape(t)
        assert chats.unescape(e) == t and not any(m in e for m in chats.MARKS)
    assert chats.escape("plain [text] with <b>tags</b> and \\n") == "plain [text] with <b>tags</b> and \\n"


def test_loss_mask_equals_comparing_all():
    rng = np.random.default_rng(5)
    for _ in range(200):
        at = np.sort(rng.choice(60, 12, replace=False))
        spans = at.reshape(-1, 2)
        ends = np.sort(rng.choice(60, 20))
        offsets = np.stack([ends[:-1], ends[1:]], axis=1)
        want = [any(s < b and e > a for s, e in spans) for a, b in offsets]
        assert chats.loss_mask(offsets, spans).tolist() == want
    assert not chats.loss_mask(offsets, np.zeros((0, 2), np.int64)).any() and not len(chats.loss_mask(np.zeros((0, 2), np.int64), spans))


def test_chats_empty_and_long(spark):
    none = chats.format_chats(spark.createDataFrame([], CHAT), TOKENIZER)
    assert chats.read_back(scratch(spark).table(none, "none"), TOKENIZER).count() == 0
    text = "long words and more " * 40_000
    rows = [(1, i, "assistant", text, 1, True, "x", "x", "x", 5, "x", "x", 9) for i in range(3)]
    made = scratch(spark).table(chats.format_chats(spark.createDataFrame(rows, CHAT), TOKENIZER), "long")
    assert made.count() > 1
    got = chats.read_back(made, TOKENIZER).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == plain_chats(rows)[1] and got.formatted_chars == 3 * (len(text) + 4)


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    n = collections.Counter()
    for d, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    forms, out = {}, {}
    for w in n:
        others = [x for x in n if abs(len(x) - len(w)) <= 1 and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(others)
    root = lambda w: w if forms[w] is None else root(forms[w])
    return {(w, forms[w], root(w), n[w], out[w], n[forms[w]] if forms[w] is not None else None) for w in n}


def test_spelling_variants_equal_comparing_all(spark):
    rng, rows = random.Random(4), []
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(40)] + ["aaaaaaa", "aaaaaa", "aaaaa", "abababab", "ÿÿÿÿÿ"]
    for i in range(600):
        words = []
        for _ in range(40):
            w = rng.choice(stems[: rng.randint(1, len(stems))])
            if rng.random() < 0.3:
                k = rng.randrange(len(w) + 1)
                w = w[:k] + rng.choice(["", "a", "b", "Z"]) + w[k + rng.randint(0, 1) :]
            words.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    rows += [(None, "wordless wordless wordless"), (1, None), (2, ""), (3, "..."), rows[0]]
    long = "acgt" * 30_000  # one run of letters
    rows += [(700 + i, long if i % 2 else long[:70_000] + "x" + long[70_000:]) for i in range(9)]
    wide = [(*r, "x", 1, 2, "x", "y", 3, 4, 5) for r in rows]
    df = spark.createDataFrame(wide, "doc_id long, text string, word string, n long, r long, d string, w string, h long, best long, k1 long")
    n = plain_words(rows)
    short = {w: k for w, k in n.items() if len(w) < 1000}
    got = [tuple(r) for r in spelling.spelling_variants(df, scratch(spark)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) == len(n)
    assert {r for r in got if len(r[0]) < 1000} == plain_variants(short)
    assert {(len(r[0]), r[4]) for r in got if len(r[0]) >= 1000} == {(120_000, 1), (120_001, 1)}
    assert max(r[4] for r in got) > 5 and any(r[2] not in (r[0], r[1]) for r in got)
    assert spelling.spelling_variants(df.limit(0), scratch(spark)).count() == 0


def test_rotations_are_those_of_the_words():
    words = ["abcde", "aab", "", "zzz", "ÿ"]
    k1, k2, word, kind = spelling.rotations(words)
    by = collections.defaultdict(set)
    rows = iter(zip(k1.tolist(), k2.tolist(), word.tolist(), kind.tolist(), strict=True))
    for w, t in enumerate(words):
        for i in range(len(t) + 1):
            *key, at, what = next(rows)
            assert (at, what) == (w, 0)
            by[tuple(key)].add(t[i:] + "$" + t[:i])
    for w, t in enumerate(words):
        for i in range(len(t)):
            *key, at, what = next(rows)
            assert (at, what) == (w, 2 if i and t[i] == t[i - 1] else 1)
            by[tuple(key)].add(t[i + 1 :] + "$" + t[:i])
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def test_spelling_links_are_followed_to_their_end(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 23)] + [(100, 5)], "r long, to long")
    assert {r.r: r.to for r in spelling._roots(chain, scratch(spark)).collect()} == {**{i: 0 for i in range(1, 23)}, 100: 0}


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [int(np.floor(4096 * x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return set()
    width = max(collections.Counter(len(q) for _, q, _ in kept).items(), key=lambda x: (x[1], x[0]))[0]
    kept = sorted((k for k in kept if len(k[1]) == width), key=lambda k: (k[0] is None, k[0] or 0))
    edges = [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]
    books = [[q[a:b] for _, q, _ in kept[:entries]] for a, b in edges]
    dist = lambda x, e: sum((u - v) ** 2 for u, v in zip(x, e, strict=True))
    pick = lambda p, q: min((dist(q[edges[p][0] : edges[p][1]], e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[pick(p, q)[1] for p in range(parts)] for _, q, _ in kept]
        for p, (a, b) in enumerate(edges):
            for k in range(len(books[p])):
                mine = [q[a:b] for (_, q, _), x in zip(kept, at, strict=True) if x[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    done = [(i, "".join(f"{pick(p, q)[1]:02x}" for p in range(parts)), sum(pick(p, q)[0] for p in range(parts)), lab) for i, q, lab in kept]
    total = collections.Counter()
    for _, _, e, lab in done:
        total[lab] += e
    return collections.Counter((i, c, e, total[lab], sha) for i, c, e, lab in done)


VECTORS = "vec_id long, embedding array<float>, label int, row long, pos int, x int, entry int, salt int, code string, q int"


@pytest.mark.parametrize("width", [16, 11, 3])
def test_codes_equal_plain_rounds(spark, width, monkeypatch):
    monkeypatch.setattr(codes, "OWNED", 50)  # several owners an entry
    rng = np.random.default_rng(width)
    rows = [(i, rng.normal(size=width).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(5, 160)]
    rows += [(i, rows[0][1], None) for i in range(200, 330)]  # a vector that is very common
    rows += [(1, None, 1), (2, [None] * width, 1), (3, [float("nan")] * width, 1), (4, [float("inf")] + [0.0] * (width - 1), 2), (0, [1.0] * (width + 1), 2)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "x", 6) for r in rows], VECTORS)
    got = collections.Counter(tuple(r) for r in codes.compressed(df, scratch(spark)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == plain_codes(rows)


def test_codes_of_few_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert codes.compressed(none, scratch(spark)).count() == 0
    assert codes.compressed(spark.createDataFrame([(1, None, 1, 1, 2, 3, 4, 5, "x", 6)], VECTORS), scratch(spark)).count() == 0
    rows = [(i, [0.1 * i] * 8, 1) for i in (3, 1, 1)] + [(None, [5.0] * 8, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "x", 6) for r in rows], VECTORS)
    got = [tuple(r) for r in codes.compressed(df, scratch(spark)).select("vec_id", "code", "error", "label_error").collect()]
    # of equal entries the lower index is taken
    assert sorted(got, key=str) == sorted([(1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0), (3, "02" * 8, 0, 0), (None, "03" * 8, 0, 0)], key=str)
    assert codes.compressed(spark.createDataFrame([(1, [], 1, 1, 2, 3, 4, 5, "x", 6)], VECTORS), scratch(spark)).first().code == "00" * 8


def test_owners_add_up_without_a_shuffle_and_only_movers_go(spark, sf):
    s = scratch(spark)
    kept, width = codes.quantized(load(spark, sf, "embeddings"), s, 4096, "vec_id", "embedding", "label")
    owned = codes.Residents(s, 2, 8)
    parts = kept.select("row", F.posexplode(F.array(*[F.slice("q", a + 1, b - a) for a, b in codes.cut(width, 8)])).alias("pos", "x"))
    owned.next(None, parts.select("row", "pos", "x", (F.col("row") % 16).cast("int").alias("entry"), (F.col("row") % 2).cast("int").alias("salt"), F.lit(True).alias("moved")))
    plan = owned.sums(8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "salt" not in plan.split("Exchange hashpartitioning")[1].split("\n")[0]
    before = {(r.row, r.pos): r.x for r in owned.table().collect()}
    assert len(before) == kept.count() * 8
    table = owned.table().withColumn("moved", F.col("row") % 7 == 0)
    owned.next(table.where("not moved"), table.where("moved").withColumn("entry", (F.col("entry") + 1) % 16))
    assert {(r.row, r.pos): r.x for r in owned.table().collect()} == before
    assert sum(r.n for r in owned.sums(8).collect()) == len(before)
    owned.close()
