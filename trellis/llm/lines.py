"""Fuzzy line deduplication by MinHash, in DataFrame expressions only.

Equal lines are folded first. A line's signature is taken over the character shingles that begin at
word starts (so an inserted word shifts none of the others); lines that agree on a band of it are
candidates, whose exact Jaccard similarity over the shingles at all positions decides. In a small
bucket all lines are compared. The lines of large buckets, whatever their number, are joined by an
exact prefix filter instead, and those of its large groups that are not connected yet all with all,
by an exact bound from sketches of their shingles. Links go through distributed union-find and the first line of each
component stays.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import SPACE, SPACE_CHARS, Scratch, bit_table, join_spread, let, marked
from trellis.llm.components import connected_components

#: Odd factors: h * factor mod 2^32 orders the 32-bit hashes of shingles anew for each factor.
_FACTORS = [random.Random(f"factor {j}").getrandbits(31) | 1 for j in range(256)]
#: Shingles are counted in so many cells, which bounds the table of their frequencies.
_CELLS = 1 << 16
#: Keys of buckets are marked in 2 to the power of so many bits, a table of at most 2^17 rows.
_KEY_BITS = 23
#: A sketch has so many words of 64 bits.
_WORDS = 16
_BITS = [f"x{j}" for j in range(_WORDS)]


def split_lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, pos, norm, id, check) of all lines that are not blank. ``norm`` is the trimmed line in
    lower case, runs of white space as one space; ``id`` and ``check`` are two hashes of it: equal lines
    are told by both, and links go by the first."""
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc", "pos", F.btrim("line", F.lit(SPACE_CHARS)).alias("line")).where("line <> ''")
    uneven = F.lit(False)
    for x in ("  ", *SPACE_CHARS[1:]):
        uneven = uneven | F.col("line").contains(x)
    lines = lines.select("doc", "pos", F.lower(F.when(uneven, F.regexp_replace("line", f"[{SPACE}]+", " ")).otherwise(F.col("line"))).alias("norm"))
    return lines.select("doc", "pos", "norm", F.xxhash64("norm").alias("id"), F.xxhash64(F.lit("second"), "norm").alias("check"))


def shingles(line: Column, width: int) -> Column:
    """64-bit hashes of the ``width`` characters from every position, in no order; a shorter line is its
    own shingle. Cut as rows of tiles, one row for each of the first ``width`` positions, which takes
    less time than a search at every place."""
    row = lambda k: F.regexp_extract_all(F.substr(line, F.lit(k)), F.lit(f"(?s).{{{width}}}"), 0)
    tiles = F.concat(*[row(k) for k in range(1, width + 1)])
    return F.transform(F.when(F.char_length(line) < width, F.array(line)).otherwise(tiles), lambda s: F.xxhash64(s))


def word_shingles(line: Column, width: int) -> Column:
    """Those that begin at a word, as strings; those from every position in lines without many spaces. A
    match takes the whole word, so the search goes on at the next one and tries no place in between."""
    found = lambda step: F.regexp_extract_all(line, F.lit(rf"(?s)(?=([^ ].{{{width - 1}}})){step}"), 1)
    n = F.char_length(line)
    few_spaces = n > 12 * (n - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
    return F.when(n < width, F.array(line)).when(few_spaces, found(".")).otherwise(found("[^ ]+ ?"))


def crowd_pairs(texts: DataFrame, scratch: Scratch, similarity: float, width: int, most: int = 16) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(a, b) candidates among (id, norm): all pairs that can be as alike as that are among them, or have
    a common token in ``hot``. Four tables: pairs with a common partner; other pairs; ``hot``; (id, hs)
    of all lines, the hashes of their shingles.

    The shingles of a line are ordered from rare to common. Two lines that are alike share one among
    the first few of each (the prefix filter; fewer of the shorter line than of the longer one). Where
    at most ``most`` lines have a shingle among the first few of a shorter line, each line there meets
    all of these. A shingle that stays common so far up belongs to lines which differ in little
    else: each meets the line of fewest rarer shingles, which connects most of them, and
    ``crossing_pairs`` compares all that this leaves apart.
    """
    cell = lambda h: F.pmod(h, F.lit(_CELLS)).cast("int")
    hashes = texts.select("id", F.array_distinct(shingles(F.col("norm"), width)).alias("hs"))
    hashes = scratch.table(hashes, "hashes")
    # a table of a fixed number of cells: about how often the shingles in each occur, in powers of two
    seen = hashes.select(F.explode("hs").alias("h")).groupBy(cell(F.col("h")).alias("cell")).agg(F.count("*").alias("n"))
    every = texts.sparkSession.range(_CELLS).select(F.col("id").cast("int").alias("cell")).join(seen, "cell", "left")
    often = every.select(F.lit(1).alias("one"), F.struct("cell", F.log2(F.coalesce("n", F.lit(0)) + 1).cast("long").alias("c")).alias("x"))
    often = often.groupBy("one").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]).alias("often"))
    ranked = hashes.withColumn("one", F.lit(1)).join(F.broadcast(often), "one")
    rank = lambda h: F.shiftleft(F.get("often", cell(h)), 57).bitwiseOR(F.shiftrightunsigned(h, 7))
    sized = ranked.select("id", F.size("hs").alias("n"), F.array_sort(F.transform("hs", rank)).alias("r"))
    n = F.col("n")
    first = n - F.ceil(n * similarity - 1e-9).cast("int") + 1
    short = n - F.ceil(n * (2 * similarity / (1 + similarity)) - 1e-9).cast("int") + 1
    rows = sized.select("id", "n", short.alias("short"), F.posexplode(F.slice("r", 1, first)).alias("at", "token"))
    rows = scratch.table(rows.select("id", "n", "at", (F.col("at") < F.col("short")).alias("front"), "token"), "prefixes")

    # tokens that occur in front of some line and in another
    groups = rows.groupBy("token").agg(F.count("*").alias("k"), F.count_if("front").alias("fronts"), F.min(F.struct("at", "n", "id")).alias("p")).where("k > 1 and fronts > 0")
    groups = scratch.table(groups.select("token", "k", (F.col("fronts") > most).alias("hot"), F.when(F.col("fronts") > most, F.col("p.id")).alias("p")), "groups")
    full = scratch.table(join_spread(rows, groups, ["token"], "k"), "met")
    scratch.drop("groups", "prefixes")
    cold, hot = full.where("not hot"), full.where("hot")
    y = cold.where("front").select("token", F.col("id").alias("b"), F.col("n").alias("nb"))
    within = cold.join(y, "token").where(_shorter(F.col("nb"), F.col("b"), F.col("n"), F.col("id"), similarity)).select(F.col("id").alias("a"), "b")
    return hot.where("id <> p").select(F.col("id").alias("a"), F.col("p").alias("b")), within, hot.select("token", "id", "n", "front"), hashes


def _shorter(nb: Column, b: Column, na: Column, a: Column, similarity: float) -> Column:
    """Whether line b comes before a by its number of shingles, but not by so many that they are unlike."""
    return ((nb < na) | ((nb == na) & (b < a))) & (nb >= na * similarity - 1e-9)


def sketches(hashes: DataFrame) -> DataFrame:
    """(id, n, x0, x1, ...) of rows (id, hs): the number of hashes, and a bit for each of 1,024 classes of them:
    whether there is an odd number of those."""
    h = F.col("h")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 4).bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.select("id", F.explode("hs").alias("h")).select("id", (h.bitwiseAND(F.lit(_WORDS - 1))).alias("word"), bit.alias("bit"))
    odd = [F.bit_xor(F.when(F.col("word") == j, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"x{j}") for j in range(_WORDS)]
    return rows.groupBy("id").agg(F.count("*").cast("int").alias("n"), *odd)


def _can_be_alike(similarity: float) -> Column:
    """Of two sketches with names in a and b. Where the bits differ, the sets do, so the number of such bits
    bounds the similarity from above: no pair that is as alike as that is lost."""
    na, nb = F.col("n_a"), F.col("n_b")
    differ = sum((F.bit_count(F.col(f"x{j}_a").bitwiseXOR(F.col(f"x{j}_b"))) for j in range(1, _WORDS)), F.bit_count(F.col("x0_a").bitwiseXOR(F.col("x0_b"))))
    return (F.least(na, nb) >= F.greatest(na, nb) * similarity - 1e-9) & (differ <= (na + nb) * ((1 - similarity) / (1 + similarity)) + 1e-9)


def crossing_pairs(hot: DataFrame, hashes: DataFrame, parts: DataFrame, scratch: Scratch, similarity: float, block: int = 512) -> DataFrame:
    """(a, b) candidates among rows (token, id, n, front): of the lines with a common token all pairs that
    lie in different components of ``parts`` (node, component) and can be as alike as that.

    A pair meets at each token that both have, and is told by its sketches to be worth a closer look. It is
    given at the least of these tokens alone, which the tokens before it tell. A group of any size
    is dealt over tasks by pairs of blocks; one that is connected already is left out as a whole.
    """
    placed = hot.join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
    placed = scratch.table(placed.select("token", "id", "n", "front", F.coalesce("component", "id").alias("c")), "crowd")
    groups = placed.groupBy("token").agg(F.count("*").alias("k"), F.count_if("front").alias("fronts"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi and fronts > 0")
    groups = scratch.table(groups.select("token", "k", F.ceil(F.col("k") / block).alias("blocks")), "crowd-groups")
    apart = scratch.table(join_spread(placed, groups, ["token"], "k"), "apart")
    # a line's tokens are no more than its shingles
    lists = apart.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "front", "blocks"))).alias("own"), F.first("c").alias("c"))
    rows = lists.join(sketches(hashes.join(apart.select("id").distinct(), "id", "left_semi")), "id")
    earlier = F.transform(F.slice("own", F.lit(1), F.col("at")), lambda x: x["token"]).alias("before")
    rows = rows.select("*", F.posexplode("own").alias("at", "x")).select("x.*", "id", "n", "c", earlier, *_BITS)
    rows = scratch.table(rows, "crowd-bits")
    own, every = F.pmod(F.xxhash64("id"), "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    side = lambda rows, x: rows.select("token", "i", "j", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "c", "before", *_BITS)])
    a = side(rows.withColumn("i", own).withColumn("j", every), "a")
    b = side(rows.where("front").withColumn("j", own).withColumn("i", every), "b")
    near = (F.col("c_a") != F.col("c_b")) & _shorter(F.col("n_b"), F.col("id_b"), F.col("n_a"), F.col("id_a"), similarity) & _can_be_alike(similarity)
    near = near & ~F.arrays_overlap("before_a", "before_b")
    pairs = scratch.table(a.join(b, ["token", "i", "j"]).where(near).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "crossing")
    scratch.drop("crowd", "crowd-groups", "apart", "crowd-bits")
    return pairs


def _both_ends(pairs: DataFrame, table: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b, ...) with the other columns of ``table`` (id, ...) for each end, named for it."""
    for end in ("a", "b"):
        met = pairs.groupBy(end).agg(F.count("*").alias("k"))
        side = scratch.table(table.select(*[F.col(c).alias(end if c == "id" else f"{c}_{end}") for c in table.columns]).join(met, end), f"side-{end}-{name}")
        pairs = join_spread(pairs, side, [end], "k")
        if end == "a":
            pairs = scratch.table(pairs, f"half-{name}")
    return pairs


def alike(pairs: DataFrame, texts: DataFrame, bits: DataFrame, scratch: Scratch, name: str, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity over all shingles is high enough. ``texts``: (id,
    norm); ``bits``: their ``sketches``, by which most of the pairs that are unlike go before texts are compared."""
    close = _both_ends(pairs, bits, scratch, f"{name}-bits").where(_can_be_alike(similarity)).select("a", "b", "n_a", "n_b")
    close = scratch.table(close, f"close-{name}")
    na, nb = F.col("n_a"), F.col("n_b")
    both = F.size(F.array_intersect(shingles(F.col("norm_a"), width), shingles(F.col("norm_b"), width)))
    told = _both_ends(close, texts.select("id", "norm"), scratch, name)
    links = scratch.table(told.where(both >= (na + nb) * (similarity / (1 + similarity)) - 1e-9).select("a", "b"), f"links-{name}")
    scratch.drop(*[f"{x}-{name}{y}" for x in ("side-a", "side-b", "half") for y in ("", "-bits")], f"close-{name}")
    return links


def near_duplicate_lines(docs: DataFrame, scratch: Scratch, similarity: float = 0.8, width: int = 8, bands: int = 6, rows: int = 4, small: int = 16, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, kept_doc, kept_pos) of every line to remove and the line that stands for it.

    Of equal or linked lines the one of the smallest document id and position stays; blank lines are
    none. Equal lines are always found, however short. Lines alike in at least ``similarity`` of their
    ``width``-character shingles are found with the recall of ``bands`` bands of ``rows`` minima; within
    a bucket all pairs are compared where it has ``small`` lines or fewer, and the lines of larger
    ones through ``crowd_pairs`` and ``crossing_pairs``, so none is given up.
    Null and blank texts have no lines; rows that repeat an id are one document, equal places of it one
    line; long texts are lines like any others; an empty table gives an empty result; other columns
    are ignored.
    """
    lines = scratch.table(split_lines(docs, id_col, text), "lines")
    kind = lines.schema["doc"].dataType.simpleString()
    signed = lines.select("id", F.explode(word_shingles(F.col("norm"), width)).alias("s")).select("id", F.shiftrightunsigned(F.xxhash64("s"), 32).alias("h"))
    mins = [F.min((F.col("h") * F.lit(_FACTORS[j])).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"m{j}") for j in range(bands * rows)]
    signatures = signed.groupBy("id").agg(*mins)
    keys = [F.xxhash64(F.lit(b), *[f"m{b * rows + k}" for k in range(rows)]) for b in range(bands)]
    banded = scratch.table(signatures.select("id", F.explode(F.array(*keys)).alias("key")), "banded")
    drawn = F.struct(F.xxhash64("key", "id").alias("h"), "id")  # another line for each bucket, also where buckets hold the same lines
    buckets = scratch.table(banded.groupBy("key").agg(F.count("*").alias("n"), F.min(drawn)["id"].alias("centre")).where("n > 1"), "buckets")
    many = F.col("n") > small
    shared = marked(banded, F.col("key"), bit_table(buckets.select("key"), _KEY_BITS), "left_semi", _KEY_BITS)
    placed = scratch.table(join_spread(shared, buckets.withColumn("many", many), ["key"], "n"), "placed")
    scratch.drop("banded", "buckets")
    # texts of candidates only, once for each distinct line
    members = scratch.table(placed.groupBy("id").agg(F.max("many").alias("many")), "members")
    bits = bit_table(members.select("id"))
    held = marked(lines.select("id", "norm"), F.col("id"), bits, "left_semi").groupBy("id").agg(F.first("norm").alias("norm"))
    texts = scratch.table(held.join(members, "id"), "texts")
    bits = scratch.table(sketches(texts.select("id", F.array_distinct(shingles(F.col("norm"), width)).alias("hs"))), "sketches")

    few = placed.where("not many")
    stars, rest, hot, hashes = crowd_pairs(texts.where("many").select("id", "norm"), scratch, similarity, width)
    ordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # first the pairs with one partner in common; then, of all pairs, those that these have not connected
    stars = ordered(placed.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).union(stars))
    links = alike(scratch.table(stars, "stars"), texts, bits, scratch, "stars", similarity, width)
    parts = scratch.table(connected_components(links, scratch, "cc-stars"), "parts")
    few = few.select("key", "id")
    pairs = few.withColumnRenamed("id", "a").join(few.withColumnRenamed("id", "b"), "key").where("a < b").select("a", "b")
    pairs = ordered(pairs.union(rest).union(crossing_pairs(hot, hashes, parts, scratch, similarity)))
    for end in ("a", "b"):
        pairs = pairs.join(parts.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")), end, "left")
    pairs = pairs.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    links = links.union(alike(scratch.table(pairs, "pairs"), texts, bits, scratch, "pairs", similarity, width))
    scratch.drop("placed", "members", "met", "hashes", "crossing", "stars", "parts", "texts", "sketches", "pairs")

    parts = connected_components(links, scratch).select(F.col("node").alias("id"), F.col("component").alias("root"))
    places = lines.select("id", "check", "doc", "pos")
    counts = places.groupBy("id", "check").agg(F.count("*").alias("n"))
    alone = F.when(F.col("root").isNull(), F.col("check"))  # equal lines only
    roots = counts.join(parts, "id", "left").where("n > 1 or root is not null").select("id", "check", "n", F.coalesce("root", "id").alias("root"), F.coalesce(alone, F.lit(0)).alias("alone"))
    likely = marked(places, F.col("id"), bit_table(roots.select("id")), "left_semi")
    grouped = scratch.table(join_spread(likely, scratch.table(roots, "roots"), ["id", "check"], "n").select("root", "alone", "doc", "pos"), "grouped")
    scratch.drop("lines", "links-stars", "links-pairs", "roots")
    first = scratch.table(grouped.groupBy("root", "alone").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("kept")), "first")
    removed = join_spread(grouped, first, ["root", "alone"], "n").where("not (doc <=> kept.doc and pos = kept.pos)")
    return removed.select(F.col("doc").cast(kind).alias("doc"), "pos", F.col("kept.doc").alias("kept_doc"), F.col("kept.pos").alias("kept_pos"))


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the removed lines cut out of their text; all rows and columns stay."""
    cut = removed.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("pos").alias("_cut"))  # no more than a document has lines

    def kept(t: Column, c: Column) -> Column:
        places = lambda a: F.array_except(F.sequence(F.lit(0), F.size(a) - 1), c)
        return let(F.split(t, "\n", -1), lambda a: F.array_join(F.transform(places(a), lambda i: F.get(a, i)), "\n"))

    out = docs.join(cut, docs[id_col] == cut["_doc"], "left")
    return out.withColumn(text, F.when(F.col("_cut").isNull(), F.col(text)).otherwise(kept(F.col(text), F.col("_cut")))).select(*[F.col(f"`{c}`") for c in docs.columns])
