"""Line-first quality rules, in DataFrame expressions only.

Every line is judged by itself (punctuation, navigation, boilerplate); failing lines go, and a
document goes when it loses too much text that way, or fails the whole-document base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import SPACE, SPACE_CHARS, let, words_of

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Phrases of boilerplate lines.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "javascript is disabled", "enable javascript", "subscribe to our newsletter", "click here", "sign up now", "log in to", "powered by", "lorem ipsum", "share this", "read more")
#: A phrase makes a line boilerplate where the line is at most this many times as long.
PHRASE_SHARE = 20


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside ``width``-word windows that occur twice or more, each word once.

    Windows are compared by 64-bit hashes within one document. Few passes over the arrays: each
    lambda call is interpreted, so passes are what this costs.
    """

    def spans(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
            at = F.transform(F.filter(s, same), lambda x: x["i"])
            further = lambda a, k: F.transform(a, lambda i: i + k)
            return let(at, lambda a: F.size(F.array_distinct(F.concat(a, *[further(a, k) for k in range(1, width)]))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, repeats))

    def windows(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.size(w) - (width - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))
        return F.when(F.size(w) < width + 1, F.lit(0)).otherwise(let(hashes, spans))

    return let(words, windows)


def line_fails(line: Column, min_prose_words: int = 12) -> Column:
    """A line fails as navigation, symbol junk, shouting, boilerplate, or long text without any sentence mark.

    A phrase counts by its share of the line, at least one in ``PHRASE_SHARE`` characters. Cheap
    tests come first and the costly ones run only behind them; ``let`` keeps a lower-cased line
    from being computed once per phrase. No pattern can match a run of characters in two ways, so
    each takes time in proportion to the line.
    """
    at_least = lambda n: line.rlike(rf"^[{SPACE}]*(?:[^{SPACE}]+[{SPACE}]+){{{n - 1}}}[^{SPACE}]")

    def marks(bare: Column) -> Column:
        n = F.char_length(bare)
        symbols = n - F.char_length(F.translate(bare, SYMBOLS, ""))
        separators = n - F.char_length(F.translate(bare, "|»›·•", ""))
        return (symbols * 10 > n) | (separators * 4 > F.size(words_of(line)))

    def phrases(low: Column) -> Column:
        found = F.lit(False)
        for phrase in BOILERPLATE:
            found = found | ((length <= PHRASE_SHARE * len(phrase)) & low.contains(phrase))
        return found

    marked = line.rlike(r"[#*$%&|<>»›·•]") & let(F.translate(line, SPACE_CHARS, ""), marks)
    shout = (F.upper(line) == line) & at_least(5) & line.rlike(r"\p{Lu}")
    length = F.char_length(line)
    may_hold = length <= PHRASE_SHARE * max(map(len, BOILERPLATE))
    unpunctuated = ~line.rlike(r"[.!?…。！？]") & at_least(min_prose_words)
    return marked | F.when(may_hold, let(F.lower(line), phrases)).otherwise(F.lit(False)) | shout | unpunctuated


def assess(docs: DataFrame, max_lost: float = 0.5, text: str = "text") -> DataFrame:
    """Add the counts, ``base_failed``, ``clean_text``, ``lost`` (share of characters removed) and ``kept``.

    Null text counts as empty: no words, so it fails. Time is in proportion to the text, however
    long its lines, but for the sort of the windows of a text that repeats some. Columns of the input with these names are
    replaced. Repeated rows are judged alike; an empty table stays empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda x: x.rlike(rf"[^{SPACE}]")

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def by_line(a: Column) -> Column:
        with_words = let(F.filter(a, has_word), lambda b: F.size(b) - F.size(F.array_distinct(b)))
        return F.struct(with_words.cast("long").alias("n_dup_lines"), F.array_join(F.filter(a, lambda x: ~line_fails(x)), "\n").alias("clean_text"))

    symbols = F.when(t.rlike(r"[#*$%&|<>]"), F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).otherwise(F.lit(0))
    out = docs.withColumns({"n_symbols": symbols.cast("long"), "_words": let(words_of(F.col(text)), counts), "_lines": let(F.split(t, "\n", -1), by_line)})
    out = out.withColumns({c: F.col(f"_words.{c}") for c in ("n_words", "word_chars", "n_repeat_words")} | {c: F.col(f"_lines.{c}") for c in ("n_dup_lines", "clean_text")}).drop("_words", "_lines")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    out = out.withColumn("lost", F.when(F.char_length(t) > 0, 1 - F.char_length("clean_text") / F.char_length(t)).otherwise(F.lit(0.0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))
