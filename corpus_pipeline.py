"""The corpus pipeline: quality rules, line deduplication, near-duplicates, personal data, packing.

Each stage works on all that its predecessor kept, as (spark, docs, sf_dir) -> DataFrame; its
result is written as Parquet in the shared folder and read again for the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import lines, packing, pii, quality, simhash
from trellis.llm.common import Scratch, load
from trellis.llm.registry import tokenizer_path


def _measured(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` again, with n_chars after what a stage did to the text."""
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.char_length("text").cast(df.schema["n_chars"].dataType))
    return df.select(*[F.col(f"`{c}`") for c in columns])


def _apart(stage: Callable) -> Callable:
    """A stage that sees doc_id, text and n_chars by their names and all other columns by names of their own,
    which none of its columns has; they get their names back after it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {c: f"__carried_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in docs.columns]), sf_dir)
        return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])

    return run


def _key() -> Column:
    """What tells rows apart, also those of one id; ordered by id."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))


@_apart
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that the rules reject go. Null, empty and blank texts have no words
    and are rejected; repeated rows are judged alike."""
    good = quality.assess(docs).where("kept").withColumn("text", F.col("clean_text"))
    return _measured(good, docs.columns)


@_apart
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and near lines the first stays; all documents stay, also those that lose all their
    lines. Null and blank texts have no lines. Rows of one id are told apart by their texts; rows
    alike in both keep the same lines."""
    keyed = docs.withColumn("_key", _key())
    removed = lines.near_duplicate_lines(keyed.select("_key", "text"), Scratch(spark, "pipeline-lines"), id_col="_key")
    return _measured(lines.without_lines(keyed, removed, id_col="_key"), docs.columns)


@_apart
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the smallest id, and of rows of that id the one of the
    smallest text hash. Rows of one id with unlike texts are told apart and both stay. Null, empty
    and blank texts are one group; rows without an id are compared like any others."""
    keyed = docs.withColumn("_key", _key())
    found = simhash.near_duplicates(keyed.select("_key", "text"), Scratch(spark, "pipeline-simhash"), id_col="_key")
    keep = found.where("_key = component_id").select("_key").distinct()
    # repeated rows have one key: the least of them stays
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return keyed.join(keep, "_key", "left_semi").groupBy("_key").agg(F.min(row).alias("_row")).select("_row.*")


@_apart
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in brackets. All rows stay, null texts as nulls."""
    return _measured(pii.masked(docs, pii.fit(docs)), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens. Null and empty texts are an end token.
    Its workers share the executor with what the stages before it left there, so they remember less."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), memory=64 << 20)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses neither MinHash candidates nor the tokenizer; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = load(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage{i}")
            if i:
                scratch.drop(f"stage{i - 1}")
    return docs
