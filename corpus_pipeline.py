"""The corpus pipeline: quality rules, near duplicates, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; its result is written as Parquet and reread as the next one's docs. All
but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm import fertility, mixing, ngram_jaccard, packing
from postbag.llm.common import ROW, keep, with_row_keys
from postbag.llm.queries import PIECES, WORDS, table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep; the rest go."""
    judged = fertility.quality(docs, vocabulary(PIECES), vocabulary(WORDS), keep_columns=COLUMNS, with_text=True)
    return judged.filter("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (five words, similarity 0.8): the one with the
    smallest doc_id, a row without one only if none has; of rows with the same doc_id in a class, one.
    Links are between rows, so doc_ids may be null or repeated."""
    rows = with_row_keys(docs, "near-duplicate-rows")
    classes = ngram_jaccard.jaccard_classes(rows.select(F.col(ROW).alias("doc_id"), "text"), k=5, percent=80, count_links=False)
    ids = rows.select(F.col(ROW).alias("_r"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(ROW)).alias("_order"))
    first = classes.join(ids, F.col("doc_id") == F.col("_r")).select("component_id", "_order", "_r")
    first = first.groupBy("component_id").agg(F.min_by("_r", "_order").alias(ROW))
    return rows.join(first, ROW, "left_semi").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the shards of the mix draw them, each shard's draws in its own random order:
    a row a draw, so a document can come up to three times, or not at all if its source's quota ends
    before it; one across the end of a shard's range is cut there, and one at which a quota ends has only its first words."""
    rows = with_row_keys(docs, "mixing-rows")
    _, draws = mixing.mix_sources(rows)
    joined = mixing.shuffle_locally(rows.join(draws.drop("doc_id", "source"), ROW))
    whole = F.col("words") == mixing.word_count(F.col("text"))
    # each piece is a word with the white space before it
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, (F.col("first_word") + 1).cast("int"), F.col("words").cast("int")), "")
    return joined.withColumns({"text": F.when(whole, F.col("text")).otherwise(cut), "n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length(cut))}).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the drawn documents in sequences of at most 2048 tokens."""
    return packing.best_fit_packing(docs, vocabulary(WORDS), end_id=0, capacity=2048)


STAGES = [("quality rules", quality_stage), ("near duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenisers decide what is kept and how long pieces are, which SQL can't say. Tests hold run() against a brute force of all four stages.
ORACLE_SQL = None
