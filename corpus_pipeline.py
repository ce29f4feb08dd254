"""The corpus pipeline: quality rules, near-duplicates, repeated strings and packing, stage by stage.

Every stage reads what the one before it has written.  The first three return
the columns of documents; the last returns the packed pieces with their ids.

Defined results, for each stage by itself: only the five columns of documents
are read, others are left out; null texts count as empty, nulls in lang, source
and n_chars pass through, and a null id is an id that comes last; rows that
repeat are rows each, but near-duplicates leave one row of a group; an empty
table gives no rows; texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.packing import pack
from tradewind.llm.quality_rules import quality
from tradewind.llm.simhash import similar_rows
from tradewind.llm.storage import stored
from tradewind.llm.suffix_dedup import repeated_strings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another text and its length."""
    given = docs.withColumn("text", F.col(text))
    return given.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from the others."""
    return _with_text(quality(docs).where("kept"), "clean_text")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the row of the smallest id stays.

    One row of each group, also where rows repeat an id; rows with a null id come last.
    """
    found = similar_rows(docs, shingle=5, similarity=0.8, keep=("lang", "source", "n_chars"))
    return found.where("is_first").select(*COLUMNS)


def repeated_strings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id holds go; documents of which nothing is left go."""
    found = repeated_strings(docs, length=50, keep=("lang", "source"))
    left = F.length(F.trim(F.regexp_replace("clean_text", "\\s+", " "))) > 0
    return _with_text(found.where((F.col("n_removed") == 0) | left), "clean_text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, packed into windows of 2048 tokens."""
    return pack(docs, window=2048, end_id=1, tokenizer="byte_bpe_50k.json")


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicates_stage),
    ("suffix-array dedup", repeated_strings_stage),
    ("packing", packing_stage),
]

#: SQL can't express the fingerprints' links, and packing depends on how rows are dealt to tasks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if i < len(STAGES) - 1:
            rows = stored(rows, name.replace(" ", "-"))
    return rows
