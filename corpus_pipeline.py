"""A corpus pipeline of five stages over `documents`.

Quality, near copies, repeated passages, benchmark leaks, tokens. Each stage works on all that the one
before kept; run() writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaica.llm import bpe, decontaminate, quality, simhash, substring
from mosaica.llm.common import col, free, stored, table
from mosaica.llm.queries import TOKENIZER


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; those without words (null, empty, blank) go, repeated rows stay or go together, and of no documents none stay."""
    return quality.good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash group; of repeated rows (equal ids and texts) one stays.

    Null and empty texts are alike and so one group; a null doc_id stays only where its group has no other, and no documents give none.
    """
    kept = simhash.simhash_groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(free(docs, "_id"))).distinct()
    own, digest, nth = free(docs, "_id"), free(docs, "_hash"), free(docs, "_nth")
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi").withColumn(digest, F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("doc_id", digest).orderBy("doc_id"))
    return rows.withColumn(nth, place).where(F.col(nth) == 1).select(*map(col, docs.columns))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that an other document keeps; those that were nothing else go.

    n_chars follows the text. Documents without words, and rows with a null doc_id, stay as they are; repeated rows are cut alike; no documents give none.
    """
    cut = substring.remove_passages(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay, repeated rows stay or go together, and without items or documents nothing goes."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact): the tokens of each text, and whether they decode to it. A null text counts as empty; every row, repeated ones too, has its row."""
    path, pattern = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN
    rows = bpe.tokenized(docs.select("doc_id", "text"), path, pattern)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("near_copies", one_of_each),
    ("passages", without_passages),
    ("leaks", without_leaks),
    ("tokens", tokens),
]

#: No SQL: trained models, linked components and a tokenizer. The tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
