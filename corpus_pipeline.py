"""The corpus pipeline: documents through language ID, exact, near and substring deduplication, then packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.llm import exact_dedup, language_id, packing, simhash, substring_dedup
from metaweave.llm.common import Table

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without any letter go, null and empty texts with them.

    Where no language could be learned (no labels, or none that aren't held out), every document with a letter stays. Repeated rows and ids, and null ids, stay as they are.
    """
    d = language_id.language_id(docs, columns=COLUMNS[1:])
    return d.filter((F.col("lang_pred") != language_id.NONE) | F.col("text").rlike(r"\p{L}")).select(COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id (null last; of rows of one id and text one). A null text counts as empty."""
    return exact_dedup.kept_rows(docs.select(COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by five-word shingles of similarity 0.8 or more.

    Texts without words are one group. Of rows of one id that with the smallest hash of its text stays; a null id is larger than any other.
    """
    return simhash.kept_rows(docs.select(COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 50 words or more that a document with a smaller doc_id has. n_chars follows the text.

    A text without such a passage stays as it is, null too. Rows of one id don't cut each other.
    """
    others = [c for c in COLUMNS if c not in ("text", "n_chars")]
    d = substring_dedup.remove_repeats(docs, columns=COLUMNS, spaced=True)
    cut = F.size("spans") > 0
    text, size = F.when(cut, F.col("kept")).otherwise(F.col("row.text")), F.when(cut, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return d.select(*[F.col(f"row.{c}") for c in others], text.alias("text"), size.alias("n_chars")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces of at most 4096 tokens with their places in sequences. Null and empty texts are a piece of one token; rows that repeat are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("simhash_near_dedup", near_stage), ("substring_dedup", substring_stage), ("best_fit_packing", packing_stage)]

#: SQL has no language vectors, tokenizers or packing: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir)).read()
    return STAGES[-1][1](spark, docs, sf_dir)
