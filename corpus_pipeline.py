"""A corpus in five stages: language ID, exact and near deduplication, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``. All but the last return the columns
of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import bpe, exact_dedup, language, mixing, near_dedup
from lexispark.llm.catalog import vocabulary_path
from lexispark.llm.common import fresh, written

#: Share of the likeliest language below which a text is rejected.
LEAST_SCORE = 0.5
#: SQL cannot express the language model nor the tokenizer.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; goes by their text alone.

    A null or empty text, or one without a letter, has no language and goes;
    whole texts are read, however long; repeated rows are decided alike; columns
    of any name stay; an empty table stays empty. Without a labelled document
    nothing is recognised.
    """
    model = language.train(docs.where(~language.held_out(docs["doc_id"])).select("text", "lang"), vocabulary_path("piece_bpe_32k.model"))
    lang, score = fresh(docs, "lang_pred", "score")
    known = language.predict(docs, model, "text", lang, score)
    return known.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of each group of equal texts.

    A null text equals the empty one; a null doc_id is smaller than others; of
    repeated rows the last by place in the table stays; very long texts are
    compared whole; columns of any name stay; an empty table stays empty.
    """
    return exact_dedup.drop_exact(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8): the smallest doc_id.

    Texts without words and rows with a null doc_id are linked with nothing and
    stay; rows that share a doc_id are decided by their own texts; very long texts
    are read whole, piece by piece; columns of any name stay; an empty table
    stays empty.
    """
    return near_dedup.drop_near(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target shares.

    A null source is a source, the last; documents without words stay once;
    repeated rows are taken one by one, ties in rank go by a digest of the row's
    id and text; of very long texts only the number of words matters; columns of
    any name stay; an empty table stays empty.
    """
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and a digest of what they decode to, of each row.

    A null or empty text has no tokens; rows are independent, so repeated ones
    (copies that the mix made) give equal results; very long texts are encoded
    whole; other columns, whatever their names, are not read; an empty table
    gives none.
    """
    return bpe.encode_documents(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mix_sources", mix_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
