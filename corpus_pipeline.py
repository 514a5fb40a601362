"""A cleaning pipeline for training text: every stage reads what its predecessor wrote.

    toxicity          documents that the model rejects go
    near_duplicates   of each group of near copies (five-word shingles, similarity 0.8) one row stays, that of the smallest doc_id
    decontamination   documents that benchmark passages contaminate go
    secrets           live-looking secrets are replaced in the text
    packing           what is left becomes sequences of at most 2048 tokens

All stages but the last return the columns of ``documents``, whatever their names are, extra ones included.

Defined results: a null or empty text is scored, has no near copies, is never contaminated, holds no secret and packs as an
empty text. Decisions follow a row's text, never its doc_id alone: rows that share a doc_id, or have none, stay or go each by their own text. Of
repeated rows with words one stays. A null doc_id comes after all others. A null owner counts as one owner more. An empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lyrebird.llm.common import materialize, scratch_scope, table
from lyrebird.llm.decontam import keep_uncontaminated
from lyrebird.llm.ngram_join import keep_one
from lyrebird.llm.packing import pack_documents
from lyrebird.llm.queries import tokenizer_path
from lyrebird.llm.secrets import redact_corpus
from lyrebird.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that score below the threshold."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group, that of the smallest doc_id; documents without words stay."""
    return keep_one(docs, k=5, p=80, q=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the contaminated documents."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"), 13)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace live-looking secrets; every document stays."""
    return redact_corpus(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences."""
    return pack_documents(docs, tokenizer_path(), 2048)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: SQL expresses neither the model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch_scope() as keep:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
