"""From raw documents to packed training sequences: language, toxicity, near duplicates, packing.

Each stage reads what its predecessor wrote and works on all of it. A stage's decisions take effect: documents that it
rejects go. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepsake.llm import language_id, near_duplicates, packing, toxicity
from keepsake.llm._shared import table, written
from keepsake.llm.queries import tokenizer

#: Runs that a packing worker remembers: fewer than by itself, as idle workers of other stages may stand beside it.
REMEMBERED = 400_000


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach.

    Rejected are null and empty texts, those without a letter, and those that no learned language explains (see spoken()). An
    empty table stays empty. Repeated rows and extra columns pass through, null doc_ids too.
    """
    return language_id.spoken(docs)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity; the model is fitted on a bounded sample of the labelled ones.

    Each row is judged by its whole text, whatever its length; a null or empty text has the score of no words. Without labels of both kinds
    all documents stay. Repeated rows and extra columns pass through, null doc_ids too, which no label names.
    """
    return toxicity.harmless(docs, toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels"))))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Texts without a word have no duplicate and stay, and so do rows without a doc_id. Of rows that repeat doc_id and text one
    stays. Extra columns pass through, whatever their names.
    """
    return near_duplicates.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    A null or empty text is its end mark alone; longer ones than a sequence are cut, and nothing is lost. Repeated rows and rows without a doc_id are packed
    like any other; extra columns are left out. An empty table gives no pieces.
    """
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [("language_id", identified), ("toxicity", harmless), ("near_duplicates", single), ("packing", packed)]
#: SQL expresses neither the parser nor the model nor the packing; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
