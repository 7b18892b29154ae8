"""From documents to packed windows of token ids: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and, but for the last, returns
the columns of documents. The models of the first two stages are trained on the rows that reach them, by the rules of
the queries op1 and op9: on a bounded sample whose bound is a parameter, and never on held-out rows. Each stage begins
with executors that have given back what the one before left in their heaps.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinsieve.llm import language_id, near_dedup, packing, suffix_dedup, toxicity
from twinsieve.llm.common import executors_give_back, held_out, table
from twinsieve.llm.word_bpe import VOCABULARY
from twinsieve.session import materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.

    A null, empty or letterless text is not. Rows are judged one by one, so rows repeated or with a null id are judged
    like any other; a row without a language trains nothing. Other columns, whatever their names, stay as they are.
    """
    executors_give_back(spark)
    return language_id.accepted(docs, language_id.train(docs.filter(~held_out())))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold.

    A null text is scored as an empty one. Rows are judged one by one, repeated ones alike; a null id has no label and
    trains nothing, and of labels that differ for one id the toxic one counts. Other columns stay as they are.
    """
    executors_give_back(spark)
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return toxicity.accepted(docs, toxicity.train(docs, labels))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of near copies.

    Rows with a null id or a text without words stay. Rows with the same id and text stay once, the first by their
    columns as JSON; the same id with another text is another document. Other columns stay as they are.
    """
    executors_give_back(spark)
    return near_dedup.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur earlier.

    Earlier is by id, then by place; a null id comes first, and of rows that share an id the lesser SHA-256 of the text.
    Rows repeated whole are one document and lose the same. A null text stays null. Other columns stay as they are, but
    for n_chars, which counts the new text.
    """
    executors_give_back(spark)
    return suffix_dedup.kept_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows.

    A null or empty text is its end id alone; each row is packed for itself, with a null or repeated id too. Only the
    ids and texts of docs are read.
    """
    executors_give_back(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("near_dedup", one_of_near_copies),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]
#: Trained models and token ids have no form in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
