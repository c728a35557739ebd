"""From raw documents to token files: filter, deduplicate, decontaminate, mix, encode.

Each stage takes ``(spark, docs, sf_dir)``; ``docs`` has the columns of ``documents``, and so has the
result of every stage but the last. ``run`` writes each result as Parquet into the shared folder and
reads it back as the next stage's input, so a lost executor costs part of one stage.

Defined results, for every stage: a null or empty text is a document without words: it is not toxic
unless the model's score of no term says so, is no copy of anything, holds no benchmark item and is
never taken into the mix. A null or repeated doc_id stands for a row of its own, except that an id that
holds a benchmark item goes with all its rows. Null lang, source or n_chars are kept; a null source is
mixed as a source of its own. Long texts are read whole. Of repeated rows one stays. Extra columns,
whatever their names, are kept up to the mix. Empty tables give empty results; without labels no
document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm.decontam import decontaminate
from faultline.llm.mixing import mixed_documents
from faultline.llm.queries import END_ID, table, vocabulary_path
from faultline.llm.setjoin import one_of_each
from faultline.llm.storage import materialize
from faultline.llm.tokenbin import token_binary
from faultline.llm.toxicity import non_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on all labels, does not reject."""
    return non_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of linked sets of five-word shingles."""
    return one_of_each(docs, 5, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), short=1, loose=1)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document taken twice is there twice."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row a document of the files, in ascending order of ids."""
    return token_binary(docs, vocabulary_path(), END_ID)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: No stage but the mixing and the decontamination can be told in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on ``documents``: ``doc_id, start, n_tokens, ids_crc32`` of the token files."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
