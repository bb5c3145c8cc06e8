"""Corpus pipeline: toxicity, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deploom.llm.bwt import remove_repeats
from deploom.llm.common import table, written
from deploom.llm.packing import pack_documents
from deploom.llm.pii import sanitise
from deploom.llm.simhash import SIMILAR, representatives
from deploom.llm.toxicity import clean


def _counted(docs: DataFrame) -> DataFrame:
    """Where documents carry their length, it follows the changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window reaches the threshold go.

    Null and empty texts score alike and stay unless that score does; equal texts fare alike; rows
    without a doc_id are judged too; an empty table gives no rows; further columns pass untouched.
    """
    return clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingle sets of Jaccard similarity 0.8 or more, the smallest doc_id stays.

    Null and empty texts are one group; of repeated rows (same doc_id and text) one stays; rows without a
    doc_id stay only where nothing with one is in their group; an empty table gives no rows; further
    columns pass untouched, whatever their names.
    """
    return representatives(docs, SIMILAR)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 100-byte string that starts earlier go from the texts; every row stays.

    Rows of one doc_id are ordered by their place in the input, rows without one come first; null texts
    stay null, texts of nothing but repeats become empty; an empty table gives no rows; further columns
    pass untouched, whatever their names, but for ``n_chars``, which follows the text.
    """
    return _counted(remove_repeats(docs))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are replaced in the texts; every row stays.

    Of overlapping spans the first one's replacement counts; null texts stay null; equal texts change
    alike; an empty table gives no rows; further columns pass untouched but for ``n_chars``.
    """
    return _counted(sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document and its place in a training sequence.

    Null texts count as empty (one piece, the end id); repeated rows are packed each; null doc_ids stay
    null; an empty table gives no rows; further columns are not read.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("suffix_array", drop_repeated_passages),
    ("pii", sanitise_personal_data),
    ("packing", pack),
]

#: The trained network, the merge of transforms and the packing order are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
