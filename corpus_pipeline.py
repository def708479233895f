"""From raw documents to token ids: five stages, each an operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xeric.llm import bpe, line_dedup, minhash, mixing, toxicity
from xeric.llm.common import materialise, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    A row with a null text is scored as an empty one; rows of equal text go or stay together, whatever their ids, and
    texts of any length are scored whole. Columns of any name pass through. An empty table gives an empty one.
    """
    scores = toxicity.scored(docs, read_table(spark, sf_dir, "labels"))
    return scores.filter(F.col(scores.columns[-1]) < toxicity.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines. All rows stay, also those with no line left, and null texts as empty ones.

    Of a line in many documents the largest id's stays; rows that repeat an id are one document, and a null id ranks
    below the others. Texts of any length are split whole. Columns of any name pass through. An empty table gives an
    empty one.
    """
    out = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Rows with a null id, and those without words, stay; rows that repeat an id go or stay together. Texts of any length
    are compared whole. Columns of any name pass through. An empty table gives an empty one.
    """
    gone = minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each round in which blocks of a document are taken, with those blocks as its text.

    Documents without words, null texts among them, are not in it. Null is a source of its own. Rows that repeat an id,
    a source and a text are taken alike. Columns of any name pass through. An empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the SHA-256 of the ids and of the text decoded from them.

    Each row is encoded by itself, whole, whatever its id; a null text as an empty one. An empty table gives an empty one.
    """
    return bpe.encode(docs, bpe.model_path(), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("BPE", encode),
]
#: A trained network, MinHash groups and a seeded mix are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
