"""A corpus from documents: toxicity, exact dedup, near dedup, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes what a stage
returns to the shared folder as Parquet and reads it again as the next one's ``docs``. All
but the last return the columns that ``documents`` has, and any others that it was given,
whatever their names. All work on whole texts of any length, take null text for empty, and
return no rows for an empty table; what they do with null ids, ties and repeated rows is said
at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import exact_dedup, mixing, piece_codec, shingle_dedup, toxicity
from tallyframe.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model learns from the labelled documents of ``sf_dir``.

    A row's score depends on its text alone, so rows that repeat stay or go together, with
    or without ids. Texts without words stay. If the labels teach nothing, all stay.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.not_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, the document with the smallest id stays.

    Null ids count as larger than any. Of rows that repeat id and text one stays. Null, empty
    and blank texts: null and empty are one group, those of white space alone another.
    """
    return exact_dedup.dedupe(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with five-word Jaccard 0.8 or more the one with the smallest id stays.

    Texts without words are one group. Null ids count as larger than any; a group without
    ids keeps one row. Of rows that share the smallest id the one with the lowest digest stays.
    """
    return shingle_dedup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: one taken twice stands twice, one not taken goes.

    Texts without words are not taken. A null source is a source, null ids go by their texts,
    ties of the sampling key go by id and text.
    """
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each row, with its id or null."""
    return piece_codec.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The kernel machine, the fingerprints and the encoder can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
