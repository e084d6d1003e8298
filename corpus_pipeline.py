"""The corpus pipeline: each stage works on all that the one before it kept.

All stages but the last return the columns they were given, whatever their names: results are worked out under
names that begin with a prefix no column has. An empty table gives an empty table. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, nearcopies, packing, quality, repeats
from tessera.llm.common import Scratch, apart, table
from tessera.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and blank texts have no words and go. Repeated rows are judged alike. Other columns may be null.
    """
    x = apart(docs.columns)
    return quality.compression_bands(docs, keep=docs.columns, prefix=x).where(F.col(f"{x}kept")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 of five-word shingles): the one with the least id.

    Near copies are found by the blocks of SimHash fingerprints, those many bits apart by minhashes; all are verified.
    Null and empty texts are copies of one another. Of rows that repeat an id one stays. Rows with a null id stay.
    """
    return nearcopies.one_per_group(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has; those of which nothing is left go.

    Null texts come out empty. Rows with a null id stay as they are. Rows with one id are cut by smaller ids only.
    ``n_chars``, if there, counts what is left of the text.
    """
    x = apart(docs.columns)
    cut = repeats.cut_repeats(docs, keep=docs.columns, prefix=x).where(f"{x}n_removed = 0 OR {x}n_removed < {x}n_words")
    made = {"text": F.col(f"{x}rest"), "n_chars": F.length(f"{x}rest").cast("long")}
    return cut.select(*(made[c].alias(c) if c in made else F.col(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled by their calibrated probabilities.

    Null sources and languages are values of their own. Rows that repeat an id, or have none, share one decision.
    """
    x = apart(docs.columns)
    return mixing.mix(docs, keep=docs.columns, prefix=x).where(F.col(f"{x}selected")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in token sequences.

    Null and empty texts are one end token. Rows that repeat an id are packed each; so are rows without an id.
    """
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("repeats", repeats_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: zstandard ratios and XXH64 fingerprints are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read back for the next."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.write(docs)
    return docs
