"""The corpus pipeline: quality classifier, toxicity, line dedup, SimHash near-dedup, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written
as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.

Edge cases: documents with null or empty texts are scored like any other by
both classifiers, have no lines to lose and form one near-duplicate group, of
which one stays; null ids take part in every stage; rows repeated with the
same id and text get the same decisions, and one of them passes near-dedup; very
long texts are taken whole; columns beyond those of ``documents`` are carried, by
whatever name, up to packing; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codecorpus.llm import harmonic, line_windows, rule_ensemble, simhash_vptree, toxicity_pu
from codecorpus.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from this stage's input, does not reject."""
    return rule_ensemble.keep_good(docs, rule_ensemble.fit(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the PU classifier, learned from this stage's input, does not call toxic."""
    return toxicity_pu.drop_toxic(docs, toxicity_pu.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of repeated three-line windows."""
    return line_windows.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, 2 bits)."""
    return simhash_vptree.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    return harmonic.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("packing", packing)]

#: Learned stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
