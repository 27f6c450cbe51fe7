"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from codecorpus.llm import (collocations, fill_middle, harmonic, katz, line_windows, ngram_join, nn_descent, quality_gbt, rule_ensemble, simhash_vptree,
                            suffix_pieces, toxicity_pu, wavelet)
from codecorpus.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document (vantage-point trees)."""
    return simhash_vptree.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents (non-negative PU learning)."""
    docs = table(spark, sf_dir, "documents")
    return toxicity_pu.score(docs, toxicity_pu.fit(docs, table(spark, sf_dir, "labels")))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every 50th vector (NN-descent graph, greedy search)."""
    vectors = table(spark, sf_dir, "embeddings")
    return nn_descent.search(nn_descent.build(vectors), vectors.where("vec_id % 50 = 0"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as wavelet matrices and read back."""
    return wavelet.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents by suffix-array matching, and whether decoding gives the text back."""
    return suffix_pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and the boosted trees' verdict on all documents."""
    docs = table(spark, sf_dir, "documents")
    judged = quality_gbt.judge(docs, quality_gbt.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "score", "kept")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids (harmonic classes)."""
    return harmonic.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated three-line windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_windows.dedup_lines(docs, counts=True)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents (Katz backoff, words after one word)."""
    return katz.score(table(spark, sf_dir, "documents"), order=2)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents (sparse rule ensemble)."""
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.score(docs, rule_ensemble.fit(docs, table(spark, sf_dir, "labels")))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of 5-word shingles and its group at Jaccard 0.8 (rare-first prefix filtering)."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases by score (counting quotient filters)."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of all documents (learned rank index), by digest, and the texts restored."""
    return fill_middle.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_token_output": op4_token_output,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality_trees": op6_quality_trees,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_katz": op9_katz,
    "op10_quality_rules": op10_quality_rules,
    "op11_ngram_join": op11_ngram_join,
    "op12_collocations": op12_collocations,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": line_windows.ORACLE_SQL,
    "op11_ngram_join": ngram_join.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_fill_middle": fill_middle.ORACLE_SQL,
}
