"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    fingerprints,
    hosts,
    idplanes,
    languages,
    linedups,
    manifest,
    packing,
    periodic,
    private,
    probminhash,
    repeats,
    speculate,
    warc,
)
from .common import table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op2_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, from the files they were written to."""
    return idplanes.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the archives that all pages were written to."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op4_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return speculate.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return hosts.judged_by_host(table(spark, sf_dir, "documents"))


def op6_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return languages.identified(table(spark, sf_dir, "documents"))


def op7_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that occurred before."""
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op9_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return private.found(table(spark, sf_dir, "documents"))


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that an earlier one holds."""
    return linedups.line_digests(table(spark, sf_dir, "documents"))


def op12_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its tampered leaf is found out."""
    return manifest.verified(table(spark, sf_dir, "documents"))


def op13_block_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, and the text without their repeats."""
    return periodic.run_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_fingerprints": op1_minhash_fingerprints,
    "op2_bitplane_tokens": op2_bitplane_tokens,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_speculative_bpe": op4_speculative_bpe,
    "op5_host_rules": op5_host_rules,
    "op6_hyperdimensional_language": op6_hyperdimensional_language,
    "op7_exact_complement_packing": op7_exact_complement_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_probminhash_classes": op9_probminhash_classes,
    "op10_boosted_pii": op10_boosted_pii,
    "op11_line_runs": op11_line_runs,
    "op12_merkle_climb": op12_merkle_climb,
    "op13_block_convolution": op13_block_convolution,
}
