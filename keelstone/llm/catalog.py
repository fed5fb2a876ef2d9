"""The operators on the given tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.llm import (
    captures,
    codes,
    contamination,
    fingerprints,
    forced,
    middles,
    neardup,
    pieces,
    privacy,
    records,
    revisits,
    sharding,
    substrings,
    toxicity,
)
from keelstone.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings that occur earlier."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return pieces.piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every not-modified revisit of the captures of the pages, resolved."""
    found = revisits.resolve_revisits(captures.captures(spark, table(spark, sf_dir, "pages")))
    return found.withColumn("headers", captures.header_text(F.col("headers")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document, edits allowed."""
    return contamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token records of every document, written and read back."""
    manifest = records.write_records(
        table(spark, sf_dir, "documents"), scratch_path(spark, "records"), vocabulary("word_bpe_49k.json")
    )
    return records.record_digests(manifest)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the training folds."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = (~toxicity.in_training("doc_id")).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of near equal bytes."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


#: Production takes the key from its secret store; results here are to be reproducible.
DEMO_KEY = "keelstone"


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses permuted."""
    return privacy.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, cut between lines, as digests."""
    return middles.middle_digests(table(spark, sf_dir, "documents"))


def op13_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return forced.word_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_repeated_substrings": op2_repeated_substrings,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_revisits": op4_revisits,
    "op5_decontamination": op5_decontamination,
    "op6_token_records": op6_token_records,
    "op7_toxicity": op7_toxicity,
    "op8_byte_shards": op8_byte_shards,
    "op9_fingerprints": op9_fingerprints,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_vector_codes": op11_vector_codes,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_forced_bpe": op13_forced_bpe,
}
ORACLES = {
    "op4_revisits": captures.ORACLE,
    "op11_vector_codes": codes.ORACLE,
    "op12_fill_in_middle": middles.ORACLE,
}
