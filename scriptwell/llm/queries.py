"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptwell.llm import (
    alignment,
    ann,
    bytetree,
    chat,
    exact,
    lexical,
    lines,
    mixing,
    packing,
    phrases,
    quality,
    simhash,
    suffixes,
)
from scriptwell.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splitting_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")) \
        .select("doc_id", "fingerprint", "component_id")


def op2_ann_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")) \
        .select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and what is left as a document: text and n_chars. Where a removed run
    ends inside a character, text holds a replacement character for each part left of it."""
    text = F.expr("make_valid_utf8(CAST(kept AS STRING))")
    return suffixes.suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return chat.chat_digests(chat.format_chats(turns.unionByName(more), tokenizer_path()))


def op11_byte_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer_path(RANKS), splitting_pattern()
    encoded = bytetree.encode(table(spark, sf_dir, "documents"), ranks, pattern)
    return bytetree.decode(encoded, ranks, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(),
                           tokenizer_path(PIECES), digest=True) \
        .withColumnRenamed("groups", "groups_sha256")


QUERIES: dict = {f.__name__: f for f in (
    op1_simhash_dedup, op2_ann_adaptive_scan, op3_exact_dedup, op4_substring_dedup,
    op5_quality_classifier, op6_line_dedup, op7_source_mix, op8_suffix_array_dedup, op9_packing,
    op10_chat_format, op11_byte_bpe_tree, op12_lexical_search, op13_token_alignment)}
