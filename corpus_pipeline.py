"""From documents to packed training sequences, in five stages.

Each stage gets what the one before kept, read again from Parquet, and returns the columns of
documents; the last returns the packed pieces. An empty table passes through every stage but the
first, which needs labelled documents. A very long text is whole in one row at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptwell.llm import lines, mixing, packing, quality, simhash
from scriptwell.llm.common import table, unused
from scriptwell.llm.queries import tokenizer_path
from scriptwell.sources.workspace import write_once


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of low quality go; null texts are judged as empty ones, equal
    texts alike, and other columns aren't looked at. Without labels nothing can be learned: the
    operator stops."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where a table has it, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents that are nothing else.

    Null texts, empty texts and blank ones stay, as nothing is removed from them. Of repeated rows
    each keeps the same lines. Columns named like the operator's counts are kept as they came.
    """
    aside = dict(zip(("n_lines", "n_removed"), unused(docs.columns, "_n_lines", "_n_removed"),
                     strict=True))
    left = lines.line_dedup(docs.withColumnsRenamed(aside))
    emptied = (F.col("n_removed") > 0) & (F.length(F.trim("text")) == 0)
    back = left.where(~emptied).drop("n_lines", "n_removed").withColumnsRenamed(
        {v: k for k, v in aside.items()})
    return with_length(back).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that of the smallest id, null ids last. Texts without
    words, null or not, are one group. Rows equal in id and text are merged."""
    return simhash.simhash_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words aren't taken. A null source is a
    source, and ties are settled by a hash of id and text."""
    return with_length(mixing.mixture(docs, mixing.mix_sources(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; a null text is the end id alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality classifier", classify), ("line dedup", drop_lines),
          ("simhash near-dedup", drop_near_copies), ("mixing sources", mix), ("packing", pack)]

#: Learned scores, XXH64 fingerprints and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = write_once(docs, f"pipeline-{number}")
    return docs
