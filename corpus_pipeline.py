"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs. Rows of the same doc_id and text are one document from
the third stage on; rows of a null or repeated doc_id with different texts are documents of their own. Empty tables pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.llm.decontamination import find_passages
from dirlake.llm.jaccard import similar_documents
from dirlake.llm.langid import fit, identify, sample
from dirlake.llm.lines import dedup_lines
from dirlake.llm.packing import pack
from dirlake.llm.storage import written
from dirlake.llm.tokens import default_path


def columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled ones; without a letter (or a text) a document goes. A missing
    lang becomes the predicted one; if no document has both text and lang it stays null."""
    model = fit(sample(docs.select("text", "lang", F.col("doc_id").alias("key"))))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found, name = identify(docs, model)
    kept = found.where(F.col(f"{name}.lang_pred") != "und").withColumn("lang", F.coalesce("lang", f"{name}.lang_pred"))
    return columns(kept, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, or much alike, in the corpus; one that loses all its text goes."""
    out, removed = dedup_lines(docs)
    out = out.where((F.size(removed) == 0) | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(removed) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return columns(out, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked at any remove, the one with the smallest doc_id (null last). Equal rows (same doc_id and text) are one."""
    key, check = "key", "check"
    while key in docs.columns:
        key += "_"
    while check in docs.columns:
        check += "_"
    keyed = docs.withColumns({key: F.xxhash64("doc_id", "text"), check: F.xxhash64(F.lit(1), "doc_id", "text")})
    found = similar_documents(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id").distinct()
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("of"))
    first = keyed.select(key, check, "doc_id").distinct().join(found, key).groupBy("component_id").agg(F.min(rank).alias("first"))
    return columns(keyed.join(first.select(F.col("first.of").alias(key)), key, "left_semi").dropDuplicates([key, check]), docs)  # different rows of one key all stay


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found, name = find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return columns(found.where(F.size(f"{name}.spans") == 0), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences, with their token ids."""
    return pack(docs, default_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the language model nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
