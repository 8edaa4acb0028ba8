"""From raw documents to token ids in five stages; each one works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsense.llm import bpe, decontaminate, jaccard, linededup, quality
from fleetsense.llm.common import free_name, saved
from fleetsense.llm.queries import table, tokenizer_file


def numbered(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """docs with a column that tells its rows apart by id and text, its name, and whether it is a hash of both: it is the
    doc_id itself where each is there once and none is null."""
    name = free_name(docs.columns, "row_id")
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name, False
    return docs.withColumn(name, F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))), name, True


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more."""
    model, score = quality.fit(docs, table(spark, sf_dir, "labels")), free_name(docs.columns, "score")
    return quality.scored(docs, model, score).where(F.col(score) >= 0.7).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; n_chars follows the text."""
    return linededup.drop_common_lines(docs).select("doc.*").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8. The one with the smallest doc_id stays.

    Rows that share a doc_id are documents of their own, if their texts differ; rows equal in both are one. Null ids come last."""
    rows, key, hashed = numbered(docs)
    near = jaccard.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"))
    if not hashed:
        gone = near.where("component_id <> doc_id").select(F.col("doc_id").alias(key))
        return rows.join(gone, key, "left_anti").select(*docs.columns)
    near = near.select(F.col("doc_id").alias(key), "component_id").join(rows.groupBy(key).agg(F.min("doc_id").alias("id")), key)
    stay = near.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", key)).alias("w")).select(F.col(f"w.{key}").alias(key))
    return rows.join(saved(stay, "stay"), key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; of rows that share a doc_id, or have none, only those with the item go."""
    rows, key, _ = numbered(docs)
    found = decontaminate.leaks(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = saved(found.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return rows.join(found, key, "left_anti").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids."""
    return bpe.tokenize(docs, tokenizer_file(), ids=True)


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near copies", drop_near_copies), ("decontamination", drop_leaks), ("token ids", token_ids)]
ORACLE_SQL = None       # the classifier, BM25 and BPE are beyond SQL; tests compare each stage with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; every stage's output is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
