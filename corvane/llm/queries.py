"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from . import leakage, lookalike, markup, neardup, privacy, spam, splitting, tokens


def _shown(spark: SparkSession, folder: str) -> DataFrame:
    documents, messages = table(spark, folder, "documents"), table(spark, folder, "chat_messages")
    frequency = lookalike.representatives(documents.select("text"), messages.select("content"))
    rows = lookalike.keyed(documents, "doc_id", "text", frequency).withColumn("table_name", F.lit("documents"))
    return rows.unionByName(lookalike.keyed(messages, "message_id", "content", frequency).withColumn("table_name", F.lit("chat_messages")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.same_looking_pairs(_shown(spark, folder))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.same_looking_classes(_shown(spark, folder))


def p1_text(spark: SparkSession, folder: str) -> DataFrame:
    documents, messages = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "chat_messages").select("content")
    return lookalike.normalize(documents, "text", lookalike.representatives(documents.select("text"), messages))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    texts = neardup.similar_pairs(documents, "doc_id", "text", 3, 0.6).withColumn("field", F.lit("text"))
    paths = neardup.similar_pairs(documents, "doc_id", "relative_path", 1, 0.7).withColumn("field", F.lit("relative_path"))
    return texts.unionByName(paths).select("field", F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    texts = neardup.similar_classes(documents, "doc_id", "text", 3, 0.6).withColumn("field", F.lit("text"))
    paths = neardup.similar_classes(documents, "doc_id", "relative_path", 1, 0.7).withColumn("field", F.lit("relative_path"))
    return texts.unionByName(paths).select("field", F.col("id").alias("doc_id"), "class_id", "size", "links")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split(table(spark, folder, "documents"), "doc_id", longer_than=1000).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    places = (("documents", "doc_id", "text"), ("chat_messages", "message_id", "content"), ("retrieval_runs", "request_id", "question"))
    parts = [privacy.found(table(spark, folder, name), key, column, name) for name, key, column in places]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_text(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.redacted(table(spark, folder, "documents").select("doc_id", "text"), "text")


def p6_text(spark: SparkSession, folder: str) -> DataFrame:
    return markup.cleaned(table(spark, folder, "documents").select("doc_id", "text"), "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.found(table(spark, folder, "documents"), "doc_id", "text")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded(table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.found(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.found(table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict:
    found = (p1_found, p1_classes, p1_text, p2_found, p2_classes, p3_found, p5_found, p5_text, p6_found, p6_text, p7_ids, p8_found, p9_found)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """None: SQL cannot say these; they are tested against brute force, plain forms and another encoder."""
    return {}
