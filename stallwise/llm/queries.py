"""The corpus operators as named queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm import (
    alignment,
    conversations,
    decontaminate,
    hosts,
    jaccard,
    languages,
    materialise,
    mixing,
    neighbours,
    pseudonyms,
    quality,
    toxicity,
    warc,
)
from stallwise.llm.common import crc32_fold, table
from stallwise.llm.oracle import ORACLE as ORACLE

# Rules of the URL filter.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

HELD_OUT = 1  # fold of the CRC-32 of the id that isn't learned from
QUALITY_FOLDS, QUALITY_HELD_OUT = 4, 2


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    learned = documents.where(crc32_fold(F.col("doc_id")) != HELD_OUT)
    scored = toxicity.score(documents, toxicity.train(learned, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (crc32_fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    learned = documents.select("doc_id", "text", "lang").where(crc32_fold(F.col("doc_id")) != HELD_OUT)
    found = languages.predict(documents, languages.train(learned))
    return found.select(
        "doc_id", (crc32_fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected"
    )


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label that carries its id; other pages have none."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hosts.filter_urls(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.materialise(table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents")).orderBy("position", "digest")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pseudonyms.pseudonymise(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "text", "n_replaced", *(f"n_{kind}" for kind in pseudonyms.PATTERNS))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.summary(conversations.repair(damaged, copies="copies"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fold = crc32_fold(F.col("doc_id"), QUALITY_FOLDS)
    learned = documents.select("doc_id", "text").where(fold != QUALITY_HELD_OUT)
    scored = neighbours.score(documents, neighbours.train(learned, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold == QUALITY_HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= neighbours.THRESHOLD).cast("int").alias("predicted"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(table(spark, sf_dir, "documents")).drop("groups")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_url_filter": op7_url_filter,
    "op8_materialise": op8_materialise,
    "op9_mix": op9_mix,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_conversations": op11_conversations,
    "op12_neighbours": op12_neighbours,
    "op13_alignment": op13_alignment,
}
