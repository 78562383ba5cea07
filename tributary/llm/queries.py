"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, lm, media, mixing, ngram_join, oracles, sharding, substring, toxicity
from .common import remainder, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remainder(F.col("doc_id"), 7) == 2
    return lm.score(table(spark, sf_dir, "documents"), ~out).withColumn("held_out", out)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.read_back(chat.format_turns(turns.unionByName(own))).drop("n_tokens", "loss_tokens")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = remainder(F.col("doc_id"), 3) == 1
    return langid.identify(docs, langid.fit(docs.where(~out)), out)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = remainder(F.col("doc_id"), 4) == 2
    return toxicity.score(docs, toxicity.fit(docs, labels.where(~out)), out)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is stored as the payload of a figure on its document's page; the page's reference finds it by digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    payloads = media.resolved_payloads(media.store(docs, "text"))
    caption = F.concat(F.lit("payload of "), F.octet_length("text").cast("string"), F.lit(" bytes"))
    pages = docs.withColumn("digest", media.payload_digest(F.col("text"))).select("doc_id", media.page("digest", caption).alias("html"))
    refs = media.references(media.parse(pages, "doc_id", "html")).withColumnRenamed("id", "doc_id")
    return media.resolve(refs, payloads).drop("digest")


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of every web page: how many, and the text runs in order."""
    found = media.parse(table(spark, sf_dir, "pages"), "page_id", "html")
    runs = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"])
    return found.select(F.col("id").alias("page_id"), F.size("items").alias("n_items"), F.size(runs).alias("n_texts"), F.sha2(F.array_join(runs, "\n"), 256).alias("texts_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lm": op2_lm,
    "op3_chat": op3_chat,
    "op4_substring": op4_substring,
    "op5_langid": op5_langid,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_join": op7_ngram_join,
    "op8_sharding": op8_sharding,
    "op9_media": op9_media,
    "op10_mixing": op10_mixing,
    "page_sequences": page_sequences,
}

#: The others have no SQL form: tests hold them against brute force, round trips or held-out labels.
ORACLES: dict[str, str] = {
    "op3_chat": oracles.OP3,
    "op4_substring": oracles.OP4,
    "op7_ngram_join": oracles.OP7,
    "op9_media": oracles.OP9,
    "op10_mixing": oracles.OP10,
}
