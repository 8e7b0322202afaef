"""The registered training-data queries and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderlens.llm import (
    chat, collocations, jaccard, line_dedup, mixture, packing, perplexity, repair, secret_scan, topk, toxicity, url_filter,
    warc,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    judged = perplexity.judge(_table(spark, folder, "documents"))
    return judged.drop("print").withColumnRenamed("key", "doc_id")


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_filter.labelled(pages))
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    placed = packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return placed.withColumnRenamed("key", "doc_id")


def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixture.mix(_table(spark, folder, "documents"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(_table(spark, folder, "documents")).withColumnRenamed("key", "doc_id")


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"),
        count(2).alias("n_hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.train(docs, _table(spark, folder, "labels"))
    return toxicity.score(docs, model).withColumnRenamed("key", "doc_id")


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.read(warc.write(_table(spark, folder, "pages")))
    return records.select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(chat.PLANTED, "conv_id long, turn long, role string, text string"))
    tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    read = chat.read_turns(chat.format_turns(turns, *tokenizer), *tokenizer)
    return chat.digests(read).withColumnRenamed("key", "conv_id")


def op13_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(repair.damaged(_table(spark, folder, "conversations"))).withColumnRenamed("key", "conv_id")


QUERIES = {f.__name__: f for f in (
    op1_perplexity, op2_url_filter, op3_exact_top_k, op4_best_fit_packing, op5_mix_sources, op6_jaccard_join,
    op7_secret_scan, op8_toxicity, op9_warc, op10_line_dedup, op11_collocations, op12_chat_format, op13_structure_repair)}
ORACLE: dict[str, str] = {
    "op2_url_filter": url_filter.ORACLE, "op3_exact_top_k": topk.ORACLE, "op9_warc": warc.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE, "op11_collocations": collocations.ORACLE,
    "op12_chat_format": chat.ORACLE, "op13_structure_repair": repair.ORACLE,
}
