"""The registered queries of the corpus operators: thin digests of what each operator returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import html_text, langid, media, mixing, near_dup, pieces, token_store, topk, unit_dedup, warc
from lexigrove.llm.common import shared_dir


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pieces.with_round_trip(docs, tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    docs = mixing.with_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mixing.mix_sources(docs, quality=F.col("m_quality"), size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; its bytes stay where they are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = langid.identify_documents(docs)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = shared_dir(spark, "tokens"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = token_store.write_tokens(docs, tokenizer_file("byte_bpe_50k.json"), folder)
    back = token_store.read_tokens(manifest, folder)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    manifest = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    back = warc.read_archives(manifest, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = unit_dedup.dedup_units(docs)
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), cut.alias("removed_chars"), "removed", "text")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(pages)


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "class_id")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "media")
    manifest = media.write_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return media.features(media.read_media(spark, folder, manifest))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_store": op2_token_store,
    "op3_exact_topk": op3_exact_topk,
    "op4_warc_dictionary": op4_warc_dictionary,
    "op5_pieces": op5_pieces,
    "op6_mix_sources": op6_mix_sources,
    "op7_unit_dedup": op7_unit_dedup,
    "op8_main_text": op8_main_text,
    "op9_near_dup": op9_near_dup,
    "op10_media": op10_media,
}
ORACLE = {
    "op3_exact_topk": topk.ORACLE,
    "op6_mix_sources": mixing.ORACLE,
}
