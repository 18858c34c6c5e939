"""Pipeline stages: (spark, docs, sf_dir) -> documents kept, with the columns of documents (the last: encoded)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.llm import langid, mixing, near_dup, pieces, unit_dedup
from lexigrove.llm.common import by_ids, free_name, staged

#: A document whose best language has a lower mean probability is rejected, as is one without a letter.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows. Trained on the rows of ``docs`` that are not held out."""
    out = langid.identify_documents(docs)
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of near-duplicates; of equal rows one."""
    classes = near_dup.near_duplicates(docs)
    dropped = staged(classes.where("id <> class_id").select("id", "text_hash").distinct(), "dropped")
    again = classes.where("id = class_id").groupBy("id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    again = staged(again.select("id", "text_hash"), "repeated-rows")
    i, h = free_name(docs.columns, "id"), free_name(docs.columns, "text_hash")
    dropped, again = (x.withColumnsRenamed({"id": i, "text_hash": h}) for x in (dropped, again))
    keyed = docs.withColumns({i: F.col("doc_id"), h: F.xxhash64("text")})
    kept = by_ids(keyed, dropped, [i, h], "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    one = by_ids(kept, again, [i, h], "left_semi").dropDuplicates([i, h])  # combined before the shuffle, so no hot key
    return by_ids(kept, again, [i, h], "left_anti").unionAll(one).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a document of which nothing is left goes."""
    out = unit_dedup.dedup_units(docs).where((F.size("removed") == 0) | F.col("text").rlike(r"\S"))
    lengths = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return out.withColumns(lengths).select(*docs.columns) if lengths else out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: complete epochs, and once more if at least half of it is selected.

    The mix is made of ids, sources and sizes; texts are shuffled once, to meet their numbers of copies. Equal rows are
    told apart by nothing, so one of them stands for the copies of all.
    """
    row, key, one, copy = (free_name(docs.columns, x) for x in ("m_row", "m_id", "m_one", "m_copy"))
    keyed = docs.withColumns({row: F.xxhash64(*docs.columns), key: F.coalesce("doc_id", F.lit(0))})
    light = keyed.select("doc_id", "source", F.col(row).alias("row"), F.col(key).alias("key"), mixing.word_count(F.col("text")).alias("words"))
    sized = mixing.with_quality(light, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mixing.mix_sources(sized, text_col="source", quality=F.col("m_quality"), size=F.col("words"))
    copies = F.floor(F.coalesce(F.try_divide("taken", "size"), F.lit(0.0)) + 0.5).cast("int")
    taken = mixed.groupBy("key", "row").agg(F.sum(copies).cast("int").alias("copies")).where("copies > 0")
    taken = staged(taken.select(F.col("key").alias(key), F.col("row").alias(row), F.col("copies").alias(copy)), "mixed")
    number = F.row_number().over(Window.partitionBy(key, row).orderBy(row))
    found = keyed.join(taken, [key, row]).withColumn(one, number).where(F.col(one) == 1)
    return found.select(*docs.columns, F.explode(F.array_repeat(F.lit(True), F.col(copy))).alias(one)).drop(one)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str | None = None) -> DataFrame:
    """doc_id, lang, source, ids and n_pieces of each document."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.load(model))
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_pieces"))
