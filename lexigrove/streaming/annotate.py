"""Annotation of streams. Annotators are expressions inside a row, so a pipeline runs on a stream as it does on a table;
word counts by label are a running aggregate, and distributions follow from it at the end of each batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrove.operators import morphology, tokens
from lexigrove.operators.wordcount import WordCountConfig, distribution, words_by_label
from lexigrove.plans.materialise import shared_folder


def utterance_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream over the Parquet files of a folder (or a file), with the schema that they have now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if name.endswith(".parquet"):
        reader = reader.option("pathGlobFilter", name)
        # a single file is watched through its folder; a folder of part files is watched itself
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
            reader, folder = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files), path
        return reader.parquet(folder)
    return reader.parquet(path)


def go_words(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """A stream with what word counts need: tokens with tags and stop words."""
    df = tokens.split_sentences(tokens.tokenize(stream, text_col))
    return morphology.flag_stop_words(morphology.add_lemmas(morphology.tag_parts_of_speech(df)))


def running_counts(stream: DataFrame, label: Column, config: WordCountConfig = WordCountConfig()) -> DataFrame:
    """(label, word, n) over all that has been read: write in ``update`` or ``complete`` mode."""
    return words_by_label(stream, label, config)


def windowed_counts(stream: DataFrame, time: str, label: Column, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, label, word, n) by event time; rows later than the watermark are not counted."""
    timed = stream.withWatermark(time, late).withColumn("label", label)
    rows = tokens.elements(timed, "tokens", time, "label").select(time, "label", F.lower("x.text").alias("word"))
    return rows.groupBy(F.window(time, width), "label", "word").agg(F.count("*").alias("n"))


def write_distributions(counts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, top: int = 3) -> StreamingQuery:
    """Starts a query that hands the distributions so far to ``sink`` after each batch."""

    def each(batch: DataFrame, number: int) -> None:
        sink(distribution(batch, top), number)

    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(each).trigger(availableNow=True).start()


def counted_to_end(spark: SparkSession, path: str, label: str) -> DataFrame:
    """The counts of a stream over ``path`` when it has read all that is there, as a table."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    counts = running_counts(go_words(utterance_stream(spark, path)), F.col(label))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/counts")

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").foreachBatch(keep)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("label string, word string, n long").parquet(f"{base}/counts")
