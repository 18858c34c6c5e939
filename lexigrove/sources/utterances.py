"""Where utterances come from and where annotations go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UTTERANCES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def utterances(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Literal utterances, numbered from 1."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], UTTERANCES)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file is one utterance, its lines joined by blanks."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.withColumn("text", F.rtrim(F.regexp_replace("text", r"\r?\n", " ")))


#: Bytes of a file for each task at most, when its rows are dealt out.
DEALT_BYTES = 4 << 20
#: Rows for each task at most, then: repeated texts take few bytes of a file, but no less work.
DEALT_ROWS = 5_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` so that no task has much more than its share of the rows: annotating costs far more than dealing out texts.

    A file is planned as many partitions by its size, but a row group is read by one of them whole; a file of one row group is
    therefore read by a single task however large it is. The rows of each partition are counted from the files' footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    rows = [r["count"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    if sum(rows) >= 2 * cores * max(rows, default=0):  # the largest partition is half a core's share at most
        return df
    return df.repartition(min(max(cores, size // DEALT_BYTES, sum(rows) // DEALT_ROWS), 100 * cores))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table of a folder; only ``columns`` are read if given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)


def write_annotations(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Annotations as Parquet, nested columns included, so that later reads prune to the fields they use."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def as_json(df: DataFrame, *keys: str, deep: bool = False) -> DataFrame:
    """Rows for reading by people: ``keys`` and the record as JSON; without ``deep`` only text, mentions and sentiment."""
    fields = [c for c in df.columns if c not in keys and (deep or c in ("text", "mentions", "tok_re_mentions", "sentiment"))]
    return df.select(*keys, F.to_json(F.struct(*fields), {"pretty": "true"}).alias("record"))
