"""Word distributions by label and scores of utterances against them.

Training is a hash aggregate by (label, word), combined before its shuffle; distributions are at most ``top`` words a label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions.strings import feature_name
from lexigrove.functions.tags import GO_TAGS
from lexigrove.operators.access import go_word_forms, word_form
from lexigrove.operators.features import numeric
from lexigrove.operators.tokens import elements

#: A table of distributions of more rows than this is joined by shuffling instead of being broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class WordCountConfig:
    """Words a distribution keeps for a label, how a token becomes a word, and the tags of words that count."""

    top: int = 3
    form: Callable[[Column], Column] = word_form
    tags: tuple[str, ...] = GO_TAGS


def words_by_label(df: DataFrame, label: Column, config: WordCountConfig = WordCountConfig()) -> DataFrame:
    """(label, word, n): go words of labelled rows; rows without a label are left out."""
    labelled = df.withColumn("label", label.cast("string"))
    rows = elements(labelled, go_word_forms(F.col("tokens"), config.form, config.tags), "label").withColumnRenamed("x", "word")
    return rows.where(F.col("label").isNotNull()).groupBy("label", "word").agg(F.count("*").alias("n"))


def distribution(counts: DataFrame, top: int = 3) -> DataFrame:
    """(label, word, num, den, ratio): the ``top`` most frequent words of each label, ties by word, normalised over these."""
    by_label = Window.partitionBy("label")
    ranked = counts.withColumn("r", F.row_number().over(by_label.orderBy(F.desc("n"), F.asc("word")))).where(F.col("r") <= top)
    out = ranked.withColumn("den", F.sum("n").over(by_label))
    return out.select("label", "word", F.col("n").alias("num"), "den", (F.col("n").cast("double") / F.col("den")).alias("ratio"))


def feature_stats(df: DataFrame, label: Column, config: WordCountConfig = WordCountConfig()) -> tuple[DataFrame, DataFrame]:
    """Words by label and the distributions from them."""
    counts = words_by_label(df, label, config)
    return counts, distribution(counts, config.top)


def label_scores(df: DataFrame, keys: list[str], stats: DataFrame, config: WordCountConfig = WordCountConfig()) -> DataFrame:
    """(keys, label, score): for every row with tokens and every label, the sum of the label's ratios over all tokens.

    A word's ratios travel as one small array (a value for each label that has the word), so tokens are joined once; the
    join broadcasts the distributions if they have few rows. Labels without a match score 0.
    """
    by_word = stats.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("label", "ratio"))).alias("ratios"))
    labels = [r[0] for r in stats.select("label").distinct().orderBy("label").collect()]  # labels are few: one for each class
    tokens = elements(df, "tokens", *keys).select(*keys, config.form(F.col("x")).alias("word"))
    by_word = F.broadcast(by_word) if stats.count() <= BROADCAST_ROWS else by_word
    joined = tokens.join(by_word, "word", "left")
    sums = [F.sum(F.coalesce(F.try_element_at("ratios", F.lit(x)), F.lit(0.0))).alias(f"s_{i}") for i, x in enumerate(labels)]
    if not labels:
        return joined.select(*keys, F.lit("").alias("label"), F.lit(0.0).alias("score")).limit(0)
    wide = joined.groupBy(*keys).agg(*sums)
    pairs = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"s_{i}").alias("score")) for i, x in enumerate(labels)])
    return wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.label", "p.score")


def score_features(scores: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """A column ``word_count_<label>`` for each label."""
    cells = [F.sum(F.when(F.col("label") == x, F.col("score")).otherwise(0.0)).alias(feature_name("word-count", x)) for x in labels]
    return scores.groupBy(*keys).agg(*cells)


def score_feature_metas(labels: Iterable[str]) -> T.StructType:
    return T.StructType([numeric(feature_name("word-count", x)) for x in labels])


def top_labels(scores: DataFrame, keys: list[str], n: int = 1) -> DataFrame:
    """(keys, rank, label, score): the ``n`` best labels of each row that score above 0, ties by label."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("label"))
    ranked = scores.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= n) & (F.col("score") > 0))
    return ranked.select(*keys, F.col("rank").cast("int").alias("rank"), "label", "score")
