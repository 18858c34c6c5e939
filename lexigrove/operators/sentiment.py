"""Sentiment by word list: tokens, sentences (clamped to -2..2) and utterances (the sum over sentences, not clamped)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.arrays import at, drop_take, let
from lexigrove.operators import chains

#: Words by score.
WORDS = {
    2: "excellent wonderful amazing perfect fantastic brilliant outstanding superb".split(),
    1: "good great love like enjoy happy nice best better fine glad helpful beautiful pleasant dog friend success thanks well".split(),
    -1: "bad sad poor lazy wrong hate fail failed problem grim worse dull boring angry sorry error damp drizzly".split(),
    -2: "terrible horrible awful worst disgusting dreadful".split(),
}
NEGATORS = ("not", "n't", "n’t", "no", "never")


def token_sentiment(token: Column, before: Column, before_that: Column) -> Column:
    """A token's score; a negator among the two tokens before in the sentence turns it round."""
    lower, out = F.lower(token["text"]), F.lit(0)
    for score, words in WORDS.items():
        out = F.when(lower.isin(*words), score).otherwise(out)
    near = lambda t: F.coalesce(F.lower(t["text"]).isin(*NEGATORS), F.lit(False))
    return F.when(near(before) | near(before_that), -out).otherwise(out)


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(-2), F.least(F.lit(2), score))


def score_sentiment(df: DataFrame, aggregate: bool = True) -> DataFrame:
    """Tokens and sentences get ``sentiment``; column ``sentiment`` is the sum over sentences if ``aggregate``, else null."""
    if (out := chains.extended(df, "mood", aggregate)) is not None:
        return out

    def over(ts: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before, before_that = F.when(t["token_index"] > 1, at(ts, i - 1)), F.when(t["token_index"] > 2, at(ts, i - 2))
            return t.withField("sentiment", token_sentiment(t, before, before_that))

        return F.transform(ts, one)

    scored = df.withColumn("tokens", let(F.col("tokens"), over))
    total = lambda ts: F.aggregate(ts, F.lit(0), lambda a, t: a + t["sentiment"])
    per_sentence = let(
        F.col("tokens"),
        lambda ts: F.transform(
            F.col("sents"),
            lambda s: s.withField("sentiment", clamp(total(drop_take(ts, s["token_range"]["begin"], s["token_range"]["end"])))),
        ),
    )
    scored = scored.withColumn("sents", per_sentence)
    whole = F.aggregate("sents", F.lit(0), lambda a, s: a + s["sentiment"]) if aggregate else F.lit(None).cast("int")
    return scored.withColumn("sentiment", whole)
