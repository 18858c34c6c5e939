"""Tokens with offsets, and sentences over them, as array columns inside a row.

Nothing here shuffles: a document's tokens stay in its row, so the same expressions serve batch and streams, and a table
of tokens (:func:`exploded`) is a projection. Offsets are running sums over the gaps between tokens, in code points.
Null text counts as empty and has no tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove import defaults
from lexigrove.functions.arrays import at, let, running_sum
from lexigrove.functions.ranges import range_of
from lexigrove.operators import chains


def _spans(text: Column, pattern: str, clitics: bool) -> Column:
    def placed(words: Column, ends: Column) -> Column:
        def one(word: Column, i: Column) -> Column:
            end = at(ends, i)
            begin = end - F.length(word)
            whole = F.struct(word.alias("text"), begin.alias("begin"), end.alias("end"))
            if not clitics:
                return F.array(whole)
            head = F.regexp_extract(word, defaults.CLITIC, 1)
            cut = begin + F.length(head)
            parts = F.array(
                F.struct(head.alias("text"), begin.alias("begin"), cut.alias("end")),
                F.struct(F.substring(word, F.length(head) + 1, F.length(word)).alias("text"), cut.alias("begin"), end.alias("end")),
            )
            return F.when(word.rlike("['’]") & word.rlike(defaults.CLITIC), parts).otherwise(F.array(whole))

        return F.flatten(F.transform(words, one))

    def over(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        size = lambda x: F.coalesce(F.length(x), F.lit(0))
        ends = lambda w: running_sum(F.zip_with(F.split(t, pattern, -1), w, lambda g, x: size(g) + size(x)))
        return let(words, lambda w: let(ends(w), lambda e: placed(w, e)))

    return let(F.coalesce(text, F.lit("")), over)


def token_array(text: Column, only_whitespace: bool = False) -> Column:
    """``array<struct<text, char_range, token_range>>`` of a text column."""
    pattern = defaults.WHITESPACE_TOKEN if only_whitespace else defaults.TOKEN
    return F.transform(
        _spans(text, pattern, not only_whitespace),
        lambda t, i: F.struct(
            t["text"].alias("text"), range_of(t["begin"], t["end"]).alias("char_range"), range_of(i, i + 1).alias("token_range")
        ),
    )


def tokenize(df: DataFrame, text_col: str = "text", lang: str = "en", only_whitespace: bool = False) -> DataFrame:
    """``df`` with ``tokens``. ``lang`` is kept for annotators that look up words; the pattern serves all languages."""
    return chains.begun(df, text_col, only_whitespace)


def _classes(tokens: Column) -> Column:
    """A letter for each token: E ends a sentence, C may follow an end, x is any other."""

    def one(ts: Column) -> Column:
        def of(t: Column, i: Column) -> Column:
            before = F.lower(at(ts, i - 1)["text"])
            short = (t["text"] == ".") & F.coalesce(before.isin(*defaults.ABBREVIATIONS), F.lit(False))
            end = t["text"].isin(*defaults.SENTENCE_ENDS) & ~short
            return F.when(end, "E").when(t["text"].isin(*defaults.SENTENCE_CLOSERS), "C").otherwise("x")

        return F.array_join(F.transform(ts, of), "")

    return let(tokens, one)


#: A sentence in the letters of its tokens.
SENTENCE = "[^E]*E[EC]*|[^E]+"


def sentence_sizes(tokens: Column) -> Column:
    """Tokens of each sentence."""
    return F.transform(F.regexp_extract_all(_classes(tokens), F.lit(SENTENCE), F.lit(0)), lambda s: F.length(s))


def split_sentences(df: DataFrame) -> DataFrame:
    """Tokens get sent_index (from 0), token_index (from 1 in the sentence) and index_range; ``sents`` lists sentences with
    their text and token range. Runs after :func:`tokenize`."""
    if (out := chains.extended(df, "sen")) is not None:
        return out
    sized = df.withColumn("s_sizes", sentence_sizes(F.col("tokens")))
    numbers = lambda n, s: F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(s.alias("s"), k.alias("k")))
    places = F.flatten(F.transform(F.col("s_sizes"), numbers))
    sized = sized.withColumns(
        {
            "tokens": F.zip_with(
                "tokens",
                places,
                lambda t, p: t.withField("sent_index", p["s"]).withField("token_index", p["k"]).withField("index_range", range_of(p["k"] - 1, p["k"])),
            ),
            "s_ends": running_sum(F.col("s_sizes")),
        }
    )
    sized = sized.withColumn("s_ranges", F.zip_with("s_ends", "s_sizes", lambda e, n: range_of(e - n, e)))
    both = let(F.col("tokens"), lambda ts: F.transform(F.col("s_ranges"), lambda r, i: _sentence(ts, r, i)))
    return sized.withColumn("sents", both).drop("s_sizes", "s_ends", "s_ranges")


def _sentence(tokens: Column, span: Column, index: Column) -> Column:
    chars = range_of(at(tokens, span["begin"])["char_range"]["begin"], at(tokens, span["end"] - 1)["char_range"]["end"])
    return F.struct(index.alias("sent_index"), span.alias("token_range"), chars.alias("char_range"))


def exploded(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each token: ``keys`` and the token's fields. A projection, no shuffle."""
    return elements(df, "tokens", *keys).select(*keys, "x.*")


def elements(df: DataFrame, column: str | Column, *keys: str) -> DataFrame:
    """(keys, x): a row for each element. The filter stands above the generator: a plain explode has one on the array, which
    the optimizer would push below the annotators, to run them once more."""
    return df.select(*keys, F.explode_outer(column).alias("x")).where("x IS NOT NULL")


def exploded_sentences(df: DataFrame, *keys: str) -> DataFrame:
    return elements(df, "sents", *keys).select(*keys, "x.*")
