"""Accessors over annotated rows, in two forms: column expressions inside a row (no shuffle, fit for streams), and joins of
exploded tables on document and sentence with the range as residual condition."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.arrays import at, drop_take, first, let
from lexigrove.functions.ranges import in_range, overlaps, token_in_range
from lexigrove.functions.tags import GO_TAGS, is_go_tag
from lexigrove.operators import chains
from lexigrove.operators.batches import pairs_met


def token(tokens: Column, index: Column | int, strict: bool = False) -> Column:
    """Token ``index`` from 0: null outside, or an error if ``strict``."""
    return F.element_at(tokens, F.lit(index) + 1) if strict else at(tokens, index)


def sent(sents: Column, index: Column | int) -> Column:
    return at(sents, index)


def sentence_tokens(tokens: Column, sents: Column) -> Column:
    """Tokens by sentence: an array of arrays."""
    return let(tokens, lambda ts: F.transform(sents, lambda s: drop_take(ts, s["token_range"]["begin"], s["token_range"]["end"])))


def tokens_by_sentence(tokens: Column, sents: Column, index: Column | int, begin: Column, end: Column) -> Column:
    """Tokens [begin, end) of a sentence, counted from the sentence's first token."""
    span = at(sents, index)["token_range"]
    return drop_take(tokens, span["begin"] + begin, F.least(span["begin"] + end, span["end"]))


def root_dependency(tokens: Column, edges: Column) -> Column:
    """The token that the first root of the first sentence's dependencies stands for; null without a tree."""
    root = first(F.filter(edges, lambda e: e["parent_token_index"] == 0))
    its = lambda r: lambda t: (t["sent_index"] == r["sent_index"]) & (t["token_index"] == r["token_index"])
    return let(root, lambda r: first(F.filter(tokens, its(r))))  # looked for once, not once more for each token


def mentions(*columns: Column) -> Column:
    """All mentions of several columns, in their order."""
    return F.concat(*[F.coalesce(c, F.slice(c, 1, 0)) for c in columns])


def mentions_for_token(found: Column, one: Column) -> Column:
    """The mentions that cover a token."""
    return F.filter(found, lambda m: in_range(m["token_range"], one["token_range"]))


def tokens_for_mention(tokens: Column, mention: Column) -> Column:
    """The tokens of a mention: in its sentence and its range; null for a null mention."""
    inside = F.filter(tokens, lambda t: (t["sent_index"] == mention["sent_index"]) & token_in_range(t, mention["token_range"]))
    return F.when(mention.isNotNull(), inside)


def token_mentions(tokens: Column, found: Column) -> Column:
    """Every mention with its tokens. Ranges are contiguous, so tokens are sliced, not searched."""
    return let(tokens, lambda ts: F.transform(found, lambda m: m.withField("tokens", drop_take(ts, m["token_range"]["begin"], m["token_range"]["end"]))))


def is_go_word(one: Column, tags: tuple[str, ...] = GO_TAGS) -> Column:
    """Neither a stop word nor of a tag that bears no meaning."""
    return ~F.coalesce(one["stopword"], F.lit(False)) & is_go_tag(one["pos_tag"], tags)


def word_form(one: Column) -> Column:
    return F.lower(one["text"])


def lemma_form(one: Column) -> Column:
    return F.lower(one["lemma"])


def go_word_forms(tokens: Column, form: Callable[[Column], Column] = word_form, tags: tuple[str, ...] = GO_TAGS) -> Column:
    """Forms of the go words, in order."""
    return F.transform(F.filter(tokens, lambda t: is_go_word(t, tags)), form)


def first_propbank_label(tokens: Column) -> Column:
    """The first frame of a predicate among the tokens."""
    return first(F.filter(tokens, lambda t: t["srl"]["propbank"].isNotNull()))["srl"]["propbank"]


def first_sentence_propbank_label(tokens: Column, index: Column | int = 0) -> Column:
    """The first frame of a predicate among a sentence's tokens."""
    return first_propbank_label(F.filter(tokens, lambda t: t["sent_index"] == index))


def tokens_equal(a: Column, b: Column) -> Column:
    return a["text"].eqNullSafe(b["text"]) & a["sent_index"].eqNullSafe(b["sent_index"]) & a["token_range"].eqNullSafe(b["token_range"])


def join_tokens_mentions(tokens: DataFrame, found: DataFrame, keys: list[str], how: str = "inner", same_sentence: bool = True) -> DataFrame:
    """Exploded tokens with the mentions that cover them. ``found`` brings its columns under the prefix ``m_``.

    An equi-join on the document (and sentence), so it shuffles or broadcasts by key; the range is a residual condition.
    """
    renamed = found.select(*keys, *[F.col(c).alias(f"m_{c}") for c in found.columns if c not in keys])
    on = [tokens[k] == renamed[k] for k in keys]
    if same_sentence:
        on.append(tokens["sent_index"] == renamed["m_sent_index"])
    on.append(in_range(renamed["m_token_range"], tokens["token_range"]))
    joined = tokens.join(renamed, on, how)
    for k in keys:
        joined = joined.drop(renamed[k])
    return joined


def overlapping_mentions(found: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a document's mentions that overlap (ends count), each pair once. ``found`` needs ``mention_id``."""
    a, b = found.alias("a"), found.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    on += [F.col("a.mention_id") < F.col("b.mention_id"), overlaps(F.col("a.token_range"), F.col("b.token_range"))]
    return a.join(b, on).select(*[F.col(f"a.{k}") for k in keys], F.col("a.mention_id").alias("a_id"), F.col("b.mention_id").alias("b_id"))


def overlap_count(spans: Column) -> Column:
    """Pairs of an array of ranges that overlap (ends count), as long (:func:`batches.pairs_met`)."""

    @F.arrow_udf("bigint")
    def run(spans: pa.Array) -> pa.Array:
        flat, sizes = spans.flatten(), pc.fill_null(pc.list_value_length(spans), 0)
        row = np.repeat(np.arange(len(spans)), np.asarray(sizes))
        return pa.array(pairs_met(row, np.asarray(flat.field("begin")), np.asarray(flat.field("end")), len(spans)))

    return run.asNondeterministic()(spans)


def overlap_pairs_of(df: DataFrame) -> tuple[DataFrame, Column]:
    """A table and the pairs of its rows' mentions, those of patterns among them, that overlap; counted where annotators run
    together, so that no second Python worker stands beside each of theirs."""
    out = chains.extended(df, "pairs")
    if out is None:
        spans = lambda column: F.transform(column, lambda m: m["token_range"])
        return df, overlap_count(mentions(spans("mentions"), spans("tok_re_mentions")))
    return chains.only(out, "overlap_pairs"), first(F.col("overlap_pairs"))


def with_words(tokens: DataFrame, words: DataFrame, column: str = "word", how: str = "left_semi") -> DataFrame:
    """Tokens whose lower-cased text is in a table of words (``left_semi``), or is not (``left_anti``)."""
    return tokens.join(words, F.lower(tokens["text"]) == words[column], how)
