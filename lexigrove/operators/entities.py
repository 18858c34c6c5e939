"""Named entities by word lists and patterns, and mentions as runs of equal tags inside a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.arrays import at, let
from lexigrove.functions.ranges import range_of
from lexigrove.operators import chains
from lexigrove.operators.morphology import label_in

MONTHS = "january february march april may june july august september october november december".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
CURRENCIES = "dollar dollars euro euros pound pounds cents yen".split()
TITLES = "mr mrs ms dr prof sir lady president".split()
FIRST_NAMES = (
    "james john robert michael william david richard joseph thomas charles paul mark george kenneth steven edward brian ronald"
    " anthony kevin jason matthew gary timothy mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa"
    " margaret betty sandra ashley dorothy kimberly emily donna michelle carol amanda melissa deborah teddy anna peter maria jean"
    " pierre hans carlos juan luis ishmael"
).split()
PLACES = (
    "africa america asia australia austria belgium berlin boston brazil britain canada chicago china england europe france germany"
    " greece india ireland italy japan london madrid manhattan mexico moscow munich paris poland portugal rome russia scotland spain"
    " sweden switzerland tokyo turkey ukraine vienna wales washington"
).split()
COMPANY_ENDS = "inc corp ltd llc gmbh plc company corporation".split()
YEAR = r"^(?:1[0-9]{3}|20[0-9]{2})$"

MENTION_FIELDS = ("text", "entity_type", "ner_tag", "normalized_tag", "sent_index", "token_range", "char_range")


def entity_tag(token: Column, before: Column, after: Column) -> Column:
    """``O`` or the entity's kind. ``before`` and ``after`` are the neighbours in the sentence, or null."""
    text, tag = token["text"], token["pos_tag"]
    lower, left, right = F.lower(text), F.coalesce(F.lower(before["text"]), F.lit("")), F.coalesce(F.lower(after["text"]), F.lit(""))
    number, proper = text.rlike(r"^\p{N}"), tag.isin("NNP", "NNPS") | text.rlike(r"^\p{Lu}")
    return (
        F.when(number & (left.isin("$", "€", "£") | right.isin(*CURRENCIES)), "MONEY")
        .when(number & right.isin("%", "percent"), "PERCENT")
        .when(number & (text.rlike(YEAR) | left.isin(*MONTHS) | right.isin(*MONTHS)), "DATE")
        .when(number | (tag == "CD"), "NUMBER")
        .when(text.isin("$", "€", "£") & right.rlike(r"^\p{N}"), "MONEY")
        .when(lower.isin(*CURRENCIES) & left.rlike(r"^\p{N}"), "MONEY")
        .when(lower.isin("%", "percent") & left.rlike(r"^\p{N}"), "PERCENT")
        .when(lower.isin(*DAYS) & proper, "DATE")
        .when(lower.isin(*MONTHS) & (lower != "may") & proper, "DATE")
        .when(lower.isin(*PLACES) & proper, "LOCATION")
        .when(proper & (lower.isin(*COMPANY_ENDS) | right.isin(*COMPANY_ENDS)), "ORGANIZATION")
        .when(lower.isin(*FIRST_NAMES) & text.rlike(r"^\p{Lu}"), "PERSON")
        .when(tag.isin("NNP", "NNPS") & (left.isin(*FIRST_NAMES) | left.isin(*TITLES)), "PERSON")
        .otherwise("O")
    )


def normalized(text: Column, ner_tag: Column) -> Column:
    """A number without separators of thousands, for numeric entities."""
    return F.when(ner_tag.isin("NUMBER", "MONEY", "PERCENT") & text.rlike(r"^[0-9]"), F.regexp_replace(text, ",", ""))


def recognize_entities(df: DataFrame, text_col: str = "text", lexicon: dict[str, str] | None = None) -> DataFrame:
    """Tokens get ner_tag, entity_type and normalized_tag; ``mentions`` is added. Runs after part-of-speech tagging. Words of a
    lexicon of one's own have its tag."""
    if (out := chains.extended(df, "ner", lexicon, text_col=text_col)) is not None:
        return out
    own = label_in(lexicon)

    def one(ts: Column) -> Column:
        def of(t: Column, i: Column) -> Column:
            before = F.when(t["token_index"] > 1, at(ts, i - 1))
            after = at(ts, i + 1)
            after = F.when(after["sent_index"] == t["sent_index"], after)
            return t.withField("ner_tag", F.coalesce(own(t["text"]), entity_tag(t, before, after)))

        return F.transform(ts, of)

    tagged = let(F.col("tokens"), one)
    typed = F.transform(
        tagged,
        lambda t: t.withField("entity_type", F.when(t["ner_tag"] != "O", t["ner_tag"])).withField("normalized_tag", normalized(t["text"], t["ner_tag"])),
    )
    out = df.withColumn("tokens", typed)
    return out.withColumn("mentions", mentions_of(F.col("tokens"), F.col(text_col), "ner_tag"))


def without_entities(df: DataFrame) -> DataFrame:
    """Tokens get an ``ner_tag`` of ``O`` and no normalized_tag, which mentions of patterns carry."""
    if (out := chains.extended(df, "blank")) is not None:
        return out
    blank = lambda t: t.withField("ner_tag", F.lit("O")).withField("normalized_tag", F.lit(None).cast("string"))
    return df.withColumn("tokens", F.transform("tokens", blank))


def mentions_of(tokens: Column, text: Column, field: str, extra: tuple[str, ...] = ()) -> Column:
    """Runs of tokens in a sentence whose ``field`` is equal, neither null nor ``O``, as mentions in order.

    A mention's text is cut anew from the utterance by its character range. ``extra``: fields that a run shares too.
    """

    def over(ts: Column) -> Column:
        def inside(t: Column) -> Column:
            return F.coalesce(t[field] != "O", F.lit(False))

        def same(a: Column, b: Column) -> Column:
            out = (a[field] == b[field]) & (a["sent_index"] == b["sent_index"])
            for x in extra:
                out = out & a[x].eqNullSafe(b[x])
            return F.coalesce(out, F.lit(False))

        indexes = F.sequence(F.lit(0), F.size(ts) - 1)
        begins = F.filter(indexes, lambda i: inside(at(ts, i)) & ((i == 0) | ~same(at(ts, i - 1), at(ts, i))))
        ends = F.filter(indexes, lambda i: inside(at(ts, i)) & ((i == F.size(ts) - 1) | ~same(at(ts, i), at(ts, i + 1))))
        return F.when(F.size(ts) > 0, F.zip_with(begins, ends, lambda b, e: _mention(ts, text, b, e, field, extra))).otherwise(
            F.transform(F.slice(F.array(F.lit(0)), 1, 0), lambda b: _mention(ts, text, b, b, field, extra))
        )

    return let(tokens, over)


def _mention(ts: Column, text: Column, begin: Column, end: Column, field: str, extra: tuple[str, ...]) -> Column:
    head, tail = at(ts, begin), at(ts, end)
    chars = range_of(head["char_range"]["begin"], tail["char_range"]["end"])
    return F.struct(
        F.substring(text, chars["begin"] + 1, chars["end"] - chars["begin"]).alias("text"),
        head[field].alias("entity_type"),
        head["ner_tag"].alias("ner_tag"),
        head["normalized_tag"].alias("normalized_tag"),
        head["sent_index"].alias("sent_index"),
        range_of(head["token_range"]["begin"], tail["token_range"]["end"]).alias("token_range"),
        chars.alias("char_range"),
        *[head[x].alias(x) for x in extra],
    )
