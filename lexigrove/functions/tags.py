"""Tag sets, tag classes and label functions, as constants and column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove.defaults import NONE_LABEL

# Penn Treebank tags with their descriptions.
TAG_DESCRIPTIONS = {
    "CC": "Coordinating conjunction",
    "CD": "Cardinal number",
    "DT": "Determiner",
    "EX": "Existential there",
    "FW": "Foreign word",
    "IN": "Preposition or subordinating conjunction",
    "JJ": "Adjective",
    "JJR": "Adjective, comparative",
    "JJS": "Adjective, superlative",
    "LS": "List item marker",
    "MD": "Modal",
    "NN": "Noun, singular or mass",
    "NNS": "Noun, plural",
    "NNP": "Proper noun, singular",
    "NNPS": "Proper noun, plural",
    "PDT": "Predeterminer",
    "POS": "Possessive ending",
    "PRP": "Personal pronoun",
    "PRP$": "Possessive pronoun",
    "RB": "Adverb",
    "RBR": "Adverb, comparative",
    "RBS": "Adverb, superlative",
    "RP": "Particle",
    "SYM": "Symbol",
    "TO": "to",
    "UH": "Interjection",
    "VB": "Verb, base form",
    "VBD": "Verb, past tense",
    "VBG": "Verb, gerund or present participle",
    "VBN": "Verb, past participle",
    "VBP": "Verb, non-3rd person singular present",
    "VBZ": "Verb, 3rd person singular present",
    "WDT": "Wh-determiner",
    "WP": "Wh-pronoun",
    "WP$": "Possessive wh-pronoun",
    "WRB": "Wh-adverb",
}

# Tags by class, in the order in which a tag's class is looked for.
TAG_TYPES = {
    "noun": ("NN", "NNS", "NNP", "NNPS"),
    "verb": ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ"),
    "adjective": ("JJ", "JJR", "JJS"),
    "adverb": ("RB", "RBR", "RBS", "WRB"),
    "wh": ("WDT", "WRB", "WP", "WP$"),
}

# Tags beside those with a description.
PUNCTUATION_TAGS = ("$", "#", "''", ",", "-LRB-", "-RRB-", ".", ":")

# Tags of words that bear meaning.
GO_TAGS = (
    "RB", "JJ", "JJR", "JJS", "MD", "NN", "NNS", "NNP", "NNPS", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "PRP", "PDT", "POS", "RP", "FW",
)

# Sentiment labels with the scores of their classes.
SENTIMENT_SCORES = {"very positive": 2, "positive": 1, "neutral": 0, "negative": -1, "very negative": -2}

# Labels of semantic roles.
HEAD_FUNCTION_TAGS = ("DIR", "GOL", "LOC", "PAG", "PPT", "PRD", "VSP", "CAU", "MNR", "TMP", "COM", "PRP", "EXT")
HEAD_DEPENDENCY_LABELS = (
    "A0", "A1", "A2", "A3", "A4", "AM-ADV", "AM-DIR", "AM-PRR", "AM-DIS", "AM-EXT", "AM-GOL", "AM-LOC", "AM-MNR", "AM-PRP", "AM-TMP",
    "C-V", "R-A1", "R-AM-TMP", "AM-MOD", "R-AM-GOL", "AM-NEG", "AM-COM", "R-AM-MNR", "C-A1", "AM-CAU", "R-A0", "R-AM-CAU", "AM-PRD",
    "AM-PNC", "R-A2", "R-AM-LOC", "R-AM-PRP", "AM-REC", "R-AM-DIR", "EXT", "R-A3", "R-AM-DIS", "A1-DSP", "R-AM-EXT",
)
DEPENDENCY_LABELS = (
    "advcl", "advmod", "amod", "appos", "attr", "auxpass", "conj", "dep", "dobj", "nn", "npadvmod", "nsubj", "partmod", "pcomp", "pobj",
    "poss", "prep", "root", "xcomp", "ccomp", "nmod", "prt", "punct", "rcmod", "iobj", "num", "mark", "infmod", "cc", "acomp", "oprd",
    "det", "agent", "nsubjpass", "hmod", "aux", "meta", "intj", "parataxis", "csubj", "preconj", "csubjpass", "neg", "number",
    "possessive", "expl", "predet",
)


def pos_tags(kind: str | None = None) -> list[str]:
    """The tags of a class, or all 44; an unknown class is an error."""
    if kind is None:
        return sorted({*TAG_DESCRIPTIONS, *PUNCTUATION_TAGS})
    if kind not in TAG_TYPES:
        raise ValueError(f"no class of tags is called {kind!r}: {', '.join(TAG_TYPES)}")
    return list(TAG_TYPES[kind])


def pos_tag_types() -> list[str]:
    return list(TAG_TYPES)


def pos_description(tag: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TAG_DESCRIPTIONS.items() for x in pair])
    return F.try_element_at(table, tag)


def pos_tag_type(tag: Column) -> Column:
    """The first class that has the tag (so ``WRB`` is an adverb), or null."""
    out = F.lit(None).cast("string")
    for kind, tags in reversed(TAG_TYPES.items()):
        out = F.when(tag.isin(*tags), kind).otherwise(out)
    return out


def pos_tag_or_none(tag: Column) -> Column:
    return F.when(tag.isin(*pos_tags()), tag).otherwise(NONE_LABEL)


def is_go_tag(tag: Column, tags: tuple[str, ...] = GO_TAGS) -> Column:
    return F.coalesce(tag.isin(*tags), F.lit(False))


def sentiment_label(score: Column) -> Column:
    """The label of a whole score; null for null."""
    return (
        F.when(score > 1, "very positive")
        .when(score == 1, "positive")
        .when(score < -1, "very negative")
        .when(score == -1, "negative")
        .when(score == 0, "neutral")
    )


def sentiment_score(label: Column) -> Column:
    """The score of a class's label in any case; null if it is none."""
    out = F.lit(None).cast("int")
    for name, score in SENTIMENT_SCORES.items():
        out = F.when(F.lower(label) == name, score).otherwise(out)
    return out
