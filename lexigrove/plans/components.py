"""Pipeline components: their descriptions, constructors and the transforms that they stand for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from lexigrove.operators import entities, morphology, patterns, roles, sentiment, syntax, tokens


@dataclass(frozen=True)
class Component:
    """One annotator with its options. ``parser``: the library that runs it."""

    component: str
    parser: str
    options: dict[str, Any] = field(default_factory=dict)

    def as_dict(self) -> dict[str, Any]:
        return {"component": self.component, "parser": self.parser} | self.options


def tokenize(lang: str = "en", only_whitespace: bool = False) -> Component:
    """Split an utterance into tokens with character offsets."""
    return Component("tokenize", "rules", {"lang": lang, "only_whitespace": only_whitespace})


def sentence() -> Component:
    """Group tokens into sentences."""
    return Component("sents", "rules")


def part_of_speech(pos_model_resource: str = "lexicon") -> Component:
    """Tag tokens with parts of speech; a resource is the path of a lexicon of one's own."""
    return Component("pos", "rules", {"pos_model_resource": pos_model_resource})


def morphology_() -> Component:
    """Find the lemma of each token."""
    return Component("morph", "rules")


def stopword() -> Component:
    """Flag stop words by form and by lemma."""
    return Component("stopword", "rules")


def named_entity_recognizer(paths: list[str] | None = None, lang: str = "ENGLISH") -> Component:
    """Tag named entities and group them into mentions; paths are lexicons of one's own."""
    return Component("ner", "rules", {"ner_model_paths": paths, "lang": lang})


def token_regex(rules: list | None = None) -> Component:
    """Match token patterns: rules or paths of rule files, or lists of them for annotators that run one after another."""
    return Component("tok-re", "rules", {"rules": rules or []})


def parse_tree(include_score: bool = False, maxtime: int | None = None, use_shift_reduce: bool = False, language: str = "english") -> Component:
    """Build constituency trees."""
    options = {"include_score": include_score, "maxtime": maxtime, "use_shift_reduce": use_shift_reduce, "language": language}
    return Component("parse-tree", "rules", options)


def dependency_parse_tree() -> Component:
    """Build dependency trees."""
    return Component("dependency-parse-tree", "rules")


def natural_logic() -> Component:
    """Mark polarity and the operators of quantifiers."""
    return Component("natlog", "rules")


def sentiment_(aggregate: bool = True) -> Component:
    """Score the sentiment of tokens and sentences, and of the utterance if ``aggregate``."""
    return Component("sentiment", "rules", {"aggregate": aggregate is True})


def coreference() -> Component:
    """Chain mentions and pronouns that stand for the same thing."""
    return Component("coref", "rules")


def semantic_role_labeler(lang: str = "en", first_label_token_threshold: int = roles.SHORT_SENTENCE) -> Component:
    """Label predicates and their arguments."""
    return Component("srl", "srl", {"lang": lang, "model_type": f"general-{lang}", "first_label_token_threshold": first_label_token_threshold})


#: Constructors by the name that configuration strings use.
RULE_CONSTRUCTORS: dict[str, Callable[..., Component]] = {
    "tokenize": tokenize,
    "sentence": sentence,
    "part-of-speech": part_of_speech,
    "morphology": morphology_,
    "stopword": stopword,
    "named-entity-recognizer": named_entity_recognizer,
    "token-regex": token_regex,
    "parse-tree": parse_tree,
    "dependency-parse-tree": dependency_parse_tree,
    "natural-logic": natural_logic,
    "sentiment": sentiment_,
    "coreference": coreference,
}
ROLE_CONSTRUCTORS: dict[str, Callable[..., Component]] = {"semantic-role-labeler": semantic_role_labeler}

#: What the default pipeline of the rules library has; token patterns need rules and are added by hand.
DEFAULT_RULES = [k for k in RULE_CONSTRUCTORS if k != "token-regex"]


def _patterns(df: DataFrame, rules: list, text_col: str) -> DataFrame:
    from lexigrove.sources.rules import read_rules

    for chain in rules if rules and isinstance(rules[0], list) else [rules]:
        known = [x for r in chain for x in (read_rules(df.sparkSession, r) if isinstance(r, str) else [r])]
        df = patterns.match_patterns(df, known, text_col)
    return df


def _lexicon(df: DataFrame, paths: list[str] | None) -> dict[str, str] | None:
    from lexigrove.sources.lexicons import read_lexicon

    return read_lexicon(df.sparkSession, *paths) if paths else None


def run_rules(df: DataFrame, component: Component, text_col: str) -> DataFrame:
    """Adds what a component of the rules library stands for; components of other libraries change nothing."""
    o = component.options
    match component.component:
        case "tokenize":
            return tokens.tokenize(df, text_col, o["lang"], o["only_whitespace"])
        case "sents":
            return tokens.split_sentences(df)
        case "pos":
            return morphology.tag_parts_of_speech(df, _lexicon(df, [x] if (x := o["pos_model_resource"]) != "lexicon" else None))
        case "morph":
            return morphology.add_lemmas(df)
        case "stopword":
            return morphology.flag_stop_words(df, o.get("lang", "en"))
        case "ner":
            return entities.recognize_entities(df, text_col, _lexicon(df, o["ner_model_paths"]))
        case "tok-re":
            return _patterns(df, o["rules"], text_col)
        case "parse-tree":
            return syntax.add_parse_trees(df, o["include_score"], o["maxtime"], o["use_shift_reduce"], o["language"])
        case "dependency-parse-tree":
            return syntax.add_dependencies(df)
        case "natlog":
            return syntax.add_natural_logic(df)
        case "sentiment":
            return sentiment.score_sentiment(df, o["aggregate"])
        case "coref":
            return roles.resolve_coreference(df)
    return df


def run_roles(df: DataFrame, component: Component, text_col: str) -> DataFrame:
    return roles.label_roles(df, component.options["lang"]) if component.component == "srl" else df
