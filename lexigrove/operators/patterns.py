"""Token patterns: items compiled to rules, rules written to and read from rule files, and matched over token arrays.

A rule is a sequence of token tests. Matching finds every place of every rule inside a row with built-in functions, then
keeps the leftmost, of these the longest, of these the first rule's, and goes on after it, by one ordered fold over the
matches. Nothing shuffles and no Python runs.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.arrays import at, drop_take, first, let
from lexigrove.operators import batch_rules, chains, expressions
from lexigrove.operators.entities import mentions_of

# The characters that a literal inside a regular expression escapes.
SPECIAL = frozenset(".?*+^$[]\\(){}|/")


@dataclass(frozen=True)
class Item:
    """An entry to be found in texts, before it is compiled.

    ``lem_min_len``: length of the content from which its last word is matched by lemma (-1: never). ``case_min_tok``:
    number of words from which case counts (-1: never). ``conj_regexp``: a word ``and`` or ``&`` matches both.
    ``first_det_chop``: a ``the`` at either end is dropped. ``is_regexp``: the content is a rule's expression already.
    """

    content: str
    label: str
    id: int | None = None
    features: dict[str, str | None] | None = None
    lem_min_len: int = -1
    case_min_tok: int = -1
    conj_regexp: bool = True
    is_regexp: bool = False
    first_det_chop: bool = True
    feature_group: str = "$0"


@dataclass(frozen=True)
class Test:
    """A test of one token: ``attribute`` is word, lemma, tag or ner; the whole value has to match."""

    attribute: str
    value: str
    regex: bool


@dataclass(frozen=True)
class Rule:
    """``tests``: for each token, tests that all hold; or ``expression``: the tree of anything beyond a sequence of tokens.
    ``group``: what of the match gets the features."""

    tests: tuple[tuple[Test, ...], ...]
    label: str
    id: int | None = None
    features: dict[str, str] = field(default_factory=dict)
    expression: tuple | None = None
    group: str = "$0"


def escape(text: str) -> str:
    return "".join("\\" + c if c in SPECIAL else c for c in text)


def plural_lemma(word: str) -> str:
    """The singular of a word taken as a plural noun, in its shape: upper case, capitalised or as it is."""
    from lexigrove.operators.morphology import IRREGULAR, STEMS

    lower = word.lower()
    found = next((k for k, forms in IRREGULAR.items() if lower in forms), lower)
    if found == lower:
        for tags, pattern, to in STEMS:
            bare = pattern.replace(r"\p{L}", r"[^\W\d_]")
            if "NNS" in tags and re.search(bare, lower):
                found = re.sub(bare, to.replace("{1}", r"\1"), lower)
                break
    if found == lower:
        return word
    return found.upper() if re.fullmatch("[A-Z]+", word) else found.capitalize() if word[:1].isupper() else found


def compiled(item: Item) -> list[Test]:
    """The token tests of an item that is not a regular expression; none for a lone article."""
    words = re.split(r"\s+", item.content)
    by_lemma = item.lem_min_len != -1 and len(item.content) >= item.lem_min_len
    exact = item.case_min_tok != -1 and len(words) >= item.case_min_tok
    out = []
    for i, word in enumerate(words):
        outer, lemmatize = i in (0, len(words) - 1), by_lemma and i == len(words) - 1
        if lemmatize:
            word = plural_lemma(word)
        if outer and item.first_det_chop and word.lower() == "the":
            continue
        text = word if exact else word.lower()
        replaced = text.replace('""', "/ /")
        if item.conj_regexp and replaced in ("&", "and"):
            replaced = "(?:&|and)"
        if not exact:
            text = replaced if replaced != text else escape(text)
        else:
            text = replaced
        out.append(Test("lemma" if lemmatize else "word", text if exact else f"(?i){text}", not exact))
    return out


def format_features(features: dict[str, str | None]) -> str:
    return ",".join(f"{k}={{{'' if v is None else v}}}" for k, v in features.items())


# Fixed value: the form of a feature in a rule.
FEATURE = r"(.+?)=\{(.+?)\},?"


def parse_features(text: Column) -> Column:
    """``k={v},k={v}`` as a map."""
    keys, values = (F.regexp_extract_all(text, F.lit(FEATURE), F.lit(i)) for i in (1, 2))
    return F.map_from_arrays(keys, values)


def format_rule(item: Item) -> str | None:
    """The line of a rule file for an item, or None if nothing is left of it."""
    if item.is_regexp:
        pattern = item.content
    else:
        tests = compiled(item)
        if not tests:
            return None
        sign = lambda t: "/" if t.regex else '"'
        pattern = " ".join(f"[{{{t.attribute}:{sign(t)}{t.value}{sign(t)}}}]" for t in tests)
    actions = [f'Annotate($0,zstrner,"{item.label}")']
    if item.id is not None:
        actions.append(f'Annotate($0,zstriid,"{item.id}")')
    if item.features:
        actions.append(f'Annotate({item.feature_group},zstrfeat,"{format_features(item.features)}")')
    return f"{{pattern:({pattern}),action:({','.join(actions)})}}"


def feature_values(items: list[Item]) -> dict[str, list[str]]:
    """All values of each feature, in order."""
    out: dict[str, set] = {}
    for item in items:
        for k, v in (item.features or {}).items():
            if v is not None:
                out.setdefault(k, set()).add(v)
    return {k: sorted(v) for k, v in sorted(out.items())}


_TOKEN = re.compile(r"\s*(?:\[\{(?P<tests>.*?)\}\](?=\s|\(|$|\[)|/(?P<regex>(?:\\.|[^/\\])*)/)")
_TEST = re.compile(r"\s*(\w+):(?:\"((?:\\.|[^\"\\])*)\"|/((?:\\.|[^/\\])*)/)\s*;?")


def parse_pattern(text: str) -> tuple[tuple[Test, ...], ...]:
    """Token tests of a rule's expression: a sequence of ``/re/`` and ``[{attribute:/re/;attribute:"value"}]``."""
    at_, out = 0, []
    while at_ < len(text.rstrip()):
        m = _TOKEN.match(text, at_)
        if not m:
            raise ValueError(f"cannot read the pattern from column {at_ + 1}: {text}")
        if m["regex"] is not None:
            out.append((Test("word", m["regex"].replace(r"\/", "/"), True),))
        else:
            tests = tuple(Test(n, r.replace(r"\/", "/") if r is not None else s, r is not None) for n, s, r in _tests(m["tests"]))
            out.append(tests)
        at_ = m.end()
    return tuple(out)


def rule_of(pattern: str, label: str, number: int | None, features: dict[str, str], group: str = "$0") -> Rule:
    """A rule from its expression: a plain sequence of tokens, or with quantifiers, alternatives, groups, any token, negation."""
    try:
        tests = parse_pattern(pattern)
        if tests and group == "$0":
            return Rule(tests, label, number, features)
    except ValueError:
        pass
    tree = expressions.read(pattern, Test)
    expressions.check(tree, group)
    return Rule((), label, number, features, tree, group)


def _tests(text: str):
    at_ = 0
    while at_ < len(text):
        m = _TEST.match(text, at_)
        if not m:
            raise ValueError(f"cannot read the token test: {text}")
        yield m[1], m[2], m[3]
        at_ = m.end()


_RULE = re.compile(r"^\{\s*pattern:\((?P<pattern>.*)\),\s*action:\((?P<actions>.*)\)\}\s*$")
_ACTION = re.compile(r'Annotate\((\$\w+),(\w+),"((?:\\.|[^"\\])*)"\)')


def parse_rule(line: str) -> Rule:
    m = _RULE.match(line)
    if not m:
        raise ValueError(f"not a rule: {line}")
    found = _ACTION.findall(m["actions"])
    actions = {key: value for _, key, value in found}
    group = next((g for g, key, _ in found if key == "zstrfeat"), "$0")
    features = dict(re.findall(FEATURE, actions.get("zstrfeat", "")))
    number = actions.get("zstriid")
    return rule_of(m["pattern"], actions["zstrner"], int(number) if number else None, features, group)


def rules_of(items: list[Item]) -> list[Rule]:
    """Rules of items, without a file between."""
    out = []
    for item in items:
        features = {k: v for k, v in (item.features or {}).items() if v}
        if item.is_regexp:
            out.append(rule_of(item.content, item.label, item.id, features, item.feature_group))
        elif tests := tuple((t,) for t in compiled(item)):
            out.append(Rule(tests, item.label, item.id, features))
    return out


_FIELDS = {"word": "text", "lemma": "lemma", "tag": "pos_tag", "ner": "ner_tag"}


def _one(token: Column, t: Test) -> Column:
    value = token[_FIELDS[t.attribute]]
    return value.rlike(f"^(?:{t.value})$") if t.regex else value == t.value


def _holds(token: Column, tests: tuple[Test, ...]) -> Column:
    return reduce(lambda a, b: a & b, [_one(token, t) for t in tests])


def matches(tokens: Column, rules: list[Rule]) -> Column:
    """``array<struct<begin, less, rule, end, from, to>>``: the matches kept, in order; token positions in the utterance,
    half-open; [from, to) gets the rule's features."""

    def over(ts: Column) -> Column:
        indexes = F.when(F.size(ts) > 0, F.sequence(F.lit(0), F.size(ts) - 1)).otherwise(F.array().cast("array<int>"))

        def places(number: int, rule: Rule) -> Column:
            if rule.expression is not None:
                return expressions.places(ts, rule.expression, rule.group, number, _one)
            n = len(rule.tests)

            def here(i: Column) -> Column:
                tests = [_holds(at(ts, i + k), t) for k, t in enumerate(rule.tests)]
                if n > 1:
                    tests.append(at(ts, i)["sent_index"] == at(ts, i + n - 1)["sent_index"])
                return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

            def match(i: Column) -> Column:
                return F.struct(i.alias("begin"), F.lit(-n).alias("less"), F.lit(number).alias("rule"), (i + n).alias("end"), i.alias("from"), (i + n).alias("to"))

            return F.transform(F.filter(indexes, here), match)

        found = [places(number, rule) for number, rule in enumerate(rules)]
        ordered = F.array_sort(F.concat(*found))
        none = F.struct(F.lit(0).alias("end"), F.slice(ordered, 1, 0).alias("kept"))

        def keep(acc: Column, m: Column) -> Column:
            more = F.struct(m["end"].alias("end"), F.concat(acc["kept"], F.array(m)).alias("kept"))
            return F.when(m["begin"] >= acc["end"], more).otherwise(acc)

        return F.aggregate(ordered, none, keep, lambda acc: acc["kept"])

    return let(tokens, over)


def match_patterns(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Tokens get tok_re_ner_tag, tok_re_ner_item_id and tok_re_ner_features, and ``tok_re_mentions`` is added. Needs lemmas.

    Called again with other rules, it sees and keeps what earlier ones set, where its own do not match.
    """
    if rules and {"ner", "blank"} & set(chains.steps(df)) and batch_rules.fits(rules, chains.steps(df)):
        if (out := chains.extended(df, "tre", rules, text_col=text_col)) is not None:
            return out
    earlier = "tok_re_ner_tag" in df.schema["tokens"].dataType.elementType.names
    strings = lambda rows: F.array(*[F.lit(x) for x in rows]) if rows else F.array().cast("array<string>")
    grouped = any(r.group != "$0" for r in rules)
    labels, ids = strings([r.label for r in rules]), F.array(*[F.lit(r.id).cast("int") for r in rules]) if rules else None
    maps = [F.create_map(*[F.lit(x) for kv in r.features.items() for x in kv]) if r.features else F.lit(None).cast("map<string,string>") for r in rules]

    def over(ts: Column, kept: Column) -> Column:
        nulls = lambda n: F.array_repeat(F.lit(None).cast("int"), n)
        end_before = lambda k: F.coalesce(at(kept, k - 1)["end"], F.lit(0))
        parts = F.transform(kept, lambda m, k: F.concat(nulls(m["begin"] - end_before(k)), F.array_repeat(m["rule"], m["end"] - m["begin"])))
        rest = nulls(F.size(ts) - end_before(F.size(kept)))
        rule_at = F.transform(F.concat(F.flatten(parts), rest), lambda r: F.struct(r.alias("rule"), r.alias("to")))
        if grouped:  # only a group of the match gets the features
            fill = lambda m: F.array_repeat(F.struct(m["rule"].alias("rule"), F.lit(None).cast("int").alias("to")), m["end"] - m["begin"])
            marks = lambda m: F.transform(fill(m), lambda x, i: x.withField("to", F.when((i + m["begin"] >= m["from"]) & (i + m["begin"] < m["to"]), x["rule"])))
            none = lambda n: F.array_repeat(F.struct(F.lit(None).cast("int").alias("rule"), F.lit(None).cast("int").alias("to")), n)
            parts = F.transform(kept, lambda m, k: F.concat(none(m["begin"] - end_before(k)), marks(m)))
            rule_at = F.concat(F.flatten(parts), none(F.size(ts) - end_before(F.size(kept))))

        def of(t: Column, x: Column) -> Column:
            r, to = x["rule"], x["to"]
            old = (lambda c, kind: t[c]) if earlier else (lambda c, kind: F.lit(None).cast(kind))
            return (
                t.withField("tok_re_ner_tag", F.coalesce(F.get(labels, r), old("tok_re_ner_tag", "string")))
                .withField("tok_re_ner_item_id", F.when(r.isNotNull(), F.get(ids, r)).otherwise(old("tok_re_ner_item_id", "int")))
                .withField("tok_re_ner_features", F.when(r.isNotNull(), F.get(F.array(*maps), to)).otherwise(old("tok_re_ner_features", "map<string,string>")))
            )

        return F.zip_with(ts, rule_at, of)

    if not rules:
        blank = {"tok_re_ner_tag": "string", "tok_re_ner_item_id": "int", "tok_re_ner_features": "map<string,string>"}
        add = lambda t: reduce(lambda a, x: a.withField(x[0], F.lit(None).cast(x[1])), blank.items(), t)
        out = df if earlier else df.withColumn("tokens", F.transform("tokens", add))
    else:
        out = df.withColumn("t_kept", matches(F.col("tokens"), rules))
        out = out.withColumn("tokens", let(F.col("tokens"), lambda ts: let(F.col("t_kept"), lambda kept: over(ts, kept)))).drop("t_kept")
    found = mentions_of(F.col("tokens"), F.col(text_col), "tok_re_ner_tag", ("tok_re_ner_tag", "tok_re_ner_item_id"))
    inside = lambda ts, m: F.transform(drop_take(ts, m["token_range"]["begin"], m["token_range"]["end"]), lambda t: t["tok_re_ner_features"])
    value = lambda ts, m: first(F.filter(inside(ts, m), lambda x: x.isNotNull())) if grouped else at(ts, m["token_range"]["begin"])["tok_re_ner_features"]
    with_features = let(F.col("tokens"), lambda ts: F.transform(found, lambda m: m.withField("tok_re_ner_features", value(ts, m))))
    return out.withColumn("tok_re_mentions", with_features)


def kept_matches(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with ``t_kept``, what :func:`matches` gives."""
    if rules and batch_rules.fits(rules, chains.steps(df)):
        if (out := chains.extended(df, "kept", rules)) is not None:
            return out
    return df.withColumn("t_kept", matches(F.col("tokens"), rules))


def features_json(items: list[Item]) -> str:
    return json.dumps(feature_values(items))
