"""Token patterns over the slices of :mod:`lexigrove.operators.batches`: the rules of :mod:`lexigrove.operators.patterns`."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from lexigrove.operators import expressions
from lexigrove.operators.batches import Slice, listed, struct

_FLAG = re.compile(r"\(\?(i|iu|ui|u)\)")
_CLASSES = ("L", "N", "Lu", "Ll", "P")


@cache
def _characters(kind: str) -> str:
    """A Unicode category as the inside of a character class."""
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)).startswith(kind):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def translated(pattern: str) -> str | None:
    """A pattern of the JVM in Python's syntax, or None if it has anything that might not mean the same."""
    flags = ""
    if m := _FLAG.match(pattern):
        flags, pattern = m[1], pattern[m.end() :]
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if m := re.compile(r"\\p\{(\w+)\}").match(pattern, i):
                if m[1] not in _CLASSES or (flags and m[1] in ("Lu", "Ll")):
                    return None
                out.append(_characters(m[1]) if inside else f"[{_characters(m[1])}]")
                i = m.end()
                continue
            n = pattern[i + 1 : i + 2]
            if not n or (n.isalnum() and (n not in "dwsDWS" or "u" in flags)):
                return None
            out.append(c + n)
            i += 2
            continue
        if inside:
            if c == "[" or pattern.startswith("&&", i) or (c == "]" and pattern[i - 1] in "[^"):
                return None
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(" and pattern.startswith("(?", i) and not pattern.startswith(("(?:", "(?=", "(?!"), i):
            return None
        elif c == ".":
            c = "[^\n\r\x85\u2028\u2029]"
        out.append(c)
        i += 1
    body = "".join(out)
    if "i" in flags:
        body = f"(?i:{body})"
    body = body if "u" in flags else f"(?a:{body})"
    try:
        re.compile(body)
    except re.error:
        return None
    return None if inside else body


@cache
def _matcher(value: str, regex: bool):
    if not regex:
        return value.__eq__
    found = re.compile(f"(?:{translated(value)})")
    return lambda x: found.fullmatch(x) is not None


def tests_of(rule) -> list:
    return expressions.tests_of(rule.expression) if rule.expression is not None else [t for ts in rule.tests for t in ts]


def fits(rules: list, have: list[str]) -> bool:
    """Whether rules can be matched here, with the steps that came before."""
    needed = {"word": "tok", "lemma": "lemma", "tag": "tag"}
    for t in (t for r in rules for t in tests_of(r)):
        if t.regex and translated(t.value) is None or needed.get(t.attribute, "tok") not in have:
            return False
        if t.attribute not in needed and (t.attribute != "ner" or not {"ner", "blank"} & set(have)):
            return False
    return True


def _holds(s: Slice, t) -> np.ndarray:
    test = _matcher(t.value, t.regex)
    match t.attribute:
        case "word":
            return s.of_words(t, test, bool)
        case "lemma":
            return np.fromiter((test(w) for w in s.lemma_list), bool, len(s.lemma_list))[s.lemma_codes]
        case "tag":
            return np.fromiter((test(w) for w in s.tag_names), bool, len(s.tag_names))[s.tag]
    coded = s.fields["ner_tag"].dictionary_encode()
    return np.fromiter((test(w) for w in coded.dictionary.to_pylist()), bool, len(coded.dictionary))[np.asarray(coded.indices)]


def _sequence(s: Slice, rule, held: dict, number: int) -> list[tuple]:
    n, size = len(rule.tests), len(s.codes)
    if size < n:
        return []
    here = np.ones(size - n + 1, bool)
    for k, tests in enumerate(rule.tests):
        for t in tests:
            here &= held[t][k : size - n + 1 + k]
    here &= s.sentence_of[: size - n + 1] == s.sentence_of[n - 1 :]
    return [(b, -n, number, b + n, b, b + n) for b in np.flatnonzero(here).tolist()]


def _expression(s: Slice, rule, held: dict, number: int) -> list[tuple]:
    tests = list(dict.fromkeys(expressions.tests_of(rule.expression)))
    before, inside, after = expressions.parts(rule.expression, rule.group, tests)
    letters = np.full(len(s.codes), expressions.FIRST_LETTER, np.uint32)
    for k, t in enumerate(tests):
        letters += held[t].astype(np.uint32) << k
    starts = s.sentence_at
    text = np.insert(letters, starts, 10).tobytes().decode("utf-32-le")  # each sentence after a line break
    out, lines = [], s.sentence_of + 1
    place = np.zeros(len(text) + 1, np.int64)
    place[np.arange(len(letters)) + lines] = np.arange(len(letters))
    for m in re.compile(f"(?=({before})({inside})({after}))").finditer(text):
        (b, e1), (_, e2), (_, e3) = m.span(1), m.span(2), m.span(3)
        if e3 > b:
            at = int(place[b])
            out.append((at, b - e3, number, at + e3 - b, at + e1 - b, at + e2 - b))
    return out


def _kept(s: Slice, rules: list) -> list[tuple]:
    """The matches kept, in the slice's token numbers: the leftmost, of these the longest, of these the first rule's."""
    held = {t: _holds(s, t) for t in dict.fromkeys(t for r in rules for t in tests_of(r))}
    found = [m for n, r in enumerate(rules) for m in (_sequence if r.expression is None else _expression)(s, r, held, n)]
    out, end = [], 0
    for m in sorted(found):
        if m[0] >= end:
            out.append(m)
            end = m[3]
    return out


def _columns(s: Slice, rules: list) -> np.ndarray:
    return np.array(_kept(s, rules), np.int64).reshape(-1, 6)


def keep(s: Slice, rules: list) -> None:
    """``t_kept``: the matches kept, in token positions of the text."""
    m = _columns(s, rules)
    doc = s.doc[m[:, 0]]
    base = s.offsets[doc]
    made = {k: pa.array(m[:, i] - (base if k not in ("less", "rule") else 0), pa.int32()) for i, k in enumerate(("begin", "less", "rule", "end", "from", "to"))}
    s.lists["t_kept"] = listed(np.searchsorted(doc, np.arange(len(s.texts) + 1)), struct(made))


def match_patterns(s: Slice, rules: list) -> None:
    m = _columns(s, rules)
    rule, to = np.full(len(s.codes), -1), np.full(len(s.codes), -1)
    for b, _, number, e, f, t in m.tolist():
        rule[b:e] = number
        to[f:t] = number
    of = lambda values, kind, at: pa.array([*values, None], kind).take(pa.array(np.where(at < 0, len(rules), at)))
    maps = pa.array([list(r.features.items()) if r.features else None for r in rules] + [None], pa.map_(pa.string(), pa.string()))
    features = lambda at: maps.take(pa.array(np.where(at < 0, len(rules), at)))
    s.fields["tok_re_ner_tag"] = of([r.label for r in rules], pa.string(), rule)
    s.fields["tok_re_ner_item_id"] = of([r.id for r in rules], pa.int32(), rule)
    s.fields["tok_re_ner_features"] = features(to)
    labels, ids = list(dict.fromkeys(r.label for r in rules)), list(dict.fromkeys(r.id for r in rules))
    kinds = np.array([labels.index(r.label) * len(ids) + ids.index(r.id) for r in rules] + [-1])[rule]
    grouped = any(r.group != "$0" for r in rules)
    with_map = np.array([bool(r.features) for r in rules] + [False])

    def more(b: np.ndarray, e: np.ndarray) -> dict:
        at = to[b]
        if grouped:  # the first features in the mention
            marked = np.flatnonzero(with_map[to])
            place = np.searchsorted(marked, b)
            token = np.append(marked, len(to))[place]
            at = np.where(token <= e, np.append(to, -1)[token], -1)
        return {"tok_re_ner_features": features(at)}

    s.lists["tok_re_mentions"] = s.mentions(kinds, "tok_re_ner_tag", ("tok_re_ner_tag", "tok_re_ner_item_id"), more)
