"""Expressions over tokens: quantifiers, alternatives, groups, any token and negation, as regular expressions over letters.

The distinct tests of an expression are numbered, and each token becomes one letter that stands for the set of tests which it
passes; a token of the expression is then a class of letters, and all the rest of the syntax is that of regular expressions.
Sentences are lines, so no match crosses one. Every start is found, by a look-ahead that writes the match where it begins.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove.functions.arrays import at, let, running_sum

#: Tests in one expression; a letter stands for each of the 2 ** MOST_TESTS sets at most.
MOST_TESTS = 10
FIRST_LETTER = 0x4E00
_QUANTIFIER = re.compile(r"([?*+]|\{\d+(?:,\d*)?\})([?+]?)")
_GROUP_NAME = re.compile(r"\?\$?<?(\w+)>?\s")


class _Reader:
    def __init__(self, text: str, test):
        self.text, self.at, self.test, self.groups = text, 0, test, 0

    def blank(self) -> None:
        while self.text[self.at : self.at + 1].isspace():
            self.at += 1

    def take(self, sign: str) -> bool:
        self.blank()
        if self.text.startswith(sign, self.at):
            self.at += len(sign)
            return True
        return False

    def fail(self):
        raise ValueError(f"cannot read the pattern from column {self.at + 1}: {self.text}")

    def alternatives(self):
        found = [self.sequence()]
        while self.take("|"):
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        found = []
        while True:
            self.blank()
            if self.at >= len(self.text) or self.text[self.at] in "|)":
                break
            found.append(self.quantified())
        if not found:
            self.fail()
        return found[0] if len(found) == 1 else ("seq", found)

    def quantified(self):
        node = self.atom()
        while m := _QUANTIFIER.match(self.text, self.at):
            self.at = m.end()
            node = ("rep", node, m[0])
        return node

    def atom(self):
        if self.take("("):
            if self.take("?:"):
                node = self.alternatives()
            else:
                m = _GROUP_NAME.match(self.text, self.at)
                if m:
                    self.at = m.end()
                self.groups += 1
                number = self.groups
                node = ("group", {str(number), m[1]} if m else {str(number)}, self.alternatives())
            if not self.take(")"):
                self.fail()
            return node
        if self.take("["):
            if self.take("]"):
                return ("token", ("any",))
            node = self.either()
            if not self.take("]"):
                self.fail()
            return ("token", node)
        m = re.compile(r"/((?:\\.|[^/\\])*)/|\"((?:\\.|[^\"\\])*)\"").match(self.text, self.at)
        if not m:
            self.fail()
        self.at = m.end()
        return ("token", ("test", self.test("word", m[1].replace(r"\/", "/") if m[1] is not None else m[2], m[1] is not None)))

    def either(self):
        found = [self.both()]
        while self.take("|"):
            found.append(self.both())
        return found[0] if len(found) == 1 else ("or", found)

    def both(self):
        found = [self.one()]
        while self.take("&"):
            found.append(self.one())
        return found[0] if len(found) == 1 else ("and", found)

    def one(self):
        if self.take("!"):
            return ("not", self.one())
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                self.fail()
            return node
        if not self.take("{"):
            self.fail()
        found, form = [], re.compile(r"\s*(!?)(\w+):(?:\"((?:\\.|[^\"\\])*)\"|/((?:\\.|[^/\\])*)/)\s*;?\s*")
        while not self.take("}"):
            m = form.match(self.text, self.at)
            if not m:
                self.fail()
            self.at = m.end()
            node = ("test", self.test(m[2], m[3] if m[3] is not None else m[4].replace(r"\/", "/"), m[3] is None))
            found.append(("not", node) if m[1] else node)
        return ("and", found) if len(found) != 1 else found[0]


def read(text: str, test) -> tuple:
    """The tree of an expression; ``test(attribute, value, is_regex)`` makes a token test."""
    reader = _Reader(text.strip(), test)
    node = reader.alternatives()
    if reader.at < len(reader.text):
        reader.fail()
    return node


def tests_of(node) -> list:
    if isinstance(node, list):
        return [t for x in node for t in tests_of(x)]
    if node[0] == "test":
        return [node[1]]
    return [t for x in node[1:] if isinstance(x, tuple | list) for t in tests_of(x)]


def _passes(node, held: set) -> bool:
    match node[0]:
        case "any":
            return True
        case "test":
            return node[1] in held
        case "not":
            return not _passes(node[1], held)
        case "and":
            return all(_passes(x, held) for x in node[1])
    return any(_passes(x, held) for x in node[1])


def _letters(node, tests: list) -> str:
    sets = range(1 << len(tests))
    good = [n for n in sets if _passes(node, {t for i, t in enumerate(tests) if n >> i & 1})]
    if not good:
        return "(?!)"
    runs = [[n for _, n in g] for _, g in groupby(enumerate(good), lambda x: x[1] - x[0])]
    return "[" + "".join(f"{chr(FIRST_LETTER + r[0])}-{chr(FIRST_LETTER + r[-1])}" for r in runs) + "]"


def _pattern(node, tests: list) -> str:
    match node[0]:
        case "token":
            return _letters(node[1], tests)
        case "seq":
            return "".join(_pattern(x, tests) for x in node[1])
        case "alt":
            return "(?:" + "|".join(_pattern(x, tests) for x in node[1]) + ")"
        case "rep":
            return f"(?:{_pattern(node[1], tests)}){node[2]}"
    return f"(?:{_pattern(node[2], tests)})"


def parts(node, group: str, tests: list) -> tuple[str, str, str]:
    """Patterns before, in and after a group, which stands in the outermost sequence."""
    name = group.lstrip("$")
    if name == "0":
        return "", _pattern(node, tests), ""
    parts = node[1] if node[0] == "seq" else [node]
    for i, part in enumerate(parts):
        if part[0] == "group" and name in part[1]:
            return tuple("".join(_pattern(x, tests) for x in xs) for xs in (parts[:i], [part], parts[i + 1 :]))
    raise ValueError(f"features can go to a group of the outermost sequence only, not to {group}")


def check(node, group: str) -> None:
    """Raises ValueError if the expression cannot be matched."""
    if len(dict.fromkeys(tests_of(node))) > MOST_TESTS:
        raise ValueError(f"more than {MOST_TESTS} different tests in a pattern")
    parts(node, group, list(dict.fromkeys(tests_of(node))))


def places(tokens: Column, node, group: str, number: int, holds) -> Column:
    """All matches: ``array<struct<begin, less, rule, end, from, to>>``; [from, to) is the group. ``holds(token, test)``: a condition."""
    tests = list(dict.fromkeys(tests_of(node)))
    letters = F.array(*[F.lit(chr(FIRST_LETTER + n)) for n in range(1 << len(tests))])
    before, inside, after = parts(node, group, tests)

    def written(ts: Column) -> Column:
        def of(t: Column, i: Column) -> Column:
            held = [F.when(holds(t, x), 1 << k).otherwise(0) for k, x in enumerate(tests)]
            letter = F.get(letters, reduce(lambda a, b: a + b, held, F.lit(0)))
            new = F.coalesce(t["sent_index"] != at(ts, i - 1)["sent_index"], F.lit(False))
            return F.when(new, F.concat(F.lit("\n"), letter)).otherwise(letter)

        return F.split(F.array_join(F.transform(ts, of), ""), "\n")

    def in_sentence(s: Column, base: Column) -> Column:
        marked = F.regexp_replace(s, f"(?=({before})({inside})({after}))", "\x01$1\x03$2\x03$3\x02")

        def found(pieces: Column) -> Column:
            plain = F.transform(pieces, lambda p: F.length(F.substring_index(p, "\x02", -1)))

            def match(p: Column, end: Column) -> Column:
                # a piece is the match in three parts and the letters up to the next start
                parts = F.split(F.substring_index(p, "\x02", 1), "\x03")
                begin = base + end - F.length(F.substring_index(p, "\x02", -1))
                n = [F.length(F.get(parts, F.lit(k))) for k in range(3)]
                size = n[0] + n[1] + n[2]
                return F.struct(
                    begin.alias("begin"), (-size).alias("less"), F.lit(number).alias("rule"), (begin + size).alias("end"),
                    (begin + n[0]).alias("from"), (begin + n[0] + n[1]).alias("to"),
                )

            made = F.zip_with(pieces, running_sum(plain), lambda p, e: F.when(p.contains("\x02"), match(p, e)))
            return F.filter(made, lambda m: m.isNotNull() & (m["less"] < 0))

        return let(F.split(marked, "\x01"), found)

    def over(sentences: Column) -> Column:
        sizes = F.transform(sentences, lambda s: F.length(s))
        bases = F.zip_with(running_sum(sizes), sizes, lambda e, n: e - n)
        return F.flatten(F.zip_with(sentences, bases, in_sentence))

    return let(written(tokens), over)
