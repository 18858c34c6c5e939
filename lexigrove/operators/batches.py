"""The annotators over whole Arrow batches: the rules of the column expressions, for all tokens of a slice of texts at once.

A lambda of an array expression is interpreted for each token, and its lists of words and patterns with it. Here a slice's texts
are one array of code points, its tokens are numbers of distinct words, rules on a word's form run once for a word, and rules on
neighbours are array operations. What a slice holds is bounded (:data:`SLICE`), so memory does not grow with a batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexigrove import defaults
from lexigrove.functions.tags import TAG_TYPES
from lexigrove.operators import entities as en
from lexigrove.operators import morphology as mo

#: Bytes of text that are annotated at once, unless one text has more.
SLICE = 1 << 20
#: Distinct words whose properties are kept between slices.
KEPT_WORDS = 400_000

_SPACES = " \t\n\x0b\f\r"
_RANGE = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _NUMBER
    out[[ord(c) for c in _SPACES]] = _SPACE
    return out


@cache
def _first_classes() -> bytes:
    return _classes()[:256].tobytes()


def _classes_of(text: str, cp: np.ndarray) -> np.ndarray:
    """The class of each code point of a text; a look-up of bytes costs a tenth of one of code points."""
    out = np.frombuffer(bytearray(text.encode("latin-1", "replace").translate(_first_classes())), np.uint8)
    rest = np.flatnonzero(cp > 255)
    out[rest] = _classes()[cp[rest]]
    return out


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[list[str]]:
    """The texts of a batch (null: empty) in lists of about ``size`` bytes."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    begin = 0
    while begin < len(texts):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + size, "right")))
        part = texts.slice(begin, end - begin)
        try:
            found = part.to_pylist()
        except UnicodeDecodeError:
            found = [x if x is None else x.decode("utf-8", "replace") for x in part.cast(pa.binary()).to_pylist()]
        yield [x or "" for x in found]
        begin = end


def _before(values: np.ndarray, empty) -> np.ndarray:
    out = np.empty_like(values)
    out[:1] = empty
    out[1:] = values[:-1]
    return out


def _after(values: np.ndarray, empty) -> np.ndarray:
    out = np.empty_like(values)
    out[-1:] = empty
    out[:-1] = values[1:]
    return out


def _run_starts(mask: np.ndarray) -> np.ndarray:
    return mask & ~_before(mask, False)


def _token_starts(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the tokens of :data:`defaults.TOKEN` begin; every character but white space is in one."""
    letter, number = kind == _LETTER, kind == _NUMBER
    dash, dot = cp == ord("-"), cp == ord(".")
    joins_words = ((cp == ord("'")) | (cp == ord("’")) | dash) & _before(letter, False) & _after(letter, False)
    joins_numbers = (dot | (cp == ord(",")) | (cp == ord(":")) | (cp == ord("/")) | dash) & _before(number, False) & _after(number, False)
    word, figure = letter | joins_words, number | joins_numbers
    dash &= ~(joins_words | joins_numbers)
    dot &= ~joins_numbers
    single = (kind != _SPACE) & ~(word | figure | dash | dot)
    starts = _run_starts(word) | _run_starts(figure) | _run_starts(dash) | single
    at = np.flatnonzero(dot)
    if len(at):  # three dots in a row are one token
        new = np.empty(len(at), bool)
        new[:1] = True
        new[1:] = np.diff(at) > 1
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        place, whole = np.arange(len(at)) - np.repeat(first, size), np.repeat(size // 3 * 3, size)
        starts[at] = (place >= whole) | (place % 3 == 0)
    return starts


@cache
def _upper(first: str) -> bool:
    return unicodedata.category(first) == "Lu"


def _is_number(first: str) -> bool:
    return unicodedata.category(first)[0] == "N"


def _bare(pattern: str) -> str:
    return pattern.replace(r"\p{L}", r"[^\W\d_]")


_CLITIC = re.compile(defaults.CLITIC)
_SIGNS = {s: tag for tag, signs in reversed(mo.SIGNS) for s in signs}
_LEXICON = {w: tag for tag, words in reversed(mo.LEXICON) for w in words}
_SUFFIXES = [(tag, re.compile(_bare(p))) for tag, p in mo.SUFFIXES]
_IRREGULAR = {w: lemma for lemma, forms in reversed(mo.IRREGULAR.items()) for w in forms}
_STEM_TAGS = frozenset(t for tags, _, _ in mo.STEMS for t in tags)
_STEMS = [(frozenset(tags), re.compile(_bare(p)), to.replace("{1}", r"\1"), to == "{1}" and p.endswith(("ed$", "ing$"))) for tags, p, to in mo.STEMS]
_DOUBLED = re.compile(_bare(mo.DOUBLED))
_YEAR = re.compile(en.YEAR)

#: Properties of a word in lower case, by bit.
_WORDS = [
    {"do", "does", "did"}, set(mo.SINGULAR), set(mo.PRONOUN_LIKE), set(mo.AUXILIARY), {"like"}, {"is", "has", "does", "was"},
    {"$", "€", "£"}, set(en.CURRENCIES), {"%", "percent"}, set(en.MONTHS), set(en.MONTHS) - {"may"}, set(en.DAYS), set(en.PLACES),
    set(en.COMPANY_ENDS), set(en.FIRST_NAMES), set(en.TITLES),
]
(DO, SINGULAR, PRONOUN, AUXILIARY, LIKE, KEPT_S, SIGN, CURRENCY, PERCENT, MONTH, SURE_MONTH, DAY, PLACE, COMPANY, NAME, TITLE) = (1 << i for i in range(16))
ENDS_S, NUMBER, UPPER, YEAR, SIGN_EXACT, DIGIT, SENTENCE_END, CLOSER, PERIOD, ABBREVIATION = (1 << i for i in range(16, 26))
_FLAGS: dict[str, int] = {}
for _i, _words in enumerate(_WORDS):
    for _w in _words:
        _FLAGS[_w] = _FLAGS.get(_w, 0) | 1 << _i
_ABBREVIATIONS = frozenset(defaults.ABBREVIATIONS)


def base_tags(word: str) -> tuple[str, str]:
    """The tags by form at a sentence's begin and elsewhere (:func:`morphology.base_tag`)."""
    if word in _SIGNS:
        return (_SIGNS[word],) * 2
    lower = word.lower()
    if not any(c.isalpha() for c in word):
        return ("CD",) * 2 if _is_number(word[0]) else ("SYM",) * 2
    if lower in ("'s", "’s"):
        return ("POS",) * 2
    known = _LEXICON.get(lower)
    tag = known or next((t for t, p in _SUFFIXES if p.search(lower)), "NN")
    if _upper(word[0]) and lower != "i" and known is None:
        return tag, "NNPS" if len(word) > 1 and word[-1] == "s" != word[-2] else "NNP"
    return tag, tag


def lemma(word: str, tag: str) -> str:
    """:func:`morphology.lemma_of`."""
    if tag in ("NNP", "NNPS"):
        return word
    lower = word.lower()
    if lower in _IRREGULAR:
        return _IRREGULAR[lower]
    if tag in _STEM_TAGS:
        for tags, pattern, to, doubled in _STEMS:
            if tag in tags and pattern.search(lower):
                stem = pattern.sub(to, lower)
                return stem[:-1] if doubled and _DOUBLED.search(stem) else stem
    return lower


def flags_of(word: str) -> int:
    lower = word.lower()
    out = _FLAGS.get(lower, 0)
    if lower.endswith("s"):
        out |= ENDS_S
    if _is_number(word[0]):
        out |= NUMBER | (YEAR if _YEAR.search(word) else 0) | (DIGIT if "0" <= word[0] <= "9" else 0)
    if _upper(word[0]):
        out |= UPPER
    if word in ("$", "€", "£"):
        out |= SIGN_EXACT
    if word in defaults.SENTENCE_ENDS:
        out |= SENTENCE_END | (PERIOD if word == "." else 0)
    if word in defaults.SENTENCE_CLOSERS:
        out |= CLOSER
    if lower in _ABBREVIATIONS:
        out |= ABBREVIATION
    return out


class Vocabulary:
    """Distinct words with numbers, and properties by number that are found once for a word. It starts anew beyond
    :data:`KEPT_WORDS`, between slices."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.words: list[str] = []
        self.known: dict = {}

    def number(self, words: list[str]) -> np.ndarray:
        find, own = self.numbers, self.words
        for w in [w for w in words if w not in find]:
            if find.setdefault(w, len(own)) == len(own):
                own.append(w)
        return np.fromiter(map(find.__getitem__, words), np.int64, len(words))

    def property(self, key, function, kind) -> np.ndarray:
        """The values of ``function`` for all words by number; ``key`` names it."""
        values = self.known.get(key)
        done = 0 if values is None else len(values)
        if values is None or done < len(self.words):
            new = np.fromiter(map(function, self.words[done:]), kind, len(self.words) - done)
            self.known[key] = values = new if not done else np.concatenate([values, new])
        return values


_CUT = lambda w: len(m[1]) if ("'" in w or "’" in w) and (m := _CLITIC.search(w)) else 0
WORDS, LEMMAS = Vocabulary(), Vocabulary()
#: Lemmas by the numbers of word and tag.
_LEMMA_OF: dict[int, int] = {}
_TAG_NUMBER: dict[str, int] = {}


def _make_room() -> None:
    """Forgets words if there are many, and what is known by their numbers."""
    if max(len(WORDS.words), len(LEMMAS.words), len(_LEMMA_OF)) > KEPT_WORDS:
        WORDS.clear()
        LEMMAS.clear()
        _LEMMA_OF.clear()


class Slice:
    """The annotations of some texts; a value for each token unless said otherwise."""

    def __init__(self, texts: list[str], only_whitespace: bool = False):
        _make_room()
        self.texts = texts
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _classes_of(joined, cp)
        bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        bases = bounds - np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        space = kind == _SPACE
        starts = ~space & _before(space, True) if only_whitespace else _token_starts(cp, kind)
        at = np.flatnonzero(starts | space)
        own = starts[at]
        begin, end = at[own], _after(at, len(cp))[own]
        codes = self._numbered(cp, space, end - begin)
        if not only_whitespace:
            codes, begin, end = self._clitics(codes, begin, end)
        self.codes = codes
        self.doc = np.searchsorted(bounds, begin, "right")
        self.offsets = np.searchsorted(self.doc, np.arange(len(texts) + 1)).astype(np.int32)  # of texts' first tokens
        base = bases[self.doc]
        self.begin, self.end = (begin - base).astype(np.int32), (end - base).astype(np.int32)
        self.place = (np.arange(len(codes)) - self.offsets[self.doc]).astype(np.int32)
        self.fields: dict[str, pa.Array] = {}
        self.lists: dict[str, pa.Array] = {}

    def _numbered(self, cp, space, sizes):
        """The number in the vocabulary of each token's word."""
        inside = cp[~space]
        data = inside.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        ends = np.cumsum(sizes)
        if len(data) != len(inside):
            more = np.cumsum((inside >= 0x80).view(np.int8) + (inside >= 0x800) + (inside >= 0x10000), dtype=np.int64)
            ends = ends + more[ends - 1] if len(ends) else ends
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        return WORDS.number(words.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(words.indices)]  # to_pylist makes a scalar of each

    def _clitics(self, codes, begin, end):
        cuts = WORDS.property("cut", _CUT, np.int32)[codes]
        two = cuts > 0
        if not two.any():
            return codes, begin, end
        split = np.unique(codes[two])
        words, cut = [WORDS.words[i] for i in split], WORDS.known["cut"][split].tolist()
        heads, tails = WORDS.number([w[:n] for w, n in zip(words, cut, strict=True)]), WORDS.number([w[n:] for w, n in zip(words, cut, strict=True)])
        index = np.repeat(np.arange(len(codes)), 1 + two)
        second = np.zeros(len(index), bool)
        second[1:] = index[1:] == index[:-1]
        of, b, e = codes[index], begin[index], end[index]
        first = two[index] & ~second
        at = np.searchsorted(split, of)
        e = np.where(first, b + cuts[index], e)
        b = np.where(second, b + cuts[index], b)
        of[first], of[second] = heads[at[first]], tails[at[second]]
        return of, b, e

    # What later steps compute.

    def of_words(self, key, function, kind) -> np.ndarray:
        """A property of its word for each token."""
        return WORDS.property(key, function, kind)[self.codes]

    @cached_property
    def flags(self) -> np.ndarray:
        return self.of_words("flags", flags_of, np.int32)

    @cached_property
    def distinct(self) -> tuple[list[str], np.ndarray]:
        """The slice's distinct words, and which of them each token is."""
        there = np.zeros(len(WORDS.words), bool)
        there[self.codes] = True
        numbers = np.flatnonzero(there)
        place = np.zeros(len(there), np.int32)
        place[numbers] = np.arange(len(numbers))
        return [WORDS.words[i] for i in numbers.tolist()], place[self.codes]

    def tokenized(self) -> None:
        words, place = self.distinct
        self.fields["text"] = pa.array(words, pa.string()).take(pa.array(place))
        self.fields["char_range"] = ranges(self.begin, self.end)
        self.fields["token_range"] = ranges(self.place, self.place + 1)

    def sentences(self) -> None:
        new_doc = self.place == 0
        flag = self.flags
        short = (flag & PERIOD > 0) & (_before(flag, 0) & ABBREVIATION > 0) & ~new_doc
        end = (flag & SENTENCE_END > 0) & ~short
        run = end | (flag & CLOSER > 0)
        first = run & (new_doc | ~_before(run, False))
        ends = np.cumsum(end)
        before_run = np.maximum.accumulate(np.where(first, ends - end, 0)) if len(ends) else ends
        closed = run & (ends > before_run)  # an end, or what follows one
        begins = new_doc | (_before(closed, False) & ~closed)
        at = np.flatnonzero(begins)
        order = np.cumsum(begins) - 1
        self.sentence_at, self.sentence_of = at, order
        self.sentence_offsets = np.searchsorted(self.doc[at], np.arange(len(self.texts) + 1)).astype(np.int32)
        self.sent_index = (order - self.sentence_offsets[self.doc]).astype(np.int32)
        self.token_index = (np.arange(len(flag)) - at[order] + 1).astype(np.int32) if len(at) else self.place
        self.sentence_sizes = np.diff(np.append(at, len(flag)))
        last = at + self.sentence_sizes - 1
        self.fields |= {"sent_index": pa.array(self.sent_index), "token_index": pa.array(self.token_index), "index_range": ranges(self.token_index - 1, self.token_index)}
        made = {
            "sent_index": pa.array(self.sent_index[at]),
            "token_range": ranges(self.place[at], self.place[last] + 1),
            "char_range": ranges(self.begin[at], self.end[last]),
        }
        self.sentence_fields = made
        self.lists["sents"] = listed(self.sentence_offsets, struct(made))

    def neighbours(self, values, empty):
        """The values of the tokens before and after in the sentence."""
        first = self.token_index == 1
        return np.where(first, empty, _before(values, empty)), np.where(_after(first, True), empty, _after(values, empty))

    def tags(self, lexicon: dict[str, str] | None) -> None:
        self.tag_names = list(dict.fromkeys([*TAGS, *(lexicon or {}).values()]))
        number = {t: i for i, t in enumerate(self.tag_names)}
        by_form = self.of_words("tags", lambda w: number[(x := base_tags(w))[0]] * 256 + number[x[1]], np.int32)
        tag = np.where(self.token_index == 1, by_form >> 8, by_form & 255).astype(np.int16)
        if lexicon:
            words, place = self.distinct
            own = np.array([number[x] if (x := lexicon.get(w.lower())) is not None else -1 for w in words], np.int16)[place] if words else tag
            tag = np.where(own >= 0, own, tag)
        before, _ = self.neighbours(tag, np.int16(-1))
        flag = self.flags
        left, _ = self.neighbours(flag, np.int32(0))
        out = tag.copy()

        def follows(at: np.ndarray, *names: str) -> np.ndarray:
            known = np.zeros(len(self.tag_names) + 1, bool)  # the last for none
            known[[number[n] for n in names]] = True
            return known[before[at]]

        def turn(tags: str, to: str, test=None) -> None:
            at = np.flatnonzero(tag == number[tags])
            out[at[test(at)]] = number[to]

        noun = lambda at: follows(at, "DT", "PRP$", "JJ", "POS", "CD")
        at = np.flatnonzero(tag == number["VB"])
        base = follows(at, "TO", "MD", "CC", "RB", ",", ":") | (before[at] < 0) | (left[at] & DO > 0)
        out[at] = np.where(base, number["VB"], np.where(noun(at), number["NN"], number["VBP"]))
        turn("NN", "VB", lambda at: follows(at, "MD"))
        turn("NNS", "VBZ", lambda at: left[at] & SINGULAR > 0)
        turn("VBZ", "NNS", lambda at: noun(at) & (left[at] & SINGULAR == 0) & (flag[at] & ENDS_S > 0) & (flag[at] & KEPT_S == 0))
        turn("VBD", "VBN", lambda at: left[at] & AUXILIARY > 0)
        turn("POS", "VBZ", lambda at: (left[at] & PRONOUN > 0) | follows(at, "PRP", "WP", "EX"))
        at = np.flatnonzero((flag & LIKE > 0) & (tag != number["VB"]))  # before the other rules but the first
        for names, to in ((("MD", "TO"), "VB"), (("PRP",), "VBP")):
            out[at[follows(at, *names)]] = number[to]
        self.tag = out
        self.fields["pos_tag"] = pa.array(self.tag_names, pa.string()).take(pa.array(self.tag))

    def statistics(self) -> None:
        """``pos_stats``, one element for each text: tokens, those of each class of tags, first and last tag."""
        n, kinds = len(self.texts), list(TAG_TYPES)
        classes = [next((i for i, k in enumerate(kinds) if t in TAG_TYPES[k]), len(kinds)) for t in self.tag_names]
        counts = np.bincount(self.doc * (len(kinds) + 1) + np.array(classes)[self.tag], minlength=n * (len(kinds) + 1)).reshape(n, -1)
        size = np.diff(self.offsets)
        ends = lambda at: self.fields["pos_tag"].take(pa.array(at, pa.int64(), mask=size == 0))
        made = {"n": pa.array(size, pa.int32())} | {k: pa.array(counts[:, i], pa.int32()) for i, k in enumerate(kinds)}
        self.lists["pos_stats"] = listed(np.arange(n + 1), struct(made | {"first": ends(self.offsets[:-1]), "last": ends(self.offsets[1:] - 1)}))

    def lemmas(self) -> None:
        words, place = self.distinct
        n = len(self.tag_names)
        key = place.astype(np.int64) * n + self.tag
        there = np.zeros(len(words) * n, bool)
        there[key] = True
        keys = np.flatnonzero(there)
        index = np.zeros(len(there), np.int32)
        index[keys] = np.arange(len(keys))
        tags = np.array([_TAG_NUMBER.setdefault(t, len(_TAG_NUMBER)) for t in self.tag_names], np.int64)
        numbers = np.fromiter(map(WORDS.numbers.__getitem__, words), np.int64, len(words))
        pairs = (numbers[keys // n] << 20 | tags[keys % n]).tolist()
        found = list(map(_LEMMA_OF.get, pairs))
        new = [i for i, f in enumerate(found) if f is None]
        made = LEMMAS.number([lemma(words[k // n], self.tag_names[k % n]) for k in keys[new].tolist()]).tolist()
        for i, f in zip(new, made, strict=True):
            found[i] = _LEMMA_OF[pairs[i]] = f
        self.lemma_numbers = np.array(found, np.int64)
        self.lemma_list, self.lemma_codes = [LEMMAS.words[i] for i in found], index[key]
        self.fields["lemma"] = pa.array(self.lemma_list, pa.string()).take(pa.array(self.lemma_codes))

    def stop_words(self, listed_: frozenset[str]) -> None:
        listed_in = lambda w: w.lower() in listed_
        known = LEMMAS.property(("stop", listed_), listed_in, bool)[self.lemma_numbers]
        self.fields["stopword"] = pa.array(self.of_words(("stop", listed_), listed_in, bool))
        self.fields["stoplemma"] = pa.array(known[self.lemma_codes])

    def entities(self, lexicon: dict[str, str] | None) -> None:
        names = list(dict.fromkeys([*ENTITY_TAGS, *(lexicon or {}).values()]))
        flag = self.flags
        left, right = self.neighbours(flag, np.int32(0))
        has = lambda xs, bits: xs & bits > 0
        tagged = lambda *of: np.array([t in of for t in self.tag_names])[self.tag]
        named = tagged("NNP", "NNPS")
        number, upper = has(flag, NUMBER), has(flag, UPPER)
        proper = named | upper
        rules = [
            (number & (has(left, SIGN) | has(right, CURRENCY)), "MONEY"),
            (number & has(right, PERCENT), "PERCENT"),
            (number & (has(flag, YEAR) | has(left, MONTH) | has(right, MONTH)), "DATE"),
            (number | tagged("CD"), "NUMBER"),
            (has(flag, SIGN_EXACT) & has(right, NUMBER), "MONEY"),
            (has(flag, CURRENCY) & has(left, NUMBER), "MONEY"),
            (has(flag, PERCENT) & has(left, NUMBER), "PERCENT"),
            (has(flag, DAY) & proper, "DATE"),
            (has(flag, SURE_MONTH) & proper, "DATE"),
            (has(flag, PLACE) & proper, "LOCATION"),
            (proper & (has(flag, COMPANY) | has(right, COMPANY)), "ORGANIZATION"),
            (has(flag, NAME) & upper, "PERSON"),
            (named & (has(left, NAME) | has(left, TITLE)), "PERSON"),
        ]
        ner = np.zeros(len(flag), np.int8)
        for here, name in reversed(rules):
            ner[here] = names.index(name)
        if lexicon:
            words, place = self.distinct
            own = np.array([names.index(x) if (x := lexicon.get(w.lower())) is not None else -1 for w in words], np.int64)[place] if words else ner
            ner = np.where(own >= 0, own, ner)
        numeric = np.array([x in ("NUMBER", "MONEY", "PERCENT") for x in names])[ner] & has(flag, DIGIT)
        of = pa.array(names, pa.string())
        plain = ner == names.index("O")
        self.fields["ner_tag"] = of.take(pa.array(ner))
        self.fields["entity_type"] = of.take(pa.array(ner, mask=plain))
        words, place = self.distinct
        bare = pa.array([w.replace(",", "") for w in words], pa.string())
        self.fields["normalized_tag"] = bare.take(pa.array(place, mask=~numeric))
        self.lists["mentions"] = self.mentions(np.where(plain, -1, ner), "ner_tag")

    def no_entities(self) -> None:
        self.fields["ner_tag"] = pa.repeat(pa.scalar("O"), len(self.codes))
        self.fields["normalized_tag"] = pa.nulls(len(self.codes), pa.string())

    def runs(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last tokens of runs of one kind in a sentence; kinds below 0 are in none."""
        same = (kind == _before(kind, -1)) & (self.token_index > 1)
        inside = kind >= 0
        return np.flatnonzero(inside & ~same), np.flatnonzero(inside & ~_after(same, False))

    def mentions(self, kind: np.ndarray, field: str, extra: tuple[str, ...] = (), more: dict | None = None) -> pa.Array:
        b, e = self.runs(kind)
        head = pa.array(b)
        begin, end = self.begin[b], self.end[e]
        cut = [self.texts[d][x:y] for d, x, y in zip(self.doc[b].tolist(), begin.tolist(), end.tolist(), strict=True)]
        made = {"text": pa.array(cut, pa.string()), "entity_type": self.fields[field].take(head)}
        made |= {k: self.fields[k].take(head) for k in ("ner_tag", "normalized_tag", "sent_index")}
        made |= {"token_range": ranges(self.place[b], self.place[e] + 1), "char_range": ranges(begin, end)}
        made |= {k: self.fields[k].take(head) for k in extra} | (more(b, e) if more else {})
        return listed(np.searchsorted(self.doc[b], np.arange(len(self.texts) + 1)), struct(made))

    def overlaps(self) -> None:
        """``overlap_pairs``, one element for each text: pairs of its mentions, those of patterns among them, that overlap."""
        found = [self.lists[k] for k in ("mentions", "tok_re_mentions")]
        row = np.concatenate([np.repeat(np.arange(len(x)), np.diff(np.asarray(x.offsets))) for x in found])
        begin, end = (np.concatenate([np.asarray(x.values.field("token_range").field(k)) for x in found]) for k in ("begin", "end"))
        n = len(self.texts)
        self.lists["overlap_pairs"] = listed(np.arange(n + 1), pa.array(pairs_met(row, begin, end, n)))

    def column(self, fields: tuple[str, ...] | None) -> pa.Array:
        """``tokens`` with some or all fields."""
        return listed(self.offsets, struct({k: x for k, x in self.fields.items() if fields is None or k in fields}))


TAGS = list(dict.fromkeys(["NN", "NNP", "NNPS", "CD", "SYM", "POS", *(t for t, _ in mo.SIGNS), *(t for t, _ in mo.LEXICON), *(t for t, _ in mo.SUFFIXES)]))
ENTITY_TAGS = ["O", "MONEY", "PERCENT", "DATE", "NUMBER", "LOCATION", "ORGANIZATION", "PERSON"]


def struct(fields: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(fields.values()), list(fields))


def ranges(begin: np.ndarray, end: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], fields=list(_RANGE))


def pairs_met(row: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Pairs of ranges of the same row, of ``n`` rows, that overlap (ends count): those that begin by a range's end, less those
    that have ended before its begin, so no pair is formed."""
    begin, end = (x.astype(np.int64) + (row << 32) for x in (begin, end))
    met = np.searchsorted(np.sort(begin), end, "right") - np.searchsorted(np.sort(end), begin, "left") - 1
    return np.bincount(row, met, n).astype(np.int64) // 2


def listed(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
