"""Natural logic, sentiment, coreference and nested sentences over the slices of :mod:`lexigrove.operators.batches`: the rules of
:mod:`lexigrove.operators.syntax`, :mod:`~lexigrove.operators.sentiment`, :mod:`~lexigrove.operators.roles` and
:mod:`lexigrove.plans.records`."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa

from lexigrove.operators import sentiment
from lexigrove.operators.batches import Slice, listed, ranges, struct
from lexigrove.operators.roles import FEMALE, MALE, NEUTRAL, PLURAL, SPEAKER
from lexigrove.operators.syntax import DOWNWARD, NEGATIONS, UPWARD, VERBS

_NONE = 1 << 30
_QUANTIFIERS, _DOWN = frozenset((*UPWARD, *DOWNWARD)), frozenset((*DOWNWARD, *NEGATIONS))
_SCORES = {w: score for score, words in sentiment.WORDS.items() for w in words}
_PRONOUNS = frozenset((*MALE, *FEMALE, *NEUTRAL, *PLURAL, *SPEAKER))


def _masked(made: pa.StructArray, there: np.ndarray) -> pa.StructArray:
    """``made`` with nulls where nothing is there."""
    return made.take(pa.array(np.arange(len(there)), mask=~there))


def _tagged(s: Slice, *tags: str) -> np.ndarray:
    return np.array([t in tags for t in s.tag_names], bool)[s.tag]


def _first(s: Slice, test: np.ndarray) -> np.ndarray:
    """For each token, the token index of the first of its sentence that passes; :data:`_NONE` if none does."""
    out = np.full(len(s.sentence_at), _NONE, np.int64)
    at = np.flatnonzero(test)[::-1]
    out[s.sentence_of[at]] = s.token_index[at]
    return out[s.sentence_of]


def natural_logic(s: Slice) -> None:
    """Tokens' ``natlog``."""
    kind = s.of_words("natlog", lambda w: ((x := w.lower()) in _DOWN) | (x in _QUANTIFIERS) << 1, np.int8)
    down = s.token_index > _first(s, kind & 1 > 0)
    quantifier = (kind & 2 > 0) & _tagged(s, "DT", "JJ", "PDT")
    i = s.token_index
    verb = _first(s, _tagged(s, *VERBS))
    before = (verb != _NONE) & (verb > i)
    size = s.sentence_sizes[s.sentence_of]
    operator = {
        "surface_form": s.fields["text"],
        "subject_token_range": ranges(i, np.where(before, verb - 1, size)),
        "object_token_range": _masked(ranges(np.where(before, verb - 1, 0), size), before),
        "quantifier_token_range": ranges(i - 1, i),
        "quantifier_token_head_index": pa.array(i - 1, pa.int32()),
    }
    polarity = pa.array(["up", "down"], pa.string()).take(pa.array(down.astype(np.int8)))
    s.fields["natlog"] = struct({"polarity": polarity, "operator": _masked(struct(operator), quantifier)})


def score_sentiment(s: Slice, aggregate: bool) -> None:
    """``sentiment`` of tokens, sentences and texts."""
    score = s.of_words("score", lambda w: _SCORES.get(w.lower(), 0), np.int32)
    negator = s.of_words("negator", lambda w: w.lower() in sentiment.NEGATORS, bool)
    near = np.zeros(len(score), bool)
    near[1:] |= negator[:-1] & (s.token_index[1:] > 1)
    near[2:] |= negator[:-2] & (s.token_index[2:] > 2)
    score = np.where(near, -score, score)
    s.fields["sentiment"] = pa.array(score, pa.int32())
    sums = np.bincount(s.sentence_of, score, len(s.sentence_at)).astype(np.int64)
    own = np.clip(sums, -2, 2)
    s.sentence_fields = s.sentence_fields | {"sentiment": pa.array(own, pa.int32())}
    s.lists["sents"] = listed(s.sentence_offsets, struct(s.sentence_fields))
    ends = np.concatenate([[0], np.cumsum(own)])[s.sentence_offsets]
    s.lists["sentiment"] = pa.array(np.diff(ends), pa.int32()) if aggregate else pa.nulls(len(s.texts), pa.int32())


def _candidates(s: Slice) -> list[tuple]:
    """(text, begin, end, sentence, word, kind, entity) of names and pronouns in textual order."""
    mentions = s.lists["mentions"]
    found, offsets = mentions.values, np.asarray(mentions.offsets)
    entity = found.field("entity_type").dictionary_encode()
    named = np.array([x in ("PERSON", "LOCATION", "ORGANIZATION") for x in entity.dictionary.to_pylist()], bool)
    at = np.flatnonzero(named[np.asarray(entity.indices)]) if len(found) else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, at, "right") - 1
    own = found.take(pa.array(at, pa.int64()))
    span = own.field("token_range")
    columns = [pa.array(doc), span.field("begin"), span.field("end"), own.field("sent_index"), own.field("text"), own.field("entity_type")]
    out = [(d, b, e, i, w.lower(), "PROPER", x) for d, b, e, i, w, x in zip(*[c.to_pylist() for c in columns], strict=True)]
    at = np.flatnonzero(_tagged(s, "PRP", "PRP$") & s.of_words("pronoun", lambda w: w.lower() in _PRONOUNS, bool))
    words = s.fields["text"].take(pa.array(at)).to_pylist()
    place = s.place[at].tolist()
    out += [(d, b, b + 1, i, w.lower(), "PRONOMINAL", "") for d, b, i, w in zip(s.doc[at].tolist(), place, s.sent_index[at].tolist(), words, strict=True)]
    return sorted(out)


def _chains_of(members: list[tuple]) -> list[list[tuple]]:
    """A text's chains of at least two candidates, by first mention."""
    found: dict[str, list[tuple]] = {}
    nearest: dict[bool, str] = {}  # the last name of a person, and of anything else
    for m in members:
        _, _, _, _, word, kind, entity = m
        if kind == "PROPER":
            name = nearest[entity == "PERSON"] = word
        else:
            name = " speaker" if word in SPEAKER else nearest.get(word not in NEUTRAL)
        if name is not None:
            found.setdefault(name, []).append(m)
    return [x for x in found.values() if len(x) > 1]


def _gender(words: set[str]) -> str:
    return next((name for known, name in ((MALE, "MALE"), (FEMALE, "FEMALE"), (NEUTRAL, "NEUTRAL")) if not words.isdisjoint(known)), "UNKNOWN")


def resolve_coreference(s: Slice) -> None:
    """``coref``."""
    counts, sizes, ids, rows = np.zeros(len(s.texts), np.int64), [], [], []
    for doc, members in groupby(_candidates(s), lambda m: m[0]):
        found = _chains_of(list(members))
        counts[doc] = len(found)
        for k, chain in enumerate(found, 1):
            ids.append(k)
            sizes.append(len(chain))
            gender = _gender({m[4] for m in chain})
            for _, b, e, sent, word, kind, entity in chain:
                thing = gender == "NEUTRAL" or entity in ("LOCATION", "ORGANIZATION")
                rows.append((sent, b, e, gender, "INANIMATE" if thing else "ANIMATE", kind, "PLURAL" if word in PLURAL else "SINGULAR"))
    columns = list(zip(*rows, strict=True)) or [()] * 7
    begin, end = np.array(columns[1], np.int32), np.array(columns[2], np.int32)
    texts = {k: pa.array(columns[i], pa.string()) for i, k in enumerate(("gender", "animacy", "type", "number"), 3)}
    mention = {"sent_index": pa.array(columns[0], pa.int32()), "token_range": ranges(begin, end), "head_index": pa.array(end - 1, pa.int32())} | texts
    inside = listed(np.concatenate([[0], np.cumsum(sizes)]), struct(mention))
    s.lists["coref"] = listed(np.concatenate([[0], np.cumsum(counts)]), struct({"id": pa.array(ids, pa.int32()), "mention": inside}))


def nested_sentences(s: Slice, kind) -> None:
    """``record_sents``: sentences with their trees and tokens; null for texts without. ``kind`` is the column's Spark type."""
    from pyspark.sql.pandas.types import to_arrow_type

    sentence = to_arrow_type(kind).value_type
    of = {f.name: f.type for f in sentence}
    n = len(s.sentence_at)
    ends = np.append(s.sentence_at, len(s.codes))

    def shaped(have: dict[str, pa.Array], wanted: pa.DataType, size: int) -> pa.StructArray:
        arrays = [x if (x := have.get(f.name)) is not None and x.type == f.type else pa.nulls(size, f.type) if x is None else x.cast(f.type) for f in wanted]
        return pa.StructArray.from_arrays(arrays, fields=list(wanted))

    def lists(name: str, column: str, offsets: np.ndarray) -> pa.Array:
        if column not in s.lists:
            return pa.nulls(n, of[name])
        values = s.lists[column].values
        made = shaped({f.name: values.field(f.name) for f in values.type}, of[name].value_type, len(values))
        return _listed_as(of[name], offsets, made)

    span = s.sentence_fields["char_range"]
    places = zip(s.doc[s.sentence_at].tolist(), span.field("begin").to_pylist(), span.field("end").to_pylist(), strict=True)
    fields = {
        "text": pa.array([s.texts[d][x:y] for d, x, y in places], pa.string()),
        "sent_index": s.sentence_fields["sent_index"],
        "parse_tree": lists("parse_tree", "parse_nodes", getattr(s, "node_ends", ends)),
        "dependency_parse_tree": lists("dependency_parse_tree", "dependency_edges", ends),
        "tokens": _listed_as(of["tokens"], ends, shaped(s.fields, of["tokens"].value_type, len(s.codes))),
    }
    if "sentiment" in s.sentence_fields:
        fields["sentiment"] = s.sentence_fields["sentiment"]
    none = np.diff(s.sentence_offsets) == 0
    s.lists["record_sents"] = _listed_as(to_arrow_type(kind), s.sentence_offsets, shaped(fields, sentence, n), none)


def _listed_as(kind: pa.ListType, offsets: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.ListArray:
    at = pa.array(offsets, pa.int32(), mask=None if null is None else np.append(null, False))
    return pa.ListArray.from_arrays(at, values, type=kind)
