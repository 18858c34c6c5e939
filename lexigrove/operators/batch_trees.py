"""Trees over the slices of :mod:`lexigrove.operators.batches`: columns of numbers instead of an object for each edge or node, so
that a slice's trees are small however many rows a batch has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lexigrove.operators.batches import WORDS, Slice, Vocabulary, listed, ranges, struct
from lexigrove.operators.syntax import COPULAS, FRAMES, VERBS, binarised, chunk_tree, heads


#: Numbers that trees of sentences are kept in, for sentences with the same tags.
KEPT_NUMBERS = 8_000_000


class _Kept:
    """What a function gives for a sentence, by all that it depends on."""

    def __init__(self):
        self.found, self.size = {}, 0

    def get(self, key, make) -> np.ndarray:
        out = self.found.get(key)
        if out is None:
            out = make()
            if self.size > KEPT_NUMBERS:
                self.found.clear()
                self.size = 0
            self.found[key] = out
            self.size += out.size + 16
        return out


_HEADS, _TREES, _NAMES = _Kept(), _Kept(), Vocabulary()
#: Numbers of the lists of tags that keys refer to.
_LISTS: dict[tuple[str, ...], int] = {}


def _form(word: str) -> int:
    """What a word's form tells the rules on heads."""
    lower = word.lower()
    return (lower in COPULAS) | (lower in ("not", "n't", "n’t", "never")) << 1 | any(c.isalnum() for c in word) << 2


def _sentences(s: Slice, kinds: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
    """(key, first token, size) of each sentence."""
    data, width = kinds.tobytes(), kinds.itemsize
    for at, n in zip(s.sentence_at.tolist(), s.sentence_sizes.tolist(), strict=True):
        yield data[at * width : (at + n) * width], at, n


def _tags(s: Slice, at: int, n: int) -> list[str]:
    return [s.tag_names[t] for t in s.tag[at : at + n].tolist()]


def _joined(parts: list[np.ndarray], width: int) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros((0, width), np.int32)


def dependencies(s: Slice, longest: int) -> None:
    """``dependency_edges``, one for each token; a sentence beyond ``longest`` tokens (0: any) hangs from its first token."""
    def edges(at: int, n: int) -> np.ndarray:
        if longest and n > longest:
            found = [(0, "root")] + [(1, "dep")] * (n - 1)
        else:
            found = heads(_tags(s, at, n), [WORDS.words[c] for c in s.codes[at : at + n].tolist()])
        seen: dict[int, int] = {}
        out = []
        for (head, _), dep in zip(found, _NAMES.number([d for _, d in found]).tolist(), strict=True):
            place = seen.get(head, 0)
            out.append((head, place, dep))
            seen[head] = place + 1
        return np.array(out, np.int32)

    kinds = s.tag * np.int16(8) + s.of_words("form", _form, np.int16)
    names = _LISTS.setdefault(tuple(s.tag_names), len(_LISTS))
    made = _joined([_HEADS.get((longest, names, key), lambda at=at, n=n: edges(at, n)) for key, at, n in _sentences(s, kinds)], 3)
    s.head, s.dep, s.dep_names = made[:, 0], made[:, 2], list(_NAMES.words)
    fields = {
        "sent_index": pa.array(s.sent_index),
        "token_index": pa.array(s.token_index),
        "parent_token_index": pa.array(s.head),
        "child_ord": pa.array(made[:, 1]),
        "dep": pa.array(s.dep_names, pa.string()).take(pa.array(s.dep)),
        "text": s.fields["text"],
    }
    s.lists["dependency_edges"] = listed(s.offsets, struct(fields))


def trees(s: Slice, longest: int, binary: bool, scored: bool) -> None:
    """``parse_nodes`` of all sentences, in preorder."""
    def nodes_of(at: int, n: int) -> np.ndarray:
        tags = _tags(s, at, n)
        if longest and n > longest:  # a sentence beyond the limit: all tokens below S
            nodes = [(0, -1, 0, "ROOT", 0), (1, 0, 0, "S", 0), *((k + 1, 1, k - 1, tag, k) for k, tag in enumerate(tags, 1))]
        else:
            nodes = chunk_tree(tags)
        if binary:
            nodes = binarised(nodes)
        begin, end = [1 << 30] * len(nodes), [0] * len(nodes)
        for node, up, _, _, token in reversed(nodes):
            if token:
                begin[node], end[node] = token - 1, token
            if up >= 0:
                begin[up], end[up] = min(begin[up], begin[node]), max(end[up], end[node])
        labels = _NAMES.number([x[3] for x in nodes]).tolist()
        return np.array([(x[0], x[1], x[2], label, x[4], b, e) for x, label, b, e in zip(nodes, labels, begin, end, strict=True)], np.int32)

    names = _LISTS.setdefault(tuple(s.tag_names), len(_LISTS))
    parts = [_TREES.get((longest, binary, names, key), lambda at=at, n=n: nodes_of(at, n)) for key, at, n in _sentences(s, s.tag)]
    made, counts = _joined(parts, 7), np.array([len(p) for p in parts], np.int64)
    column = lambda i: pa.array(made[:, i])
    fields = {
        "sent_index": pa.array(np.repeat(s.sent_index[s.sentence_at], counts)),
        "node_id": column(0),
        "parent_id": column(1),
        "child_ord": column(2),
        "label": pa.array(_NAMES.words, pa.string()).take(column(3)),
        "token_index": pa.array(made[:, 4], mask=made[:, 4] == 0),
        "index_range": ranges(made[:, 5], made[:, 6]),
        "score": pa.array(np.ones(len(made))) if scored else pa.nulls(len(made), pa.float64()),
    }
    s.node_ends = ends = np.concatenate([[0], np.cumsum(counts)])
    s.lists["parse_nodes"] = listed(ends[s.sentence_offsets], struct(fields))


def roles(s: Slice) -> None:
    """Tokens' ``srl``: frame, head, relation and argument of each edge."""
    from lexigrove.operators.roles import ARGUMENTS, RELATIONS

    verbs = np.isin(s.tag, [i for i, t in enumerate(s.tag_names) if t in VERBS])
    frames = pa.array([FRAMES.get(x, f"{x}.01") for x in s.lemma_list], pa.string())
    argument = np.array([d in ARGUMENTS for d in s.dep_names], bool)[s.dep]
    at = pa.array(s.dep[argument])
    head = {
        "function_tag": pa.array([ARGUMENTS.get(d, (None, None))[1] for d in s.dep_names], pa.string()).take(at),
        "dependency_label": pa.array([ARGUMENTS.get(d, (None, None))[0] for d in s.dep_names], pa.string()).take(at),
    }
    offsets = pa.array(np.concatenate([[0], np.cumsum(argument)]), pa.int32(), mask=np.append(~argument, False))
    s.fields["srl"] = struct(
        {
            "id": pa.array(s.token_index),
            "propbank": frames.take(pa.array(s.lemma_codes, mask=~verbs)),
            "head_id": pa.array(s.head),
            "dependency_label": pa.array([RELATIONS.get(d, d) for d in s.dep_names], pa.string()).take(pa.array(s.dep)),
            "heads": pa.ListArray.from_arrays(offsets, struct(head)),
        }
    )


def _above(s: Slice) -> np.ndarray:
    """The token that each token hangs from; -1 for roots."""
    return np.where(s.head > 0, s.sentence_at[s.sentence_of] + s.head - 1, -1)


def parents(s: Slice) -> None:
    """``edge_parents``: the relation and the parent's text (null for roots) of each edge."""
    above = _above(s)
    text = s.fields["text"].take(pa.array(above, mask=above < 0))
    s.lists["edge_parents"] = listed(s.offsets, struct({"dep": s.lists["dependency_edges"].values.field("dep"), "parent_text": text}))


def frames_of_heads(s: Slice) -> None:
    """``role_heads``: the relation and the head's frame of each role node."""
    above = _above(s)
    frame = s.fields["srl"].field("propbank").take(pa.array(above, mask=above < 0))
    s.lists["role_heads"] = listed(s.offsets, struct({"dependency_label": s.fields["srl"].field("dependency_label"), "head_propbank": frame}))
