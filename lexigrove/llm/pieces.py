"""SentencePiece BPE encoding and decoding by suffix-array matching.

Texts are cut where no piece of the vocabulary can reach across (before a run of word marks, about line breaks), and the
distinct cuts of a batch that are not known yet are concatenated. A suffix array of that text (by prefix doubling, up to
the longest piece) is searched for every piece at once by bisection, one character deeper in each turn; the resulting
ranges are the edges. Edges are sorted by where they end and relaxed in that order, for all cuts together: an edge counts
if the piece that ends where it begins is there and the two can stand side by side. With merges in order of rank that
holds for just one edge at each place, and the chain of them is what merging gives (a sequence is a merge result if each
adjacent pair is). Two pieces cannot stand side by side if, undoing their merges from the last one backwards, the two
symbols at the border had a better merge with each other. Characters outside the vocabulary fall back to bytes.

Defined results: null and empty texts have no ids; decoding no ids gives an empty text; rows that repeat give equal ids;
word marks written in a text come back as blanks, as in the reference library; columns ``ids`` and ``decoded`` replace
those of the input; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.llm.common import give_back, sliced

MARK = "▁"
#: Texts become Python objects in slices of so many rows and, but for single texts, bytes at most.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20
NEVER = np.iinfo(np.int64).max


@dataclass
class Vocabulary:
    """Pieces with what matching and merging need. ``rank``: order of merging, -1 for single characters. ``late``: pieces
    merged from ones of a later rank (runs of word marks), whose merges cannot be undone by rank."""

    pieces: list[str]
    bytes_of: list[bytes]
    byte_ids: np.ndarray
    usable: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    unknown: int
    late: np.ndarray
    score: dict[str, float]


def merged(chars: list[str], score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """The merge result of a short text, by definition: the best pair first, of equals the leftmost; and the last pair."""
    parts, last = list(chars), None
    while len(parts) > 1:
        best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score), default=None)
        if best is None:
            break
        i = -best[1]
        last = parts[i], parts[i + 1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


def load(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
    score = {p: model.get_score(i) for i, (p, s) in enumerate(zip(pieces, special, strict=True)) if not s}
    ids = {p: i for i, (p, s) in enumerate(zip(pieces, special, strict=True)) if not s}
    order = {s: r for r, s in enumerate(sorted({-v for p, v in score.items() if len(p) > 1}))}
    rank, left, right = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    usable, pairs = np.zeros(n + 1, bool), {}
    for p, i in ids.items():
        if len(p) == 1:
            usable[i] = True
            continue
        rank[i] = order[-score[p]]
        for cut in range(1, len(p)):
            if p[:cut] in ids and p[cut:] in ids:
                pairs[ids[p[:cut]] * (n + 1) + ids[p[cut:]]] = rank[i]
        parts, last = merged(list(p), score)
        if len(parts) == 1 and last[0] in ids and last[1] in ids:
            usable[i], left[i], right[i] = True, ids[last[0]], ids[last[1]]
    late = np.zeros(n + 1, bool)
    for i in sorted(ids.values(), key=lambda i: len(pieces[i])):
        if usable[i] and rank[i] >= 0:
            late[i] = max(rank[left[i]], rank[right[i]]) >= rank[i] or late[left[i]] or late[right[i]]
    keys = np.array(sorted(pairs), np.int64)
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    raw = [p.encode() if not s else b"" for p, s in zip(pieces, special, strict=True)]
    for b in range(256):
        raw[byte_ids[b]] = bytes([b])
    return Vocabulary(pieces, raw, byte_ids, usable, rank, left, right, keys, np.array([pairs[k] for k in keys.tolist()], np.int64), n, late, score)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` symbols at least, by prefix doubling.

    Symbols become dense numbers, of which as many as fit into a key are sorted at first; doubling goes on from there.
    """
    symbols, dense = np.unique(text, return_inverse=True)
    bits, n = max(1, int(len(symbols)).bit_length()), len(text)
    width = 1
    while 2 * width * bits <= 62:
        width *= 2
    key, size = dense.astype(np.int64) + 1, 1
    while size < width:  # the key of a place holds its next symbols, zeros after the end
        key = key << np.int64(size * bits)
        key[:-size] |= key[size:] >> np.int64(size * bits)
        size *= 2
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
    while width < depth and n > 1 and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[:-width] = rank[width:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
        width *= 2
    return order


class Pairs:
    """Ranks of pairs of pieces by key: a table with one slot for most keys; keys that meet in a slot are searched for."""

    BITS = 19

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.slots, self.found = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, NEVER, np.int64)
        at = self._slot(keys)
        count = np.bincount(at, minlength=1 << self.BITS)
        lone = count[at] == 1
        self.slots[at[lone]], self.found[at[lone]] = keys[lone], ranks[lone]
        self.slots[count > 1] = -2
        self.keys, self.ranks = keys[~lone], ranks[~lone]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        slot = self.slots[at]
        out = np.where(slot == keys, self.found[at], NEVER)
        full = np.flatnonzero(slot == -2)
        if len(full) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys[full]), len(self.keys) - 1)
            out[full] = np.where(self.keys[place] == keys[full], self.ranks[place], NEVER)
        return out


class Matcher:
    """Encodes and decodes with a vocabulary; remembers the ids of cuts."""

    MOST, BLOCK = 200_000, 1 << 17

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        found = [i for i in range(v.unknown) if v.usable[i]]
        found.sort(key=lambda i: v.pieces[i])
        self.ids = np.array(found, np.int32)
        self.size = np.array([len(v.pieces[i]) for i in found], np.int64)
        self.deepest = int(self.size.max(initial=1))
        self.chars = np.zeros((len(found), self.deepest), np.int32)
        for row, i in enumerate(found):
            self.chars[row, : self.size[row]] = [ord(c) for c in v.pieces[i]]
        self.length = np.ones(v.unknown + 1, np.int32)
        self.length[self.ids] = self.size
        # cuts with their ids, in two generations: the older one goes when the younger one is full, what is used moves up
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs = Pairs(v.pair_keys, v.pair_ranks)
        self.tried: dict[tuple[int, int], bool] = {}
        self.lines = not any("\n" in p for p in v.pieces)
        inner = any(MARK in p.lstrip(MARK) for p in v.pieces)
        if inner:
            raise ValueError("a piece has a word mark after other characters")
        # signs that no piece has right after a letter; a text in which they follow nothing else is cut before them, too
        self.signs = [c for c in ".,;:!?" if not any(re.search(rf"[^\W\d_]{re.escape(c)}", p) for p in v.pieces)]
        self.elsewhere = re.compile(rf"[{re.escape(''.join(self.signs))}](?<![^\W\d_].)") if self.signs else None
        self.cutter = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+" if self.lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def cuts(self, text: str) -> list[str]:
        if not text:
            return []
        lone = self.signs and not self.elsewhere.search(text)
        text = MARK + text.replace(" ", MARK)
        if self.lines and "\x01" not in text and MARK + MARK not in text:
            text = text.replace(MARK, "\x01" + MARK).replace("\n", "\x01\n\x01")
            if lone:
                for c in self.signs:
                    text = text.replace(c, "\x01" + c)
            return list(filter(None, text.split("\x01")))
        return self.cutter.findall(text)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, piece) of every occurrence of every piece."""
        order = suffix_array(text, self.deepest)
        n = len(text)
        ended = np.r_[text, np.full(self.deepest, -1, np.int32)]
        live = np.arange(len(self.ids))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), n, np.int64)
        begins, which = [], []
        for depth in range(self.deepest):
            want = self.chars[live, depth]
            low, high = self._bound(ended, order, depth, want, low, high), self._bound(ended, order, depth, want + 1, low, high)
            some = high > low
            live, low, high = live[some], low[some], high[some]
            full = self.size[live] == depth + 1
            count = high[full] - low[full]
            at = np.repeat(low[full] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            begins.append(order[at].astype(np.int32))
            which.append(np.repeat(self.ids[live[full]], count))
            live, low, high = live[~full], low[~full], high[~full]
            if not len(live):
                break
        return np.concatenate(begins), np.concatenate(which)

    @staticmethod
    def _bound(ended, order, depth, want, low, high):
        """First place in each [low, high) whose suffix has at least ``want`` at ``depth``."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            less = ended[order[mid] + depth] < want[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
            open_ = open_[low[open_] < high[open_]]
        return low

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two pieces can follow each other in a merge result; ``unknown`` stands for any other character."""
        v, n = self.v, self.v.unknown
        good = (a == n) | (b == n)
        odd = ~good & (v.late[a] | v.late[b])
        for i in np.flatnonzero(odd):
            good[i] = self._by_merging(int(a[i]), int(b[i]))
        at = np.flatnonzero(~good & ~odd)
        a, b, limit = a[at].astype(np.int64), b[at].astype(np.int64), np.full(len(at), NEVER)
        while len(at):
            key = a * (n + 1) + b
            rank = self.pairs(key)
            ra, rb = v.rank[a], v.rank[b]
            clash = rank < limit
            single = (ra < 0) & (rb < 0)
            good[at[~clash & single]] = True
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, v.right[a], a), np.where(undo, b, v.left[b])
            on = ~clash & ~single
            at, a, b, limit = at[on], a[on], b[on], limit[on]
        return good

    def _by_merging(self, a: int, b: int) -> bool:
        if (a, b) not in self.tried:
            x, y = self.v.pieces[a], self.v.pieces[b]
            self.tried[a, b] = merged(list(x + y), self.v.score)[0] == [x, y]
        return self.tried[a, b]

    def learn(self, cuts: list[str]) -> None:
        """Encodes cuts that are not known."""
        block, size = [], 0
        for cut in cuts:
            block.append(cut)
            size += len(cut) + 1
            if size >= self.BLOCK:
                self._learn(block)
                block, size = [], 0
        if block:
            self._learn(block)

    def _learn(self, cuts: list[str]) -> None:
        v = self.v
        text = np.frombuffer(("\x00".join(cuts) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        sizes = np.array([len(c) for c in cuts], np.int64)
        starts = (np.cumsum(sizes + 1) - sizes - 1).astype(np.int32)
        owner = np.repeat(np.arange(len(cuts), dtype=np.int32), sizes + 1)
        begin, piece = self.edges(text)
        covered = np.zeros(len(text), bool)
        covered[begin[self.length[piece] == 1]] = True
        covered[starts + sizes] = True  # the ends are no characters
        lone = np.flatnonzero(~covered).astype(np.int32)
        begin, piece = np.r_[begin, lone], np.r_[piece, np.full(len(lone), v.unknown, np.int32)]
        end = begin + self.length[piece]
        inside = end <= (starts + sizes)[owner[begin]]
        begin, piece, end = begin[inside], piece[inside], end[inside]
        depth = end - starts[owner[begin]]
        order = np.argsort(depth, kind="stable")
        begin, piece, end, depth = begin[order], piece[order], end[order], depth[order]
        turns = np.r_[0, np.flatnonzero(np.diff(depth)) + 1, len(depth)]
        first = np.zeros(len(text) + 1, bool)
        first[starts] = True
        last = np.full(len(text) + 1, -1, np.int32)
        for x, y in zip(turns[:-1], turns[1:], strict=True):
            b, p, e = begin[x:y], piece[x:y], end[x:y]
            good = first[b]
            rest = np.flatnonzero(~good & (last[b] >= 0))
            good[rest] = self.side_by_side(last[b[rest]], p[rest])
            last[e[good]] = p[good]
        at, rows, found, mark = starts + sizes, [], [], []
        live = np.flatnonzero(sizes > 0)
        while len(live):
            p = last[at[live]]
            at[live] -= self.length[p]
            rows.append(live)
            found.append(p)
            mark.append(at[live].copy())
            live = live[at[live] > starts[live]]
        rows, found, mark = np.concatenate(rows), np.concatenate(found), np.concatenate(mark)
        order = np.argsort(mark, kind="stable")
        rows, found, mark = rows[order], found[order], mark[order]
        cut_at = np.searchsorted(rows, np.arange(len(cuts) + 1))
        odd = set(rows[found == v.unknown].tolist())
        raw = found.astype("<i4").tobytes()
        for i, cut in enumerate(cuts):
            a, b = cut_at[i], cut_at[i + 1]
            if i in odd:
                out = []
                for p, m in zip(found[a:b].tolist(), mark[a:b].tolist(), strict=True):
                    out += v.byte_ids[list(chr(text[m]).encode("utf-8", "surrogatepass"))].tolist() if p == v.unknown else [p]
                self.known[cut] = np.array(out, "<i4").tobytes()
            else:
                self.known[cut] = raw[4 * a : 4 * b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian 32-bit integers."""
        cut = [self.cuts(t or "") for t in texts]
        if len(self.known) > self.MOST:
            self.old, self.known = self.known, {}
        need = set().union(*cut).difference(self.known)
        for c in need.intersection(self.old):
            self.known[c] = self.old[c]
        self.learn(sorted(need.difference(self.old)))
        find = self.known.__getitem__
        return [b"".join(map(find, cs)) for cs in cut]

    def decode(self, ids) -> str:
        raw = self.v.bytes_of
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text.removeprefix(" ")


_MATCHERS: list[Matcher] = []


def matcher_of(vocabulary: Vocabulary) -> Matcher:
    """The matcher of a broadcast vocabulary, one for each Python worker, which outlives a task."""
    if not _MATCHERS or _MATCHERS[0].v is not vocabulary:
        _MATCHERS[:] = [Matcher(vocabulary)]
    return _MATCHERS[0]


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` with ids: array<int>."""
    columns = [c for c in docs.columns if c != "ids"]
    kept, sent = docs.select(*columns), docs.sparkSession.sparkContext.broadcast(vocabulary)
    at = columns.index(text_col)

    def run(batches):
        matcher = matcher_of(sent.value)
        for batch in batches:
            for part in sliced(batch, at, SLICE_BYTES, SLICE_ROWS):
                found = matcher.encode(part.column(at).to_pylist())
                offsets = pa.array(np.r_[0, np.cumsum([len(x) // 4 for x in found])].astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*columns, "ids"])
        give_back()

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with decoded: the text of the ids (null for null)."""
    columns = [c for c in encoded.columns if c != "decoded"]
    kept, sent = encoded.select(*columns), encoded.sparkSession.sparkContext.broadcast(vocabulary)
    at = columns.index(ids_col)

    def run(batches):
        matcher = Matcher.__new__(Matcher)
        matcher.v = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                texts = [None if x is None else matcher.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*columns, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("decoded", T.StringType())]))


def with_round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ids and whether they decode to it: one pass, which sends no text back."""
    columns = [c for c in docs.columns if c not in ("ids", "round_trip", text_col)]
    sent = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        matcher = matcher_of(sent.value)
        for batch in batches:
            for part in sliced(batch, 0, SLICE_BYTES, SLICE_ROWS):
                texts = part.column(0).to_pylist()
                found = matcher.encode(texts)
                same = [matcher.decode(np.frombuffer(x, "<i4").tolist()) == (t or "") for x, t in zip(found, texts, strict=True)]
                offsets = pa.array(np.r_[0, np.cumsum([len(x) // 4 for x in found])].astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids, pa.array(same, pa.bool_())], [*columns, "ids", "round_trip"])
        give_back()

    schema = docs.select(*columns).schema.add("ids", T.ArrayType(T.IntegerType())).add("round_trip", T.BooleanType())
    return docs.select(text_col, *columns).mapInArrow(run, schema)
