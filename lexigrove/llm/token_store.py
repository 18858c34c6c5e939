"""Token ids in binary files coded by a static range asymmetric numeral system.

A file ("shard") holds a run of documents in id order: a table of symbol frequencies shared by its blocks, the blocks,
and an index. A block holds whole documents, about ``BLOCK_TOKENS`` ids; its ids are dealt over interleaved coder lanes,
one state each, which read one stream of 16-bit words. A block's header is a checkpoint: lane states, ids before it in the
shard, sizes and checksums of the coded bytes and of the ids, so any block can be decoded alone and in parallel.

    magic "LXRANS1\\n" | table size u32, zlib(symbols u32, frequencies u16)
    block: lanes u32, steps u32, words u32, tokens u32, documents u32, side bytes u32, crc of body u32, crc of ids u32,
           first id u64 | body: states u32[lanes], words u16[words], zlib(present u8, document ids i64, sizes u32)
    index: zlib(offset u64, bytes u64 of each block) | index size u32, blocks u32, magic

Documents are ordered by a range partitioning, so each partition writes its own shards and no task sees all ids. Ids are
counted over the whole shard before its blocks are coded.

Defined results: null text is an empty one (only the end id); a null document id is kept and comes first; rows that share
an id follow each other in the order of their texts' hashes; a very long text is a block (and, from 2 ** 24 ids on, a shard)
of its own; a shard with 65,536 distinct ids or more codes each id as two symbols; other columns are not read, so no name
can clash; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.common import open_shared, sliced, staged

MAGIC = b"LXRANS1\n"
LANES, BLOCK_TOKENS, SHARD_TOKENS = 2048, 1 << 18, 1 << 24
SCALE = 16
#: Bits of an id's lower half and the flag of a table of halves, where a shard has 65,536 distinct ids or more, or very large ones.
LOW, PAIRED = 14, 1 << 31
HEAD = struct.Struct("<8IQ")
#: The pre-tokenizing pattern of byte-level BPE with its own regular expression.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


token_id = attrgetter("id")


class Known:
    """Cuts with their token ids, as Arrow strings and one pool of ids. If there would be more than ``MOST``, those that the
    last batch did not use go."""

    MOST = 1_000_000

    def __init__(self, make):
        self.make = make
        self.cuts, self.pool, self.length = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64)

    def places(self, distinct: pa.Array) -> np.ndarray:
        """Where each of the distinct cuts stands among the known ones; what is new is made known."""
        at = pc.index_in(distinct, value_set=self.cuts)
        new = pc.is_null(at)
        found = distinct.filter(new)
        if len(found) and len(self.cuts) + len(found) > self.MOST:
            keep = np.unique(at.drop_null().to_numpy())
            begin, length = (np.cumsum(self.length) - self.length)[keep], self.length[keep]
            self.pool, self.length, self.cuts = gathered(self.pool, begin, length), length, self.cuts.take(pa.array(keep))
            at = pc.index_in(distinct, value_set=self.cuts)
        places = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if len(found):
            ids = [self.make(x) for x in found.to_pylist()]
            places[new.to_numpy(zero_copy_only=False)] = len(self.cuts) + np.arange(len(found))
            self.pool = np.r_[self.pool, np.frombuffer(b"".join(ids), "<u4")]
            self.length = np.r_[self.length, np.array([len(x) for x in ids], np.int64) // 4]
            self.cuts = pa.concat_arrays([self.cuts, found])
        return places


def gathered(pool: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[begin[i] : begin[i] + length[i]], one after the other."""
    ends = np.cumsum(length)
    return pool[np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of a text as bytes (little-endian unsigned 32 bit), as the tokenizers library gives them.

    Byte-level BPE works on each piece of a text alone, so the library's model is asked once for each distinct piece. A
    plain text (Latin letters, no control characters, no runs of three blanks) is cut before each blank, about each line
    break, and about full stops and commas that stand alone between letters, figures or an end; these are piece boundaries
    there. Cuts are looked up; other texts, and those that hold an added token's content, go to the library whole.
    """

    PLAIN = "\t\n" + "".join(map(chr, [*range(32, 127), *range(0xA1, 0x250)]))

    def __init__(self, path: str, plain: bool):
        import re

        import regex
        from tokenizers import Tokenizer

        self.whole, self.plain = Tokenizer.from_file(path), plain
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        signs = re.escape("".join(regex.findall(r"[^\s\p{L}\p{N}]", self.PLAIN)))
        self.odd = re.compile(f"[^{re.escape(self.PLAIN)}]")
        self.runs, self.pieces = re.compile(r"\s{3}|\s\s\Z"), regex.compile(PIECES)
        self.crowded = re.compile(f"[.,](?:(?=[{signs}])|(?<=[{signs}\\s].))")
        self.model, self.cuts = self.whole.model, Known(self._cut)
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.byte_names = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.blank = self.byte_names[32]

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # only the blank has another name
            named = piece.replace(" ", self.blank)
        else:
            named = piece.encode().decode("latin1").translate(self.byte_names)
        return array("I", map(token_id, self.model.tokenize(named))).tobytes()

    def _cut(self, cut: str) -> bytes:
        if (cut[1:] if cut[:1] == " " and len(cut) > 1 else cut).isalpha():
            return self._piece(cut)
        return b"".join(map(self._piece, self.pieces.findall(cut)))

    def _cuttable(self, text: str) -> bool:
        gaps = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\t" in text or text[-1:].isspace()
        return self.plain and not (self.odd.search(text) or (gaps and self.runs.search(text)) or any(t in text for t in self.added))

    def _marked(self, text: str) -> str:
        cuts = text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01")
        if not self.crowded.search(text):
            cuts = cuts.replace(".", "\x01.\x01").replace(",", "\x01,\x01")
        return cuts

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has. Cuts are split and made distinct in Arrow; each
        distinct one is looked up once, and its ids are gathered to where it stands."""
        plain = np.array([self._cuttable(t) for t in texts], bool)
        lists = pc.split_pattern(pa.array([self._marked(t) if x else "" for t, x in zip(texts, plain, strict=True)], pa.string()), "\x01")
        found = lists.flatten().dictionary_encode()
        which = self.cuts.places(found.dictionary)[found.indices.to_numpy()]
        sizes = self.cuts.length[which]
        flat, ends = gathered(self.cuts.pool, (np.cumsum(self.cuts.length) - self.cuts.length)[which], sizes), np.cumsum(sizes)
        counts = np.diff(np.r_[0, ends][lists.offsets.to_numpy() - lists.offsets[0].as_py()])
        if not plain.all():
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(~plain):
                parts[k] = np.array(self.whole.encode(texts[k], add_special_tokens=False).ids, "<u4")
            flat, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return flat, counts

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0].tobytes()


def works_on_pieces(path: str) -> bool:
    """Whether a tokenizer file is of the kind whose pieces ``PIECES`` finds. Asked once, on the driver: the file is large."""
    import json
    from pathlib import Path

    spec = json.loads(Path(path).read_text())
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    own = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return bool(own and spec.get("normalizer") is None and not spec.get("truncation") and not model.get("ignore_merges"))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, plain: bool) -> Encoder:
    """The encoder of a file, one for each Python worker, which outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path, plain)
    return _ENCODERS[path]


def frequencies(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies): of the symbols that occur, at least 1 each, in all 2 ** SCALE, none the whole of it."""
    counts = np.r_[counts, np.zeros(max(0, 2 - len(counts)), np.int64)]
    symbols = np.flatnonzero(counts)
    if len(symbols) < 2:
        symbols = np.unique(np.r_[symbols, 0, 1])
    if len(symbols) >= 1 << SCALE:
        raise ValueError("more symbols in a shard than its table can hold")
    n = counts[symbols].astype(float)
    f = np.maximum(1, np.floor(n * ((1 << SCALE) / max(n.sum(), 1)))).astype(np.int64)
    while excess := int(f.sum()) - (1 << SCALE):
        order = np.argsort(-f, kind="stable")
        if excess > 0:
            can = np.minimum(f[order] - 1, -(-f[order] * excess // f.sum()))
            cut = np.minimum(can, np.maximum(0, excess - (np.cumsum(can) - can)))
            f[order] -= cut
        else:
            f[order[0]] += -excess
    if f.max() == 1 << SCALE:
        f[f.argmax()] -= 1
        f[f.argmin()] += 1
    return symbols.astype(np.uint32), f.astype(np.uint32)


class Coder:
    paired = False

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq
        self.base = (np.cumsum(freq) - freq).astype(np.uint32)
        self.slot = np.repeat(np.arange(len(freq)), freq)
        self.slot_freq = self.freq[self.slot]
        self.slot_rest = (np.arange(1 << SCALE) - self.base[self.slot]).astype(np.uint32)
        self.slot_symbol = symbols[self.slot]
        self.place = np.zeros(int(symbols.max()) + 1, np.uint32)
        self.place[symbols] = np.arange(len(symbols))

    def encode(self, ids: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        """(lanes, steps, states, words) of a block's ids."""
        lanes = int(np.clip(len(ids) // 128, 1, LANES))
        steps = -(-len(ids) // lanes)
        place = np.zeros(steps * lanes, np.uint32)
        place[: len(ids)] = self.place[ids]
        f, base = self.freq[place].reshape(steps, lanes), self.base[place].reshape(steps, lanes)
        x, words = np.full(lanes, 1 << 16, np.uint32), []
        for t in range(steps - 1, -1, -1):
            full = x >= (f[t] << np.uint32(16))
            words.append((x[full] & np.uint32(0xFFFF)).astype(np.uint16))
            x = np.where(full, x >> np.uint32(16), x)
            q = x // f[t]
            x = (q << np.uint32(16)) + (x - q * f[t]) + base[t]
        return lanes, steps, x, np.concatenate(words[::-1]) if words else np.empty(0, np.uint16)

    def decode(self, lanes: int, steps: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        x, at, out = states.copy(), 0, np.empty((steps, lanes), np.uint32)
        words = words.astype(np.uint32)
        for t in range(steps):
            slot = x & np.uint32(0xFFFF)
            out[t] = self.slot_symbol.take(slot)
            x = self.slot_freq.take(slot) * (x >> np.uint32(16)) + self.slot_rest.take(slot)
            low = np.flatnonzero(x < 65536)
            x[low] = (x[low] << np.uint32(16)) | words[at : at + len(low)]
            at += len(low)
        if at != len(words) or (x != 1 << 16).any():
            raise ValueError("a block does not end in its first state")
        return out.ravel()


def halves(ids: np.ndarray) -> np.ndarray:
    """Two symbols for each id, its upper and its lower bits, for shards with more distinct ids than a table can hold."""
    out = np.empty(2 * len(ids), np.uint32)
    out[0::2], out[1::2] = (ids >> np.uint32(LOW)) + np.uint32(1 << LOW), ids & np.uint32((1 << LOW) - 1)
    return out


def write_shard(sink, names: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> Iterator[dict]:
    """Writes documents (their ids, their numbers of token ids, all token ids) as one shard; a row for each block."""
    paired = int(ids.max(initial=0)) >= 1 << 24 or np.count_nonzero(np.bincount(ids)) >= 1 << SCALE
    coder = Coder(*frequencies(np.bincount(halves(ids) if paired else ids)))
    table = zlib.compress(coder.symbols.astype("<u4").tobytes() + coder.freq.astype("<u2").tobytes())
    sink.write(MAGIC + struct.pack("<I", len(table) | (PAIRED if paired else 0)) + table)
    offset, first, index, begin = len(MAGIC) + 4 + len(table), 0, [], 0
    ends = np.cumsum(sizes)
    present = np.array([x is not None for x in names], np.uint8)
    known = np.array([x or 0 for x in names], "<i8")
    while begin < len(names):
        end = min(len(names), int(np.searchsorted(ends, first + BLOCK_TOKENS)) + 1)
        size = int(ends[end - 1]) - first
        own = ids[first : first + size]
        lanes, steps, states, words = coder.encode(halves(own) if paired else own)
        side = zlib.compress(present[begin:end].tobytes() + known[begin:end].tobytes() + sizes[begin:end].astype("<u4").tobytes())
        body = states.astype("<u4").tobytes() + words.astype("<u2").tobytes() + side
        head = HEAD.pack(lanes, steps, len(words), size, end - begin, len(side), zlib.crc32(body), zlib.crc32(own.astype("<u4").tobytes()), first)
        sink.write(head)
        sink.write(body)
        index += [offset, len(head) + len(body)]
        yield {"offset": offset, "bytes": len(head) + len(body), "first": first, "tokens": size}
        offset, first, begin = offset + len(head) + len(body), first + size, end
    tail = zlib.compress(np.array(index, "<u8").tobytes())
    sink.write(tail + struct.pack("<II", len(tail), len(index) // 2) + MAGIC)


def read_table(source) -> Coder:
    head = source.read_at(len(MAGIC) + 4, 0)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token shard")
    size = struct.unpack_from("<I", head, len(MAGIC))[0]
    raw = zlib.decompress(source.read_at(size & ~PAIRED, len(head)))
    n = len(raw) // 6
    coder = Coder(np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint32))
    coder.paired = bool(size & PAIRED)
    return coder


def read_block(source, coder: Coder, offset: int, size: int) -> tuple[list, np.ndarray, np.ndarray, int]:
    """(document ids, sizes, ids, ids before the block in its shard); verifies both checksums."""
    data = source.read_at(size, offset)
    lanes, steps, n_words, tokens, n_docs, side, crc, ids_crc, first = HEAD.unpack_from(data)
    body = memoryview(data)[HEAD.size :]
    if zlib.crc32(body) != crc:
        raise ValueError("a block's bytes have another checksum")
    states = np.frombuffer(body, "<u4", lanes)
    ids = coder.decode(lanes, steps, states, np.frombuffer(body, "<u2", n_words, 4 * lanes))
    if coder.paired:
        ids = ((ids[0 : 2 * tokens : 2] - np.uint32(1 << LOW)) << np.uint32(LOW)) | ids[1 : 2 * tokens : 2]
    ids = ids[:tokens]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("a block's ids have another checksum")
    extra = zlib.decompress(body[4 * lanes + 2 * n_words : 4 * lanes + 2 * n_words + side])
    present, names = np.frombuffer(extra, np.uint8, n_docs), np.frombuffer(extra, "<i8", n_docs, n_docs)
    sizes = np.frombuffer(extra, "<u4", n_docs, 9 * n_docs)
    return [int(n) if p else None for n, p in zip(names, present, strict=True)], sizes, ids, first


def index_of(source, size: int) -> np.ndarray:
    """Offset and bytes of each block of a shard, from its own index."""
    tail, _ = struct.unpack_from("<II", source.read_at(16, size - 16))
    return np.frombuffer(zlib.decompress(source.read_at(tail, size - 16 - tail)), "<u8").reshape(-1, 2)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Tokenizes and writes ``docs`` in ascending id order; the manifest has a row for each block."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.col("id"), F.col("h")).sortWithinPartitions("id", "h").select("id", "text")
    plain = works_on_pieces(tokenizer)

    def write(batches):
        from pyspark import TaskContext

        files, root = open_shared(folder)
        files.create_dir(root, recursive=True)
        encode, part, seq, names, chunks, size = encoder(tokenizer, plain), TaskContext.get().partitionId(), 0, [], [], 0

        def shard():
            path = f"{root}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.lxr"
            sizes, ids = (np.concatenate(x) for x in zip(*chunks, strict=True))
            with files.open_output_stream(path) as sink:
                blocks = list(write_shard(sink, names, sizes, ids))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path} | b for b in blocks])

        for batch in batches:
            for own in sliced(batch, 1, 1 << 22, 4096):
                names += own.column(0).to_pylist()
                ids, sizes = encode.many(own.column(1).to_pylist())
                chunks.append((sizes + 1, np.insert(ids, np.cumsum(sizes), end_id)))
                size += len(ids) + len(sizes)
                if size >= SHARD_TOKENS:
                    yield shard()
                    seq, names, chunks, size = seq + 1, [], [], 0
        if names:
            yield shard()

    return staged(rows.mapInArrow(write, "part long, seq long, path string, offset long, bytes long, first long, tokens long"), "tokens-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids): ``start`` counts the ids of all documents before, ``ids`` is little-endian unsigned 32 bit.

    Shards are few (about 2 ** 24 ids each), so their starts come from one window over a row for each of them.
    """
    spark = manifest.sparkSession
    shards = manifest.groupBy("part", "seq").agg(F.sum("tokens").alias("shard_tokens"))
    order = Window.partitionBy(F.lit(0)).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("base", F.coalesce(F.sum("shard_tokens").over(order), F.lit(0))).drop("shard_tokens")
    tasks = max(spark.sparkContext.defaultParallelism, manifest.count() // 16)
    blocks = manifest.join(shards, ["part", "seq"]).select("path", "offset", "bytes", "base")
    blocks = blocks.repartition(tasks, "path", "offset").sortWithinPartitions("path", "offset")

    def read(batches):
        files, _ = open_shared(folder)
        last, source, coder = None, None, None
        for batch in batches:
            for path, offset, size, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != last:
                    source = files.open_input_file(path)
                    last, coder = path, read_table(source)
                names, sizes, ids, first = read_block(source, coder, offset, size)
                ends = np.cumsum(sizes, dtype=np.int64)
                data = pa.py_buffer(ids.astype("<u4").tobytes())
                at = pa.py_buffer(np.r_[0, 4 * ends].astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(base + first + ends - sizes), pa.Array.from_buffers(pa.binary(), len(names), [None, at, data])],
                    ["doc_id", "start", "ids"],
                )

    return blocks.mapInArrow(read, "doc_id long, start long, ids binary")
