"""Substring deduplication by hashing lines and the sentences in them.

A text is cut into units: every line is cut at sentence ends (``.``, ``!`` or ``?`` before white space) where at least
``min_words`` words have gathered, so that short sentences join the next one and the cuts fall into step again after one
long sentence, wherever a passage begins. A unit is lower-cased, its white space made single blanks, and digested to 128
bits. Digests are grouped over all documents; the occurrence with the smallest (id, position) stays, the others are repeats.

A passage is a run of adjacent repeats, in any number of lines, and goes if it has ``passage`` words or more: lines that
many documents share by chance or by habit (a greeting, a licence line) leave their documents as they are. The default is
half of 50 words, as a repeated passage of 50 words need not begin or end where its first and last units do.

Lines alone, the plain form of this method, miss every passage that begins or ends within a line; the README has the
figures of both, and the measured recall.

Defined results: null text stays null; rows that share an id are one document, and what one has of another's units stays;
a null id comes before the others; repeats within a document go, too; equal occurrences at the same place (repeated rows)
keep the same units; a passage that is all of a line takes its line break with it; a very long text is cut like any other,
one text at a time; an empty table gives an empty result. ``text`` and ``removed`` replace the input's columns of these
names; no other name can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.llm.common import by_ids, free_name, give_back, sliced, staged

MIN_WORDS, PASSAGE = 8, 25
#: So many texts' spans are broadcast to the texts at most.
BROADCAST_SPANS = 500_000


def unit_pattern(min_words: int) -> re.Pattern:
    return re.compile(rf"[^\S\n]*+(?:\S++[^\S\n]++){{{max(0, min_words - 1)},}}?\S*[.!?]++(?=\s|\Z)|[^\n]+")


def units_of(text: str, pattern: re.Pattern) -> Iterator[tuple[bytes, int, int, int]]:
    """(digest, begin, end, words) of every unit, in code points; what holds no word is none."""
    for m in pattern.finditer(text):
        words = m[0].lower().split()
        if words:
            yield blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest(), m.start(), m.end(), len(words)


def passages(found: list[tuple[int, int, int, int]], least: int) -> list[tuple[int, int]]:
    """Spans of the runs of adjacent units (place, begin, end, words) that have ``least`` words."""
    spans, words, begin, last, end = [], 0, 0, None, 0
    for at, b, e, n in sorted(set(found)):
        if last is None or at != last + 1:
            if words >= least:
                spans.append((begin, end))
            words, begin = 0, b
        words, last, end = words + n, at, e
    if words >= least and last is not None:
        spans.append((begin, end))
    return spans


def spliced(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans (in order, apart); the spans as they were cut."""
    kept, at, cut = [], 0, []
    for b, e in spans:
        if (b == 0 or text[b - 1] == "\n") and text[e : e + 1] == "\n":
            e += 1
        kept.append(text[at:b])
        cut.append((b, e))
        at = e
    return "".join(kept) + text[at:], cut


def units(docs: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2, id, hash, again, at, begin, end, words) of all units of (id, hash, text); ``again``: the document has the unit
    further up."""
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches):
        pattern = unit_pattern(min_words)
        for batch in batches:
            for part in sliced(batch, 2):
                digests, rows, numbers, again = [], [], [], []
                for row, text in enumerate(part.column(2).to_pylist()):
                    seen = set()
                    for at, (digest, begin, end, words) in enumerate(units_of(text or "", pattern)):
                        digests.append(digest)
                        rows.append(row)
                        numbers.append((at, begin, end, words))
                        again.append(digest in seen)
                        seen.add(digest)
                pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                four = np.array(numbers, np.int32).reshape(-1, 4)
                take = pa.array(rows, pa.int32())
                columns = [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)]
                columns += [part.column(i).take(take) for i in (0, 1)] + [pa.array(again, pa.bool_())]
                columns += [pa.array(np.ascontiguousarray(four[:, i])) for i in range(4)]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "id", "hash", "again", "at", "begin", "end", "words"])
        give_back()

    return docs.select("id", "hash", "text").mapInArrow(
        cut, f"h1 long, h2 long, id {kind}, hash long, again boolean, at int, begin int, end int, words int"
    )


def repeats(docs: DataFrame, min_words: int, passage: int) -> DataFrame:
    """(id, hash, spans) of the texts (id, hash, text) that lose something: spans in order, as [begin, end)."""
    found = staged(units(docs, min_words), "units")
    first = found.groupBy("h1", "h2").agg(
        F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("nameless"), F.count("*").alias("n")
    )
    first = staged(first.where("n > 1").drop("n"), "repeated-units")  # a table of its own: the join can split a hot digest
    later = found.join(first, ["h1", "h2"]).where("again OR (nameless AND id IS NOT NULL) OR (NOT nameless AND id <> first)")
    runs = later.groupBy("id", "hash").agg(F.collect_list(F.struct("at", "begin", "end", "words")).alias("l"))
    kind = docs.schema["id"].dataType.simpleString()

    def joined(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                spans = [passages([tuple(x.values()) for x in units], passage) for units in part.column(2).to_pylist()]
                made = pa.array([[{"begin": b, "end": e} for b, e in x] for x in spans], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), made], ["id", "hash", "spans"]).filter(pa.array([bool(x) for x in spans], pa.bool_()))

    return staged(runs.mapInArrow(joined, f"id {kind}, hash long, spans array<struct<begin: int, end: int>>"), "spans")


def dedup_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, passage: int = PASSAGE
) -> DataFrame:
    """``docs`` with repeated passages cut from the text, and ``removed``: array of [begin, end) in the original text.

    Units are cut once and staged; digests are shuffled twice (grouped, then joined to the repeated ones only). Texts that
    lose nothing are not shuffled.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    spans = repeats(keyed, min_words, passage)
    columns = [c for c in docs.columns if c != "removed"]
    at = columns.index(text_col)
    i, h, s = (free_name(columns, x) for x in ("id", "hash", "spans"))
    spans = spans.withColumnsRenamed({"id": i, "hash": h, "spans": s}).withColumn(i, F.array(i))  # as arrays, null ids are equal
    hashed = docs.select(*columns, F.array(id_col).alias(i), F.xxhash64(F.col(text_col)).alias(h))
    whole = by_ids(hashed, spans.select(i, h), [i, h], "left_anti").select(*columns)
    touched = by_ids(hashed, spans, [i, h], "inner", BROADCAST_SPANS).select(*columns, s)

    span = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = docs.select(*columns).schema.add("removed", T.ArrayType(span))
    spans_of = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def cut_out(batches):
        for batch in batches:
            for part in sliced(batch, at):
                out, cuts = [], []
                for text, found in zip(part.column(at).to_pylist(), part.column(len(columns)).to_pylist(), strict=True):
                    kept, cut = spliced(text, [(x["begin"], x["end"]) for x in found])
                    out.append(kept)
                    cuts.append([{"begin": b, "end": e} for b, e in cut])
                made = [*part.columns[: len(columns)], pa.array(cuts, spans_of)]
                made[at] = pa.array(out, part.column(at).type)
                yield pa.RecordBatch.from_arrays(made, [*columns, "removed"])
        give_back()

    none = F.array().cast(T.ArrayType(span)).alias("removed")
    return whole.select(*columns, none).unionAll(touched.mapInArrow(cut_out, schema))
