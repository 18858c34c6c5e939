"""Near-duplicate documents by order MinHash, verified by banded alignment.

Symbols are shingles of five lower-cased words, labelled with their occurrence (the second "a b c d e" of a text is
another symbol than the first); a text of fewer words is one shingle. A sketch takes the two smallest symbols of a text
under a hash and keeps their text order; a text has ``SKETCHES`` of them. Texts that share a sketch are candidates. Two
texts whose symbol sets have the Jaccard index j share none of 32 sketches with a chance of ``(1 - j * j) ** 32``: 0.4 %
at 0.4, 5 % at 0.3.

The similarity of a pair is ``1 - d / max(m, n)``, with ``d`` the edit distance of the word sequences, taken exactly by a
bit-parallel alignment in a band as wide as the least similarity allows. One changed word in ten leaves it at 0.9, although
it takes five shingles with it.

Classes are the connected components of verified pairs. Equal texts are grouped first by digest, and only one of them is
sketched. Groups of texts with equal sketches are never expanded into pairs:

1. Small groups (``SMALL``) are compared pair by pair. In large ones, members are compared with a pivot, the member with
   the most group mates; groups of one family share it. Groups of one class are done.
2. What is left has a pivot of its own. The edit distance is a metric: a text that differs from the pivot by more than half
   (``APART``) cannot be similar to any text that is similar to the pivot. So what is linked to the pivot is done unless
   some member lies between; the others are sketched again without the symbols that they share with their pivots (the
   passage or the line that brought them together), and meet anew by what else they have in common. As every turn takes
   symbols away, this ends.

No candidate pair is capped or sampled. Beside the chance above, a link can be missed where two texts share next to nothing
but what they also share with a pivot that neither is similar to; the README has the measured recall.

Defined results: null text is a class of its own, and so is a null id; rows that share an id are one document, similar to
all that any of its texts is similar to; empty texts are copies of one another; texts with no word in common with another
stay alone; the class id is the smallest document id in the class; an empty table gives an empty result; other columns are
not read, so no name can clash. A very long text costs its words times its words over 64, and only when it is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import by_ids, give_back, sliced, staged, string_buffers

WORDS, SIMILARITY, APART = 5, 0.8, 0.5
SKETCHES = 32
SMALL = 8
#: Members that a pivot's text is sent for once; so many rows of five small columns are broadcast to the texts at most.
BUCKET, BROADCAST_NEEDS = 64, 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = _mixed(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True


def symbols_of(texts: pa.Array) -> list[np.ndarray]:
    """Occurrence-labelled shingles of each text of a column, in text order; nulls have none."""
    lower = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[\p{Z}\x{85}\x{1c}-\x{1f}]", " ")
    data, offsets = string_buffers(lower)
    data = data[offsets[0] : offsets[-1]]
    letters = np.flatnonzero(~_SPACE[data])
    # a word begins after a gap, or where a text begins
    begins = np.r_[True, np.diff(letters) > 1] if len(letters) else np.empty(0, bool)
    edges = np.searchsorted(letters, offsets - offsets[0])
    begins[edges[edges < len(letters)]] = True
    first = np.flatnonzero(begins)
    place = np.arange(len(letters)) - np.repeat(first, np.diff(np.r_[first, len(letters)]))
    parts = (data[letters].astype(np.uint64) + np.uint64(1)) * _ODD[place & 1023]
    words = _mixed(np.add.reduceat(parts, first)) if len(first) else np.empty(0, np.uint64)
    at = np.searchsorted(first, edges)
    return [_shingles(words[b:e]) for b, e in zip(at[:-1], at[1:], strict=True)]


def _shingles(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    n = min(WORDS, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * _ODD[7] + words[i : len(words) - n + 1 + i]
    out = _mixed(out)
    order = np.argsort(out, kind="stable")
    same = np.r_[False, out[order][1:] == out[order][:-1]]
    if same.any():
        at = np.arange(len(out))
        label = np.empty(len(out), np.uint64)
        label[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
        out = np.where(label > 0, _mixed(out + label * _ODD[11]), out)
    return out


def sketches(symbols: np.ndarray, turn: int = 0) -> np.ndarray:
    """Keys of all sketches of a text; every turn has hashes of its own."""
    n, first = len(symbols), 16 + turn * SKETCHES % 4000
    if n <= 2:  # all sketches would be the same one
        key = _ODD[first : first + min(n, 1)]
        for x in symbols:
            key = _mixed(key * _ODD[3] + x)
        return key
    keys, step = [], max(1, (1 << 16) // n)
    for at in range(0, SKETCHES, step):
        factor = _ODD[first + at : first + min(SKETCHES, at + step), None]
        ranks = symbols[None, :] * factor
        ranks ^= ranks >> np.uint64(32)
        rows = np.arange(len(factor))
        i = ranks.argmin(1)
        ranks[rows, i] = np.iinfo(np.uint64).max
        j = ranks.argmin(1)
        key = _mixed(factor[:, 0] * _ODD[3] + symbols[np.minimum(i, j)])
        keys.append(_mixed(key * _ODD[3] + symbols[np.maximum(i, j)]))
    return np.concatenate(keys)


class Aligner:
    """Edit distances of word sequences to one text, in a band, by bit vectors: a column of the table is one integer, of which
    only the bits in the band are kept."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.where: dict[str, int] = {}
        for i, w in enumerate(words):
            self.where[w] = self.where.get(w, 0) | 1 << i

    def distance(self, words: list[str], most: int) -> int:
        """The distance if it is ``most`` or less, else ``most + 1``; ``most`` is half of the longer text's words at most."""
        m, n = self.n, len(words)
        most = min(most, max(m, n) // 2)
        if abs(m - n) > most:
            return most + 1
        # the highest bit of a column is the lowest row of the band, ``most`` rows below the diagonal; the score is followed
        # along it down to the last row, and then along that row
        width = 2 * most + 2
        full, diagonal, last = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
        vp, vn, score, shift = full ^ ((1 << (width - most - 1)) - 1), 0, most, most + 1 - width
        give_up, steep, where = most + n - (m - most), m - most, self.where
        for j, w in enumerate(words):
            x = where.get(w, 0)
            if x:
                x = (x >> shift if shift >= 0 else x << -shift) & full
            d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
            hp = vn | (full ^ (d0 | vp))
            hn = d0 & vp
            if j < steep:
                score += not d0 & diagonal
            else:
                score += bool(hp & last) - bool(hn & last)
                last >>= 1
            if score > give_up:
                return most + 1
            d0 >>= 1
            vp = hn | (full ^ (d0 | hp))
            vn = d0 & hp
            shift += 1
        return min(score, most + 1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b): equal roots are connected. Every node goes to the neighbour with the
    smallest hash, edges go with their ends, until none is left; edges and parents stay tables throughout."""
    edges, tree, turn = staged(edges.where("a <> b").distinct(), "edges"), None, 0
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("x"))  # noqa: E731,B023
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), F.min(rank("a")))["x"].alias("root"))
        parent = staged(parent, "parents")
        for end in ("a", "b"):
            edges = edges.join(parent.select(F.col("node").alias(end), F.col("root").alias("r")), end).drop(end).withColumnRenamed("r", end)
        edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
        tree = parent if tree is None else follow(tree, parent)
        turn += 1
    return staged(edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if tree is None else tree, "components")


def follow(labels: DataFrame, parent: DataFrame, key: str = "root") -> DataFrame:
    """``labels`` with each ``key`` replaced by its root in ``parent``, if it has one."""
    to = parent.select(F.col("node").alias(key), F.col("root").alias("f_to"))
    return labels.join(to, key, "left").withColumn(key, F.coalesce("f_to", key)).select(*labels.columns)


def sketch_table(texts: DataFrame) -> DataFrame:
    """(key, id) of the sketches of (id, text)."""

    def make(batches):
        for batch in batches:
            for part in sliced(batch, 1):
                yield _keyed([sketches(x) for x in symbols_of(part.column(1))], part.column(0))
        give_back()

    return texts.mapInArrow(make, "key long, id long")


def sketch_rests(rests: DataFrame, turn: int) -> DataFrame:
    """(key, id) of the sketches of what is left of texts: (id, rest)."""

    def make(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                lists = part.column(1)
                flat, at = lists.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
                yield _keyed([sketches(flat[b:e], turn) for b, e in zip(at[:-1], at[1:], strict=True)], part.column(0))
        give_back()

    return rests.select("id", "rest").mapInArrow(make, "key long, id long")


def _keyed(keys: list[np.ndarray], ids: pa.Array) -> pa.RecordBatch:
    rows = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
    flat = np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(flat), ids.take(rows)], ["key", "id"])


#: What a row brings to its bucket, in the order in which they are read.
PIVOT, REST, MEMBER = 0, 1, 2


def compared(pairs: DataFrame, docs: DataFrame, least: float, rests_wanted: bool, rests: DataFrame | None = None) -> DataFrame:
    """The staged pairs (p, id, more) with linked and, where ``more`` is wanted, near (at most ``APART`` from ``p``) and rest: the
    symbols of ``id`` (those in ``rests``, if it is there) that ``p`` lacks.

    Only texts that some pair needs are shuffled, once, to meet their pivot. A pivot's text goes once to each ``BUCKET`` of
    its members, so a hot pivot is dealt out over many tasks, and its text is not multiplied by its members.
    """
    ids = staged(pairs.select(F.col("p").alias("id")).unionAll(pairs.select("id")).distinct(), "pair-ids")
    texts = staged(by_ids(docs, ids, ["id"], "left_semi"), "pair-texts")
    if texts.count() != ids.count():  # rows that share an id
        texts = staged(texts.distinct(), "pair-texts")
    sizes = staged(pairs.groupBy("p").agg(F.ceil(F.count("*") / BUCKET).alias("buckets")), "pivots")
    dealt = by_ids(pairs, sizes, ["p"], "inner").withColumn("part", F.pmod(F.xxhash64("id"), F.col("buckets"))).drop("buckets")
    dealt = staged(dealt.select("p", "part", F.lit(MEMBER).alias("kind"), "id", "more"), "dealt")
    lead = dealt.select("p", "part").distinct().select("p", "part", F.lit(PIVOT).alias("kind"), F.col("p").alias("id"), F.lit(False).alias("more"))
    needs = staged(dealt.unionAll(lead), "needs")
    rows = by_ids(texts, needs, ["id"], "inner", BROADCAST_NEEDS).select("p", "part", "kind", "id", "more", "text", F.lit(None).cast("array<long>").alias("rest"))
    if rests is not None:
        own = by_ids(rests, staged(dealt.where("more"), "rest-needs"), ["id"], "inner", BROADCAST_NEEDS)
        rows = rows.unionAll(own.select("p", "part", F.lit(REST).alias("kind"), "id", "more", F.lit(None).cast("string").alias("text"), "rest"))
    rows = rows.repartition("p", "part").sortWithinPartitions("p", "part", "kind")

    def check(batches):
        bucket, pivots, left = None, [], {}
        for batch in batches:
            for part in sliced(batch, 5):
                out = []
                ps, parts, kinds, ids, mores, texts = (part.column(i).to_pylist() for i in range(6))
                symbols = symbols_of(part.column(5)) if rests_wanted else None
                for i, p in enumerate(ps):
                    if bucket != (p, parts[i]):
                        bucket, pivots, left = (p, parts[i]), [], {}
                    if kinds[i] == REST:
                        left[ids[i]] = part.column(6)[i].values.to_numpy().view(np.uint64)
                        continue
                    own = (texts[i] or "").lower().split()
                    if kinds[i] == PIVOT:
                        pivots.append((Aligner(own), symbols[i] if symbols else None))
                        continue
                    linked = near = False
                    rest = np.empty(0, np.uint64)
                    for pivot, _ in pivots:
                        longer = max(pivot.n, len(own))
                        allowed = int(longer * (1 - least) + 1e-9)
                        distance = pivot.distance(own, int(longer * APART) if mores[i] else allowed)
                        linked |= distance <= allowed
                        near |= distance <= longer * APART
                    if mores[i]:
                        rest = left.get(ids[i], symbols[i])
                        for _, theirs in pivots:
                            rest = rest[~np.isin(rest, theirs)]
                    out.append((p, ids[i], mores[i], linked, near, rest.view(np.int64)))
                if out:
                    offsets = pa.array(np.r_[0, np.cumsum([len(x[5]) for x in out])].astype(np.int32))
                    made = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))]
                    made.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[5] for x in out]))))
                    yield pa.RecordBatch.from_arrays(made, ["p", "id", "more", "linked", "near", "rest"])
        give_back()

    return staged(rows.mapInArrow(check, "p long, id long, more boolean, linked boolean, near boolean, rest array<long>"), "compared")


def rests_of(found: DataFrame) -> DataFrame:
    """(id, rest) of the members of large groups that go on: what they have beside the pivots that they are not linked to; of
    members that are linked to all of theirs, beside those pivots that have a member between near and linked."""
    between = staged(found.where("more AND near AND NOT linked").select("p").distinct(), "between")
    flagged = by_ids(found.where("more"), between.withColumn("open", F.lit(True)), ["p"], "left")
    flagged = flagged.where("NOT linked OR open").select("id", "linked", "rest")
    by = flagged.groupBy("id").agg(  # a member meets SKETCHES pivots at most
        F.collect_list(F.when(~F.col("linked"), F.col("rest"))).alias("apart"), F.collect_list(F.when(F.col("linked"), F.col("rest"))).alias("close")
    )
    lists = F.when(F.size("apart") > 0, F.col("apart")).otherwise(F.col("close"))
    both = F.aggregate(F.slice(lists, 2, SKETCHES * 2), F.element_at(lists, 1), F.array_intersect)
    return by.select("id", both.alias("rest")).where(F.size("rest") > 0)


def small_pairs(groups: DataFrame) -> DataFrame:
    """Distinct pairs (p, id), p < id, within groups of at most ``SMALL`` members, of different classes."""
    lists = groups.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("id", "root")).alias("l"))
    pairs = F.expr("flatten(transform(l, x -> transform(filter(l, y -> y.id > x.id AND y.root <> x.root), y -> struct(x.id AS p, y.id AS id))))")
    return lists.select(F.explode(pairs).alias("x")).select("x.p", "x.id").distinct()


def with_roots(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    rows = rows.withColumn("root", F.col("id"))
    return rows if labels is None else follow(rows, labels)


def open_groups(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, id, root, n) of members (key, id) in groups of more than one class."""
    rooted = with_roots(members, labels)
    stats = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    # a table of its own, so that a hot key's rows can be split in the join
    stats = staged(stats.where("lo < hi").select("key", "n"), "group-sizes")
    return staged(by_ids(rooted, stats, ["key"], "inner"), "groups")


def pivots_of(groups: DataFrame, shared: bool) -> DataFrame:
    """(key, p) of large groups: the member with the most group mates or, if ``shared``, the best of those that members meet in any
    of their large groups, so that groups of one family share a pivot, which need not be a member of each."""
    large = groups.where(F.col("n") > SMALL)
    degree = large.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = large.join(degree, "id").select("key", "id", F.struct("degree", (-F.col("id")).alias("x")).alias("own"))
    best = staged(ranked.groupBy("key").agg(F.max("own").alias("best")), "best")
    if shared:
        near = large.select("key", "id")
        met = by_ids(near, best, ["key"], "inner").groupBy("id").agg(F.max("best").alias("met"))
        best = near.join(met, "id").groupBy("key").agg(F.max("met").alias("best"))
    return best.select("key", (-F.col("best.x")).alias("p"))


def joined_labels(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after the links (a, b) between ids."""
    if labels is None:
        return components(links)
    found = components(follow(follow(links, labels, "a"), labels, "b"))
    return staged(follow(labels, found).unionAll(found.join(labels, "node", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, text_hash, class_id) of every row; ``text_hash`` (xxhash64) tells rows that share an id apart."""
    if least < APART:
        raise ValueError(f"the least similarity is {APART} or more")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    light = rows.select("id", F.xxhash64("text").alias("text_hash"), F.md5(F.col("text").cast("binary")).alias("fp"))
    known = light.where("id IS NOT NULL AND fp IS NOT NULL")
    shared = known.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = staged(by_ids(known, staged(shared, "copied"), ["fp"], "inner").where("id <> rep").select("id", "text_hash", "rep").distinct(), "copies")
    texts = by_ids(
        rows.where("id IS NOT NULL AND text IS NOT NULL").withColumn("text_hash", F.xxhash64("text")),
        copies.select("id", "text_hash"), ["id", "text_hash"], "left_anti",
    ).select("id", "text")
    labels, turn, rests = None, 0, None
    groups = open_groups(staged(sketch_table(texts), "sketches"), None)
    while not groups.isEmpty():
        large = groups.where(F.col("n") > SMALL)
        pivots = staged(pivots_of(groups, turn == 0), "pivots")
        pairs = large.join(pivots, "key").where("id <> p").select("p", "id").distinct()
        found = compared(staged(pairs.withColumn("more", F.lit(turn > 0)).unionAll(small_pairs(groups).withColumn("more", F.lit(False))), "pairs"), texts, least, turn > 0, rests)
        links = found.where("linked").select(F.col("p").alias("a"), F.col("id").alias("b"))
        labels = labels if links.isEmpty() else joined_labels(labels, links)
        if turn == 0:
            groups = open_groups(large.select("key", "id"), labels)
        else:
            rests = staged(rests_of(found), "rests")
            groups = open_groups(staged(sketch_rests(rests, turn), "sketches"), labels)
        turn += 1
    out = by_ids(light, copies, ["id", "text_hash"], "left").withColumn("root", F.coalesce("rep", "id"))
    if labels is not None:
        least_id = labels.groupBy("root").agg(F.min("node").alias("least"))
        named = staged(labels.join(least_id, "root").select(F.col("node").alias("root"), F.col("least").alias("to")), "classes")
        out = by_ids(out, named, ["root"], "left").withColumn("root", F.coalesce("to", "root"))
    return out.select("id", "text_hash", F.col("root").alias("class_id"))
