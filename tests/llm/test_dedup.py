"""Near-duplicates and unit dedup against independent brute force, hot groups, and odd inputs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SF, documents, odd_documents

from lexigrove.llm import near_dup, queries, stages, unit_dedup


def edits(a: list[str], b: list[str]) -> int:
    """Edit distance by the textbook's table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def components(n: int, links) -> list[int]:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    return [root(i) for i in range(n)]


def changed(rng, base: list[str], share: float, words: list[str]) -> list[str]:
    out = list(base)
    for _ in range(int(len(base) * share)):
        i, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.7:
            out[i] = rng.choice(words)
        elif kind < 0.85 and len(out) > 3:
            del out[i]
        else:
            out.insert(i, rng.choice(words))
    return out


def test_alignment_against_the_table():
    rng = random.Random(3)
    for _ in range(4000):
        a = [rng.choice("abcd") for _ in range(rng.randrange(16))]
        b = [x for x in a if rng.random() > 0.2] if rng.random() < 0.5 else [rng.choice("abc") for _ in range(rng.randrange(16))]
        most = rng.randrange(0, max(len(a), len(b)) // 2 + 1)
        assert near_dup.Aligner(a).distance(b, most) == min(edits(a, b), most + 1)


def hot_texts() -> list[str]:
    """A large family, texts that share a long passage or a line, a family in which the pivot is far from some, small families."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    base, passage, line = draw(120), draw(60), draw(9)
    texts = [changed(rng, base, rng.uniform(0.01, 0.09), words) for _ in range(40)]
    texts += [draw(25) + passage + draw(25) for _ in range(30)]  # alike in half of their words: no duplicates
    for _ in range(6):  # duplicates that share the passage as well
        own = draw(30)
        texts += [changed(rng, own + passage + own[:10], 0.04, words) for _ in range(2)]
    texts += [line + draw(rng.randrange(20, 50)) for _ in range(25)]
    for size in (40, 80, 200):
        own = draw(size)
        texts += [changed(rng, own, 0.05, words) for _ in range(rng.randrange(2, 6))]
    between = changed(rng, base, 0.14, words)  # a chain away from the large family
    texts += [between, changed(rng, between, 0.12, words)]
    return [" ".join(t) for t in texts]


def test_near_duplicates_against_all_pairs(spark):
    texts = hot_texts()
    split = [t.lower().split() for t in texts]
    links, least = [], near_dup.SIMILARITY
    for i in range(len(texts)):
        for j in range(i):
            longer = max(len(split[i]), len(split[j]))
            if longer - min(len(split[i]), len(split[j])) <= 0.2 * longer and 1 - edits(split[i], split[j]) / longer >= least - 1e-12:
                links.append((i, j))
    want = components(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    linked = [got[i] == got[j] for i, j in links]
    assert np.mean(linked) >= 0.98
    assert all(want[i] == want[got[i]] for i in got)  # nothing is joined that is not connected


def test_near_duplicates_of_the_table_against_all_pairs(spark):
    rows = [(r["id"], r["class_id"]) for r in near_dup.near_duplicates(documents(spark)).collect()]
    got, found = dict(rows), documents(spark).orderBy("doc_id").collect()
    split = [(r["text"] or "").lower().split() for r in found]
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in split]
    links = []
    for i in range(len(found)):
        for j in range(i):
            m, n = sorted((len(split[i]), len(split[j])))
            if m and m >= 0.8 * n and shingles[i] & shingles[j] and 1 - edits(split[i], split[j]) / n >= 0.8:
                links.append((found[i]["doc_id"], found[j]["doc_id"]))
    assert links and np.mean([got[a] == got[b] for a, b in links]) >= 0.95


def test_near_duplicates_odd_inputs(spark):
    docs = odd_documents(spark).withColumn("id", F.lit("clash")).withColumn("text_hash", F.lit("clash"))
    out = near_dup.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    classes = {r["id"]: r["class_id"] for r in out if r["id"] != 3}
    assert classes[0] == 0 and classes[8] == classes[7] == 7 and classes[None] is None
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near_dup.near_duplicates(docs, least=0.3)


def test_near_dedup_keeps_one_of_equal_rows(spark):
    docs = documents(spark).limit(20)
    out = stages.near_dedup(spark, docs.unionAll(docs), SF)
    assert out.count() == out.select("doc_id").distinct().count() == stages.near_dedup(spark, docs, SF).count()


def passages_removed(rows: list[tuple], min_words: int, least: int) -> dict:
    """What unit dedup removes, written again: word by word, without patterns."""
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        units, begin = [], 0
        for line in (text or "").split("\n"):
            start, count = 0, 0
            tokens = list(re.finditer(r"\S+", line))
            for k, t in enumerate(tokens):
                count += 1
                if (count >= min_words and t[0][-1] in ".!?") or k == len(tokens) - 1:
                    end = len(line) if k == len(tokens) - 1 and not (count >= min_words and t[0][-1] in ".!?") else t.end()
                    units.append((" ".join(line[start:end].lower().split()), begin + start, begin + end, count))
                    start, count = end, 0
            begin += len(line) + 1
        mine, run, spans = set(), [], []
        for unit in [*units, None]:
            if unit and (unit[0] in mine or seen.get(unit[0], doc) != doc):
                run.append(unit)
            else:
                if run and sum(u[3] for u in run) >= least:
                    spans.append((run[0][1], run[-1][2]))
                run = []
            if unit:
                mine.add(unit[0])
        for unit in units:
            seen.setdefault(unit[0], doc)
        out[doc] = spans
    return out


def test_unit_dedup_of_the_table_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    want, texts = passages_removed(rows, unit_dedup.MIN_WORDS, unit_dedup.PASSAGE), dict(rows)
    out = queries.op7_unit_dedup(spark, SF).collect()
    assert len(out) == len(rows) and any(want.values())
    for r in out:
        got = [(x["begin"], x["end"]) for x in r["removed"]]
        trimmed = [(b, e - (texts[r["doc_id"]][e - 1] == "\n")) for b, e in got]
        assert trimmed == want[r["doc_id"]] and r["n_removed"] == len(got)
        kept, at = "", 0
        for b, e in got:
            kept, at = kept + texts[r["doc_id"]][at:b], e
        assert r["text"] == (None if texts[r["doc_id"]] is None else kept + texts[r["doc_id"]][at:])


PASSAGE = " ".join(f"word{i}" for i in range(30)) + "."


def test_unit_dedup_odd_inputs(spark):
    extra = {"id": F.lit("a"), "hash": F.lit("b"), "spans": F.lit("c"), "h1": F.lit("d"), "u_key": F.lit("e"), "REMOVED_": F.lit("f")}
    docs = odd_documents(spark).withColumns(extra).withColumn("removed", F.lit("replaced"))
    out = unit_dedup.dedup_units(docs)
    assert [c for c in out.columns if c != "removed"] == [c for c in docs.columns if c != "removed"]
    assert sorted(map(str, (r["text"] for r in out.collect()))) == sorted(map(str, (r["text"] for r in docs.collect())))
    assert unit_dedup.dedup_units(docs.limit(0)).count() == 0


def test_unit_dedup_by_hand(spark):
    line = "a short line of nine words that many share."
    rows = [(2, f"one.\n{PASSAGE} And the rest of it.\n"), (1, f"{line}\n{PASSAGE}\nend"), (3, f"{line}\nno."), (4, f"{PASSAGE}\n{PASSAGE}\n"), (None, "x"), (5, None)]
    rows += [(6, "is new"), (6, "is new")]
    out = {r["doc_id"]: r for r in unit_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"] == rows[1][1] and out[1]["removed"] == []
    assert out[2]["text"] == "one.\n And the rest of it.\n" and out[2]["removed"][0]["begin"] == 5
    assert out[3]["text"] == rows[2][1]  # a line alone is no passage
    assert out[4]["text"] == "" and out[4]["removed"][0]["end"] == len(rows[3][1])
    assert out[5]["text"] is None and out[6]["text"] == "is new"
