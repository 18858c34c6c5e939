"""The corpus operators against brute force, exact round trips, and odd inputs: nulls, empty texts, ties, repeats, clashing columns."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import html_text, langid, media, mixing, near_dup, pieces, queries, stages, token_store, topk, unit_dedup, warc
from lexigrove.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   ", "\n", "one", "Ünï ☃ 漢字 😀 x", "a " * 40_000, "same text here again now", "same text here again now", "123 456", "l1 is a line of words.\nl1 is a line of words.\n"]


def odd_documents(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None) for i, t in enumerate(ODD)]
    rows += [(None, "an id that is null", None, None, None), (3, "\n", "en", "s0", None), (3, "other text, same id", "de", "s1", None)]
    return spark.createDataFrame(rows, DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1. Language identification


def test_language_on_held_out_rows(spark):
    out = queries.op1_language_id(spark, SF).join(documents(spark).select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = out[out.held_out & out.lang.notna()]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.9
    assert out.score.between(0, 1).all()
    crc = out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (crc == out.held_out).all()


def test_language_odd_inputs(spark):
    docs = odd_documents(spark).withColumn("score", F.lit("clash"))
    out = langid.identify_documents(docs).collect()
    assert len(out) == docs.count()
    by_text = {r["text"]: (r["lang_pred"], r["score"]) for r in out}
    assert by_text[None] == by_text[""] == by_text["123 456"] == ("und", 0.0)
    assert by_text["one"][0] in ("en", "de")
    assert langid.identify_documents(docs.limit(0)).count() == 0


def test_every_language_is_learned(spark):
    rows = [(i, f"words of language number {i % 70}", f"l{i % 70:02d}") for i in range(210)] + [(1000, "a null language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_sample(docs, F.lit(True), "doc_id", "text", "lang")
    assert sorted(sample) == sorted((r[2], r[1]) for r in rows[:-1])


def test_more_languages_than_a_batch_take_turns(monkeypatch):
    seen, real = set(), langid.gradients

    def watched(net, x, y):
        seen.update(y.tolist())
        return real(net, x, y)

    monkeypatch.setattr(langid, "gradients", watched)
    langid.train([(f"l{i}", f"text {i}") for i in range(250)], steps=2)
    assert seen == set(range(250))


def test_network_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = langid.fresh(["a", "b"], hidden=3)
    for k, w in net.weights().items():
        setattr(net, k, w.astype(np.float64))
    x, y = rng.integers(0, 256, (6, 4)).astype(np.uint8), np.array([0, 1, 0, 1])
    _, g = langid.gradients(net, x, y)
    for k in ("gate", "cand", "out", "bias", "byte"):
        w = getattr(net, k)
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        w[at] += 1e-4
        up = langid.gradients(net, x, y)[0]
        w[at] -= 2e-4
        down = langid.gradients(net, x, y)[0]
        w[at] += 1e-4
        assert g[k][at] == pytest.approx((up - down) / 2e-4, rel=0.05)


# 2. Token store


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))


def test_token_store_round_trip(spark):
    t, start = tokenizer(), 0
    got = {r["doc_id"]: r for r in queries.op2_token_store(spark, SF).collect()}
    for r in documents(spark).orderBy("doc_id").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_store_odd_inputs(spark):
    folder, docs = shared_dir(spark, "t"), odd_documents(spark)
    path = queries.tokenizer_file("byte_bpe_50k.json")
    back = token_store.read_tokens(token_store.write_tokens(docs, path, folder), folder).orderBy("start").collect()
    assert len(back) == docs.count() and back[0]["doc_id"] is None and back[0]["start"] == 0
    assert [r["start"] for r in back] == np.cumsum([0, *[len(r["ids"]) // 4 for r in back]])[:-1].tolist()
    assert [r["doc_id"] for r in back[1:]] == sorted(r["doc_id"] for r in back[1:])
    for few, n in ((docs.limit(0), 0), (docs.where("text IS NULL OR text = ''"), 2)):
        folder = shared_dir(spark, "t")
        assert token_store.read_tokens(token_store.write_tokens(few, path, folder), folder).count() == n


def test_encoder_equals_the_library_on_odd_texts(monkeypatch):
    monkeypatch.setattr(token_store.Known, "MOST", 50)
    path = queries.tokenizer_file("byte_bpe_50k.json")
    mine, t = token_store.Encoder(path, token_store.works_on_pieces(path)), tokenizer()
    rng = np.random.default_rng(0)
    parts = [*"ab .,'\n\t!?éß²½_-1☃", "  ", " .", "..", "the ", "don't ", "漢", "😀"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, rng.integers(0, 30)))
        assert mine(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_knows_added_tokens():
    path = queries.tokenizer_file("byte_bpe_50k.json")
    mine, t = token_store.Encoder(path, token_store.works_on_pieces(path)), tokenizer()
    for text in ("one<|endoftext|>two", "<|endoftext|>", "a <|endoftext|> b.", "漢<|endoftext|>\n", "<|endoftext|", "one two"):
        assert mine(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert np.frombuffer(mine("one<|endoftext|>two"), "<u4").tolist() == [505, 50256, 11545]


def test_ans_blocks_decode_and_checksums_tell():
    rng = np.random.default_rng(2)
    for ids in (np.array([5], "<u4"), np.zeros(1000, "<u4"), rng.zipf(1.3, 50_000).clip(0, 40_000).astype("<u4")):
        coder = token_store.Coder(*token_store.frequencies(np.bincount(ids)))
        assert coder.freq.sum() == 1 << token_store.SCALE
        lanes, steps, states, words = coder.encode(ids)
        assert (coder.decode(lanes, steps, states, words)[: len(ids)] == ids).all()
    with pytest.raises(ValueError):
        coder.decode(lanes, steps, states, np.r_[words, words[:1]])


def test_shard_of_many_distinct_ids():
    import io

    import pyarrow as pa

    rng = np.random.default_rng(4)
    for ids in (rng.permutation(150_000).astype("<u4"), rng.integers(0, 1 << 28, 90_000).astype("<u4"), np.arange(5, dtype="<u4")):
        sink, names, sizes = io.BytesIO(), [None, 7, 8], np.array([2, len(ids) - 3, 1])
        blocks = list(token_store.write_shard(sink, names, sizes, ids))
        source = pa.PythonFile(io.BytesIO(sink.getvalue()), "r")
        source = pa.BufferReader(sink.getvalue()) if not hasattr(source, "read_at") else source
        coder, got = token_store.read_table(source), []
        for b in blocks:
            who, n, back, first = token_store.read_block(source, coder, b["offset"], b["bytes"])
            got += zip(who, n.tolist(), strict=True)
            assert (back == ids[first : first + len(back)]).all() and b["first"] == first
        assert got == list(zip(names, sizes.tolist(), strict=True))


# 3. Exact top-k


def brute_topk(rows, k=10):
    v = {i: [int(np.floor(1024 * float(x))) for x in e] for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = {}
    for q in (i for i in v if i % 100 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(v[q], v[c], strict=False)), c) for c in v if c != q))[:k]
        out |= {(q, n): (c, -s) for n, (s, c) in enumerate(scores, 1)}
    return out


def test_topk_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(250)]
    rows += [(i, rows[7][1]) for i in range(250, 300)] + [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (400, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r[0], r[1]) for r in df.collect()]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_topk(df, F.col("vec_id") % 100 == 0).collect()}
    assert got == brute_topk(rows)
    few = df.where("vec_id IN (0, 5, 9)")
    assert topk.exact_topk(few, F.col("vec_id") % 100 == 0).count() == 2
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# 4. WARC


def test_warc_records(spark):
    rows = [(1, "http://a", "x" * 5000), (2, "http://b", "x" * 5000), (3, None, None), (4, "http://d", ""), (5, "u", "ü☃"), (None, "n", "x" * 5000), (2, "http://b", "x" * 5000)]
    pages, folder = spark.createDataFrame(rows, "page_id long, url string, html string"), shared_dir(spark, "w")
    got = warc.read_archives(warc.write_archives(pages, folder), folder).collect()
    assert len(got) == len(rows)
    first = {r["page_id"]: r for r in got}
    assert first[2]["record_type"] == "response" and first[1]["record_type"] == "revisit" and first[1]["refers_to"] == 2
    assert first[4]["record_type"] == "response" and first[3]["refers_to"] == 4
    assert first[5]["payload"] == "ü☃".encode() and first[5]["payload_digest"] == base64.b32encode(hashlib.sha1("ü☃".encode()).digest()).decode()
    assert first[None]["refers_to"] == 2 and first[1]["payload_bytes"] == 5000
    folder = shared_dir(spark, "w")
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder), folder).count() == 0


def test_warc_dictionary_frame(tmp_path):
    import io

    sink = io.BytesIO()
    sink.close, data = lambda: None, [warc.record(i, "u", f"<p>record {i} of many".encode() * 50, "D", 1, None) for i in range(200)]
    writer = warc.ArchiveWriter(sink)
    for x in data:
        writer.add(x)
    writer.close()
    sink.seek(0)
    assert list(warc.read_archive(sink)) == data
    assert len(sink.getvalue()) < sum(map(len, data)) / 4


# 5. Pieces


def test_pieces_equal_the_reference_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    out = queries.op5_pieces(spark, SF).join(documents(spark).select("doc_id", "text"), "doc_id").collect()
    assert all(list(r["ids"]) == model.encode(r["text"] or "") and r["round_trip"] for r in out)


def test_pieces_odd_inputs(spark):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = odd_documents(spark).withColumn("ids", F.lit("clash"))
    out = pieces.encode(docs, pieces.load(path)).collect()
    assert len(out) == docs.count() and all(list(r["ids"]) == model.encode(r["text"] or "") for r in out)
    assert pieces.encode(docs.limit(0), pieces.load(path)).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(4)
    for n, symbols in ((1, 2), (50, 2), (300, 4), (300, 3000)):
        text = rng.integers(0, symbols, n)
        order = pieces.suffix_array(text, n)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


# 6. Mixing


def test_mix_meets_targets(spark):
    out = queries.op6_mix_sources(spark, SF).join(documents(spark).select("doc_id", "source"), "doc_id").toPandas()
    per = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(per.taken - per.target) <= 1).all()
    assert (out.taken <= 3 * out["size"]).all() and per.target.sum() == pytest.approx(out["size"].sum())


def test_mix_caps_and_odd_inputs(spark):
    docs = odd_documents(spark).withColumn("size", F.lit("clash"))
    out = mixing.mix_sources(docs).collect()
    assert len(out) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    again = mixing.mix_sources(docs.repartition(5)).select("doc_id", "text", "taken").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in mixing.mix_sources(docs).select("doc_id", "text", "taken").collect())


# 8. Main text


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="ad-banner">Buy now!</div>
<article><h1>The &quot;title&quot; &amp; more</h1><p>First   paragraph, with <b>bold</b> text
and a line.</p><p>Second paragraph &mdash; long enough, it has commas, and words.</p><script>var x = "<p>no</p>";</script></article>
<div id="comments"><p>A reader says something, at length, about this.</p></div><footer>Imprint</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == ['The "title" & more', "First paragraph, with bold text and a line.", "Second paragraph — long enough, it has commas, and words."]
    assert html_text.main_text("") == "" and html_text.main_text("<p") == ""
    assert html_text.main_text("<P>Plain text, no more.") == "Plain text, no more."


def test_main_text_of_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", PAGE), (4, "w", "<div>" * 3000 + "deep text, here." + "</div>"), (5, "x", "<p>" + "long text, " * 30_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(pages).collect()
    assert [r["n_chars"] for r in got][:2] == [0, 0] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert "Second paragraph" in got[2]["text"] and got[4]["n_chars"] > 300_000
    assert html_text.extract(pages.limit(0)).count() == 0


STORY = "".join(f"<p>Paragraph {i} of the story, which is long enough, has commas, and goes on for a while.</p>" for i in range(6))


def test_main_text_ratios_decide_inside_an_article():
    tags = "".join(f"<div><span>Tag{i}</span></div>" for i in range(12))
    got = html_text.main_text(f"<body><article><h1>Title</h1>{STORY}{tags}</article></body>")
    assert got.count("of the story") == 6 and got.startswith("Title") and "Tag6" not in got
    long = "A sentence, with marks, and words. " * 400
    assert html_text.main_text(f"<article><p><b>{long}</b></p>{STORY}</article>").count("of the story") == 6


def test_main_text_short_article_beside_the_story():
    teaser = '<article class="teaser"><p>Read our other piece, too.</p></article>'
    got = html_text.main_text(f"<body><div>{STORY}</div>{teaser}</body>")
    assert got.count("of the story") == 6


def test_main_text_words_inside_an_article_are_hints_only():
    for name in ("discussion", "related-work", "side-effects", "search", "alerts"):
        got = html_text.main_text(f'<article><div class="entry-header"><h1>Title</h1></div>{STORY}<section id="{name}">{STORY}</section></article>')
        assert got.startswith("Title") and got.count("of the story") == 12
    noise = '<div class="related"><a href=1>Another story, which is as long as a paragraph.</a></div><div class="promo">Buy now!</div>'
    got = html_text.main_text(f"<article>{STORY}{noise}</article>")
    assert got.count("of the story") == 6 and "Another" not in got and "Buy" not in got


def test_main_text_stray_quotes_in_tags():
    assert html_text.main_text("<p title=it's>one two</p><p>four, five</p>") == "one two\nfour, five"
    assert html_text.main_text('<p class="x"">one</p><p>two</p>') == "one\ntwo"
    assert html_text.main_text("<p title=a=\"b>one</p><p \"c>two</p><p ='d'>three</p>") == "one\ntwo\nthree"
    assert html_text.main_text("<p title = \"a > b\" id='c>d'>one</p><p>two</p>") == "one\ntwo"
    assert html_text._attributes("class=\"x y\" id = 'z' href=/a/b checked title=it's lang=\"\"") == {"class": "x y", "id": "z", "href": "/a/b", "checked": "", "title": "it's", "lang": ""}


# 10. Media


def test_media_round_trip(spark):
    folder, docs = shared_dir(spark, "m"), odd_documents(spark)
    media.write_media(docs, folder)
    got = media.features(media.read_media(spark, folder)).collect()
    assert len(got) == docs.count()
    sums = sorted(r["payload_sha256"] for r in got)
    padded = lambda t: (t or "").encode() + bytes(-len((t or "").encode()) % 64 or (0 if t else 64))
    assert sums == sorted(hashlib.sha256(padded(r["text"])).hexdigest() for r in docs.collect())
    assert all(r["payload_bytes"] % 64 == 0 and json.loads(r["feature"])["bands"] for r in got)


def test_media_member_is_retried_alone(monkeypatch, tmp_path):
    calls, real = [], media.read_member

    def flaky(files, path, member):
        calls.append(member.filename)
        if len(calls) == 1:
            raise OSError("gone")
        return real(files, path, member)

    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(3):
            z.writestr(f"{i}/{i}.png", media.encoded(b"text %d" % i))
    monkeypatch.setattr(media, "read_member", flaky)
    reader = media.MediaReader(f"file://{tmp_path}", 64)
    rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted(r["doc_id"] for r in rows) == [0, 1, 2] and len(calls) == 4


def test_media_of_failed_tasks_are_not_read(spark, monkeypatch):
    real = media.write_media

    def leaving(docs, folder):
        manifest = real(docs, folder)
        path = Path(manifest.first()["path"])
        path.with_name("again.zip").write_bytes(path.read_bytes())
        path.with_name("killed.zip").write_bytes(path.read_bytes()[:1000])
        return manifest

    monkeypatch.setattr(media, "write_media", leaving)
    got = sorted(r["doc_id"] for r in queries.op10_media(spark, SF).collect())
    assert got == sorted(r["doc_id"] for r in documents(spark).collect())
    folder = shared_dir(spark, "m")
    assert media.read_media(spark, folder, real(odd_documents(spark).limit(0), folder)).count() == 0
