"""The corpus pipeline, stage by stage and from end to end."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_dedup import passages_removed
from test_operators import SF, documents, odd_documents

from lexigrove.llm import html_text, mixing, near_dup, queries, stages, unit_dedup


def test_stages_keep_columns_and_survive_odd_rows(spark):
    docs = odd_documents(spark)
    for stage in (stages.language_id, stages.near_dedup, stages.substring_dedup, stages.mix):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert stages.near_dedup(spark, docs, SF).where("text = 'same text here again now'").count() == 1
    assert stages.encode(spark, docs, SF).count() == docs.count()


def test_clashing_names(spark):
    names = ["m_key", "m_null", "m_row", "m_id", "m_copy", "m_one", "M_BASE", "id", "text_hash", "h_html", "hash", "spans"]
    docs = odd_documents(spark).withColumns({x: F.lit(x) for x in names})
    for stage in (stages.near_dedup, stages.substring_dedup, stages.mix):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.where("m_key <> 'm_key' OR M_BASE <> 'M_BASE'").count() == 0
    mixed = mixing.mix_sources(docs)
    assert set(docs.columns) <= set(mixed.columns) and mixed.count() == docs.count()
    pages = docs.withColumnRenamed("text", "html").withColumns({"page_id": F.col("doc_id"), "url": F.lit("u")})
    assert html_text.extract(pages).count() == docs.count()


def test_pipeline_against_brute_force(spark):
    import sentencepiece

    import corpus_pipeline

    docs = documents(spark)
    kept = stages.language_id(spark, docs, SF)
    classes = {r["id"]: r["class_id"] for r in near_dup.near_duplicates(kept).collect()}
    rows = {r["doc_id"]: r["text"] for r in kept.collect() if classes[r["doc_id"]] == r["doc_id"]}
    spans, texts = passages_removed(list(rows.items()), unit_dedup.MIN_WORDS, unit_dedup.PASSAGE), {}
    for i, text in rows.items():
        left, at = "", 0
        for b, e in spans[i]:
            whole = (b == 0 or text[b - 1] == "\n") and text[e : e + 1] == "\n"
            left, at = left + text[at:b], e + whole
        if not spans[i] or (left + text[at:]).strip():
            texts[i] = left + text[at:]
    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r["doc_id"] for r in out} <= set(texts)
    assert all(list(r["ids"]) == model.encode(texts[r["doc_id"]]) and r["n_pieces"] == len(r["ids"]) for r in out)
    words = {i: len([w for w in t.split() if w]) for i, t in texts.items()}
    assert abs(sum(words[r["doc_id"]] for r in out) / max(1, sum(words.values())) - 1) < 0.25
