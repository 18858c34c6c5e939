"""Annotators that run together in Arrow batches against the column expressions, and how much they hold at once."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexigrove.operators import access, batch_rules, chains, entities, morphology, patterns, roles, syntax, tokens
from lexigrove.plans import catalogue
from lexigrove.sources import utterances

ODD = [
    None, "", " ", "\n\n", "I can't say it's $5.50 ago--never ... 667-16-9329", "....... a.b 1.2.3. x-y--z 'tis o’clock ’’ don''t",
    'Mr. Smith went. " Hello" said Dr. Who?! (Yes.) No...', "²³ ½x Ⅷ a1b2 1a-2b -- - --- ---- 12:30/1", "İstanbul ΣΑΣ ſize the THE Of the",
    "😀 a😀b 日本語 テスト é àb", "a b x y z\u0085z", "they'Ll CAN'T n't it's 's THAT'S", "of the of of the and & in the in on the of big old the",
    "He has liked to like. I like cats; do like? this works cats' dogs that runs", "$ 5 million, 5 dollars 10 % 12,345 May 1999 3 June Paris Acme Inc. john John Smith",
    ".", '?"', 'x" . " y', "The the THE The. the",
]
ITEMS = [
    *catalogue.LITERAL_ITEMS,
    patterns.Item("([{word:/(?i)of/}]) (?$what [{word:/(?i)the/}])", "OF_THE", features={"part": "article"}, is_regexp=True, feature_group="$what"),
    patterns.Item('[{lemma:"be"}]', "BE", is_regexp=True),
    patterns.Item(r"/\p{L}+-\p{L}+/", "HYPHEN", id=7, features={"a": "b"}, is_regexp=True),
    patterns.Item("[{tag:/NN.?/}]+ []? [{ner:/NUMBER/}]", "NUMBERED", is_regexp=True),
]


def annotated(df, together: bool):
    df = tokens.tokenize(df) if together else df.withColumn("tokens", tokens.token_array(F.col("text")))
    df = morphology.flag_stop_words(morphology.add_lemmas(morphology.tag_parts_of_speech(tokens.split_sentences(df))))
    df = entities.recognize_entities(df)
    df = roles.label_roles(syntax.add_parse_trees(syntax.add_dependencies(df), use_shift_reduce=True, include_score=True))
    rules = patterns.rules_of(ITEMS)
    df = patterns.kept_matches(patterns.match_patterns(df, rules), rules)
    assert bool(chains.steps(df)) == together
    return df


def test_chain_equals_expressions(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    a, b = annotated(df, True), annotated(df, False)
    assert {f.name: f.dataType.simpleString() for f in a.schema} == {f.name: f.dataType.simpleString() for f in b.schema}
    wanted = {r["doc_id"]: r.asDict(True) for r in b.collect()}
    assert {r["doc_id"]: r.asDict(True) for r in a.collect()} == wanted


@pytest.mark.parametrize("name", ["pos_features", "pos_tag", "sentence_lengths", "range_in", "tokre_literal", "tokre_sequence", "tokre_quantifier", "mention_concat", "wordcount_quality", "srl_features", "verb_features_root", "parse_tree_shift_reduce"])
def test_texts_are_annotated_once_and_in_arrow(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "regexp_extract_all" not in plan


@pytest.mark.parametrize("name", ["dep_parent_join", "srl_heads", "mention_overlap"])
def test_what_stands_in_one_row_is_not_joined(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_overlaps_without_pairs(spark):
    ranges = [(0, 5), (5, 9), (6, 7), (20, 21), (0, 30)]
    df = spark.createDataFrame([(1, ranges), (2, []), (3, None), (4, [(1, 2), (1, 2)])], "id long, r array<struct<begin:int,end:int>>")
    got = {r["id"]: r["n"] for r in df.select("id", access.overlap_count(F.col("r")).alias("n")).collect()}
    pairs = sum(a[0] <= b[1] and b[0] <= a[1] for i, a in enumerate(ranges) for b in ranges[:i])
    assert got == {1: pairs, 2: 0, 3: 0, 4: 1}


def test_a_batch_is_annotated_in_slices():
    from lexigrove.operators import batches

    texts = pa.array(["a b. " * 10_000, None, "x", "é" * 40_000] * 20)
    parts = list(batches.slices(texts, 100_000))
    assert [t for p in parts for t in p] == [t or "" for t in texts.to_pylist()] and len(parts) > 10
    assert max(sum(len(t.encode()) for t in p) for p in parts) <= 130_000


def test_one_row_group_is_dealt_out(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": range(4000), "text": [f"{i} " * 200 for i in range(4000)]}), tmp_path / "documents.parquet", compression="none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # many partitions by size, all rows in one of them
    try:
        df = utterances.table(spark, str(tmp_path), "documents", "doc_id", "text")
        rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(rows) == 4000 and max(rows) <= 2000


def test_patterns_that_may_differ_from_the_jvm_are_left_to_it():
    assert batch_rules.translated("(?i)the|of") and batch_rules.translated(r"\p{L}+") and batch_rules.translated("(?!4000)4[0-9]{15}")
    assert not any(batch_rules.translated(x) for x in (r"\bthe", "[a&&b]", r"(?<=a)b", r"\x41", "(?i)\\p{Lu}", "a(?i)b"))


MEANT = [
    "John Smith lives in Paris. He likes it. Every dog saw no cat, but she did not see all of them.", "I never said my dog is great. It is not very good! This is terrible; the worst.",
    "Mary met John. She likes him, and their dog loves Acme Inc. It grows. Mary knows.", "No one without some few cats ran. Neither works.", "They saw it. He saw John and john.",
]


def recorded(df, together: bool, *left_out: str):
    from lexigrove.plans import registry
    from lexigrove.plans.records import to_record

    config = [x for x in registry.create_parse_config() if x.component not in left_out]
    if not together:
        config = [lambda x: x.withColumn("tokens", tokens.token_array(F.col("text"))), *config[1:]]
    out = registry.annotate(df, context=registry.create_context(config))
    assert bool(chains.steps(out)) == together
    return to_record(out, "doc_id")


@pytest.mark.parametrize("left_out", [(), ("parse-tree", "sentiment", "stopword", "coref"), ("dependency-parse-tree", "natlog", "ner", "coref", "srl")])
def test_records_of_chains_equal_those_of_expressions(spark, left_out):
    df = spark.createDataFrame(list(enumerate([*ODD, *MEANT, *MEANT])), "doc_id long, text string")
    a, b = recorded(df, True, *left_out), recorded(df, False, *left_out)
    assert a.schema["panon"].dataType.simpleString() == b.schema["panon"].dataType.simpleString()
    wanted = {r["doc_id"]: r.asDict(True) for r in b.collect()}
    assert {r["doc_id"]: r.asDict(True) for r in a.collect()} == wanted


def test_annotations_by_column_equal_those_of_expressions(spark):
    from lexigrove.plans import registry

    df = spark.createDataFrame(list(enumerate([*ODD, *MEANT])), "doc_id long, text string")
    config = registry.create_parse_config()
    begun = [lambda x: x.withColumn("tokens", tokens.token_array(F.col("text"))), *config[1:]]
    a, b = (registry.annotate(df, context=registry.create_context(c)) for c in (config, begun))
    assert {f.name: f.dataType.simpleString() for f in a.schema} == {f.name: f.dataType.simpleString() for f in b.schema}
    wanted = {r["doc_id"]: r.asDict(True) for r in b.collect()}
    assert {r["doc_id"]: r.asDict(True) for r in a.collect()} == wanted


def test_the_default_pipeline_is_one_pass_in_arrow(spark):
    plan = catalogue.QUERIES["default_pipeline"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "lambdafunction" not in plan


def test_the_root_is_looked_for_once(spark):
    text = access.root_dependency(F.col("tokens"), F.col("edges_of_row"))._jc.toString()
    assert text.count("edges_of_row") == 1  # not in the lambda over tokens, which would search all edges for each of them


@pytest.mark.parametrize("name", ["tokre_group", "pos_description", "range_overlap", "srl_propbank", "srl_propbank_sentence", "tokre_lemma", "tokre_case", "mention_features", "dep_parent_join", "srl_heads", "mention_overlap"])
def test_other_queries_annotate_once_and_in_arrow(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [run(text#") == 1 and "regexp_extract_all" not in plan


def test_overlaps_are_counted_in_the_same_pass(spark):
    plan = catalogue.QUERIES["mention_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1  # a second one would be a second worker for each task
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    found = []
    for together in (True, False):
        x = tokens.tokenize(df) if together else df.withColumn("tokens", tokens.token_array(F.col("text")))
        x = entities.recognize_entities(morphology.tag_parts_of_speech(tokens.split_sentences(x)))
        x, pairs = access.overlap_pairs_of(patterns.match_patterns(x, patterns.rules_of(catalogue.LITERAL_ITEMS)))
        assert bool(chains.steps(x)) == together
        found.append({r["doc_id"]: r["n"] for r in x.select("doc_id", pairs.alias("n")).collect()})
    assert found[0] == found[1] and len(found[0]) == len(ODD) and sum(found[0].values())


def test_rows_that_take_few_bytes_are_dealt_out_too(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": range(60_000), "text": ["He saw it. " * 40] * 60_000}), tmp_path / "documents.parquet", compression="zstd")
    df = utterances.table(spark, str(tmp_path), "documents", "doc_id", "text")
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 60_000 and max(rows) <= 6_000  # not a share for each core, however long the table is


@pytest.mark.parametrize(
    ("name", "wanted"),
    [
        ("tokre_group", ["tok", "sen", "blank", "tre"]),
        ("tokre_sequence", ["tok", "sen", "tag", "blank", "tre"]),
        ("tokre_literal", ["tok", "sen", "blank", "tre"]),
        ("tokre_case", ["tok", "sen", "blank", "tre"]),
        ("tokre_lemma", ["tok", "sen", "tag", "lemma", "blank", "tre"]),
        ("wordcount_quality", ["tok", "sen", "tag", "lemma", "stop"]),
        ("pos_tag", ["tok", "sen", "tag"]),
        ("mention_features", ["tok", "sen", "tag", "ner"]),
    ],
)
def test_steps_that_nothing_needs_are_left_out(spark, monkeypatch, name, wanted):
    run = []
    made = chains.annotator
    monkeypatch.setattr(chains, "annotator", lambda steps, *rest: (run.append([s[0] for s in steps]), made(steps, *rest))[1])
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert run[-1] == wanted


def test_steps_of_whole_tables_and_of_records_are_kept(spark):
    df = spark.createDataFrame([(1, "The cat's hat is old.")], "doc_id long, text string")
    chain = annotated(df, True).__dict__["lexigrove_chain"]
    assert chain.needed() == chain.steps


def test_classes_of_code_points():
    import numpy as np

    from lexigrove.operators import batches

    text = "\n".join(x or "" for x in ODD) + "\ud800 ǅ  \x00ÿĀ"
    cp = np.array([ord(c) for c in text], np.uint32)
    assert batches._classes_of(text, cp).tolist() == batches._classes()[cp].tolist()
    words = batches.Vocabulary()
    assert words.number(["b", "a", "b"]).tolist() == [0, 1, 0] and words.number(["c", "a"]).tolist() == [2, 1] and words.words == ["b", "a", "c"]
