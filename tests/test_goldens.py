"""Known results of small utterances, and laws that hold for any."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrove.functions import tags as tg
from lexigrove.functions.arrays import running_sum
from lexigrove.functions.ranges import in_range, overlaps
from lexigrove.functions.strings import java_hash
from lexigrove.operators import access, entities, features, morphology, patterns, roles, sentiment, syntax, tokens, wordcount
from lexigrove.plans import dsl, registry
from lexigrove.plans.records import to_record
from lexigrove.sources import rules
from lexigrove.sources.utterances import text_files, utterances

FOX = "The quick brown fox jumps over the lazy dog."
MOBY = """Call me Ishmael. Some years ago--never mind how long precisely--having
little or no money in my purse, and nothing particular to interest me on
shore, I thought I would sail about a little and see the watery part of
the world."""


def tagged(spark, *texts, steps=(tokens.split_sentences, morphology.tag_parts_of_speech, morphology.add_lemmas, morphology.flag_stop_words)):
    df = tokens.tokenize(utterances(spark, list(texts)))
    for step in steps:
        df = step(df)
    return df.orderBy("doc_id")


def words(df, field="text"):
    return [[t[field] for t in r["tokens"]] for r in df.collect()]


def test_tokens_and_tags(spark):
    df = tagged(spark, FOX, "I am Paul Landes.", "I like Teddy Grams on Tuesday")
    assert words(df)[0] == "The quick brown fox jumps over the lazy dog .".split()
    assert words(df, "pos_tag") == ["DT JJ JJ NN VBZ IN DT JJ NN .".split(), "PRP VBP NNP NNPS .".split(), "PRP VBP NNP NNPS IN NNP".split()]
    assert words(df, "lemma")[0] == "the quick brown fox jump over the lazy dog .".split()
    fox = df.collect()[0]["tokens"]
    assert [tuple(t["char_range"]) for t in fox][:3] == [(0, 3), (4, 9), (10, 15)] and tuple(fox[-1]["char_range"]) == (43, 44)
    assert [t["token_index"] for t in fox] == list(range(1, 11)) and tuple(fox[0]["token_range"]) == (0, 1)


def test_clitics_and_numbers(spark):
    df = tokens.tokenize(utterances(spark, ["I can't say it's $5.50 ago--never ... 667-16-9329", "", "a\tb\n c"]))
    got = words(df.orderBy("doc_id"))
    assert got[0] == ["I", "ca", "n't", "say", "it", "'s", "$", "5.50", "ago", "--", "never", "...", "667-16-9329"]
    assert got[1:] == [[], ["a", "b", "c"]]


def test_null_text_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "Hi there.", "y")], "doc_id long, text string, tokens string")
    out = registry.annotate(df, context=registry.create_context(only_tokenize=True)).orderBy("doc_id").collect()
    assert out[0]["tokens"] == [] and out[0]["sents"] == [] and len(out[1]["tokens"]) == 3


def test_go_words(spark):
    df = tagged(spark, "This is a test.  This will filter 5 semantically significant words.", "This is a test.  This cleans 5 semantically significant words.")
    got = df.select(access.go_word_forms(F.col("tokens")).alias("w"), access.go_word_forms(F.col("tokens"), access.lemma_form, tg.TAG_TYPES["noun"]).alias("n")).collect()
    assert got[0]["w"] == "test filter semantically significant words".split()
    assert got[1]["n"] == ["test", "word"]


def test_word_scores(spark):
    stats = spark.createDataFrame([("moby", "get", 3, 17, 3 / 17), ("moby", "i", 9, 17, 9 / 17), ("moby", "me", 5, 17, 5 / 17)], "label string, word string, num int, den int, ratio double")
    df = tokens.tokenize(utterances(spark, ["I account it high time to get to sea as soon as I can.", "nothing"]))
    scores = wordcount.label_scores(df, ["doc_id"], stats).orderBy("doc_id").collect()
    assert int(100 * scores[0]["score"]) == 123 and scores[1]["score"] == 0
    top = wordcount.top_labels(wordcount.label_scores(df, ["doc_id"], stats), ["doc_id"]).collect()
    assert [(r["doc_id"], r["rank"], r["label"]) for r in top] == [(1, 1, "moby")]


def test_distribution_sums_to_one_and_breaks_ties_by_word(spark):
    counts = spark.createDataFrame([("a", w, n) for w, n in (("x", 2), ("b", 1), ("c", 1), ("d", 1))] + [("e", "z", 4)], "label string, word string, n long")
    got = {(r["label"], r["word"]): r["ratio"] for r in wordcount.distribution(counts).collect()}
    assert got == {("a", "x"): 0.5, ("a", "b"): 0.25, ("a", "c"): 0.25, ("e", "z"): 1.0}


def test_rule_mentions(spark, tmp_path):
    lines = '{pattern:(/(?iu)monday|tuesday|wednesday/),action:(Annotate($0,zstrner,"DAY_OF_WEEK"))}\n{pattern:([{word:"Teddy"}] [{lemma:"Grams"}]),action:(Annotate($0,zstrner,"PRODUCT"),Annotate($0,zstriid,"123"),Annotate($0,zstrfeat,"food-type={snack}"))}\n'
    (tmp_path / "rules.txt").write_text("## comment\n" + lines)
    df = entities.recognize_entities(tagged(spark, "I like Teddy Grams on Tuesday"))
    row = patterns.match_patterns(df, rules.read_rules(spark, str(tmp_path / "rules.txt"))).collect()[0]
    got = [(m["text"], m["tok_re_ner_tag"], tuple(m["token_range"]), tuple(m["char_range"])) for m in row["tok_re_mentions"]]
    assert got == [("Teddy Grams", "PRODUCT", (2, 4), (7, 18)), ("Tuesday", "DAY_OF_WEEK", (5, 6), (22, 29))]
    first = row["tokens"][2]
    assert (first["tok_re_ner_item_id"], first["tok_re_ner_features"]) == (123, {"food-type": "snack"})


ITEMS = [
    patterns.Item("bad Words", "PROFANITY", id=0, lem_min_len=0),
    patterns.Item("/^(?!000|666)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$/", "PII", id=1, is_regexp=True, features={"pii-type": "ssn"}),
]


def test_rule_file_round_trip(spark, tmp_path):
    assert rules.write_rules(spark, ITEMS, str(tmp_path / "r.txt"), str(tmp_path / "f.txt")) == {"pii-type": ["ssn"]}
    assert rules.read_feature_values(spark, str(tmp_path / "f.txt")) == {"pii-type": ["ssn"]}
    read = rules.read_rules(spark, str(tmp_path / "r.txt"))
    assert read == patterns.rules_of(ITEMS)
    df = entities.recognize_entities(tagged(spark, "My social security number is 667-16-9329.  Say some bad words."))
    row = patterns.match_patterns(df, read).collect()[0]
    assert [m["tok_re_ner_tag"] for m in row["tok_re_mentions"]] == ["PII", "PROFANITY"]
    token = next(t for t in row["tokens"] if t["text"].startswith("667"))
    assert token["tok_re_ner_features"] == {"pii-type": "ssn"} and token["ner_tag"] == "NUMBER"


def test_item_compilation():
    show = lambda **o: patterns.format_rule(patterns.Item(**o))
    assert '[{word:/(?i)bad/}] [{lemma:/(?i)word/}]' in show(content="bad Words", label="L", lem_min_len=0)
    assert show(content="the", label="L") is None
    assert "(?i)end/}])" in show(content="the end", label="L") and "the" not in show(content="end the", label="L")[:40]
    assert "(?:&|and)" in show(content="salt and pepper", label="L")
    assert '[{word:"Acme"}]' in show(content="Acme", label="L", case_min_tok=0)
    assert r"a\.b" in show(content="a.b", label="L")
    assert patterns.plural_lemma("CITIES") == "CITY" and patterns.plural_lemma("Boxes") == "Box" and patterns.plural_lemma("bus") == "bus"


def test_chained_patterns_keep_earlier_labels(spark):
    df = tagged(spark, "red fish blue fish")
    df = df.withColumn("tokens", F.transform("tokens", lambda t: t.withField("ner_tag", F.lit("O")).withField("normalized_tag", F.lit(None).cast("string"))))
    df = patterns.match_patterns(df, patterns.rules_of([patterns.Item("red", "COLOUR")]))
    row = patterns.match_patterns(df, patterns.rules_of([patterns.Item("fish", "ANIMAL"), patterns.Item("blue fish", "BLUE")])).collect()[0]
    assert [t["tok_re_ner_tag"] for t in row["tokens"]] == ["COLOUR", "ANIMAL", "BLUE", "BLUE"]


def test_mentions_and_joins(spark):
    df = entities.recognize_entities(tagged(spark, "I am Paul Landes."))
    row = df.collect()[0]
    assert [(m["text"], m["entity_type"], tuple(m["token_range"]), tuple(m["char_range"])) for m in row["mentions"]] == [("Paul Landes", "PERSON", (2, 4), (5, 16))]
    both = df.select(access.token_mentions(F.col("tokens"), F.col("mentions")).alias("m"), F.size(access.mentions_for_token(F.col("mentions"), F.col("tokens")[2])).alias("n")).collect()[0]
    assert [t["text"] for t in both["m"][0]["tokens"]] == ["Paul", "Landes"] and both["n"] == 1
    made = df.select(*[c.alias(k) for k, c in features.token_features(F.col("text"), F.col("tokens"), F.col("sents"), F.col("mentions")).items()]).collect()[0]
    assert tuple(made) == (17, 1, 1, 5, 14 / 5, False)


def test_dependencies(spark):
    df = syntax.add_dependencies(tagged(spark, FOX, "I am Paul Landes."))
    got = [[(e["token_index"], e["parent_token_index"], e["dep"]) for e in r["dependency_edges"]] for r in df.collect()]
    assert got[0] == [(1, 4, "det"), (2, 4, "amod"), (3, 4, "amod"), (4, 5, "nsubj"), (5, 0, "root"), (6, 9, "case"), (7, 9, "det"), (8, 9, "amod"), (9, 5, "nmod"), (10, 5, "punct")]
    assert [x[1:] for x in got[1]] == [(4, "nsubj"), (4, "cop"), (4, "nn"), (0, "root"), (4, "punct")]
    root = df.select(access.root_dependency(F.col("tokens"), F.col("dependency_edges"))["text"].alias("r")).collect()
    assert [r["r"] for r in root] == ["jumps", "Landes"]


def test_parse_tree(spark):
    df = syntax.add_parse_trees(tagged(spark, "I am Paul"))
    assert df.select(syntax.bracketed(F.col("parse_nodes")).alias("t")).collect()[0]["t"] == "(ROOT (S (NP (PRP 1)) (VP (VBP 2) (NP (NNP 3)))))"
    binary = syntax.binarised([(0, -1, 0, "S", 0), (1, 0, 0, "A", 1), (2, 0, 1, "B", 2), (3, 0, 2, "C", 3)])
    assert [(x[1], x[3]) for x in binary] == [(-1, "S"), (0, "A"), (0, "@S"), (2, "B"), (2, "C")]


def test_roles(spark):
    df = roles.label_roles(syntax.add_dependencies(tagged(spark, FOX, "I am Paul Landes.")))
    got = df.select(access.first_propbank_label(F.col("tokens")).alias("p")).collect()
    assert [r["p"] for r in got] == ["jump.03", "be.01"]
    made = df.select(*[c.alias(k) for k, c in features.srl_features(F.col("tokens")).items()]).collect()[0]
    assert made["srl_argument_counts"] == 2 and made["srl_propbank_id"] == java("jump.03")


def test_best_tree(spark):
    rows = [(0, 3, [(0.9, False), (0.5, True)]), (1, 4, [(0.9, False), (0.5, True)]), (2, 3, [(0.2, False), (0.9, False)])]
    df = spark.createDataFrame(rows, "s int, n int, trees array<struct<score:double,has_propbank:boolean>>")
    assert [r[0] for r in df.orderBy("s").select(roles.best_tree(F.col("trees"), F.col("n"))["score"]).collect()] == [0.5, 0.9, 0.9]


def test_coreference(spark):
    df = entities.recognize_entities(tagged(spark, "Paul saw Paris.  He loved it.  I did not.", "No names.", ""))
    got = roles.resolve_coreference(df).select("coref").collect()
    found = [[(m["token_range"]["begin"], m["type"], m["gender"]) for m in c["mention"]] for c in got[0]["coref"]]
    assert found == [[(0, "PROPER", "MALE"), (4, "PRONOMINAL", "MALE")], [(2, "PROPER", "NEUTRAL"), (6, "PRONOMINAL", "NEUTRAL")]]
    assert [c["id"] for c in got[0]["coref"]] == [1, 2] and got[1]["coref"] == got[2]["coref"] == []


def test_sentiment(spark):
    df = sentiment.score_sentiment(tagged(spark, "I love it.  I hate this bad day.", "not good", ""))
    got = df.select("sentiment", F.transform("sents", lambda s: s["sentiment"]).alias("s")).collect()
    assert [(r["sentiment"], r["s"]) for r in got] == [(-1, [1, -2]), (-1, [-1]), (0, [])]
    made = df.select(*[c.alias(k) for k, c in features.sentiment_features(F.col("sents"), F.col("sentiment")).items()]).collect()
    assert tuple(made[0]) == (-1, -2, 1, -1, -0.5, 4.5) and tuple(made[2]) == (0, None, None, 0, 0.0, 0.0)


def test_natural_logic(spark):
    df = syntax.add_natural_logic(tagged(spark, FOX, "No dog jumps."))
    fox, dog = (r["tokens"] for r in df.collect())
    operator = fox[0]["natlog"]["operator"]
    assert [tuple(operator[k]) for k in ("quantifier_token_range", "subject_token_range", "object_token_range")] == [(0, 1), (1, 4), (4, 10)]
    assert [t["natlog"]["polarity"] for t in dog] == ["up", "down", "down", "down"]


RANGE_IN = [((1, 5), (2, 3), True), ((1, 5), (1, 5), True), ((1, 5), (1, 3), True), ((1, 5), (2, 5), True), ((1, 5), (0, 3), False), ((1, 5), (2, 6), False)]
RANGE_OVER = [((0, 5), (3, 9), True), ((0, 5), (5, 9), True), ((1, 5), (1, 5), True), ((0, 5), (6, 9), False)]


def test_ranges(spark):
    schema = "a struct<begin:int,end:int>, b struct<begin:int,end:int>, want boolean"
    df = spark.createDataFrame(RANGE_IN, schema)
    assert all(r[0] == r[1] for r in df.select(in_range(F.col("a"), F.col("b")), "want").collect())
    df = spark.createDataFrame(RANGE_OVER, schema)
    assert all(r[0] == r[1] == r[2] for r in df.select(overlaps(F.col("a"), F.col("b")), overlaps(F.col("b"), F.col("a")), "want").collect())


def java(text: str) -> int:
    h = 0
    for c in text:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_tag_functions(spark):
    assert len(tg.pos_tags()) == 44 and tg.pos_tag_types() == ["noun", "verb", "adjective", "adverb", "wh"]
    with pytest.raises(ValueError):
        tg.pos_tags("particle")
    df = spark.createDataFrame([("WRB",), ("NN",), ("XX",), (None,)], "t string")
    got = df.select(tg.pos_tag_type(F.col("t")), tg.pos_tag_or_none(F.col("t")), tg.pos_description(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("adverb", "WRB", "Wh-adverb"), ("noun", "NN", "Noun, singular or mass"), (None, "<none>", None), (None, "<none>", None)]


def test_hash_and_sums(spark):
    df = spark.createDataFrame([("",), ("a",), ("<none>",), ("polygenelubricants",), (None,)], "s string")
    assert [r[0] for r in df.select(java_hash(F.col("s"))).collect()] == [java(""), java("a"), java("<none>"), java("polygenelubricants"), None]
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 300)], "v array<int>")
    assert [r[0] for r in df.select(running_sum(F.col("v"))).collect()] == [[i * (i + 1) // 2 for i in range(n)] for n in (0, 1, 63, 64, 65, 300)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from(list("ab Z9.,!?'’\"()-\n\té☃😀")), max_size=60), min_size=1, max_size=8))
def test_offsets_cut_the_tokens(spark, texts):
    for row in tokens.split_sentences(tokens.tokenize(utterances(spark, texts))).collect():
        cut = [row["text"][t["char_range"]["begin"] : t["char_range"]["end"]] for t in row["tokens"]]
        assert cut == [t["text"] for t in row["tokens"]]
        spans = [tuple(s["token_range"]) for s in row["sents"]]
        assert [x for b, e in spans for x in range(b, e)] == list(range(len(cut)))


def test_partitions_do_not_matter(spark):
    texts = ["My name is Paul Landes", FOX, "I love it!"] * 5
    df = utterances(spark, texts)
    context = registry.create_context(pipeline=dsl.parse("tokenize,sentence,part-of-speech,morphology,stopword,named-entity-recognizer"))
    made = [sorted(map(repr, registry.annotate(df.repartition(n), context=context).collect())) for n in (1, 7)]
    assert made[0] == made[1]


def test_records(spark):
    out = to_record(registry.annotate(utterances(spark, ["I love Clojure.  I enjoy it.", ""])), "doc_id").orderBy("doc_id").collect()
    panon = out[0]["panon"]
    assert [s["text"] for s in panon["sents"]] == ["I love Clojure.", "I enjoy it."] and panon["sentiment"] == 2
    assert panon["sents"][0]["tokens"][0]["text"] == "I" and panon["sents"][1]["parse_tree"] and panon["sents"][1]["dependency_parse_tree"]
    assert out[1]["panon"]["sents"] is None


# Configuration.


def test_dsl_forms():
    assert dsl.to_metadata("tokenize") == [{"func": "tokenize", "params": None}]
    assert dsl.to_metadata("a.b/tokenize(arg1,arg2),sentence")[0] == {"namespace": "a.b", "func": "tokenize", "params": ("arg1", "arg2")}
    for text, column in (("a(,a)", 3), ("a(a,)", 5)):
        with pytest.raises(dsl.ConfigurationError) as e:
            dsl.to_forms(text)
        assert e.value.column == column


def test_dsl_components():
    one = lambda text: dsl.parse(text)[0].as_dict()
    assert one("tokenize") == {"component": "tokenize", "parser": "rules", "lang": "en", "only_whitespace": False}
    assert one('tokenize("arg1")')["lang"] == "arg1" and isinstance(one("tokenize(arg1)")["lang"], dsl.Symbol)
    assert [one(f"sentiment{x}")["aggregate"] for x in ("", "(true)", "(false)")] == [True, True, False]
    assert [x.component for x in dsl.parse("sentence,rules/tokenize(en)")] == ["sents", "tokenize"]
    with pytest.raises(dsl.ConfigurationError):
        dsl.parse("nothing-like-this")


def test_dsl_maps_and_own_libraries():
    from lexigrove.plans.components import Component

    def make(param2=None, lang_code=None, param1=None):
        return Component("tokenize", "own", {"lang": lang_code, "param1": param1, "param2": param2})

    registry.register_library(registry.Library("own", {"config-func": make}, lambda df, c, text: df))
    try:
        got = dsl.parse('own/config-func({:lang-code "es" :param1 123}, "p2")')[0]
        assert got.options == {"lang": "es", "param1": 123, "param2": "p2"}
        assert "config-func" in registry.components_as_string() and registry.distinct_parsers([got]) == ["own"]
    finally:
        registry.unregister_library("own")


def test_contexts(spark):
    default = registry.current_context()
    assert registry.current_context() is default
    own = registry.create_context("tokenize,sentence", timeout_millis=5000)
    assert own.timeout_millis == 5000 and registry.component_from_context(own, "sents")
    with registry.with_context(own):
        assert registry.current_context() is own
        assert registry.parse(spark, "I am.")["sents"][0]["tokens"][0]["pos_tag"] is None
    assert registry.current_context() is default
    registry.reset()
    assert registry.current_context() is not default
    order = [x.component for x in registry.create_parse_config()]
    assert order.index("pos") < order.index("srl") and "tok-re" not in order
    assert [x.component for x in registry.create_parse_config(only_tokenize=True)] == ["tokenize", "sents"]


def test_function_in_pipeline(spark):
    context = registry.create_context(pipeline=[*registry.create_parse_config(only_tokenize=True), lambda df: df.withColumn("n", F.size("tokens"))])
    assert registry.annotate(utterances(spark, ["a b c"]), context=context).collect()[0]["n"] == 3


def test_timeout(spark):
    with pytest.raises(registry.ParseTimeoutError):
        registry.parse(spark, "This is a test", registry.create_context(timeout_millis=1))


def test_text_files(spark, tmp_path):
    (tmp_path / "moby.txt").write_text(MOBY)
    df = text_files(spark, str(tmp_path / "moby.txt"))
    assert df.collect()[0]["text"] == MOBY.replace("\n", " ")


def test_stream_counts_like_a_table(spark, tmp_path):
    from lexigrove.streaming.annotate import counted_to_end, go_words

    rows = spark.createDataFrame([("a", "Dogs jump high."), ("b", "I see dogs."), (None, "none")], "label string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in counted_to_end(spark, str(tmp_path / "in"), "label").collect()}
    assert got == {tuple(r) for r in wordcount.words_by_label(go_words(rows), F.col("label")).collect()} and ("a", "dogs", 1) in got


# Token expressions, action groups, rule files and lexicons by path


def spans(spark, text, *contents, group="$0"):
    df = registry.annotate(spark.createDataFrame([(text,)], "text string"), context=registry.create_context("tokenize,sentence,part-of-speech,morphology,named-entity-recognizer"))
    rules = patterns.rules_of([patterns.Item(c, f"R{i}", is_regexp=True, features={"n": str(i)}, feature_group=group) for i, c in enumerate(contents)])
    return [(r["begin"], r["end"], r["from"], r["to"]) for r in df.select(patterns.matches(F.col("tokens"), rules).alias("m")).first()["m"]]


def test_token_expressions(spark):
    text = "a b b c. b c a b d e"
    assert [x[:2] for x in spans(spark, text, "/a/ /b/+")] == [(0, 3), (7, 9)]
    assert [x[:2] for x in spans(spark, text, "/a/ /b/{2} /c/?")] == [(0, 4)]
    assert [x[:2] for x in spans(spark, text, "/c/ []* /b/")] == [(6, 9)]  # no match crosses a sentence
    assert [x[:2] for x in spans(spark, text, '/c/ [!{word:"b"}]')] == [(3, 5), (6, 8)]
    assert [x[:2] for x in spans(spark, text, '(/d/ | /b/ /c/) /e/?')] == [(2, 4), (5, 7), (9, 11)]
    assert [x[:2] for x in spans(spark, text, '[{word:"d"} | {word:"e"}]')] == [(9, 10), (10, 11)]
    assert [x[:2] for x in spans(spark, text, '[{word:/[a-c]/} & !{word:"b"}] [{word:/.*/;word:"b"}]*')] == [(0, 3), (3, 4), (6, 7), (7, 9)]
    assert spans(spark, text, "/a/ (/b/+) /c/?", group="$1") == [(0, 4, 1, 3), (7, 9, 8, 9)]
    assert spans(spark, text, "/a/ (?$x /b/+?) ", group="$x") == [(0, 2, 1, 2), (7, 9, 8, 9)]
    assert spans(spark, text, "/a/?") == [(0, 1, 0, 1), (7, 8, 7, 8)] and spans(spark, "", "/a/+") == []
    for bad in ("/a/ (", "[{word:/a/]", "/a/ )", "", "|", "[{word}]", "/a/ | "):
        with pytest.raises(ValueError):
            patterns.rule_of(bad, "X", None, {})
    with pytest.raises(ValueError):
        patterns.rule_of("((/a/) /b/)+", "X", None, {}, "$2")


def test_rule_files_and_lexicons_by_path(spark, tmp_path):
    item = patterns.Item('([{word:"x"}]) ([{word:/y+/}])+', "XY", id=4, features={"k": "v"}, is_regexp=True, feature_group="$1")
    assert patterns.parse_rule(patterns.format_rule(item)).group == "$1"
    rules.write_rules(spark, [item], f"{tmp_path}/a.rules", f"{tmp_path}/a.features")
    (tmp_path / "tags.tsv").write_text("# own tags\nzorp\tFW\n")
    (tmp_path / "names.tsv").write_text("zorp\tGADGET\n")
    spark.conf.set("spark.lexigrove.resources", str(tmp_path))
    try:
        config = f'tokenize,sentence,part-of-speech("tags.tsv"),morphology,named-entity-recognizer(["names.tsv"]),token-regex(["{tmp_path}/a.rules"])'
        row = registry.annotate(spark.createDataFrame([("x y yy zorp",)], "text string"), context=registry.create_context(config)).first()
    finally:
        spark.conf.unset("spark.lexigrove.resources")
    assert [t["tok_re_ner_tag"] for t in row["tokens"]] == ["XY", "XY", "XY", None]
    assert [t["tok_re_ner_features"] for t in row["tokens"]] == [{"k": "v"}, None, None, None]
    assert row["tok_re_mentions"][0]["tok_re_ner_features"] == {"k": "v"} and row["tok_re_mentions"][0]["text"] == "x y yy"
    assert (row["tokens"][3]["pos_tag"], row["tokens"][3]["ner_tag"]) == ("FW", "GADGET")
