"""All queries of the annotation engine, by name, with their DuckDB oracles.

Every query reads its whole table and whole texts. Annotations are expressions inside a row, so a query shuffles only where
it groups or joins over rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions import tags as tg
from lexigrove.functions.arrays import at, count_if, cut_of, let, settled, stretches
from lexigrove.functions.ranges import in_range, overlaps, range_of
from lexigrove.operators import access, chains, entities, features, morphology, patterns, roles, sentiment, syntax, tokens, wordcount
from lexigrove.plans import oracles as o
from lexigrove.plans.oracles import chain
from lexigrove.sources.utterances import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

STEPS = {
    "sen": tokens.split_sentences,
    "tag": morphology.tag_parts_of_speech,
    "lemma": morphology.add_lemmas,
    "stop": morphology.flag_stop_words,
    "ner": entities.recognize_entities,
    "mood": sentiment.score_sentiment,
    "dep": syntax.add_dependencies,
    "tree": syntax.add_parse_trees,
    "natlog": syntax.add_natural_logic,
    "srl": roles.label_roles,
    "coref": roles.resolve_coreference,
}
KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"], "pages": ["page_id"], "benchmark": ["item_id"]}


def annotated(spark: SparkSession, sf_dir: str, name: str, *steps: str, more: tuple[str, ...] = ()) -> DataFrame:
    """A table's keys, text and annotations up to the given steps."""
    df = tokens.tokenize(table(spark, sf_dir, name, *KEYS[name], "text", *more))
    for step in steps:
        df = STEPS[step](df)
    return df


def nonempty(df: DataFrame) -> DataFrame:
    """Rows with tokens."""
    return df.withColumn("n_tokens_", settled(F.size("tokens"))).where("n_tokens_ > 0").drop("n_tokens_")


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def digest(values: Column) -> Column:
    return F.md5(F.array_join(values, " ").cast("binary"))


def field(name: str) -> Column:
    return F.transform("tokens", lambda t: t[name])


def long_(c: Column) -> Column:
    return c.cast("long")


# Tokens and sentences.

_COUNTS = """
SELECT src.doc_id, count(tok.i)::BIGINT AS n_tokens, md5(coalesce(string_agg(tok.text, ' ' ORDER BY i), '')) AS digest
FROM src LEFT JOIN tok USING (doc_id) GROUP BY src.doc_id"""


@query("tokenize_counts", chain("documents", "tok") + _COUNTS)
def tokenize_counts(spark, sf_dir):
    return annotated(spark, sf_dir, "documents").select("doc_id", long_(F.size("tokens")).alias("n_tokens"), digest(field("text")).alias("digest"))


@query("tokenize_whitespace", chain("documents", "tok", only_whitespace=True) + _COUNTS)
def tokenize_whitespace(spark, sf_dir):
    df = tokens.tokenize(table(spark, sf_dir, "documents", "doc_id", "text"), only_whitespace=True)
    return df.select("doc_id", long_(F.size("tokens")).alias("n_tokens"), digest(field("text")).alias("digest"))


@query(
    "token_offsets",
    chain("documents", "tok")
    + """ SELECT doc_id, sum(b)::BIGINT AS sum_begin, sum(e)::BIGINT AS sum_end, max(e)::BIGINT AS last_end,
      count_if(substr(src.text, b + 1, e - b) <> tok.text)::BIGINT AS n_bad FROM tok JOIN src USING (doc_id) GROUP BY doc_id""",
)
def token_offsets(spark, sf_dir):
    df = annotated(spark, sf_dir, "documents").select("doc_id", "text", settled(F.col("tokens")).alias("tokens")).where(F.size("tokens") > 0)
    ends = lambda k: F.transform("tokens", lambda t: t["char_range"][k])
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    cut = lambda ts: let(
        stretches(F.col("text")), lambda s: F.filter(ts, lambda t: cut_of(s, F.col("text"), t["char_range"]["begin"], t["char_range"]["end"]) != t["text"])
    )
    bad = long_(F.size(cut(F.col("tokens"))))
    return df.select("doc_id", total(ends("begin")).alias("sum_begin"), total(ends("end")).alias("sum_end"), long_(F.array_max(ends("end"))).alias("last_end"), bad.alias("n_bad"))


@query(
    "sentence_split",
    chain("conversations", "sen")
    + """ SELECT conv_id, turn, s AS sent_index, min(i)::INT AS tok_begin, (max(i) + 1)::INT AS tok_end,
      substr(any_value(src.text), min(b) + 1, max(e) - min(b)) AS text FROM sen JOIN src USING (doc_id) GROUP BY conv_id, turn, s""",
)
def sentence_split(spark, sf_dir):
    df = tokens.elements(annotated(spark, sf_dir, "conversations", "sen"), "sents", "conv_id", "turn", "text").withColumnRenamed("x", "s")
    cut = F.substring("text", F.col("s.char_range.begin") + 1, F.col("s.char_range.end") - F.col("s.char_range.begin"))
    return df.select("conv_id", "turn", "s.sent_index", F.col("s.token_range.begin").alias("tok_begin"), F.col("s.token_range.end").alias("tok_end"), cut.alias("text"))


@query(
    "sentence_lengths",
    chain("documents", "sen")
    + """, sizes AS (SELECT doc_id, s, count(*) AS n FROM sen GROUP BY doc_id, s)
    SELECT doc_id, count(*)::BIGINT AS n_sents, min(n)::BIGINT AS shortest, max(n)::BIGINT AS longest FROM sizes GROUP BY doc_id""",
)
def sentence_lengths(spark, sf_dir):
    df = chains.only(annotated(spark, sf_dir, "documents", "sen"), "sents")
    sizes = F.transform("sents", lambda s: long_(s["token_range"]["end"] - s["token_range"]["begin"]))
    out = df.select("doc_id", settled(sizes).alias("sizes")).where(F.size("sizes") > 0)
    return out.select("doc_id", long_(F.size("sizes")).alias("n_sents"), F.array_min("sizes").alias("shortest"), F.array_max("sizes").alias("longest"))


@query(
    "token_nth",
    chain("documents", "tok")
    + """ SELECT src.doc_id, max(CASE WHEN i = 0 THEN tok.text END) AS first_token, max(CASE WHEN i = 2 THEN tok.text END) AS third_token
    FROM src LEFT JOIN tok USING (doc_id) GROUP BY src.doc_id""",
)
def token_nth(spark, sf_dir):
    df = annotated(spark, sf_dir, "documents")
    nth = lambda i: access.token(F.col("tokens"), i)["text"]
    return df.select("doc_id", nth(0).alias("first_token"), nth(2).alias("third_token"))


@query(
    "sent_nth",
    chain("documents", "sen")
    + " SELECT doc_id, min(i)::INT AS tok_begin, (max(i) + 1)::INT AS tok_end FROM sen WHERE s = 1 GROUP BY doc_id",
)
def sent_nth(spark, sf_dir):
    second = access.sent(F.col("sents"), 1)["token_range"]
    out = annotated(spark, sf_dir, "documents", "sen").select("doc_id", settled(second).alias("r")).where("r IS NOT NULL")
    return out.select("doc_id", F.col("r.begin").alias("tok_begin"), F.col("r.end").alias("tok_end"))


@query(
    "tokens_by_sentence",
    chain("documents", "sen")
    + " SELECT doc_id, string_agg(text, ' ' ORDER BY i) AS words FROM sen WHERE s = 1 AND k BETWEEN 2 AND 4 GROUP BY doc_id",
)
def tokens_by_sentence(spark, sf_dir):
    part = access.tokens_by_sentence(F.col("tokens"), F.col("sents"), 1, F.lit(1), F.lit(4))
    out = annotated(spark, sf_dir, "documents", "sen").select("doc_id", settled(F.transform(part, lambda t: t["text"])).alias("w"))
    return out.where(F.size("w") > 0).select("doc_id", F.array_join("w", " ").alias("words"))


@query("page_text_tokens", chain("pages", "tok") + _COUNTS.replace("src.doc_id, count", "src.doc_id AS page_id, count"))
def page_text_tokens(spark, sf_dir):
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^<>]*>", " ")
    pages = table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.trim(F.regexp_replace(bare, r"[ \t\n\r]+", " ")).alias("text"))
    return tokens.tokenize(pages).select("page_id", long_(F.size("tokens")).alias("n_tokens"), digest(field("text")).alias("digest"))


# Tags, lemmas, stop words.


@query(
    "pos_tag",
    chain("documents", "tagged") + " SELECT doc_id, count(*)::BIGINT AS n_tokens, md5(string_agg(tag, ' ' ORDER BY i)) AS digest FROM tagged GROUP BY doc_id",
)
def pos_tag(spark, sf_dir):
    df = nonempty(chains.only(annotated(spark, sf_dir, "documents", "sen", "tag"), "tokens", fields=("pos_tag",)))
    return df.select("doc_id", long_(F.size("tokens")).alias("n_tokens"), digest(field("pos_tag")).alias("digest"))


@query("pos_description", chain("documents", "tagged") + f" SELECT tag, {o.tag_description('tag')} AS description, count(*)::BIGINT AS n FROM tagged GROUP BY tag")
def pos_description(spark, sf_dir):
    df = tokens.exploded(chains.only(annotated(spark, sf_dir, "documents", "sen", "tag"), "tokens", fields=("pos_tag",)))
    return df.groupBy(F.col("pos_tag").alias("tag")).agg(F.count("*").alias("n")).withColumn("description", tg.pos_description(F.col("tag")))


@query("pos_tag_type", chain("documents", "tagged") + f" SELECT {o.tag_type('tag')} AS kind, count(*)::BIGINT AS n FROM tagged GROUP BY 1")
def pos_tag_type(spark, sf_dir):
    df = tokens.exploded(chains.only(annotated(spark, sf_dir, "documents", "sen", "tag"), "tokens", fields=("pos_tag",)))
    return df.groupBy(tg.pos_tag_type(F.col("pos_tag")).alias("kind")).agg(F.count("*").alias("n"))


def _pos_sql(table_name: str) -> str:
    cells = []
    for kind in tg.TAG_TYPES:
        count = f"count(*) FILTER ({o.tag_type('tag')} = '{kind}')"
        cells.append(f"{count}::BIGINT AS pos_tag_count_{kind}")
        cells.append(f"coalesce({count}::DOUBLE / nullif(count(i), 0), 0.0::DOUBLE) AS pos_tag_ratio_{kind}")
    return (
        chain(table_name, "tagged")
        + f" SELECT src.doc_id, {', '.join(cells)}, coalesce(arg_min(tag, i), '<none>') AS pos_first_tag, coalesce(arg_max(tag, i), '<none>') AS pos_last_tag"
        + " FROM src LEFT JOIN tagged USING (doc_id) GROUP BY src.doc_id"
    )


@query("pos_features", _pos_sql("documents").replace("'<none>') AS pos_first_tag", "'<none>') AS pos_first_tag"))
def pos_features(spark, sf_dir):
    df, made = features.pos_features_of(annotated(spark, sf_dir, "documents", "sen", "tag"))
    return features.select_features(df, ["doc_id"], made, features.pos_feature_metas())


@query("lemma", chain("documents", "ann") + " SELECT doc_id, count(*)::BIGINT AS n_tokens, md5(string_agg(lemma, ' ' ORDER BY i)) AS digest FROM ann GROUP BY doc_id")
def lemma(spark, sf_dir):
    df = nonempty(chains.only(annotated(spark, sf_dir, "documents", "sen", "tag", "lemma"), "tokens", fields=("lemma",)))
    return df.select("doc_id", long_(F.size("tokens")).alias("n_tokens"), digest(field("lemma")).alias("digest"))


@query(
    "stopword_flags",
    chain("conversations", "ann")
    + " SELECT conv_id, turn, i AS tok_begin, ann.text, tag, lemma, stopword, stoplemma FROM ann JOIN src USING (doc_id)",
)
def stopword_flags(spark, sf_dir):
    df = tokens.exploded(annotated(spark, sf_dir, "conversations", "sen", "tag", "lemma", "stop"), "conv_id", "turn")
    return df.select("conv_id", "turn", F.col("token_range.begin").alias("tok_begin"), "text", F.col("pos_tag").alias("tag"), "lemma", "stopword", "stoplemma")


@query("go_words", chain("conversations", "ann") + " SELECT conv_id, turn, i AS tok_begin, ann.text FROM ann JOIN src USING (doc_id) WHERE go")
def go_words(spark, sf_dir):
    df = annotated(spark, sf_dir, "conversations", "sen", "tag", "lemma", "stop")
    kept = df.withColumn("tokens", F.filter("tokens", lambda t: access.is_go_word(t)))
    return tokens.exploded(kept, "conv_id", "turn").select("conv_id", "turn", F.col("token_range.begin").alias("tok_begin"), "text")


@query(
    "go_word_forms",
    chain("conversations", "ann")
    + """ SELECT conv_id, turn, coalesce(string_agg(l, ' ' ORDER BY i) FILTER (WHERE go), '') AS forms,
      coalesce(string_agg(lower(lemma), ' ' ORDER BY i) FILTER (WHERE go AND tag IN ('NN', 'NNS', 'NNP', 'NNPS')), '') AS noun_lemmas
    FROM src LEFT JOIN ann USING (doc_id) GROUP BY conv_id, turn""",
)
def go_word_forms(spark, sf_dir):
    df = annotated(spark, sf_dir, "conversations", "sen", "tag", "lemma", "stop")
    forms, nouns = access.go_word_forms(F.col("tokens")), access.go_word_forms(F.col("tokens"), access.lemma_form, tg.TAG_TYPES["noun"])
    return df.select("conv_id", "turn", F.array_join(forms, " ").alias("forms"), F.array_join(nouns, " ").alias("noun_lemmas"))


def _stop_words(spark) -> DataFrame:
    from lexigrove.defaults import STOP_WORDS

    return spark.createDataFrame([(w,) for w in STOP_WORDS["en"]], "word string")


def _stop_sql(how: str) -> str:
    from lexigrove.defaults import STOP_WORDS

    values = ", ".join(f"('{w}')" for w in STOP_WORDS["en"])
    return (
        chain("conversations", "tok")
        + f", stop AS (SELECT * FROM (VALUES {values}) v(word)) SELECT lower(t.text) AS word, count(*)::BIGINT AS n FROM tok t {how} JOIN stop ON lower(t.text) = stop.word GROUP BY 1"
    )


@query("stopword_semi", _stop_sql("SEMI"))
def stopword_semi(spark, sf_dir):
    rows = tokens.exploded(annotated(spark, sf_dir, "conversations"), "conv_id", "turn")
    return access.with_words(rows, _stop_words(spark)).groupBy(F.lower("text").alias("word")).agg(F.count("*").alias("n"))


@query("stopword_anti", _stop_sql("ANTI"))
def stopword_anti(spark, sf_dir):
    rows = tokens.exploded(annotated(spark, sf_dir, "conversations"), "conv_id", "turn")
    return access.with_words(rows, _stop_words(spark), how="left_anti").groupBy(F.lower("text").alias("word")).agg(F.count("*").alias("n"))


@query(
    "first_last_pos",
    chain("conversations", "tagged")
    + """ SELECT conv_id, turn, coalesce(arg_min(tag, i), '<none>') AS first_tag, coalesce(arg_max(tag, i), '<none>') AS last_tag
    FROM src LEFT JOIN tagged USING (doc_id) GROUP BY conv_id, turn""",
)
def first_last_pos(spark, sf_dir):
    made = features.pos_features(F.col("tokens"))
    return annotated(spark, sf_dir, "conversations", "sen", "tag").select("conv_id", "turn", made["pos_first_tag"].alias("first_tag"), made["pos_last_tag"].alias("last_tag"))


@query(
    "verb_features",
    chain("conversations", "tagged")
    + f""", verbs AS (SELECT conv_id, turn, coalesce(max(CASE WHEN i = 0 AND tag = 'VB' THEN l END), '<none>') AS elected_verb
      FROM src LEFT JOIN tagged USING (doc_id) GROUP BY conv_id, turn)
    SELECT conv_id, turn, elected_verb, ({o.java_hash("elected_verb")})::BIGINT AS elected_verb_id FROM verbs""",
)
def verb_features(spark, sf_dir):
    df = annotated(spark, sf_dir, "conversations", "sen", "tag")
    return features.select_features(df, ["conv_id", "turn"], features.verb_features(F.col("tokens")), features.verb_feature_metas())


@query(
    "verb_features_root",
    chain("conversations", "edges")
    + f""", verbs AS (SELECT conv_id, turn, coalesce(max(CASE WHEN i = 0 AND tag = 'VB' THEN lower(edges.text) END),
        max(CASE WHEN s = 0 AND head = 0 AND tag = 'VB' THEN lower(edges.text) END), '<none>') AS elected_verb
      FROM src LEFT JOIN edges USING (doc_id) GROUP BY conv_id, turn)
    SELECT conv_id, turn, elected_verb, ({o.java_hash("elected_verb")})::BIGINT AS elected_verb_id FROM verbs""",
)
def verb_features_root(spark, sf_dir):
    df = chains.only(annotated(spark, sf_dir, "conversations", "sen", "tag", "dep"), "tokens", "dependency_edges", fields=("text", "sent_index", "token_index", "pos_tag"))
    root = access.root_dependency(F.col("tokens"), F.col("dependency_edges"))
    return features.select_features(df, ["conv_id", "turn"], features.verb_features(F.col("tokens"), root), features.verb_feature_metas())


# Word counts.

_DIST = """, counts AS (SELECT label, word, count(*) AS n FROM words_of GROUP BY label, word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS r FROM counts),
dist AS (SELECT label, word, n::BIGINT AS num, sum(n) OVER (PARTITION BY label)::BIGINT AS den,
  n::DOUBLE / sum(n) OVER (PARTITION BY label)::DOUBLE AS ratio FROM ranked WHERE r <= 3)"""


def _words_sql(name: str, label: str, join: str = "") -> str:
    where = f" JOIN src USING (doc_id) {join} WHERE go AND {label} IS NOT NULL"
    return chain(name, "ann") + f", words_of AS (SELECT {label}::VARCHAR AS label, l AS word FROM ann{where})"


def _go(spark, sf_dir, name, *more, labels: tuple[str, ...] = ()):
    """What word counts need. Labels of another table (its name, key and columns) meet the texts, not the annotations."""
    df = table(spark, sf_dir, name, *KEYS[name], "text", *more)
    if labels:
        df = df.join(table(spark, sf_dir, *labels), labels[1])
    df = tokens.tokenize(df)
    for step in ("sen", "tag", "lemma", "stop"):
        df = STEPS[step](df)
    return chains.only(df, "tokens", fields=("text", "pos_tag", "stopword"))


@query("wordcount_by_label", _words_sql("conversations", "role") + " SELECT label, word, count(*)::BIGINT AS n FROM words_of GROUP BY label, word")
def wordcount_by_label(spark, sf_dir):
    return wordcount.words_by_label(_go(spark, sf_dir, "conversations", "role"), F.col("role"))


@query("wordcount_distribution", _words_sql("conversations", "role") + _DIST + " SELECT * FROM dist")
def wordcount_distribution(spark, sf_dir):
    return wordcount.feature_stats(_go(spark, sf_dir, "conversations", "role"), F.col("role"))[1]


@query("wordcount_lang", _words_sql("documents", "lang") + _DIST + " SELECT * FROM dist")
def wordcount_lang(spark, sf_dir):
    return wordcount.feature_stats(_go(spark, sf_dir, "documents", "lang"), F.col("lang"))[1]


@query("wordcount_quality", _words_sql("documents", "quality", "JOIN labels USING (doc_id)") + _DIST + " SELECT * FROM dist")
def wordcount_quality(spark, sf_dir):
    labelled = _go(spark, sf_dir, "documents", labels=("labels", "doc_id", "quality"))
    return wordcount.feature_stats(labelled, F.col("quality"))[1]


_SCORES = (
    _words_sql("conversations", "role")
    + _DIST
    + """, scores AS (SELECT conv_id, turn, lab.label, sum(coalesce(dist.ratio, 0.0::DOUBLE)) AS score
    FROM ann JOIN src USING (doc_id) CROSS JOIN (SELECT DISTINCT label FROM dist) lab LEFT JOIN dist ON dist.label = lab.label AND dist.word = ann.l
    GROUP BY conv_id, turn, lab.label)"""
)


def _scored(spark, sf_dir) -> DataFrame:
    from lexigrove.plans.materialise import materialised

    df = _go(spark, sf_dir, "conversations", "role")
    stats = materialised(wordcount.feature_stats(df, F.col("role"))[1])
    scores = wordcount.label_scores(df, ["conv_id", "turn"], stats)
    return scores.withColumn("score", F.round("score", 9))


@query("wordcount_score", _SCORES + " SELECT conv_id, turn, label, round(score, 9) AS score FROM scores")
def wordcount_score(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(
    "wordcount_top_labels",
    _SCORES
    + """, r AS (SELECT conv_id, turn, label, round(score, 9) AS score,
      row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 9) DESC, label)::INT AS rank FROM scores)
    SELECT conv_id, turn, rank, label, score FROM r WHERE rank <= 2 AND score > 0""",
)
def wordcount_top_labels(spark, sf_dir):
    return wordcount.top_labels(_scored(spark, sf_dir), ["conv_id", "turn"], 2)


@query(
    "wordcount_score_features",
    _SCORES
    + """ SELECT conv_id, turn, round(sum(CASE WHEN label = 'assistant' THEN score ELSE 0.0::DOUBLE END), 9) AS word_count_assistant,
      round(sum(CASE WHEN label = 'user' THEN score ELSE 0.0::DOUBLE END), 9) AS word_count_user FROM scores GROUP BY conv_id, turn""",
)
def wordcount_score_features(spark, sf_dir):
    out = wordcount.score_features(_scored(spark, sf_dir), ["conv_id", "turn"], ["assistant", "user"])
    return out.select("conv_id", "turn", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


# Entities, mentions, joins of ranges.


@query(
    "ner_regex",
    chain("documents", "men") + " SELECT ner AS ner_tag, lower(text) AS word, count(*)::BIGINT AS n FROM ner WHERE ner <> 'O' GROUP BY 1, 2",
)
def ner_regex(spark, sf_dir):
    rows = tokens.exploded(annotated(spark, sf_dir, "documents", "sen", "tag", "ner"), "doc_id").where("ner_tag <> 'O'")
    return rows.groupBy("ner_tag", F.lower("text").alias("word")).agg(F.count("*").alias("n"))


def _mentions(df: DataFrame, *keys: str, column: str = "mentions") -> DataFrame:
    return tokens.elements(df, column, *keys).select(*keys, "x.*")


@query(
    "mention_group",
    chain("documents", "men")
    + " SELECT doc_id, entity_type, s AS sent_index, tb AS tok_begin, te AS tok_end, b AS char_begin, e AS char_end, text FROM men",
)
def mention_group(spark, sf_dir):
    out = _mentions(annotated(spark, sf_dir, "documents", "sen", "tag", "ner"), "doc_id")
    ends = [F.col(f"{r}_range.{x}").alias(f"{n}_{x}") for r, n in (("token", "tok"), ("char", "char")) for x in ("begin", "end")]
    return out.select("doc_id", "entity_type", "sent_index", *ends, "text")


@query(
    "mention_text_recut",
    chain("documents", "men") + " SELECT entity_type, text, count(*)::BIGINT AS n FROM men GROUP BY 1, 2",
)
def mention_text_recut(spark, sf_dir):
    out = _mentions(annotated(spark, sf_dir, "documents", "sen", "tag", "ner"), "doc_id")
    return out.groupBy("entity_type", "text").agg(F.count("*").alias("n"))


@query(
    "mention_for_token",
    chain("documents", "men")
    + """, places AS (SELECT doc_id, entity_type, text AS mention_text, unnest(range(tb, te))::INT AS i FROM men)
    SELECT t.doc_id, t.i AS tok_begin, t.text, p.entity_type, p.mention_text FROM places p JOIN tagged t ON t.doc_id = p.doc_id AND t.i = p.i""",
)
def mention_for_token(spark, sf_dir):
    df = annotated(spark, sf_dir, "documents", "sen", "tag", "ner")
    both = tokens.elements(df, access.token_mentions(F.col("tokens"), F.col("mentions")), "doc_id").withColumnRenamed("x", "m")
    rows = both.select("doc_id", F.col("m.entity_type").alias("entity_type"), F.col("m.text").alias("mention_text"), F.explode("m.tokens").alias("t"))
    return rows.select("doc_id", F.col("t.token_range.begin").alias("tok_begin"), "t.text", "entity_type", "mention_text")


@query(
    "tokens_for_mention",
    chain("documents", "men")
    + """ SELECT m.doc_id, m.tb AS tok_begin, m.entity_type, string_agg(t.text, ' ' ORDER BY t.i) AS words
    FROM men m JOIN tagged t ON t.doc_id = m.doc_id AND t.s = m.s AND m.tb <= t.i AND t.i < m.te GROUP BY 1, 2, 3""",
)
def tokens_for_mention(spark, sf_dir):
    df = annotated(spark, sf_dir, "documents", "sen", "tag", "ner")
    both = tokens.elements(df, access.token_mentions(F.col("tokens"), F.col("mentions")), "doc_id").withColumnRenamed("x", "m")
    words = F.array_join(F.transform("m.tokens", lambda t: t["text"]), " ")
    return both.select("doc_id", F.col("m.token_range.begin").alias("tok_begin"), "m.entity_type", words.alias("words"))


@query(
    "token_mentions",
    chain("documents", "men")
    + """ SELECT m.doc_id, count(DISTINCT m.tb)::BIGINT AS n_mentions, count(*)::BIGINT AS n_covered
    FROM men m JOIN tagged t ON t.doc_id = m.doc_id AND t.s = m.s AND m.tb <= t.i AND t.i < m.te GROUP BY 1""",
)
def token_mentions(spark, sf_dir):
    df = annotated(spark, sf_dir, "documents", "sen", "tag", "ner")
    both = df.select("doc_id", settled(access.token_mentions(F.col("tokens"), F.col("mentions"))).alias("m")).where(F.size("m") > 0)
    covered = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.size(x["tokens"]))
    return both.select("doc_id", long_(F.size("m")).alias("n_mentions"), covered.alias("n_covered"))


#: Patterns of the queries over documents and conversations.
LITERAL_ITEMS = [
    patterns.Item("of the", "OF_THE", id=1, first_det_chop=False),
    patterns.Item("and", "CONJUNCTION", id=2, features={"kind": "coordination", "arity": "2"}),
    patterns.Item("in the", "IN_THE", id=3, first_det_chop=False, features={"kind": "place"}),
    patterns.Item("the", "ARTICLE", id=4),
]
_LITERAL_SQL = """, cand AS (
  SELECT doc_id, s, i, i + 2 AS e, 0 AS rule FROM (SELECT *, lead(l) OVER w AS l1 FROM sen WINDOW w AS (PARTITION BY doc_id, s ORDER BY i)) WHERE l = 'of' AND l1 = 'the'
  UNION ALL SELECT doc_id, s, i, i + 1, 1 FROM sen WHERE l IN ('and', '&')
  UNION ALL SELECT doc_id, s, i, i + 2, 2 FROM (SELECT *, lead(l) OVER w AS l1 FROM sen WINDOW w AS (PARTITION BY doc_id, s ORDER BY i)) WHERE l = 'in' AND l1 = 'the'),
joins AS (SELECT *, (lag(e) OVER w = i AND lag(rule) OVER w = rule AND lag(s) OVER w = s) AS goes_on FROM cand WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
marked AS (SELECT *, sum((NOT coalesce(goes_on, false))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM joins),
tre AS (SELECT doc_id, any_value(s) AS s, min(i)::INT AS tb, max(e)::INT AS te, ['OF_THE', 'CONJUNCTION', 'IN_THE'][any_value(rule) + 1] AS label, any_value(rule) + 1 AS item
  FROM marked GROUP BY doc_id, run)"""


def _matched(spark, sf_dir, name: str, items: list[patterns.Item], *steps: str) -> DataFrame:
    df = annotated(spark, sf_dir, name, "sen", *(steps or ("tag", "lemma")))
    if "ner" not in steps:  # mentions carry an entity tag
        df = entities.without_entities(df)
    return patterns.match_patterns(df, patterns.rules_of(items))


@query(
    "tokre_literal",
    chain("documents", "sen") + _LITERAL_SQL + " SELECT doc_id, label, item::INT AS item_id, tb AS tok_begin, te AS tok_end FROM tre",
)
def tokre_literal(spark, sf_dir):
    out = _mentions(chains.only(_matched(spark, sf_dir, "documents", LITERAL_ITEMS), "tok_re_mentions"), "doc_id", column="tok_re_mentions")
    runs = out.select("doc_id", F.col("tok_re_ner_tag").alias("label"), F.col("tok_re_ner_item_id").alias("item_id"), F.col("token_range.begin").alias("b"), F.col("token_range.end").alias("e"))
    return runs.select("doc_id", "label", "item_id", F.col("b").alias("tok_begin"), F.col("e").alias("tok_end"))


@query(
    "tokre_case",
    chain("documents", "sen") + " SELECT text, count(*)::BIGINT AS n FROM sen WHERE text = 'The' GROUP BY text",
)
def tokre_case(spark, sf_dir):
    items = [patterns.Item("The", "SENTENCE_ARTICLE", case_min_tok=0, first_det_chop=False)]
    out = tokens.exploded(_labelled(spark, sf_dir, items), "doc_id").where("tok_re_ner_tag = 'SENTENCE_ARTICLE'")
    return out.groupBy("text").agg(F.count("*").alias("n"))


@query(
    "tokre_lemma",
    chain("documents", "ann") + " SELECT l AS word, count(*)::BIGINT AS n FROM ann WHERE lower(lemma) = 'be' GROUP BY l",
)
def tokre_lemma(spark, sf_dir):
    items = [patterns.Item('[{lemma:"be"}]', "BE", is_regexp=True)]
    out = tokens.exploded(_labelled(spark, sf_dir, items), "doc_id").where("tok_re_ner_tag = 'BE'")
    return out.groupBy(F.lower("text").alias("word")).agg(F.count("*").alias("n"))


@query(
    "tokre_sequence",
    chain("documents", "tagged")
    + r""", c AS (SELECT doc_id, i, l, lead(l) OVER w AS l1, lead(tag) OVER w AS t1 FROM tagged WINDOW w AS (PARTITION BY doc_id, s ORDER BY i))
    SELECT l || ' ' || l1 AS phrase, count(*)::BIGINT AS n FROM c WHERE l IN ('the', 'of') AND t1 = 'NNS' AND regexp_matches(l1, '^(?:\p{L}+)$') GROUP BY 1""",
)
def tokre_sequence(spark, sf_dir):
    items = [patterns.Item(r"[{word:/(?i)the|of/}] [{word:/\p{L}+/;tag:/NNS/}]", "PLURAL_PHRASE", is_regexp=True)]
    matched = chains.only(_matched(spark, sf_dir, "documents", items), "tokens", "tok_re_mentions", fields=("char_range",))
    out = _mentions(_split_runs(matched), "doc_id", column="tok_re_mentions")
    return out.groupBy(F.lower(F.regexp_replace("text", r"[ \t\n\r\x0B\f]+", " ")).alias("phrase")).agg(F.count("*").alias("n"))


def _labelled(spark, sf_dir, items) -> DataFrame:
    return chains.only(_matched(spark, sf_dir, "documents", items), "tokens", fields=("text", "tok_re_ner_tag"))


def _split_runs(df: DataFrame) -> DataFrame:
    """Mentions of a rule of two tokens whose matches touch: cut into pairs."""
    def pairs(m: Column) -> Column:
        n = m["token_range"]["end"] - m["token_range"]["begin"]
        return F.transform(F.sequence(m["token_range"]["begin"], m["token_range"]["begin"] + n - 1, F.lit(2)), lambda b: _pair(m, b))

    def _pair(m: Column, b: Column) -> Column:
        head, tail = at(F.col("tokens"), b), at(F.col("tokens"), b + 1)
        chars = range_of(head["char_range"]["begin"], tail["char_range"]["end"])
        return m.withField("text", F.substring("text", chars["begin"] + 1, chars["end"] - chars["begin"])).withField("token_range", range_of(b, b + 2))

    return df.withColumn("tok_re_mentions", F.flatten(F.transform("tok_re_mentions", pairs)))


@query(
    "tokre_quantifier",
    chain("documents", "sen")
    + """, c AS (SELECT doc_id, i, l, lead(l) OVER w AS l1, lead(l, 2) OVER w AS l2, lead(l, 3) OVER w AS l3 FROM sen WINDOW w AS (PARTITION BY doc_id, s ORDER BY i))
    SELECT doc_id, i::INT AS tok_begin, (i + CASE WHEN l1 = 'the' THEN 2 WHEN l2 = 'the' THEN 3 ELSE 4 END)::INT AS tok_end FROM c WHERE l = 'of'
      AND (l1 = 'the' OR (l1 <> 'of' AND (l2 = 'the' OR (l2 <> 'of' AND l3 = 'the'))))""",
)
def tokre_quantifier(spark, sf_dir):
    """Up to two tokens between two words; a match can neither hold nor touch another one."""
    items = [patterns.Item("[{word:/(?i)of/}] [!{word:/(?i)of|the/}]{0,2} [{word:/(?i)the/}]", "OF_THE", is_regexp=True)]
    return _tokre_spans(spark, sf_dir, items)


@query(
    "tokre_alternation",
    chain("documents", "sen")
    + """, c AS (SELECT doc_id, i, l, lead(l) OVER w AS l1, lead(l, 2) OVER w AS l2 FROM sen WINDOW w AS (PARTITION BY doc_id, s ORDER BY i))
    SELECT doc_id, i::INT AS tok_begin, (i + CASE WHEN l = 'und' THEN 3 ELSE 2 END)::INT AS tok_end FROM c
    WHERE (l IN ('in', 'on', 'de') AND l1 IN ('the', 'la')) OR (l = 'und' AND l1 NOT IN ('und', 'in', 'on', 'de') AND l2 = 'die')""",
)
def tokre_alternation(spark, sf_dir):
    content = '(?: [{word:/(?i)in|on|de/}] ([{word:/(?i)the/} | {word:/(?i)la/}]) | /(?i)und/ [!{word:/(?i)und|in|on|de/}] /(?i)die/ )'
    return _tokre_spans(spark, sf_dir, [patterns.Item(content, "PHRASE", is_regexp=True)])


def _tokre_spans(spark, sf_dir, items) -> DataFrame:
    df = patterns.kept_matches(annotated(spark, sf_dir, "documents", "sen"), patterns.rules_of(items))
    rows = tokens.elements(chains.only(df, "t_kept"), "t_kept", "doc_id")
    return rows.select("doc_id", F.col("x.begin").alias("tok_begin"), F.col("x.end").alias("tok_end"))


@query(
    "tokre_group",
    chain("documents", "sen")
    + """, c AS (SELECT doc_id, i, l, lead(l) OVER w AS l1 FROM sen WINDOW w AS (PARTITION BY doc_id, s ORDER BY i)),
    hits AS (SELECT doc_id, i FROM c WHERE l = 'of' AND l1 = 'the')
    SELECT doc_id, count(*)::BIGINT AS n_labelled, (count(*) // 2)::BIGINT AS n_featured FROM (
      SELECT doc_id, i FROM hits UNION ALL SELECT doc_id, i + 1 FROM hits) GROUP BY doc_id""",
)
def tokre_group(spark, sf_dir):
    """The label goes to the whole match, the features to its second group."""
    items = [patterns.Item("([{word:/(?i)of/}]) (?$what [{word:/(?i)the/}])", "OF_THE", features={"part": "article"}, is_regexp=True, feature_group="$what")]
    df = chains.only(_matched(spark, sf_dir, "documents", items), "tokens", fields=("tok_re_ner_tag", "tok_re_ner_features"))
    df = df.select("doc_id", settled(F.col("tokens")).alias("tokens"))
    of = lambda test: long_(F.size(F.filter("tokens", test)))
    counts = df.select("doc_id", of(lambda t: t["tok_re_ner_tag"] == "OF_THE").alias("n_labelled"), of(lambda t: t["tok_re_ner_features"]["part"] == "article").alias("n_featured"))
    return counts.where("n_labelled > 0")


FEATURE_TEXTS = ["food-type={snack}", "pii-type={ssn},level={high}", "a={1},b={2},c={3}", ""]


@query(
    "tokre_feature_parse",
    "SELECT * FROM (VALUES (0, 'food-type', 'snack'), (1, 'pii-type', 'ssn'), (1, 'level', 'high'), (2, 'a', '1'), (2, 'b', '2'), (2, 'c', '3')) t(row, feature, value)",
)
def tokre_feature_parse(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(FEATURE_TEXTS)), "row int, features string")
    return rows.select("row", F.explode(patterns.parse_features(F.col("features"))).alias("feature", "value"))


@query(
    "tokre_feature_union",
    "SELECT * FROM (VALUES ('arity', '2'), ('kind', 'coordination,place')) t(feature, all_values)",
)
def tokre_feature_union(spark, sf_dir):
    from lexigrove.sources.rules import feature_value_table, rules_table

    return feature_value_table(rules_table(spark, LITERAL_ITEMS)).select("feature", F.array_join("values", ",").alias("all_values"))


@query(
    "tokre_rule_lines",
    """SELECT * FROM (VALUES
      (1, 'OF_THE', 'of the', '{pattern:([{word:/(?i)of/}] [{word:/(?i)the/}]),action:(Annotate($0,zstrner,"OF_THE"),Annotate($0,zstriid,"1"))}', ''),
      (2, 'CONJUNCTION', 'and', '{pattern:([{word:/(?i)(?:&|and)/}]),action:(Annotate($0,zstrner,"CONJUNCTION"),Annotate($0,zstriid,"2"),Annotate($0,zstrfeat,"kind={coordination},arity={2}"))}', 'kind={coordination},arity={2}'),
      (3, 'IN_THE', 'in the', '{pattern:([{word:/(?i)in/}] [{word:/(?i)the/}]),action:(Annotate($0,zstrner,"IN_THE"),Annotate($0,zstriid,"3"),Annotate($0,zstrfeat,"kind={place}"))}', 'kind={place}'),
      (4, 'ARTICLE', 'the', NULL, '')) t(id, label, content, rule, features)""",
)
def tokre_rule_lines(spark, sf_dir):
    from lexigrove.sources.rules import rules_table

    return rules_table(spark, LITERAL_ITEMS)


@query(
    "tokre_pii",
    chain("documents", "sen")
    + r""" SELECT doc_id, i::INT AS tok_begin, text, 'card' AS pii_type FROM sen WHERE regexp_matches(text, '^4[0-9]{15}$') AND NOT starts_with(text, '4000')""",
)
def tokre_pii(spark, sf_dir):
    """Numbers in the form of a payment card's, by a verbatim expression with look-ahead."""
    items = [patterns.Item("/(?!4000)4[0-9]{15}/", "PII", id=1, is_regexp=True, features={"pii-type": "card"})]
    rows = tokens.exploded(_matched(spark, sf_dir, "documents", items), "doc_id").where("tok_re_ner_tag = 'PII'")
    return rows.select("doc_id", F.col("token_range.begin").alias("tok_begin"), "text", F.col("tok_re_ner_features")["pii-type"].alias("pii_type"))


_BOTH = """, both_ AS (SELECT doc_id, 'ner' AS kind, entity_type, tb, te FROM men UNION ALL SELECT doc_id, 'tok_re', label, tb, te FROM tre)"""


def _all_mentions(spark, sf_dir) -> DataFrame:
    df = _matched(spark, sf_dir, "documents", LITERAL_ITEMS, "tag", "lemma", "ner")
    light = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), m["entity_type"].alias("entity_type"), m["token_range"].alias("token_range"))
    both = access.mentions(F.transform("mentions", light("ner")), F.transform("tok_re_mentions", light("tok_re")))
    return chains.only(df, "mentions", "tok_re_mentions").select("doc_id", both.alias("both"))


@query(
    "mention_concat",
    chain("documents", "sen", "men") + _LITERAL_SQL + _BOTH + " SELECT doc_id, kind, entity_type, tb AS tok_begin, te AS tok_end FROM both_",
)
def mention_concat(spark, sf_dir):
    out = _mentions(_all_mentions(spark, sf_dir), "doc_id", column="both")
    return out.select("doc_id", "kind", "entity_type", F.col("token_range.begin").alias("tok_begin"), F.col("token_range.end").alias("tok_end"))


@query(
    "mention_overlap",
    chain("documents", "sen", "men")
    + _LITERAL_SQL
    + _BOTH
    + """, ids AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, tb) AS n FROM both_)
    SELECT a.doc_id, count(*)::BIGINT AS n_pairs FROM ids a JOIN ids b ON a.doc_id = b.doc_id AND a.n < b.n AND a.tb <= b.te AND b.tb <= a.te GROUP BY a.doc_id""",
)
def mention_overlap(spark, sf_dir):
    df, pairs = access.overlap_pairs_of(_matched(spark, sf_dir, "documents", LITERAL_ITEMS, "tag", "lemma", "ner"))
    return df.select("doc_id", settled(pairs).alias("n_pairs")).where("n_pairs > 0")


ENTITIES = ["PERSON", "LOCATION", "DATE", "NUMBER", "MONEY"]


@query(
    "mention_features",
    chain("documents", "men")
    + ", sizes AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id)"
    + " SELECT src.doc_id, "
    + ", ".join(
        f"count(*) FILTER (entity_type = '{k}')::BIGINT AS mentions_count_{k.lower()}, coalesce(count(*) FILTER (entity_type = '{k}')::DOUBLE / any_value(sizes.n), 0.0::DOUBLE) AS mentions_ratio_{k.lower()}"
        for k in ENTITIES
    )
    + " FROM src LEFT JOIN sizes USING (doc_id) LEFT JOIN men USING (doc_id) GROUP BY src.doc_id",
)
def mention_features(spark, sf_dir):
    df = chains.only(annotated(spark, sf_dir, "documents", "sen", "tag", "ner"), "tokens", "mentions", fields=("sent_index",))
    return features.select_features(df, ["doc_id"], features.mention_features(F.col("mentions"), F.col("tokens"), ENTITIES), features.mention_feature_metas(ENTITIES))


_PAIRS = """, r AS (SELECT doc_id, s, min(i) AS tb, max(i) + 1 AS te FROM sen GROUP BY doc_id, s),
pairs AS (SELECT a.doc_id, a.s, a.tb AS ab, a.te AS ae, b.tb AS bb, b.te AS be FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.s = a.s + 1)"""


def _neighbours(spark, sf_dir) -> DataFrame:
    df = chains.only(annotated(spark, sf_dir, "documents", "sen"), "sents")
    both = let(F.col("sents"), lambda ss: F.transform(ss, lambda s, i: F.struct(s.alias("a"), at(ss, i + 1).alias("b"))))
    rows = tokens.elements(df, both, "doc_id").withColumnRenamed("x", "p").where("p.b IS NOT NULL")
    return rows.select("doc_id", F.col("p.a.sent_index").alias("s"), F.col("p.a.token_range").alias("a"), F.col("p.b.token_range").alias("b"))


@query(
    "range_in",
    chain("documents", "sen") + _PAIRS + " SELECT doc_id, count_if(bb >= ab AND be <= ae)::BIGINT AS n_in, count_if(ab >= ab AND be >= ae AND bb >= ab)::BIGINT AS n_hull FROM pairs GROUP BY doc_id",
)
def range_in(spark, sf_dir):
    hull = range_of(F.col("a.begin"), F.col("b.end"))
    rows = _neighbours(spark, sf_dir).groupBy("doc_id")
    return rows.agg(F.count_if(in_range(F.col("a"), F.col("b"))).alias("n_in"), F.count_if(in_range(hull, F.col("b"))).alias("n_hull"))


@query(
    "range_overlap",
    chain("documents", "sen") + _PAIRS + " SELECT doc_id, s, (ab <= be AND bb <= ae) AS touches FROM pairs",
)
def range_overlap(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("doc_id", "s", overlaps(F.col("a"), F.col("b")).alias("touches"))


# Sentiment.


@query(
    "sentiment_sentence",
    chain("conversations", "sen_mood") + " SELECT conv_id, turn, s AS sent_index, mood AS sentiment FROM sen_mood JOIN src USING (doc_id)",
)
def sentiment_sentence(spark, sf_dir):
    out = tokens.exploded_sentences(annotated(spark, sf_dir, "conversations", "sen", "tag", "mood"), "conv_id", "turn")
    return out.select("conv_id", "turn", "sent_index", "sentiment")


@query(
    "sentiment_utterance",
    chain("conversations", "sen_mood") + " SELECT conv_id, turn, coalesce(sum(mood), 0)::INT AS sentiment FROM src LEFT JOIN sen_mood USING (doc_id) GROUP BY conv_id, turn",
)
def sentiment_utterance(spark, sf_dir):
    return annotated(spark, sf_dir, "conversations", "sen", "tag", "mood").select("conv_id", "turn", "sentiment")


@query(
    "sentiment_label",
    chain("conversations", "sen_mood")
    + f", u AS (SELECT coalesce(sum(mood), 0) AS m FROM src LEFT JOIN sen_mood USING (doc_id) GROUP BY doc_id) SELECT {o.label_of('m')} AS label, count(*)::BIGINT AS n FROM u GROUP BY 1",
)
def sentiment_label(spark, sf_dir):
    df = annotated(spark, sf_dir, "conversations", "sen", "tag", "mood")
    return df.groupBy(tg.sentiment_label(F.col("sentiment")).alias("label")).agg(F.count("*").alias("n"))


@query(
    "sentiment_features",
    chain("conversations", "sen_mood")
    + """ SELECT conv_id, turn, coalesce(sum(mood), 0)::BIGINT AS sentiment_utterance, min(mood)::BIGINT AS sentiment_min, max(mood)::BIGINT AS sentiment_max,
      coalesce(sum(mood), 0)::BIGINT AS sentiment_sum, round(coalesce(avg(mood::DOUBLE), 0.0::DOUBLE), 9) AS sentiment_mean,
      round(coalesce(var_samp(mood::DOUBLE), 0.0::DOUBLE), 9) AS sentiment_variance FROM src LEFT JOIN sen_mood USING (doc_id) GROUP BY conv_id, turn""",
)
def sentiment_features(spark, sf_dir):
    df = annotated(spark, sf_dir, "conversations", "sen", "tag", "mood")
    out = features.select_features(df, ["conv_id", "turn"], features.sentiment_features(F.col("sents"), F.col("sentiment")), features.sentiment_feature_metas())
    return out.withColumns({c: F.round(c, 9) for c in ("sentiment_mean", "sentiment_variance")})


@query(
    "sentiment_class_score",
    "SELECT * FROM (VALUES ('very positive', 2), ('Positive', 1), ('NEUTRAL', 0), ('negative', -1), ('Very Negative', -2), ('other', NULL)) t(label, score)",
)
def sentiment_class_score(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in ("very positive", "Positive", "NEUTRAL", "negative", "Very Negative", "other")], "label string")
    return rows.withColumn("score", tg.sentiment_score(F.col("label")))


# Features of tokens.


@query(
    "token_features",
    chain("conversations", "men")
    + """, per AS (SELECT doc_id, count(*)::BIGINT AS n, (max(s) + 1)::BIGINT AS ns, sum(length(text))::DOUBLE AS total, arg_max(text, i) AS last_ FROM tagged GROUP BY doc_id),
    ms AS (SELECT doc_id, count(*)::BIGINT AS m FROM men GROUP BY doc_id)
    SELECT conv_id, turn, length(src.text)::BIGINT AS utterance_length, coalesce(m, 0)::BIGINT AS mention_count, coalesce(ns, 0)::BIGINT AS sent_count,
      coalesce(n, 0)::BIGINT AS token_count, coalesce(total / n, 0.0::DOUBLE) AS token_average_length, coalesce(last_ = '?', false) AS is_question
    FROM src LEFT JOIN per USING (doc_id) LEFT JOIN ms USING (doc_id)""",
)
def token_features(spark, sf_dir):
    df = annotated(spark, sf_dir, "conversations", "sen", "tag", "ner")
    made = features.token_features(F.col("text"), F.col("tokens"), F.col("sents"), F.col("mentions"))
    return features.select_features(df, ["conv_id", "turn"], made, features.token_feature_metas())


_DICTIONARY = """, b AS (SELECT coalesce(text, '') AS text FROM benchmark),
dict AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM b)),
c AS (SELECT t.doc_id, count(dict.word)::BIGINT AS in_dict_count, count(*)::BIGINT AS token_count FROM tok t LEFT JOIN dict ON lower(t.text) = dict.word GROUP BY t.doc_id)
SELECT doc_id, in_dict_count, token_count, in_dict_count::DOUBLE / token_count AS in_dict_ratio FROM c"""


@query("dictionary_ratio", chain("documents", "tok") + _DICTIONARY)
def dictionary_ratio(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark", "text").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    rows = tokens.exploded(annotated(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text")
    return features.dictionary_ratio(rows, words.select(F.lower("w").alias("word")), ["doc_id"])


# Trees, roles, coreference.


def _edges(spark, sf_dir) -> DataFrame:
    df = chains.only(annotated(spark, sf_dir, "conversations", "sen", "tag", "dep"), "dependency_edges")
    return tokens.elements(df, "dependency_edges", "conv_id", "turn").select("conv_id", "turn", "x.*")


@query(
    "dep_edges",
    chain("conversations", "edges")
    + """ SELECT conv_id, turn, s::INT AS sent_index, k::INT AS token_index, head::INT AS parent_token_index, child_ord::INT AS child_ord, dep, edges.text
    FROM edges JOIN src USING (doc_id)""",
)
def dep_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(
    "root_token",
    chain("conversations", "edges")
    + " SELECT conv_id, turn, edges.text AS root, tag AS root_tag FROM src LEFT JOIN edges ON edges.doc_id = src.doc_id AND s = 0 AND head = 0",
)
def root_token(spark, sf_dir):
    df = chains.only(annotated(spark, sf_dir, "conversations", "sen", "tag", "dep"), "tokens", "dependency_edges", fields=("text", "sent_index", "token_index", "pos_tag"))
    root = access.root_dependency(F.col("tokens"), F.col("dependency_edges"))
    return df.select("conv_id", "turn", root["text"].alias("root"), root["pos_tag"].alias("root_tag"))


@query(
    "dep_parent_join",
    chain("conversations", "edges")
    + """ SELECT a.dep, lower(b.text) AS parent, count(*)::BIGINT AS n FROM edges a LEFT JOIN edges b ON a.doc_id = b.doc_id AND a.s = b.s AND a.head = b.k GROUP BY 1, 2""",
)
def dep_parent_join(spark, sf_dir):
    out = syntax.edge_parents(annotated(spark, sf_dir, "conversations", "sen", "tag", "dep"))
    return out.groupBy("dep", F.lower("parent_text").alias("parent")).agg(F.count("*").alias("n"))


@query(
    "dep_ancestors",
    chain("conversations", "edges").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, up AS (SELECT doc_id, s, head, 1 AS depth FROM edges WHERE head > 0
      UNION ALL SELECT up.doc_id, up.s, e.head, depth + 1 FROM up JOIN edges e ON e.doc_id = up.doc_id AND e.s = up.s AND e.k = up.head WHERE e.head > 0)
    SELECT depth::INT AS depth, count(*)::BIGINT AS n FROM up GROUP BY depth""",
)
def dep_ancestors(spark, sf_dir):
    return syntax.ancestors(_edges(spark, sf_dir), ["conv_id", "turn"]).groupBy("depth").agg(F.count("*").alias("n"))


def _nodes(spark, sf_dir) -> DataFrame:
    return annotated(spark, sf_dir, "conversations", "sen", "tag", "tree")


@query("parse_tree_nodes")
def parse_tree_nodes(spark, sf_dir):
    rows = tokens.elements(_nodes(spark, sf_dir), "parse_nodes", "conv_id", "turn").select("conv_id", "turn", "x.*")
    return rows.select("conv_id", "turn", "sent_index", "node_id", "parent_id", "child_ord", "label", "token_index", F.col("index_range.begin").alias("b"), F.col("index_range.end").alias("e"))


@query("parse_tree_shift_reduce")
def parse_tree_shift_reduce(spark, sf_dir):
    df = chains.only(syntax.add_parse_trees(annotated(spark, sf_dir, "conversations", "sen", "tag"), use_shift_reduce=True, include_score=True), "parse_nodes")
    return tokens.elements(df, "parse_nodes", "conv_id", "turn").withColumnRenamed("x", "n").groupBy("n.label").agg(F.count("*").alias("n"), F.sum("n.score").alias("score"))


@query("parse_tree_leaves", chain("conversations", "tagged") + " SELECT conv_id, turn, count(*)::BIGINT AS n_leaves, (max(s) + 1)::BIGINT AS n_roots FROM tagged JOIN src USING (doc_id) GROUP BY conv_id, turn")
def parse_tree_leaves(spark, sf_dir):
    df = nonempty(_nodes(spark, sf_dir))
    leaves, roots = count_if(F.col("parse_nodes"), lambda x: x["token_index"].isNotNull()), count_if(F.col("parse_nodes"), lambda x: x["parent_id"] < 0)
    return df.select("conv_id", "turn", long_(leaves).alias("n_leaves"), long_(roots).alias("n_roots"))


_DOWN = o.listed([*syntax.DOWNWARD, "not", "n't", "n’t", "never", "without"])


@query(
    "natlog_polarity",
    chain("conversations", "tagged")
    + f""", down AS (SELECT doc_id, s, min(k) AS k0 FROM tagged WHERE l IN {_DOWN} GROUP BY doc_id, s),
    q AS (SELECT t.doc_id, coalesce(t.k > down.k0, false) AS is_down, (t.l IN {o.listed([*syntax.UPWARD, *syntax.DOWNWARD])} AND t.tag IN ('DT', 'JJ', 'PDT')) AS quant
      FROM tagged t LEFT JOIN down USING (doc_id, s))
    SELECT conv_id, turn, count_if(is_down)::BIGINT AS n_down, count_if(quant)::BIGINT AS n_quantifiers FROM q JOIN src USING (doc_id) GROUP BY conv_id, turn""",
)
def natlog_polarity(spark, sf_dir):
    df = nonempty(annotated(spark, sf_dir, "conversations", "sen", "tag", "natlog"))
    down, quantifiers = count_if(F.col("tokens"), lambda t: t["natlog"]["polarity"] == "down"), count_if(F.col("tokens"), lambda t: t["natlog"]["operator"].isNotNull())
    return df.select("conv_id", "turn", long_(down).alias("n_down"), long_(quantifiers).alias("n_quantifiers"))


def _roles(spark, sf_dir) -> DataFrame:
    return chains.only(annotated(spark, sf_dir, "conversations", "sen", "tag", "lemma", "dep", "srl"), "tokens", fields=("sent_index", "token_index", "srl"))


_FRAMES = f"""CASE WHEN e.tag IN {o.listed(syntax.VERBS)} THEN CASE lemma {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in syntax.FRAMES.items())} ELSE lemma || '.01' END END"""


@query(
    "srl_features",
    chain("conversations", "edges", "ann")
    + f""", r AS (SELECT e.doc_id, e.dep, {_FRAMES} AS frame FROM edges e JOIN ann ON ann.doc_id = e.doc_id AND ann.i = e.i)
    SELECT conv_id, turn, coalesce(sum({o.java_hash("frame")}) FILTER (frame IS NOT NULL), 0)::BIGINT AS srl_propbank_id,
      count(*) FILTER (dep IN {o.listed(roles.ARGUMENTS)})::BIGINT AS srl_argument_counts FROM src LEFT JOIN r USING (doc_id) GROUP BY conv_id, turn""",
)
def srl_features(spark, sf_dir):
    return features.select_features(_roles(spark, sf_dir), ["conv_id", "turn"], features.srl_features(F.col("tokens")), features.srl_feature_metas())


@query(
    "srl_propbank",
    chain("conversations", "ann")
    + f""", v AS (SELECT doc_id, i, CASE lemma {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in syntax.FRAMES.items())} ELSE lemma || '.01' END AS frame
      FROM ann WHERE tag IN {o.listed(syntax.VERBS)})
    SELECT conv_id, turn, arg_min(frame, i) AS first_propbank, sum({o.java_hash("frame")})::BIGINT AS propbank_id FROM v JOIN src USING (doc_id) GROUP BY conv_id, turn""",
)
def srl_propbank(spark, sf_dir):
    df = _roles(spark, sf_dir)
    out = df.select("conv_id", "turn", access.first_propbank_label(F.col("tokens")).alias("first_propbank"), features.srl_features(F.col("tokens"))["srl_propbank_id"].alias("propbank_id"))
    return out.withColumn("first_propbank", settled(F.col("first_propbank"))).where("first_propbank IS NOT NULL")


@query(
    "srl_propbank_sentence",
    chain("conversations", "ann")
    + f""" SELECT conv_id, turn, arg_min({_FRAMES.replace("e.tag", "tag")}, i) FILTER (tag IN {o.listed(syntax.VERBS)}) AS first_propbank
    FROM src LEFT JOIN (SELECT * FROM ann WHERE s = 1) USING (doc_id) GROUP BY conv_id, turn""",
)
def srl_propbank_sentence(spark, sf_dir):
    """The first frame of each utterance's second sentence."""
    return _roles(spark, sf_dir).select("conv_id", "turn", access.first_sentence_propbank_label(F.col("tokens"), 1).alias("first_propbank"))


@query("srl_zip", chain("conversations", "tok") + " SELECT conv_id, turn, count(*)::BIGINT AS n FROM tok JOIN src USING (doc_id) GROUP BY conv_id, turn")
def srl_zip(spark, sf_dir):
    df = nonempty(_roles(spark, sf_dir))
    return df.select("conv_id", "turn", long_(count_if(F.col("tokens"), lambda t: t["srl"]["id"] == t["token_index"])).alias("n"))


@query(
    "srl_heads",
    chain("conversations", "edges", "ann")
    + f""", r AS (SELECT e.doc_id, e.s, e.k, e.head, e.dep, {_FRAMES} AS frame FROM edges e JOIN ann ON ann.doc_id = e.doc_id AND ann.i = e.i)
    SELECT CASE a.dep {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in roles.RELATIONS.items())} ELSE a.dep END AS dependency_label, b.frame AS head_propbank, count(*)::BIGINT AS n
    FROM r a LEFT JOIN r b ON a.doc_id = b.doc_id AND a.s = b.s AND a.head = b.k GROUP BY 1, 2""",
)
def srl_heads(spark, sf_dir):
    rows = roles.role_heads(annotated(spark, sf_dir, "conversations", "sen", "tag", "lemma", "dep", "srl"))
    return rows.groupBy("dependency_label", "head_propbank").agg(F.count("*").alias("n"))


_TREES = [(0, 3, 0.9, False), (0, 3, 0.5, True), (1, 4, 0.9, False), (1, 4, 0.5, True), (2, 3, 0.7, False), (2, 3, 0.6, False)]


@query("srl_best_tree", "SELECT * FROM (VALUES (0, 0.5::DOUBLE), (1, 0.9::DOUBLE), (2, 0.7::DOUBLE)) t(sent_index, score)")
def srl_best_tree(spark, sf_dir):
    rows = spark.createDataFrame(_TREES, "sent_index int, n_tokens int, score double, has_propbank boolean")
    grouped = rows.groupBy("sent_index", "n_tokens").agg(F.collect_list(F.struct("score", "has_propbank")).alias("trees"))
    return grouped.select("sent_index", roles.best_tree(F.col("trees"), F.col("n_tokens"))["score"].alias("score"))


@query(
    "tree_features",
    chain("conversations", "edges")
    + f""", trees AS (SELECT doc_id, s, string_agg(k || ':' || head || ':' || dep || ':' || text, ' ' ORDER BY k) AS tree FROM edges GROUP BY doc_id, s),
    hashed AS (SELECT doc_id, ({o.java_hash("tree")})::BIGINT AS h FROM trees)
    SELECT conv_id, turn, coalesce(sum(h), 0)::BIGINT AS dep_tree_id FROM src LEFT JOIN hashed USING (doc_id) GROUP BY conv_id, turn""",
)
def tree_features(spark, sf_dir):
    df = annotated(spark, sf_dir, "conversations", "sen", "tag", "dep")
    return features.select_features(df, ["conv_id", "turn"], features.tree_features(F.col("dependency_edges")), features.tree_feature_metas())


@query("coref_chains")
def coref_chains(spark, sf_dir):
    df = annotated(spark, sf_dir, "conversations", "sen", "tag", "ner", "coref")
    flat = F.flatten(F.transform("coref", lambda c: F.transform(c["mention"], lambda m: m.withField("id", c["id"]))))
    rows = tokens.elements(df, flat, "conv_id", "turn").withColumnRenamed("x", "m")
    return rows.select("conv_id", "turn", F.col("m.id").alias("chain_id"), "m.sent_index", F.col("m.token_range.begin").alias("tok_begin"), F.col("m.token_range.end").alias("tok_end"), "m.gender", "m.type", "m.number")


# Pipelines, configuration, schemas.


@query("default_pipeline")
def default_pipeline(spark, sf_dir):
    """Every annotator of the default pipeline, as nested records."""
    from lexigrove.plans import registry
    from lexigrove.plans.records import to_record

    df = registry.annotate(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"))
    return to_record(df, "conv_id", "turn")


@query(
    "only_tokenize_pipeline",
    chain("conversations", "sen") + " SELECT conv_id, turn, count(*)::BIGINT AS n_tokens, (max(s) + 1)::BIGINT AS n_sents FROM sen JOIN src USING (doc_id) GROUP BY conv_id, turn",
)
def only_tokenize_pipeline(spark, sf_dir):
    from lexigrove.plans import registry
    from lexigrove.plans.records import to_record

    context = registry.create_context(only_tokenize=True)
    records = to_record(registry.annotate(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), context=context), "conv_id", "turn")
    n = F.aggregate("panon.sents", F.lit(0).cast("long"), lambda a, s: a + F.size(s["tokens"]))
    out = records.select("conv_id", "turn", n.alias("n_tokens"), settled(long_(F.size("panon.sents"))).alias("n_sents"))
    return out.where("n_sents > 0")


DSL_CONFIG = 'tokenize("en"),sentence,part-of-speech("english"),rules/morphology,stopword,sentiment(false)'


@query(
    "config_dsl_components",
    """SELECT * FROM (VALUES (0, 'tokenize', 'rules', '{"lang": "en", "only_whitespace": false}'), (1, 'sents', 'rules', '{}'),
      (2, 'pos', 'rules', '{"pos_model_resource": "english"}'), (3, 'morph', 'rules', '{}'), (4, 'stopword', 'rules', '{}'),
      (5, 'sentiment', 'rules', '{"aggregate": false}')) t(place, component, parser, options)""",
)
def config_dsl_components(spark, sf_dir):
    import json

    from lexigrove.plans.dsl import parse

    rows = [(i, x.component, x.parser, json.dumps(x.options)) for i, x in enumerate(parse(DSL_CONFIG))]
    return spark.createDataFrame(rows, "place int, component string, parser string, options string")


@query(
    "component_docs",
    """SELECT * FROM (VALUES ('coreference'), ('dependency-parse-tree'), ('morphology'), ('named-entity-recognizer'), ('natural-logic'), ('parse-tree'),
      ('part-of-speech'), ('semantic-role-labeler'), ('sentence'), ('sentiment'), ('stopword'), ('token-regex'), ('tokenize')) t(name)""",
)
def component_docs(spark, sf_dir):
    from lexigrove.plans.registry import component_documentation_table

    return component_documentation_table(spark).where(F.length("doc") > 0).select("name")


def _metas() -> list[tuple]:
    schemas = {
        "verb": features.verb_feature_metas(),
        "pos": features.pos_feature_metas(),
        "tree": features.tree_feature_metas(),
        "srl": features.srl_feature_metas(),
        "sentiment": features.sentiment_feature_metas(),
        "mentions": features.mention_feature_metas(["PERSON"]),
        "words": wordcount.score_feature_metas(["user"]),
        "tokens": features.token_feature_metas(),
    }
    return [(k, f.name, f.dataType.simpleString(), f.metadata.get("kind"), len(f.metadata.get("values", []))) for k, schema in schemas.items() for f in schema]


@query(
    "feature_metas",
    """SELECT * FROM (VALUES ('verb', 2, 0), ('pos', 12, 90), ('tree', 1, 0), ('srl', 2, 0), ('sentiment', 6, 0), ('mentions', 2, 0), ('words', 1, 0), ('tokens', 6, 0))
      t(feature_set, n_features, n_values)""",
)
def feature_metas(spark, sf_dir):
    rows = spark.createDataFrame(_metas(), "feature_set string, name string, type string, kind string, n_values int")
    return rows.groupBy("feature_set").agg(F.count("*").cast("int").alias("n_features"), F.sum("n_values").cast("int").alias("n_values"))


@query("feature_meta_rows")
def feature_meta_rows(spark, sf_dir):
    return spark.createDataFrame(_metas(), "feature_set string, name string, type string, kind string, n_values int")


@query("pos_tag_sets", "SELECT * FROM (VALUES ('noun', 4), ('verb', 6), ('adjective', 3), ('adverb', 4), ('wh', 4), ('all', 44)) t(kind, n)")
def pos_tag_sets(spark, sf_dir):
    rows = [(k, len(tg.pos_tags(k))) for k in tg.pos_tag_types()] + [("all", len(tg.pos_tags()))]
    return spark.createDataFrame(rows, "kind string, n int")


@query("streaming_word_counts", ORACLE["wordcount_by_label"])
def streaming_word_counts(spark, sf_dir):
    """The counts that a stream over the conversations has reached when all of them are read."""
    from lexigrove.streaming.annotate import counted_to_end

    return counted_to_end(spark, f"{sf_dir}/conversations.parquet", "role")

