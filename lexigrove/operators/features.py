"""Features of one annotated row as column expressions, with the schemas of what they give.

Every function takes array columns of a row and returns named columns, so a feature table is a single projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.defaults import EMPTY, NONE_LABEL
from lexigrove.functions.arrays import at, count_if, first, last, let, ratio
from lexigrove.functions.strings import feature_name, java_hash
from lexigrove.functions.tags import TAG_TYPES, pos_tag_or_none, pos_tag_type, pos_tags
from lexigrove.operators import chains


def numeric(name: str, whole: bool = False) -> T.StructField:
    return T.StructField(name, T.LongType() if whole else T.DoubleType(), True, {"kind": "numeric"})


def nominal(name: str, values: list[str]) -> T.StructField:
    return T.StructField(name, T.StringType(), True, {"kind": "nominal", "values": values})


def pos_features(tokens: Column) -> dict[str, Column]:
    """Count and ratio (to all tokens) of each class of tags; first and last tag."""
    kinds = F.transform(tokens, lambda t: pos_tag_type(t["pos_tag"]))
    out = {}
    for kind in TAG_TYPES:
        count = count_if(kinds, lambda k, kind=kind: k == kind).cast("long")
        out[feature_name("pos-tag-count", kind)] = count
        out[feature_name("pos-tag-ratio", kind)] = ratio(count, F.size(tokens))
    out["pos_first_tag"] = pos_tag_or_none(first(tokens)["pos_tag"])
    out["pos_last_tag"] = pos_tag_or_none(last(tokens)["pos_tag"])
    return out


def pos_features_of(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """A table and :func:`pos_features` of its rows; where annotators run together, from counts made there."""
    out = chains.extended(df, "stats")
    if out is None:
        return df, pos_features(F.col("tokens"))
    made, x = {}, first(F.col("pos_stats"))
    for kind in TAG_TYPES:
        made[feature_name("pos-tag-count", kind)] = x[kind].cast("long")
        made[feature_name("pos-tag-ratio", kind)] = ratio(x[kind], x["n"])
    made["pos_first_tag"], made["pos_last_tag"] = pos_tag_or_none(x["first"]), pos_tag_or_none(x["last"])
    return chains.only(out, "pos_stats"), made


def pos_feature_metas() -> T.StructType:
    tags = [NONE_LABEL, *pos_tags()]
    counts = [f for kind in TAG_TYPES for f in (numeric(feature_name("pos-tag-count", kind), True), numeric(feature_name("pos-tag-ratio", kind)))]
    return T.StructType([*counts, nominal("pos_first_tag", tags), nominal("pos_last_tag", tags)])


def elected_verb(tokens: Column, root: Column | None = None) -> Column:
    """The first token in lower case if it is a base verb, else the root of the dependencies if it is one."""
    own = F.when(first(tokens)["pos_tag"] == "VB", F.lower(first(tokens)["text"]))
    if root is not None:
        own = F.coalesce(own, let(root, lambda r: F.when(r["pos_tag"] == "VB", F.lower(r["text"]))))
    return F.coalesce(own, F.lit(NONE_LABEL))


def verb_features(tokens: Column, root: Column | None = None) -> dict[str, Column]:
    verb = elected_verb(tokens, root)
    return {"elected_verb": verb, "elected_verb_id": java_hash(verb)}


def verb_feature_metas() -> T.StructType:
    return T.StructType([T.StructField("elected_verb", T.StringType()), numeric("elected_verb_id", True)])


def srl_features(tokens: Column) -> dict[str, Column]:
    """Sum of the frames' hashes, and tokens whose first argument label is set."""
    frames = F.filter(F.transform(tokens, lambda t: t["srl"]["propbank"]), lambda p: p.isNotNull())
    hashed = F.aggregate(F.transform(frames, java_hash), F.lit(0).cast("long"), lambda a, x: a + x)
    count = count_if(tokens, lambda t: first(t["srl"]["heads"])["dependency_label"].isNotNull())
    return {"srl_propbank_id": hashed, "srl_argument_counts": count.cast("long")}


def srl_feature_metas() -> T.StructType:
    return T.StructType([numeric("srl_propbank_id", True), numeric("srl_argument_counts", True)])


def sentiment_features(sents: Column, whole: Column) -> dict[str, Column]:
    """Of the utterance, and least, greatest, sum, mean and sample variance over sentences that have one.

    Without sentences, least and greatest are null and the others 0; the variance of one sentence is 0.
    """

    def over(scores: Column) -> Column:
        n = F.size(scores)
        total = F.aggregate(scores, F.lit(0).cast("long"), lambda a, x: a + x)
        mean = ratio(total, n)
        squares = F.aggregate(scores, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        variance = F.when(n > 1, squares / (n - 1)).otherwise(0.0)
        return F.struct(
            F.array_min(scores).cast("long").alias("min"), F.array_max(scores).cast("long").alias("max"), total.alias("sum"), mean.alias("mean"), variance.alias("variance")
        )

    made = let(F.filter(F.transform(sents, lambda s: s["sentiment"]), lambda x: x.isNotNull()), over)
    return {"sentiment_utterance": whole.cast("long")} | {f"sentiment_{k}": made[k] for k in ("min", "max", "sum", "mean", "variance")}


def sentiment_feature_metas() -> T.StructType:
    whole = [numeric(f"sentiment_{k}", True) for k in ("utterance", "min", "max", "sum")]
    return T.StructType([*whole, numeric("sentiment_mean"), numeric("sentiment_variance")])


def mention_features(mentions: Column, tokens: Column, entities: list[str]) -> dict[str, Column]:
    """Count and ratio to tokens of each listed entity type; all observed types as a map."""
    kinds = F.transform(mentions, lambda m: m["entity_type"])
    out = {}
    for kind in entities:
        count = F.coalesce(count_if(kinds, lambda k, kind=kind: k == kind), F.lit(EMPTY)).cast("long")
        out[feature_name("mentions-count", kind)] = count
        out[feature_name("mentions-ratio", kind)] = ratio(count, F.size(tokens))
    return out


def mention_count_map(mentions: Column) -> Column:
    """Lower-cased entity type -> count, for all types that occur."""
    return let(
        F.transform(mentions, lambda m: F.lower(m["entity_type"])),
        lambda kinds: F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, count_if(kinds, lambda x: x == k).cast("long")))),
    )


def mention_feature_metas(entities: list[str]) -> T.StructType:
    return T.StructType([f for k in entities for f in (numeric(feature_name("mentions-count", k), True), numeric(feature_name("mentions-ratio", k)))])


def tree_features(edges: Column) -> dict[str, Column]:
    """A hash of each sentence's dependencies, summed: an identity, stable between runs. Edges are written as lines, one for a
    sentence, in one pass."""

    def over(es: Column) -> Column:
        def of(e: Column, i: Column) -> Column:
            before = F.when(i == 0, "").when(at(es, i - 1)["sent_index"] == e["sent_index"], " ").otherwise("\n")
            return F.concat(before, F.concat_ws(":", e["token_index"].cast("string"), e["parent_token_index"].cast("string"), e["dep"], e["text"]))

        lines = F.filter(F.split(F.array_join(F.transform(es, of), ""), "\n"), lambda x: F.length(x) > 0)
        return F.aggregate(F.transform(lines, java_hash), F.lit(0).cast("long"), lambda a, x: a + x)

    return {"dep_tree_id": let(edges, over)}


def tree_feature_metas() -> T.StructType:
    return T.StructType([numeric("dep_tree_id", True)])


def token_features(text: Column, tokens: Column, sents: Column, mentions: Column) -> dict[str, Column]:
    """Lengths and counts of an utterance, and whether it ends with a question mark."""
    lengths = F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"]))
    return {
        "utterance_length": F.coalesce(F.length(text), F.lit(0)).cast("long"),
        "mention_count": F.size(mentions).cast("long"),
        "sent_count": F.size(sents).cast("long"),
        "token_count": F.size(tokens).cast("long"),
        "token_average_length": ratio(lengths, F.size(tokens)),
        "is_question": F.coalesce(last(tokens)["text"] == "?", F.lit(False)),
    }


def token_feature_metas() -> T.StructType:
    whole = [numeric(k, True) for k in ("utterance_length", "mention_count", "sent_count", "token_count")]
    return T.StructType([*whole, numeric("token_average_length"), T.StructField("is_question", T.BooleanType())])


def select_features(df: DataFrame, keys: list[str], features: dict[str, Column], metas: T.StructType | None = None) -> DataFrame:
    """``keys`` and the features, in the order of their schema if given."""
    order = metas.names if metas else list(features)
    return df.select(*keys, *[features[k].alias(k) for k in order])


def dictionary_ratio(tokens: DataFrame, words: DataFrame, keys: list[str], column: str = "word") -> DataFrame:
    """(keys, in_dict_count, token_count, in_dict_ratio) of exploded tokens: a left join with distinct words, then one
    grouping, which combines before its shuffle."""
    known = words.select(F.col(column).alias("d_word")).distinct().withColumn("d_known", F.lit(True))
    joined = tokens.join(known, F.lower(tokens["text"]) == known["d_word"], "left")
    counts = joined.groupBy(*keys).agg(F.count("d_known").alias("in_dict_count"), F.count("*").alias("token_count"))
    return counts.withColumn("in_dict_ratio", ratio(F.col("in_dict_count"), F.col("token_count")))
