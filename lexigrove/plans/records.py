"""The nested annotation record of a row, assembled from the columns of a pipeline. Columns that are not there are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from lexigrove.functions.arrays import drop_take, if_some, let
from lexigrove.functions.ranges import RANGE
from lexigrove.operators import chains
from lexigrove.operators.chains import NATLOG
from lexigrove.operators.roles import COREF, SRL

FEATURES = "map<string,string>"
MENTION = f"text:string,entity_type:string,ner_tag:string,normalized_tag:string,sent_index:int,token_range:{RANGE},char_range:{RANGE}"
PATTERN_MENTION = f"{MENTION},tok_re_ner_tag:string,tok_re_ner_item_id:int,tok_re_ner_features:{FEATURES}"
TOKEN_FIELDS = {
    "text": "string",
    "pos_tag": "string",
    "lemma": "string",
    "entity_type": "string",
    "ner_tag": "string",
    "normalized_tag": "string",
    "sent_index": "int",
    "token_index": "int",
    "token_range": RANGE,
    "char_range": RANGE,
    "index_range": RANGE,
    "stopword": "boolean",
    "stoplemma": "boolean",
    "sentiment": "int",
    "tok_re_ner_tag": "string",
    "tok_re_ner_item_id": "int",
    "tok_re_ner_features": FEATURES,
    "natlog": NATLOG,
    "srl": SRL,
}
NODE = f"struct<node_id:int,parent_id:int,child_ord:int,label:string,token_index:int,index_range:{RANGE},sentiment:int,score:double>"
EDGE = "struct<token_index:int,parent_token_index:int,child_ord:int,dep:string,text:string>"

SENTENCE = (
    f"struct<text:string,sent_index:int,sentiment:int,parse_tree:array<{NODE}>,dependency_parse_tree:array<{EDGE}>,"
    f"tokens:array<struct<{','.join(f'{k}:{v}' for k, v in TOKEN_FIELDS.items())}>>>"
)


def to_record(df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """(keys, panon): one nested record per row; empty lists become null."""
    columns, have = set(df.columns), {}
    chained = chains.extended(df, "record", _parse_datatype_string(f"array<{SENTENCE}>"), text_col=text_col)
    if chained is not None:
        used = ("mentions", "tok_re_mentions", "coref", "sentiment")
        df = chains.only(chained, "record_sents", *[k for k in used if k in columns])
    elif "tokens" in columns:
        have = {f.name for f in df.schema["tokens"].dataType.elementType.fields}
    null = lambda kind: F.lit(None).cast(kind)
    column = lambda name, kind: if_some(F.col(name)).cast(kind) if name in columns else null(kind)

    def token(t: Column) -> Column:
        return F.struct(*[(t[k].cast(kind) if k in have else null(kind)).alias(k) for k, kind in TOKEN_FIELDS.items()])

    def own(name: str, sentence: Column, fields: tuple[str, ...], kind: str) -> Column:
        if name not in columns:
            return null(f"array<{kind}>")
        inside = F.filter(F.col(name), lambda x: x["sent_index"] == sentence["sent_index"])
        element = df.schema[name].dataType.elementType.names
        made = F.transform(inside, lambda x: F.struct(*[(x[k] if k in element else F.lit(None)).alias(k) for k in fields]))
        return if_some(made).cast(f"array<{kind}>")

    def sentences(ts: Column) -> Column:
        def one(s: Column) -> Column:
            chars, span = s["char_range"], s["token_range"]
            return F.struct(
                F.substring(F.col(text_col), chars["begin"] + 1, chars["end"] - chars["begin"]).alias("text"),
                s["sent_index"].alias("sent_index"),
                (s["sentiment"].cast("int") if "sentiment" in df.schema["sents"].dataType.elementType.names else null("int")).alias("sentiment"),
                own("parse_nodes", s, ("node_id", "parent_id", "child_ord", "label", "token_index", "index_range", "sentiment", "score"), NODE).alias("parse_tree"),
                own("dependency_edges", s, ("token_index", "parent_token_index", "child_ord", "dep", "text"), EDGE).alias("dependency_parse_tree"),
                drop_take(ts, span["begin"], span["end"]).alias("tokens"),
            )

        return if_some(F.transform(F.col("sents"), one))

    if chained is not None:
        sents = F.col("record_sents")
    elif "tokens" not in columns:
        sents = F.lit(None)
    elif "sents" in columns:
        sents = let(F.transform("tokens", token), sentences)
    else:  # tokens without sentences stand in one
        sents = F.array(F.struct(F.col(text_col).alias("text"), F.lit(0).alias("sent_index"), F.transform("tokens", token).alias("tokens")))
    record = F.struct(
        F.col(text_col).alias("text"),
        (F.col("sentiment").cast("int") if "sentiment" in columns else null("int")).alias("sentiment"),
        column("mentions", f"array<struct<{MENTION}>>").alias("mentions"),
        column("tok_re_mentions", f"array<struct<{PATTERN_MENTION}>>").alias("tok_re_mentions"),
        column("coref", f"array<{COREF}>").alias("coref"),
        sents.alias("sents"),
    )
    return df.select(*keys, record.alias("panon"))
