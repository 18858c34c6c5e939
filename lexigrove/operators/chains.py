"""Plans of annotators that run together: a DataFrame that an annotator returns knows its steps, and the next annotator adds its
own, so that all of them are one pass over the texts in Arrow batches (:mod:`lexigrove.operators.batches`).

Any other operation on such a DataFrame ends its chain; annotators after it are column expressions over its arrays, with the
same results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.ranges import RANGE

NATLOG = (
    f"struct<polarity:string,operator:struct<surface_form:string,subject_token_range:{RANGE},object_token_range:{RANGE},"
    f"quantifier_token_range:{RANGE},quantifier_token_head_index:int>>"
)
COREF = f"struct<id:int,mention:array<struct<sent_index:int,token_range:{RANGE},head_index:int,gender:string,animacy:string,type:string,number:string>>>"
#: What a step adds to each token.
FIELDS = {
    "tok": f"text:string,char_range:{RANGE},token_range:{RANGE}",
    "sen": f"sent_index:int,token_index:int,index_range:{RANGE}",
    "tag": "pos_tag:string",
    "lemma": "lemma:string",
    "stop": "stopword:boolean,stoplemma:boolean",
    "ner": "ner_tag:string,entity_type:string,normalized_tag:string",
    "blank": "ner_tag:string,normalized_tag:string",
    "srl": "srl:struct<id:int,propbank:string,head_id:int,dependency_label:string,heads:array<struct<function_tag:string,dependency_label:string>>>",
    "tre": "tok_re_ner_tag:string,tok_re_ner_item_id:int,tok_re_ner_features:map<string,string>",
    "natlog": f"natlog:{NATLOG}",
    "mood": "sentiment:int",
}
_MENTION = f"text:string,entity_type:string,ner_tag:string,normalized_tag:string,sent_index:int,token_range:{RANGE},char_range:{RANGE}"
#: The column that a step adds beside the tokens.
COLUMNS = {
    "sen": ("sents", f"struct<sent_index:int,token_range:{RANGE},char_range:{RANGE}>"),
    "ner": ("mentions", f"struct<{_MENTION}>"),
    "tre": ("tok_re_mentions", f"struct<{_MENTION},tok_re_ner_tag:string,tok_re_ner_item_id:int,tok_re_ner_features:map<string,string>>"),
    "stats": ("pos_stats", "struct<n:int,noun:int,verb:int,adjective:int,adverb:int,wh:int,first:string,last:string>"),
    "parents": ("edge_parents", "struct<dep:string,parent_text:string>"),
    "heads": ("role_heads", "struct<dependency_label:string,head_propbank:string>"),
    "pairs": ("overlap_pairs", "bigint"),
    "kept": ("t_kept", "struct<begin:int,less:int,rule:int,end:int,from:int,to:int>"),
    "dep": ("dependency_edges", "struct<sent_index:int,token_index:int,parent_token_index:int,child_ord:int,dep:string,text:string>"),
    "tree": ("parse_nodes", f"struct<sent_index:int,node_id:int,parent_id:int,child_ord:int,label:string,token_index:int,index_range:{RANGE},score:double>"),
    "coref": ("coref", COREF),
}
#: Steps that have to come before.
NEEDS = {"tok": (), "sen": ("tok",), "tag": ("sen",), "lemma": ("tag",), "stop": ("lemma",), "ner": ("tag",), "blank": ("sen",), "tre": ("sen",), "pairs": ("ner", "tre"), "kept": ("sen",), "dep": ("tag",), "tree": ("tag",), "srl": ("lemma", "dep"), "stats": ("tag",), "parents": ("dep",), "heads": ("srl",), "natlog": ("tag",), "mood": ("sen",), "coref": ("ner",), "record": ("sen",)}


#: Steps whose needs are all in :data:`NEEDS` and their patterns, so that chains of them run without what nobody asks for.
_PLAIN = {"tok", "sen", "tag", "lemma", "stop", "ner", "blank", "tre", "pairs", "kept", "stats"}


@dataclass(frozen=True)
class Chain:
    """A table without annotations, its text column and steps (name, options); ``columns`` and ``fields`` (of tokens) that are given, None: all."""

    base: DataFrame
    text_col: str
    steps: tuple[tuple, ...]
    columns: tuple[str, ...] | None = None
    fields: tuple[str, ...] | None = None

    @property
    def names(self) -> list[str]:
        return [s[0] for s in self.steps]

    def schema(self) -> dict[str, str]:
        """The types of the columns by name."""
        given = [x for n in self.names if n in FIELDS for x in _parts(FIELDS[n]) if self.fields is None or x.split(":")[0] in self.fields]
        out = {"tokens": f"array<struct<{','.join(given)}>>"}
        out |= {COLUMNS[n][0]: f"array<{COLUMNS[n][1]}>" for n in self.names if n in COLUMNS}
        if "mood" in self.names:
            out["sents"] = out["sents"][:-2] + ",sentiment:int>>"
            out["sentiment"] = "int"
        for name, *options in self.steps:
            if name == "record":
                out["record_sents"] = options[0].simpleString()
        return {k: v for k, v in out.items() if self.columns is None or k in self.columns}

    def needed(self) -> tuple[tuple, ...]:
        """The steps without those that neither a given column or field nor another needed step comes from."""
        if not set(self.names) <= _PLAIN:
            return self.steps
        kinds, needed = self.schema(), {"tok"}
        for name, *options in reversed(self.steps):
            fields = [x.split(":")[0] for x in _parts(FIELDS[name])] if name in FIELDS and "tokens" in kinds else []
            if name in needed or any(self.fields is None or x in self.fields for x in fields) or name in COLUMNS and COLUMNS[name][0] in kinds:
                needed |= {name, *NEEDS[name]}
                if name == "tre":
                    needed |= {"ner", "blank"}  # mentions carry an entity tag, of either
                if name in ("tre", "kept"):
                    from lexigrove.operators.batch_rules import tests_of

                    attributes = {t.attribute for rule in options[0] for t in tests_of(rule)}
                    needed |= (attributes & {"tag", "lemma"}) | ({"ner", "blank"} if "ner" in attributes else set())
        return tuple(s for s in self.steps if s[0] in needed)


def _parts(text: str) -> list[str]:
    out, deep = [""], 0
    for c in text:
        deep += (c == "<") - (c == ">")
        if c == "," and not deep:
            out.append("")
        else:
            out[-1] += c
    return out


def _planned(chain: Chain) -> DataFrame:
    kinds = chain.schema()
    run = annotator(chain.needed(), kinds, chain.fields)
    out = chain.base.withColumn("lexigrove_all_", run(F.col(chain.text_col).cast("string")))
    out = out.withColumns({k: F.col("lexigrove_all_")[k] for k in kinds}).drop("lexigrove_all_")
    out.__dict__["lexigrove_chain"] = chain
    return out


def annotator(steps: tuple[tuple, ...], kinds: dict[str, str], fields: tuple[str, ...] | None):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(f"struct<{','.join(f'`{k}`:{v}' for k, v in kinds.items())}>")

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from lexigrove.operators import batches as b

        kind = to_arrow_type(schema)
        for texts in batches:
            for part in b.slices(texts):
                made = annotated(part, steps, kinds, fields)
                yield made if made.type == kind else made.cast(kind)

    return run.asNondeterministic()  # else filters on what it gives are pushed below it, and it runs once more for them


def annotated(texts: list[str], steps: tuple[tuple, ...], kinds: dict[str, str], fields: tuple[str, ...] | None = None) -> pa.StructArray:
    """The annotations of some texts."""
    from lexigrove.operators import batch_meaning, batch_rules, batch_trees
    from lexigrove.operators import batches as b

    out = b.Slice(texts, steps[0][1])
    out.tokenized()
    for name, *options in steps[1:]:
        match name:
            case "sen":
                out.sentences()
            case "tag":
                out.tags(*options)
            case "lemma":
                out.lemmas()
            case "stop":
                out.stop_words(*options)
            case "ner":
                out.entities(*options)
            case "blank":
                out.no_entities()
            case "tre":
                batch_rules.match_patterns(out, *options)
            case "pairs":
                out.overlaps()
            case "kept":
                batch_rules.keep(out, *options)
            case "dep":
                batch_trees.dependencies(out, *options)
            case "tree":
                batch_trees.trees(out, *options)
            case "srl":
                batch_trees.roles(out)
            case "stats":
                out.statistics()
            case "parents":
                batch_trees.parents(out)
            case "heads":
                batch_trees.frames_of_heads(out)
            case "natlog":
                batch_meaning.natural_logic(out)
            case "mood":
                batch_meaning.score_sentiment(out, *options)
            case "coref":
                batch_meaning.resolve_coreference(out)
            case "record":
                batch_meaning.nested_sentences(out, *options)
    return b.struct({k: out.column(fields) if k == "tokens" else out.lists[k] for k in kinds})


def begun(df: DataFrame, text_col: str, only_whitespace: bool) -> DataFrame:
    return _planned(Chain(df, text_col, (("tok", only_whitespace),)))


def extended(df: DataFrame, name: str, *options, text_col: str | None = None) -> DataFrame | None:
    """``df`` with one more step, or None if it is no chain that the step can follow."""
    chain = df.__dict__.get("lexigrove_chain")
    if chain is None or name in chain.names or not set(NEEDS[name]) <= set(chain.names) or chain.columns or chain.fields:
        return None
    if text_col is not None and text_col != chain.text_col:
        return None
    return _planned(replace(chain, steps=(*chain.steps, (name, *options))))


def steps(df: DataFrame) -> list[str]:
    """The steps of a chain, none for any other table."""
    chain = df.__dict__.get("lexigrove_chain")
    return [] if chain is None else chain.names


def only(df: DataFrame, *columns: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """A chain's table with some of its columns and fields of tokens, so that no others travel; any other table as it is."""
    chain = df.__dict__.get("lexigrove_chain")
    return df if chain is None else _planned(replace(chain, columns=columns, fields=fields))
