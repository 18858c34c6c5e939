"""Semantic roles over dependency edges, and coreference chains over mentions and pronouns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.arrays import first, last, let
from lexigrove.functions.ranges import range_of
from lexigrove.operators import chains
from lexigrove.operators.syntax import FRAMES, VERBS

#: From a dependency relation to (label of the argument, its function).
ARGUMENTS = {
    "nsubj": ("A0", "PAG"),
    "dobj": ("A1", "PPT"),
    "acomp": ("A1", "PRD"),
    "nmod": ("AM-LOC", "LOC"),
    "advmod": ("AM-ADV", "MNR"),
    "neg": ("AM-NEG", None),
    "aux": ("AM-MOD", None),
}
#: Relations that role labels call otherwise.
RELATIONS = {"nmod": "pobj", "case": "prep", "cop": "aux", "conj": "conj"}
#: Sentences of so many tokens at most take the best tree that has a frame.
SHORT_SENTENCE = 3

SRL = "struct<id:int,propbank:string,head_id:int,dependency_label:string,heads:array<struct<function_tag:string,dependency_label:string>>>"


def role_nodes(tokens: Column, edges: Column) -> Column:
    """A node for each edge: id, frame of a predicate, head, relation and argument labels."""

    def over(ts: Column) -> Column:
        def node(e: Column, t: Column) -> Column:
            frame = F.lit(None).cast("string")
            for lemma, known in FRAMES.items():
                frame = F.when(t["lemma"] == lemma, known).otherwise(frame)
            frame = F.when(t["pos_tag"].isin(*VERBS), F.coalesce(frame, F.concat(t["lemma"], F.lit(".01"))))
            label, function, relation = F.lit(None).cast("string"), F.lit(None).cast("string"), e["dep"]
            for dep, (argument, tag) in ARGUMENTS.items():
                label = F.when(e["dep"] == dep, argument).otherwise(label)
                function = F.when(e["dep"] == dep, F.lit(tag).cast("string")).otherwise(function)
            for dep, other in RELATIONS.items():
                relation = F.when(e["dep"] == dep, other).otherwise(relation)
            head = F.struct(function.alias("function_tag"), label.alias("dependency_label"))
            return F.struct(
                e["token_index"].alias("id"),
                frame.alias("propbank"),
                e["parent_token_index"].alias("head_id"),
                relation.alias("dependency_label"),
                F.when(label.isNotNull(), F.array(head)).alias("heads"),
            ).cast(SRL)

        n = F.least(F.size(edges), F.size(ts))
        return F.zip_with(F.slice(edges, F.lit(1), n), F.slice(ts, F.lit(1), n), node)

    return let(tokens, over)


def zip_roles(tokens: Column, nodes: Column) -> Column:
    """Tokens with ``srl`` by position; as many as the shorter side has."""

    def over(ts: Column) -> Column:
        n = F.least(F.size(ts), F.size(nodes))
        return F.zip_with(F.slice(ts, F.lit(1), n), F.slice(nodes, F.lit(1), n), lambda t, s: t.withField("srl", s))

    return let(tokens, over)


def label_roles(df: DataFrame, lang: str = "en") -> DataFrame:
    """Tokens get ``srl``. Needs lemmas and ``dependency_edges``."""
    if (out := chains.extended(df, "srl")) is not None:
        return out
    noded = df.withColumn("r_nodes", role_nodes(F.col("tokens"), F.col("dependency_edges")))
    return noded.withColumn("tokens", zip_roles(F.col("tokens"), F.col("r_nodes"))).drop("r_nodes")


def trees_by_score(trees: Column) -> Column:
    """Trees, the highest score first, equal scores in their order."""
    return F.array_sort(trees, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))


def best_tree(trees: Column, n_tokens: Column, short: int = SHORT_SENTENCE) -> Column:
    """The tree with the highest score; in a short sentence the one with the highest that has a frame, if any has."""

    def over(ordered: Column) -> Column:
        framed = first(F.filter(ordered, lambda t: F.coalesce(t["has_propbank"], F.lit(False))))
        return F.when(n_tokens <= short, F.coalesce(framed, first(ordered))).otherwise(first(ordered))

    return let(trees_by_score(trees), over)


def join_heads(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Exploded role nodes with the frame of their head: an equi-join on sentence and node."""
    on = [*keys, "sent_index"]
    above = nodes.select(*on, F.col("id").alias("head_id"), F.col("propbank").alias("head_propbank"))
    return nodes.join(above, [*on, "head_id"], "left")


def role_heads(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, dependency_label, head_propbank) of each role node of annotated rows, without a join."""
    from lexigrove.operators.tokens import elements, exploded

    out = chains.extended(df, "heads")
    if out is None:
        return join_heads(exploded(df, *keys).select(*keys, "sent_index", "srl.*"), list(keys)).select(*keys, "dependency_label", "head_propbank")
    return elements(chains.only(out, "role_heads"), "role_heads", *keys).select(*keys, "x.*")


MALE, FEMALE, NEUTRAL, PLURAL = ("he", "him", "his", "himself"), ("she", "her", "hers", "herself"), ("it", "its", "itself"), ("they", "them", "their")
SPEAKER = ("i", "me", "my", "myself")
COREF = chains.COREF


def _candidates(mentions: Column, tokens: Column) -> Column:
    """Names and pronouns in textual order."""

    def light(x: Column, kind: str, entity: Column) -> Column:
        return F.struct(
            x["token_range"]["begin"].alias("begin"), x["token_range"]["end"].alias("end"), x["sent_index"].alias("sent_index"),
            F.lower(x["text"]).alias("word"), F.lit(kind).alias("kind"), entity.alias("entity"),
        )

    words = (*MALE, *FEMALE, *NEUTRAL, *PLURAL, *SPEAKER)
    names = F.filter(mentions, lambda m: m["entity_type"].isin("PERSON", "LOCATION", "ORGANIZATION"))
    pronouns = F.filter(tokens, lambda t: t["pos_tag"].isin("PRP", "PRP$") & F.lower(t["text"]).isin(*words))
    named = F.transform(names, lambda m: light(m, "PROPER", m["entity_type"]))
    return F.array_sort(F.concat(named, F.transform(pronouns, lambda t: light(t, "PRONOMINAL", F.lit("")))))


def _with_chain(found: Column) -> Column:
    """Candidates with the chain that they belong to: a name's own, the speaker's, or that of the nearest name that fits."""

    def over(cs: Column) -> Column:
        def of(m: Column, i: Column) -> Column:
            person = ~m["word"].isin(*NEUTRAL)
            before = F.filter(F.slice(cs, F.lit(1), i), lambda x: (x["kind"] == "PROPER") & ((x["entity"] == "PERSON") == person))
            chain = F.when(m["kind"] == "PROPER", m["word"]).when(m["word"].isin(*SPEAKER), " speaker").otherwise(last(before)["word"])
            return m.withField("chain", chain)

        return F.filter(F.transform(cs, of), lambda m: m["chain"].isNotNull())

    return let(found, over)


def _chain(members: Column, index: Column) -> Column:
    def over(words: Column) -> Column:
        has = lambda known: F.arrays_overlap(words, F.array(*[F.lit(w) for w in known]))
        gender = F.when(has(MALE), "MALE").when(has(FEMALE), "FEMALE").when(has(NEUTRAL), "NEUTRAL").otherwise("UNKNOWN")

        def mention(m: Column) -> Column:
            thing = (gender == "NEUTRAL") | m["entity"].isin("LOCATION", "ORGANIZATION")
            return F.struct(
                m["sent_index"].alias("sent_index"),
                range_of(m["begin"], m["end"]).alias("token_range"),
                (m["end"] - 1).alias("head_index"),
                gender.alias("gender"),
                F.when(thing, "INANIMATE").otherwise("ANIMATE").alias("animacy"),
                m["kind"].alias("type"),
                F.when(m["word"].isin(*PLURAL), "PLURAL").otherwise("SINGULAR").alias("number"),
            )

        return F.struct((index + 1).alias("id"), F.transform(members, mention).alias("mention")).cast(COREF)

    return let(F.transform(members, lambda m: m["word"]), over)


def resolve_coreference(df: DataFrame) -> DataFrame:
    """``df`` with ``coref``: chains of at least two mentions, by first mention; indexes count from 0.

    Equal names corefer; a pronoun takes the nearest name before it that fits; pronouns of the speaker are one chain. Needs
    ``mentions`` and part-of-speech tags. Outside a chain, built-in expressions over a row's names and pronouns.
    """
    if (out := chains.extended(df, "coref")) is not None:
        return out
    placed = df.withColumn("c_placed", _with_chain(_candidates(F.col("mentions"), F.col("tokens"))))

    def over(cs: Column) -> Column:
        names = F.array_distinct(F.transform(cs, lambda m: m["chain"]))
        groups = F.transform(names, lambda k: F.filter(cs, lambda m: m["chain"] == k))
        return F.transform(F.filter(groups, lambda g: F.size(g) > 1), _chain)

    return placed.withColumn("coref", let(F.col("c_placed"), over)).drop("c_placed")
