"""Part-of-speech tags, lemmas and stop words by lexicon, suffix and context rules.

A first pass tags a token by its own form; a second pass corrects tags by their neighbours in the sentence (after Brill).
Rules are data, from which :mod:`lexigrove.plans.oracles` writes the same rules in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove import defaults
from lexigrove.functions.arrays import at, let
from lexigrove.operators import chains

#: (tag, tokens): by exact form.
SIGNS = [
    (".", [".", "!", "?"]),
    (",", [","]),
    (":", [":", ";", "...", "--", "---", "-", "–", "—", "…"]),
    ("-LRB-", ["(", "[", "{"]),
    ("-RRB-", [")", "]", "}"]),
    ("''", ['"', "'", "“", "”", "‘", "’", "«", "»"]),
    ("$", ["$", "€", "£"]),
    ("#", ["#"]),
]
#: (tag, words in lower case).
LEXICON = [
    ("DT", "a an the this that these those every each some any no another either neither all both".split()),
    ("CD", "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred million billion".split()),
    ("PRP", "i you he she it we they me him us them myself yourself himself herself itself ourselves themselves".split()),
    ("PRP$", "my your his her its our their".split()),
    ("MD", "will would can could may might shall should must ca wo 'll ’ll 'd ’d".split()),
    ("TO", ["to"]),
    ("CC", "and or but nor &".split()),
    ("EX", ["there"]),
    ("WDT", ["which"]),
    ("WP", "who whom what".split()),
    ("WP$", ["whose"]),
    ("WRB", "when where why how whenever wherever".split()),
    ("VBZ", "is has does says goes makes takes gets".split()),
    ("VBP", "am are 'm ’m 're ’re 've ’ve".split()),
    ("VBD", "was were had did said went got made took came saw thought knew found told felt left kept".split()),
    ("VBN", "been done gone seen known given taken".split()),
    ("VBG", ["being"]),
    (
        "IN",
        "of in on at by for with from as if into over under after before about against between through during without within"
        " upon because while though although since until than like among toward towards per unless whether off above below".split(),
    ),
    ("RP", "up out down away".split()),
    (
        "RB",
        "not n't n’t never very too so also just only now then here there almost always often again ever yet still quite rather"
        " perhaps soon long ago well nearly once first better least even already else instead together".split(),
    ),
    (
        "JJ",
        "good bad great small large big little new old young high low long quick brown lazy red green blue black white hot cold"
        " particular own other same such many much more most few several certain damp drizzly grim extreme common free full".split(),
    ),
]
#: Base forms of verbs; other forms follow from them.
VERBS = (
    "be have do say go get make know think take see come want look use find give tell work call try ask need feel become leave put"
    " mean keep let begin seem help show hear play run move live believe bring happen write sit stand lose pay meet include continue"
    " set learn lead understand watch follow stop create speak read spend grow open walk win teach offer remember consider appear buy"
    " serve die send build stay fall cut reach kill raise pass sell decide return explain hope develop carry break receive agree"
    " support hit produce eat cover catch draw choose enjoy love hate jump sail throw knock require prevent account involve find"
    " chase clean drive"
).split()
LEXICON.append(("VB", VERBS))
#: (tag, suffix pattern) of words in lower case.
SUFFIXES = [
    ("VBZ", r"^(?:%s)e?s$" % "|".join(v for v in VERBS if len(v) > 2)),
    ("RB", r"\p{L}{2}ly$"),
    ("NN", r"^(?:no|any|every|some)thing$|^(?:morning|evening|spleen|thing|king|ring|string|spring|wing|bed|seed|need|speed|hundred)$"),
    ("VBG", r"\p{L}{2}ing$"),
    ("VBD", r"\p{L}{2}ed$"),
    ("JJ", r"\p{L}{2}(?:ous|ful|ive|able|ible|ical|less|ish|icant|ent)$"),
    ("NN", r"(?:ss|us|is)$"),
    ("NNS", r"\p{L}{2}s$"),
]
#: Irregular forms by lemma.
IRREGULAR = {
    "be": "am is are was were been being 'm ’m 're ’re",
    "have": "has had having 've ’ve",
    "do": "does did done",
    "go": "goes went gone",
    "get": "got gotten getting",
    "make": "made making",
    "take": "took taken taking",
    "come": "came coming",
    "see": "saw seen",
    "say": "said",
    "think": "thought",
    "know": "knew known",
    "find": "found",
    "tell": "told",
    "feel": "felt",
    "leave": "left leaving",
    "keep": "kept",
    "give": "gave given giving",
    "man": "men",
    "woman": "women",
    "child": "children",
    "foot": "feet",
    "tooth": "teeth",
    "mouse": "mice",
    "not": "n't n’t",
    "will": "'ll ’ll wo",
    "can": "ca",
}
IRREGULAR = {k: v.split() for k, v in IRREGULAR.items()}
#: (tags, pattern, replacement with group 1 as {1}), the first that matches.
STEMS = [
    (("NNS",), r"^(\p{L}+)ies$", "{1}y"),
    (("NNS",), r"^(\p{L}+(?:ss|sh|ch|x|zz))es$", "{1}"),
    (("NNS",), r"^(\p{L}*)men$", "{1}man"),
    (("NNS",), r"^(.+[^su])s$", "{1}"),
    (("VBZ",), r"^(\p{L}+)ies$", "{1}y"),
    (("VBZ",), r"^(\p{L}+(?:ss|sh|ch|x|zz|o))es$", "{1}"),
    (("VBZ",), r"^(.+[^s])s$", "{1}"),
    (("VBD", "VBN"), r"^(\p{L}+)ied$", "{1}y"),
    (("VBD", "VBN"), r"^(\p{L}+(?:at|iz|is|ur|iv|uc|ov|as|us|ag|rg|nc|bl|tl|dl|gl|pl|eas|os))ed$", "{1}e"),
    (("VBD", "VBN"), r"^(\p{L}+)ed$", "{1}"),
    (("VBG",), r"^(\p{L}+(?:at|iz|is|ur|iv|uc|ov|as|us|ag|rg|nc|bl|tl|dl|gl|pl|eas|os))ing$", "{1}e"),
    (("VBG",), r"^(\p{L}+)ing$", "{1}"),
]
#: A doubled last consonant of a stem.
DOUBLED = r"^(\p{L}*?)(?:bb|dd|gg|mm|nn|pp|rr|tt)$"
PRONOUN_LIKE = ("it", "that", "he", "she", "there", "what", "who", "here", "let", "this")
SINGULAR = ("this", "that", "it", "he", "she", "who", "which")
AUXILIARY = ("have", "has", "had", "'ve", "’ve", "am", "is", "are", "was", "were", "be", "been", "being", "'m", "’m", "'re", "’re")


def base_tag(text: Column, first: Column) -> Column:
    """The tag of a token by its form; ``first``: whether it begins a sentence."""

    def of(lower: Column) -> Column:
        known = reduce(lambda a, x: a | lower.isin(*x[1]), LEXICON, F.lit(False))
        out = F.when(~text.rlike(r"\p{L}"), F.when(text.rlike(r"^\p{N}"), "CD").otherwise("SYM"))
        out = out.when(lower.isin("'s", "’s"), "POS")
        out = out.when(text.rlike(r"^\p{Lu}") & ~first & (lower != "i") & ~known, F.when(text.rlike(r"[^s]s$"), "NNPS").otherwise("NNP"))
        for tag, words in LEXICON:
            out = out.when(lower.isin(*words), tag)
        for tag, pattern in SUFFIXES:
            out = out.when(lower.rlike(pattern), tag)
        out = out.otherwise("NN")
        for tag, signs in reversed(SIGNS):
            out = F.when(text.isin(*signs), tag).otherwise(out)
        return out

    return let(F.lower(text), of)


def contextual_tag(tag: Column, before: Column, word: Column, word_before: Column) -> Column:
    """A corrected tag. ``before``: the tag by form of the token before in the sentence; words are in lower case."""
    noun_follows = before.isin("DT", "PRP$", "JJ", "POS", "CD")
    base = (
        F.when(before.isNull() | before.isin("TO", "MD", "CC", "RB", ",", ":"), "VB")
        .when(word_before.isin("do", "does", "did"), "VB")
        .when(noun_follows, "NN")
        .otherwise("VBP")
    )
    return (
        F.when(tag == "VB", base)
        .when((word == "like") & (before == "PRP"), "VBP")
        .when((word == "like") & before.isin("MD", "TO"), "VB")
        .when((tag == "NN") & (before == "MD"), "VB")
        .when((tag == "NNS") & word_before.isin(*SINGULAR), "VBZ")
        .when((tag == "VBZ") & noun_follows & ~word_before.isin(*SINGULAR) & word.rlike("s$") & ~word.isin("is", "has", "does", "was"), "NNS")
        .when((tag == "VBD") & word_before.isin(*AUXILIARY), "VBN")
        .when((tag == "POS") & (word_before.isin(*PRONOUN_LIKE) | before.isin("PRP", "WP", "EX")), "VBZ")
        .otherwise(tag)
    )


def tag_parts_of_speech(df: DataFrame, lexicon: dict[str, str] | None = None) -> DataFrame:
    """Tokens get ``pos_tag``. Runs after sentence splitting. Words of a lexicon of one's own have its tag, before corrections
    by context."""
    if (out := chains.extended(df, "tag", lexicon)) is not None:
        return out
    own = label_in(lexicon)
    tagged = F.transform("tokens", lambda t: t.withField("pos_tag", F.coalesce(own(t["text"]), base_tag(t["text"], t["token_index"] == 1))))

    def corrected(ts: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before = F.when(t["token_index"] > 1, at(ts, i - 1))
            word, word_before = F.lower(t["text"]), F.coalesce(F.lower(before["text"]), F.lit(""))
            return t.withField("pos_tag", contextual_tag(t["pos_tag"], before["pos_tag"], word, word_before))

        return F.transform(ts, one)

    return df.withColumn("tokens", let(tagged, corrected))


def label_in(lexicon: dict[str, str] | None):
    """The label of a word in a lexicon, or null."""
    if not lexicon:
        return lambda text: F.lit(None).cast("string")
    known = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])
    return lambda text: F.try_element_at(known, F.lower(text))


def lemma_of(text: Column, tag: Column) -> Column:
    """The lemma of a token with its tag: proper nouns keep their form, others are in lower case."""

    def of(lower: Column) -> Column:
        out = F.when(tag.isin("NNP", "NNPS"), text)
        for lemma, forms in IRREGULAR.items():
            out = out.when(lower.isin(*forms), lemma)
        out = out.when(~tag.isin(*{t for tags, _, _ in STEMS for t in tags}), lower)
        for tags, pattern, to in STEMS:
            stem = F.regexp_replace(lower, pattern, to.replace("{1}", "$1"))
            if to == "{1}" and pattern.endswith(("ed$", "ing$")):
                stem = F.when(stem.rlike(DOUBLED), F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem)
            out = out.when(tag.isin(*tags) & lower.rlike(pattern), stem)
        return out.otherwise(lower)

    return let(F.lower(text), of)


def add_lemmas(df: DataFrame) -> DataFrame:
    if (out := chains.extended(df, "lemma")) is not None:
        return out
    return df.withColumn("tokens", F.transform("tokens", lambda t: t.withField("lemma", lemma_of(t["text"], t["pos_tag"]))))


def flag_stop_words(df: DataFrame, lang: str = "en", words: list[str] | None = None) -> DataFrame:
    """Tokens get ``stopword`` (by form) and ``stoplemma`` (by lemma)."""
    listed = words if words is not None else defaults.STOP_WORDS.get(lang, [])
    if (out := chains.extended(df, "stop", frozenset(listed))) is not None:
        return out
    is_stop = lambda c: F.lower(c).isin(*listed) if listed else F.lit(False)
    flags = lambda t: t.withField("stopword", is_stop(t["text"])).withField("stoplemma", is_stop(t["lemma"]))
    return df.withColumn("tokens", F.transform("tokens", flags))
