"""The annotators' rules in DuckDB SQL, over a row for each token: windows where the engine has array expressions.

:func:`chain` gives the common table expressions up to a step; queries add their own SELECT. Word lists and patterns come
from the operators, the logic is written here again.
"""

from __future__ import annotations

from lexigrove import defaults
from lexigrove.functions.tags import GO_TAGS, TAG_DESCRIPTIONS, TAG_TYPES
from lexigrove.operators import entities as en
from lexigrove.operators import morphology as mo
from lexigrove.operators import sentiment as se
from lexigrove.operators import syntax as sy


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


TOKEN, CLITIC = quoted(defaults.TOKEN), quoted(defaults.CLITIC)

#: Tables as (doc_id, text, and what queries need beside).
SOURCES = {
    "documents": "SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents",
    "conversations": "SELECT conv_id::HUGEINT * 4294967296 + turn AS doc_id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations",
    "pages": "SELECT page_id AS doc_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^<>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM pages",
}


def _tokens(pattern: str, clitics: bool) -> list[str]:
    cut = f"CASE WHEN regexp_matches(word, {CLITIC}) THEN length(regexp_extract(word, {CLITIC}, 1)) END" if clitics else "NULL::BIGINT"
    return [
        f"words AS (SELECT doc_id, regexp_extract_all(text, {pattern}) AS w, regexp_split_to_array(text, {pattern}) AS g FROM src)",
        "pieces AS (SELECT doc_id, unnest(w) AS word, unnest(g[:len(w)]) AS gap, generate_subscripts(w, 1) AS pos FROM words WHERE len(w) > 0)",
        "ends AS (SELECT doc_id, pos, word, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM pieces)",
        f"cuts AS (SELECT *, {cut} AS h FROM ends)",
        """split AS (
          SELECT doc_id, pos, 0 AS k, CASE WHEN h IS NULL THEN word ELSE substr(word, 1, h) END AS text, e - length(word) AS b,
            CASE WHEN h IS NULL THEN e ELSE e - length(word) + h END AS e FROM cuts
          UNION ALL SELECT doc_id, pos, 1, substr(word, h + 1), e - length(word) + h, e FROM cuts WHERE h IS NOT NULL)""",
        "tok AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1)::INT AS i, text, b::INT AS b, e::INT AS e FROM split)",
    ]


_SENTENCES = [
    f"""classes AS (SELECT *, CASE WHEN text IN {listed(defaults.SENTENCE_ENDS)}
            AND NOT (text = '.' AND coalesce(lower(lag(text) OVER d) IN {listed(defaults.ABBREVIATIONS)}, false)) THEN 'E'
          WHEN text IN {listed(defaults.SENTENCE_CLOSERS)} THEN 'C' ELSE 'x' END AS c
        FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY i))""",
    """borders AS (SELECT *, (c = 'x' AND coalesce(max(CASE WHEN c = 'E' THEN i END) OVER p, -1)
            > coalesce(max(CASE WHEN c = 'x' THEN i END) OVER p, -1))::INT AS starts
        FROM classes WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "numbered AS (SELECT *, (sum(starts) OVER (PARTITION BY doc_id ORDER BY i))::INT AS s FROM borders)",
    "sen AS (SELECT doc_id, i, text, lower(text) AS l, b, e, s, (row_number() OVER (PARTITION BY doc_id, s ORDER BY i))::INT AS k FROM numbered)",
]


def _base_tag() -> str:
    known = listed([w for _, words in mo.LEXICON for w in words])
    out = [f"WHEN text IN {listed(signs)} THEN {quoted(tag)}" for tag, signs in mo.SIGNS]
    out.append(r"WHEN NOT regexp_matches(text, '\p{L}') THEN CASE WHEN regexp_matches(text, '^\p{N}') THEN 'CD' ELSE 'SYM' END")
    out.append("WHEN l IN ('''s', '’s') THEN 'POS'")
    out.append(rf"WHEN regexp_matches(text, '^\p{{Lu}}') AND k > 1 AND l <> 'i' AND l NOT IN {known} THEN CASE WHEN regexp_matches(text, '[^s]s$') THEN 'NNPS' ELSE 'NNP' END")
    out += [f"WHEN l IN {listed(words)} THEN {quoted(tag)}" for tag, words in mo.LEXICON]
    out += [f"WHEN regexp_matches(l, {quoted(pattern)}) THEN {quoted(tag)}" for tag, pattern in mo.SUFFIXES]
    return "CASE " + " ".join(out) + " ELSE 'NN' END"


_TAGS = [
    f"base AS (SELECT *, {_base_tag()} AS t0 FROM sen)",
    "near AS (SELECT *, lag(t0) OVER w AS t1, coalesce(lag(l) OVER w, '') AS l1 FROM base WINDOW w AS (PARTITION BY doc_id, s ORDER BY i))",
    f"""tagged AS (SELECT doc_id, i, text, l, b, e, s, k, CASE
          WHEN t0 = 'VB' THEN CASE WHEN t1 IS NULL OR t1 IN ('TO', 'MD', 'CC', 'RB', ',', ':') THEN 'VB' WHEN l1 IN ('do', 'does', 'did') THEN 'VB'
            WHEN t1 IN ('DT', 'PRP$', 'JJ', 'POS', 'CD') THEN 'NN' ELSE 'VBP' END
          WHEN l = 'like' AND t1 = 'PRP' THEN 'VBP'
          WHEN l = 'like' AND t1 IN ('MD', 'TO') THEN 'VB'
          WHEN t0 = 'NN' AND t1 = 'MD' THEN 'VB'
          WHEN t0 = 'NNS' AND l1 IN {listed(mo.SINGULAR)} THEN 'VBZ'
          WHEN t0 = 'VBZ' AND t1 IN ('DT', 'PRP$', 'JJ', 'POS', 'CD') AND l1 NOT IN {listed(mo.SINGULAR)} AND l LIKE '%s' AND l NOT IN ('is', 'has', 'does', 'was') THEN 'NNS'
          WHEN t0 = 'VBD' AND l1 IN {listed(mo.AUXILIARY)} THEN 'VBN'
          WHEN t0 = 'POS' AND (l1 IN {listed(mo.PRONOUN_LIKE)} OR t1 IN ('PRP', 'WP', 'EX')) THEN 'VBZ'
          ELSE t0 END AS tag FROM near)""",
]


def _lemma() -> str:
    out = ["WHEN tag IN ('NNP', 'NNPS') THEN text"]
    out += [f"WHEN l IN {listed(forms)} THEN {quoted(lemma)}" for lemma, forms in mo.IRREGULAR.items()]
    for tags, pattern, to in mo.STEMS:
        stem = f"regexp_replace(l, {quoted(pattern)}, {quoted(to.replace('{1}', chr(92) + '1'))})"
        if to == "{1}" and pattern.endswith(("ed$", "ing$")):
            stem = f"CASE WHEN regexp_matches({stem}, {quoted(mo.DOUBLED)}) THEN substr({stem}, 1, length({stem}) - 1) ELSE {stem} END"
        out.append(f"WHEN tag IN {listed(tags)} AND regexp_matches(l, {quoted(pattern)}) THEN {stem}")
    return "CASE " + " ".join(out) + " ELSE l END"


_STOPS = listed(defaults.STOP_WORDS["en"])
_LEMMAS = [
    f"lemmas AS (SELECT *, {_lemma()} AS lemma FROM tagged)",
    f"""ann AS (SELECT *, l IN {_STOPS} AS stopword, lower(lemma) IN {_STOPS} AS stoplemma,
          (l NOT IN {_STOPS} AND tag IN {listed(GO_TAGS)}) AS go FROM lemmas)""",
]

_NER = [
    "sides AS (SELECT *, coalesce(lag(l) OVER w, '') AS l1, coalesce(lead(l) OVER w, '') AS r1 FROM tagged WINDOW w AS (PARTITION BY doc_id, s ORDER BY i))",
    rf"""ner AS (SELECT *, CASE
          WHEN num AND (l1 IN ('$', '€', '£') OR r1 IN {listed(en.CURRENCIES)}) THEN 'MONEY'
          WHEN num AND r1 IN ('%', 'percent') THEN 'PERCENT'
          WHEN num AND (regexp_matches(text, {quoted(en.YEAR)}) OR l1 IN {listed(en.MONTHS)} OR r1 IN {listed(en.MONTHS)}) THEN 'DATE'
          WHEN num OR tag = 'CD' THEN 'NUMBER'
          WHEN text IN ('$', '€', '£') AND regexp_matches(r1, '^\p{{N}}') THEN 'MONEY'
          WHEN l IN {listed(en.CURRENCIES)} AND regexp_matches(l1, '^\p{{N}}') THEN 'MONEY'
          WHEN l IN ('%', 'percent') AND regexp_matches(l1, '^\p{{N}}') THEN 'PERCENT'
          WHEN l IN {listed(en.DAYS)} AND proper THEN 'DATE'
          WHEN l IN {listed(en.MONTHS)} AND l <> 'may' AND proper THEN 'DATE'
          WHEN l IN {listed(en.PLACES)} AND proper THEN 'LOCATION'
          WHEN proper AND (l IN {listed(en.COMPANY_ENDS)} OR r1 IN {listed(en.COMPANY_ENDS)}) THEN 'ORGANIZATION'
          WHEN l IN {listed(en.FIRST_NAMES)} AND upper1 THEN 'PERSON'
          WHEN tag IN ('NNP', 'NNPS') AND (l1 IN {listed(en.FIRST_NAMES)} OR l1 IN {listed(en.TITLES)}) THEN 'PERSON'
          ELSE 'O' END AS ner
        FROM (SELECT *, regexp_matches(text, '^\p{{N}}') AS num, regexp_matches(text, '^\p{{Lu}}') AS upper1,
          (tag IN ('NNP', 'NNPS') OR regexp_matches(text, '^\p{{Lu}}')) AS proper FROM sides))""",
    """runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, s, ner ORDER BY i) AS island FROM ner)""",
    """men AS (SELECT r.doc_id, r.entity_type, r.s, r.tb, r.te, r.b, r.e, substr(src.text, r.b + 1, r.e - r.b) AS text FROM (
          SELECT doc_id, ner AS entity_type, s, min(i)::INT AS tb, (max(i) + 1)::INT AS te, min(b)::INT AS b, max(e)::INT AS e
          FROM runs WHERE ner <> 'O' GROUP BY doc_id, s, ner, island) r JOIN src USING (doc_id))""",
]

_SCORES = " ".join(f"WHEN l IN {listed(words)} THEN {score}" for score, words in se.WORDS.items())
_SENTIMENT = [
    f"""moods AS (SELECT *, (CASE {_SCORES} ELSE 0 END * CASE WHEN coalesce(lag(l) OVER w IN {listed(se.NEGATORS)}, false)
          OR coalesce(lag(l, 2) OVER w IN {listed(se.NEGATORS)}, false) THEN -1 ELSE 1 END)::INT AS mood
        FROM tagged WINDOW w AS (PARTITION BY doc_id, s ORDER BY i))""",
    "sen_mood AS (SELECT doc_id, s, greatest(-2, least(2, sum(mood)))::INT AS mood FROM moods GROUP BY doc_id, s)",
]

_NOUN_TAIL = "('NN', 'NNS', 'NNP', 'NNPS')"
_RELATIONS = " ".join(f"WHEN {quoted(tag)} THEN {quoted(dep)}" for tag, dep in sy.PREMODIFIERS.items())
_BEFORE, _AFTER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
#: Dependencies: noun phrases by their ends, the root and its copula by sentence, and the preposition that waits for its object
#: as the last event before a noun. ``k`` counts a sentence's tokens from 1.
_DEPENDENCIES = [
    f"""d1 AS (SELECT *, tag IN {listed(sy.NOUNS)} AS noun, tag IN {listed(sy.VERBS)} AS verb, tag IN {listed(sy.PREMODIFIERS)} AS pre, lead(tag) OVER w AS tag1,
          tag IN {listed(sy.NOUNS)} AND (tag IN ('PRP', 'EX', 'WP') OR NOT coalesce(lead(tag) OVER w IN {_NOUN_TAIL}, false)) AS ends
        FROM tagged WINDOW w AS (PARTITION BY doc_id, s ORDER BY k))""",
    """d2 AS (SELECT * EXCLUDE (next_end, next_other), CASE WHEN noun OR (pre AND next_other % 2 = 1) THEN next_end ELSE 0 END AS noun_end FROM (
        SELECT *, min(CASE WHEN ends THEN k END) OVER w AS next_end, min(CASE WHEN noun OR NOT pre THEN k * 2 + noun::INT END) OVER w AS next_other
        FROM d1 WINDOW w AS (PARTITION BY doc_id, s ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))""",
    """d3 AS (SELECT doc_id, s, coalesce(max(CASE WHEN k = 1 AND tag = 'VB' THEN 1 END), min(k) FILTER (tag IN ('VBD', 'VBP', 'VBZ')), min(k) FILTER (verb),
          max(k) FILTER (ends), 1) AS root0, bool_or(verb) AS verbal FROM d2 GROUP BY doc_id, s)""",
    f"""d4 AS (SELECT d2.doc_id, d2.s, any_value(root0) AS root0, bool_or(verbal AND k = root0 AND l IN {listed(sy.COPULAS)}) AS be,
          min(k) FILTER (k > root0 AND (ends OR (tag IN ('JJ', 'VBN', 'VBG') AND noun_end = 0))) AS after0, min(k) FILTER (k > root0 AND tag IN ('IN', 'TO')) AS between0
        FROM d2 JOIN d3 USING (doc_id, s) GROUP BY d2.doc_id, d2.s)""",
    """d5 AS (SELECT doc_id, s, CASE WHEN moved THEN after0 ELSE root0 END AS root, CASE WHEN moved THEN root0 ELSE 0 END AS copula
        FROM (SELECT *, be AND after0 IS NOT NULL AND coalesce(between0 > after0, true) AS moved FROM d4))""",
    """d6 AS (SELECT *, CASE WHEN k = root THEN 'root' WHEN k = copula THEN 'cop' WHEN pre AND noun_end > 0 AND NOT ends THEN 'pre' WHEN ends THEN 'end'
          WHEN tag IN ('IN', 'TO') THEN 'mark' ELSE 'other' END AS part FROM d2 JOIN d5 USING (doc_id, s))""",
    """d7 AS (SELECT *, CASE WHEN part = 'end' THEN k * 4 + 1 WHEN part = 'mark' THEN k * 4 + 2
          WHEN part <> 'pre' AND NOT pre AND tag NOT IN ('IN', 'TO', 'RB') AND NOT ends THEN k * 4 + 3 END AS event FROM d6)""",
    f"""d8 AS (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id, s ORDER BY k {_BEFORE}) AS last_event,
          first_value(event IGNORE NULLS) OVER (PARTITION BY doc_id, s ORDER BY k {_AFTER}) AS next_event FROM d7)""",
    f"""d9 AS (SELECT *, CASE WHEN part = 'root' THEN 0 WHEN part = 'pre' THEN noun_end WHEN part = 'mark' AND next_event % 4 = 1 THEN next_event // 4
          WHEN part = 'other' AND tag = 'POS' AND k > 1 THEN k - 1 ELSE root END AS head, CASE
          WHEN part IN ('root', 'cop') THEN part
          WHEN part = 'pre' THEN CASE tag {_RELATIONS} END
          WHEN part = 'end' THEN CASE WHEN last_event % 4 = 2 THEN 'nmod' WHEN k < CASE WHEN copula > 0 THEN copula ELSE root END THEN 'nsubj' ELSE 'dobj' END
          WHEN part = 'mark' THEN CASE WHEN next_event % 4 = 1 THEN 'case' WHEN tag1 IN {listed(sy.VERBS)} THEN 'mark' ELSE 'prep' END
          WHEN tag = 'MD' THEN 'aux' WHEN verb AND k < root THEN 'aux' WHEN verb THEN 'conj'
          WHEN tag IN ('RB', 'RBR', 'RBS', 'WRB') THEN CASE WHEN l IN ('not', 'n''t', 'n’t', 'never') THEN 'neg' ELSE 'advmod' END
          WHEN tag IN ('JJ', 'JJR', 'JJS') THEN 'acomp' WHEN tag = 'RP' THEN 'prt' WHEN tag = 'CC' THEN 'cc'
          WHEN tag = 'POS' AND k > 1 THEN 'possessive' WHEN tag = 'POS' THEN 'dep'
          WHEN NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 'punct' ELSE 'dep' END AS dep FROM d8)""",
    """edges AS (SELECT doc_id, s, k, head, dep, text, tag, i, row_number() OVER (PARTITION BY doc_id, s, head ORDER BY k) - 1 AS child_ord FROM d9)""",
]

STEPS = {"sen": _SENTENCES, "tagged": _TAGS, "ann": _LEMMAS, "men": _NER, "sen_mood": _SENTIMENT, "edges": _DEPENDENCIES}
_NEEDS = {"tok": [], "sen": ["sen"], "tagged": ["sen", "tagged"], "ann": ["sen", "tagged", "ann"], "men": ["sen", "tagged", "men"], "sen_mood": ["sen", "tagged", "sen_mood"], "edges": ["sen", "tagged", "edges"]}


def chain(table: str, *steps: str, only_whitespace: bool = False) -> str:
    """``WITH src, tok, ...`` up to each of the steps, for a table of :data:`SOURCES`."""
    pattern = quoted(defaults.WHITESPACE_TOKEN) if only_whitespace else TOKEN
    found = [f"src AS ({SOURCES[table]})", *_tokens(pattern, not only_whitespace)]
    for name in dict.fromkeys(n for step in steps for n in _NEEDS[step]):
        found += STEPS[name]
    return "WITH " + ",\n".join(found)


def tag_type(column: str) -> str:
    cases = " ".join(f"WHEN {column} IN {listed(tags)} THEN {quoted(kind)}" for kind, tags in TAG_TYPES.items())
    return f"CASE {cases} END"


def tag_description(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in TAG_DESCRIPTIONS.items()) + " END"


def label_of(column: str) -> str:
    return (
        f"CASE WHEN {column} > 1 THEN 'very positive' WHEN {column} = 1 THEN 'positive' WHEN {column} < -1 THEN 'very negative'"
        f" WHEN {column} = -1 THEN 'negative' WHEN {column} = 0 THEN 'neutral' END"
    )


def java_hash(column: str) -> str:
    """The polynomial hash of a string, by a fold over its code points."""
    codes = f"list_transform(regexp_extract_all({column}, '(?s).'), lambda c: ord(c)::BIGINT)"
    total = f"list_reduce(list_prepend(0::BIGINT, {codes}), lambda a, c: (a * 31 + c) % 4294967296)"
    return f"CASE WHEN {total} >= 2147483648 THEN {total} - 4294967296 ELSE {total} END"
