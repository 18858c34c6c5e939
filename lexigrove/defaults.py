"""Choices that the annotation model leaves open, and the patterns that all parts share."""

from __future__ import annotations

#: Stands for a part-of-speech tag or a verb that is not there.
NONE_LABEL = "<none>"
#: Of no mentions, no tokens and no sentences.
EMPTY = 0

#: English stop words, by language code; other languages have none unless a list is given.
STOP_WORDS = {
    "en": (
        "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to"
        " was will with"
    ).split()
}

#: Words (with inner apostrophes and hyphens), numbers (with inner marks), dashes, ellipses, and any other character.
TOKEN = r"\p{L}+(?:['’-]\p{L}+)*|\p{N}+(?:[.,:/-]\p{N}+)*|--+|\.\.\.|[^ \t\n\x0B\f\r\p{L}\p{N}]"
#: A word and the clitic that becomes a token of its own.
CLITIC = r"^(.+?)(n['’]t|['’](?:s|re|ve|ll|d|m|S|RE|VE|LL|D|M))$"
#: What only white space separates.
WHITESPACE_TOKEN = r"[^ \t\n\x0B\f\r]+"

#: Tokens that end a sentence, and those that may follow the end inside it.
SENTENCE_ENDS = (".", "!", "?", "...")
SENTENCE_CLOSERS = ('"', "'", "”", "’", ")", "]", "}", "»")
#: A period after one of these ends no sentence.
ABBREVIATIONS = "mr mrs ms dr prof st jr sr vs etc inc ltd co corp dept gen rep sen rev hon".split()
