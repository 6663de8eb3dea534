"""Text cleaning and tokenizing as Column expressions (no Python in the tasks)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns below define what a word, a space and a token is.
# They use explicit Unicode classes because \w, \s and \b mean different
# things in Java, RE2 and Python.
WORD_CHAR = r"[\p{L}\p{N}_]"
NON_SPACE = r"[^\p{Z}\x09-\x0D\x1C-\x1F\x85]"
HANDLE = r"@[A-Za-z0-9]+"
URL = WORD_CHAR + r"+://" + NON_SPACE + r"+"
SYMBOL = r"[^0-9A-Za-z \t]"
BLANKS = r"[ \t]+"

# Tweet tokens, first alternative wins: URL, handle, hashtag, word with inner
# apostrophes or hyphens, number, emoticon, any other visible character.
TOKEN = "|".join(
    [
        r"(?:https?|ftp)://[^\p{Z}\p{Cc}]+",
        r"@[A-Za-z0-9_]+",
        r"#[\p{L}\p{N}_]+",
        r"\p{N}*[\p{L}_][\p{L}\p{N}_]*(?:['’\-][\p{L}\p{N}_]+)*",
        r"\p{N}+(?:[.,:/]\p{N}+)*",
        r"[<>]?[:;=]['\-^]?[)(\]\[DPO/\\|*]|<3",
        r"[^\p{Z}\p{Cc}]",
    ]
)
HANDLE_TOKEN = r"^@[A-Za-z0-9_]+$"
TERM = WORD_CHAR + r"{2,}"
NON_LETTERS = r"[^\p{L}]+"
LETTER_TRIGRAM = r"(?=([ \p{L}]\p{L}[ \p{L}]))"


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, not once per use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_spacing(text: Column | str) -> Column:
    """Handles, symbols and URLs become spaces; runs of spaces become one."""
    pattern = f"({HANDLE})|({SYMBOL})|({URL})"
    return _collapse(F.regexp_replace(_column(text), pattern, " "))


def clean_strict(text: Column | str) -> Column:
    """Handles, URLs, digits and two entities become spaces, in this order;
    every other symbol is deleted, line breaks included."""
    cleaned = _column(text)
    for pattern in (HANDLE, URL, r"[0-9]+", "&amp;", "&quote;"):
        cleaned = F.regexp_replace(cleaned, pattern, " ")
    return _collapse(F.regexp_replace(cleaned, SYMBOL, ""))


def squeeze_letters(text: Column | str) -> Column:
    """Shorten a character repeated more than twice, in any case, to its first two."""
    return F.regexp_replace(_column(text), r"(?isu)((.)\2)\2+", "$1")


def tokenize(text: Column | str, strip_handles: bool = False) -> Column:
    """Array of tweet tokens in text order."""
    tokens = F.regexp_extract_all(_column(text), F.lit(TOKEN), F.lit(0))
    if strip_handles:
        tokens = F.filter(tokens, lambda token: ~token.rlike(HANDLE_TOKEN))
    return tokens


def terms(text: Column | str, ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """Lower-cased tokens of two or more word characters, and their n-grams."""
    words = F.regexp_extract_all(F.lower(_column(text)), F.lit(TERM), F.lit(0))
    if ngram_range == (1, 1):
        return words
    if ngram_range == (2, 2):
        return bigram_terms(words)
    if ngram_range == (1, 2):
        return _bind(words, lambda w: F.concat(w, _joined_pairs(w)))
    raise ValueError(f"n-gram range not supported: {ngram_range}")


def letter_trigrams(text: Column | str) -> Column:
    """One lower-cased trigram per letter, words padded by one space."""
    letters = F.regexp_replace(F.lower(_column(text)), NON_LETTERS, " ")
    padded = F.concat(F.lit(" "), letters, F.lit(" "))
    return F.regexp_extract_all(padded, F.lit(LETTER_TRIGRAM), F.lit(1))


def _first_and_second(tokens: Column) -> tuple[Column, Column]:
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.slice(tokens, F.lit(1), pairs), F.slice(tokens, F.lit(2), pairs)


def _joined_pairs(tokens: Column) -> Column:
    first, second = _first_and_second(tokens)
    return F.zip_with(first, second, lambda a, b: F.concat_ws(" ", a, b))


def bigrams(tokens: Column | str) -> Column:
    """Array of structs ``(w1, w2)`` of adjacent tokens; empty below two tokens."""
    zipped = _bind(_column(tokens), lambda t: F.arrays_zip(*_first_and_second(t)))
    return zipped.cast("array<struct<w1:string,w2:string>>")


def bigram_terms(tokens: Column | str) -> Column:
    """Adjacent tokens joined by one space."""
    return _bind(_column(tokens), _joined_pairs)


def presence(tokens: Column | str) -> Column:
    """Distinct tokens of one text."""
    return F.array_distinct(_column(tokens))


def _run_starts(ordered: Column) -> Column:
    """Struct of a sorted array and the positions where a new value begins."""
    positions = F.when(
        F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)
    ).otherwise(F.array().cast("array<int>"))
    starts = F.filter(
        positions, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
    )
    return F.struct(ordered.alias("ordered"), starts.alias("starts"))


def term_counts(tokens: Column | str) -> Column:
    """Array of structs ``(term, tf)`` of one text, in term order.

    Counts runs in the sorted array, so a long text costs n log n inside its
    own row and no shuffle.
    """

    def count(runs: Column) -> Column:
        ordered, starts = runs["ordered"], runs["starts"]
        after = F.concat(
            F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))),
            F.array(F.size(ordered)),
        )
        return F.zip_with(
            starts,
            after,
            lambda start, end: F.struct(
                F.get(ordered, start).alias("term"), (end - start).alias("tf")
            ),
        )

    counted = _bind(_bind(F.sort_array(_column(tokens)), _run_starts), count)
    return F.filter(counted, lambda entry: entry["term"].isNotNull())


def without_apostrophes(word: Column | str) -> Column:
    return F.regexp_replace(_column(word), "'", "")
