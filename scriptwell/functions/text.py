"""Text expressions: identifier redaction, chunking, tokens, question intents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptwell.fixed_values import (
    CHUNK_MAX_WORDS,
    CHUNK_OVERLAP_WORDS,
    DEFAULT_QUESTION_YEAR,
    PHI_COUNT_ONLY,
    PHI_PATTERNS,
    PHI_REPLACEMENT,
    QUESTION_INTENTS,
    QUESTION_YEAR_PATTERN,
)
from scriptwell.functions.columns import col

# Unicode character classes, so that \w, \d and \b also cover accented letters.
_UNICODE = "(?U)"

# Runs of what Python's str.split takes for whitespace.
_SPACES = _UNICODE + r"[\s\x1c-\x1f]+"

# What a match can start with. Looked at first, it rejects most positions of a text
# without the costlier word-boundary test.
_FIRST = {
    "ssn": r"\d", "phone": r"[+(\d]", "ip_address": r"\d", "date_full": r"\d",
    "mrn_like": r"[Mm]", "npi_as_identifier": r"\d",
}


def _pattern(label: str) -> str:
    first = f"(?={_FIRST[label]})" if label in _FIRST else ""
    return _UNICODE + first + PHI_PATTERNS[label]


# Marks without which a text cannot hold an identifier; the other kinds need a digit.
_MARKS = {"email": "@", "url": "://"}


def has_digit(text: Column | str) -> Column:
    return col(text).rlike(_UNICODE + r"\d")


def identifier_count(text: Column | str, label: str, digit: Column) -> Column:
    """How often one kind of identifier occurs; `digit` tells whether the text has one."""
    possible = col(text).contains(_MARKS[label]) if label in _MARKS else digit
    found = F.regexp_count(col(text), F.lit(_pattern(label)))
    return F.when(possible, found).otherwise(F.lit(0))


def without_identifier(text: Column | str, label: str) -> Column:
    """The text with one kind of identifier replaced, unless that kind is only counted."""
    if label in PHI_COUNT_ONLY:
        return col(text)
    return F.regexp_replace(col(text), _pattern(label), PHI_REPLACEMENT % label.upper())


def redact_phi(text: Column | str) -> Column:
    """The text with identifiers replaced one kind after the other."""
    for label in PHI_PATTERNS:
        text = without_identifier(text, label)
    return col(text)


def words(text: Column | str) -> Column:
    """Whitespace-separated words, none of them empty."""
    return F.array_remove(F.split(col(text), _SPACES), "")


def chunks(text: Column | str, max_words: int = CHUNK_MAX_WORDS,
           overlap: int = CHUNK_OVERLAP_WORDS) -> Column:
    """Overlapping word windows; a text of at most max_words words stays as it is."""
    if not 0 <= overlap < max_words:
        raise ValueError("overlap must be smaller than the window")
    listed, stride = words(text), max_words - overlap

    def windows(w: Column) -> Column:
        last = F.ceil((F.size(w) - max_words) / F.lit(stride)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.array_join(F.slice(w, i * stride + 1, F.lit(max_words)), " "))

    # Bind the word array once: every window slices the same array.
    split_once = F.transform(F.array(listed), windows)[0]
    return F.when(F.size(listed) > max_words, split_once).otherwise(F.array(col(text)))


def tokens(text: Column | str) -> Column:
    """Distinct lower-case word tokens."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(col(text)), F.lit(_UNICODE + r"(\w+)"), F.lit(1)))


def letter_words(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z]+)"), F.lit(1)))


def intent_of(question_words: Column) -> Column:
    """First intent all of whose word groups meet the question, NULL if there is none."""
    intent = F.lit(None).cast("string")
    for name, groups in reversed(QUESTION_INTENTS):
        matches = F.lit(True)
        for group in groups:
            matches = matches & _any_of(question_words, group)
        intent = F.when(matches, F.lit(name)).otherwise(intent)
    return intent


def _any_of(found: Column, group: Sequence[str]) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(w) for w in group]))


def question_year(text: Column | str) -> Column:
    found = F.regexp_extract(col(text), _UNICODE + QUESTION_YEAR_PATTERN, 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(DEFAULT_QUESTION_YEAR))
