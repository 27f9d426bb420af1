"""Text functions as Spark columns, with Python's meaning of white space, words and rounding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Accented letters below U+0250 and their base letters, by Unicode decomposition.
ACCENTED = "".join(chr(c) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isalpha())
BASES = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)

# Words that are no keywords.
STOPWORDS_EN = """
what how when where who which why is are was were do does did the a an in on at to for of with by from and or but
not this that it its can could would should has have had be been being will shall
""".split()
STOPWORDS_DE = """
wie was wer wo wann warum ist sind der die das ein eine in auf an zu fuer von mit und oder aber nicht den dem des im
am es er sie wird werden hat haben kann
""".split()
STOPWORDS = tuple(dict.fromkeys(STOPWORDS_EN + STOPWORDS_DE))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def keywords(question: Column) -> Column:
    """Lower-cased words of three letters or more that are no stopwords; order and repeats stay."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def fts_fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, BASES), r"\p{Mn}", "")


def fts_tokens(c: Column) -> Column:
    return F.regexp_extract_all(fts_fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def fts_line(c: Column) -> Column:
    """Tokens between single spaces, so that a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(fts_tokens(c), " "), F.lit(" "))


def line_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def token_estimate(c: Column) -> Column:
    return F.floor(F.size(words(c)) / 0.75).cast("long")


def matched_keywords(answer: Column, expected: Column) -> Column:
    return F.filter(expected, lambda k: F.contains(F.lower(answer), F.lower(k)))


def keyword_score(answer: Column, expected: Column) -> Column:
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(matched_keywords(answer, expected)) / F.size(expected))
