"""Text expressions: words, stems, keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that carry no meaning of their own.
STOP = ["the", "and", "for", "that", "with", "this", "from", "are", "was", "were", "has", "have", "had", "not", "but", "been", "will", "its", "our", "their", "they", "than", "which", "about", "into"]


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def stem(word: Column) -> Column:
    """A word without a common English ending, if enough of it is left."""
    return F.regexp_replace(word, r"^([\p{L}]{4,}?)(?:ings|ing|ed|es|s)$", "$1")


def spaced(words_: Column) -> Column:
    """Words joined by blanks, with one around them: for searching word sequences."""
    return F.concat(F.lit(" "), F.array_join(words_, " "), F.lit(" "))


def plain(text: Column) -> Column:
    """The words of a text, one blank around each: for searching word sequences."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Number of the terms that occur in the lower-cased text (as substrings)."""
    low = F.lower(text)
    total = F.lit(0)
    for t in terms:
        total = total + F.when(low.contains(t), 1).otherwise(0)
    return total
