"""Text expressions: matching with null for no match, and the tokenizers of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a word is, and what separates tokens.
WORD = r"[a-zA-Z][a-zA-Z0-9]*"
BETWEEN_WORDS = r"(?:^|[^a-zA-Z0-9])[^a-zA-Z]*"
SPACE_OR_COMMA = r"[\s,]+"
AGENT_SEPARATORS = r"[;/,() ]"
FIRST_TWO_OCTETS = r"^([0-9]{1,3}[.][0-9]{1,3}).*"


def extract_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null (not '') where the pattern isn't found."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def full_match(c: Column, pattern: str) -> Column:
    """Whether the whole text matches; null for null."""
    return c.rlike(rf"\A(?:{pattern})\z")


def words(c: Column) -> Column:
    """Array of lower-cased words; '9x' holds the word x. Null gives null, '' an empty array."""
    return F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lower)


def word_pieces(c: Column) -> Column:
    """Array of the same words as they are written, and perhaps an empty text before the first: the text split at everything
    that isn't of a word. Faster than :func:`words` where the array is exploded anyway."""
    return F.split(c, BETWEEN_WORDS)


def _without_empty(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def list_tokens(c: Column) -> Column:
    """Tokens between white space and commas, without empty ones."""
    return _without_empty(F.split(c, SPACE_OR_COMMA))


def agent_tokens(c: Column) -> Column:
    """Pieces of a user agent between ``; / , ( )`` and blanks, without empty ones; repeats stay."""
    return _without_empty(F.split(c, AGENT_SEPARATORS))


def tab_fields(c: Column) -> Column:
    return F.split(c, "\t")


def first_octets(c: Column) -> Column:
    """The first two octets of an address, '' where there are none."""
    return F.regexp_extract(c, FIRST_TWO_OCTETS, 1)


def day_token(c: Column) -> Column:
    """'09 Aug 2012' of 'Thu, 09 Aug 2012 19:21:17 +0000': the second to fourth token."""
    return F.array_join(F.slice(F.split(c, " "), 2, 3), " ")


def created_at(c: Column) -> Column:
    """The timestamp of such a text, null if it is none."""
    return F.try_to_timestamp(F.substring_index(c, ", ", -1), F.lit("dd MMM yyyy HH:mm:ss Z"))
