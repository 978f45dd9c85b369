"""Text cleaning, tokens and lexicon sentiment as native columns."""

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketscope.constants import SENTIMENT_BOUNDS, SENTIMENTS, TEXT_PATTERNS


def cleaned(text: str | Column) -> Column:
    """Lower-cased text without tags and links, every other non-letter turned into a space."""
    out = F.lower(text)
    for pattern, replacement in TEXT_PATTERNS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def tokens(text: str | Column) -> Column:
    """Lower-cased words split at white space, without empty ones."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(or_, [text.contains(word) for word in words])


def count_present(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur in the text, each counted once."""
    return reduce(add, [text.contains(pattern).cast("int") for pattern in patterns])


def sentiment_bucket(score: str | Column) -> Column:
    """Five-step label of a score, upper bounds included."""
    score = F.col(score) if isinstance(score, str) else score
    labelled = F.when(score <= SENTIMENT_BOUNDS[0], SENTIMENTS[0])
    for bound, label in zip(SENTIMENT_BOUNDS[1:], SENTIMENTS[1:]):
        labelled = labelled.when(score <= bound, label)
    return labelled.otherwise(SENTIMENTS[-1])


def sentiment_rank(label: str) -> Column:
    """Position of a label from most negative (1) to most positive (5)."""
    return F.array_position(F.array(*[F.lit(s) for s in SENTIMENTS]), F.col(label))


def shortened(text: str | Column, limit: int = 100) -> Column:
    """Text over `limit` characters cut so that it ends in dots and is `limit` long."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)
