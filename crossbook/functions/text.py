"""Token sets of market questions and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a question's subject.
STOPWORDS = (
    "will the a an be to of in on by at is are was were for and or not this that it as with than then who what when which over under above below before after win wins beat"
).split()
# Words that make a number or word a selector of one event among several, and filler words.
SELECTORS = ("stage", "round", "leg", "heat", "group", "top", "matchday", "game")


# Words that a threshold or a yes/no outcome begins with, beside signs and digits.
NO_SUBJECT = ("yes", "no", "above", "below", "under", "over", "at least", "at most", "more than", "less than", "fewer than", "exactly", "between")


def tokenize(text: Column) -> Column:
    """Distinct lower-case alphanumeric tokens of two or more characters, without stopwords; none for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS)))


def jaccard_parts(a: Column, b: Column) -> tuple[Column, Column]:
    """Sizes of the intersection and the union of two token sets."""
    both = F.size(F.array_intersect(a, b))
    return both, F.size(a) + F.size(b) - both


def is_entity(text: Column) -> Column:
    """Whether the text names a subject, not a threshold or yes/no; by prefix, with no word boundary."""
    t = F.trim(F.coalesce(text, F.lit("")))
    begins = "|".join([*(w.replace(" ", r"\s+") for w in NO_SUBJECT), "[<>$+]", r"\d"])
    return (t != "") & ~t.rlike(rf"(?i)^\s*({begins})") & ~t.contains("%")
