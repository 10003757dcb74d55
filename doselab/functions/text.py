"""Text functions on columns. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words left out of overlap tests.
OVERLAP_STOPWORDS = (
    "a an the this that these those is am are was were be been being do does did done have has had having "
    "will would shall should can could may might must of to in on at by for with from into onto off out up down "
    "over under and or but nor so yet for not no i you he she it we they me him her us them "
    "my your his its our their as if than then there here"
).split()
#: Function words left out of productivity counts.
INSTANCE_STOPWORDS = (
    "a an the this that these those is are was were be been being am do does did done has have had having "
    "of to in on at by for with from as into onto and or but nor so yet i you he she it we they me him her us them "
    "my your his its our their not no"
).split()
#: Fixed value: what is stripped from the ends of white-space tokens.
EDGE_MARKS = ".,!?;:\"'()[]{}—–-"
#: Fixed value: a word with at most one inner apostrophe.
WORD = "[a-z]+(?:'[a-z]+)?"


def space_tokens(text: Column) -> Column:
    """White-space tokens; the class is Unicode's."""
    return F.regexp_extract_all(text, F.lit("(?U)\\S+"), F.lit(0))


def normalize_space(text: Column) -> Column:
    return F.array_join(space_tokens(text), " ")


def space_count(text: Column) -> Column:
    return F.size(space_tokens(text))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def content_set(text: Column) -> Column:
    return F.array_distinct(F.array_except(word_tokens(text), F.array(*map(F.lit, sorted(set(OVERLAP_STOPWORDS))))))


def content_list(text: Column) -> Column:
    stop = F.array(*map(F.lit, INSTANCE_STOPWORDS))
    stripped = F.transform(space_tokens(F.lower(text)), lambda x: F.btrim(x, F.lit(EDGE_MARKS)))
    return F.filter(stripped, lambda x: (x != "") & ~F.array_contains(stop, x))


def feature(feats: Column, key: str) -> Column:
    """The value of a morphological feature in ``K=V|K=V``; null if absent or empty."""
    # One search; a map of all features took several times as long.
    return F.nullif(F.regexp_extract(feats, rf"(?:^|\|)\Q{key}\E=([^|]*)", 1), F.lit(""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def nonblank(text: Column) -> Column:
    return F.regexp_like(text, F.lit("(?U)\\S"))
