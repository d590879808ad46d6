"""Tokenisers and set distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokenisers that the fuzzy joins try, in this order.
JOIN_TOKENISERS = ("q3", "q2", "word")
RECOVERY_TOKENISERS = ("q3", "word")
#: Tokenisers and distances of the oracle's grid.
GRID_TOKENISERS = ("EXACT", "LOWER", "SPLIT", "WORD", "Q2", "Q3", "Q4", "Q5", "Q6", "Q7", "Q8", "Q9", "Q10")
GRID_DISTANCES = ("JACCARD", "DICE", "MAXINCLUSION", "INTERSECT")


def qgrams(value: Column, q: int) -> Column:
    """The distinct runs of q characters; a shorter value is its own token."""
    n = F.length(value)
    return F.when(n < q, F.array(value)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: F.substring(value, i, F.lit(q)))))


def _parts(value: Column) -> Column:
    return F.array_distinct(F.filter(F.split(value, r"\s+"), lambda x: x != ""))


def words(value: Column) -> Column:
    return _parts(value)


def split_tokens(value: Column) -> Column:
    return _parts(F.lower(value))


def word_tokens(value: Column) -> Column:
    return _parts(F.regexp_replace(F.lower(value), r"[^\p{Alnum}]+", " "))


def padded_qgrams(value: Column, q: int) -> Column:
    """Runs of q characters of the lower-cased value with q - 1 dollar signs at both ends and for every white space."""
    pad = "$" * (q - 1)
    return qgrams(F.concat(F.lit(pad), F.regexp_replace(F.lower(value), r"\s", pad.replace("$", r"\$")), F.lit(pad)), q)


def tokenise(value: Column, name: str) -> Column:
    if name in ("q2", "q3"):
        return qgrams(value, int(name[1:]))
    if name == "word":
        return words(value)
    if name == "EXACT":
        return F.array(value)
    if name == "LOWER":
        return F.array(F.lower(value))
    if name == "SPLIT":
        return split_tokens(value)
    if name == "WORD":
        return word_tokens(value)
    if name.startswith("Q"):
        return padded_qgrams(value, int(name[1:]))
    raise ValueError(f"no tokeniser {name}")


def distance(name: str, both: Column, left: Column, right: Column) -> Column:
    """A set distance from the sizes of the intersection and of both sets; 0 for two empty sets, 1 for one."""
    d = {
        "JACCARD": 1 - both / (left + right - both),
        "DICE": 1 - 2 * both / (left + right),
        "MAXINCLUSION": 1 - both / F.least(left, right),
        "INTERSECT": 1 / (1 + both),
    }[name]
    return F.when((left == 0) & (right == 0), 0.0).when((left == 0) | (right == 0), 1.0).otherwise(d)


def sets_distance(name: str, a: Column, b: Column) -> Column:
    return distance(name, F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def blank_aware_jaccard(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Jaccard distance of token sets a and b of values x and y: 0 for two blank or two equal values, 1 for one blank one."""
    blank = lambda v: F.trim(v) == ""
    return F.when((blank(x) & blank(y)) | (x == y), 0.0).when(blank(x) | blank(y), 1.0).otherwise(sets_distance("JACCARD", a, b))
