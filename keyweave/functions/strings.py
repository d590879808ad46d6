"""Column expressions of the transformation language, with plain Python twins for learning and tests.

Positions that do not exist give null, and null passes through concatenation, so a program that fails on a row gives null there.
"""

from __future__ import annotations

import unicodedata
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

#: substring() length that reaches the end of any string.
TO_END = 2**31 - 1


class Casing(str, Enum):
    NONE = "none"
    LOWER = "lower"
    UPPER = "upper"
    TITLE = "title"


def literal_pattern(text: str) -> str:
    """A Java regular expression that matches the text itself."""
    return "".join(c if c.isalnum() or ord(c) > 126 else f"\\x{ord(c):02x}" for c in text)


def split(value: Column, separator: str) -> Column:
    """Parts between literal separators, trailing empty ones too."""
    if not separator:
        raise ValueError("empty separator")
    return F.split(value, literal_pattern(separator), -1)


def select_k(parts: Column, k: int) -> Column:
    """The k-th part from 0, or from the end for negative k; null where there is none."""
    return F.get(parts, F.lit(k)) if k >= 0 else F.try_element_at(parts, F.lit(k))


def substring(value: Column, start: int, length: int = -1, casing: Casing = Casing.NONE) -> Column:
    """``length`` characters (-1: all) from ``start`` (negative: from the end), clamped to the value."""
    n = F.length(value)
    at = F.greatest(F.lit(0), F.least(F.lit(start) if start >= 0 else n + start, n))
    return cased(F.substring(value, at + 1, F.lit(TO_END if length < 0 else length)), casing)


def cased(value: Column, casing: Casing) -> Column:
    if casing is Casing.LOWER:
        return F.lower(value)
    if casing is Casing.UPPER:
        return F.upper(value)
    if casing is Casing.TITLE:
        words = F.split(value, r"(?<=\p{javaWhitespace})", -1)
        return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, TO_END)))), "")
    return value


def java_trim(value: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def join_cells(cells: Column, positions: list[int], separator: str) -> Column:
    """The cells at the positions with a separator between them, null as empty."""
    return F.concat_ws(separator, *[F.coalesce(F.get(cells, F.lit(p)), F.lit("")) for p in positions])


def whole_row(cells: Column, separator: str = " ") -> Column:
    return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), separator)


# --- the same in Python -----------------------------------------------------------------------------------------------


def py_cased(value: str, casing: Casing) -> str:
    if casing is Casing.LOWER:
        return value.lower()
    if casing is Casing.UPPER:
        return value.upper()
    if casing is Casing.TITLE:
        out, first = [], True
        for c in value:
            out.append(c.upper() if first else c.lower())
            first = c in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f" or unicodedata.category(c)[0] == "Z" and c not in "\u00a0\u2007\u202f"  # what Java calls white space
        return "".join(out)
    return value


def py_substring(value: str, start: int, length: int = -1, casing: Casing = Casing.NONE) -> str:
    at = max(0, min(start if start >= 0 else len(value) + start, len(value)))
    return py_cased(value[at:] if length < 0 else value[at : at + length], casing)


def py_select(parts: list[str], k: int) -> str | None:
    return parts[k] if -len(parts) <= k < len(parts) else None
