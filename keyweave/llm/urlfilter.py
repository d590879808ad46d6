"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All patterns share one Shift-And state vector of as many 64-bit words as their positions need. A character moves
every pattern at once: ``D = ((D << 1) & B[c]) | (D & S[c])``, where B holds the positions that c may enter and S
those where a wildcard lets the automaton stay. numpy runs the step for a whole Arrow batch, longest URLs first, so
that the active URLs are always a prefix of the batch.

Patterns: ``*`` stands for any characters but ``/``, ``**`` for any characters, ``?`` for one character but ``/``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.workers import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host + path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: (verdict, glob over the canonical url), for urls that no rule fits; the first that matches decides.
GLOBS = (("block", "**.exe"), ("block", "**/wp-admin/**"), ("block", "**/cgi-bin/**"), ("block", "*.onion/**"))
DEFAULT = "allow"
_SLASH = ord("/")


def rule_glob(rule: str) -> str:
    """The glob of a rule over canonical urls, which are a dot, the host and the path."""
    host, slash, path = rule.partition("/")
    return f"*.{host}{slash}{path}**"


@dataclass
class Automaton:
    """Patterns in order of priority, packed from the lowest bit on."""

    classes: np.ndarray  # code points with a class of their own, sorted; class 0 is every other character
    enter: np.ndarray  # [class, word]
    stay: np.ndarray  # [class, word]
    start: np.ndarray  # [word]
    final: np.ndarray  # [word]
    owner: np.ndarray  # pattern by bit

    @classmethod
    def of(cls, globs: Sequence[str]) -> Automaton:
        states: list[tuple[int, int | None, int]] = []  # pattern, the character that enters (None: start), wildcard: 0, 1 or 2
        ends = []
        for k, glob in enumerate(globs):
            states.append((k, None, 0))
            i = 0
            while i < len(glob):
                if glob[i] == "*":
                    deep = 2 if glob[i : i + 2] == "**" else 1
                    k0, c, kind = states[-1]
                    states[-1] = (k0, c, max(kind, deep))
                    i += deep
                else:
                    states.append((k, -1 if glob[i] == "?" else ord(glob[i]), 0))
                    i += 1
            ends.append(len(states) - 1)
        own = np.array(sorted({c for _, c, _ in states if c is not None and c >= 0} | {_SLASH}), dtype=np.int64)
        words = max(1, -(-len(states) // 64))
        enter, stay = (np.zeros((len(own) + 1, words), dtype=np.uint64) for _ in range(2))
        start, final = (np.zeros(words, dtype=np.uint64) for _ in range(2))
        for bit, (_, c, kind) in enumerate(states):
            w, b = divmod(bit, 64)
            one = np.uint64(1 << b)
            for k in range(len(own) + 1):
                char = own[k - 1] if k else None
                if c is not None and (char != _SLASH if c == -1 else char == c):
                    enter[k, w] |= one
                if kind == 2 or kind == 1 and char != _SLASH:
                    stay[k, w] |= one
            if c is None:
                start[w] |= one
        for bit in ends:
            final[bit // 64] |= np.uint64(1 << bit % 64)
        return cls(own, enter, stay, start, final, np.array([k for k, _, _ in states], dtype=np.int32))

    def first(self, strings: Sequence[str]) -> np.ndarray:
        """The first pattern that matches each whole string, -1 where none does."""
        flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        length = np.fromiter((len(s) for s in strings), dtype=np.int64, count=len(strings))
        at = np.cumsum(length) - length
        spot = np.searchsorted(self.classes, flat)
        code = np.where(self.classes[np.minimum(spot, len(self.classes) - 1)] == flat, spot + 1, 0)
        order = np.argsort(-length, kind="stable")
        at, length = at[order], length[order]
        state = np.tile(self.start, (len(strings), 1))
        top = np.uint64(63)
        for i in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -i, side="left"))  # strings longer than i
            d, c = state[:n], code[at[:n] + i]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> top
            state[:n] = (moved & self.enter[c]) | (d & self.stay[c])
        hit = state & self.final
        out = np.full(len(strings), -1, dtype=np.int32)
        for w in range(hit.shape[1] - 1, -1, -1):  # lower words hold earlier patterns and overwrite later ones
            got = np.flatnonzero(hit[:, w])
            low = hit[got, w] & (~hit[got, w] + np.uint64(1))
            bit = np.frexp(low.astype(np.float64))[1] - 1
            out[order[got]] = self.owner[64 * w + bit]
        return out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, globs: Sequence[tuple[str, str]] = GLOBS, default: str = DEFAULT) -> DataFrame:
    """df with host, path, rule and verdict; columns of df with these names are replaced.

    The longest rule that fits decides (of equally long ones the first); where none fits, rule is null and the first
    matching glob's verdict holds, else the default. Null urls and urls without ``://`` have an empty host and path, which
    no rule fits. Rows are judged one by one, so repeated rows get equal verdicts; urls of any length are read whole. Other columns pass through, whatever their names.
    """
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    machine = Automaton.of([rule_glob(r) for _, r in ranked] + [g for _, g in globs])
    texts, verdicts = [r for _, r in ranked] + [None] * len(globs), [v for v, _ in [*ranked, *globs]]

    @F.pandas_udf("int")
    def first(urls: pd.Series) -> pd.Series:
        return pd.Series(machine.first(urls.tolist()))

    ship(df.sparkSession)
    host, path = host_path(F.col(f"`{url}`"))
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), host.alias("host"), path.alias("path"))
    out = out.select("*", first(F.concat(F.lit("."), "host", "path")).alias("k"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)).cast("array<string>"), F.col("k"))
    new = {"host": F.col("host"), "path": F.col("path"), "rule": pick(texts), "verdict": F.coalesce(pick(verdicts), F.lit(default))}
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in new], *[v.alias(k) for k, v in new.items()])
