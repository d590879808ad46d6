"""Personal data: regular expressions propose spans, checksum validators confirm them, context words adjust the score.

Only built-in Spark functions run. A pattern's matches and the gaps between them come from one pair of linear scans
(regexp_extract_all and split with the same pattern); offsets are running sums of their lengths, in code points.
Every pattern is written so that Java's matcher stays linear on long runs: possessive repeats, and a look-behind that
lets a match begin only at the start of a run or where the last match ended (``\\G``), which keeps the leftmost
non-overlapping matches of the plain pattern. Whatever an expression over many matches needs more than once is bound first
(``_bound``), so that the work stays linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Elements that one step of a running sum handles; the sum of n lengths costs about n * _BLOCK copies.
_BLOCK = 128


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # Java; same matches as the plain pattern
    base: bool  # base spans stay whatever their score
    score: float
    context: str  # words that raise the score when they stand next to the span


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, 0.9, r"e-?mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", True, 0.6, r"ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", True, 0.8, r"card|visa|mastercard|amex|credit|debit"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.6, r"phone|tel|call|mobile|fax"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", False, 0.8, r"iban|account|bank"),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", False, 0.3, r"ssn|social security"),
    Kind("key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[oprsu]_[A-Za-z0-9]{36,255}\b|\bxox[abprs]-[A-Za-z0-9-]{10,255}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", False, 0.8, r"key|secret|token|credentials?"),
    Kind("secret", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}", False, 0.3, r"token|secret|password|passwd|api[_-]?key|access[_-]?key|credentials?|authorization|bearer"),
)
#: Spans of kinds that are not base ones are kept from this score on; context adds CONTEXT_BONUS.
THRESHOLD, CONTEXT_BONUS, CONTEXT_CHARS = 0.5, 0.3, 48


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """ISO 13616: the first four characters move to the end, letters count 10 to 35, the number modulo 97 is 1."""
    s = F.regexp_replace(m, " ", "")
    s = F.concat(F.substring(s, 5, 2**30), F.substring(s, 1, 4))
    # 48 is the code of "0", 55 turns "A" into 10
    step = lambda a, c: F.when(F.ascii(c) < 65, (a * 10 + (F.ascii(c) - 48)) % 97).otherwise((a * 100 + (F.ascii(c) - 55)) % 97)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & _mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9..)|-00-|-0000$")
    if kind == "secret":  # letters and at least four digits, as random strings have
        return F.length(m).between(20, 512) & m.rlike("[A-Za-z]") & (F.length(_digits(m)) >= 4)
    return F.lit(True)


def _bound(value: Column, f) -> Column:
    """f(value), with value worked out once, however often and in whatever inner function f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running_sum(lengths: Column) -> Column:
    """Running sums of an array of ints: block sums first, then the sums within each block."""
    none = F.array().cast("array<int>")
    grow = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out"))
    start = lambda at: F.struct(at.alias("at"), none.alias("out"))

    def sums(n: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int"))
        block = lambda b: F.slice(n, b * _BLOCK + 1, _BLOCK)
        whole = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda a, x: a + x))
        before = F.concat(F.array(F.lit(0)), F.aggregate(whole, start(F.lit(0)), grow)["out"])
        return _bound(before, lambda at: F.flatten(F.transform(blocks, lambda b: F.aggregate(block(b), start(F.get(at, b)), grow)["out"])))

    return _bound(lengths, lambda n: F.when(F.size(n) > 0, sums(n)).otherwise(none))


def _near(kind: Kind, gap: Column, after: Column) -> Column:
    words = rf"(?i)(?<![a-z])(?:{kind.context})(?![a-z])"
    return F.substring(gap, -CONTEXT_CHARS, CONTEXT_CHARS).rlike(words) | F.substring(after, 1, CONTEXT_CHARS).rlike(words)


def _found(kind: Kind, text: Column, f, otherwise: Column) -> Column:
    """f(matches, gaps around them, scores of the matches) where the kind's pattern occurs in the text, else ``otherwise``.

    The score of a match that does not count is null. The context of a match is the text between it and the matches around it.
    """

    def scores(m: Column, g: Column) -> Column:
        score = lambda i: F.lit(kind.score) + F.when(_near(kind, F.get(g, i), F.get(g, i + 1)), CONTEXT_BONUS).otherwise(0.0)
        return F.transform(m, lambda x, i: F.when(_valid(kind.name, x), _bound(score(i), lambda s: F.when(F.lit(kind.base) | (s >= THRESHOLD), F.least(s, F.lit(1.0))))))

    with_scores = lambda m, g: _bound(scores(m, g), lambda ok: f(m, g, ok))
    with_gaps = lambda m: _bound(F.split(text, kind.pattern, -1), lambda g: with_scores(m, g))
    return F.when(text.rlike(kind.pattern), _bound(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), with_gaps)).otherwise(otherwise)


def _spans(kind: Kind, text: Column) -> Column:
    def of(m: Column, g: Column, ok: Column) -> Column:
        ends = running_sum(F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x)))
        span = lambda end, x, i: F.struct(F.lit(kind.name).alias("kind"), (end - F.length(x)).alias("start"), end.alias("end"), F.get(ok, i).alias("score"))
        return _bound(ends, lambda e: F.filter(F.transform(m, lambda x, i: span(F.get(e, i), x, i)), lambda s: s["score"].isNotNull()))

    return _found(kind, text, of, F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def pii_spans(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with a column ``out``: array<struct<kind, start, end, score>> by kind as in KINDS, then start.

    Offsets are code points, end exclusive. Null text counts as empty and gives an empty array; repeated rows are
    judged one by one; text of any length is searched as a whole; an empty table stays empty. Other columns pass through
    untouched, whatever their names; a column named ``out`` is replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    spans = F.concat(*[_spans(k, value) for k in KINDS])
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != out], spans.alias(out))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span that counts replaced by its kind in brackets, kind after kind; null text stays null.

    A kind is searched in what the kinds before it have left, so that overlapping spans leave nothing behind. Rows are judged
    one by one, repeated ones alike; an empty table stays empty. Other columns pass through, whatever their names.
    """

    def hidden(kinds: tuple[Kind, ...], t: Column) -> Column:
        if not kinds:
            return t
        of = lambda m, g, ok: F.array_join(F.transform(g, lambda x, i: F.concat(x, F.coalesce(F.when(F.get(ok, i).isNotNull(), F.lit(f"[{kinds[0].name.upper()}]")).otherwise(F.get(m, i)), F.lit("")))), "")
        return _bound(_found(kinds[0], t, of, t), lambda left: hidden(kinds[1:], left))

    return df.select(*[hidden(KINDS, F.col(f"`{text}`")).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def spans_query(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, a digest of the base spans, and all spans as text."""
    base = [k.name for k in KINDS if k.base]
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    d = pii_spans(docs.select("doc_id", "text"))
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("pii", of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    of_base = F.concat_ws(",", F.transform(F.filter("pii", lambda s: s["kind"].isin(base)), line))
    return d.select("doc_id", *counts, F.sha2(of_base, 256).alias("base_sha256"), F.concat_ws(",", F.transform("pii", line)).alias("spans"))
