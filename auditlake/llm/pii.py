"""Personal data: proposed by patterns, confirmed by checksums, weighed by context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows


@dataclass(frozen=True)
class Kind:
    """``prior`` is the score of a confirmed span, ``raised`` its score beside a context word."""

    name: str
    pattern: str
    context: tuple[str, ...]
    prior: float
    raised: float


# Fixed values. Where a pattern repeats a class, it is possessive, and a match
# starts where its first run starts: the matches are those of the plain
# pattern, but long runs are read once and without recursion.
EMAIL_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{EMAIL_LOCAL})){EMAIL_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("mail", "contact", "write", "address"), 0.9, 1.0),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ("ip", "host", "server", "address"), 0.6, 0.9),
    # runs of digits with single separators, 12 to 19 digits long
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])", ("card", "visa", "credit", "pay"), 0.8, 1.0),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", ("phone", "tel", "call", "mobile", "fax"), 0.7, 0.95),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", ("iban", "account", "bank"), 0.9, 1.0),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", ("ssn", "social security", "tax"), 0.4, 0.9),
)
BASE = ("email", "ip", "card", "phone")
#: Characters on either side in which context words are looked for.
NEARBY = 40
#: Score that a span of a kind outside ``BASE`` needs.
CERTAIN = 0.5

FOUND = "struct<at:int,found:array<struct<start:int,end:int,value:string>>>"


def _located(text: Column, hits: Column, pattern: str) -> Column:
    """Matches with their places: each starts where the gaps and matches before it end."""
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda hit, gap: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), hit.alias("value")))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + pair["size"]
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found")).cast(FOUND)

    none = F.struct(F.lit(0).alias("at"), F.array().alias("found")).cast(FOUND)
    return F.when(F.size(hits) > 0, F.aggregate(pairs, none, add, lambda acc: acc["found"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _characters(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substr(value, i, F.lit(1)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    def weighed(digit: Column, i: Column) -> Column:
        twice = digit.cast("int") * 2
        return F.when(i % 2 == 0, digit.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(_characters(F.reverse(digits)), weighed), F.lit(0), lambda total, x: total + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the check of ISO 13616."""
    plain = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), rest * 10 + F.try_to_number(c, F.lit("9")).cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(_characters(turned), F.lit(0), step) == 1


def _confirmed(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike(r"\A0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})\z"))
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, r"\x20", "")).between(15, 34) & mod97(value)
    return F.lit(True)


def _spans(number: int, kind: Kind) -> Column:
    """Confirmed spans of one kind with their scores."""

    def scored(span: Column) -> Column:
        first = F.greatest(F.lit(1), span["start"] + 1 - NEARBY)
        before = F.substr("text", first, span["start"] + 1 - first)
        after = F.substr("text", span["end"] + 1, F.lit(NEARBY))
        near = F.lower(F.concat(before, F.lit(" "), after)).rlike(r"\b(" + "|".join(kind.context) + r")")
        score = F.when(near, F.lit(kind.raised)).otherwise(F.lit(kind.prior))
        return F.struct(span["start"].alias("start"), F.lit(number).alias("kind_no"), span["end"].alias("end"), F.lit(kind.name).alias("kind"), span["value"].alias("value"), score.alias("score"))

    located = _located(F.col("text"), F.col(f"hits_{kind.name}"), kind.pattern)
    confirmed = F.filter(located, lambda span: _confirmed(kind.name, span))
    return F.coalesce(F.transform(confirmed, scored), F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,value:string,score:double>>"))


def find(docs: DataFrame) -> DataFrame:
    """Every row with the personal data in its text.

    Returns ``row`` (the whole input row), ``doc_id`` and ``spans``: an array of
    ``start, kind_no, end, kind, value, score`` in that order, ``start`` and
    ``end`` (exclusive) in code points. Matches are taken leftmost and without
    overlap per kind; those that fail their check are dropped. The kinds in
    ``BASE`` are always kept; others need a score of ``CERTAIN``, which context
    words nearby may lift. Null texts are empty; rows are judged one by one, so
    ties and repeated rows have equal results and nulls elsewhere no effect.
    """
    d = rows(docs, doc_id="doc_id", text=F.coalesce("text", F.lit("")))
    d = d.withColumns({f"hits_{k.name}": F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)) for k in KINDS})
    d = d.withColumn("spans", F.array_sort(F.concat(*[_spans(number, kind) for number, kind in enumerate(KINDS)])))
    certain = F.filter("spans", lambda s: s["kind"].isin(*BASE) | (s["score"] >= CERTAIN))
    return d.select("row", "doc_id", certain.alias("spans"))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
