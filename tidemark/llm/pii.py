"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

All of it is column expressions. Patterns use possessive repeats and start conditions that accept what the
plain pattern accepts, in time linear in the text. Positions are code points: the lengths of the pieces between
the matches and of the matches, added up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import documents, pick

#: How many characters before a match are looked through for context words.
NEAR = 48
#: Added kinds are reported from this score on; those of the base always are.
REPORTED = 0.5
SPAN = "struct<kind:string,start:long,end:long,score:double,value:string>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn: from the right, every second digit doubled, nines cast out."""
    values = F.transform(F.split(F.reverse(number), ""), lambda c: c.cast("int"))

    def worth(v: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2)

    return F.aggregate(F.transform(values, worth), F.lit(0), lambda acc, v: acc + v) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97: first four characters last, A = 10 to Z = 35."""
    text = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        return F.when(letter, acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + F.ascii(c) - 48) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add) == 1


def octets(value: Column) -> Column:
    """Four parts of at most 255 each; leading zeros do not count."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def whole(gap: Column) -> Column:
    """Whether a match does not go on from a letter, digit or dash before it."""
    return ~F.coalesce(F.right(gap, F.lit(1)).rlike("[A-Za-z0-9-]"), F.lit(False))


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: a text that every match holds, pattern, test of (match, text before), start score, context."""

    name: str
    holds: str
    pattern: str
    test: Callable[[Column, Column], Column]
    score: float
    context: str
    base: bool = True


KINDS = [
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda v, g: F.lit(True), 0.7, "mail|contact|write|reply"),
    Kind("ip", ".", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", lambda v, g: octets(v), 0.5, "ip|address|host|server|login"),
    Kind("card", "", r"[0-9](?:[\x20-]?[0-9])++",
         lambda v, g: F.length(digits(v)).between(16, 19) & luhn(digits(v)), 0.8, "card|visa|credit|payment|account"),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, g: F.length(digits(v)).between(8, 15), 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", "", r"[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})",
         lambda v, g: whole(g) & mod97(F.replace(v, F.lit(" "), F.lit(""))), 0.8, "iban|account|bank|konto", base=False),
    Kind("ssn", "-", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda v, g: whole(g), 0.2, "ssn|social security", base=False),
]


def spans_of(text: Column, kind: Kind) -> Column:
    """The confirmed spans of a kind: leftmost matches that do not overlap, failing ones dropped, no retries."""
    none = F.array().cast(f"array<{SPAN}>")
    gaps = F.split(text, kind.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))

    def add(acc: Column, piece: Column) -> Column:
        value, gap = piece["value"], piece["gap"]
        start = acc["at"] + F.length(gap)
        end = start + F.length(value)
        score = F.lit(kind.score) + F.when(F.lower(F.right(gap, F.lit(NEAR))).rlike(rf"\b(?:{kind.context})"), 0.3).otherwise(0.0)
        good = kind.test(value, gap) if kind.base else kind.test(value, gap) & (score >= REPORTED)
        score = F.least(score, F.lit(1.0))
        span = F.struct(
            F.lit(kind.name).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"),
            score.alias("score"), value.alias("value"),
        ).cast(SPAN)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(F.contains(text, F.lit(kind.holds)), found).otherwise(none) if kind.holds else found


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text", kinds: list[Kind] = KINDS) -> DataFrame:
    """doc_id and spans (kind, start, end, score, value), by kind as listed, then start, of every row.

    Null texts count as empty and have none; repeated rows stay; an empty table gives none; other columns are
    ignored. The work is within rows: no shuffle, whatever the data.
    """
    rows = pick(df, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.concat(*[spans_of(F.col("text"), kind) for kind in kinds]).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [k.name for k in KINDS if k.base]
    found = find(documents(spark, sf_dir))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    of_base = joined(F.filter("spans", lambda s: s["kind"].isin(base)))
    return found.select(
        "doc_id", *[count(name) for name in base], F.sha2(of_base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
