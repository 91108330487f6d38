"""Column functions: names, text helpers, formats. All native, all inside codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tidemark import rules

SPACE = r"[\s\p{Z}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _identifier(c, digit_prefix: str) -> Column:
    s = F.regexp_replace(_col(c).cast("string"), "[^a-zA-Z0-9_]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_{2,}", "_"), "^_|_$", "")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit(digit_prefix), s)).otherwise(s)


def _or_default(s: Column, default: str) -> Column:
    return F.when(s.isNull() | (s == ""), F.lit(default)).otherwise(s)


def clean_table_name(c) -> Column:
    return _or_default(F.substring(_identifier(c, "table_"), 1, 50), "unnamed_table")


def clean_column_name(c) -> Column:
    return _or_default(F.substring(_identifier(c, "col_"), 1, 50), "unnamed_column")


def clean_identifier(c, default: str = "unnamed_column") -> Column:
    return F.lower(_or_default(_identifier(c, "col_"), default))


def truncate_text(c, max_length: int = 100, suffix: str = "...") -> Column:
    c = _col(c)
    cut = F.concat(F.substring(c, 1, max_length - len(suffix)), F.lit(suffix))
    return F.when(F.length(c) > max_length, cut).otherwise(c)


def clip(c, n: int) -> Column:
    """First ``n`` characters plus ``...`` when anything was cut off."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def format_file_size(c) -> Column:
    size = _col(c).cast("double")
    out = F.when(size == 0, F.lit("0B"))
    units = ["B", "KB", "MB", "GB"]
    for i, unit in enumerate(units):
        scaled = F.round(size / F.lit(float(1024**i)), 2).cast("string")
        out = out.when(size < float(1024 ** (i + 1)), F.concat(scaled, F.lit(f" {unit}")))
    top = F.round(size / F.lit(float(1024**4)), 2).cast("string")
    return out.when(size.isNotNull(), F.concat(top, F.lit(" TB")))


def format_duration(c) -> Column:
    """Seconds as text. Ties in the last digit go by the decimal value, upwards."""
    s = _col(c).cast("double")
    whole = lambda x: F.floor(x).cast("string")
    return (
        F.when(s < 1, F.concat(F.round(s * 1000, 0).cast("bigint").cast("string"), F.lit("ms")))
        .when(s < 60, F.concat(F.round(s, 1).cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(whole(s / 60), F.lit("m "), whole(s % 60), F.lit("s")))
        .when(
            s.isNotNull(),
            F.concat(whole(s / 3600), F.lit("h "), whole((s % 3600) / 60), F.lit("m")),
        )
    )


def sanitize_filename(c) -> Column:
    s = F.regexp_replace(_col(c), r'[<>:"/\\|?*]', "_")
    s = F.regexp_replace(s, r"^[. ]+|[. ]+$", "")
    has_ext = F.contains(s, F.lit("."))
    ext = F.when(has_ext, F.substring_index(s, ".", -1)).otherwise(F.lit(""))
    name = F.when(has_ext, s.substr(F.lit(1), F.length(s) - F.length(ext) - 1)).otherwise(s)
    room = F.when(ext == "", F.lit(255)).otherwise(254 - F.length(ext))
    keep = F.when(room >= 0, room).otherwise(F.greatest(F.length(name) + room, F.lit(0)))
    tail = F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("."), ext))
    return F.when(F.length(s) > 255, F.concat(name.substr(F.lit(1), keep), tail)).otherwise(s)


def words_of(c) -> Column:
    """Lower-case ASCII words of three letters or more, bounded by non-word characters."""
    tokens = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(tokens, lambda w: w.rlike("^[a-z]{3,}$"))


def extract_keywords(c, min_length: int = 3, max_keywords: int = 10) -> Column:
    stop = F.array(*[F.lit(w) for w in rules.KEYWORD_STOP_WORDS])
    words = F.filter(
        words_of(c), lambda w: (F.length(w) >= min_length) & ~F.array_contains(stop, w)
    )
    return F.slice(F.array_distinct(words), 1, max_keywords)


CONNECTION = r"^(\w+)://(?:([^:]+):([^@]+)@)?([^:/]+)(?::(\d+))?/(.+)"


def parse_connection_string(c) -> Column:
    """Struct of driver, username, password, host, port, database; null when malformed."""
    c = _col(c)
    part = lambda i: F.regexp_extract(c, CONNECTION, i)
    fields = F.struct(
        part(1).alias("driver"),
        part(2).alias("username"),
        part(3).alias("password"),
        part(4).alias("host"),
        part(5).try_cast("int").alias("port"),
        part(6).alias("database"),
    )
    return F.when(c.rlike(CONNECTION), fields)


def validate_email(c) -> Column:
    return _col(c).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def normalize_text(c) -> Column:
    s = F.regexp_replace(F.lower(_col(c)), r"[_\-.]+", " ")
    return F.coalesce(F.regexp_replace(F.regexp_replace(s, SPACE, " "), "^ | $", ""), F.lit(""))


def generate_slug(c, max_length: int = 50) -> Column:
    s = F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}_\s\p{Z}-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s\p{Z}_-]+", "-"), "^-|-$", "")
    return F.coalesce(F.regexp_replace(F.substring(s, 1, max_length), "-$", ""), F.lit(""))


def safe_json_loads(c, default: str | None = None) -> Column:
    """JSON text as a variant; ``default`` (JSON text) where it does not parse."""
    parsed = F.try_parse_json(_col(c))
    return parsed if default is None else F.coalesce(parsed, F.parse_json(F.lit(default)))


def safe_json_dumps(c, default: str = "{}") -> Column:
    return F.coalesce(F.to_json(_col(c)), F.lit(default))


def format_timestamp(c, pattern: str = "yyyy-MM-dd HH:mm:ss 'UTC'") -> Column:
    return F.coalesce(F.date_format(_col(c), pattern), F.lit(""))


def sha256_hex(c) -> Column:
    return F.sha2(_col(c).cast("string"), 256)


def qualified_name(*parts) -> Column:
    return F.concat_ws(".", *[_col(p) for p in parts])


def mask_sensitive(c, visible: int = 4, mask: str = "*") -> Column:
    c = _col(c)
    n = F.length(c)
    tail = F.when(n > visible, F.substring(c, -visible, visible)).otherwise(F.lit(""))
    hidden = F.when(n > visible, n - visible).otherwise(n)
    return F.coalesce(F.concat(F.repeat(F.lit(mask), hidden), tail), F.lit(""))


def title_case(c) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(_col(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    cased = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))
    )
    return F.array_join(cased, "")


def contains_any(c, words) -> Column:
    """True when any of the given literal words is a substring: one pattern, so the plan stays small."""
    return _col(c).rlike("|".join(re.escape(w) for w in words))


def first_rule(c, rule_list) -> Column:
    """Name of the first rule with a word inside ``c``; null when none fits."""
    out = None
    for name, words in rule_list:
        hit = contains_any(c, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def mean(c, digits: int) -> Column:
    """Average to ``digits`` decimals. The first rounding takes out what the order of summation adds,
    so that a tie in the last digit is always seen as one and goes up."""
    return F.round(F.round(F.avg(_col(c)), 9), digits)
