"""Text functions as column expressions. Offsets of stored chunks are UTF-16 units; everything here is by code point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"([.!?][\"')\]]*)\s+"
MARK = "\u0001"
#: English words that keyword search ignores.
STOPWORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so that the "
    "their them then there these they this to up was we were what when where which who will with you your"
).split()


def normalized(text: Column) -> Column:
    """Without one leading byte order mark, and with LF for CRLF."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n", "\n")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{FEFF}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def tokens(text: Column) -> Column:
    """Lower-case search tokens without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(STOPWORDS))


def is_blank(text: Column) -> Column:
    """Only white space, separators and control characters."""
    return text.rlike(r"(?U)^[\s\p{Z}\p{C}]*$")


def slug(text: Column) -> Column:
    """An anchor before duplicates are told apart."""
    base = F.replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}\p{Pc}\- ]", ""), F.lit(" "), F.lit("-"))
    return F.when(base == "", "section").otherwise(base)


def middle_cut(text: Column, most: int) -> Column:
    """At most so many characters, with an ellipsis in place of the middle."""
    keep = max(most - 1, 0)
    head = -(-keep // 2)
    tail = keep - head
    short = F.concat(F.substring(text, 1, head), F.lit("…"), F.right(text, F.lit(tail)) if tail else F.lit(""))
    return F.when(F.length(text) <= most, text).otherwise(short)


def sentences(text: Column) -> Column:
    """Sentences, cut after an end mark and its closing quotes."""
    return F.filter(F.split(F.regexp_replace(text, SENTENCE_END, "$1" + MARK), MARK), lambda s: s != "")


def ancestor_dirs(path: Column) -> Column:
    """a/b/c.md -> [a, a/b]; none for a file at the root."""
    parts = F.split(path, "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.size(parts) > 1, dirs).otherwise(F.array().cast("array<string>"))


def posix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def decoded_ref(ref: Column) -> Column:
    """A percent-encoded reference; a plus sign stays one."""
    return F.url_decode(F.replace(ref, F.lit("+"), F.lit("%2B")))


def quoted(text: Column) -> Column:
    """A block quote without leading blank lines."""
    lines = F.split(F.regexp_replace(text, r"^(?:[ \t]*\n)+", ""), "\n")
    return F.array_join(F.transform(lines, lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")


#: ISO dates, or date-times with a zone.
UPDATED_AT = r"^\d{4}-\d{2}-\d{2}(?:[T ](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d))?$"


def updated_at_ms(text: Column) -> Column:
    """Epoch milliseconds, null if text isn't a real ISO date or a date-time with a zone. Needs a session in UTC."""
    return F.when(text.rlike(UPDATED_AT), F.unix_millis(F.try_to_timestamp(F.replace(text, F.lit(" "), F.lit("T")))))


def day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def three_decimals(x: Column) -> Column:
    return F.format_string("%.3f", x)


def plain_number(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), text.cast("double"))
