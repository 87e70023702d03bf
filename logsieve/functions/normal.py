"""Normal forms of single log fields. A null result means that the value is rejected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MAX_MESSAGE, MAX_SERVICE
from .text import short_digest, strip

# Fixed value: epochs below this count as seconds, others as milliseconds.
SECONDS_BELOW = 32503680000
# Other spellings of levels.
LEVEL_ALIASES = {
    "DEBUG": "DEBUG", "INFO": "INFO", "WARNING": "WARNING", "WARN": "WARNING", "ERROR": "ERROR", "ERR": "ERROR",
    "CRITICAL": "CRITICAL", "CRIT": "CRITICAL", "FATAL": "CRITICAL",
}
_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}([T]\d{1,2}:\d{1,2}:\d{1,2}([.]\d{1,6}Z?|Z)?|[ ]\d{1,2}:\d{1,2}:\d{1,2})$"
#: Blanks inside messages; written out so that every engine agrees on it.
MESSAGE_BLANKS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def timestamp(c: Column) -> Column:
    """Epoch seconds or milliseconds, or one of five ISO forms in UTC; offsets are rejected."""
    s = strip(c)
    number = F.when(s.rlike(_NUMBER), s.try_cast("double"))
    micros = F.when(number < SECONDS_BELOW, number * 1e6).otherwise(number * 1e3)
    epoch = F.timestamp_micros(F.round(micros).try_cast("bigint")).cast("timestamp_ntz")
    # The cast reads every accepted form, and more; it neither uses a formatter nor throws.
    return F.when(s.rlike(_ISO), s.try_cast("timestamp_ntz")).otherwise(epoch)


def level(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LEVEL_ALIASES.items() for x in pair))
    return F.try_element_at(known, F.upper(strip(c)))


def service(c: Column) -> Column:
    """Lower case, at most 128 characters, of which letters, digits, '-', '_' and '.' stay."""
    cut = F.substring(strip(F.lower(c)), 1, MAX_SERVICE)
    return F.nullif(F.regexp_replace(cut, r"[^\p{L}\p{N}\-_.]", ""), F.lit(""))


def message(c: Column) -> Column:
    flat = F.regexp_replace(c, MESSAGE_BLANKS, " ")
    return F.nullif(F.substring(F.btrim(flat), 1, MAX_MESSAGE), F.lit(""))


def message_hash(normal_message: Column) -> Column:
    return short_digest(normal_message)


def duration(c: Column) -> Column:
    """Whole milliseconds; zero, negative and unreadable values are null, 0.5 is 0."""
    d = strip(c.cast("string")).try_cast("double")
    return F.when((d > 0) & (d < 9e18), F.floor(d).cast("bigint"))


def trimmed(c: Column, most: int) -> Column:
    return F.substring(strip(F.nullif(c, F.lit(""))), 1, most)
