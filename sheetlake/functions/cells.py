"""Cleaning and typing of cell text, as column expressions.

Blank text gives neither a value nor an error.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that trimming removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Accepted spellings and error texts.
TRUE_WORDS = ("true", "yes", "1")
FALSE_WORDS = ("false", "no", "0")
BAD_NUMBER = "Invalid number value"
BAD_BOOLEAN = "Invalid boolean value"
BAD_DATE = "Invalid date value"
# Decimal number shapes, day zero of spreadsheet serials
# (1899-12-30) and the widest date, both in milliseconds from 1970.
NUMBER_SHAPE = r"^[+-]?(Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"
SERIAL_EPOCH_MS = -2209161600000
MAX_DATE_MS = 8640000000000000
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
ISO_TIME = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?"
            r"(Z|[+-][0-9]{2}:?[0-9]{2})?$")
ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"
US_DATE = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
NAMED_DATE = r"^(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* ([0-9]{1,2}), ([0-9]{4})$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim Unicode whitespace at both ends; null stays null."""
    return F.btrim(_col(c).cast("string"), F.lit(WHITESPACE))


def trim_text(c) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def blank_to_null(c) -> Column:
    return F.nullif(strip(c), F.lit(""))


def outcome(text: Column, value: Column, message: Column) -> Column:
    """Error text: there was something to read, and it gave no value."""
    return F.when(text.isNotNull() & value.isNull(), message)


class Kind(NamedTuple):
    """How trimmed text becomes a value, and what is said when it does not.

    ``convert`` takes the text and what ``prepare`` made of it; preparing apart
    lets the caller compute it once, where ``convert`` uses it several times.
    """

    convert: Callable[[Column, Column], Column]
    message: Callable[[Column], Column]
    prepare: Callable[[Column], Column] = lambda text: text


def number_or_null(text: Column) -> Column:
    """Double for text of a plain decimal shape, null for anything else."""
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))


def without_money_signs(text: Column) -> Column:
    bare = F.replace(F.replace(text, F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    return strip(bare)


def boolean_or_null(word: Column) -> Column:
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def serial_to_timestamp(number: Column) -> Column:
    """Spreadsheet serial day number to a zone-free timestamp, whole milliseconds."""
    ms = F.lit(float(SERIAL_EPOCH_MS)) + number * 24 * 60 * 60 * 1000
    whole = F.when(F.abs(ms) <= MAX_DATE_MS, ms).cast("bigint")
    return F.timestamp_add("MILLISECOND", whole, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def text_to_timestamp(text: Column) -> Column:
    """ISO dates and date-times, ``M/d/yyyy`` and ``MMM d, yyyy``; without a zone means UTC."""
    local = F.regexp_replace(F.regexp_replace(text, ZONE, ""), r"(\.[0-9]{3})[0-9]+$", "$1")
    zone = F.replace(F.regexp_extract(text, ZONE, 1), F.lit(":"), F.lit(""))
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    shift = F.when(zone.startswith("+"), -minutes).when(zone.startswith("-"), minutes).otherwise(F.lit(0))
    month = ((F.position(F.lower(F.regexp_extract(text, NAMED_DATE, 1)), F.lit(MONTHS)) + 2) / 3).cast("int")
    named = F.concat_ws("-", F.regexp_extract(text, NAMED_DATE, 3), month.cast("string"),
                        F.regexp_extract(text, NAMED_DATE, 2))
    return (
        F.when(text.rlike(ISO_DATE), text.try_cast("timestamp_ntz"))
        .when(text.rlike(ISO_TIME), F.timestamp_add("MINUTE", shift, local.try_cast("timestamp_ntz")))
        .when(text.rlike(US_DATE), F.regexp_replace(text, US_DATE, "$3-$1-$2").try_cast("timestamp_ntz"))
        .when(text.rlike(NAMED_DATE), named.try_cast("timestamp_ntz"))
    )


def date_or_null(text: Column, number: Column) -> Column:
    """Numeric text is a serial; other text goes through the fixed list of date forms."""
    return F.coalesce(serial_to_timestamp(number), text_to_timestamp(text))


def iso_text(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:mm:ss.sssZ``; years outside 0-9999 take a sign and six digits."""
    text = ts.cast("timestamp_ntz").cast("string")  # free of the session's zone
    day, time = F.substring_index(text, " ", 1), F.substring_index(text, " ", -1)
    year = F.year(ts.cast("timestamp_ntz"))
    shown = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(
        F.concat(F.when(year < 0, F.lit("-")).otherwise(F.lit("+")),
                 F.lpad(F.abs(year).cast("string"), 6, "0")))
    return F.concat(shown, F.right(day, F.lit(6)), F.lit("T"), F.substring(time, 1, 8), F.lit("."),
                    F.rpad(F.substring(time, 10, 3), 3, "0"), F.lit("Z"))


KINDS = {
    "text": Kind(lambda text, _: text, lambda _: F.lit(None).cast("string")),
    "number": Kind(lambda _, bare: number_or_null(bare), lambda _: F.lit(BAD_NUMBER), without_money_signs),
    "boolean": Kind(lambda _, word: boolean_or_null(word), lambda _: F.lit(BAD_BOOLEAN), F.lower),
    "date": Kind(date_or_null, lambda _: F.lit(BAD_DATE), number_or_null),
}


def kind_of(name: str | None) -> Kind:
    """Any kind other than date, number or boolean is text."""
    return KINDS.get(name or "text", KINDS["text"])
