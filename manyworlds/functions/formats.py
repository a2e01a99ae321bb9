"""Templates for numbers and dates, intervals, bit strings, keyed hashes: what SQL has a type or a template language for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- templates --------------------------------------------------------------------------------------------------------

#: Date template patterns (fixed values) and the date format that gives the same.
PATTERNS = {
    "YYYY": "yyyy", "YY": "yy", "MM": "MM", "DDD": "DDD", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "Q": "q", "AM": "a", "PM": "a",
    "Month": "MMMM", "MONTH": "MMMM", "month": "MMMM", "Mon": "MMM", "MON": "MMM", "mon": "MMM", "Day": "EEEE", "DAY": "EEEE", "day": "EEEE", "Dy": "EEE", "DY": "EEE", "dy": "EEE",
}
_PIECE = re.compile("(FM)?(" + "|".join(sorted(PATTERNS, key=len, reverse=True)) + r')|"([^"]*)"|(.)', re.S)


def to_char(when: C, template: str) -> Column:
    """A date or time by a template such as ``Dy, DD Mon YYYY HH24:MI``. FM before a pattern drops its padding: names of
    months and days are padded to nine letters, numbers with zeros. Text in double quotes stands for itself."""
    t, out = _c(when).cast("timestamp"), []
    for m in _PIECE.finditer(template):
        bare, pattern, quoted, other = m.groups()
        if pattern is None:
            out.append(F.lit(quoted if quoted is not None else other))
            continue
        piece = F.quarter(t).cast("string") if pattern == "Q" else F.date_format(t, PATTERNS[pattern])
        if pattern.isupper() and PATTERNS[pattern][0] in "MEa" and pattern != "MM":
            piece = F.upper(piece)
        elif pattern.islower():
            piece = F.lower(piece)
        if PATTERNS[pattern] in ("MMMM", "EEEE") and not bare:
            piece = F.rpad(piece, 9, " ")
        elif bare and pattern[0] not in "MDd" or bare and pattern in ("MM", "DD", "DDD"):
            piece = F.regexp_replace(piece, r"^0+(?=\d)", "")
        out.append(piece)
    return F.concat(*out)


def to_timestamp(text: C, template: str) -> Column:
    """The time that a text states by a template; null for a text that doesn't fit."""
    parts = []
    for m in _PIECE.finditer(template):
        _, pattern, quoted, other = m.groups()
        literal = quoted if quoted is not None else other
        parts.append(PATTERNS[pattern] if pattern else "'" + literal.replace("'", "''") + "'" if literal.isalpha() else literal)
    return F.try_to_timestamp(_c(text), F.lit("".join(parts)))


def number_to_char(value: C, template: str) -> Column:
    """A number by a template of 9 (a digit or blank), 0 (a digit), a point and commas; one more place in front has the
    sign. A number that doesn't fit is all ``#``."""
    places = len(template.split(".")[1]) if "." in template else 0
    x = F.round(_c(value).cast("decimal(38,10)"), places)
    whole, zeros = template.split(".")[0], template.replace(",", "").split(".")[0]
    least = len(zeros) - zeros.index("0") if "0" in zeros else 0
    digits = F.regexp_replace(F.format_string("%s", F.floor(F.abs(x)).cast("string")), "^0$", "" if places else "0")
    digits = F.when(F.length(digits) < least, F.lpad(digits, max(least, 1), "0")).otherwise(digits)
    room = sum(c in "90" for c in whole)
    grouped = digits
    if "," in whole:
        grouped = F.regexp_replace(digits, r"(?<=\d)(?=(?:\d{3})+\z)", ",")
    fraction = F.concat(F.lit("."), F.substring_index(F.abs(x).cast(f"decimal(38,{places})").cast("string"), ".", -1)) if places else F.lit("")
    body = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), grouped, fraction)
    return F.when(x.isNull(), F.lit(None)).when(F.length(digits) > room, F.lit(" " + re.sub("[90]", "#", template))).otherwise(F.lpad(body, len(template) + 1, " "))


def to_number(text: C, scale: int = 10) -> Column:
    """The number in a text with group commas, blanks and a sign at either end; null if there is none."""
    bare = F.regexp_replace(_c(text), r"[,\s$]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^<(.*)>\z", "-$1"), r"^([0-9.]+)-\z", "-$1").try_cast(f"decimal(38,{scale})")


# --- intervals --------------------------------------------------------------------------------------------------------

DAY = 86_400_000_000


def interval(months: C | int = 0, days: C | int = 0, micros: C | int = 0) -> Column:
    """An interval as its three independent parts: STRUCT<months, days, micros>."""
    part = lambda x: (F.lit(x) if isinstance(x, int) else _c(x)).cast("bigint")
    return F.struct(part(months).alias("months"), part(days).alias("days"), part(micros).alias("micros"))


def _carried(low: Column, high: Column, size: int) -> tuple[Column, Column]:
    """Whole sizes of `low` moved up to `high`, towards zero."""
    moved = F.when(low < 0, -F.floor(-low / size)).otherwise(F.floor(low / size)).cast("bigint")
    return low - moved * size, high + moved


def justify_hours(iv: Column) -> Column:
    """24 hours are a day."""
    micros, days = _carried(iv["micros"], iv["days"], DAY)
    return interval(iv["months"], days, micros)


def justify_days(iv: Column) -> Column:
    """30 days are a month."""
    days, months = _carried(iv["days"], iv["months"], 30)
    return interval(months, days, iv["micros"])


def plus_interval(when: C, iv: Column) -> Column:
    """A time later by an interval: months first (the day is cut to the month's last), then days, then time."""
    t = _c(when)
    shifted = F.timestamp_add("MONTH", iv["months"].cast("int"), t)
    return F.timestamp_add("MICROSECOND", iv["micros"], F.timestamp_add("DAY", iv["days"].cast("int"), shifted))


def at_time_zone(when: C, zone: str) -> Column:
    """The zone-less clock time of an instant in a zone."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), _c(when).cast("timestamp_ntz"))


# --- bit strings ------------------------------------------------------------------------------------------------------


def bits_op(a: C, b: C, op: str) -> Column:
    """and, or, xor of two bit strings (texts of 0 and 1) of one length; null for unlike lengths."""
    x, y = F.split(_c(a), ""), F.split(_c(b), "")
    one = {"and": lambda p, q: (p == "1") & (q == "1"), "or": lambda p, q: (p == "1") | (q == "1"), "xor": lambda p, q: p != q}[op]
    joined = F.array_join(F.zip_with(x, y, lambda p, q: F.when(one(p, q), F.lit("1")).otherwise(F.lit("0"))), "")
    return F.when(F.length(_c(a)) == F.length(_c(b)), joined)


def bits_not(a: C) -> Column:
    return F.translate(_c(a), "01", "10")


def bits_shift(a: C, by: int) -> Column:
    """Moved to the left (to the right, if negative); the length stays, zeros come in."""
    v = _c(a)
    return F.rpad(F.substring(v, F.lit(by + 1), F.length(v)), F.length(v), F.lit("0")) if by >= 0 else F.substring(F.concat(F.lit("0" * -by), v), F.lit(1), F.length(v))


def bits_count(a: C) -> Column:
    return F.length(F.replace(_c(a), F.lit("0"), F.lit("")))


def bits_number(a: C) -> Column:
    """The number that up to 63 bits are."""
    return F.conv(_c(a), 2, 10).cast("bigint")


# --- keyed hashes, identifiers ----------------------------------------------------------------------------------------


def hmac_sha256(message: C, key: bytes) -> Column:
    """The keyed hash of a text or binary, in hexadecimal."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, _c(message).cast("binary")), 256))), 256)


def as_uuid(text: C) -> Column:
    """32 hexadecimal digits, whatever stands between them, in the usual form; null for another text."""
    digits = F.lower(F.regexp_replace(_c(text), "[-{}]", ""))
    return F.when(digits.rlike(r"^[0-9a-f]{32}\z"), F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5"))
