"""Column functions: time formats, numbers as text, paths, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_z(ts: Column) -> Column:
    """``2023-01-01T12:00:00Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def offset_text(ts: Column) -> Column:
    """``2023-01-01 12:00:00+00:00``."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))


def parse_iso(text: Column) -> Column:
    """ISO-8601 text with ``Z`` or an offset, as a timestamp; null where it is malformed."""
    return F.try_to_timestamp(text)


def fixed2(x: Column) -> Column:
    """Two decimals, as text."""
    return F.format_string("%.2f", F.round(x, 2))


def last_part(path: Column, separator: str = "/") -> Column:
    return F.element_at(F.split(path, separator), -1)


def capitalise(text: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, (1 << 31) - 1))


def json_field(doc: Column, name: str, kind: str) -> Column:
    """A field of JSON text, null where the text or the field is malformed."""
    return F.get_json_object(doc, f"$.{name}").try_cast(kind)


def is_json(doc: Column) -> Column:
    """Whether text is a JSON value."""
    return F.try_parse_json(doc).isNotNull()


def route_hash(key: Column, parts: int) -> Column:
    """Stable part number of a key: the first eight hexadecimal digits of its md5, as any engine can compute them."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(parts)).cast("int")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def rstrip(text: Column, characters: str = "\r\n") -> Column:
    """Without any of these characters at the end."""
    return F.rtrim(text, F.lit(characters))
