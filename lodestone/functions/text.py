"""Column functions over strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def color_of(ident: Column) -> Column:
    """A colour for an id: the last six hexadecimal digits of its SHA-256 sum."""
    return F.concat(F.lit("#"), F.right(F.sha2(ident.cast("string").cast("binary"), 256), F.lit(6)))


def symbols(text: Column) -> Column:
    """Tokens in braces, in order."""
    return F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0))


def tokens(text: Column) -> Column:
    """Tokens in braces and single characters between them. A brace that nothing closes is a character."""
    return F.regexp_extract_all(text, F.lit(r"\{[^}]*\}|[\s\S]"), F.lit(0))


def or_default(value: Column, default: str) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def numbered(prefix: str, i: Column) -> Column:
    return F.format_string(prefix + "_%04d", i)


def truthy(text: Column) -> Column:
    return F.lower(text).isin("y", "yes", "true")


def joined_known(sep: str, *parts: Column) -> Column:
    """Parts that are not null, joined."""
    return F.concat_ws(sep, *parts)


def js_round(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def label_line(label: Column, points: Column, size: float = 640.0) -> Column:
    """'label x1 y1 ...' with coordinates as shares of the image size, to ten digits."""
    return F.concat_ws(" ", label.cast("string"), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", F.format_string("%.10f", p["x"] / size), F.format_string("%.10f", p["y"] / size))), " "))


def base64_text(raw: Column) -> Column:
    """Without line breaks, whatever the session's setting for them."""
    return F.translate(F.base64(raw), "\r\n", "")


def unless_none(word: Column) -> Column:
    """Null for the words none and no, in any case."""
    return F.when(~F.lower(word).isin("none", "no"), word)


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def uuid(text: Column) -> Column:
    """Lower case with dashes, from 32 hexadecimal digits with or without dashes, braces and outer blanks; else null."""
    digits = F.regexp_replace(F.lower(F.trim(text)), r"^\{|\}$|-", "")
    dashed = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), dashed)


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; of keys that both have, the right one's values."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)
