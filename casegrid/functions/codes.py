"""Code and name columns without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three inline code shapes, by bucket.
INLINE = {"snomed": r"\bSNOMED[\s:]+(\d{6,9})\b", "loinc": r"\bLOINC[\s:]+(\d{1,7}-\d)\b", "rxnorm": r"\bRxNorm[\s:]+(\d{2,9})\b"}


def inline_codes(text: Column, bucket: str) -> Column:
    """All codes of a kind, in order of their places, without context rules."""
    return F.regexp_extract_all(text, F.lit("(?i)" + INLINE[bucket]), F.lit(1))


def _present(c: Column) -> Column:
    return F.when(c != "", c)


def normal_code(bucket: str, value: Column) -> Column:
    """The raw code in a value that may carry display text, or null."""
    text = F.trim(value)
    text = F.when((text != "") & (F.lower(text) != "null"), text)
    safe = text.rlike("^[A-Za-z0-9.-]+$")
    if bucket == "conditions":
        found = _present(F.regexp_extract(text, r"\b(?:(?i:SNOMED(?:\s+CT)?\s*))?([0-9]{5,18})\b", 1))
        return F.when(text.rlike("^[0-9]+$"), text).otherwise(found)
    if bucket == "loincs":
        return F.coalesce(_present(F.regexp_extract(text, r"\b[0-9]{1,7}-[0-9]\b", 0)), F.when(safe & text.rlike("[0-9]"), text))
    if bucket == "rxnorms":
        found = _present(F.regexp_extract(text, r"\b(?:(?i:RXNORM\s*))?([0-9]{3,18})\b", 1))
        return F.when(text.rlike("^[0-9]+$"), text).otherwise(found)
    return F.when(safe, text)


def normal_codes(bucket: str, values: Column, ordered: bool = True) -> Column:
    """T21 (first-seen order) or T47 (sorted): different codes of an array of values."""
    clean = F.array_distinct(F.array_compact(F.transform(values, lambda v: normal_code(bucket, v))))
    return clean if ordered else F.array_sort(clean)


def tag_attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, in single or double quotes; null if absent."""
    both = F.regexp_extract(tag, rf"\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 1)
    other = F.regexp_extract(tag, rf"\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 2)
    return _present(F.concat(both, other))


def tags(text: Column, name: str) -> Column:
    """All opening tags of a name."""
    return F.regexp_extract_all(text, F.lit(rf"<{name}\b[^>]*>"), F.lit(0))


def name_and_code(value: Column) -> Column:
    """``Name (SYSTEM code)`` as struct(name, system, code); without the bracket all is name."""
    pattern = r"^(.*?)\s*\(([A-Za-z0-9-]+)[\s:]+([A-Za-z0-9.-]+)\)\s*$"
    hit = value.rlike(pattern)
    part = lambda k: F.when(hit, F.regexp_extract(value, pattern, k))
    return F.struct(F.coalesce(part(1), F.trim(value)).alias("name"), part(2).alias("system"), part(3).alias("code"))


def person(name: Column) -> Column:
    """struct(given, family), split at the first space."""
    parts = F.split(F.trim(name), " ", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("given"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("family"))


def place(address: Column) -> Column:
    """``City, ST ZIP`` as struct(city, state, zip)."""
    pattern = r"^\s*([^,]*),\s*(\S+)(?:\s+(\S+))?\s*$"
    return F.struct(*[F.regexp_extract(address, pattern, k).alias(n) for k, n in ((1, "city"), (2, "state"), (3, "zip"))])


def compact_date(value: Column) -> Column:
    """YYYYMMDD... to YYYY-MM-DD; anything else as it is."""
    return F.when(value.rlike("^[0-9]{8}"), F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2))).otherwise(value)


def age(birth: Column, on: Column) -> Column:
    """Whole years, adjusted for the birthday."""
    return F.floor(F.months_between(on, birth) / 12).cast("int")


def last_word(value: Column) -> Column:
    """The last white-space separated token."""
    return F.element_at(F.split(F.trim(value), r"\s+"), -1)
