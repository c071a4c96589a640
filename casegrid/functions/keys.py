"""Identity keys: subject, duplicate, text and split keys, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subject_key(given: Column, family: Column, birth: Column, trim: bool = True) -> Column:
    """First 16 hex digits of sha256 over ``given|family|birth`` in lower case; null if the name or the birth date is missing."""
    names = [F.lower(F.trim(c)) if trim else F.lower(c) for c in (given, family)]
    there = given.isNotNull() & family.isNotNull() & birth.isNotNull() & (F.concat(given, family) != "") & (birth != "")
    return F.when(there, F.substring(F.sha2(F.concat_ws("|", *names, birth), 256), 1, 16))


def subject_key_long(given: Column, family: Column, birth: Column, code: Column | None = None) -> Column:
    """64 hex digits, family first, no separators; with a code it is the duplicate key."""
    parts = [F.lower(family), F.lower(given), birth] + ([code] if code is not None else [])
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def text_key(text: Column, digits: int = 64) -> Column:
    """sha256 of the text in lower case with white space collapsed and trimmed."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    return F.substring(F.sha2(F.lower(flat), 256), 1, digits)


def split_of(seed: str, row_id: Column, key: Column, share: float) -> Column:
    """'val' for about ``share`` of the rows, by the first 32 bits of a keyed hash; the same row always falls alike."""
    head = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), row_id.cast("string"), key), 256), 1, 8)
    return F.when(F.conv(head, 16, 10).cast("double") / F.lit(float(0xFFFFFFFF)) < F.lit(share), "val").otherwise("train")
