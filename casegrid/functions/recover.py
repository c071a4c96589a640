"""JSON out of model output."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$")
_BARE_KEY = re.compile(r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)(\s*:)")
_CODE = re.compile(r'"code"\s*:\s*"([^"]+)"')


def _scan(text: str):
    """(position, character, depth after it, inside a string) from the first brace on."""
    stack: list[str] = []
    quoted = escaped = False
    for at in range(max(0, text.find("{")), len(text)):
        c = text[at]
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
        yield at, c, stack, quoted


def balanced(text: str | None) -> str | None:
    """Fences off, then the whole text if it is JSON, else its first balanced object if that is; null otherwise."""
    if not text:
        return None
    body = _FENCE.sub("", text.strip()) if text.strip().startswith("```") else text.strip()
    for candidate in (body, _first_object(body)):
        if candidate is not None:
            try:
                json.loads(candidate)
                return candidate
            except ValueError:
                pass
    return None


def _first_object(text: str) -> str | None:
    start = text.find("{")
    if start < 0:
        return None
    return next((text[start : at + 1] for at, c, stack, quoted in _scan(text) if c == "}" and not stack and not quoted), None)


def repaired(text: str | None) -> str | None:
    """What a cut-off object holds: open strings and brackets closed, dangling commas dropped, bare keys quoted; null if that is no JSON."""
    good = balanced(text)
    if good is not None or not text or "{" not in text:
        return good
    body = _FENCE.sub("", text.strip())
    stack, quoted = [], False
    for _, _, stack, quoted in _scan(body):
        pass
    tail = body[body.find("{") :] + ('"' if quoted else "")
    for attempt in (tail, re.sub(r",?\s*\"[^\"]*\"\s*:?\s*$", "", tail)):
        closed = re.sub(r"[,:]\s*$", "", attempt.rstrip()) + "".join(reversed(stack))
        fixed = _BARE_KEY.sub(r'\1"\2"\3', re.sub(r",(\s*[}\]])", r"\1", closed))
        try:
            json.loads(fixed)
            return fixed
        except ValueError:
            continue
    return None


def coded_pairs(text: str | None, around: int = 80) -> list[tuple[str, str | None, str | None]]:
    """(code, display, system) by pattern, where nothing parses; the system is named within ``around`` characters."""
    out = []
    for m in _CODE.finditer(text or ""):
        near = text[max(0, m.start() - around) : m.end() + around]
        display = re.search(r'"display"\s*:\s*"([^"]*)"', text[m.end() : m.end() + around])
        system = re.search(r"snomed|loinc|rxnorm", near, re.IGNORECASE)
        out.append((m.group(1), display.group(1) if display else None, system.group(0).lower() if system else None))
    return out


def recover(column: Column, repair: bool = True) -> Column:
    """T24 or, with ``repair``, T25, as an Arrow batch function over the texts that aren't an object as they are."""
    fn = repaired if repair else balanced

    @F.pandas_udf("string")
    def apply(texts):
        return texts.map(fn, na_action="ignore")

    whole = F.startswith(column, F.lit("{")) & F.endswith(column, F.lit("}")) & F.try_parse_json(column).isNotNull()
    return F.when(whole, column).otherwise(apply(F.when(~F.coalesce(whole, F.lit(False)), column)))


def outer_object(text: Column) -> Column:
    """From the first to the last brace."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def tool_calls(text: Column) -> Column:
    """Array of struct(name, arguments) from ``<tool_call>name{...}</tool_call>`` blocks; sentinel quotes become quotes, bare keys are quoted."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    clean = lambda b: F.regexp_replace(F.regexp_replace(b, r"<\|\"\|>", '"'), r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)(\s*:)", '$1"$2"$3')
    return F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(b, r"^\s*(?:call:)?\s*([A-Za-z_][A-Za-z0-9_]*)", 1)).alias("name"), F.regexp_extract(clean(b), r"(?s)\{.*\}", 0).alias("arguments")))
