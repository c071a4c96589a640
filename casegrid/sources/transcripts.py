"""Recorded server-sent event streams of chat completions.

A record is a JSON line ``{"transcript": id, "at_ms": milliseconds since the
request, "chunk": base64 of the bytes that arrived}``; the lines of a transcript
follow each other in order of arrival. Chunks may cut events, lines, line ends and
characters anywhere.

Rules: a line ``data: {...}`` is an event, ``data: [DONE]`` ends the transcript,
other lines and data that is no JSON are skipped (the latter counted); what stands
behind the last line end counts as a line, so a stream that broke off loses no more
than its last piece. ``ttft_ms`` is the arrival of the first event (of the last
chunk, where there is none), usage and speeds are those of the last event.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "transcript string, content string, ttft_ms double, total_ms double, prompt_tokens long, completion_tokens long, "
    "gen_tok_per_sec double, prompt_tok_per_sec double, events long, malformed long, complete boolean"
)
_LINE_END = re.compile(rb"\r\n|\n|\r")


class EventStream:
    """Lines and events of one transcript, put together from the chunks as they come."""

    def __init__(self) -> None:
        self.rest = b""
        self.content: list[str] = []
        self.first_ms: float | None = None
        self.last_ms = 0.0
        self.events = self.malformed = 0
        self.last: dict = {}
        self.done = False

    def feed(self, chunk: bytes, at_ms: float) -> None:
        self.last_ms = at_ms
        data = self.rest + chunk
        held = data[-1:] == b"\r"  # its line feed may come with the next chunk
        *lines, self.rest = _LINE_END.split(data[:-1] if held else data)
        self.rest += b"\r" * held
        for line in lines:
            self._line(line)

    def _line(self, line: bytes) -> None:
        if self.done or not line.startswith(b"data: "):
            return
        body = line[len(b"data: ") :].strip()
        if body == b"[DONE]":
            self.done = True
            return
        try:
            event = json.loads(body)
        except ValueError:
            event = None
        if not isinstance(event, dict):
            self.malformed += 1
            return
        self.events += 1
        if self.first_ms is None:
            self.first_ms = self.last_ms
        self.last = event
        choices = event.get("choices") or [{}]
        text = (choices[0].get("delta") or {}).get("content") if isinstance(choices[0], dict) else None
        if text:
            self.content.append(text)

    def row(self, transcript: str) -> dict:
        for line in _LINE_END.split(self.rest):
            self._line(line)
        usage, timings = self.last.get("usage") or {}, self.last.get("timings") or {}
        number = lambda x: float(x) if isinstance(x, int | float) else None
        return {
            "transcript": transcript, "content": "".join(self.content), "ttft_ms": self.last_ms if self.first_ms is None else self.first_ms, "total_ms": self.last_ms,
            "prompt_tokens": usage.get("prompt_tokens"), "completion_tokens": usage.get("completion_tokens"),
            "gen_tok_per_sec": number(timings.get("predicted_per_second")), "prompt_tok_per_sec": number(timings.get("prompt_per_second")),
            "events": self.events, "malformed": self.malformed, "complete": self.done,
        }


def transcripts(records: Iterable[tuple[str, int, bytes]]) -> Iterator[dict]:
    """A row for each transcript of (file, byte, line) records; memory holds one transcript's text."""
    stream, current = EventStream(), None
    for path, at, line in records:
        if not line.strip():
            continue
        try:
            record = json.loads(line)
            name, when, chunk = str(record["transcript"]), float(record["at_ms"]), base64.b64decode(record["chunk"], validate=True)
        except (ValueError, KeyError, TypeError, binascii.Error) as fault:
            raise ValueError(f"{path} at byte {at}: no record of a transcript: {fault!r}") from None
        if name != current:
            if current is not None:
                yield stream.row(current)
            stream, current = EventStream(), name
        stream.feed(chunk, when)
    if current is not None:
        yield stream.row(current)


def record_lines(chunks: DataFrame, transcript: Column, order: Column, at_ms: Column, chunk: Column) -> DataFrame:
    """The recorder's side: chunk rows as record lines (column value), a transcript's lines together and in order, for ``write.text``."""
    rows = chunks.select(transcript.cast("string").alias("transcript"), order.alias("o"), at_ms.cast("double").alias("at_ms"), F.base64(chunk.cast("binary")).alias("chunk"))
    dealt = rows.repartition("transcript").sortWithinPartitions("transcript", "o")
    return dealt.select(F.to_json(F.struct("transcript", "at_ms", "chunk")).alias("value"))
