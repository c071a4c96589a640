"""Language identification by compression.

A raw-content zstandard dictionary is made for each language from a bounded
sample of labelled text. A text is cut into blocks, each block is compressed
with every dictionary, and the language with the smallest total wins; narrow
margins are marked as rejected. Only letters and the marks that belong to them
(vowel signs, accents) count.

Defined results: a null text and a text without a letter give ``und`` with score
0 and ``rejected``; rows with a null language teach nothing; with nothing to
learn from, every text is ``und``. Ties go to the first language in order.
Repeated rows are predicted alike and teach once; an empty table gives no rows;
long texts are compressed block by block and take memory in proportion to the
longest alone; extra columns are carried along whatever their names, but one
that is named like a result column gives way to it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import CARRIED, carry, opened, tidy, widened

UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
#: pieces that a task remembers to drop their copies before the shuffle
SEEN = 200_000


@dataclass(frozen=True)
class Settings:
    #: bytes of sample text per language, and of all languages together: the bound of what training gathers and broadcasts
    dictionary_bytes: int = 112_640
    most_bytes: int = 33_554_432
    #: bytes of a training piece; pieces are drawn by the hash of their content
    piece_bytes: int = 1024
    #: bytes that are compressed at a time, so that a long text stays near the dictionary
    block_bytes: int = 4096
    level: int = 9
    #: the second-best total must exceed the best by this share and by two bytes, or the text is rejected
    margin: float = 0.01
    #: weight of a byte of difference in the score
    sharpness: float = 0.35


def normal(text: str) -> bytes:
    """Lower-case letters and marks, with one space for each run of anything else; nothing without a letter."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass") if _LETTER.search(text) else b""


def learn(labelled: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """A dictionary for each language of ``labelled`` (text, lang).

    One pass cuts the texts into pieces and keeps each different piece of a
    language once, by its hash; copies are dropped on the executors. From the
    bytes of different pieces each language gets the share that fills its
    dictionary, and only those pieces, about 1.3 dictionaries a language, reach
    the driver, each once.
    """
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")

    def cut(batches: Iterator[pa.RecordBatch], share: dict[str, float] | None) -> Iterator[pa.RecordBatch]:
        """lang, key, and the length of each piece, or the piece itself where the key is within the language's share."""
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            out: list[tuple] = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                most = (share.get(lang, 0.0) if share is not None else 1.0) * 2.0**64
                data = normal(text.as_py())
                for at in range(0, len(data), settings.piece_bytes):
                    piece = data[at : at + settings.piece_bytes]
                    key = xxhash.xxh64_intdigest(piece)
                    if key < most and (lang, key) not in seen:
                        seen.add((lang, key))
                        out.append((lang, key.to_bytes(8, "big"), len(piece) if share is None else piece))
            if len(seen) > SEEN:
                seen.clear()
            what = pa.int32() if share is None else pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], what)], ["lang", "key", "piece"])

    keyed = rows.mapInArrow(tidy(lambda batches: cut(batches, None)), "lang string, key binary, piece int")
    sizes = keyed.groupBy("lang", "key").agg(F.max("piece").alias("n")).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    if not sizes:
        return {}
    most = min(settings.dictionary_bytes, settings.most_bytes // len(sizes))
    share = {r["lang"]: min(1.0, 1.3 * most / max(1, r["n"])) for r in sizes}

    drawn: dict[str, dict[bytes, bytes]] = defaultdict(dict)
    for r in rows.mapInArrow(tidy(lambda batches: cut(batches, share)), "lang string, key binary, piece binary").groupBy("lang", "key").agg(F.min("piece").alias("piece")).collect():
        drawn[r["lang"]][bytes(r["key"])] = bytes(r["piece"])
    return {lang: b" ".join(piece for _, piece in sorted(found.items()))[:most] for lang, found in sorted(drawn.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], settings: Settings):
        self.settings = settings
        self.langs = sorted(dictionaries)
        self.coders = []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=settings.level)
            self.coders.append(zstandard.ZstdCompressor(level=settings.level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str | None) -> list[int] | None:
        data = normal(text) if text else b""
        if not data or not self.langs:
            return None
        step = self.settings.block_bytes
        blocks = [data[at : at + step] for at in range(0, len(data), step)]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected)."""
        sizes = self.sizes(text)
        if sizes is None:
            return UNKNOWN, 0.0, True
        best = min(range(len(sizes)), key=sizes.__getitem__)
        least = sizes[best]
        score = 1.0 / sum(math.exp(-self.settings.sharpness * min(500, n - least)) for n in sizes)
        second = min((n for k, n in enumerate(sizes) if k != best), default=2 * least + 2)
        return self.langs[best], score, second - least < max(2, self.settings.margin * least)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """The columns of ``docs`` but text, then lang_pred, score, rejected. One narrow pass, no shuffle.

    The dictionaries (``most_bytes`` in all at most) travel as a broadcast variable.
    """
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model.value, settings)
        for batch in batches:
            got = [classifier.predict(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*got)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())],
                [CARRIED, "lang_pred", "score", "rejected"],
            )

    rows = carry(docs)
    return opened(rows.mapInArrow(tidy(run), widened(rows, ("text",), "lang_pred string, score double, rejected boolean")), docs, ["lang_pred", "score", "rejected"])
