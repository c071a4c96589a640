"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per Python worker.

A text is split by the vocabulary's pattern; each different piece of a batch
becomes rows (piece, position, token) that join the merge table. A recursive
query contracts every piece's leftmost pair of least rank, again and again,
until no pair can merge. Decoding joins tokens with the vocabulary and
concatenates their bytes in order of position.

Pieces of more than ``WINDOW`` bytes are encoded as windows that overlap by
half. A sequence of tokens is the encoding of its bytes if and only if each two
neighbours are that of theirs (the first merge across the edge of a token would
also happen in these two alone), and neighbours inside a window are. So two
windows are joined at a token that both hold at the same place. Where they hold
none, the piece goes to windows eight times as wide, and after the widest to a
query over the whole piece, which contracts a pair at all its places at once
where nothing that the new token can merge with ranks below it. So rounds are
bounded by the window, and cost and memory grow in line with the piece.

Defined results: null and empty texts have no tokens and decode to no bytes;
special tokens in a text are ordinary text; a piece that is a token as a whole is
that token; repeated rows are encoded once each; ties of rank go to the leftmost
pair; an empty table gives no rows; columns other than doc_id and text are
ignored, whatever their names. Long texts take memory in proportion to the
longest text alone.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import tidy

#: Contracts one pair of each piece a round: its leftmost of least rank. ``best`` packs rank and place, so one minimum finds both.
ENCODE = """
WITH RECURSIVE rows(piece, pos, tok, done) AS (
    SELECT piece, pos, tok, false FROM start
  UNION ALL
    SELECT piece, pos, CASE WHEN pos = best & 1048575 THEN (best >> 20)::INTEGER ELSE tok END, best IS NULL
    FROM (
        SELECT *, min(candidate) OVER (PARTITION BY piece) AS best
        FROM (
            SELECT r.piece, r.pos, r.tok, r.before, (m.made::BIGINT << 20) | r.pos AS candidate
            FROM (
                SELECT piece, pos, tok, lead(tok) OVER w AS after, lag(pos) OVER w AS before
                FROM rows WHERE NOT done WINDOW w AS (PARTITION BY piece ORDER BY pos)
            ) r LEFT JOIN merges m ON m.l = r.tok AND m.r = r.after
        )
    )
    WHERE best IS NULL OR before IS NULL OR before <> best & 1048575
)
SELECT piece, tok FROM rows WHERE done ORDER BY piece, pos
"""

#: The same for a whole long piece, where a safe pair is contracted at all its places at once: every other one of a run that overlaps.
ENCODE_LONG = """
WITH RECURSIVE rows(piece, pos, tok, done) AS (
    SELECT piece, pos, tok, false FROM start
  UNION ALL
    SELECT piece, pos, CASE WHEN taken THEN best ELSE tok END, best IS NULL
    FROM (
        SELECT *, coalesce(lag(taken) OVER (PARTITION BY piece ORDER BY pos), false) AS gone
        FROM (
            SELECT *, hit AND (pos = leftmost OR (safe AND row_number() OVER (PARTITION BY piece, run ORDER BY pos) % 2 = 1)) AS taken
            FROM (
                SELECT *, min(CASE WHEN hit THEN pos END) OVER (PARTITION BY piece) AS leftmost,
                       CASE WHEN hit THEN row_number() OVER (PARTITION BY piece ORDER BY pos)
                            - count(CASE WHEN hit THEN 1 END) OVER (PARTITION BY piece ORDER BY pos) END AS run
                FROM (
                    SELECT *, coalesce(made = best, false) AS hit
                    FROM (
                        SELECT r.*, m.made, m.safe, min(m.made) OVER (PARTITION BY r.piece) AS best
                        FROM (SELECT piece, pos, tok, lead(tok) OVER (PARTITION BY piece ORDER BY pos) AS after FROM rows WHERE NOT done) r
                        LEFT JOIN merges m ON m.l = r.tok AND m.r = r.after
                    )
                )
            )
        )
    )
    WHERE NOT gone
)
SELECT piece, tok FROM rows WHERE done ORDER BY piece, pos
"""

DECODE = """
SELECT i.piece, string_agg(v.hex, '' ORDER BY i.pos) AS hex
FROM ids i JOIN vocabulary v ON v.tok = i.tok GROUP BY i.piece ORDER BY i.piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int], list[bool]]:
    """(left, right, merged, safe) of every pair of tokens whose bytes together are a token."""
    left, right, made = [], [], []
    least: dict[int, int] = {}
    for word, rank in ranks.items():
        for at in range(1, len(word)):
            a, b = ranks.get(word[:at]), ranks.get(word[at:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                made.append(rank)
                for part in (a, b):
                    least[part] = min(rank, least.get(part, rank))
    return left, right, made, [least.get(m, m + 1) > m for m in made]


class DuckBpe:
    #: pieces remembered at most; the memory is emptied beyond
    LIMIT = 1_200_000
    #: characters of text that are split before their new pieces are encoded
    GROUP = 4_000_000
    #: bytes of pieces that one query contracts
    BLOCK = 600_000
    #: bytes of the windows of long pieces, which overlap by half, narrowest first
    WINDOWS = (64, 512, 4096)
    #: bytes of pieces, ids and decoded texts that are remembered at most
    HELD = 250_000_000

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        ranks = read_ranks(path)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB"})
        self.db.execute("SET preserve_insertion_order = false")
        left, right, made, safe = merge_rows(ranks)
        self._table("merges", l=pa.array(left, pa.int32()), r=pa.array(right, pa.int32()), made=pa.array(made, pa.int32()), safe=pa.array(safe))
        self._table("vocabulary", tok=pa.array(list(ranks.values()), pa.int32()), hex=pa.array([w.hex() for w in ranks]))
        self.ranks = ranks
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.size[list(ranks.values())] = [len(w) for w in ranks]
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0

    def _table(self, name: str, **columns: pa.Array) -> None:
        rows = pa.table(columns)
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def contracted(self, pieces: list[bytes], query: str = ENCODE) -> list[np.ndarray]:
        """Tokens of each piece, ``BLOCK`` bytes a query."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(pieces):
            size, end = 0, at
            while end < len(pieces) and (size < self.BLOCK or end == at):
                size += len(pieces[end])
                end += 1
            block = pieces[at:end]
            sizes = np.array([len(p) for p in block], dtype=np.int64)
            number = np.repeat(np.arange(len(block), dtype=np.int32), sizes)
            pos = np.arange(len(number), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
            self._table("start", piece=pa.array(number), pos=pa.array(pos), tok=pa.array(self.single[np.frombuffer(b"".join(block), np.uint8)]))
            got = self.db.execute(query).fetchnumpy()
            piece, tok = np.asarray(got["piece"]), np.asarray(got["tok"])
            out += np.split(tok, np.searchsorted(piece, np.arange(1, len(block))))
            at = end
        return out

    def encode_long(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Tokens of long pieces, by windows; see the module's text."""
        done: dict[int, np.ndarray] = {}
        for width in self.WINDOWS:
            left = [k for k in range(len(pieces)) if k not in done]
            windows: dict[bytes, np.ndarray] = {}
            for k in left:
                for at in range(0, len(pieces[k]), width // 2):
                    windows.setdefault(pieces[k][at : at + width])
            listed = sorted(windows)
            windows = dict(zip(listed, self.contracted(listed)))
            for k in left:
                joined = self.joined(pieces[k], width, windows)
                if joined is not None:
                    done[k] = joined
        rest = [k for k in range(len(pieces)) if k not in done]
        for k, tokens in zip(rest, self.contracted([pieces[k] for k in rest], ENCODE_LONG)):
            done[k] = tokens
        return [done[k] for k in range(len(pieces))]

    def joined(self, piece: bytes, width: int, windows: dict[bytes, np.ndarray]) -> np.ndarray | None:
        tokens, ends = windows[piece[:width]].tolist(), []
        at = 0
        for t in tokens:
            at += int(self.size[t])
            ends.append(at)
        for start in range(width // 2, len(piece), width // 2):
            if ends[-1] >= len(piece):
                break
            new = windows[piece[start : start + width]]
            stop = start + np.cumsum(self.size[new])
            here = {(e - int(self.size[t]), e): k for k, (t, e) in enumerate(zip(new.tolist(), stop.tolist()))}
            for k in range(len(tokens) - 1, -1, -1):
                begin = ends[k] - int(self.size[tokens[k]])
                if begin < start:
                    return None
                if (same := here.get((begin, ends[k]))) is not None:
                    break
            else:
                return None
            del tokens[k + 1 :], ends[k + 1 :]
            tokens += new[same + 1 :].tolist()
            ends += stop[same + 1 :].tolist()
        return np.array(tokens, dtype=np.int32)

    def decode_pieces(self, pieces: list[np.ndarray]) -> list[bytes]:
        number = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(p) for p in pieces])
        tokens = np.concatenate(pieces) if pieces else np.empty(0, np.int32)
        self._table("ids", piece=pa.array(number), pos=pa.array(np.arange(len(number), dtype=np.int32)), tok=pa.array(tokens.astype(np.int32)))
        got = dict(self.db.execute(DECODE).fetchall())
        return [bytes.fromhex(got.get(k, "")) for k in range(len(pieces))]

    def learn(self, pieces: list[str]) -> None:
        """Encode and decode pieces that are not yet known."""
        kinds: tuple[list[bytes], list[bytes], list[bytes]] = [], [], []
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            kinds[0 if data in self.ranks else 1 if len(data) <= self.WINDOWS[0] else 2].append(data)
        self.remember(kinds[0], [np.array([self.ranks[d]], np.int32) for d in kinds[0]])
        self.remember(kinds[1], self.contracted(kinds[1]))
        long, size = [], 0
        for data in kinds[2]:
            long.append(data)
            size += len(data)
            if size > self.BLOCK:
                self.remember(long, self.encode_long(long))
                long, size = [], 0
        self.remember(long, self.encode_long(long))

    def remember(self, pieces: list[bytes], tokens: list[np.ndarray]) -> None:
        for at in range(0, len(pieces), 100_000):
            part = tokens[at : at + 100_000]
            for data, ids, back in zip(pieces[at : at + 100_000], part, self.decode_pieces(part)):
                self.known[data.decode("utf-8", "surrogatepass")] = (ids.astype("<u4").tobytes(), back)
                self.held += 2 * len(data) + 4 * len(ids)

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, bytes decoded from them) of each text, ``GROUP`` characters at a time."""
        group: list[list[str]] = []
        size = 0
        for k, text in enumerate(texts):
            group.append(self.split(text))
            size += len(text)
            if size >= self.GROUP or k == len(texts) - 1:
                if len(self.known) > self.LIMIT or self.held > self.HELD:
                    self.known.clear()
                    self.held = 0
                known = self.known
                self.learn(sorted({p for pieces in group for p in pieces if p not in known}))
                for pieces in group:
                    got = [known[p] for p in pieces]
                    yield b"".join([g[0] for g in got]), b"".join([g[1] for g in got])
                group, size = [], 0


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> DuckBpe:
    return DuckBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = True) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, or (``digests`` off) the ids and bytes themselves.

    One narrow pass over ``doc_id, text``, no shuffle.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            counts, ids, back = [], [], []
            for a, b in bpe.encode_texts([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(a) // 4)
                ids.append(hashlib.sha256(a).hexdigest() if digests else a)
                back.append(hashlib.sha256(b).hexdigest() if digests else b)
            sort = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, sort), pa.array(back, sort)], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    out = "string" if digests else "binary"
    schema = f"doc_id {kind}, n_tokens long, {names[2]} {out}, {names[3]} {out}"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)
