"""Tokenizing whole documents with a public tokenizer, word by word with a bounded memory.

The tokenizer's own splitter never joins text across white space, so the ids of
a text are those of its white-space separated words in turn; each different
word is encoded by the library once. Strings of special tokens hold no white space, so
they too get the library's ids, alone or inside a word.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, remember: int = 700_000) -> "WordEncoder":
    """One encoder a worker; ``remember`` bounds each of its two generations of words (about 200 bytes a word)."""
    return WordEncoder(path, remember)


class WordEncoder:
    """When a generation of words is full, the one before it is forgotten."""

    def __init__(self, path: str, remember: int = 700_000):
        self.limit = remember
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        #: words that may hold a special token's string, in any case: the library looks for these strings in every word, which costs a quarter of its time
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        ws = text.encode("utf-8", "surrogatepass").split()
        known = self.known
        try:
            return b"".join([known[w] for w in ws])
        except KeyError:
            pass
        if len(known) > self.limit:
            self.known, self.older = known, older = {}, known
        else:
            older = self.older
        new = []
        for w in set(ws):
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        odd = [w for w in new if self.special.search(w.lower())] if self.special else []
        if odd:
            new = [w for w in new if w not in set(odd)]
        for words, plain in ((new, True), (odd, False)):
            self.tokenizer.encode_special_tokens = plain  # True: such strings, of which these words hold none, would be ordinary text
            for w, got in zip(words, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)):
                known[w] = np.asarray(got.ids, dtype="<u4").tobytes()
        return b"".join([known[w] for w in ws])
