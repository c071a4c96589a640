"""Quality rules, line first.

Every line is judged by punctuation, navigation and boilerplate rules; failing
lines are removed, and a document that loses too much of its text is rejected.

Defined results: a null or empty text has no words and is rejected (fewer than
``min_words`` words); blank lines are neither judged nor counted; a repeated
row is judged by itself, equal texts alike; a line may fail by several rules and
is removed once; an empty table gives no rows; long texts take memory in
proportion to the longest alone; extra columns are ignored by ``clean_lines`` and
carried along by ``clean_documents`` whatever their names, but one that is named
like a result column gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casegrid.llm.common import CARRIED, WHITE, carry, opened, tidy, widened, words

#: Phrases that mark a line as boilerplate, in English, French, German and Spanish.
BOILERPLATE = (
    "javascript is disabled",
    "enable javascript",
    "cookie policy",
    "accept cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "lorem ipsum",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "click here to",
    "powered by wordpress",
    "skip to content",
    "activer javascript",
    "javascript est désactivé",
    "politique de cookies",
    "accepter les cookies",
    "politique de confidentialité",
    "conditions d'utilisation",
    "conditions générales",
    "mentions légales",
    "tous droits réservés",
    "abonnez-vous à notre newsletter",
    "inscrivez-vous à notre newsletter",
    "cliquez ici pour",
    "propulsé par wordpress",
    "aller au contenu",
    "javascript ist deaktiviert",
    "javascript aktivieren",
    "cookie-richtlinie",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "allgemeine geschäftsbedingungen",
    "alle rechte vorbehalten",
    "newsletter abonnieren",
    "klicken sie hier",
    "hier klicken, um",
    "zum inhalt springen",
    "javascript está desactivado",
    "active javascript",
    "política de cookies",
    "aceptar cookies",
    "política de privacidad",
    "términos de uso",
    "condiciones de uso",
    "aviso legal",
    "todos los derechos reservados",
    "suscríbete a nuestro boletín",
    "suscríbase a nuestro boletín",
    "haz clic aquí",
    "haga clic aquí",
    "saltar al contenido",
)
#: Words that make up navigation lines, in the same languages.
NAVIGATION = (
    "home", "about", "contact", "login", "logout", "menu", "search", "next", "previous", "share", "tweet", "sitemap", "faq", "help",
    "accueil", "propos", "connexion", "déconnexion", "recherche", "rechercher", "suivant", "précédent", "partager", "aide", "plan", "panier",
    "startseite", "über", "kontakt", "anmelden", "abmelden", "menü", "suche", "weiter", "zurück", "teilen", "hilfe", "impressum", "warenkorb",
    "inicio", "acerca", "contacto", "entrar", "salir", "menú", "buscar", "siguiente", "anterior", "compartir", "ayuda", "mapa", "carrito",
)
_NAVIGATION = frozenset(w.encode() for w in NAVIGATION)
#: Fixed value: the symbol characters that the base counts look for.
SYMBOLS = b"#*$%&|<>"


#: documents that leave together
SLICE = 1000


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: share of a line's words that may carry two or more symbol or exclamation marks
    max_noisy: float = 0.3
    #: separators (``|``, ``>``, bullets) per word from which a line is navigation
    max_separators: float = 0.15
    #: a line of more words than this must hold sentence punctuation somewhere
    unpunctuated_words: int = 40
    #: share of a line's words that may equal the word before
    max_stutter: float = 0.3
    #: share of word characters that may go with removed lines
    max_lost: float = 0.5


NOISY = re.compile(rb"[#*$%&|<>!?]{2,}|^[#*$%&|<>]+$")
SEPARATORS = (b"|", b">", b"\xc2\xbb", b"\xe2\x80\xa2", b"\xc2\xb7")
PUNCTUATION = re.compile(rb"[.!?;:,\x22\x27)]|\xe2\x80\xa6|\xc2\xbb|\xe3\x80\x82")
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())


def lowered(data: bytes) -> bytes:
    return data.lower() if data.isascii() else data.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")


def failing_rule(line: bytes, ws: list[bytes], rules: Rules) -> str | None:
    """Name of the first rule that a line with words breaks, or None."""
    n = len(ws)
    if sum(w in SEPARATORS for w in ws) >= max(2, rules.max_separators * n):
        return "navigation"
    if n <= 12 and sum(lowered(w.strip(b"|>:,.")) in _NAVIGATION for w in ws) * 2 > n:
        return "navigation"
    if (b"!" in line or len(line.translate(None, SYMBOLS)) != len(line)) and sum(NOISY.search(w) is not None for w in ws) > rules.max_noisy * n:
        return "punctuation"
    if n > rules.unpunctuated_words and not PUNCTUATION.search(line):
        return "punctuation"
    if n >= 8 and sum(a == b for a, b in zip(ws, ws[1:])) > rules.max_stutter * n:
        return "boilerplate"
    if _BOILER.search(lowered(line)):
        return "boilerplate"
    return None


def repeated_words(ws: list[bytes], width: int = 5) -> int:
    """Words inside ``width``-word windows that occur twice or more, each word once."""
    n = len(ws) - width + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in ws), dtype=np.uint64, count=len(ws))
    span = len(index) + 1
    if span**width < 2**64:
        key = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            key = key * np.uint64(span) + ids[k : k + n]
    else:  # too many different words to pack: rank the windows word by word
        key = ids[:n]
        for k in range(1, width):
            key = np.unique(key * np.uint64(span) + ids[k : k + n], return_inverse=True)[1].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(ws) + 1, dtype=np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def judge(text: str | None, rules: Rules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, n_lines, n_bad_lines, cleaned)."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    ws = data.split()
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    repeats = lines = bad = lost = 0
    keep: list[bytes] = []
    for line in data.split(b"\n"):
        tokens = line.split()
        if not tokens:
            keep.append(line)
            continue
        lines += 1
        if line in seen:
            repeats += 1
        seen.add(line)
        if failing_rule(line, tokens, rules):
            bad += 1
            body = b"".join(tokens)
            lost += len(body) if body.isascii() else len(body.decode("utf-8", "surrogatepass"))
        else:
            keep.append(line)
    chars = len(text) - (len(data) - len(data.translate(None, WHITE)))
    again = repeated_words(ws)
    base = len(ws) < rules.min_words or 100 * again > rules.max_repeat_percent * len(ws)
    kept = not base and lost <= rules.max_lost * chars
    cleaned = text if not bad else b"\n".join(keep).decode("utf-8", "surrogatepass")
    return len(ws), chars, symbols, repeats, again, base, kept, lost, lines, bad, cleaned


FIELDS = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("lost_chars", "long"), ("n_lines", "long"), ("n_bad_lines", "long"),
)


def clean_lines(docs: DataFrame, rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """doc_id, the base counts, the verdict ``kept`` and (``with_text``) the text without its failing lines.

    One narrow pass over ``doc_id, text``: no shuffle, memory of one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [judge(t.as_py(), rules) for t in batch.column(1)]
            columns = list(zip(*got)) or [()] * 11
            kinds = {"long": pa.int64(), "boolean": pa.bool_()}
            out = [batch.column(0), *(pa.array(columns[k], kinds[kind]) for k, (_, kind) in enumerate(FIELDS))]
            names = ["doc_id", *(n for n, _ in FIELDS)]
            if with_text:
                out.append(pa.array(columns[10], pa.string()))
                names.append("cleaned_text")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} {k}" for n, k in FIELDS) + (", cleaned_text string" if with_text else "")
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(tidy(run), schema)


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All columns of ``docs`` but text, then ``kept`` and ``cleaned_text``; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            got = [judge(t.as_py(), rules) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[6] for g in got], pa.bool_()), pa.array([g[10] for g in got], pa.string())], [CARRIED, "kept", "cleaned_text"])

    rows = carry(docs)
    return opened(rows.mapInArrow(tidy(run), widened(rows, ("text",), "kept boolean, cleaned_text string")), docs, ["kept", "cleaned_text"])
