"""Operator 11, quality rules, line first: bad lines go, then documents that lose too much of their text.

Lines (split at ``\\n``) are judged one by one. A line with a word goes by the first rule that it breaks:

``repeated``     it equals an earlier line of its text;
``boilerplate``  at most ``SHORT`` words, and one of the ``PHRASES`` of licences, consent, accounts and page ends is in it;
``navigation``   two words or more, and a quarter of all, are lone separators such as ``|``;
``symbols``      over a tenth of its characters are ``[#*$%&|<>]`` or others of code and markup;
``shouting``     three words or more, and more of A-Z than of a-z;
``punctuation``  no sentence end at its end, quotes and brackets that close there left aside; a line of over ``SHORT`` words may also end in the
                 midst of a sentence, if another one ends in it.

A document is kept if the base rules let it pass and the lines that go hold at most ``MOST_LOST`` per cent of its characters in words.
Words are ``[^\\x20\\x09-\\x0D]+``. Each text is judged whole by itself, in Arrow batches, so nothing is shuffled.

Defined results: null text is empty; a text without words has no line to judge and fails the base rules; lines of white space go silently;
every repeated row is a row; null doc_ids and other columns are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lockstep.llm.encoding import slices

LEAST_WORDS, MOST_REPEATED, MOST_LOST, SHORT = 50, 50, 40, 30
SYMBOLS, MORE_SYMBOLS, SEPARATORS = "#*$%&|<>", "~^{}\\=_", ("|", "||", "»", "«", "›", "‹", "·", "•", ">", ">>", "→", "/", "::")
ENDS, CLOSING = ".!?…:;。！？؟।", "\"'”’»)]"
#: Fixed phrases, lower case, single blanks: English, German, French, Spanish.
PHRASES = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy", "cookie", "copyright", "©", "javascript", "click here", "read more", "sign in", "sign up", "log in", "subscribe", "newsletter", "share this", "skip to content", "powered by",
    "alle rechte vorbehalten", "lizenziert unter", "nutzungsbedingungen", "datenschutzerkl", "impressum", "hier klicken", "weiterlesen", "anmelden", "abonnieren",
    "tous droits réservés", "sous licence", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "cliquez ici", "lire la suite", "se connecter", "s'abonner",
    "todos los derechos reservados", "bajo licencia", "términos de uso", "política de privacidad", "aviso legal", "haga clic", "leer más", "iniciar sesión", "suscr",
)
RULES = ("repeated", "boilerplate", "navigation", "symbols", "shouting", "punctuation")
MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long, lost_lines array<int>, cleaned string"

_PHRASES, _SEPARATORS = [p.encode() for p in PHRASES], {s.encode() for s in SEPARATORS}
_ENDS = tuple(ENDS)
_SYMBOLS, _ALL_SYMBOLS = SYMBOLS.encode(), (SYMBOLS + MORE_SYMBOLS).encode()
_UPPER, _LOWER, _INNER = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(0x80, 0xC0))


def _chars(raw: bytes) -> int:
    """Code points of UTF-8."""
    return len(raw.translate(None, _INNER))


def _many(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def _ends(word: bytes) -> bool:
    """Whether a sentence ends with this word."""
    return word.decode().rstrip(CLOSING).endswith(_ENDS)


def line_rule(words: list[bytes], repeated: bool, phrases: list[bytes]) -> int:
    """The place in ``RULES`` of the first rule that a line of these words breaks, or -1; ``phrases``: those of its text."""
    if repeated:
        return 0
    if phrases and len(words) <= SHORT:
        lowered = b" ".join(words).lower()
        if any(p in lowered for p in phrases):
            return 1
    if not _SEPARATORS.isdisjoint(words):
        lone = sum(w in _SEPARATORS for w in words)
        if lone >= 2 and 4 * lone >= len(words):
            return 2
    joined = b"".join(words)
    if 10 * _many(joined, _ALL_SYMBOLS) > _chars(joined):
        return 3
    if len(words) >= 3 and _many(joined, _UPPER) > _many(joined, _LOWER):
        return 4
    return -1 if _ends(words[-1]) or len(words) > SHORT and any(map(_ends, words)) else 5


def repeat_words(words: list[bytes]) -> int:
    """How many words stand in a window of three that is found twice or more."""
    if len(words) < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pair = x[:-1] * len(number) + x[1:]
    if len(number) > 1 << 20:  # three numbers in one long need 21 bits each
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * len(number) + x[2:], return_inverse=True, return_counts=True)
    twice, inside = times[which] > 1, np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


def judge(text: str | None, most_lost: int = MOST_LOST) -> tuple:
    """``MEASURES`` of one text, without its doc_id."""
    raw = (text or "").encode()
    words, seen, kept, total, lost, dups = [], set(), [], 0, 0, 0
    lines, lowered = [0] * len(RULES), b" ".join(raw.split()).lower()
    phrases = [p for p in _PHRASES if p in lowered]
    for line in raw.split(b"\n"):
        own = line.split()  # bytes split at just these six characters
        if not own:
            continue
        words += own
        again = line in seen
        seen.add(line)
        dups += again
        chars = _chars(b"".join(own))
        total += chars
        rule = line_rule(own, again, phrases)
        if rule < 0:
            kept.append(line)
        else:
            lost += chars
            lines[rule] += 1
    n, repeats = len(words), repeat_words(words)
    failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
    return n, total, _many(raw, _SYMBOLS), dups, repeats, failed, not failed and 100 * lost <= most_lost * total, lost, lines, b"\n".join(kept).decode()


def measure(documents: DataFrame, most_lost: int = MOST_LOST) -> DataFrame:
    """``MEASURES`` of each row of ``doc_id, text``: counts, verdicts, lines lost by each of ``RULES``, and the text of the lines that stay."""
    shape = StructType.fromDDL(MEASURES)
    names = shape.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = zip(*(judge(t, most_lost) for t in part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, kind) for x, kind in zip(found, kinds, strict=True))], names)

    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.list_(pa.int32()), pa.string()]
    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, shape)


def cleaned(documents: DataFrame, most_lost: int = MOST_LOST) -> DataFrame:
    """The documents that are kept, all columns as they were, with the text of the lines that stay."""
    numbered = documents.toDF(*(f"c{k}" for k in range(len(documents.columns))))  # whatever the names hold
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                found = [judge(t, most_lost) for t in part.column(at).to_pylist()]
                part = part.set_column(at, part.schema.field(at), pa.array([x[-1] for x in found], part.schema.field(at).type))
                yield part.filter(pa.array([x[6] for x in found], pa.bool_()))

    return numbered.mapInArrow(run, numbered.schema).toDF(*documents.columns)
