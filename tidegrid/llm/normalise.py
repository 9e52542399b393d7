"""Folding of page text to comparable words (plain Python, used inside Arrow tasks)."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ɡ": "g", "α": "a", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
_LOOK = str.maketrans(LOOKALIKES)
_BROKEN = re.compile("[Â-ôЂ-џ][\u0080-¿Œ-ƒˆ˜–-›€™Ѐ-џ]+")
# combining marks and characters without width
_UNSEEN = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]+")
LOST = "\ufffd"  # stands where a character could not be decoded, be it a letter or an invisible one
_WORD = re.compile(rf"[\w{LOST}]+")
_LATIN = re.compile("[a-z]")


def _unbreak(m: re.Match) -> str:
    """A run of UTF-8 bytes once read as a one-byte charset, read again as UTF-8."""
    run = m.group()
    for charset in ("cp1252", "latin-1", "cp1251"):
        try:
            return run.encode(charset).decode("utf-8")
        except UnicodeError:
            continue
    return run


def fold(text: str) -> str:
    """Case, accents, width, invisible characters, entities, look-alike letters and doubly encoded bytes removed."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _BROKEN.sub(_unbreak, text)
        text = unicodedata.normalize("NFKD", text)
        text = _UNSEEN.sub("", text)
    return text.casefold()


def words(text: str) -> list[str]:
    """Words of the folded text, in order; a word that mixes scripts is read as Latin."""
    found = _WORD.findall(fold(text))
    return [w.translate(_LOOK) if not w.isascii() and _LATIN.search(w) else w for w in found]


def fitting(word: str, known: Iterable[str]) -> list[str]:
    """The known words that a word with lost characters could have been: each lost one stands for none to two."""
    parts = word.split(LOST)
    pattern = re.compile(".{0,2}".join(map(re.escape, parts)))
    return [k for k in known if len(word) - len(parts) < len(k) <= len(word) + len(parts) and pattern.fullmatch(k)] if any(parts) else []


def could_be(word: str, known: Iterable[str]) -> str | None:
    """The known word that a word with lost characters most likely was. Fewest missing letters first."""
    return min(fitting(word, known), key=lambda k: (abs(len(k) - len(word)), k), default=None)
