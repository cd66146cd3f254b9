"""Texts as sequences of word ids, for statistics of terms."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from itertools import chain

import numpy as np

_WORD = re.compile(r"[^\W\d_]+")
_PLAIN_WORD = re.compile(r"[A-Za-z]{3,}")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
#: Latin words under this length are dropped; so many split words are kept in a worker.
SHORTEST, KEPT = 3, 300_000


def _singular(w: str) -> str:
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if len(w) > 4 and w.endswith(("ches", "shes", "sses", "xes")):
        return w[:-2]
    if len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")):
        return w[:-1]
    return w


def pieces(token: str) -> list[str]:
    """The words of an unbroken run of letters: parts of camel case, in lower case and singular; overlapping pairs of
    characters of scripts without spaces."""
    if token.isascii():
        parts = _CAMEL.findall(token) if not (token.islower() or token.isupper()) else [token]
        return [_singular(p.lower()) for p in parts if len(p) >= SHORTEST]
    if _WIDE.search(token):
        return [token[i : i + 2] for i in range(max(1, len(token) - 1))]
    w = token.lower()
    return [w] if len(w) >= SHORTEST else []


#: Encoded data, as in binary patches: an unbroken run of so many printable characters holds no words.
_ENCODED = re.compile(r"(?<![!-~])[!-~]{60,}+")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]")


def plain(text: str) -> str:
    """The text with escapes of dumps resolved, UTF-8 that was read as a one-byte code page restored, and characters composed."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if text.isascii():
        return text
    if "Ã" in text or "Ð" in text or "â€" in text or "ã" in text:
        for page in ("cp1252", "latin-1"):
            try:
                text = text.encode(page).decode()
                break
            except UnicodeError:
                pass
    return unicodedata.normalize("NFC", text)


def word_id(word: str) -> int:
    """A 62-bit id; pairs of words have ids above."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 2


class Words:
    """Texts as places in a growing list of words; what has been split is kept."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.place: dict[int, int] = {}

    def places(self, text: str | None) -> np.ndarray:
        """The words of a text, as places in :meth:`ids`."""
        text = _ENCODED.sub(" ", plain(text)) if text else ""
        # the same words, without those that :func:`pieces` drops anyway
        tokens = (_PLAIN_WORD if text.isascii() else _WORD).findall(text)
        new = set(tokens).difference(self.known)
        place = self.place
        for t in new:
            self.known[t] = tuple(place.setdefault(word_id(p), len(place)) for p in pieces(t))
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, tokens)), np.int64)

    def ids(self) -> np.ndarray:
        return np.fromiter(self.place, np.int64, len(self.place))

    def full(self) -> bool:
        return len(self.known) > KEPT

    def make_room(self) -> None:
        """Forgets everything, if it is much; places change their meaning then."""
        if self.full():
            self.known.clear()
            self.place.clear()


def pair_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """62-bit ids of pairs of words, with a bit above that no word has."""
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return (mixed >> np.uint64(2)).astype(np.int64) | (1 << 62)
