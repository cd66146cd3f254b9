"""Byte-level BPE by depth-first traversal of a trie of distinct words.

A word's encoding is fixed by one fact about each of its prefixes: the last token of that prefix's own encoding.
Of the tokens that end at a place exactly one follows the prefix before it without any merge across the joint; it is the
last token there.  So the states of a prefix serve all words that share it.  :meth:`ByteBPE.encode_words` takes the words in
byte order, which is the depth-first order of their trie, and keeps the states of the current path only.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable

NEVER = 1 << 60


def default_path() -> str:
    """The rank file of byte_bpe_50k: $MILLRACE_TOKENIZERS or /opt/tokenizers."""
    return os.path.join(os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


#: The pattern that splits text before merging, as published with the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBPE:
    """A vocabulary of ranked byte strings, with what is derived from it on demand."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.rank.items()}
        #: every ending of a token: beyond one that is missing here no longer token can end
        self.endings = {t[i:] for t in self.rank for i in range(len(t))}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        import regex

        self.split = regex.compile(SPLIT).findall

    def merge(self, word: bytes, below: int = NEVER) -> list[int]:
        """The plain procedure: again and again merge the leftmost pair of lowest rank, of ranks under ``below``."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1], NEVER)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that ``token`` is merged from; None for a byte or a token that merging never makes."""
        if token not in self._halves:
            text = self.token[token]
            parts = self.merge(text, token) if len(text) > 1 else []
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def made(self, token: int) -> bool:
        return len(self.token[token]) == 1 or self.halves(token) is not None

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that stand at one end (0 left, 1 right) of ``token`` while it is merged, each with the rank of the merge
        that ends it; the last is the token itself, which nothing ends."""
        key = (token, side)
        if key not in self._spines:
            out, end = [], NEVER
            piece = token
            while True:
                out.append((piece, end))
                h = self.halves(piece)
                if h is None:
                    break
                end, piece = piece, h[side]
            self._spines[key] = out
        return self._spines[key]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` side by side stay two tokens: no merge across the joint comes before the ones that end
        its two pieces.  At equal rank the left merge comes first."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            known = True
            token, rank = self.token, self.rank
            for a, a_end in self.spine(left, 1):
                for b, b_end in self.spine(right, 0):
                    c = rank.get(token[a] + token[b])
                    if c is not None and c < a_end and c <= b_end:
                        known = False
                        break
                if not known:
                    break
            self._fits[key] = known
            if len(self._fits) > 2_000_000:
                self._fits.clear()
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The encodings of distinct words."""
        order = sorted((w.encode(), w) for w in words)
        rank, endings, token, fits = self.rank, self.endings, self.token, self.fits
        out: dict[str, tuple[int, ...]] = {}
        before = b""
        last: list[int] = [-1]  # last[d]: the last token of the path's first d bytes
        for text, word in order:
            n = len(text)
            d = 0
            stop = min(n, len(before), len(last) - 1)
            while d < stop and text[d] == before[d]:
                d += 1
            del last[d + 1 :]
            while d < n:
                d += 1
                found = -1
                ending, size = text[d - 1 : d], 1
                tries = []
                while ending in endings:
                    r = rank.get(ending)
                    if r is not None:
                        tries.append((size, r))
                    size += 1
                    if size > d:
                        break
                    ending = text[d - size : d]
                for size, r in reversed(tries):
                    if (size == d and self.made(r)) or (size < d and fits(last[d - size], r)):
                        found = r
                        break
                last.append(found)
                if found < 0:
                    break
            before = text
            if len(last) == n + 1 and last[n] >= 0:
                ids = []
                while d:
                    ids.append(last[d])
                    d -= len(token[last[d]])
                out[word] = tuple(reversed(ids))
            else:  # no vocabulary with whole merges leads here
                last.pop()
                before = text[: len(last) - 1]
                out[word] = tuple(self.merge(text))
        return out


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The vocabulary at ``path``, once a process."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]
