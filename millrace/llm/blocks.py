"""Many texts as one packed row: their terms as numbers of a dictionary that the block itself holds.

A term is a word or a pair of neighbouring words, known everywhere by a 63-bit id.  Within a block it is a place in the block's
dictionary, so that work on every occurrence is work on small numbers, and ids are looked up once a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa

from millrace.llm.words import Words, pair_ids

#: A block holds at most so many texts, and about so many characters of them (one text at least).
MOST_TEXTS, MOST_CHARS = 1 << 14, 1 << 25
_WORD_BITS = 24
NOTHING = np.zeros(0, np.uint16)
#: Stands for a null id.
NO_ID = -(1 << 63)


def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def packed(a: np.ndarray) -> bytes:
    """An array of one dimension: its type, its length in bytes, and its bytes compressed."""
    raw = np.ascontiguousarray(a)
    return f"{raw.dtype.str}{raw.nbytes}:".encode() + _codec().compress(raw.tobytes(), asbytes=True)


def unpacked(b: bytes) -> np.ndarray:
    head, _, body = b.partition(b":")
    kind, size = head[:3].decode(), int(head[3:])
    return np.frombuffer(_codec().decompress(body, size, asbytes=True) if size else b"", np.dtype(kind))


def narrow(a: np.ndarray) -> np.ndarray:
    """The same whole numbers, none negative, in the narrowest type of two bytes or four."""
    return a.astype(np.uint16 if not len(a) or a.max() < 1 << 16 else np.uint32)


class Packed:
    """What several arrays of a block have in common: they travel as columns of one row."""

    @classmethod
    def schema(cls) -> str:
        return "n long, " + ", ".join(f"{f.name} binary" for f in fields(cls))

    def row(self) -> pa.RecordBatch:
        """One row; ``n`` is the number of texts."""
        cols = [pa.array([packed(getattr(self, f.name))], pa.binary()) for f in fields(self)]
        return pa.RecordBatch.from_arrays([pa.array([len(self.size)], pa.int64()), *cols], ["n", *[f.name for f in fields(self)]])

    @classmethod
    def rows(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[Packed]:
        """The packed rows; what is not among the columns of the batches is left empty."""
        for b in batches:
            there = set(b.schema.names)
            for i in range(b.num_rows):
                yield cls(*[unpacked(b[f.name][i].as_py()) if f.name in there else NOTHING for f in fields(cls)])


@dataclass
class Block(Packed):
    """Texts, in columns of numbers.

    ``doc`` are their ids.  ``told`` are their known subjects, as (text, subject) pairs in one number each.  ``size`` is the number of words
    of each text, ``word`` the words in order, as places in ``words``.  ``left`` and ``right`` are the words of each distinct pair.
    ``terms`` is the number of distinct terms of each text, ``term`` these terms (a word's place, or behind the words a pair's) and
    ``often`` how often the text has them.
    """

    doc: np.ndarray
    told: np.ndarray
    size: np.ndarray
    word: np.ndarray
    words: np.ndarray
    left: np.ndarray
    right: np.ndarray
    terms: np.ndarray
    term: np.ndarray
    often: np.ndarray

    def ids(self) -> np.ndarray:
        """The ids of all terms of the dictionary: words, then pairs."""
        return np.concatenate([self.words, pair_ids(self.words[self.left], self.words[self.right])])

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.told >> 8).astype(np.int64), (self.told & 255).astype(np.int64)


def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each occurs."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    key = np.sort(key)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at], np.diff(np.r_[at, len(key)])


def block(doc: list[int], told: list[list[int] | None], flat: np.ndarray, size: np.ndarray, known: np.ndarray) -> Block:
    """Of texts with ``size`` words each, ``flat`` being places in ``known``, the ids of all words that a worker has met."""
    used = np.zeros(len(known), bool)
    used[flat] = True
    place = np.cumsum(used) - 1
    words, word = known[used], place[flat]
    if len(words) >= 1 << _WORD_BITS:
        raise ValueError("too many distinct words in a block")
    text = np.repeat(np.arange(len(size), dtype=np.int64), size)
    one, n_one = counted((text << 48) | word)
    inside = text[1:] == text[:-1]
    two, n_two = counted(((text[:-1] << 48) | (word[:-1] << _WORD_BITS) | word[1:])[inside])
    mask = (1 << 48) - 1
    pairs, pair = np.unique(two & mask, return_inverse=True)
    at = np.concatenate([one >> 48, two >> 48])
    by = np.argsort(at.astype(np.uint16), kind="stable")  # at most 2^14 texts
    term = np.concatenate([one & mask, pair + len(words)])[by]
    pairs_of = [(i << 8) | s for i, ss in enumerate(told) for s in ss or ()]
    return Block(
        np.array(doc, np.int64), np.array(pairs_of, np.int64), size.astype(np.uint32), narrow(word), words, narrow(pairs >> _WORD_BITS), narrow(pairs & ((1 << _WORD_BITS) - 1)),
        np.bincount(at, minlength=len(size)).astype(np.uint32), narrow(term), narrow(np.concatenate([n_one, n_two])[by]),
    )


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Texts (doc_id, text, told) packed; texts that are null or only white space are left out."""
    w = Words()
    doc: list[int] = []
    told: list[list[int] | None] = []
    parts: list[np.ndarray] = []
    chars = 0

    def made() -> Block:
        size = np.array([len(p) for p in parts], np.int64)
        return block(doc, told, np.concatenate(parts) if parts else np.zeros(0, np.int64), size, w.ids())

    for b in batches:
        for i, t, s in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["told"].to_pylist()):
            if not t or t.isspace():
                continue
            if doc and (len(doc) == MOST_TEXTS or chars + len(t) > MOST_CHARS or w.full()):
                yield made()
                doc, told, parts, chars = [], [], [], 0
                w.make_room()
            doc.append(NO_ID if i is None else i)
            told.append(s)
            parts.append(w.places(t))
            chars += len(t)
    if doc:
        yield made()
