"""Encoding of whole texts with a public byte-level tokenizer."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millrace.llm import byte_bpe

#: So many distinct words, and words up to this length, are kept between batches of a worker.
KEPT_WORDS, KEPT_LENGTH = 400_000, 64


class _Encoder:
    """Texts to ids; keeps the encodings of words met before."""

    def __init__(self, path: str) -> None:
        self.bpe = byte_bpe.load(path)
        self.known: dict[str, tuple[int, ...]] = {}

    def words(self, texts: list[str]) -> tuple[list[list[str]], dict[str, tuple[int, ...]]]:
        split = self.bpe.split
        parts = [split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(parts)).difference(self.known)
        known = self.known
        if new:
            fresh = self.bpe.encode_words(new)
            if len(known) + len(fresh) > KEPT_WORDS:
                self.known = known = {}
                fresh = self.bpe.encode_words(set(chain.from_iterable(parts)))
            if any(len(w) > KEPT_LENGTH for w in fresh):
                # long words seldom return: they serve this batch only
                self.known = known | {w: i for w, i in fresh.items() if len(w) <= KEPT_LENGTH}
                return parts, known | fresh
            known.update(fresh)
        return parts, known


_encoders: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``most`` bytes of text each, one text at least."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    cut = (np.cumsum(sizes, dtype=np.int64) // most) if len(sizes) else sizes
    starts = np.flatnonzero(np.r_[True, np.diff(cut) != 0]) if len(cut) else []
    for a, b in zip(starts, [*starts[1:], len(cut)]):
        yield batch.slice(a, b - a)


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens, as array<int>.

    A null or empty text has an empty list.  Whatever a text holds, all its bytes are encoded; strings that look like
    special tokens are ordinary text.  The work is one map over the scan of two columns, with no shuffle: each
    worker splits its texts into words, encodes its distinct words by :class:`ByteBPE` and looks the rest up.
    """
    where = path or byte_bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(where)
        for whole in batches:
            for batch in _slices(whole):
                parts, known = enc.words(batch["text"].to_pylist())
                get = known.__getitem__
                flat, ends = array("i"), [0]
                for p in parts:
                    flat.extend(chain.from_iterable(map(get, p)))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), ids], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): the number of tokens of each text, 0 for a null or empty one; as :func:`encode`, without its ids."""
    where = path or byte_bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(where)
        for whole in batches:
            for batch in _slices(whole):
                parts, known = enc.words(batch["text"].to_pylist())
                get = known.__getitem__
                n = [sum(map(len, map(get, p))) for p in parts]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
