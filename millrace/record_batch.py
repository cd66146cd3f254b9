"""Batches of results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


class RecordBatch:
    """One batch of a result."""

    def __init__(self, record_batch: pa.RecordBatch) -> None:
        self.record_batch = record_batch

    def to_pyarrow(self) -> pa.RecordBatch:
        return self.record_batch


class RecordBatchStream:
    """Batches one after the other."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self._batches = iter(batches)

    def next(self) -> RecordBatch:
        return self.__next__()

    def __next__(self) -> RecordBatch:
        return RecordBatch(next(self._batches))

    def __iter__(self) -> RecordBatchStream:
        return self
