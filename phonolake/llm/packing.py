"""Packing of documents into training windows by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows
from .tokens import MAX_UNITS, WORDS, default_path, encoder

PIECES = "doc_id long, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c, pa.binary() if c == "token_ids" else pa.int64()) for c in ("doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset")])
#: Documents encoded, and pieces returned, at once: a task holds a block's ids and little else.
TOGETHER = 256


class OpenWindows:
    """Open windows by remaining capacity; a segment tree of counts finds the tightest one that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, capacity: int, n: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.at[capacity].append(window)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes the open window with the least capacity of at least need: (capacity, window)."""
        k, count = need + self.leaves, self.count
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # up, until a subtree to the right has windows
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if count[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window of each piece, its offset there, number of windows); pieces of equal length keep their order."""
    which, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    windows = OpenWindows(window)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = windows.take(need)
        capacity, w = found or (window, n)
        n += found is None
        which[i], offset[i] = w, window - capacity
        windows.put(capacity - need, w)
    return which, offset, n


def pack(df: DataFrame, tokenizer: str | None = None, window: int = 2048, end_id: int = 1, block_tokens: int = 4_000_000, task_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", max_units: int = MAX_UNITS) -> DataFrame:
    """Pack every document into windows of at most `window` tokens; one row for each piece.

    A document's ids are those of its text, then end_id. Overlong documents are first cut into full windows, each a
    sequence of its own; what is left of each document is packed by best-fit decreasing. Every task packs its own
    rows, in blocks of about block_tokens ids, so nothing is shuffled and memory is bounded; a block leaves at most
    a few windows that are not nearly full. So that blocks are full, partitions of few bytes are read together, by
    about task_bytes of text a task (the bytes are measured first). sequence_id is the task's number in the high bits, its count in the
    low ones. A worker remembers the ids of about 2 * max_units distinct words, some 150 bytes each; with fewer it
    encodes more of them again, to the same ids.

    Null and empty texts are documents of one id (the end); a null doc_id stays null; repeated rows are packed as
    often as they occur; an empty table gives no rows; other columns are not read.
    """
    path = tokenizer or default_path("word_bpe_49k.json")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, WORDS, max_units).encode, np.uint32(end_id).astype("<u4").tobytes()
        base, step = TaskContext.get().partitionId() << 40, 4 * window

        def blocks() -> Iterator[list[tuple[int, bytes]]]:
            held, n = [], 0
            for batch in batches:
                for i in range(0, batch.num_rows, TOGETHER):
                    docs, texts = (batch.column(c).slice(i, TOGETHER).to_pylist() for c in ("doc_id", "text"))
                    for d, x in zip(docs, encode(texts), strict=True):
                        held.append((d, x + end))
                        n += len(x) // 4 + 1
                        if n >= block_tokens:
                            yield held
                            held, n = [], 0
            if held:
                yield held

        for held in blocks():
            held.sort(key=lambda r: (-1 if r[0] is None else r[0], r[1]))
            pieces = [(d, at // 4, ids[at : at + step], len(ids) // 4) for d, ids in held for at in range(0, len(ids), step)]
            held.clear()
            size = np.array([len(p[2]) // 4 for p in pieces], np.int64)
            which, offset, n = best_fit_decreasing(size, window)
            for i in range(0, len(pieces), TOGETHER):
                own = slice(i, i + TOGETHER)
                doc, start, ids, total = zip(*pieces[own], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([doc, start, size[own], ids, total, base + which[own], offset[own]], _ARROW, strict=True)], schema=_ARROW)
            base += n

    rows = text_rows(df, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows.coalesce(max(1, -(-size // task_bytes))).mapInArrow(task, PIECES)
