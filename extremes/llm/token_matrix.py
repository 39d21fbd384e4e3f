"""Token ids packed into matrices by best fit decreasing (operator 7)."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-splitting pattern that belongs to the vocabulary (fixed values).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens that are packed together; what a task holds at a time.
GROUP_TOKENS = 4_000_000


class Encoder:
    """Ids of whole texts, in the smallest type that holds them."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(k): int(v) for k, v in (x.split() for x in lines if x.strip())}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = len(ranks)
        self.kind = np.dtype("<u2" if self.size < 1 << 16 else "<u4")

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), self.kind)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class CapacityTree:
    """Bins by free capacity: a segment tree over 0..limit that finds the least capacity of at least a length."""

    def __init__(self, limit: int):
        self.width = 1 << limit.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: dict[int, list[int]] = {}

    def add(self, free: int, bin_: int) -> None:
        self.bins.setdefault(free, []).append(bin_)
        i = free + self.width
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, bin) of the fullest bin that has room, which is then out of the tree."""
        i, count = length + self.width, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if count[2 * i] else 2 * i + 1
        free = i - self.width
        bin_ = self.bins[free].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return free, bin_


def best_fit_decreasing(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of item positions; longest first, each into the bin that it fills best; ties by position."""
    tree, bins = CapacityTree(limit), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        free, at = tree.take(lengths[item]) or (limit, len(bins))
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
        tree.add(free - lengths[item], at)
    return bins


SCHEMA = "n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"
_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
_NAMES = ["n_tokens", "n_segments", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"]


def pack_tokens(docs: DataFrame, length: int = 2048, path: str = VOCABULARY, end_id: int | None = None, pad_id: int = 0, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``docs(doc_id, text)`` -> rows of a packed id matrix.

    ``ids`` holds ``length`` little-endian ids (2 bytes each where the vocabulary allows it, else 4), the segments first
    and ``pad_id`` after ``n_tokens``. ``cu_seqlens`` are the segments' cumulative lengths, from 0; ``position_resets``
    where positions start again from 0; ``doc_ids`` and ``doc_offsets`` say which document and which of its tokens a
    segment starts with. A document of more than ``length`` tokens is split into pieces; no token is lost. ``end_id``,
    by default the first id that the vocabulary leaves free, ends every document. Null text counts as empty: a document
    of its end alone. Repeated rows and null ids are packed like others. An empty table gives an empty one.

    A row's ``ids`` take ``2 * length`` or ``4 * length`` bytes, the same for all rows. ``pad_id`` may be the id of a real
    token: ``n_tokens`` tells where padding starts. Which documents share a row follows from how the input is partitioned.

    Documents are packed where they are read, in groups of about ``group_tokens`` tokens, so nothing is shuffled and
    memory is bounded; a group leaves one badly filled row or so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = enc.size if end_id is None else end_id
        kind = np.dtype("<u2" if max(enc.size, end, pad_id) < 1 << 16 else "<u4")
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for bin_ in best_fit_decreasing([len(p[2]) for p in pieces], length):
                own = [pieces[i] for i in bin_]
                ends = np.cumsum([0] + [len(p[2]) for p in own])
                ids = np.full(length, pad_id, kind)
                ids[: ends[-1]] = np.concatenate([p[2] for p in own])
                rows.append((int(ends[-1]), len(own), ids.tobytes(), ends.tolist(), ends[:-1].tolist(), [p[0] for p in own], [p[1] for p in own]))
                if len(rows) == 1024:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py() or "").astype(kind, copy=False), kind.type(end))
                pieces.extend((doc_id, lo, ids[lo : lo + length]) for lo in range(0, len(ids), length))
                held += len(ids)
                if held >= group_tokens:
                    yield from flush()
                    pieces, held = [], 0
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
