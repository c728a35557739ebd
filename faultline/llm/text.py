"""Vectorised word kernels shared by the text operators.

Texts arrive as Arrow string arrays and are cut into words with numpy over the raw UTF-8 bytes. A
word is a run of bytes other than 0x20 and 0x09-0x0D; those bytes never occur inside a multi-byte
UTF-8 sequence, so the byte view agrees with the pattern ``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; a longer single document is handled alone and whole.
CHUNK_BYTES = 500_000

_U64 = np.uint64
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | _U64(1)


_BYTE = _table(17)
_BYTE_LOW = _BYTE.copy()
_BYTE_LOW[65:91] = _BYTE[97:123]
_BYTE2 = _table(29)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Kinds of bytes: 0 separates, the others form runs; a new run starts where the kind changes.
_WORDS = (~_SPACE).astype(np.uint8)
_LETTERS = np.zeros(256, dtype=np.uint8)
_LETTERS[0x80:] = _LETTERS[0x30:0x3A] = _LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = 1
_RUNS = np.where(_SPACE, 0, np.where(_LETTERS == 1, 1, 2)).astype(np.uint8)
KINDS = {"words": _WORDS, "letters": _LETTERS, "runs": _RUNS}


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64; those a chunk needs are kept, longer runs made anew."""

    most = 2 * CHUNK_BYTES + 100_000
    kept: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def _made(n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (_R, _R_INV):
            a = np.full(n, base, dtype=np.uint64)
            a[:1] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        return out[0], out[1]

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.most:
            return cls._made(n)
        if cls.kept is None:
            cls.kept = cls._made(cls.most)
        return cls.kept[0][:n], cls.kept[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(27)
    h *= _U64(0x94D049BB133111EB)
    h ^= h >> _U64(31)
    return h


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[lo, hi)`` of about ``limit`` text bytes; at least one row each."""
    if len(column) == 0:
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes.astype(np.int64))
    lo = 0
    while lo < len(sizes):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield lo, hi
        lo = hi


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and the offset of each (n + 1); null is empty."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with one space after each, and the offset of each text (n + 1)."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    return raw_bytes(pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())))


class Words:
    """Words of a chunk of texts: byte ranges, hashes and the word range of each document."""

    def __init__(self, column: pa.Array, lower: bool = False, kind: str = "words") -> None:
        """``kind``: words between white space, runs of letters and digits, or those and runs of marks."""
        self.data, self.offsets = joined(column)
        kinds = KINDS[kind][self.data]
        edge = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        edge = np.concatenate(([0], edge, [len(kinds)])) if len(kinds) else np.zeros(1, dtype=np.int64)
        keep = kinds[edge[:-1]] != 0
        self.starts, self.ends = edge[:-1][keep], edge[1:][keep]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.lower = lower

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, second: bool = False, prefix: int | None = None) -> np.ndarray:
        """One 64-bit hash a word, or of its first ``prefix`` bytes."""
        ends = self.ends if prefix is None else np.minimum(self.ends, self.starts + prefix)
        up, down = _Powers.get(len(self.data) + 1)
        table = _BYTE2 if second else _BYTE_LOW if self.lower else _BYTE
        run = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(table[self.data] * up[: len(self.data)], out=run[1:], dtype=np.uint64)
        return mix((run[ends] - run[self.starts]) * down[self.starts])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive words starting at each word (documents are not respected)."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * _U64(0xD1342543DE82EF95) + h[j : len(h) - n + 1 + j]
    return mix(out)


def long_grams(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """As ``grams`` for large ``n``: rolling over prefix sums, one pass whatever ``n`` is."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    up, down = _Powers.get(len(h) + 1)
    run = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h + _U64(seed)) * up[: len(h)], out=run[1:], dtype=np.uint64)
    return mix((run[n:] - run[:-n]) * down[: len(h) - n + 1])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.string()) if not pa.types.is_string(column.type) else column
