"""Vectorised text primitives shared by the operators: UTF-8 buffers, words, rolling hashes.

Everything works on the bytes of whole Arrow string columns, block by block,
so a worker's memory is bounded by a block plus its longest document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 2048

_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) over uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i (mod 2**64) for i < n; kept between calls."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, base, U64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole documents: about ``block_bytes``, at most BLOCK_ROWS."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1)
        end = min(end, n, at + BLOCK_ROWS)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    release()


_KEPT_POWERS = 1 << 21
_libc: list[ctypes.CDLL | None] = []


def release() -> None:
    """Give freed memory back: workers live on between tasks, and what one long text took would stay with them."""
    if len(_powers.get("up", ())) > _KEPT_POWERS:
        _powers.clear()
    if not _libc:
        try:
            _libc.append(ctypes.CDLL("libc.so.6"))
        except OSError:  # another C library
            _libc.append(None)
    if _libc[0] is not None:
        _libc[0].malloc_trim(0)
    pa.default_memory_pool().release_unused()


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs of True that stay in one document."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums of a polynomial hash: ``span_hash`` reads any substring from them."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * powers(len(data))[0], dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, document numbers and hashes of the words, A-Z lower-cased."""
    starts, ends, doc = runs(~SPACE[data], offsets)
    return starts, ends, doc, span_hash(prefix_hash(data, lower=True), starts, ends)


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles and their documents; a shorter document is one shingle."""
    n = len(words)
    count = np.bincount(doc, minlength=n_docs)
    m = max(0, n - width + 1)
    h = np.full(m, width, U64)
    for k in range(width):
        h = mix(h * U64(0x9FB21C651E98DF25) + words[k : k + m])
    whole = doc[:m] == doc[n - m :] if m else np.zeros(0, bool)
    out, at = [h[whole]], [doc[:m][whole]]
    short = (count > 0) & (count < width)
    if short.any():
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        for size in range(1, width):
            rows = np.flatnonzero(short & (count == size))
            g = np.full(len(rows), size, U64)
            for k in range(size):
                g = mix(g * U64(0x9FB21C651E98DF25) + words[first[rows] + k])
            out.append(g)
            at.append(rows)
    return np.concatenate(out), np.concatenate(at)


def distinct_by_doc(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, documents in order."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[keep], doc[keep]


def doc_ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False))
