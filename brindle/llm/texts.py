"""Texts of Arrow batches as one array of bytes, their words as positions in it and as 64-bit codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that part words: space and the five control characters from tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of the column, so that memory doesn't follow the rows of a batch."""
    for whole in batches:
        read = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(read // most)) + 1).tolist(), whole.num_rows]
        for k, upto in zip(cuts[:-1], cuts[1:], strict=True):
            if upto > k:
                yield whole.slice(k, upto - k)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind each other, and where each begins (one more entry for the end). Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def apart(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """joined() with one space behind every text, so that no word stands next to another text's."""
    return np.insert(data, at[1:], 0x20), at + np.arange(len(at))


def spaced(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of bytes inside words, each with one space behind it: all bytes; begin and end of every word there; and
    its begin in data. The last byte is not inside."""
    after = np.zeros(len(inside), bool)
    after[1:] = inside[:-1]
    kept = inside | after
    flat = np.where(inside, data, np.uint8(0x20))[kept]
    end = np.flatnonzero(flat == 0x20) if len(flat) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    source = np.flatnonzero(inside & ~after)
    return flat, begin, end, source


def mixed(h: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers that maps no two to one."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * ODD
    return h ^ (h >> U64(32))


def codes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code of each run of bytes, eight bytes at a time."""
    size = end - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out, left, k = mixed(size.astype(U64) * ODD), np.arange(len(begin)), 0
    while len(left):
        lane = eight[begin[left] + 8 * k]
        over = np.maximum(0, 8 - (size[left] - 8 * k)).astype(U64) * U64(8)
        out[left] = mixed((out[left] ^ (lane & (~U64(0) >> over))) * ODD + U64(k))
        k += 1
        left = left[size[left] > 8 * k]
    return out


def chained(code: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of every n codes in a row."""
    many = max(0, len(code) - n + 1)
    out = np.zeros(many, U64)
    for k in range(n):
        out = mixed(out * ODD + code[k : k + many])
    return out


def picked(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The bytes of each range."""
    flat = data.tobytes()
    return [flat[a:z] for a, z in zip(begin.tolist(), end.tolist(), strict=True)]
