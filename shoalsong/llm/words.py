"""Words of Arrow string columns as numpy arrays, for use inside tasks.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r. Texts are
taken in pieces that fit the processor's cache, whatever the batch;
a longer text is cut at white space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
_SPACES = b"\t\n\x0b\x0c\r"
#: White space becomes a space; LOWER also turns A-Z into a-z.
PLAIN = bytes.maketrans(_SPACES, b" " * len(_SPACES))
LOWER = bytes.maketrans(_SPACES + bytes(range(65, 91)), b" " * len(_SPACES) + bytes(range(97, 123)))

_random = np.random.RandomState(20240229)
BYTE = _random.randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[memoryview, np.ndarray]:
    """The bytes of a string column and where its rows begin and end; null is empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(data or b""), ends


def pieces(column: pa.Array, table: bytes = LOWER, limit: int = PIECE):
    """Yields (rows, starts, ends, data): the row of each word and its place in data.

    data begins and ends with a space and has one between rows.
    """
    view, at = texts(column)
    row, count = 0, len(at) - 1
    while row < count:
        last = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        if last == row + 1 and at[last] - at[row] > limit:
            for part in _parts(bytes(view[at[row] : at[last]]).translate(table), limit):
                yield _words(b" " + part + b" ", np.zeros(1, np.int64), row)
        else:
            joined = b" ".join([view[at[i] : at[i + 1]] for i in range(row, last)]).translate(table)
            yield _words(b" " + joined + b" ", at[row:last].astype(np.int64) - at[row] + np.arange(last - row) + 1, row)
        row = last


def _parts(text: bytes, limit: int):
    """A long text in parts of about `limit` bytes; words stay whole."""
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + limit)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut


def _words(data: bytes, begins: np.ndarray, first: int):
    data = np.frombuffer(data, np.uint8)
    space = data == 32
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    return np.searchsorted(begins, starts, "right") - 1 + first, starts, ends, data


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * (out[-1:] * base)])
    return out


class Hasher:
    """64-bit hashes of words: a polynomial over random byte values, then mixed."""

    def __init__(self) -> None:
        self.up, self.down = _powers(BASE, PIECE + 2), _powers(UNBASE, PIECE + 2)

    def __call__(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        if len(data) > len(self.up):
            self.up, self.down = _powers(BASE, len(data)), _powers(UNBASE, len(data))
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(BYTE[data] * self.up[: len(data)], out=total[1:])
        return mixed((total[ends] - total[starts]) * self.down[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def row_hashes(column: pa.Array, hasher: Hasher, table: bytes = LOWER):
    """Yields (row, word hashes) for rows with words, in order; a row comes whole."""
    held: list[np.ndarray] = []
    current = -1
    for rows, starts, ends, data in pieces(column, table):
        hashes = hasher(starts, ends, data)
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for row, part in zip(rows[np.r_[0, cuts]] if len(rows) else (), np.split(hashes, cuts)):
            if row != current and held:
                yield current, np.concatenate(held) if len(held) > 1 else held[0]
                held = []
            current = int(row)
            held.append(part)
    if held:
        yield current, np.concatenate(held) if len(held) > 1 else held[0]


def column_of(arrays: list[np.ndarray], kind: pa.DataType = pa.binary()) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], kind)
