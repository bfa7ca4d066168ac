"""NumPy and Arrow helpers that the operators use inside their tasks.

Texts are handled as one byte buffer per batch; words and windows get 64-bit
polynomial hashes from prefix sums, so no Python code runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
ALL_ONES = np.iinfo(np.uint64).max

# Odd multipliers; two unrelated ones for words and for windows, two lanes each.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
SECOND_BASE = 0xA0761D6478BD642F

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; different values stay different."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2^64, and those of its inverse."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = (n >> 16) + 2 << 16
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        known = _POWERS[base] = (out[0], out[1])
    return known[0][:n], known[1][:n]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """Hash sums before each place: ``n + 1`` values."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the spans; equal contents have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(base, len(sums))[1][starts])


def rolling(sums: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all windows of ``width`` places."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, U64)
    return mix((sums[width:] - sums[:n]) * powers(base, len(sums))[1][:n])


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its ``n + 1`` offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true places; no run crosses an offset."""
    n = len(inside)
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begins[cuts] |= inside[cuts]
        ends[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Words:
    """The words of a batch of texts.

    ``kind`` is ``spaced`` (divided by ASCII white space), ``lowered`` (the
    same with A-Z in lower case) or ``alphanumeric`` (lower-cased, divided by
    all other ASCII characters too). ``starts`` and ``ends`` are byte places,
    ``first`` has each text's first
    word (``n + 1`` values), ``hashes`` one 64-bit hash per word.
    """

    def __init__(self, column, kind: str = "spaced"):
        self.bytes, self.offsets = utf8(column)
        if kind != "spaced":
            self.bytes = LOWER[self.bytes]
        inside = ALPHANUMERIC[self.bytes] if kind == "alphanumeric" else ~SPACES[self.bytes]
        self.starts, self.ends = runs(inside, self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = span_hashes(prefix_sums(_BYTE_VALUES[self.bytes], BYTE_BASE), self.starts, self.ends, BYTE_BASE)

    def sums(self, base: int = WORD_BASE) -> np.ndarray:
        return prefix_sums(self.hashes, base)

    def inside_text(self, width: int) -> np.ndarray:
        """For each window of ``width`` words, whether it lies in one text."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, bool)
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(n) + width <= last[:n]


def byte_sums(data: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    return prefix_sums(_BYTE_VALUES[data], base)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Places covered by windows of ``width`` that begin at ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:-1]) > 0


def spread(marks: np.ndarray, width: int) -> np.ndarray:
    """For each place, whether one of the ``width`` places from it on is marked."""
    n = len(marks)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[np.minimum(np.arange(n) + width, n)] > total[:-1]


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def pieces(table: pa.Table | pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of a batch whose text column holds about ``limit`` bytes at most; a longer text is alone."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(table.column(column)), 0)).astype(np.int64)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield table.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    if begin < len(sizes):
        yield table.slice(begin)
