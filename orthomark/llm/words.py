"""Words of whole texts as 64-bit codes, found for many texts in one vectorised pass.

A batch of texts is one buffer of UTF-8 bytes. A table maps every byte to its lower-case form or
to 0 (no word byte); A-Z is lowered, bytes of non-ASCII characters are word bytes or not as a
whole, so a rule about characters is a rule about bytes. Every word gets a polynomial hash of
its bytes, taken from prefix sums, and then a final mixing step. Equal words have equal codes;
different words collide with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STEP = 1 << 20  # bytes handled at a time; a longer text is a step of its own
U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_P_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_table(word_byte) -> np.ndarray:
    """256 entries: the lower-case byte where ``word_byte(byte)`` holds, else 0."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if word_byte(low):
            table[b] = low
    return table


#: Words of letters, digits and non-ASCII characters.
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Words between ASCII white space.
SPACED = byte_table(lambda b: b != 32 and not 9 <= b <= 13)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all of them, one to one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: np.uint64, size: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64."""
    out = np.full(size, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of some texts: codes, byte ranges in ``data`` (lower-cased, 0 between words), text numbers."""

    __slots__ = ("codes", "starts", "ends", "text", "counts", "data", "bounds")

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, table: np.ndarray):
        # One zero byte after each text keeps words apart.
        n = len(bounds) - 1
        self.data = np.zeros(len(raw) + n + 1, np.uint8)
        lengths = np.diff(bounds)
        where = np.arange(len(raw)) + np.repeat(np.arange(n), lengths) if n > 1 else slice(0, len(raw))
        self.data[where] = table[raw]
        self.bounds = bounds + np.arange(n + 1)
        inside = self.data != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.codes = np.zeros(len(self.starts), U64)
        at = 0
        while at < len(self.starts):  # a very long text is hashed in parts
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + 2 * STEP)))
            starts, ends = self.starts[at:to] - base, self.ends[at:to] - base
            size = int(ends[-1])
            sums = np.zeros(size + 1, U64)
            np.cumsum(self.data[base:base + size] * _powers(_P, size), out=sums[1:])
            self.codes[at:to] = (sums[ends] - sums[starts]) * _powers(_P_INVERSE, size)[starts] + (ends - starts).astype(U64)
            at = to
        self.codes = mix(self.codes)
        firsts = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(firsts)
        self.text = np.repeat(np.arange(n), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the bounds of its texts; a null text is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def steps(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an array into (from, to, bytes, bounds) of about STEP bytes."""
    raw, bounds = text_bytes(texts)
    at, count = 0, len(bounds) - 1
    while at < count:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + STEP, side="right")) - 1)
        yield at, to, raw[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
        at = to


def word_steps(texts: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    for at, to, raw, bounds in steps(texts):
        yield at, to, Words(raw, bounds, table)


def windows(codes: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ``length`` words inside one text, and the position of their first word."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n, U64)
    for k in range(length):
        total = total * _P + codes[k:k + n]
    first = np.flatnonzero(text[:n] == text[length - 1:]) if length > 1 else np.arange(n)
    return mix(total[first] + U64(length)), first
