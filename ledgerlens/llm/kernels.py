"""Numpy kernels over the bytes of a batch of texts. Small helpers that run inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Fixed by the operators' contracts: the bytes that separate words.
SEPARATORS = (9, 10, 11, 12, 13, 32)
SEP = np.zeros(256, bool)
SEP[list(SEPARATORS)] = True
#: Bytes of text that one call of a kernel gets (or one text, if that is longer).
CHUNK = 1_000_000

_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTES = [np.random.default_rng(40 + i).integers(0, 2**64, 256, dtype=U) for i in range(2)]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int, lane: int, inverse: bool = False) -> np.ndarray:
    have = _powers.get((lane, inverse))
    if have is None or len(have) < n:
        base = pow(_LANES[lane], -1, 2**64) if inverse else _LANES[lane]
        have = np.full(max(n, 1 << 16), base, dtype=U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[lane, inverse] = have
    return have[:n]


def prefix(symbols: np.ndarray, lane: int) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, dtype=U)
    np.cumsum(symbols * powers(len(symbols), lane), out=out[1:])
    return out


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """The hash of symbols [start, end), wherever they stand."""
    h = (pre[ends] - pre[starts]) * powers(len(pre), lane, True)[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def window_hash(pre: np.ndarray, n: int, lane: int) -> np.ndarray:
    """span_hash of every n symbols in a row."""
    if len(pre) <= n:
        return np.zeros(0, dtype=U)
    h = (pre[n:] - pre[:-n]) * powers(len(pre), lane, True)[: len(pre) - n]
    return mix(h + U(n * 0xD6E8FEB86659FD93 % 2**64))


def byte_symbols(buf: np.ndarray, lane: int) -> np.ndarray:
    return _BYTES[lane][buf]


def spans(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each text (with the total at the end)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~sep[buf]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    at = off[:-1]
    before[at[at < len(buf)]] = False
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    to = off[1:]
    after[to[to > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    return span_hash(prefix(byte_symbols(buf, lane), lane), starts, ends, lane)


def sliding_argmin(h: np.ndarray, w: int, most: int = 1 << 26) -> np.ndarray:
    """The leftmost position of the least of each w values in a row (36 bits of a value count); `most` rows of values are looked at together."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    found = [_argmin(h[at : at + most + w - 1], w) + at for at in range(0, len(h) - w + 1, most)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def _argmin(h: np.ndarray, w: int) -> np.ndarray:
    low = U((1 << 28) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=U)
    n = 1
    while n * 2 <= w:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    if n < w:
        m = np.minimum(m[: len(m) - (w - n)], m[w - n :])
    return (m & low).astype(np.int64)


def windows_inside(off: np.ndarray, n: int) -> np.ndarray:
    """The starts of all windows of n symbols that lie within one text."""
    total = int(off[-1]) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64)
    ok = np.zeros(int(off[-1]) + 1, np.int32)
    begin, end = off[:-1], off[1:] - n + 1
    real = end > begin
    np.add.at(ok, begin[real], 1)
    np.add.at(ok, end[real], -1)
    return np.flatnonzero(np.cumsum(ok)[:total] > 0)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array in a row, and where each text begins."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_string(texts.type):
        kind = np.int32
    else:
        texts, kind = texts.cast(pa.large_string()), np.int64
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, data = texts.buffers()
    off = np.frombuffer(o, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK bytes of text, a longer text by itself: bounded memory at any batch size."""
    buf, off = flat(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
