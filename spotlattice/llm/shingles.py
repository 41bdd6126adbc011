"""Word-shingle sets of whole texts as 64-bit hashes, with numpy over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SLAB = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and odd multipliers)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _byte_table() -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))
    t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1]
    return t


_TABLE = _byte_table()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(0, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grow = lambda b: np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, b, _U))[:-1]])
            self.up, self.down = grow(_BASE), grow(pow(_BASE, -1, 1 << 64))
        return self.up, self.down


_POWERS = _Powers()


def _coefficients(width: int) -> np.ndarray:
    return mix(np.arange(1, width + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)


def _slab(texts: Sequence[bytes], width: int) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(x for t in texts for x in (t, b"\n")), np.uint8)
    up, down = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    c = _coefficients(width)
    m = len(words) - width + 1
    rolled = np.zeros(max(0, m), _U)
    for i in range(width if m > 0 else 0):
        rolled += words[i : i + m] * c[i]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        n = hi - lo
        if n >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif n:
            out.append(mix((words[lo:hi] * c[:n]).sum(dtype=_U, keepdims=True) + _U(0x5851F42D4C957F2D) * _U(n)))
        else:
            out.append(np.zeros(0, _U))
    return out


def shingle_sets(texts: Iterator[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted: runs of ``width`` words, or all words where there are fewer."""
    held, size = [], 0
    with np.errstate(over="ignore"):
        for text in texts:
            held.append(text.encode("utf-8", "surrogatepass") if text else b"")
            size += len(held[-1])
            if size >= _SLAB:
                yield from _slab(held, width)
                held, size = [], 0
        if held:
            yield from _slab(held, width)


def set_id(s: np.ndarray, second: bool = False) -> int:
    """A signed 64-bit name of a set, or a second one; equal for equal sets."""
    with np.errstate(over="ignore"):
        total = mix(s + _U(0x9FB21C651E98DF25 if second else 0x2545F4914F6CDD1D)).sum(dtype=_U, keepdims=True)
        return int(mix(total + _U(len(s))).view(np.int64)[0])
