"""Words of UTF-8 buffers as arrays: positions and 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import functools

import numpy as np

#: Lower-cases A-Z, leaves all other bytes.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
#: Bytes of words: digits, letters, and all of non-ASCII characters.
ALNUM = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
PIECE = 1 << 21
_P = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * PIECE + 1
    up, down = np.full(n, _P, dtype=np.uint64), np.full(n, pow(_P, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the SplitMix64 finalizer)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for spans in a buffer of 2 * PIECE bytes at most."""
    up, down = _powers()
    s = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=s[1:])
    return mix((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans(buf: np.ndarray, is_word: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of word bytes."""
    edge = np.flatnonzero(np.diff(is_word[buf].view(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


def words(buf: np.ndarray, is_word: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the maximal runs of word bytes, lower-cased for the hash. Long buffers are taken in
    pieces that end between words; a single word longer than a piece is hashed by pieces of its own."""
    out, at = [], 0
    while at < len(buf):
        to = min(len(buf), at + PIECE)
        if to < len(buf):
            gap = np.flatnonzero(~is_word[buf[at:to]][::-1][: PIECE // 2])
            to = to - int(gap[0]) if len(gap) else to
        part = buf[at:to]
        s, e = spans(part, is_word)
        out.append((s + at, e + at, span_hashes(LOWER[part], s, e)))
        at = to
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    s, e, h = (np.concatenate(x) for x in zip(*out))
    torn = np.flatnonzero(s[1:] == e[:-1])
    if len(torn):
        head = np.ones(len(s), dtype=bool)
        head[torn + 1] = False
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(s)) - 1
        rank = np.arange(len(s)) - np.repeat(first, last - first + 1)
        h = np.where(rank > 0, mix(h + rank.astype(np.uint64)), h)
        s, e, h = s[first], e[last], np.bitwise_xor.reduceat(h, first)
    return s, e, h


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, a line feed after each, and their offsets (one more than texts)."""
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=off[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", dtype=np.uint8), off
