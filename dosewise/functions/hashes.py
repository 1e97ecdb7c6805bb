"""md5 of many short numbered texts at once; `draws.order_number` for NumPy code inside tasks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# Numbers that differ in their last digits only are hashed together, few enough for the processor's cache.
LOW_DIGITS = 4
SPAN = 10**LOW_DIGITS
# Longest text that fills one md5 block with its end mark and length.
LONGEST = 55

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _mixed(k: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray) -> None:
    if k == 0:
        np.bitwise_xor(c, d, out=out)
        np.bitwise_and(out, b, out=out)
        np.bitwise_xor(out, d, out=out)
    elif k == 1:
        np.bitwise_xor(b, c, out=out)
        np.bitwise_and(out, d, out=out)
        np.bitwise_xor(out, c, out=out)
    elif k == 2:
        np.bitwise_xor(b, c, out=out)
        np.bitwise_xor(out, d, out=out)
    else:
        np.invert(d, out=out)
        np.bitwise_or(out, b, out=out)
        np.bitwise_xor(out, c, out=out)


def _first_words(words: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First two words of the digests of n one-block texts; a word is an array of n or the same for all."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    high = np.empty(n, np.uint32)
    for i in range(64):
        k, free = i // 16, np.empty(n, np.uint32) if i == 0 else free
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[k] % 16]
        _mixed(k, b, c, d, free)
        np.add(free, a, out=free)
        if isinstance(word, np.ndarray):
            np.add(free, word, out=free)
            np.add(free, _SINES[i], out=free)
        else:
            np.add(free, np.uint32((int(word) + int(_SINES[i])) & 0xFFFFFFFF), out=free)
        turn = _SHIFTS[k][i % 4]
        np.right_shift(free, np.uint32(32 - turn), out=high)
        np.left_shift(free, np.uint32(turn), out=free)
        np.bitwise_or(free, high, out=free)
        np.add(free, b, out=free)
        a, b, c, d, free = d, free, b, c, a
    return a + _START[0], b + _START[1]


@lru_cache(maxsize=64)
def _digits(first: int, last: int, length: int, offset: int) -> dict[int, np.ndarray]:
    """Words that hold first..last-1 as `length` digits and the end mark, if they start at byte `offset`."""
    numbers, words = np.arange(first, last), {}
    for i in range(length + 1):
        octet = numbers // 10 ** (length - 1 - i) % 10 + 48 if i < length else np.full(last - first, 128)
        at, shift = divmod(offset + i, 4)
        words[at] = words.get(at, 0) + (octet.astype(np.uint32) << np.uint32(8 * shift))
    return words


def _spans(n: int) -> Iterator[tuple[int, str, int, int, int]]:
    """1..n in parts: first number, leading digits, first and last + 1 of the other digits, how many those are."""
    for length in range(1, LOW_DIGITS + 1):
        if n >= (first := 10 ** (length - 1)):
            yield first, "", first, min(n + 1, 10**length), length
    for first in range(SPAN, n + 1, SPAN):
        yield first, str(first // SPAN), 0, min(n + 1 - first, SPAN), LOW_DIGITS


def order_numbers(heads: list[str], n: int) -> np.ndarray:
    """60-bit numbers of the texts head|1 .. head|n, a row for each head."""
    found = np.empty((len(heads), n), np.int64)
    for first, lead, low, high, length in _spans(n):
        coded, width = [f"{h}|{lead}".encode() for h in heads], high - low
        many = max(1, SPAN // width)
        for size in {len(h) for h in coded}:
            rows = np.array([k for k, h in enumerate(coded) if len(h) == size])
            for at in range(0, len(rows), many):
                part = rows[at : at + many]
                found[part, first - 1 : first - 1 + width] = _numbers([coded[k] for k in part], low, high, length)
    return found


def _numbers(heads: list[bytes], low: int, high: int, length: int) -> np.ndarray:
    """The same for equally long heads and the numbers low..high-1 written with `length` digits."""
    size, width = len(heads[0]), high - low
    if size + length > LONGEST:
        octets = b"".join([hashlib.md5(b"%b%0*d" % (h, length, p)).digest()[:8] for h in heads for p in range(low, high)])
        return (np.frombuffer(octets, ">u8") >> np.uint64(4)).astype(np.int64).reshape(len(heads), width)
    padded = np.frombuffer(b"".join(h.ljust(64, b"\0") for h in heads), "<u4").reshape(len(heads), 16)
    tail, words = _digits(low, high, length, size), []
    for w in range(16):
        if w in tail:
            words.append((padded[:, w : w + 1] + tail[w]).ravel())
        else:
            words.append(padded[0, w] if len(heads) == 1 else np.repeat(padded[:, w], width))
    words[14] = 8 * (size + length)
    a, b = _first_words(words, len(heads) * width)
    return (a.byteswap().astype(np.int64) << 28 | b.byteswap() >> np.uint32(4)).reshape(len(heads), width)
