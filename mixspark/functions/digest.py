"""MD5 of many short texts at once, in numpy: hashlib and Spark's ``md5`` cost microseconds a call,
most of it not for hashing."""

from __future__ import annotations

import math

import numpy as np

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_LEFT = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
         for s in row * 4]
_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]


def _mix(i: int, b, c, d, out):
    """The round's function of b, c and d."""
    if i < 16:
        np.bitwise_xor(c, d, out=out)
        out &= b
        out ^= d
    elif i < 32:
        np.bitwise_xor(b, c, out=out)
        out &= d
        out ^= c
    elif i < 48:
        np.bitwise_xor(b, c, out=out)
        out ^= d
    else:
        np.invert(d, out=out)
        out |= b
        out ^= c


def md5_words(heads: np.ndarray, tails: np.ndarray) -> list[np.ndarray]:
    """The four 32-bit words of the digest of each head followed by each tail. Heads and tails are
    byte matrices, a text per row; the words come as matrices, heads by tails."""
    (n, p), (k, q) = heads.shape, tails.shape
    size = p + q
    text = np.zeros((n, k, size // 4 * 4 + 4), np.uint8)
    text[:, :, :p] = heads[:, None, :]
    text[:, :, p:size] = tails
    text[:, :, size] = 0x80
    filled = text.view("<u4").reshape(n * k, -1)
    # The words after the text are the same for all: nothing, then the length in bits.
    words = [filled[:, w].copy() for w in range(filled.shape[1])]
    end = ((size + 8) // 64 + 1) * 16
    words += [0] * (end - len(words))
    words[end - 2], words[end - 1] = 8 * size % 2**32, 8 * size >> 32
    state = [np.full(n * k, x, np.uint32) for x in _START]
    spare, high = np.empty(n * k, np.uint32), np.empty(n * k, np.uint32)
    for block in range(0, end, 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            word = words[block + _WORD[i]]
            _mix(i, b, c, d, spare)
            spare += a
            if isinstance(word, int):
                spare += np.uint32((word + _ADD[i]) % 2**32)
            else:
                spare += word
                spare += np.uint32(_ADD[i])
            np.right_shift(spare, np.uint32(32 - _LEFT[i]), out=high)
            spare <<= np.uint32(_LEFT[i])
            spare |= high
            spare += b
            a, b, c, d, spare = d, spare, b, c, a
        for x, y in zip(state, (a, b, c, d)):
            x += y
    return [x.reshape(n, k) for x in state]
