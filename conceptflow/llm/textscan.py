"""Byte-level word scanning and rolling hashes shared by the text operators.

All functions are pure numpy/xxhash and run inside Arrow batches on the
executors. Texts travel as UTF-8 bytes, so no decoding is paid for.
"""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Lower-cases A-Z and turns every ASCII byte outside 0-9, A-Z, a-z into a space.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def ascii_lower(text: bytes) -> bytes:
    return text.translate(_LOWER)


def space_words(text: bytes | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+``: bytes.split() cuts at exactly these six bytes."""
    return text.split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    r"""Lower-cased words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``."""
    return text.translate(_ALNUM).split() if text else []


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words) if seed else map(digest, words), np.uint64, len(words))


class RollingHash:
    """Polynomial hash (mod 2**64, odd base) of every run of ``width`` words.

    Prefix sums of ``w[j] * B**j`` are differenced and multiplied by ``B**-i``,
    so equal word runs have equal hashes wherever they start.
    """

    def __init__(self, base: int = 0x9E3779B97F4A7C15) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        size = max(1024, 1 << (n - 1).bit_length())
        for name, factor in (("up", self.base), ("down", self.inverse)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def windows(self, hashes: np.ndarray, width: int) -> np.ndarray:
        n = len(hashes) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        if len(self.up) < len(hashes):
            self._powers(len(hashes))
        prefix = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=prefix[1:])
        return mixed((prefix[width:] - prefix[:n]) * self.down[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads the low bits of a product over the word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the ``n`` places inside any run of ``width`` that begins at ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def shingle_bytes(words: list[bytes], k: int) -> list[bytes]:
    """Space-joined runs of ``k`` words; the whole sequence if it is shorter; none if empty."""
    if not words:
        return []
    if len(words) <= k:
        return [b" ".join(words)]
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    return [joined[i:j] for i, j in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
