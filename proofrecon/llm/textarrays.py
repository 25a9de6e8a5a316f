"""Words, shingles and spans of many documents as NumPy arrays.

Documents are joined into one buffer with a line feed between them, so nothing spans two of them. Hashes are 64-bit
polynomials modulo 2**64 over random byte values, then mixed; they are the same in every process.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}

#: The bytes that separate words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inverse" if inverse else "base"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE, np.uint64)
        steps[0] = 1
        have = _POWERS[key] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The documents in one buffer, a line feed after each; where each begins, and at last the buffer's end."""
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in docs], out=starts[1:])
    return np.frombuffer(b"\n".join([*docs, b""]), np.uint8), starts


def prefix(buf: np.ndarray) -> np.ndarray:
    """Sums of byte * base**place before each place; span hashes follow from differences."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(len(buf)), out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of a buffer with these prefix sums; the place doesn't matter."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), inverse=True)[starts])


def words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document (and one more) its first word's index."""
    space = SPACE[buf]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    begin, end = edge[::2], edge[1::2]
    return begin, end, np.searchsorted(begin, starts)


def shingles(docs: list[bytes], size: int) -> list[np.ndarray]:
    """Each document's distinct ``size``-word shingles as sorted 64-bit hashes.

    A-Z are lower-cased first. With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    buf, starts = joined([d.lower() for d in docs])
    begin, end, first = words(buf, starts)
    word = spans(prefix(buf), begin, end)
    count = np.diff(first)
    rolled = word.copy()
    for k in range(1, size):
        rolled = mix(rolled[: len(word) - k] * np.uint64(0xD6E8FEB86659FD93) + word[k:]) if len(word) > k else rolled[:0]
    out = []
    for d, n in enumerate(count.tolist()):
        if n >= size:
            out.append(np.unique(rolled[first[d] : first[d] + n - size + 1]))
        elif n:
            h = word[first[d]]
            for w in word[first[d] + 1 : first[d] + n]:
                h = mix(np.array([h * np.uint64(0xD6E8FEB86659FD93) + w]))[0]
            out.append(mix(np.array([h + np.uint64(n)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
