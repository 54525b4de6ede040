"""Hashed word shingles of whole texts, vectorised over bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

U = np.uint64
STEP, LENGTH = U(0xC2B2AE3D27D4EB4F), U(0x9E3779B97F4A7C15)
#: Bytes from which on a word is hashed by xxh3.
LONG = 64
#: Texts are hashed together in stretches of about so many bytes, so that short ones don't pay for calls of numpy one by one.
STRETCH = 1 << 18
#: For bytes.translate: 1 for white space; A-Z lower-cased.
_space = bytes(int(i == 0x20 or 0x09 <= i <= 0x0D) for i in range(256))
_low = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_first = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def _mix(x: np.ndarray) -> np.ndarray:
    """mixed() in place."""
    shifted = x >> U(30)
    x ^= shifted
    x *= U(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, U(27), out=shifted)
    x *= U(0x94D049BB133111EB)
    x ^= np.right_shift(x, U(31), out=shifted)
    return x


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values; one to one."""
    return _mix(np.array(x, U))


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where it begins."""
    space = np.frombuffer(b"\1" + raw.translate(_space) + b"\1", np.bool_)
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, size = edges[0::2], edges[1::2] - edges[0::2]
    low = np.frombuffer(raw.translate(_low) + bytes(8), np.uint8)
    eight = np.ndarray(len(raw), "<u8", low, 0, (1,))  # the eight bytes from each place on
    h = _mix(eight[start] & _first[np.minimum(size, 8)])
    h = _mix(h + size.astype(U) * LENGTH)
    more = np.flatnonzero((size > 8) & (size < LONG))
    for at in range(8, LONG, 8):
        more = more[size[more] > at]
        if not len(more):
            break
        h[more] = _mix(h[more] * STEP ^ (eight[start[more] + at] & _first[np.minimum(size[more] - at, 8)]))
    for i in np.flatnonzero(size >= LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(low[start[i] : start[i] + size[i]].tobytes())
    return h, start


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word: a run without space or \\t-\\r, A-Z lower-cased. Eight bytes at a time are mixed into a
    word's hash, so no two words collide but by chance."""
    return _hashed(_encoded(text))[0]


def words_of(text: str | None) -> list[bytes]:
    """The words themselves; white space and A-Z of bytes are those of word_hashes."""
    return _encoded(text).lower().split()


def word_shingles(text: str | None, k: int = 5) -> set[tuple[bytes, ...]]:
    """The k-word shingles themselves; of fewer words, the whole sequence; of none, nothing."""
    words = words_of(text)
    k = min(k, len(words))
    return set(zip(*[words[i:] for i in range(k)]))


def words_key(text: str | None) -> bytes:
    """128 bits that stand for a text's sequence of words."""
    return hashlib.blake2b(b" ".join(words_of(text)), digest_size=16).digest()


def _sets(raws: list[bytes], k: int) -> list[np.ndarray]:
    """shingle_sets of one stretch, not empty. Shingles over the border of two texts are computed and left out."""
    words, place = _hashed(b"\n".join(raws))
    end = np.searchsorted(place, np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1))
    first = np.append(0, end[:-1])
    n = end - first
    stop = first + np.where(n >= k, n - k + 1, np.minimum(n, 1))
    whole = max(0, len(words) - k + 1)
    h = np.zeros(len(words), U)
    h[:whole] = k
    for i in range(k):
        h[:whole] *= STEP
        h[:whole] += words[i : whole + i]
    for at in np.flatnonzero((n > 0) & (n < k)).tolist():  # fewer words than k
        one = np.full(1, n[at], U)
        for word in words[first[at] : end[at]]:
            one = one * STEP + word
        h[first[at]] = one[0]
    _mix(h)
    new = np.zeros(len(words), np.bool_)
    for a, b in zip(first.tolist(), stop.tolist()):
        h[a:b].sort()
        new[a:b] = True
    new[1:] &= h[1:] != h[:-1]
    new[first[n > 0]] = True
    before = np.append(0, np.cumsum(new))
    h = h[new]
    return [h[a:b] for a, b in zip(before[first].tolist(), before[stop].tolist())]


def shingle_sets(texts: Iterable[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of fewer words, the whole sequence; of none, nothing.
    The sets of a stretch share an array: one that is kept for long is better copied."""
    raws, held = [], 0
    for text in texts:
        raws.append(_encoded(text))
        held += len(raws[-1])
        if held >= STRETCH:
            yield from _sets(raws, k)
            raws, held = [], 0
    if raws:
        yield from _sets(raws, k)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """shingle_sets of one text."""
    return _sets([_encoded(text)], k)[0]


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set of hashes."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
