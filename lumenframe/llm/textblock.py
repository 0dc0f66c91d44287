"""Hashes of words and word shingles for blocks of texts, in numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word is cut into chunks of
64 bytes. A chunk adds up a random 64-bit number for each byte and place, a word mixes its
chunks with their places, and a 64-bit finaliser follows, so no step is a polynomial that
structured words could cancel. Equal words have equal hashes wherever they stand; a second
table gives an independent hash.
"""

from __future__ import annotations

import numpy as np

_STEP = 1 << 20
_CHUNK = 64
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, .. start + size - 1 of each pair, one after the other."""
    at = np.repeat(start - np.cumsum(size) + size, size)
    at += np.arange(len(at))
    return at


#: By table, place in a chunk and byte.
_NUMBERS = mix64(np.arange(1, 2 * _CHUNK * 256 + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)).reshape(2, -1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _block(data: bytes, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words of data."""
    b = np.frombuffer(data, np.uint8)
    word = ~_IS_SPACE[b]
    edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    place = np.arange(len(b), dtype=np.int32)
    place[starts[0] :] -= np.repeat(starts, np.diff(starts, append=len(b))).astype(np.int32)
    prefix = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_NUMBERS[table][((place & (_CHUNK - 1)) << 8) | b], out=prefix[1:])
    if sizes.max() <= _CHUNK:
        sums = mix64(prefix[ends] - prefix[starts] + _PLACE)
    else:
        chunks = -(-sizes // _CHUNK)
        first = np.cumsum(chunks) - chunks
        nth = ranges(np.zeros(len(chunks), np.int64), chunks)
        lo = np.repeat(starts, chunks) + nth * _CHUNK
        hi = np.minimum(lo + _CHUNK, np.repeat(ends, chunks))
        sums = np.add.reduceat(mix64(prefix[hi] - prefix[lo] + (nth + 1).astype(np.uint64) * _PLACE), first)
    return mix64(sums + sizes.astype(np.uint64)), starts


def word_hashes(texts: list[bytes], table: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, counts of words by text). Memory: 8 bytes a word and a few MB;
    long texts are cut between words, which changes nothing."""
    counts = np.zeros(len(texts), np.int64)
    out: list[np.ndarray] = []
    pending: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pending:
            hashes, starts = _block(b"\n".join(pending), table)
            bounds = np.cumsum([0] + [len(p) + 1 for p in pending])
            per = np.diff(np.searchsorted(starts, bounds))
            np.add.at(counts, owner, per)
            out.append(hashes)
        pending.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > _STEP:
            cut = at + _STEP
            while cut < len(text) and not _IS_SPACE[text[cut]]:
                cut += 1
            flush()
            pending.append(text[at:cut])
            owner.append(i)
            flush()
            at = cut
        rest = text[at:] if at else text
        if size + len(rest) + 1 > _STEP:
            flush()
        pending.append(rest)
        owner.append(i)
        size += len(rest) + 1
    flush()
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct hashes, sorted, of the k-word shingles of one text; fewer words make one shingle."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    h = np.full(n - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        h = mix64(h * _PLACE + words[j : n - width + 1 + j])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
