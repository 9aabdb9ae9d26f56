"""Vectorised hashes of words and shingles in Arrow batches of texts."""

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at a time; a longer text is cut at white space.
SLAB = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a byte array, A-Z as lower case; words are runs without ASCII white space.

    Each 8 bytes of a word are mixed with their place before they are added, so no arrangement of bytes collides by rule.
    """
    word = ~_SPACE[data]
    if not word.any():
        return np.empty(0, np.uint64)
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    at = np.flatnonzero(word)
    starts = np.flatnonzero(word & ~before)
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    lanes = np.flatnonzero(place & 7 == 0)
    eight = np.bitwise_or.reduceat(_LOWER[data[at]].astype(np.uint64) << (place & 7).astype(np.uint64) * np.uint64(8), lanes)
    terms = mixed(eight ^ mixed(((place[lanes] >> 3) + 1).astype(np.uint64) * _BASE))
    return mixed(np.add.reduceat(terms, np.searchsorted(lanes, first)) + lengths.astype(np.uint64))


def _slabs(data: np.ndarray) -> Iterator[np.ndarray]:
    begin = 0
    while begin < len(data):
        end = min(begin + SLAB, len(data))
        if end < len(data):
            # Cut behind the last white space, or behind the next where a word is longer than a slab.
            spaces = np.flatnonzero(_SPACE[data[begin:end]])
            if len(spaces):
                end = begin + int(spaces[-1]) + 1
            else:
                while end < len(data) and not _SPACE[data[end]]:
                    end += 1
        yield data[begin:end]
        begin = end


def text_words(texts) -> Iterator[np.ndarray]:
    """For each text of an Arrow string array the hashes of its words; null: none.

    Runs of short texts are hashed together, with a space between.
    """
    pending, size = [], 0

    def flush():
        joined = b" ".join(pending)
        counts = [len(p.split()) for p in pending]
        hashes = word_hashes(np.frombuffer(joined, np.uint8))
        yield from np.split(hashes, np.cumsum(counts)[:-1])

    for text in texts:
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        if len(data) > SLAB // 4:
            if pending:
                yield from flush()
                pending, size = [], 0
            yield np.concatenate([word_hashes(s) for s in _slabs(np.frombuffer(data, np.uint8))] or [np.empty(0, np.uint64)])
            continue
        pending.append(data)
        size += len(data)
        if size > SLAB:
            yield from flush()
            pending, size = [], 0
    if pending:
        yield from flush()


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * _BASE + words[k: k + n]
    return mixed(total)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of the whole sequence where it is shorter; none without words."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))))
