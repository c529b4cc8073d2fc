"""Sets of word shingles as sorted 64-bit hashes; runs inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
SHINGLE = 5
#: Bytes of a text whose words are hashed at once.
BLOCK = 1 << 20
#: Words with more bytes than this are hashed one by one.
LONG_WORD = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WHITE = bytes([32, *range(9, 14)])
#: A-Z become a-z, all white space becomes a space.
_FOLDED = bytes(
    32 if b in _WHITE else b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256)
)
#: The lowest 0 to 8 bytes of a number.
_LOWEST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a text: eight bytes of all words at a time."""
    folded = text.translate(_FOLDED)
    inside = np.zeros(len(folded) + 2, bool)
    np.not_equal(np.frombuffer(folded, np.uint8), 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    # The number that the eight bytes from each place on make.
    eights = np.ndarray(len(folded) + 1, "<u8", folded + bytes(8), strides=(1,))
    hashes = (eights[starts] & _LOWEST[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _BASE
    more, done = np.flatnonzero(lengths > 8), 8
    while len(more) and done < LONG_WORD:
        rest = eights[starts[more] + done] & _LOWEST[np.minimum(lengths[more] - done, 8)]
        hashes[more] = _mixed(hashes[more]) * _BASE + rest
        done += 8
        more = more[lengths[more] > done]
    hashes = _mixed(hashes)
    for i in more:
        hashes[i] = xxhash.xxh3_64_intdigest(folded[starts[i] : starts[i] + lengths[i]])
    return hashes


def word_hashes(text: bytes) -> np.ndarray:
    """A hash per word of a UTF-8 text, A-Z lower-cased; long texts in blocks between words."""
    parts, start = [], 0
    while start < len(text):
        end = start + BLOCK
        if end < len(text):
            space = max(text.rfind(bytes([w]), start, end) for w in _WHITE)
            if space <= start:  # one word is longer than a block
                found = [x for w in _WHITE if (x := text.find(bytes([w]), start + 1)) >= 0]
                space = min(found, default=len(text))
            end = space
        parts.append(_word_hashes(text[start:end]))
        start = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(text: bytes | str | None) -> np.ndarray:
    """Distinct shingles of a text, A-Z lower-cased, as sorted unsigned hashes.

    A text with fewer words than a shingle gives its whole sequence as one; a text
    without words, or NULL, gives none.
    """
    if not text:
        return np.empty(0, np.uint64)
    h = word_hashes(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text)
    if not len(h):
        return h
    width = min(SHINGLE, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total = total * _BASE + h[k : k + len(total)]
    total = np.sort(_mixed(total))
    new = np.ones(len(total), bool)
    np.not_equal(total[1:], total[:-1], out=new[1:])
    return total[new]


def set_hash(sorted_hashes: np.ndarray) -> int:
    """One signed 64-bit hash of a whole set."""
    value = xxhash.xxh3_64_intdigest(sorted_hashes.tobytes())
    return value - (1 << 64) if value >> 63 else value


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())
