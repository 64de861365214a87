"""Words of many texts at once: their places in one buffer and their 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm.common import mix

KEYS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_MASK = 2**64 - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def _hashes_of_block(data: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of data; a word also ends at the places inner (0 < place < length)."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    begins = word[1:] & ~word[:-1]
    begins[inner] |= word[inner + 1]
    ends = word[:-1] & ~word[1:]
    ends[inner] |= word[inner]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    n = end - begin
    text = np.zeros(len(data) + 8, np.uint8)
    text[:-8] = _LOWER[data]
    eight = np.ndarray(len(data) + 1, "<u8", text.data, strides=(1,))  # the eight bytes from each place on
    h = n.astype(np.uint64) * KEYS[2]
    rest = np.arange(len(n))
    for k in range(0, LONG_WORD, 8):
        rest = rest[n[rest] > k]
        if not len(rest):
            break
        left = np.minimum(n[rest] - k, 8)
        part = eight[begin[rest] + k] & (np.uint64(_MASK) >> (64 - 8 * left).astype(np.uint64))
        h[rest] = mix(h[rest] ^ mix(part + KEYS[0]))
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[begin[i] : end[i]].data)
    return h, begin


def word_hashes(data: np.ndarray, borders: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie in data from border to border, and the place of each text's first word among them.

    A word's hash takes it eight bytes at a time, each step a one-to-one function of those bytes and of the
    steps before; data is hashed in blocks that end at a space or a border.
    """
    cuts = np.array([0, len(data)])
    if len(data) > block:
        gaps = _SPACE[data]
        gaps[borders[:-1][borders[:-1] < len(data)]] = True
        gaps = np.flatnonzero(gaps)
        at = np.searchsorted(gaps, np.arange(block, len(data), block))
        cuts = np.unique(np.concatenate((cuts, gaps[at[at < len(gaps)]])))
    hashes, begins = [], []
    for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        inside = borders[(borders > i) & (borders < j)] - i
        h, begin = _hashes_of_block(data[i:j], inside)
        hashes.append(h)
        begins.append(begin + i)
    return np.concatenate(hashes or [np.empty(0, np.uint64)]), np.searchsorted(np.concatenate(begins or [np.empty(0, np.int64)]), borders)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the borders of its texts in them; nulls are empty."""
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "").cast(pa.large_binary())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[borders[0] : borders[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, borders - borders[0]
