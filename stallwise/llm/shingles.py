"""Word shingles of texts as 64-bit hashes, computed over Arrow buffers with numpy.

A word's hash is a polynomial over its bytes with a random value for each byte,
mixed; a shingle's is a mixed sum of its words' hashes times odd constants. All
arithmetic is modulo 2**64. Equal shingles always agree; two different ones agree
with a chance of about 2**-64, which the similarity tests accept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
GROUP_BYTES = 1_000_000  # of texts whose words are held at a time
CHUNK_BYTES = 256_000  # text hashed at a time; bounds memory for texts of any length

_random = np.random.default_rng(np.random.PCG64(20_240_607))
_BYTE = _random.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(_random.integers(0, 2**63) * 2 + 1)
_PLACE = _random.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = _BYTE[_LOWER]  # A-Z count as a-z


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x + np.uint64((salt * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words_of(data: np.ndarray, at_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte places of the words; ``at_start`` has the places where a text begins."""
    space = _SPACE[data]
    after_word = np.concatenate(([False], ~space[:-1]))
    after_word[at_start] = False
    starts = np.flatnonzero(~space & ~after_word)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    data, space, first = data[starts[0] :], space[starts[0] :], starts - starts[0]
    inner = np.arange(len(data), dtype=np.int32)
    inner -= np.repeat(first.astype(np.int32), np.diff(np.append(first, len(data))))
    inner[space] = 0
    powers = np.empty(int(inner.max()) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = _STEP
    np.multiply.accumulate(powers, out=powers)
    value = _VALUE[data] * powers[inner]
    value[space] = 0
    return mix(np.add.reduceat(value, first)), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the first word of each text (one more entry than texts)."""
    hashes, places, low, end = [], [], int(offsets[0]), int(offsets[-1])
    while low < end:
        high = min(low + CHUNK_BYTES, end)
        while high < end and not _SPACE[data[high]]:  # never cut a word
            high += 1
        inside = offsets[(offsets >= low) & (offsets < high)]
        found, at = _words_of(data[low:high], inside - low)
        hashes.append(found)
        places.append(at + low)
        low = high
    all_places = np.concatenate(places) if places else np.empty(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.searchsorted(all_places, offsets)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for a null or a text without words."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):  # a group of texts at a time, of any length if it is one
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + GROUP_BYTES, "right")) - 1)
        part = texts.slice(start, stop - start)
        start = stop
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        words, first = word_hashes(data, offsets)
        whole = np.empty(0, np.uint64)
        if len(words) >= SHINGLE:
            last = len(words) - SHINGLE + 1
            whole = words[:last] * _PLACE[0]
            for k in range(1, SHINGLE):
                whole = whole + words[k : k + last] * _PLACE[k]
            whole = mix(whole, SHINGLE)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= SHINGLE:
                yield _distinct(whole[a : b - SHINGLE + 1])
            elif b > a:
                yield mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True), int(b - a))
            else:
                yield np.empty(0, np.uint64)
