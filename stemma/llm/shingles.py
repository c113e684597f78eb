"""Sets of word shingles as 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
#: Odd multipliers, one for each place in a shingle; any odd random numbers do.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SHORT = np.array([0x0, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (ASCII white space apart, A-Z lowered), each text's words as indices, their number in each text."""
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())  # a slice's offset misleads the split
    texts = pc.ascii_lower(texts) if lower else texts
    for space in "\t\n\x0b\x0c\r":  # Arrow's own split at white space cuts inside characters
        texts = pc.replace_substring(texts, space, " ")
    lists = pc.split_pattern(texts, " ")
    coded = pc.dictionary_encode(lists.flatten())
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    blank = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py()
    if blank >= 0:  # what stands between two spaces or before the first
        keep = code != blank
        code, owner = code[keep], owner[keep]
    return coded.dictionary, code, np.bincount(owner, minlength=len(texts))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Tabulation hashing: a random number for each byte value at each place of a word; the seed is part of the format.
_TABLE = np.random.default_rng(20240517).integers(0, 1 << 63, (64, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(found: pa.Array) -> np.ndarray:
    """64-bit hashes of words (large strings), all at once."""
    if not len(found):
        return np.zeros(0, np.uint64)
    _, starts, data = found.buffers()
    starts = np.frombuffer(starts, np.int64)[found.offset : found.offset + len(found) + 1]
    data = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(starts)
    place = np.arange(len(data)) - np.repeat(starts[:-1] - starts[0], lengths)
    value = _TABLE[place % 64, data] * (2 * (place // 64).astype(np.uint64) + np.uint64(1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    ends = np.cumsum(lengths)
    return mix(sums[ends] - sums[ends - lengths] + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, ascending within each, and the offsets of each text's.

    A text of fewer words than a shingle has one, of all its words; a text without words has none.
    """
    found, code, counts = words(texts)
    hashes = word_hashes(found)
    word = hashes[code] if len(code) else np.zeros(0, np.uint64)
    first = np.cumsum(counts) - counts
    whole = np.zeros(max(0, len(word) - WIDTH + 1), np.uint64)
    for i in range(WIDTH):
        whole += word[i : i + len(whole)] * _PLACE[i]
    whole = mix(whole)
    sets = []
    for at, n in zip(first.tolist(), counts.tolist(), strict=True):
        if n >= WIDTH:
            sets.append(np.unique(whole[at : at + n - WIDTH + 1]))
        elif n:
            sets.append(mix((word[at : at + n] * _PLACE[:n]).sum(keepdims=True) + _SHORT[n]))
        else:
            sets.append(np.zeros(0, np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offsets
