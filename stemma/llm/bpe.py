"""Byte-level BPE by corpus-level merge replay.

The texts of a block (about ``BLOCK_BYTES`` of a task's texts, or one longer text) are taken as one corpus.  Its distinct words are laid end to end in
one symbol array, an inverted index maps each token pair (by the rank of its merge) to the positions where it stands,
and every merge that occurs is applied in rank order to all its positions at once; only the neighbours of a merged
pair are looked up again and enter the index.  Nothing is kept between blocks, so memory is bounded by a block and a
lost task is simply run again.

Words are matches of the tokenizer's split pattern.  As no match reaches across a single space that stands between two
non-space characters, texts are first cut there (Arrow's split and dictionary encoding, in C++), and the pattern runs
over distinct chunks only.  A text that has a space before other white space, or at its end, is cut by a regular
expression instead.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: RE2 has no Unicode ``\s``, so the white space that may make a cut unsafe is listed (fixed values of Unicode).
_ODD_SPACE = r" ([\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|$)"
_CUT = regex.compile(r" (?=[^\s\x1c-\x1f])")
_NONE = np.int64(1) << 40
#: Bytes of text encoded, and ids decoded, at once: Arrow batches are bounded in rows, not in memory.
BLOCK_BYTES, BLOCK_IDS = 3 << 20, 1 << 18


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def ragged(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[offsets[i]:offsets[i + 1]]`` of every i in ``index``, joined; and their lengths."""
    lengths = (offsets[1:] - offsets[:-1])[index]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1][index] - (ends - lengths), lengths)
    return values[at], lengths


def blocks(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` in size and one row more."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _sizes(lengths: pa.Array) -> np.ndarray:
    return pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunk(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks of the texts, each text's chunks as indices into them, and the number of chunks in each text.

    A chunk that follows a space has that space as its first character.
    """
    odd = pc.match_substring_regex(texts, _ODD_SPACE)
    codes, counts, words, base = [], np.zeros(len(texts), np.int64), [], 0
    for strange in (False, True):
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False) == strange)
        if not len(rows):
            continue
        some = texts.take(pa.array(rows))
        if strange:
            parts = [_CUT.split(t) for t in some.to_pylist()]
            lengths, flat = np.array([len(p) for p in parts]), pa.array([x for p in parts for x in p], pa.large_string())
        else:
            lists = pc.split_pattern(some.cast(pa.large_string()), " ")
            lengths, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
        coded = pc.dictionary_encode(flat)
        first = np.zeros(len(flat), np.int64)
        first[np.cumsum(lengths) - lengths] = 1
        used, code = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + first, return_inverse=True)
        strings = coded.dictionary.to_pylist()
        words += [strings[u >> 1] if u & 1 else " " + strings[u >> 1] for u in used.tolist()]
        codes.append((rows, code + base, lengths))
        counts[rows] = lengths
        base += len(used)
    out, starts = np.zeros(int(counts.sum()), np.int64), np.cumsum(counts) - counts
    for rows, code, lengths in codes:
        at = np.arange(len(code)) + np.repeat(starts[rows] - (np.cumsum(lengths) - lengths), lengths)
        out[at] = code
    return words, out, counts


class MergeReplay:
    """The merges of one vocabulary, replayed over a whole corpus of words at a time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, rank))
        pairs.sort()
        self.keys, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def plain(self, word: bytes) -> list[int]:
        """One word by itself: its lowest pair first, the leftmost of equals."""
        parts = [self.byte[b] for b in word]
        while len(parts) > 1:
            ranks = self.rank_of(np.array(parts[:-1]), np.array(parts[1:]))
            i = int(ranks.argmin())
            if ranks[i] == _NONE:
                break
            parts[i : i + 2] = [int(ranks[i])]
        return [int(p) for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, joined, and the offsets of each word's ids."""
        whole = [self.ranks.get(w) for w in words]
        todo = [i for i, rank in enumerate(whole) if rank is None and words[i]]
        joined = np.frombuffer(b"".join([words[i] for i in todo]), np.uint8)
        lengths = np.array([len(words[i]) for i in todo], np.int64)
        ids, owner, odd = self._merge(self.byte[joined], lengths)
        counts = np.bincount(owner, minlength=len(todo)) if len(todo) else np.zeros(0, np.int64)
        every = np.array([rank is not None for rank in whole], np.int64)
        if len(todo):
            every[todo] = counts
        redone = {todo[i]: self.plain(words[todo[i]]) for i in odd}
        for i, parts in redone.items():
            every[i] = len(parts)
        offsets = np.concatenate([[0], np.cumsum(every)]).astype(np.int64)
        out = np.zeros(offsets[-1], np.int64)
        known = np.array([i for i, rank in enumerate(whole) if rank is not None], np.int64)
        out[offsets[known]] = [whole[i] for i in known]
        if len(todo):
            stay = ~np.isin(owner, np.array(sorted(odd), np.int64))
            ids, owner = ids[stay], owner[stay]
            at = np.flatnonzero(np.diff(owner, prepend=-1))
            within = np.arange(len(owner)) - np.repeat(at, np.diff(np.append(at, len(owner))))
            out[offsets[np.array(todo, np.int64)[owner]] + within] = ids
        for i, parts in redone.items():
            out[offsets[i] : offsets[i + 1]] = parts
        return out, offsets

    def _merge(self, symbol: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """Replay over words laid end to end.  Returns the symbols left, their words, and the words to do again.

        Such a word is one where a merge made a pair of a lower rank while the merge's own pair stood elsewhere in it:
        there the order of ranks over the corpus may differ from the order within the word.
        """
        n = len(symbol)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        after = np.arange(1, n + 1)
        ends = np.cumsum(lengths) - 1
        after[ends] = -1
        before = np.arange(-1, n - 1)
        before[ends - lengths + 1] = -1
        pair = np.full(n, _NONE)
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.rank_of(symbol[inner], symbol[inner + 1])
        alive, odd = np.ones(n, bool), set()
        index: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray) -> None:
            at = at[pair[at] < _NONE]
            if len(at):
                at = at[np.argsort(pair[at], kind="stable")]
                cuts = np.flatnonzero(np.diff(pair[at], prepend=-1))
                for rank, part in zip(pair[at[cuts]].tolist(), np.split(at, cuts[1:]), strict=True):
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(heap, rank)
                    index[rank].append(part)

        heap: list[int] = []
        enter(inner)
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            at = at[(pair[at] == rank) & alive[at]]
            if not len(at):
                continue
            same = symbol[at] == symbol[after[at]]
            if same.any():  # of a run of one symbol, every second pair from the left
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                run = np.flatnonzero(~chained)
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                at = at[place % 2 == 0]
            gone = after[at]
            symbol[at], alive[gone], pair[gone] = rank, False, _NONE
            after[at] = after[gone]
            inside = at[after[at] >= 0]
            before[after[inside]] = inside
            left = before[at]
            touched = np.unique(np.concatenate([at, left[left >= 0]]))
            last = touched[after[touched] < 0]
            pair[last] = _NONE
            touched = touched[after[touched] >= 0]
            pair[touched] = self.rank_of(symbol[touched], symbol[after[touched]])
            lower = touched[pair[touched] < rank]
            if len(lower):
                many = np.bincount(owner[at], minlength=0)
                odd.update(w for w in owner[lower].tolist() if many[w] > 1)
            enter(touched)
        keep = np.flatnonzero(alive)
        return symbol[keep], owner[keep], odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the offsets of each text's ids."""
        chunks, code, counts = chunk(texts)
        vocabulary: dict[str, int] = {}
        words, of = [], []
        for c in chunks:
            found = self.split.findall(c)
            of.append(len(found))
            words += [vocabulary.setdefault(w, len(vocabulary)) for w in found]
        ids, offsets = self.replay([w.encode() for w in vocabulary])
        starts = np.concatenate([[0], np.cumsum(of)]).astype(np.int64)
        ids, lengths = ragged(ids, offsets, np.array(words, np.int64))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids, lengths = ragged(ids, ends[starts], code)  # a chunk's ids are those of its words
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_engines: dict[tuple[str, str], MergeReplay] = {}


def engine(path: str, pattern: str) -> MergeReplay:
    if (path, pattern) not in _engines:
        _engines[path, pattern] = MergeReplay(load_ranks(path), pattern)
    return _engines[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every row, by ordinary text only: no special token is ever made.

    A null text counts as empty and has no ids; an empty table gives an empty result; repeated rows stay, each with
    its own result; other columns of ``docs`` are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = engine(path, pattern)
        for batch in batches:
            for part in blocks(batch, _sizes(pc.binary_length(batch.column(1))), BLOCK_BYTES):
                ids, ends = coder.encode(pc.fill_null(part.column(1), ""))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded binary)``: the bytes of each row's ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = engine(path, pattern)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in coder.tokens])])
        flat = np.frombuffer(b"".join(coder.tokens), np.uint8)
        for batch in batches:
            for part in blocks(batch, _sizes(pc.list_value_length(batch.column(1))), BLOCK_IDS):
                lists = part.column(1)
                of = _sizes(pc.list_value_length(lists))
                data, sizes = ragged(flat, offsets, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                at = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(of)])]
                raw = data.tobytes()
                out = pa.array([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, out], ["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests; a null text has no ids."""
    import public_tokenizers

    from .common import table

    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    done = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op1_bpe": op1_bpe}
ORACLE: dict[str, str] = {}
