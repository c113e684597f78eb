"""Order-preserving packing by dynamic programming.

Documents are laid end to end in id order.  Windows may be cut at document ends (no penalty), at sentence ends
(``SENTENCE_CUT``) and, inside a stretch of more than ``LONGEST_STRETCH`` ids without either, at every
``FORCED_STEP``-th id (``FORCED_CUT``).  With cut positions c and penalties p,

    cost[j] = min over c[j] - window <= c[i] < c[j] of cost[i] + window - (c[j] - c[i]) + p[j],

so a window's best start has the least cost[i] + c[i] among those in reach: a monotone queue keeps them and the whole
programme is linear.  The corpus is range-partitioned by id into blocks of about ``block_bytes`` bytes of text; each
task streams its block and solves a segment whenever ``SEGMENT`` ids have come together, so memory is bounded whatever
a block or a document holds, and only the last window of a segment can be left short.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunk, load_ranks, ragged, vocabulary_path
from .common import table

WINDOW, END_ID = 2048, 1
SENTENCE_CUT, FORCED_CUT, LONGEST_STRETCH, FORCED_STEP = 8, 64, 192, 32
SEGMENT = 1 << 20
#: Ranges of ids that the documents are dealt to at most; past that they grow with the input.
MOST_BLOCKS = 100_000


class Coder:
    """Ids as the tokenizers library makes them, over each distinct chunk of a batch once."""

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        ranks = load_ranks(path)
        self.coding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        tokens = {rank: token for token, rank in ranks.items()} | {i: s.encode() for s, i in special.items()}
        top = max(tokens) + 1
        self.bytes = np.array([len(tokens.get(i, b"")) for i in range(top)], np.int64)
        self.closes = np.array([tokens.get(i, b"")[-1:] in (b".", b"!", b"?", b"\n") for i in range(top)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, joined, and the offsets of each text's ids."""
        chunks, code, counts = chunk(texts)
        lead = np.array([c[:1] == " " for c in chunks], bool)
        ids: list[list[int]] = [[] for _ in chunks]
        spaced = np.flatnonzero(lead)
        for i in np.flatnonzero(~lead).tolist():
            ids[i] = self.coding.encode(chunks[i], allowed_special="all")
        lengths = np.zeros(len(chunks), np.int64)
        joined = "".join([chunks[i] for i in spaced.tolist()])
        flat = np.array(self.coding.encode(joined, allowed_special="all"), np.int64)
        ends = np.cumsum([len(chunks[i].encode()) for i in spaced.tolist()])
        lengths[spaced] = np.bincount(np.searchsorted(ends, np.cumsum(self.bytes[flat])), minlength=len(spaced)) if len(spaced) else 0
        alone = np.flatnonzero(~lead)
        lengths[alone] = [len(ids[i]) for i in alone.tolist()]
        values = np.concatenate([np.array([x for i in alone.tolist() for x in ids[i]], np.int64), flat])
        order = np.concatenate([alone, spaced])
        offsets = np.zeros(len(chunks) + 1, np.int64)
        starts = np.cumsum(lengths[order]) - lengths[order]
        place = np.empty(len(chunks), np.int64)
        place[order] = np.arange(len(chunks))
        offsets = np.append(starts, len(values))
        out, sizes = ragged(values, offsets, place[code])
        return out, np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, window: int) -> np.ndarray:
    """Indices of the chosen cuts, the last position always among them.  ``positions`` are ascending and start at 0."""
    at, extra = positions.tolist(), penalties.tolist()
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        key, back[j] = queue[0]
        best[j] = key + window - here + extra[j]
        key = best[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return np.array(cuts[::-1], np.int64)


def candidates(ends: np.ndarray, closes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a segment and their penalties, 0 first."""
    total = int(ends[-1])
    penalty = np.full(total + 1, -1, np.int64)
    penalty[np.flatnonzero(closes) + 1] = SENTENCE_CUT
    penalty[ends] = 0
    penalty[0] = 0
    known = np.flatnonzero(penalty >= 0)
    gaps = np.diff(known)
    for i in np.flatnonzero(gaps > min(LONGEST_STRETCH, window)).tolist():
        step = min(FORCED_STEP, window)
        penalty[np.arange(known[i] + step, known[i + 1], step)] = FORCED_CUT
    known = np.flatnonzero(penalty >= 0)
    return known, penalty[known]


def pack(
    docs: DataFrame, path: str, pattern: str, special: dict[str, int], window: int = WINDOW, end_id: int = END_ID,
    block_bytes: int = 8 << 20, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A null text is empty: its only id is ``end_id``.  Rows that share an id, and rows without one (first of all), are
    packed one after another.  An empty table gives no piece.  Other columns are not read, whatever their names.
    Sequence ids are unique, not gapless; offsets are gapless from 0.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, min(-(-total // block_bytes), MOST_BLOCKS))  # a block is read in segments, whatever its size
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base = Coder(path, pattern, special), TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # ids of rows, token ids, their number a row, ids before, ids in all
        waiting = 0

        def solve() -> pa.RecordBatch:
            nonlocal base
            names = [n for x in held for n in x[0]]
            before = np.concatenate([x[3] for x in held])
            ids = np.concatenate([x[1] for x in held])
            ends = np.cumsum(np.concatenate([x[2] for x in held]))
            at, penalties = candidates(ends, coder.closes[np.where(ids == end_id, 0, ids)] & (ids != end_id), window)
            cuts = at[choose_cuts(at, penalties, window)]
            stops = np.union1d(ends, cuts)
            starts = np.concatenate([[0], stops[:-1]])
            doc, seq = np.searchsorted(ends, starts, "right"), np.searchsorted(cuts, starts, "right")
            begin = np.concatenate([[0], ends[:-1]])
            opened = np.concatenate([[0], cuts[:-1]])
            raw = ids.astype("<u4").tobytes()
            full = np.concatenate([x[4] for x in held])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in doc.tolist()], arrow_kind), pa.array(starts - begin[doc] + before[doc]),
                    pa.array(stops - starts), pa.array(full[doc]), pa.array(seq + base), pa.array(starts - opened[seq]),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            base += len(cuts)
            held.clear()
            return out

        arrow_kind = None
        for batch in batches:
            arrow_kind = batch.schema.field(0).type
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                ids, ends = coder.encode(pc.fill_null(part.column(1), ""))
                sizes = np.diff(ends)
                ids = np.insert(ids, ends[1:], end_id)
                names, sizes = part.column(0).to_pylist(), sizes + 1
                held.append((names, ids, sizes, np.zeros(len(names), np.int64), sizes))
                waiting += len(ids)
                if waiting >= SEGMENT:
                    yield solve()
                    waiting = 0
        if held:
            yield solve()

    parted = rows.repartitionByRange(blocks, "doc_id").sortWithinPartitions("doc_id")
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return parted.mapInArrow(run, schema)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of every document; see ``pack``."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op10_packing": op10_packing}
ORACLE: dict[str, str] = {}
