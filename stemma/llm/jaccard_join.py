"""N-gram Jaccard join with count-vector R-trees.

A document is its set of distinct five-word shingles.  Equal sets are one class, joined no further.  Classes A and B
link if 7 * |A & B| >= 3 * (|A| + |B|), that is at a Jaccard similarity of 0.75 or more.

* Routing, which only says what can meet.  In any order of shingles that all classes share, two linked classes have
  their first k common shingles among the first n - ceil(3n / 4) + k of each.  The order puts frequent shingles last (a
  bounded list, HEAVY_ENTRIES), else it is that of the hashes.  With k = 1 this is the base prefix, and a class goes to
  the bucket of each of its shingles.  With k = ceil(n / SHARED) it is a filter: the k of a linked class of m shingles
  is ceil(3n / 4 / SHARED) at least, as m is 3n / 4 at least, so a class that shares fewer shingles of that prefix
  with the prefixes of others links with nothing, and takes no further part.
* Count-vector R-tree.  A class's shingles are hashed into GROUPS groups; the counts are a point, and the overlap of two
  classes is at most the sum of the smaller counts (finer ones of as many groups as a quarter of the set, for pairs that
  GROUPS leave).  The points of a bucket are packed into an R-tree whose boxes keep
  the largest count of each group and the least set size, so the same sum bounds the overlap of any points below two
  boxes.  The tree is joined with itself from the root, each bucket (of equal buckets, one) in one task.  Pairs that the
  bound leaves are not written: the task unites their classes and writes a spanning forest.  The forests of all buckets
  give candidate clusters, which linked classes never straddle.
* Verification.  A class's set is read again and sent once, to its cluster.  A task joins the cluster's R-tree with
  itself and tests the pairs left on the sets; classes that are united already are not tested, nor are boxes whose
  points all are.  Again only a spanning forest leaves the task, so no row stands for a pair, whatever a group's size.
* Groups of more than BLOCK classes or BLOCK_BYTES (a bucket or a cluster may hold a third of all rows) are cut into
  blocks.  Each is joined with itself; then its classes meet one class each of the CENTRES largest of the group's
  components; what is then not of the group's largest component meets all blocks, block against block.  All pairs of
  different components are so compared, and a class of the largest component is sent on only once a block of the rest.

Components come from repeated least-label propagation with pointer jumping, as tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, partitions_for, table
from .shingles import mix, shingle_sets

GROUPS, LEAF, FANOUT = 64, 16, 8
#: The longer prefix has one in so many of a class's shingles more; three in four of those must be shared.
SHARED = 8
NEED = f"(3 * n + {4 * SHARED - 1}) div {4 * SHARED}"
#: The largest group that one task joins as a whole: classes, and bytes of their sets or vectors.
BLOCK, BLOCK_BYTES, CENTRES = 8192, 64 << 20, 32
#: Counts are kept in 16 bits; the bound says nothing about larger sets.
LARGEST_BOUNDED = 2_000_000
HEAVY_ENTRIES, HEAVY_LEAST = 1 << 18, 64
#: Shingles that a task holds at a time, and the count from which it reports one as possibly frequent.
FLUSH, REPORT = 4_000_000, 4
ROWS_PER_SLICE, BYTES_PER_TASK = 1_000_000, 16 << 20
#: Ids that are sent to all tasks at most; more are joined by a shuffle.
MOST_SENT = 500_000
#: A packed prefix entry: six bytes of the shingle's hash, whose last bit tells the base prefix, and the class.
ENTRY = np.dtype([("key", "u1", 6), ("sid", "<u8")])


def _set_name(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 4000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def describe(docs: DataFrame) -> DataFrame:
    """For every (doc_id, text): n, sig (128 bits of the set), sid (64 of them) and vector.  And counts of shingles that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "sig", "sid", "vector", "hash", "times"]
        held, size, seen = [], 0, set()

        def frequent() -> pa.RecordBatch:
            hashes, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= REPORT
            blank = [pa.nulls(int(keep.sum()), k) for k in (kind, pa.int64(), pa.binary(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*blank, pa.array(hashes[keep].view(np.int64)), pa.array(times[keep])], names)

        kind = pa.int64()
        for part in _parts(batches):
            kind = part.schema.field(0).type
            flat, at = shingle_sets(pc.fill_null(part.column(1), ""))
            n = np.diff(at)
            sigs = [_set_name(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            blank = [pa.nulls(len(n), pa.int64())] * 2
            vectors = [fine_counts(flat[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(sigs, pa.binary()), pa.array([_sid(x) for x in sigs], pa.int64()), pa.array(vectors, pa.binary()), *blank], names)
            for i, sig in enumerate(sigs):
                if sig not in seen:
                    seen.add(sig)
                    held.append(flat[at[i] : at[i + 1]])
                    size += int(n[i])
            if size >= FLUSH:
                yield frequent()
                held, size, seen = [], 0, set()
        if held:
            yield frequent()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, sig binary, sid long, vector binary, hash long, times long")


def count_vectors(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of its shingles each set (n of them, one after another) has in each group."""
    owner = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(owner * GROUPS + (flat % np.uint64(GROUPS)).astype(np.int64), minlength=len(n) * GROUPS)
    return counts.clip(max=65535).astype("<u2").reshape(-1, GROUPS)


def fine_counts(hashes: np.ndarray) -> np.ndarray:
    """Counts of a quarter as many groups as shingles, rounded up to a power of two, GROUPS at least; halves fold into fewer groups."""
    groups = max(GROUPS, 1 << min(16, max(0, len(hashes) // 4 - 1).bit_length()))
    return np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups).clip(max=65535).astype("<u2")


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(-1, groups).sum(axis=0, dtype=np.int64) if len(counts) > groups else counts.astype(np.int64)


def _sid(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def prefix_rows(docs: DataFrame, heavy: np.ndarray, slices: int) -> DataFrame:
    """Packed entries of all longer prefixes, by slice of the shingles; those of frequent shingles by slice of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = np.zeros(1 << 20, bool)
        table_of[(heavy >> np.uint64(44)).astype(np.int64)] = True
        held, seen, size = {False: [], True: []}, set(), 0

        def packed() -> Iterator[pa.RecordBatch]:
            for often, rows in held.items():
                if not rows:
                    continue
                pairs = np.concatenate(rows)
                to = (mix(pairs[:, 1].copy() if often else pairs[:, 0] >> np.uint64(1)) % np.uint64(slices)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                pairs, to = pairs[order], to[order]
                entries = np.empty(len(pairs), ENTRY)
                entries["key"] = np.ascontiguousarray(pairs[:, 0]).view(np.uint8).reshape(-1, 8)[:, :6]
                entries["sid"] = pairs[:, 1]
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                ends = np.append(cuts[1:], len(to))
                data = [entries[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(to[cuts].astype(np.int32)), pa.array([often] * len(data)), pa.array(data, pa.binary())], ["slice", "often", "entries"])

        for part in _parts(batches):
            flat, at = shingle_sets(pc.fill_null(part.column(1), ""))
            may = table_of[(flat >> np.uint64(44)).astype(np.int64)]
            often = np.zeros(len(flat), bool)
            often[may] = np.isin(flat[may], heavy)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                n = b - a
                if not n:
                    continue
                sid = _sid(_set_name(flat[a:b]))
                if sid in seen:
                    continue
                seen.add(sid)
                base = n - (3 * n + 3) // 4 + 1
                longer = base - 1 + -(-n // SHARED)
                order = np.argsort(often[a:b], kind="stable")[:longer]
                rows = np.empty((len(order), 2), np.uint64)
                rows[:, 0] = flat[a:b][order] & np.uint64(0xFFFFFFFFFFFE) | (np.arange(len(order)) < base).astype(np.uint64)
                rows[:, 1] = np.int64(sid).view(np.uint64)
                rare = int((~often[a:b][order]).sum())
                for what, some in ((False, rows[:rare]), (True, rows[rare:])):
                    if len(some):
                        held[what].append(some)
                size += len(rows)
            if size * 4 >= FLUSH:
                yield from packed()
                held, seen, size = {False: [], True: []}, set(), 0
        yield from packed()

    return docs.mapInArrow(run, "slice int, often boolean, entries binary")


def buckets(packed: DataFrame, slices: int) -> DataFrame:
    """(hash, sid, base) of all entries whose shingle two classes or more have in their longer prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            for often, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held[often].append(np.frombuffer(data, ENTRY))
        for often, rows in held.items():
            if not rows:
                continue
            entries = np.concatenate(rows)
            rows.clear()
            key = np.zeros((len(entries), 8), np.uint8)
            key[:, :6] = entries["key"]
            pairs = np.stack([key.view(np.uint64).ravel(), entries["sid"]], axis=1)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0] >> np.uint64(1)))]
            hashes, sids = pairs[:, 0] >> np.uint64(1), pairs[:, 1]
            fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (sids[1:] != sids[:-1])])
            base = np.logical_or.reduceat((pairs[:, 0] & np.uint64(1)).astype(bool), np.flatnonzero(fresh))
            hashes, sids = hashes[fresh], sids[fresh]
            start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            size = np.diff(np.append(start, len(hashes)))
            keep = (np.repeat(size, size) >= 2) | often
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(sids[keep].view(np.int64)), pa.array(base[keep])], ["hash", "sid", "base"])

    return packed.repartition(slices, "slice").mapInArrow(run, "hash long, sid long, base boolean")


class CountTree:
    """An R-tree over count vectors, packed bottom-up from points in the order of label, set size and fullest group."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray, labels: np.ndarray | None = None):
        labels = np.arange(len(sizes)) if labels is None else labels
        self.order = np.lexsort((points.argmax(axis=1), sizes, labels))
        low, label = sizes[self.order].astype(np.int64), labels[self.order]
        box = points[self.order].astype(np.int32)
        self.levels, width = [(low, low, box, label, label, None)], LEAF
        while len(low) > 1:
            cuts = np.arange(0, len(low), width)
            low, most, box = np.minimum.reduceat(low, cuts), np.maximum.reduceat(self.levels[-1][1], cuts), np.maximum.reduceat(box, cuts, axis=0)
            self.levels.append((low, most, box, np.minimum.reduceat(self.levels[-1][3], cuts), np.maximum.reduceat(self.levels[-1][4], cuts), width))
            width = FANOUT

    def self_join(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of points of different labels whose bound allows a link."""
        return self.join(self)

    def join(self, to: CountTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for a point of this tree and one of the other."""
        yield from self._descend(to, len(self.levels) - 1, len(to.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))

    def _bounded(self, to: CountTree, i: int, j: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of boxes ``a`` of level i and ``b`` of the other tree's level j may hold a link."""
        low, most, box, first, last, _ = self.levels[i]
        low2, most2, box2, first2, last2, _ = to.levels[j]
        one = (first[a] == last[a]) & (first2[b] == last2[b]) & (first[a] == first2[b])
        keep = (4 * most[a] >= 3 * low2[b]) & (4 * most2[b] >= 3 * low[a]) & ~one
        a, b, at = a[keep], b[keep], np.flatnonzero(keep)
        fits = [_allowed(np.minimum(box[x], box2[y]).sum(axis=1), low[x], low2[y]) for x, y in zip(np.array_split(a, len(a) // 20_000 + 1), np.array_split(b, len(b) // 20_000 + 1), strict=True)]
        return at[np.concatenate(fits)]

    def _descend(self, to: CountTree, i: int, j: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keep = self._bounded(to, i, j, a, b)
        a, b = a[keep], b[keep]
        if not len(a):
            return
        if i == j == 0:
            yield self.order[a], to.order[b]
            return
        wide, width = self.levels[i][5] or 1, to.levels[j][5] or 1
        below, beneath = len(self.levels[max(0, i - 1)][0]), len(to.levels[max(0, j - 1)][0])
        step = max(1, 400_000 // (wide * width))
        across, down = np.meshgrid(np.arange(wide), np.arange(width), indexing="ij")
        for at in range(0, len(a), step):
            left = (a[at : at + step, None] * wide + across.ravel()).ravel()
            right = (b[at : at + step, None] * width + down.ravel()).ravel()
            ok = (left < below) & (right < beneath)
            if self is to:
                ok &= (left < right) if i == 1 else (left <= right)
            yield from self._descend(to, max(0, i - 1), max(0, j - 1), left[ok], right[ok])


def _allowed(overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles, at least, may link with that overlap at most."""
    return (7 * overlap >= 3 * (n + m)) | (np.minimum(n, m) > LARGEST_BOUNDED)


class Group:
    """Classes that one task joins: their sizes and points, their sets if they are to be verified, and their labels."""

    def __init__(self, node: np.ndarray, n: np.ndarray, data: list[bytes], exact: bool, label: np.ndarray | None = None):
        self.node, self.n = node, n
        if exact:
            flat = np.frombuffer(b"".join(data), np.uint64)
            self.points = count_vectors(flat, n)
            self.at = np.concatenate([[0], np.cumsum(n)])
            # shingles as small numbers, so that a set is a row of marks
            names, self.flat = np.unique(flat, return_inverse=True)
            self.mark = np.zeros(len(names), bool)
        else:
            self.fine, self.flat = [np.frombuffer(x, "<u2") for x in data], None
            self.points = np.array([folded(x, GROUPS) for x in self.fine])
        # labels are positions; classes that came united have one already
        self.label = np.arange(len(node)) if label is None else np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]

    def unite(self, x: np.ndarray, y: np.ndarray) -> None:
        """The labels after joining all the pairs."""
        while True:
            lx, ly = self.label[x], self.label[y]
            apart = lx != ly
            if not apart.any():
                return
            x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
            above = np.arange(len(self.node))
            np.minimum.at(above, np.maximum(lx, ly), np.minimum(lx, ly))
            while (above[above] != above).any():
                above = above[above]
            self.label = above[self.label]

    def test(self, x: np.ndarray, y: np.ndarray) -> None:
        """Unites those of the pairs that link; without sets, all."""
        if not len(x):
            return
        if self.flat is None:
            plain = np.array([min(len(self.fine[i]), len(self.fine[j])) == GROUPS for i, j in zip(x.tolist(), y.tolist(), strict=True)])
            self.unite(x[plain], y[plain])
            for i, j in zip(x[~plain].tolist(), y[~plain].tolist(), strict=True):  # GROUPS tell little about large sets
                if self.label[i] != self.label[j]:
                    groups = min(len(self.fine[i]), len(self.fine[j]))
                    overlap = np.minimum(folded(self.fine[i], groups), folded(self.fine[j], groups)).sum()
                    if _allowed(overlap, self.n[i], self.n[j]):
                        self.unite(np.array([i]), np.array([j]))
            return
        # the class with more partners is marked, and meets them all at once
        often = np.bincount(np.concatenate([x, y]), minlength=len(self.node))
        x, y = np.where(often[x] >= often[y], x, y), np.where(often[x] >= often[y], y, x)
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        cuts = np.flatnonzero(np.diff(x, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True):
            one, rest = int(x[a]), y[a:b]
            rest = rest[self.label[rest] != self.label[one]]
            for first in range(0, len(rest), 4096):
                some = rest[first : first + 4096]
                own = self.flat[self.at[one] : self.at[one + 1]]
                self.mark[own] = True
                met = np.concatenate([self.flat[self.at[i] : self.at[i + 1]] for i in some.tolist()])
                overlap = np.add.reduceat(self.mark[met].astype(np.int64), np.concatenate([[0], np.cumsum(self.n[some])[:-1]]))
                self.mark[own] = False
                linked = some[7 * overlap >= 3 * (self.n[one] + self.n[some])]
                self.unite(np.full(len(linked), one), linked)

    def star(self, centres: np.ndarray) -> None:
        """Each class with each of some, where the bound allows a link."""
        for c in centres.tolist():
            rest = np.flatnonzero(self.label != self.label[c])
            rest = rest[(4 * self.n[rest] >= 3 * self.n[c]) & (4 * self.n[c] >= 3 * self.n[rest])]
            rest = rest[_allowed(np.minimum(self.points[rest], self.points[c]).sum(axis=1, dtype=np.int64), self.n[rest], self.n[c])]
            self.test(np.full(len(rest), c), rest)

    def join(self) -> None:
        """All pairs of different labels whose bound allows a link; first those with some of the group, which unites most of a group of copies."""
        if len(self.node) > LEAF:
            self.star(np.linspace(0, len(self.node) - 1, 4).astype(int))
        for x, y in CountTree(self.n, self.points, self.label).self_join():
            apart = self.label[x] != self.label[y]
            self.test(x[apart], y[apart])

    def join_sides(self, side: np.ndarray) -> None:
        """The same for pairs of one class with ``side`` and one without."""
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        if len(a) and len(b):
            for x, y in CountTree(self.n[a], self.points[a], self.label[a]).join(CountTree(self.n[b], self.points[b], self.label[b])):
                x, y = a[x], b[y]
                apart = self.label[x] != self.label[y]
                self.test(x[apart], y[apart])


def _grouped(rows: DataFrame, key: list[str], join, exact: bool, tasks: int) -> DataFrame:
    """Edges (a, b) by which ``join`` of a Group and its sides unites the rows (node, n, data, label, side) of equal ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def joined(group: pa.Table) -> None:
            node, label = group["node"].to_numpy(), group["label"].to_numpy()
            of = Group(node, group["n"].to_numpy(), group["data"].to_pylist(), exact, label)
            before = of.label.copy()
            join(of, group["side"].to_numpy())
            new = np.flatnonzero((of.label != before) & (before == np.arange(len(node))))
            found.append((label[of.label[new]], label[new]))

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found, (np.zeros(0, np.int64),) * 2, strict=True))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            some = pa.Table.from_batches([batch])
            some = pa.concat_tables([rest, some]) if rest is not None else some
            change = np.zeros(len(some), bool)
            for k in key:
                values = some[k].to_numpy()
                change[1:] |= values[1:] != values[:-1]
            cuts = [0, *np.flatnonzero(change).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    joined(some.slice(a, b - a))
            rest = some.slice(cuts[-1])
            if sum(len(a) for a, _ in found) > 100_000:
                yield out()
        if rest is not None and len(rest) > 1:
            joined(rest)
        yield out()

    dealt = rows.select(*key, "node", "n", "data", "label", "side").repartition(tasks, *key).sortWithinPartitions(*key, "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _inside(group: Group, side: np.ndarray) -> None:
    group.join()


def _with_centres(group: Group, side: np.ndarray) -> None:
    group.star(np.flatnonzero(side == 1))


def _across(group: Group, side: np.ndarray) -> None:
    group.join_sides(side == 1)


def joined_groups(rows: DataFrame, exact: bool, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within a group that the bound leaves and, if ``exact``, that link.

    ``rows`` is a written table of (group, node, n, data): data are the set's hashes if ``exact``, else its vector.
    """
    size = F.octet_length("data").cast("long")
    tasks = partitions_for(rows.sparkSession, rows.agg(F.sum(size)).first()[0] or 0, BYTES_PER_TASK)
    pieces = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(size) / block_bytes)).cast("int")
    large = materialise(rows.groupBy("group").agg(pieces.alias("k")).filter("k > 1"), "large")
    several = large.count()
    plain = {"label": F.col("node"), "side": F.lit(0)}
    if not several:
        return materialise(_grouped(rows.withColumns(plain), ["group"], _inside, exact, tasks), "joined")
    large = F.broadcast(large) if several <= MOST_SENT else large
    small = rows.join(large, "group", "left_anti").withColumns(plain | {"block": F.lit(0)})
    cut = rows.join(large, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumns(plain)
    parts = [materialise(_grouped(small.unionByName(cut.drop("k")), ["group", "block"], _inside, exact, tasks), "joined")]

    def labelled() -> DataFrame:
        label = components(_union(parts)).withColumnRenamed("component", "to")
        return cut.drop("label").join(label, "node", "left").withColumn("label", F.coalesce("to", "node")).drop("to")

    # a class of each of the largest components meets every block
    now = materialise(labelled(), "labelled")
    most = now.groupBy("group", "label").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("node"))
    chosen = most.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("m"), "label"))).filter(F.col("rank") <= CENTRES)
    centres = now.join(chosen.select("group", "node"), ["group", "node"], "left_semi").withColumns({"side": F.lit(1), "block": F.explode(F.sequence(F.lit(0), F.col("k") - 1))})
    parts.append(materialise(_grouped(now.unionByName(centres), ["group", "block"], _with_centres, exact, tasks), "joined"))
    discard(now)
    # what is not of the largest component meets every block, in blocks too
    now = materialise(labelled(), "labelled")
    most = now.groupBy("group", "label").agg(F.count(F.lit(1)).alias("m"), F.sum(size).alias("w"))
    shares = most.groupBy("group").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("main"), (F.sum("m") - F.max("m")).alias("rest"), (F.sum("w") - F.max_by("w", F.struct("m", -F.col("label")))).alias("bytes"))
    shares = materialise(shares.filter("rest > 0").select("group", "main", F.greatest(F.ceil(F.col("rest") / block), F.ceil(F.col("bytes") / block_bytes), F.lit(1)).cast("int").alias("q")), "mixed")
    mixed = now.join(F.broadcast(shares) if several <= MOST_SENT else shares, "group")
    own = mixed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    rest = mixed.filter("label <> main").withColumns({"side": F.lit(1), "part": F.pmod(F.xxhash64("node"), F.col("q")).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.col("k") - 1))})
    parts.append(materialise(_grouped(own.unionByName(rest), ["group", "block", "part"], _across, exact, tasks), "joined"))
    discard(now)
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def set_table(docs: DataFrame, cluster: DataFrame) -> DataFrame:
    """(group, node, n, data) of the documents that ``cluster`` (node, group) names: the hashes of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 500):
            flat, at = shingle_sets(pc.fill_null(part.column(1), ""))
            data = [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), pa.array(np.diff(at)), pa.array(data, pa.binary())], ["group", "node", "n", "data"])

    cluster = cluster.select(F.col("node").alias("doc_id"), "group")
    few = cluster.limit(MOST_SENT + 1).count() <= MOST_SENT
    wanted = docs.join(F.broadcast(cluster) if few else cluster, "doc_id").select("doc_id", "text", "group")
    return wanted.mapInArrow(run, "group long, node long, n long, data binary").filter("n > 0")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge (a, b)."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        better = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "m").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("component").alias("above"))
        new = materialise(better.join(up, "next", "left").select("node", "old", F.least("next", "above").alias("component")), "labels")
        discard(labels)
        if not new.filter("component != old").limit(1).count():
            discard(both)
            return new.select("node", "component")
        labels = new


def candidates(rows: DataFrame, classes: DataFrame, told: DataFrame) -> DataFrame:
    """A written table of (group, node): classes by base prefix shingle, of shingles with equal classes one."""
    spark = rows.sparkSession
    total, prefix = classes.agg(F.sum("n"), F.sum(F.expr(f"n - (3 * n + 3) div 4 + (n + {SHARED - 1}) div {SHARED}"))).first()
    least = max(HEAVY_LEAST, -(-(total or 0) // HEAVY_ENTRIES))
    often = told.filter(F.col("hash").isNotNull()).groupBy("hash").agg(F.sum("times").alias("times")).filter(F.col("times") >= least).select("hash")
    heavy = np.sort(np.array([r.hash for r in often.collect()], np.int64).view(np.uint64))  # HEAVY_ENTRIES at most
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(prefix or 0) // ROWS_PER_SLICE))
    bucket = materialise(buckets(prefix_rows(rows, heavy, slices), slices), "buckets")
    shared = bucket.groupBy("sid").agg(F.count(F.lit(1)).alias("m")).join(classes.select("sid", "node", "n"), "sid")
    taking_part = shared.filter(f"m >= {NEED}").select("sid", "node")
    base = materialise(bucket.filter("base").select("hash", "sid").join(taking_part, "sid").select("hash", "node"), "base")
    discard(bucket)
    # buckets are named by their number of classes and two sums of hashes, so that no bucket is ever collected
    sums = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    named = base.groupBy("hash").agg(F.count(F.lit(1)).alias("m"), *sums).filter("m > 1")
    kept = materialise(named.groupBy("m", "x", "y").agg(F.min("hash").alias("hash")).select("hash"), "kept")
    few = kept.count() <= MOST_SENT
    out = materialise(base.join(F.broadcast(kept) if few else kept, "hash", "left_semi").select(F.col("hash").alias("group"), "node"), "candidates")
    discard(base)
    return out


def link(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ids are whole numbers.

    Texts without words, and null texts, have no shingles and are linked with nothing; a text of one to four words is
    one shingle.  Equal texts are linked.  Rows without an id are not linked and have no component; rows that share an
    id are judged each by its own text, and stand for one document.  An empty table gives no rows; other columns are
    not read.

    Components only: neither the links of a document nor their number, as pairs inside a component that is already
    joined are not looked for.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    told = materialise(describe(rows), "shingles")
    sets = told.filter(F.col("sig").isNotNull())
    real = sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    same = [F.first(c).alias(c) for c in ("sid", "n", "vector")]
    classes = materialise(real.groupBy("sig").agg(F.min("doc_id").alias("node"), *same), "classes")
    known = rows.filter(F.col("doc_id").isNotNull())
    placed = candidates(known, classes, told)
    pointed = materialise(placed.join(classes.select("node", "n", F.col("vector").alias("data")), "node").select("group", "node", "n", "data"), "points")
    discard(placed)
    cluster = components(joined_groups(pointed, exact=False)).withColumnRenamed("component", "group")
    discard(pointed)
    clustered = materialise(set_table(known, cluster), "sets")
    label = components(joined_groups(clustered, exact=True))
    discard(clustered)
    of = classes.join(label, "node", "left").select("sig", F.coalesce("component", "node").alias("component"))
    joined = sets.join(of, "sig", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component; rows without an id stay."""
    first = link(docs, id_column, text_column).filter(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias(id_column)).distinct()
    return docs.join(first, id_column, "left_semi").unionByName(docs.filter(F.col(id_column).isNull()))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Component of every document; see ``link``."""
    return link(table(spark, sf_dir, "documents"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
#: All pairs that share a shingle; for small tables only.
ORACLE = {
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(shingle) AS shingle FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e UNION SELECT doc_id, doc_id FROM documents),
r AS (SELECT x AS doc_id, y FROM b UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.y = b.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(y) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)"""
}
