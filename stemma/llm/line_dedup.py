"""Line dedup with levelled sorted runs.

A run is a table of (line hash, id of the first document that holds the line), sorted by hash.  Documents come in
batches of ascending ids.  A batch's distinct line hashes are merge-anti-joined with all runs, and what is new is
written as a run of level 0; whenever a level has ``fanout`` runs they are merged into one of the next level.  So a
hash stands in one run only, with the smallest id, and a line is dropped where its document is not that one.

Line hashes are 128 bits.  A frequent line is one row of a run, met map-side before any shuffle; where its occurrences
join the runs, the join is a plain sort-merge join whose hot partitions Spark splits.  Runs live in the shared
checkpoint folder, so neither they nor a finished batch are lost with an executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

MIN_CODE_POINTS, BATCHES, FANOUT = 10, 4, 4
_SPACE = b" \t\n\x0b\x0c\r"


def _text_hash(text: str | None) -> bytes:
    return blake2b((text or "").encode(), digest_size=8).digest()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key.decode()) >= least


def line_rows(docs: DataFrame, least: int = MIN_CODE_POINTS) -> DataFrame:
    """(doc_id, text_hash, position, hash) of every line of (doc_id, text) whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                rows, texts, places, hashes = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    name = _text_hash(text)
                    for at, line in enumerate((text or "").encode().split(b"\n")):
                        key = line.strip(_SPACE).lower()
                        if _long_enough(key, least):
                            rows.append(i)
                            texts.append(name)
                            places.append(at)
                            hashes.append(blake2b(key, digest_size=16).digest())
                ids = part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.binary()), pa.array(places, pa.int32()), pa.array(hashes, pa.binary())], ["doc_id", "text_hash", "position", "hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash binary, position int, hash binary")


class LineRuns:
    """The runs of all batches so far."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        out = runs[0] if runs else None
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def _write(self, run: DataFrame, level: int) -> DataFrame:
        return materialise(run.sortWithinPartitions("hash"), f"line-run-{level}")

    def add(self, lines: DataFrame) -> None:
        """A batch whose ids are all larger than those of earlier batches (missing ids: last of all)."""
        firsts = lines.groupBy("hash").agg(F.min("doc_id").alias("owner"))
        runs = self.all()
        if runs is not None:
            firsts = firsts.join(runs.hint("merge"), "hash", "left_anti")
        self.levels[0].append(self._write(firsts, 0))
        for level, runs in enumerate(self.levels):
            if len(runs) < self.fanout:
                break
            merged = runs[0]
            for run in runs[1:]:
                merged = merged.unionByName(run)
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged.repartition("hash"), level + 1))
            runs.clear()


def dedup_lines(docs: DataFrame, least: int = MIN_CODE_POINTS, batches: int = BATCHES, fanout: int = FANOUT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, rest): lines found in several documents stay in that of the smallest id only.

    ``rest`` is a struct of the other columns, so their names clash with nothing.  A null or empty text is one empty
    line, and a null text comes back as the empty text.  Rows with the same id are one document and keep each other's
    lines; rows without an id are one document after all others.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in (id_column, text_column)]
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("rest"))
    narrow = rows.select("doc_id", "text")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    runs = LineRuns(spark, fanout)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = narrow
        if low is not None:
            batch = batch.filter((F.col("doc_id") > low) | F.col("doc_id").isNull() if high is None else F.col("doc_id") > low)
        if high is not None:
            batch = batch.filter(F.col("doc_id") <= high)
        runs.add(line_rows(batch, least).select("hash", "doc_id"))
    lines = line_rows(narrow, least)
    later = lines.join(runs.all().hint("merge"), "hash").filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
    drops = later.groupBy("doc_id", "text_hash").agg(F.collect_list("position").alias("drop"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = pa.array([_text_hash(t) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], [*batch.schema.names, "text_hash"])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, count, lost = [], [], []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                parts = (text or "").split("\n")
                gone = set(drop or ())
                texts.append("\n".join([x for i, x in enumerate(parts) if i not in gone]) if gone else text or "")
                count.append(len(parts))
                lost.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(count, pa.int64()), pa.array(lost, pa.int64()), batch.column(2)], ["doc_id", "text", "n_lines", "n_dropped", "rest"])

    kind, of_rest = rows.schema["doc_id"].dataType.simpleString(), rows.schema["rest"].dataType.simpleString()
    named = rows.mapInArrow(name, f"doc_id {kind}, text string, rest {of_rest}, text_hash binary").alias("n")
    same = F.col("n.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("n.text_hash") == F.col("d.text_hash"))
    joined = named.join(drops.alias("d"), same, "left").select("n.doc_id", "n.text", "n.rest", "d.drop")
    return joined.mapInArrow(rebuild, f"doc_id {kind}, text string, n_lines long, n_dropped long, rest {of_rest}")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines kept and dropped of every document; see ``dedup_lines``."""
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE = {
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (o.owner IS NOT NULL AND o.owner <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN owners o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
}
