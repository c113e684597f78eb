"""Proportional stratified interleaving.

Every row gets a seeded random key; its rank r among the n rows of its source gives the fraction (2r - 1) / 2n; the
rows in order of their fractions are cut into shards of equal counts.  A source's rows are spread evenly over that
order, so every run of it, and so every shard, has the mixture of the whole.

No rank is computed over a whole source or table.  Both orders are first cut into buckets of about ``ROWS_PER_BUCKET``
rows (the random key's leading digits; the fraction's integer part after scaling), a window ranks each bucket by
itself, and bucket sizes, summed up, give the ranks before it.  A source that holds most rows has many buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, table

SHARDS, SEED, ROWS_PER_BUCKET = 40, "stemma-shards-1", 4000
#: Leading hexadecimal digits of the random key that a bucket is made from.
KEY_DIGITS = 12
#: Sources whose counts are sent to all tasks at most; more are joined by a shuffle.
MOST_SENT = 100_000


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot): sizes are UTF-8 bytes of the text plus 16.

    Counts of the shards are at most one apart, and a slot is a row's place in its shard.  A null text counts as
    empty; rows without a source are a source of their own; rows without an id, or with the same id, have the same
    random key and are told apart by text, and rows alike in both are interchangeable.  An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumns(
        {"stratum": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), "key": F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))}
    )
    counts = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // ROWS_PER_BUCKET))
    # rank within the source: buckets of the random key
    place = F.conv(F.substring("key", 1, KEY_DIGITS), 16, 10).cast("double") / float(16**KEY_DIGITS)
    # sources are few (their number is checked), so that rows are dealt by (stratum, part) only, never by a source alone
    few = counts.limit(MOST_SENT + 1).count() <= MOST_SENT
    rows = rows.join(F.broadcast(counts) if few else counts, "stratum").withColumn("part", F.floor(place * F.greatest(F.lit(1), F.ceil(F.col("n") / ROWS_PER_BUCKET))))
    earlier = Window.partitionBy("stratum").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("stratum", "part").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    order = ["key", "doc_id", "text_crc32", "size"]
    rows = rows.repartition(partitions_for(docs.sparkSession, total, ROWS_PER_BUCKET * 25), "stratum", "part")
    within = Window.partitionBy("stratum", "part").orderBy(*order)
    ranked = rows.withColumn("r", F.row_number().over(within)).join(sizes, ["stratum", "part"])
    fraction = (2 * (F.col("r") + F.col("before")) - 1) / (2 * F.col("n"))
    # rank in the whole: buckets of the fraction
    ranked = ranked.withColumn("fraction", fraction).withColumn("slice", F.floor(F.col("fraction") * buckets)).drop("part", "before", "r", "n")
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    within = Window.partitionBy("slice").orderBy("fraction", "stratum", *order)
    at = F.row_number().over(within) + F.col("before") - 1
    placed = ranked.join(sizes, "slice").withColumn("at", at)
    exact = F.expr(f"(at * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", exact).withColumn("slot", (F.col("at") - first).cast("long")).select(
        "doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot"
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of counts at most one apart, each of the mixture of all; see ``shard``."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


QUERIES = {"op3_sharding": op3_sharding}
#: DuckDB has no CRC-32; the tests hold the result against plain Python.
ORACLE: dict[str, str] = {}
