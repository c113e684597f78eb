"""The witness catalog: titles, languages, overrides, nested and flat forms, checks of pinned sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean_markup

#: Keys of leaves that hold a work's title.
TITLE_KEY = r":0(?:\.0|\.1)?$"


def titles(leaves: DataFrame, fallback: DataFrame) -> DataFrame:
    """(work, title): of (work, ordinal, key, text) the first cleaned text with a title's key; else the first text, cut to 160; else (work, fallback)."""
    cleaned = leaves.withColumn("clean", clean_markup(F.col("text"))).filter("clean <> ''")
    told = F.col("key").rlike(TITLE_KEY)
    first = cleaned.groupBy("work").agg(F.min_by(F.when(told, F.col("clean")), F.when(told, F.col("ordinal"))).alias("preferred"), F.min_by("clean", "ordinal").alias("other"))
    return fallback.join(first, "work", "left").select("work", F.coalesce("preferred", F.left("other", F.lit(160)), "fallback").alias("title"))


def with_overrides(witnesses: DataFrame, overrides: DataFrame) -> DataFrame:
    """``witnesses`` (witness_key, work_key) with ``work_id``: the override (key, work_id) of the witness, else of the work, else the work's key.

    Overrides are a curated list; its keys are distinct, so neither join adds rows.
    """
    one = overrides.groupBy("key").agg(F.min("work_id").alias("work_id"))
    met = witnesses.join(one.select(F.col("key").alias("witness_key"), F.col("work_id").alias("of_witness")), "witness_key", "left")
    met = met.join(one.select(F.col("key").alias("work_key"), F.col("work_id").alias("of_work")), "work_key", "left")
    return met.withColumn("work_id", F.coalesce("of_witness", "of_work", "work_key")).drop("of_witness", "of_work")


def nested(witnesses: DataFrame) -> DataFrame:
    """(work_id, languages): array of (language, witnesses sorted by id) sorted by language; a work is a row."""
    each = witnesses.groupBy("work_id", "language").agg(F.array_sort(F.collect_list("witness_id")).alias("witnesses"))
    return each.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("language", "witnesses"))).alias("languages"))


def without_nulls(*columns):
    """A row as JSON; fields that are null are left out."""
    return F.to_json(F.struct(*columns))


def revision_differences(lock: DataFrame, present: DataFrame) -> DataFrame:
    """(source, rule) of locked (source, revision) that are missing from ``present`` or stand at another revision; an empty lock expects nothing."""
    met = lock.join(present.select("source", F.col("revision").alias("actual"), F.lit(True).alias("there")), "source", "left")
    expected = F.coalesce("revision", F.lit(""))
    rule = F.when(F.col("there").isNull(), "missing").when((expected != "") & ~F.col("actual").eqNullSafe(expected), "revision mismatch")
    return met.select("source", rule.alias("rule")).filter("rule IS NOT NULL")


def availability(wanted: DataFrame, config: DataFrame, segments: DataFrame, units: DataFrame, absent: str = "not_available") -> DataFrame:
    """(witness_id, work_id, status, segments, units) of (witness_id, work_id) that are wanted.

    ``config``: (witness_id, work_id, status, provider).  Available text that is configured for another work is an error
    and no row; see ``mismatched``.
    """
    count = lambda df, name: df.groupBy("witness_id").agg(F.count(F.lit(1)).alias(name))
    told = _configured(wanted, config).filter("status IS NULL OR status <> 'text_available' OR configured = work_id")
    met = told.join(count(segments, "segments"), "witness_id", "left").join(count(units, "units"), "witness_id", "left")
    there = F.col("status").eqNullSafe(F.lit("text_available"))
    number = lambda c: F.when(there, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return met.select("witness_id", "work_id", F.when(there, F.col("status")).otherwise(absent).alias("status"), number("segments").alias("segments"), number("units").alias("units"))


def mismatched(wanted: DataFrame, config: DataFrame) -> DataFrame:
    return _configured(wanted, config).filter("status = 'text_available' AND configured <> work_id").select("witness_id", "work_id", "configured")


def _configured(wanted: DataFrame, config: DataFrame) -> DataFrame:
    return wanted.join(config.select("witness_id", F.col("work_id").alias("configured"), "status"), "witness_id", "left")
