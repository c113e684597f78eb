"""Ordered leaves to units: the paragraph machine in window form, unit records, and text blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import INK, collapse, editorial_flags, leaf_kind, leaf_marks, padded


def leaf_states(leaves: DataFrame) -> DataFrame:
    """Adds ``is_open`` (a paragraph is open before the leaf), ``unit_no`` and ``error`` to (work, ordinal, kind).

    A heading ends what is open; ``open`` starts a paragraph and ``close`` ends it with that leaf; ``both`` is a
    paragraph of one leaf; any other leaf joins an open paragraph or is a block of its own.  One pass over each work in
    order; works are the partitions.
    """
    order = Window.partitionBy("work").orderBy("ordinal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind").isin("heading", "open", "close", "both"), F.col("kind")), ignorenulls=True).over(before)
    opened = F.coalesce(last == "open", F.lit(False))
    starts = F.col("kind").isin("heading", "open", "both") | ~F.col("is_open")
    error = F.when(F.col("kind").isin("open", "both") & F.col("is_open"), "open while open").when((F.col("kind") == "heading") & F.col("is_open"), "heading while open").when((F.col("kind") == "close") & ~F.col("is_open"), "close while closed")
    stated = leaves.withColumn("is_open", opened)
    return stated.withColumn("unit_no", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("error", error)


def unterminated(leaves: DataFrame) -> DataFrame:
    """Works whose last marker opens a paragraph."""
    last = F.max_by("kind", "ordinal")
    return leaves.filter(F.col("kind").isin("heading", "open", "close", "both")).groupBy("work").agg(last.alias("last_marker")).filter("last_marker = 'open'")


def classified(leaves: DataFrame) -> DataFrame:
    """``leaves`` (work, ordinal, segment_id, text, template) with leaf_kind, kind of the machine and collapsed text; a missing template is ``{}``."""
    template = F.coalesce("template", F.lit("{}"))
    marks = leaf_marks(template)
    kind = F.when(marks["heading"], "heading").when(marks["opens"] & marks["closes"], "both").when(marks["opens"], "open").when(marks["closes"], "close").otherwise("block")
    return leaves.withColumns({"template": template, "leaf_kind": leaf_kind(F.col("segment_id"), template), "kind": kind, "text": collapse(F.col("text"))})


def unit_records(leaves: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Units of ``classified`` leaves: unit_id, type, ordinal within the type, segments, joined text, digest, editorial counts.

    A closing leaf outside a paragraph is a block, as any leaf there; one whose kind is metadata is metadata.  A unit
    without text is left out but keeps its number, unless ``keep_empty``.
    """
    stated = leaf_states(leaves)
    first = F.min_by(F.struct("kind", "is_open", "leaf_kind"), "ordinal")
    flags = editorial_flags(F.col("text"))
    member = F.struct("ordinal", "segment_id", "text", "template")
    made = stated.groupBy("work", "unit_no").agg(
        first.alias("f"), F.array_sort(F.collect_list(member)).alias("m"), F.count(F.lit(1)).alias("segment_count"),
        *[F.count_if(flags[f"has_{name}"]).alias(f"segments_with_{name}") for name in ("supplied", "gap", "unclear")],
    )
    kind = F.when(F.col("f.kind") == "heading", "heading").when(F.col("f.kind").isin("open", "both"), "paragraph").when(F.col("f.leaf_kind") == "metadata", "metadata").otherwise("block")
    text = collapse(F.array_join(F.col("m.text"), " "))
    typed = made.withColumns({"unit_type": kind, "text": text})
    typed = typed.withColumn("ordinal", F.row_number().over(Window.partitionBy("work", "unit_type").orderBy("unit_no")))
    mark = F.substring("unit_type", 1, 1)
    told = typed if keep_empty else typed.filter("text <> ''")
    return told.select(
        F.concat(F.col("work").cast("string"), F.lit("#"), mark, padded("", F.col("ordinal"))).alias("unit_id"), "work", "unit_type", "ordinal", F.col("m.segment_id").alias("segment_ids"),
        F.col("m")[0]["segment_id"].alias("start_segment_id"), F.element_at("m", -1)["segment_id"].alias("end_segment_id"), "text", F.sha2("text", 256).alias("text_sha256"),
        F.col("m.template").alias("html_templates"), "segment_count", "segments_with_supplied", "segments_with_gap", "segments_with_unclear",
    )


def unit_errors(leaves: DataFrame) -> DataFrame:
    """(work, ordinal, error): a heading or an opening leaf inside a paragraph, and works that end inside one (without ordinal)."""
    inside = leaf_states(leaves).filter("error IS NOT NULL AND error <> 'close while closed'").select("work", F.col("ordinal").cast("long").alias("ordinal"), "error")
    return inside.unionByName(unterminated(leaves).select("work", F.lit(None).cast("long").alias("ordinal"), F.lit("unterminated").alias("error")))


def text_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, text) of the lines that hold more than white space; numbers count empty lines too."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return lines.filter(F.rlike("text", F.lit(INK))).select("doc_id", (F.col("at") + 1).alias("ordinal"), "text")
