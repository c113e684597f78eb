"""Rows rendered as lines of Markdown, or as JSON for a page.  Lines carry (document, line_no), so that order is explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown_cell, script_safe


def listed(values: Column, empty: str = "—") -> Column:
    """An array joined by commas, a dash if it is empty."""
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) == 0, empty).otherwise(F.array_join(values, ", "))


def witness_label(identifier: Column, language: Column, tradition: Column, plain: str = "lzh") -> Column:
    """``id (language, tradition)``, the language left out if it is the plain one."""
    told = F.array_compact(F.array(F.when(~language.eqNullSafe(F.lit(plain)), language), F.nullif(tradition, F.lit(""))))
    return F.concat(identifier, F.when(F.size(told) > 0, F.concat(F.lit(" ("), F.array_join(told, ", "), F.lit(")"))).otherwise(""))


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.coalesce(c.cast("string"), F.lit(""))) for c in cells]), F.lit(" |"))


def table_lines(rows: DataFrame, order: list, titles: list[str]) -> DataFrame:
    """(line_no, line) of a table: two lines of head, then the rows' ``line``."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(1, "| " + " | ".join(titles) + " |"), (2, "|" + "---|" * len(titles))], "line_no int, line string")
    return head.unionByName(rows.select((F.row_number().over(Window.orderBy(*order)) + 2).cast("int").alias("line_no"), "line"))


def report_lines(rows: DataFrame, document: str, order: list, blocks: list[Column]) -> DataFrame:
    """(document, line_no, line): for each row of a document, in order, its blocks of lines (arrays of text, nulls and null arrays left out)."""
    none = F.array().cast("array<string>")
    lines = F.array_compact(F.concat(*[F.coalesce(b, none) for b in blocks]))
    spread = rows.withColumn("item", F.row_number().over(Window.partitionBy(document).orderBy(*order))).select(document, "item", F.posexplode(lines).alias("at", "line"))
    return spread.select(document, F.row_number().over(Window.partitionBy(document).orderBy("item", "at")).alias("line_no"), "line")


def alignment_blocks(name: Column, status: Column, members: Column, variants: Column) -> list[Column]:
    """Blocks of one alignment in a case report: heading, status, a line for each (label, text) member and each variant."""
    return [
        F.array(F.concat(F.lit("## "), name), F.concat(F.lit("Status: `"), status, F.lit("`"))),
        F.transform(members, lambda m: F.concat(F.lit("- **"), m["label"], F.lit("**: "), m["text"])),
        F.transform(variants, lambda v: F.concat(F.lit("- variant "), v)),
    ]


def worksheet_blocks(name: Column, questions: list[str], reviews: Column) -> list[Column]:
    """Blocks of one alignment in a review packet: heading, a box for each question, the reviews there are or a line that says none."""
    boxes = [F.lit(f"- [ ] {q}") for q in questions]
    told = F.when(F.size(F.coalesce(reviews, F.array().cast("array<string>"))) == 0, F.array(F.lit("No reviews yet."))).otherwise(F.transform(reviews, lambda r: F.concat(F.lit("- "), r)))
    return [F.array(F.concat(F.lit("### "), name), *boxes), told]


def page_payload(alignments: DataFrame, reviews: DataFrame, key: str = "alignment_id") -> DataFrame:
    """(key, payload): each alignment's fields with its reviews in ledger order, as JSON that may stand inside a script element."""
    fields = [c for c in alignments.columns if c != key]
    attached = reviews.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "review"))), lambda r: r["review"]).alias("existing_reviews"))
    met = alignments.join(attached, key, "left").withColumn("existing_reviews", F.coalesce("existing_reviews", F.array().cast("array<string>")))
    return met.select(key, script_safe(F.to_json(F.struct(key, *fields, "existing_reviews"))).alias("payload"))
