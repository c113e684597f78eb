"""Rendering queries: tables, reports, packets and page payloads as lines or JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import render
from ..sources import table
from .base import query

_LABEL = "s_name || CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN '' WHEN s_suppkey % 3 = 0 THEN ' (t)' WHEN s_suppkey % 2 = 0 THEN ' (san)' ELSE ' (san, t)' END"


def _label():
    k = F.col("s_suppkey")
    return render.witness_label(F.col("s_name"), F.when(k % 3 == 0, "lzh").otherwise("san"), F.when(k % 2 == 1, "t"))


@query(f"""SELECT 1::INTEGER AS line_no, '| Work | Witnesses | Other |' AS line UNION ALL SELECT 2, '|---|---|---|'
UNION ALL SELECT (row_number() OVER (ORDER BY n_nationkey) + 2)::INTEGER, '| ' || replace(n_name, '|', '\\|') || ' | ' || coalesce(w, '—') || ' | — |' FROM nation LEFT JOIN (SELECT s_nationkey, string_agg({_LABEL}, ', ' ORDER BY s_name) AS w FROM supplier GROUP BY ALL) ON s_nationkey = n_nationkey""")
def crosswalk_table_lines(spark, d):
    held = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_name", _label().alias("label")))), lambda x: x["label"]).alias("w"))
    rows = table(spark, d, "nation").join(held, "n_nationkey", "left")
    return render.table_lines(rows.select("n_nationkey", render.table_row(F.col("n_name"), render.listed(F.col("w")), render.listed(F.array().cast("array<string>"))).alias("line")), ["n_nationkey"], ["Work", "Witnesses", "Other"])


@query("""SELECT document, row_number() OVER (PARTITION BY document ORDER BY k, part, name) AS line_no, line FROM (
 SELECT n_regionkey AS document, n_nationkey AS k, 0 AS part, '' AS name, '## ' || n_name AS line FROM nation
 UNION ALL SELECT n_regionkey, n_nationkey, 1, '', 'Status: `' || CASE WHEN n_nationkey % 2 = 0 THEN 'model_reviewed' ELSE 'established' END || '`' FROM nation
 UNION ALL SELECT n_regionkey, n_nationkey, 2, s_name, '- **' || s_name || '**: ' || s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey
 UNION ALL SELECT n_regionkey, n_nationkey, 3, '', '- variant of ' || n_name FROM nation WHERE n_nationkey % 3 = 0)""")
def case_report_lines(spark, d):
    held = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("s_name").alias("label"), F.col("s_suppkey").cast("string").alias("text")))).alias("members"))
    rows = table(spark, d, "nation").join(held, "n_nationkey", "left").withColumnRenamed("n_regionkey", "document")
    k = F.col("n_nationkey")
    variants = F.when(k % 3 == 0, F.array(F.concat(F.lit("of "), "n_name")))
    return render.report_lines(rows, "document", ["n_nationkey"], render.alignment_blocks(F.col("n_name"), F.when(k % 2 == 0, "model_reviewed").otherwise("established"), F.col("members"), variants)).withColumn("line_no", F.col("line_no").cast("long"))


@query("""SELECT document, row_number() OVER (PARTITION BY document ORDER BY k, part, pos) AS line_no, line FROM (
 SELECT n_regionkey AS document, n_nationkey AS k, 0 AS part, 0 AS pos, '### ' || n_name AS line FROM nation
 UNION ALL SELECT n_regionkey, n_nationkey, 1, q.pos, '- [ ] ' || q.t FROM nation, (VALUES (1, 'source units'), (2, 'relation type')) q(pos, t)
 UNION ALL SELECT n_regionkey, n_nationkey, 2, s_suppkey, '- ' || s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey
 UNION ALL SELECT n_regionkey, n_nationkey, 2, 0, 'No reviews yet.' FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier))""")
def review_packet_lines(spark, d):
    held = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]).alias("reviews"))
    rows = table(spark, d, "nation").join(held, "n_nationkey", "left").withColumnRenamed("n_regionkey", "document")
    made = render.report_lines(rows, "document", ["n_nationkey"], render.worksheet_blocks(F.col("n_name"), ["source units", "relation type"], F.col("reviews")))
    return made.withColumn("line_no", F.col("line_no").cast("long"))


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"text":"' || n_name || '<\\/b>","existing_reviews":[' || coalesce(r, '') || ']}' AS payload FROM nation LEFT JOIN (SELECT s_nationkey, string_agg('"' || s_name || '"', ',' ORDER BY s_suppkey) AS r FROM supplier GROUP BY ALL) ON s_nationkey = n_nationkey""")
def page_payload(spark, d):
    alignments = table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("</b>")).alias("text"))
    reviews = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("review"))
    return render.page_payload(alignments, reviews, "n_nationkey")


@query("""SELECT row_number() OVER (ORDER BY doc_id) AS line, doc_id, source FROM documents WHERE doc_id % 50 = 0""")
def lookup_index(spark, d):
    from ..sources import lookup

    return lookup(table(spark, d, "documents").filter("doc_id % 50 = 0"), "doc_id", ["doc_id"], "source").withColumn("line", F.col("line").cast("long"))


@query("""SELECT count(*) AS units, count(DISTINCT lang) AS languages, (SELECT string_agg(s || ': ' || r, ';' ORDER BY s || ': ' || r) FROM (SELECT n_name AS s, 'wrong' AS r FROM nation WHERE n_nationkey % 6 = 0)) AS errors FROM documents""")
def manifest(spark, d):
    from ..sources import manifest as made

    errors = table(spark, d, "nation").filter("n_nationkey % 6 = 0").select(F.lit("wrong").alias("rule"), F.col("n_name").alias("subject"))
    counts = {"units": F.count(F.lit(1)), "languages": F.countDistinct("lang")}
    return made(table(spark, d, "documents"), errors, counts).withColumn("errors", F.array_join("errors", ";"))
