"""Unit building and mark-up queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bracketed, collapse, editorial_features, editorial_flags, html_escape, html_text, markdown_cell, offset_aware, padded, script_safe, utc_stamp, work_slug
from ..operators import constraints, units
from ..sources import paired_leaves, table
from .base import collapsed, query

# Templates by role and turn, so that every kind of leaf occurs.
_TEMPLATE = """CASE WHEN turn % 8 = 7 THEN '<h2>{}</h2>' WHEN turn % 8 = 0 THEN '<p>{}' WHEN turn % 8 = 2 AND role = 'user' THEN '{}</p>' WHEN turn % 8 = 3 THEN '<p class="x">{}</p>' WHEN turn % 8 = 5 THEN '<ul><li>{}' WHEN turn % 8 = 6 THEN '<blockquote>{}' ELSE '{}' END"""
_SEGMENT = "conv_id || CASE WHEN turn % 4 = 0 THEN ':0.' ELSE ':' END || turn"
_KIND = """CASE WHEN regexp_matches(template, '<h[1-6]\\b') THEN 'heading' WHEN regexp_matches(template, '<p(\\s|>)|</p>') THEN 'paragraph_segment' WHEN contains(segment_id, ':0.') THEN 'metadata'
 WHEN contains(template, '<li') OR contains(template, '</li>') THEN 'list_segment' WHEN contains(template, '<blockquote') OR contains(template, '</blockquote>') THEN 'blockquote_segment' ELSE 'continuation_or_other' END"""
_LEAVES = f"(SELECT *, {_KIND} AS leaf_kind, CASE WHEN contains(template, '<h2') THEN 'heading' WHEN contains(template, '<p') AND contains(template, '</p>') THEN 'both' WHEN contains(template, '<p') THEN 'open' WHEN contains(template, '</p>') THEN 'close' ELSE 'block' END AS kind FROM (SELECT conv_id AS work, turn AS ordinal, {_SEGMENT} AS segment_id, CASE WHEN turn = 4 THEN ' ' ELSE {collapsed('text')} END AS text, {_TEMPLATE} AS template FROM conversations))"
_OPEN = f"(SELECT *, coalesce(last_value(CASE WHEN kind <> 'block' THEN kind END IGNORE NULLS) OVER (PARTITION BY work ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'open', false) AS is_open FROM {_LEAVES})"
_NUMBERED = f"(SELECT *, sum(CASE WHEN kind IN ('heading', 'open', 'both') OR NOT is_open THEN 1 ELSE 0 END) OVER (PARTITION BY work ORDER BY ordinal) AS unit_no FROM {_OPEN})"


def _leaves(spark, d):
    turn = F.col("turn")
    template = (
        F.when(turn % 8 == 7, "<h2>{}</h2>").when(turn % 8 == 0, "<p>{}").when((turn % 8 == 2) & (F.col("role") == "user"), "{}</p>").when(turn % 8 == 3, '<p class="x">{}</p>')
        .when(turn % 8 == 5, "<ul><li>{}").when(turn % 8 == 6, "<blockquote>{}")
    )
    segment = F.concat(F.col("conv_id").cast("string"), F.when(turn % 4 == 0, ":0.").otherwise(":"), turn.cast("string"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("work"), turn.alias("ordinal"), segment.alias("segment_id"), F.when(turn == 4, " ").otherwise(F.col("text")).alias("text"), template.alias("template"))
    pairs = paired_leaves(rows.drop("template"), rows.filter("template IS NOT NULL").select("work", "segment_id", F.col("template").alias("text")))
    return units.classified(pairs)


@query(f"SELECT work, ordinal, segment_id, leaf_kind, kind FROM {_LEAVES}", name="leaf_kind")
def leaf_kinds(spark, d):
    return _leaves(spark, d).select("work", "ordinal", "segment_id", "leaf_kind", "kind")


@query("SELECT conv_id AS work, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations")
def leaf_ordinals(spark, d):
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("work"), "turn", number.cast("long").alias("ordinal"))


_UNITS = f"""(SELECT work || '#' || left(unit_type, 1) || printf('%04d', number) AS unit_id, work, unit_type, number AS ordinal, start_segment_id, end_segment_id, segment_count, text FROM (
 SELECT *, row_number() OVER (PARTITION BY work, unit_type ORDER BY unit_no) AS number FROM (
 SELECT work, unit_no, CASE WHEN min_by(kind, ordinal) = 'heading' THEN 'heading' WHEN min_by(kind, ordinal) IN ('open', 'both') THEN 'paragraph' WHEN min_by(leaf_kind, ordinal) = 'metadata' THEN 'metadata' ELSE 'block' END AS unit_type,
 min_by(segment_id, ordinal) AS start_segment_id, max_by(segment_id, ordinal) AS end_segment_id, count(*) AS segment_count, trim({collapsed("string_agg(text, ' ' ORDER BY ordinal)")}) AS text FROM {_NUMBERED} GROUP BY work, unit_no)) WHERE text <> '')"""


@query(f"SELECT unit_id, work, unit_type, ordinal, start_segment_id, end_segment_id, segment_count, sha256(text) AS text_sha256 FROM {_UNITS}")
def unit_records(spark, d):
    made = units.unit_records(_leaves(spark, d))
    return made.select("unit_id", "work", "unit_type", F.col("ordinal").cast("long").alias("ordinal"), "start_segment_id", "end_segment_id", "segment_count", "text_sha256")


@query(f"SELECT work, count(*) FILTER (WHERE unit_type = 'paragraph') AS paragraphs, count(*) FILTER (WHERE unit_type = 'heading') AS headings, count(*) FILTER (WHERE unit_type = 'metadata') AS metadata, count(*) FILTER (WHERE unit_type = 'block') AS blocks FROM {_UNITS} GROUP BY work")
def unit_counts_by_work(spark, d):
    kinds = {"paragraphs": "paragraph", "headings": "heading", "metadata": "metadata", "blocks": "block"}
    return units.unit_records(_leaves(spark, d)).groupBy("work").agg(*[F.count_if(F.col("unit_type") == k).alias(name) for name, k in kinds.items()])


@query(f"""SELECT work, ordinal, CASE WHEN kind = 'heading' THEN 'heading while open' ELSE 'open while open' END AS error FROM {_OPEN} WHERE is_open AND kind IN ('heading', 'open', 'both')
UNION ALL SELECT work, NULL, 'unterminated' FROM {_LEAVES} WHERE kind <> 'block' GROUP BY work HAVING max_by(kind, ordinal) = 'open'""")
def unit_errors(spark, d):
    return units.unit_errors(_leaves(spark, d))


_RIGHT = "(SELECT conv_id AS work, CASE WHEN conv_id % 5 = 0 THEN -turn ELSE turn END AS ordinal, turn AS key FROM conversations WHERE (conv_id + turn) % 7 <> 0 UNION ALL SELECT conv_id, 99, 99 FROM conversations WHERE turn = 0 AND conv_id % 6 = 0)"


@query(f"""WITH l AS (SELECT conv_id AS work, turn AS ordinal, turn AS key FROM conversations), r AS {_RIGHT},
f AS (SELECT coalesce(l.work, r.work) AS work, coalesce(l.key, r.key) AS key, l.ordinal AS a, r.ordinal AS b FROM l FULL JOIN r ON l.work = r.work AND l.key = r.key),
g AS (SELECT work, count(*) FILTER (WHERE b IS NULL) AS only_left, count(*) FILTER (WHERE a IS NULL) AS only_right,
 coalesce(array_to_string(list_slice(list(key ORDER BY a) FILTER (WHERE b IS NULL), 1, 5), ','), '') AS missing_right, coalesce(array_to_string(list_slice(list(key ORDER BY b) FILTER (WHERE a IS NULL), 1, 5), ','), '') AS missing_left,
 list(key ORDER BY a) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) IS DISTINCT FROM list(key ORDER BY b) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS moved FROM f GROUP BY work)
SELECT work, only_left, only_right, missing_right, missing_left FROM g WHERE only_left > 0 OR only_right > 0 OR moved""")
def pair_mismatch(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("ordinal"), F.col("turn").alias("key"))
    right = turns.filter("(work + key) % 7 <> 0").withColumn("ordinal", F.when(F.col("work") % 5 == 0, -F.col("ordinal")).otherwise(F.col("ordinal")))
    right = right.unionByName(turns.filter("key = 0 AND work % 6 = 0").select("work", F.lit(99).cast("long").alias("ordinal"), F.lit(99).cast("long").alias("key")))
    found = constraints.key_differences(turns, right)
    told = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("work", "only_left", "only_right", told("missing_right"), told("missing_left"))


_EDITION = "replace(replace(replace(left(html, 1500), '<title>', '<supplied>'), '</title>', '</supplied>'), CASE WHEN page_id % 2 = 0 THEN '<ul>' ELSE '<nav>' END, CASE WHEN page_id % 3 = 0 THEN '<gap n=\"1\"/>' ELSE '<unclear>' END)"


def _edition(spark, d):
    text = F.replace(F.replace(F.left("html", F.lit(1500)), F.lit("<title>"), F.lit("<supplied>")), F.lit("</title>"), F.lit("</supplied>"))
    old, new = F.when(F.col("page_id") % 2 == 0, "<ul>").otherwise("<nav>"), F.when(F.col("page_id") % 3 == 0, '<gap n="1"/>').otherwise("<unclear>")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.replace(text, old, new).alias("edition"))


@query(f"SELECT page_id, contains(e, '<supplied>') AS has_supplied, contains(e, '<gap') AS has_gap, contains(e, '<unclear') AS has_unclear, concat_ws(',', CASE WHEN contains(e, '<supplied>') THEN 'supplied' END, CASE WHEN contains(e, '<gap') THEN 'gap' END, CASE WHEN contains(e, '<unclear') THEN 'unclear' END) AS features FROM (SELECT page_id, {_EDITION} AS e FROM pages)", name="editorial_flags")
def editorial_marks(spark, d):
    marked = _edition(spark, d).withColumn("f", editorial_flags(F.col("edition")))
    return marked.select("page_id", "f.*", F.array_join(editorial_features(F.col("f")), ",").alias("features"))


@query(f"SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS segment_count, count(*) FILTER (WHERE contains(e, '<supplied>')) AS segments_with_supplied, count(*) FILTER (WHERE contains(e, '<gap')) AS segments_with_gap, count(*) FILTER (WHERE contains(e, '<unclear')) AS segments_with_unclear FROM (SELECT url, {_EDITION} AS e FROM pages) GROUP BY ALL")
def editorial_summary(spark, d):
    marked = _edition(spark, d).withColumn("f", editorial_flags(F.col("edition")))
    return marked.groupBy("host").agg(F.count(F.lit(1)).alias("segment_count"), *[F.count_if(f"f.has_{x}").alias(f"segments_with_{x}") for x in ("supplied", "gap", "unclear")])


@query(f"SELECT page_id, {collapsed(f'''regexp_replace(regexp_replace({_EDITION}, '(?s)<supplied>(.*?)</supplied>', '⟦' || chr(92) || '1⟧', 'g'), '<[^>]+>', '', 'g')''')} AS display FROM pages")
def editorial_display(spark, d):
    return _edition(spark, d).select("page_id", bracketed(F.col("edition")).alias("display"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(left(html, 300), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped, replace(left(html, 300) || '|', '|', '\\|') AS cell, replace(left(html, 300), '</', '<\\/') AS script FROM pages""")
def escapes(spark, d):
    head = F.left("html", F.lit(300))
    return table(spark, d, "pages").select("page_id", html_escape(head).alias("escaped"), markdown_cell(F.concat(head, F.lit("|"))).alias("cell"), script_safe(head).alias("script"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp, o_orderkey % 4 IN (0, 1) AS aware FROM orders")
def timestamp_check(spark, d):
    n, stamp = F.col("o_orderkey") % 4, utc_stamp(F.col("o_orderdate"))
    text = F.when(n == 0, stamp).when(n == 1, F.replace(stamp, F.lit("Z"), F.lit("+05:30"))).when(n == 2, F.replace(stamp, F.lit("Z"), F.lit(""))).otherwise("not a time Z")
    return table(spark, d, "orders").select("o_orderkey", stamp.alias("stamp"), offset_aware(text).alias("aware"))


@query("SELECT p_partkey, 'brand' || regexp_extract(p_brand, '(\\d+)$', 1)::BIGINT AS slug FROM part", name="work_slug")
def work_slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", work_slug(F.replace("p_brand", F.lit("#"), F.lit(" ")), "Brand").alias("slug"))


@query(f"SELECT doc_id, {collapsed("left(text, 2000)")} AS plain FROM documents", name="html_text")
def html_texts(spark, d):
    page = F.concat(F.lit('<!DOCTYPE html><div class="a > b"><p>'), html_escape(F.left("text", F.lit(2000))), F.lit("<br></div><!-- <p>not read</p> -->"))
    return table(spark, d, "documents").select("doc_id", html_text(page).alias("plain"))


@query(f"SELECT doc_id, {collapsed("text")} AS normal FROM documents")
def normalize_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", collapse(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, left({collapsed("text")}, 160) AS title FROM documents")
def title_prefix_160(spark, d):
    return table(spark, d, "documents").select("doc_id", F.left(collapse(F.col("text")), F.lit(160)).alias("title"))


@query("SELECT doc_id, length(text || '𠀀') AS code_points FROM documents")
def code_point_length(spark, d):
    return table(spark, d, "documents").select("doc_id", F.char_length(F.concat("text", F.lit("𠀀"))).cast("long").alias("code_points"))


@query("SELECT doc_id, sha256(text) AS digest, left(sha256(text), 12) AS short FROM documents")
def sha256_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.left(F.sha2("text", 256), F.lit(12)).alias("short"))


@query("SELECT o_orderkey, 'p' || printf('%04d', o_orderkey) AS unit_id, 'b' || printf('%04d', o_orderkey * 100) AS block_id FROM orders")
def padded_ids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", padded("p", F.col("o_orderkey")).alias("unit_id"), padded("b", F.col("o_orderkey") * 100).alias("block_id"))
