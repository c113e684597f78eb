
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import collapse, padded, slug, squeeze, stable_id, strip_tags
from ..operators import align, catalog, constraints, ledger, units
from ..sources import table
from .base import ORACLE, QUERIES, WS as _WS, collapsed, lines_of, query

__all__ = ["ORACLE", "QUERIES"]

def _witnesses(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("witness_id"), F.col("lang").alias("language"), F.col("source").alias("origin"))
    pages = table(spark, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("witness_id"), F.lit("und").alias("language"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("origin"))
    turns = table(spark, d, "conversations").select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("witness_id"), F.lit("und").alias("language"), F.lit("conversations").alias("origin")).distinct()
    return docs.unionByName(pages).unionByName(turns)


_WITNESSES = """(SELECT 'doc:' || doc_id AS witness_id, lang AS language, source AS origin FROM documents
 UNION ALL SELECT 'page:' || page_id, 'und', regexp_extract(url, '://([^/?#]*)', 1) FROM pages
 UNION ALL SELECT DISTINCT 'conv:' || conv_id, 'und', 'conversations' FROM conversations)"""


@query(f"SELECT language, count(*) AS witnesses FROM {_WITNESSES} GROUP BY language")
def catalog_counts_by_language(spark, d):
    return _witnesses(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("witnesses"))


@query(f"SELECT language, origin, count(*) AS witnesses, count(DISTINCT witness_id) AS ids FROM {_WITNESSES} GROUP BY language, origin")
def catalog_counts_by_source(spark, d):
    return _witnesses(spark, d).groupBy("language", "origin").agg(F.count(F.lit(1)).alias("witnesses"), F.countDistinct("witness_id").alias("ids"))


@query("SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS languages FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def catalog_nested_works(spark, d):
    counted = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("lang", "n")))
    return counted.groupBy("source").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["lang"], F.lit("="), x["n"].cast("string"))), ",").alias("languages"))


@query(f"SELECT * FROM {_WITNESSES}")
def catalog_flat_sorted(spark, d):
    return _witnesses(spark, d).orderBy("origin", "language", "witness_id")


@query("SELECT n_name AS missing FROM nation EXCEPT SELECT source FROM documents")
def source_union_missing(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("missing")).exceptAll(table(spark, d, "documents").select("source").distinct())


_TITLED = f"(SELECT conv_id AS work, turn AS ordinal, conv_id || ':' || (turn % 4) AS key, {collapsed("regexp_replace(text, '<[^>]+>', '', 'g')")} AS clean FROM conversations WHERE turn % 3 <> 2)"


@query(f"""SELECT c.work, coalesce(t.preferred, left(t.other, 160), 'conversation ' || c.work) AS title FROM (SELECT DISTINCT conv_id AS work FROM conversations) c LEFT JOIN (
 SELECT work, min_by(clean, ordinal) FILTER (WHERE regexp_matches(key, ':0(\\.0|\\.1)?$')) AS preferred, min_by(clean, ordinal) AS other FROM {_TITLED} WHERE clean <> '' GROUP BY work) t USING (work)""")
def title_pick(spark, d):
    turns = table(spark, d, "conversations")
    leaves = turns.filter("turn % 3 <> 2").select(F.col("conv_id").alias("work"), F.col("turn").alias("ordinal"), F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") % 4).cast("string")).alias("key"), "text")
    works = turns.select(F.col("conv_id").alias("work")).distinct()
    return catalog.titles(leaves, works.withColumn("fallback", F.concat(F.lit("conversation "), F.col("work").cast("string"))))


@query("SELECT doc_id, CASE WHEN lang = 'en' AND contains(lower(text), ' is ') THEN 'en-x' ELSE lang END AS language FROM documents")
def language_classify(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when((F.col("lang") == "en") & F.lower("text").contains(" is "), "en-x").otherwise(F.col("lang")).alias("language"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_parse(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '" + _WS + "', ' ', 'g')) AS plain FROM pages")
def strip_markup(spark, d):
    return table(spark, d, "pages").select("page_id", collapse(strip_tags(F.col("html"))).alias("plain"))


@query("SELECT doc_id, sha256(regexp_replace(text, '" + _WS + "', '', 'g')) AS digest, length(text) AS code_points FROM documents")
def normalized_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(squeeze(F.col("text")), 256).alias("digest"), F.char_length("text").cast("long").alias("code_points"))


@query("SELECT item_id, 'cand:' || left(sha256(item_id || chr(31) || text), 20) AS candidate_id, 'p' || printf('%04d', item_id) AS unit_id FROM benchmark")
def stable_candidate_id(spark, d):
    return table(spark, d, "benchmark").select("item_id", stable_id("cand", F.col("item_id").cast("string"), F.col("text")).alias("candidate_id"), padded("p", F.col("item_id")).alias("unit_id"))


@query("SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower('--' || p_name || ' ' || p_brand || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS slug, CASE WHEN p_partkey % 9 = 0 THEN 'item' END AS fallback FROM part", name="slug")
def slugs(spark, d):
    name = F.concat(F.lit("--"), "p_name", F.lit(" "), "p_brand", F.lit("!"))
    return table(spark, d, "part").select("p_partkey", slug(name).alias("slug"), F.when(F.col("p_partkey") % 9 == 0, slug(F.lit("?!"))).alias("fallback"))


def _leaves(spark, d):
    kind = F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", "open").when(F.col("role") == "assistant", "close").otherwise("block")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("ordinal"), kind.alias("kind"), "text")


_LEAVES = "(SELECT conv_id AS work, turn AS ordinal, CASE role WHEN 'system' THEN 'heading' WHEN 'user' THEN 'open' WHEN 'assistant' THEN 'close' ELSE 'block' END AS kind, text FROM conversations)"
_STATES = f"""(SELECT *, sum(CASE WHEN kind IN ('heading', 'open') OR NOT is_open THEN 1 ELSE 0 END) OVER (PARTITION BY work ORDER BY ordinal) AS unit_no FROM (
 SELECT *, coalesce(last_value(CASE WHEN kind IN ('heading', 'open', 'close') THEN kind END IGNORE NULLS) OVER (PARTITION BY work ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'open', false) AS is_open FROM {_LEAVES}))"""


@query(f"SELECT work, unit_no::BIGINT AS unit_no, count(*) AS leaves, min(ordinal) AS first_leaf, max(ordinal) AS last_leaf FROM {_STATES} GROUP BY work, unit_no")
def unit_paragraphs(spark, d):
    return units.leaf_states(_leaves(spark, d)).groupBy("work", "unit_no").agg(F.count(F.lit(1)).alias("leaves"), F.min("ordinal").alias("first_leaf"), F.max("ordinal").alias("last_leaf"))


@query(f"SELECT kind, count(*) AS leaves, count(*) FILTER (WHERE is_open) AS inside FROM {_STATES} GROUP BY kind")
def unit_type_counts(spark, d):
    return units.leaf_states(_leaves(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("leaves"), F.count_if("is_open").alias("inside"))


@query(f"SELECT work, max_by(kind, ordinal) AS last_marker FROM {_LEAVES} WHERE kind <> 'block' GROUP BY work HAVING max_by(kind, ordinal) = 'open'")
def unit_state_errors(spark, d):
    return units.unterminated(_leaves(spark, d))


_BLOCKS = lines_of("documents", "doc_id")


@query(f"SELECT doc_id, ordinal::INTEGER AS ordinal, text FROM {_BLOCKS}")
def text_blocks(spark, d):
    return units.text_blocks(table(spark, d, "documents"))


@query(f"SELECT d.doc_id, least(1.0, coalesce(b.held, 0) / greatest(length(coalesce(d.text, '')), 1)) AS coverage FROM documents d LEFT JOIN (SELECT doc_id, sum(length(text)) AS held FROM {_BLOCKS} GROUP BY doc_id) b USING (doc_id)")
def block_coverage(spark, d):
    docs = table(spark, d, "documents")
    held = units.text_blocks(docs).groupBy("doc_id").agg(F.sum(F.char_length("text")).alias("held"))
    size = F.greatest(F.coalesce(F.char_length("text"), F.lit(0)), F.lit(1))
    return docs.join(held, "doc_id", "left").select("doc_id", F.least(F.lit(1.0), F.coalesce("held", F.lit(0)) / size).alias("coverage"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS marker FROM events")
def carry_forward_marker(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(order).alias("marker"))


_RANGES = "(SELECT o_custkey AS ref_id, min(o_orderkey) AS low, min(o_orderkey) + 3 AS high FROM orders GROUP BY o_custkey)"


@query(f"""SELECT r.ref_id, count(*) AS wanted, count(l.number) AS found, CASE WHEN count(l.number) = 0 THEN 'unresolved' WHEN count(l.number) = count(*) THEN 'resolved' ELSE 'partially_resolved' END AS status
FROM (SELECT ref_id, unnest(range(low, high + 1)) AS number FROM {_RANGES}) r LEFT JOIN (SELECT DISTINCT l_orderkey AS number FROM lineitem) l USING (number) GROUP BY r.ref_id""")
def range_resolution(spark, d):
    refs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ref_id")).agg(F.min("o_orderkey").alias("low"), (F.min("o_orderkey") + 3).alias("high"))
    return constraints.resolve_ranges(refs, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("number")))


@query("SELECT number AS missing FROM (SELECT unnest(range((SELECT min(l_orderkey) FROM lineitem), (SELECT max(l_orderkey) FROM lineitem) + 1)) AS number) WHERE number NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_numbers(spark, d):
    return constraints.missing_numbers(table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT coalesce(o.o_orderkey, l.l_orderkey) AS key, CASE WHEN l.l_orderkey IS NULL THEN 'left only' ELSE 'right only' END AS side FROM orders o FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey IS NULL OR l.l_orderkey IS NULL")
def key_mismatch_full_outer(spark, d):
    left, right = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey").distinct()
    both = left.join(right, left.o_orderkey == right.l_orderkey, "full").filter("o_orderkey IS NULL OR l_orderkey IS NULL")
    return both.select(F.coalesce("o_orderkey", "l_orderkey").alias("key"), F.when(F.col("l_orderkey").isNull(), "left only").otherwise("right only").alias("side"))


@query(f"SELECT doc_id, ordinal::INTEGER AS ordinal, (sum(length(text)) OVER w - length(text) / 2) / sum(length(text)) OVER (PARTITION BY doc_id) AS center FROM {_BLOCKS} WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def relative_centers(spark, d):
    return align.centers(units.text_blocks(table(spark, d, "documents")), "doc_id").select("doc_id", "ordinal", "center")


@query(f"""SELECT doc_id, ordinal::INTEGER AS ordinal, width::INTEGER AS width, length(window_text)::INTEGER AS size FROM (
 SELECT doc_id, ordinal, 1 AS width, text AS window_text FROM {_BLOCKS}
 UNION ALL SELECT doc_id, ordinal, 2, text || ' ' || n1 FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY ordinal) AS n1 FROM {_BLOCKS}) WHERE n1 IS NOT NULL
 UNION ALL SELECT doc_id, ordinal, 3, text || ' ' || n1 || ' ' || n2 FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY ordinal) AS n1, lead(text, 2) OVER (PARTITION BY doc_id ORDER BY ordinal) AS n2 FROM {_BLOCKS}) WHERE n2 IS NOT NULL)""")
def sliding_windows(spark, d):
    made = align.windows(units.text_blocks(table(spark, d, "documents")), "doc_id", 3)
    return made.select("doc_id", "ordinal", "width", F.char_length("window_text").alias("size"))


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3")
def window_topk(spark, d):
    return align.top_k(table(spark, d, "documents"), ["source"], [F.desc("n_chars"), "doc_id"], 3).select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, d):
    return constraints.duplicates(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def ref_anti_join(spark, d):
    return constraints.missing_references(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de')")
def enum_check(spark, d):
    return constraints.outside_enum(table(spark, d, "documents").select("doc_id", "lang"), "lang", ["en", "de"])


def _entries(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("pos"), F.col("user_id").alias("reviewer"), F.get_json_object("props", "$.k").alias("subject"), (F.col("event_type") == "purchase").alias("promoted"), (F.col("event_type") == "click").alias("accepted"))


_LINEAGE = """(SELECT *, lag(pos) OVER (PARTITION BY reviewer, subject ORDER BY pos) AS supersedes FROM (
 SELECT event_id AS pos, user_id AS reviewer, json_extract_string(props, '$.k') AS subject, event_type = 'purchase' AS promoted, event_type = 'click' AS accepted FROM events))"""


@query(f"SELECT pos, supersedes FROM {_LINEAGE}")
def review_lineage(spark, d):
    return ledger.lineage(_entries(spark, d)).select("pos", "supersedes")


@query(f"SELECT pos, reviewer, subject FROM {_LINEAGE} WHERE pos NOT IN (SELECT supersedes FROM {_LINEAGE} WHERE supersedes IS NOT NULL)")
def active_reviews(spark, d):
    return ledger.active(_entries(spark, d)).select("pos", "reviewer", "subject")


@query(f"""SELECT subject, CASE WHEN bool_or(is_active AND promoted) THEN 'established' WHEN bool_or(is_active AND accepted) THEN 'promotion_required' WHEN bool_or(promoted OR accepted) THEN 'review_stale' ELSE 'model_reviewed' END AS status
FROM (SELECT *, pos NOT IN (SELECT supersedes FROM {_LINEAGE} WHERE supersedes IS NOT NULL) AS is_active FROM {_LINEAGE}) GROUP BY subject""")
def derived_status(spark, d):
    entries = _entries(spark, d)
    alive = ledger.active(entries).select("pos", F.lit(True).alias("is_active"))
    return ledger.derived_status(entries.join(alive, "pos", "left").withColumn("is_active", F.coalesce("is_active", F.lit(False))))


@query("""WITH base AS (SELECT event_id AS pos, CASE WHEN event_id % 7 <> 0 THEN event_type END AS body FROM events),
 cur AS (SELECT pos, CASE WHEN pos % 97 = 0 THEN 'x' ELSE body END AS body FROM base WHERE pos % 89 <> 0 AND pos % 91 <> 0)
SELECT b.pos, CASE WHEN c.pos IS NULL THEN 'deleted' ELSE 'rewritten' END AS rule FROM base b LEFT JOIN cur c USING (pos) WHERE c.pos IS NULL OR b.body IS DISTINCT FROM c.body""")
def append_only_check(spark, d):
    base = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("body"))
    current = base.filter("pos % 89 <> 0 AND pos % 91 <> 0").withColumn("body", F.when(F.col("pos") % 97 == 0, "x").otherwise(F.col("body")))
    return constraints.positional_difference(base, current)


@query("SELECT r_regionkey, '| ' || any_value(r_name) || ' | ' || string_agg(n_name, ', ' ORDER BY n_name) || ' |' AS line FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def crosswalk_table_markdown(spark, d):
    names = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))
    return table(spark, d, "region").join(names, "r_regionkey").select("r_regionkey", F.concat(F.lit("| "), "r_name", F.lit(" | "), "names", F.lit(" |")).alias("line"))


from . import candidates, markup, reports, resolution, reviews, rules, texts, witnesses  # noqa: E402, F401  (their queries)
