"""Catalog queries: overrides, licenses, subjects, nested form, pinned sources, availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import after_number, blob_url, leading_int, license_text, names_subject
from ..operators import catalog, constraints
from ..sources import table
from .base import query

_KEYED = "(SELECT 'doc:' || doc_id AS witness_key, 'src:' || source AS work_key, lang AS language, left(text, 60) AS header, doc_id FROM documents)"
_OVERRIDES = "(SELECT 'doc:' || doc_id AS key, 'work:toxic' AS work_id FROM labels WHERE toxic = 1 UNION ALL SELECT 'src:src' || n_nationkey, 'work:' || n_name FROM nation WHERE n_nationkey % 3 = 0)"


@query(f"""SELECT k.witness_key, coalesce(w.work_id, s.work_id, k.work_key) AS work_id FROM {_KEYED} k
LEFT JOIN {_OVERRIDES} w ON w.key = k.witness_key LEFT JOIN {_OVERRIDES} s ON s.key = k.work_key""")
def override_lookup(spark, d):
    witnesses = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("witness_key"), F.concat(F.lit("src:"), "source").alias("work_key"))
    toxic = table(spark, d, "labels").filter("toxic = 1").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"), F.lit("work:toxic").alias("work_id"))
    nations = table(spark, d, "nation").filter("n_nationkey % 3 = 0").select(F.concat(F.lit("src:src"), F.col("n_nationkey").cast("string")).alias("key"), F.concat(F.lit("work:"), "n_name").alias("work_id"))
    return catalog.with_overrides(witnesses, toxic.unionByName(nations)).select("witness_key", "work_id")


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(f"SELECT page_id, CASE WHEN {_TITLE} <> '' AND page_id % 3 <> 0 THEN {_TITLE} || ' (' || url || ')' WHEN page_id % 3 <> 0 THEN url ELSE nullif({_TITLE}, '') END AS license FROM pages", name="license_text")
def license_texts(spark, d):
    label, target = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.when(F.col("page_id") % 3 != 0, F.col("url"))
    return table(spark, d, "pages").select("page_id", license_text(label, target).alias("license"))


@query(f"SELECT page_id, (len(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda x: contains(lower(x), '/th'))) > 0 OR contains(lower({_TITLE}), 'the ') OR contains(lower({_TITLE}), ' un ')) AS is_subject FROM pages")
def metadata_predicate(spark, d):
    targets, header = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", names_subject(targets, header, "/th", ["the ", " un "]).alias("is_subject"))


@query("SELECT page_id, regexp_replace(url, '\\.git$', '') || '/blob/' || CASE WHEN page_id % 4 = 0 THEN '' ELSE 'r' || page_id END || '/page.html' AS address FROM pages")
def source_urls(spark, d):
    revision = F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("r"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", blob_url(F.col("url"), revision, F.lit("page.html")).alias("address"))


@query("""SELECT region AS work_id, string_agg(language || ':' || ids, ';' ORDER BY language) AS languages FROM (
 SELECT n_regionkey AS region, n_name AS language, string_agg(s_name, ',' ORDER BY s_name) AS ids FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) GROUP BY region""")
def catalog_nested(spark, d):
    met = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    made = catalog.nested(met.select(F.col("n_regionkey").alias("work_id"), F.col("n_name").alias("language"), F.col("s_name").alias("witness_id")))
    told = F.transform("languages", lambda x: F.concat(x["language"], F.lit(":"), F.array_join(x["witnesses"], ",")))
    return made.select("work_id", F.array_join(told, ";").alias("languages"))


@query("SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"language\":\"' || lang || '\"' || CASE WHEN doc_id % 2 = 0 THEN ',\"notes\":\"even\"' ELSE '' END || '}' AS record FROM documents")
def witness_json(spark, d):
    note = F.when(F.col("doc_id") % 2 == 0, "even")
    return table(spark, d, "documents").select("doc_id", catalog.without_nulls("doc_id", F.col("lang").alias("language"), note.alias("notes")).alias("record"))


@query("""WITH w AS (SELECT doc_id - (CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END) AS witness_id, lang AS language, source AS work_id, CASE WHEN doc_id % 11 <> 0 THEN 'p' END AS source_path, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'c' END AS canonical_id FROM documents)
SELECT 'duplicate witness_id' AS rule, witness_id::VARCHAR AS subject, count(*)::VARCHAR AS detail FROM w GROUP BY witness_id HAVING count(*) > 1
UNION ALL SELECT 'unsupported language', witness_id::VARCHAR, NULL FROM w WHERE language IS NULL OR language NOT IN ('en', 'de', 'fr')
UNION ALL SELECT 'missing source_path', witness_id::VARCHAR, NULL FROM w WHERE source_path IS NULL OR source_path = ''
UNION ALL SELECT 'missing canonical_id', witness_id::VARCHAR, NULL FROM w WHERE canonical_id IS NULL OR canonical_id = ''
UNION ALL SELECT 'missing work_id', witness_id::VARCHAR, NULL FROM w WHERE work_id IS NULL OR work_id = ''""")
def catalog_violations(spark, d):
    n = F.col("doc_id")
    witnesses = table(spark, d, "documents").select(
        (n - F.when(n % 50 == 1, 1).otherwise(0)).alias("witness_id"), F.col("lang").alias("language"), F.col("source").alias("work_id"), F.when(n % 11 != 0, "p").alias("source_path"), F.when(n % 13 == 0, "").otherwise("c").alias("canonical_id"),
    )
    return constraints.witness_violations(witnesses, ("en", "de", "fr"), ("work_id", "canonical_id", "source_path"))


@query("""SELECT l.source, CASE WHEN p.source IS NULL THEN 'missing' ELSE 'revision mismatch' END AS rule
FROM (SELECT n_name AS source, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'r' || n_nationkey END AS revision FROM nation) l
LEFT JOIN (SELECT n_name AS source, 'r' || (n_nationkey - n_nationkey % 2) AS actual FROM nation WHERE n_nationkey % 7 <> 3) p USING (source)
WHERE p.source IS NULL OR (l.revision <> '' AND p.actual <> l.revision)""")
def revision_check(spark, d):
    nations, n = table(spark, d, "nation"), F.col("n_nationkey")
    lock = nations.select(F.col("n_name").alias("source"), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("r"), n.cast("string"))).alias("revision"))
    present = nations.filter("n_nationkey % 7 <> 3").select(F.col("n_name").alias("source"), F.concat(F.lit("r"), (n - n % 2).cast("string")).alias("revision"))
    return catalog.revision_differences(lock, present)


_CONFIG = "(SELECT doc_id AS witness_id, CASE WHEN quality = 0 THEN 'src0' ELSE source END AS configured, CASE WHEN toxic = 0 THEN 'text_available' ELSE 'planned' END AS status FROM labels JOIN documents USING (doc_id))"


@query(f"""SELECT w.doc_id AS witness_id, w.source AS work_id, CASE WHEN c.status = 'text_available' THEN c.status ELSE 'not_available' END AS status,
 CASE WHEN c.status = 'text_available' THEN len(string_split(w.text, chr(10))) ELSE 0 END::BIGINT AS segments, CASE WHEN c.status = 'text_available' THEN 1 ELSE 0 END::BIGINT AS units
FROM documents w LEFT JOIN {_CONFIG} c ON c.witness_id = w.doc_id WHERE c.status IS DISTINCT FROM 'text_available' OR c.configured = w.source""")
def availability_audit(spark, d):
    docs = table(spark, d, "documents")
    told = table(spark, d, "labels").join(docs.select("doc_id", "source"), "doc_id")
    config = told.select(F.col("doc_id").alias("witness_id"), F.when(F.col("quality") == 0, "src0").otherwise(F.col("source")).alias("work_id"), F.when(F.col("toxic") == 0, "text_available").otherwise("planned").alias("status"))
    wanted = docs.select(F.col("doc_id").alias("witness_id"), F.col("source").alias("work_id"))
    segments = docs.select(F.col("doc_id").alias("witness_id"), F.explode(F.split("text", "\n")).alias("line"))
    return catalog.availability(wanted, config, segments, wanted)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END::BIGINT AS number, CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS title FROM part""", name="leading_int")
def leading_ints(spark, d):
    n = F.col("p_partkey")
    label = F.when(n % 5 == 0, F.col("p_name")).when(n % 7 == 0, F.concat(F.lit("  "), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "), "p_name"))
    return table(spark, d, "part").select("p_partkey", leading_int(label).alias("number"), after_number(label).alias("title"))
