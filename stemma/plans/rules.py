"""Validation queries: ownership, counts, guardrails, alignments, crosswalks, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints
from ..sources import table
from .base import query


@query("SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS unit_id, l_suppkey::VARCHAR AS claimed, p_size::VARCHAR AS owner FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey <> p_size AND l_orderkey % 20 = 0")
def ownership_check(spark, d):
    lines = table(spark, d, "lineitem").filter("l_orderkey % 20 = 0")
    name = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    members = lines.select(F.col("l_partkey").alias("unit_id"), F.col("l_suppkey").cast("string").alias("claimed"), name.alias("name"))
    owners = table(spark, d, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_size").cast("string").alias("owner"))
    return constraints.wrong_owners(members, owners).select(F.col("name").alias("unit_id"), "claimed", "owner")


@query("SELECT 'too few of a class' AS rule, c AS subject, n::VARCHAR AS detail FROM (SELECT x.c, x.least, count(l_returnflag) AS n FROM (VALUES ('A', 1000000000), ('N', 1), ('X', 1)) x(c, least) LEFT JOIN lineitem ON l_returnflag = x.c GROUP BY ALL) WHERE n < least")
def guardrail_histogram(spark, d):
    return constraints.too_few(table(spark, d, "lineitem"), "l_returnflag", {"A": 1_000_000_000, "N": 1, "X": 1})


_SEGMENTS = """(SELECT source AS container_id, lang, CASE WHEN doc_id % 41 = 0 THEN NULL ELSE source || ' ' || (doc_id - CASE WHEN doc_id % 97 = 1 THEN 20 ELSE 0 END) END AS canonical_id,
 CASE WHEN doc_id % 10 = 0 THEN 'supplement' ELSE 'canonical' END AS record_kind, CASE WHEN doc_id % 29 <> 0 THEN 'a' END AS start_line, CASE WHEN doc_id % 31 = 0 THEN '' ELSE 'b' END AS end_line, CASE WHEN doc_id % 37 = 0 THEN 0 ELSE n_chars END AS text_chars FROM documents)"""
_CONFIG = "(SELECT 'src' || n_nationkey AS container_id, CASE WHEN n_nationkey % 2 = 0 THEN 50 END AS expected_segments, CASE WHEN n_nationkey % 3 = 0 THEN 45 END AS expected_canonical, CASE WHEN n_nationkey % 4 = 0 THEN 5 END AS expected_supplements FROM nation)"


@query(f"""WITH s AS {_SEGMENTS}, k AS (SELECT container_id, count(*) AS n, count(DISTINCT canonical_id) AS ids, count(canonical_id) AS named, count(*) FILTER (WHERE record_kind = 'canonical') AS canonical, count(*) FILTER (WHERE record_kind = 'supplement') AS supplements FROM s GROUP BY ALL),
c AS (SELECT f.*, coalesce(n, 0) AS n, coalesce(ids, 0) AS ids, coalesce(named, 0) AS named, coalesce(canonical, 0) AS canonical, coalesce(supplements, 0) AS supplements FROM {_CONFIG} f LEFT JOIN k USING (container_id))
SELECT 'duplicate canonical ids' AS rule, container_id AS subject FROM c WHERE ids < named
UNION ALL SELECT 'wrong number of segments', container_id FROM c WHERE n <> expected_segments
UNION ALL SELECT 'wrong number of canonical segments', container_id FROM c WHERE canonical <> coalesce(expected_canonical, expected_segments)
UNION ALL SELECT 'wrong number of supplements', container_id FROM c WHERE supplements <> coalesce(expected_supplements, 0)
UNION ALL SELECT 'no number', coalesce(canonical_id, container_id) FROM s WHERE canonical_id IS NULL
UNION ALL SELECT 'missing line span', coalesce(canonical_id, container_id) FROM s WHERE start_line IS NULL OR end_line = ''
UNION ALL SELECT 'empty text', coalesce(canonical_id, container_id) FROM s WHERE text_chars <= 0""")
def expected_count_check(spark, d):
    n = F.col("doc_id")
    name = F.when(n % 41 != 0, F.concat("source", F.lit(" "), (n - F.when(n % 97 == 1, 20).otherwise(0)).cast("string")))
    segments = table(spark, d, "documents").select(
        F.col("source").alias("container_id"), name.alias("canonical_id"), F.when(n % 10 == 0, "supplement").otherwise("canonical").alias("record_kind"), F.when(n % 29 != 0, "a").alias("start_line"),
        F.when(n % 31 == 0, "").otherwise("b").alias("end_line"), F.when(n % 37 == 0, 0).otherwise(F.col("n_chars")).alias("text_chars"),
    )
    k = F.col("n_nationkey")
    config = table(spark, d, "nation").select(F.concat(F.lit("src"), k.cast("string")).alias("container_id"), F.when(k % 2 == 0, 50).alias("expected_segments"), F.when(k % 3 == 0, 45).alias("expected_canonical"), F.when(k % 4 == 0, 5).alias("expected_supplements"))
    return constraints.segment_violations(segments, config).select("rule", "subject")


# Pairwise alignments made of orders: left ids are the order's customer, right ids the parts of its lines.
_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'machine_candidate' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'established' WHEN 3 THEN 'rejected' ELSE 'unknown' END"
_ROWS = f"""(SELECT o_orderkey::VARCHAR AS alignment_id, CASE WHEN o_orderkey % 13 = 0 THEN [] ELSE ['c' || o_custkey] END AS left_ids, coalesce(r.ids, []) AS right_ids, {_STATUS} AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'not_established' END AS assertion,
 CASE WHEN o_orderkey % 2 = 0 THEN 'shared_formula' ELSE 'other' END AS relation_type, CASE WHEN o_orderkey % 7 = 0 THEN 'structural_ranking' ELSE 'lexical_rule' END AS method_kind,
 CASE WHEN o_orderkey % 4 = 0 THEN 'reviewed' END AS r_status, CASE WHEN o_orderkey % 6 < 3 THEN 'human' ELSE 'model' END AS r_type, CASE WHEN o_orderkey % 8 <> 1 THEN 'name' END AS r_name, 'accepted' AS r_decision
 FROM orders LEFT JOIN (SELECT l_orderkey, list('p' || l_partkey) AS ids FROM lineitem GROUP BY ALL) r ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 1)"""
_LEFT = "(SELECT 'c' || c_custkey AS unit_id, c_mktsegment AS text FROM customer WHERE c_custkey % 17 <> 0)"
_RIGHT = "(SELECT 'p' || p_partkey AS unit_id, p_name AS text FROM part WHERE p_partkey % 19 <> 0)"


def _rows(spark, d):
    k = F.col("o_orderkey")
    right = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("ids"))
    none = F.array().cast("array<string>")
    status = F.when(k % 5 == 0, "machine_candidate").when(k % 5 == 1, "reviewed").when(k % 5 == 2, "established").when(k % 5 == 3, "rejected").otherwise("unknown")
    review = F.struct(F.when(k % 4 == 0, "reviewed").alias("status"), F.when(k % 6 < 3, "human").otherwise("model").alias("reviewer_type"), F.when(k % 8 != 1, "name").alias("reviewer"), F.lit("accepted").alias("decision"))
    return table(spark, d, "orders").filter("o_orderkey % 3 <> 1").join(right, "o_orderkey", "left").select(
        k.cast("string").alias("alignment_id"), F.when(k % 13 == 0, none).otherwise(F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")))).alias("left_ids"), F.coalesce("ids", none).alias("right_ids"), status.alias("status"),
        F.when(k % 3 == 0, "not_established").alias("assertion"), F.when(k % 2 == 0, "shared_formula").otherwise("other").alias("relation_type"), F.when(k % 7 == 0, "structural_ranking").otherwise("lexical_rule").alias("method_kind"), review.alias("review"),
    )


@query(f"""WITH a AS {_ROWS}, l AS {_LEFT}, r AS {_RIGHT}, lm AS (SELECT alignment_id, relation_type, x.id, l.text FROM (SELECT alignment_id, relation_type, unnest(left_ids) AS id FROM a) x LEFT JOIN l ON l.unit_id = x.id),
rm AS (SELECT alignment_id, relation_type, x.id, r.text FROM (SELECT alignment_id, relation_type, unnest(right_ids) AS id FROM a) x LEFT JOIN r ON r.unit_id = x.id)
SELECT 'left_ids must be a non-empty list' AS rule, alignment_id AS subject FROM a WHERE len(left_ids) = 0
UNION ALL SELECT 'right_ids must be a non-empty list', alignment_id FROM a WHERE len(right_ids) = 0
UNION ALL SELECT 'duplicate right unit', alignment_id FROM a WHERE len(list_distinct(right_ids)) < len(right_ids)
UNION ALL SELECT 'invalid status', alignment_id FROM a WHERE status = 'unknown'
UNION ALL SELECT 'established lacks reviewed status', alignment_id FROM a WHERE status = 'established' AND r_status IS NULL
UNION ALL SELECT 'established requires human reviewer', alignment_id FROM a WHERE status = 'established' AND r_type <> 'human'
UNION ALL SELECT 'established requires reviewer identity', alignment_id FROM a WHERE status = 'established' AND r_name IS NULL
UNION ALL SELECT 'machine candidate must say not_established', alignment_id FROM a WHERE status = 'machine_candidate' AND assertion IS NULL
UNION ALL SELECT 'structural ranking cannot be established', alignment_id FROM a WHERE status = 'established' AND method_kind = 'structural_ranking'
UNION ALL SELECT 'unresolved left unit', alignment_id FROM lm WHERE text IS NULL UNION ALL SELECT 'unresolved right unit', alignment_id FROM rm WHERE text IS NULL
UNION ALL SELECT 'left formula evidence absent', alignment_id FROM lm WHERE text IS NOT NULL AND relation_type = 'shared_formula' GROUP BY alignment_id HAVING NOT bool_or(contains(lower(text), 'build'))
UNION ALL SELECT 'right formula evidence absent', alignment_id FROM rm WHERE text IS NOT NULL AND relation_type = 'shared_formula' GROUP BY alignment_id HAVING NOT bool_or(contains(text, 'red') OR contains(text, 'ring'))""")
def alignment_violations(spark, d):
    left = table(spark, d, "customer").filter("c_custkey % 17 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("unit_id"), F.col("c_mktsegment").alias("text"))
    right = table(spark, d, "part").filter("p_partkey % 19 <> 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("unit_id"), F.col("p_name").alias("text"))
    return constraints.candidate_violations(_rows(spark, d), left, right, "build", ["red", "ring"]).select("rule", "subject")


# Alignments of several witnesses made of orders and their lines; a line is a member, its part the source unit.
_MEMBERS = """(SELECT l_orderkey, l_linenumber::VARCHAR AS member_id, CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'N' THEN 'n' ELSE 'z' END AS language, 'w' || (l_partkey % 3) AS witness_id, CASE WHEN l_quantity > 45 THEN 'lost_text_marker' ELSE 'whole' END AS coverage,
 'p' || l_partkey AS unit, CASE WHEN l_partkey % 2 = 0 THEN ['gap'] ELSE [] END AS features FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS c FROM lineitem) WHERE c = 1)"""


def _multi(spark, d):
    from pyspark.sql import Window

    one = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    lines = table(spark, d, "lineitem").withColumn("c", one).filter("c = 1")
    member = F.struct(
        F.col("l_linenumber").cast("string").alias("member_id"), F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "N", "n").otherwise("z").alias("language"), F.concat(F.lit("w"), (F.col("l_partkey") % 3).cast("string")).alias("witness_id"),
        F.when(F.col("l_quantity") > 45, "lost_text_marker").otherwise("whole").alias("coverage"), F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("source_unit_ids"),
        F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("gap"))).otherwise(F.array().cast("array<string>")).alias("editorial_features"),
    )
    grouped = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    k = F.col("k")
    variants = F.array(F.struct(F.when(k % 2 == 0, "textual_loss").otherwise("other").alias("type"), F.array(F.lit("1"), F.lit("2")).alias("member_ids")))
    review = F.struct(F.when(k % 3 != 0, "reviewed").alias("status"), F.lit("model").alias("reviewer_type"), F.when(k % 7 != 0, "accepted").alias("decision"))
    rows = grouped.select(k.cast("string").alias("alignment_id"), F.when(k % 11 == 0, "established").otherwise("model_reviewed").alias("status"), F.when(k % 5 == 0, F.array(F.lit("1"))).otherwise(F.array(F.lit("1"), F.lit("2"))).alias("relation_member_ids"), review.alias("review"), "members", variants.alias("variants"))
    p = F.col("p_partkey")
    units = table(spark, d, "part").filter("p_partkey % 23 <> 0").select(
        F.explode(F.array(F.lit("a"), F.lit("n"))).alias("language"), F.concat(F.lit("p"), p.cast("string")).alias("unit_id"), F.concat(F.lit("w"), (p % 3 + F.when(p % 29 == 0, 1).otherwise(0)).cast("string")).alias("owner"),
        F.when(p % 4 == 0, F.array(F.lit("gap"))).otherwise(F.array().cast("array<string>")).alias("features"), F.when(p % 6 == 0, "lost words").otherwise("words").alias("text"),
    )
    return rows, units


@query(f"""WITH m AS {_MEMBERS}, u AS (SELECT lang AS language, 'p' || p_partkey AS unit, 'w' || (p_partkey % 3 + CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 0 END) AS owner, CASE WHEN p_partkey % 4 = 0 THEN ['gap'] ELSE [] END AS actual, p_partkey % 6 = 0 AS says_lost FROM part, (VALUES ('a'), ('n')) v(lang) WHERE p_partkey % 23 <> 0),
g AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT language) AS langs, list(member_id) AS ids, coalesce(list(member_id) FILTER (WHERE coverage = 'lost_text_marker'), []) AS lost FROM m GROUP BY ALL),
w AS (SELECT *, CASE WHEN k % 5 = 0 THEN ['1'] ELSE ['1', '2'] END AS rel FROM g WHERE n >= 2),
j AS (SELECT m.*, u.owner, u.actual, u.says_lost, m.l_orderkey || '/' || m.member_id AS subject FROM m JOIN w ON w.k = m.l_orderkey LEFT JOIN u ON u.language = m.language AND u.unit = m.unit)
SELECT 'fewer than two members' AS rule, k::VARCHAR AS subject FROM g WHERE n < 2
UNION ALL SELECT 'fewer than two languages', k::VARCHAR FROM w WHERE langs < 2
UNION ALL SELECT 'relation scope must name two members', k::VARCHAR FROM w WHERE k % 5 = 0
UNION ALL SELECT 'relation names unknown member', k::VARCHAR FROM w WHERE k % 5 <> 0 AND NOT list_has_all(ids, rel)
UNION ALL SELECT 'lost member in relation', k::VARCHAR FROM w WHERE k % 5 <> 0 AND list_has_any(lost, rel)
UNION ALL SELECT 'variant names unknown member', k::VARCHAR FROM w WHERE NOT list_has_all(ids, ['1', '2'])
UNION ALL SELECT 'lost member without textual_loss variant', k::VARCHAR FROM w WHERE len(list_filter(lost, lambda x: k % 2 <> 0 OR x NOT IN ('1', '2'))) > 0
UNION ALL SELECT 'established must not be stored', k::VARCHAR FROM w WHERE k % 11 = 0
UNION ALL SELECT 'model_reviewed requires reviewed status', k::VARCHAR FROM w WHERE k % 11 <> 0 AND k % 3 = 0
UNION ALL SELECT 'model_reviewed requires accepted decision', k::VARCHAR FROM w WHERE k % 11 <> 0 AND k % 7 = 0
UNION ALL SELECT 'unsupported language', subject FROM j WHERE language = 'z'
UNION ALL SELECT 'unresolved source unit', subject FROM j WHERE language <> 'z' AND owner IS NULL
UNION ALL SELECT 'unit belongs to another witness', subject FROM j WHERE language <> 'z' AND owner <> witness_id
UNION ALL SELECT 'editorial_features differ from the source', subject FROM j WHERE language <> 'z' AND features <> coalesce(actual, [])
UNION ALL SELECT 'lost marker without resolved units', subject FROM j WHERE language <> 'z' AND coverage = 'lost_text_marker' AND owner IS NULL
UNION ALL SELECT 'lost marker source does not say lost', subject FROM j WHERE language <> 'z' AND coverage = 'lost_text_marker' AND NOT says_lost""")
def multiwitness_violations(spark, d):
    return constraints.multiwitness_violations(*_multi(spark, d)).select("rule", "subject")


# Crosswalk records are nations, their edges the customers (full parallels) and suppliers (other lists).
_EDGES = """(SELECT c_nationkey AS id, 'chinese' AS list_name, CASE WHEN c_custkey % 9 = 0 THEN 'pli' ELSE 'lzh' END AS language, CASE WHEN c_custkey % 10 = 0 THEN 'exact_parallel' ELSE 'full_textual_parallel' END AS relation_class, CASE WHEN c_custkey % 12 <> 0 THEN 'high' END AS confidence, 'P ' || c_custkey AS canonical_id, CASE WHEN c_custkey % 14 <> 0 THEN 'c' END AS container_id, NULL AS evidence_basis, 'n' || (c_custkey % 30) AS cited FROM customer
 UNION ALL SELECT s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'sanskrit_bhs' ELSE 'partial' END, CASE WHEN s_suppkey % 3 = 0 THEN 'bhs' ELSE 'xx' END, 'shared_passage', 'low', 'S', NULL, CASE WHEN s_suppkey % 4 = 0 THEN 'e' END, 'n1' FROM supplier
 UNION ALL SELECT n_nationkey, 'anchor', CASE WHEN n_nationkey % 8 = 0 THEN 'san' ELSE 'pli' END, 'anchor', NULL, 'A', NULL, NULL, 'n2' FROM nation)"""


def _edges(spark, d):
    text = lambda c: F.col(c).cast("string")
    c, s, n = F.col("c_custkey"), F.col("s_suppkey"), F.col("n_nationkey")
    null = F.lit(None).cast("string")
    row = lambda *cols: [x.alias(name) for x, name in zip(cols, ("id", "list_name", "language", "relation_class", "confidence", "canonical_id", "container_id", "evidence_basis", "cited"), strict=True)]
    full = table(spark, d, "customer").select(*row(F.col("c_nationkey"), F.lit("chinese"), F.when(c % 9 == 0, "pli").otherwise("lzh"), F.when(c % 10 == 0, "exact_parallel").otherwise("full_textual_parallel"), F.when(c % 12 != 0, "high"), F.concat(F.lit("P "), text("c_custkey")), F.when(c % 14 != 0, "c"), null, F.array(F.concat(F.lit("n"), (c % 30).cast("string")))))
    other = table(spark, d, "supplier").select(*row(F.col("s_nationkey"), F.when(s % 2 == 0, "sanskrit_bhs").otherwise("partial"), F.when(s % 3 == 0, "bhs").otherwise("xx"), F.lit("shared_passage"), F.lit("low"), F.lit("S"), null, F.when(s % 4 == 0, "e"), F.array(F.lit("n1"))))
    anchor = table(spark, d, "nation").select(*row(n, F.lit("anchor"), F.when(n % 8 == 0, "san").otherwise("pli"), F.lit("anchor"), null, F.lit("A"), null, null, F.array(F.lit("n2"))))
    return full.unionByName(other).unionByName(anchor)


@query(f"""WITH e AS {_EDGES}, x AS (SELECT n_nationkey AS id, n_nationkey + 1 AS rank, 'A' || (n_nationkey % 24) AS anchor_id FROM nation), k AS (SELECT x.id, count(*) FILTER (WHERE list_name = 'chinese') AS f, count(*) FILTER (WHERE list_name = 'sanskrit_bhs') AS i FROM x LEFT JOIN e USING (id) GROUP BY x.id)
SELECT 'wrong number of records' AS rule, 'crosswalk' AS subject FROM x HAVING count(*) <> 20 UNION ALL SELECT 'duplicate anchor', 'crosswalk' FROM x HAVING count(DISTINCT anchor_id) < count(*)
UNION ALL SELECT 'ranks must count from 1', 'crosswalk' FROM x HAVING list(rank::INTEGER ORDER BY rank) <> range(1, 21)::INTEGER[]
UNION ALL SELECT 'anchor has the wrong language', id::VARCHAR FROM e WHERE list_name = 'anchor' AND language <> 'pli'
UNION ALL SELECT 'full parallel has the wrong language', id::VARCHAR FROM e WHERE list_name = 'chinese' AND language <> 'lzh' UNION ALL SELECT 'full parallel has the wrong relation', id::VARCHAR FROM e WHERE list_name = 'chinese' AND relation_class <> 'full_textual_parallel'
UNION ALL SELECT 'collection id without container', id::VARCHAR FROM e WHERE list_name = 'chinese' AND container_id IS NULL
UNION ALL SELECT 'unsupported language', id::VARCHAR FROM e WHERE language = 'xx' UNION ALL SELECT 'unsupported relation', id::VARCHAR FROM e WHERE relation_class = 'exact_parallel' UNION ALL SELECT 'exact_parallel is forbidden', id::VARCHAR FROM e WHERE relation_class = 'exact_parallel'
UNION ALL SELECT 'invalid confidence', id::VARCHAR FROM e WHERE relation_class <> 'anchor' AND confidence IS NULL UNION ALL SELECT 'bhs requires evidence', id::VARCHAR FROM e WHERE language = 'bhs' AND evidence_basis IS NULL
UNION ALL SELECT 'no full parallel', id::VARCHAR FROM k WHERE f = 0 UNION ALL SELECT 'no other Indic witness', id::VARCHAR FROM k WHERE i = 0
UNION ALL SELECT 'unresolved bibliography id', id::VARCHAR FROM e WHERE cited NOT IN (SELECT 'n' || n_nationkey FROM nation)
UNION ALL SELECT 'too few of a class', 'doctrinal_parallel'""")
def crosswalk_violations(spark, d):
    n = F.col("n_nationkey")
    crosswalks = table(spark, d, "nation").select(n.alias("id"), (n + 1).alias("rank"), F.concat(F.lit("A"), (n % 24).cast("string")).alias("anchor_id"), F.array().cast("array<string>").alias("cited"))
    entries = table(spark, d, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("entry_id"))
    return constraints.crosswalk_violations(crosswalks, _edges(spark, d), entries, 20, {"full_textual_parallel": 20, "doctrinal_parallel": 1}, ["P"]).select("rule", "subject")


@query("""WITH base AS (SELECT event_id AS pos, event_id AS id, event_type AS body FROM events), cur AS (SELECT event_id AS pos, event_id - CASE WHEN event_id % 201 = 7 THEN 1 ELSE 0 END AS id, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE event_type END AS body FROM events WHERE event_id % 89 <> 0)
SELECT 'shorter than before' AS rule, 'ledger' AS subject WHERE (SELECT count(*) FROM cur) < (SELECT count(*) FROM base)
UNION ALL SELECT CASE WHEN c.pos IS NULL THEN 'deleted' ELSE 'rewritten' END, b.pos::VARCHAR FROM base b LEFT JOIN cur c USING (pos) WHERE c.pos IS NULL OR b.body IS DISTINCT FROM c.body
UNION ALL SELECT 'duplicate id', id::VARCHAR FROM cur GROUP BY id HAVING count(*) > 1""")
def append_only_violations(spark, d):
    e = F.col("event_id")
    base = table(spark, d, "events").select(e.alias("pos"), e.alias("id"), F.col("event_type").alias("body"))
    current = base.filter("pos % 89 <> 0").select("pos", (F.col("id") - F.when(F.col("id") % 201 == 7, 1).otherwise(0)).alias("id"), F.when(F.col("pos") % 97 == 0, "x").otherwise(F.col("body")).alias("body"))
    return constraints.ledger_violations(base, current).select("rule", "subject")


@query("SELECT coalesce(a.n, b.n) AS line_no, a.line AS new, b.line AS old FROM (SELECT n_nationkey AS n, n_name AS line FROM nation WHERE n_nationkey <> 3) a FULL JOIN (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 6 = 0 THEN 'old' ELSE n_name END AS line FROM nation WHERE n_nationkey <> 5) b ON a.n = b.n WHERE a.line IS DISTINCT FROM b.line")
def view_drift(spark, d):
    lines = table(spark, d, "nation").select(F.col("n_nationkey").alias("line_no"), F.col("n_name").alias("line"))
    old = lines.filter("line_no <> 5").withColumn("line", F.when(F.col("line_no") % 6 == 0, "old").otherwise(F.col("line")))
    return constraints.view_drift(lines.filter("line_no <> 3"), old)
