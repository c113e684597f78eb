"""Identifier resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints
from ..sources import table
from .base import query

PREFIXES = ["P2", "P", "Q"]
# References by order: exact ids, ranges with either dash, reversed ranges, ids without a range, other identifiers.
_REFS = """(SELECT o_orderkey AS ref_id, CASE o_orderkey % 6 WHEN 0 THEN 'P ' || o_orderkey WHEN 1 THEN 'P ' || o_orderkey || '-' || (o_orderkey + 3) WHEN 2 THEN 'P2 ' || o_orderkey || '–' || (o_orderkey + 2)
 WHEN 3 THEN 'P ' || o_orderkey || '-' || (o_orderkey - 1) WHEN 4 THEN 'Q 48.' || o_orderkey ELSE 'T' || o_orderkey END AS identifier FROM orders WHERE o_orderkey % 5 <> 4)"""
_SEGMENTS = "(SELECT DISTINCT 'P ' || l_orderkey AS canonical_id FROM lineitem UNION SELECT DISTINCT 'P2 ' || l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0)"
_PARSED = f"""(SELECT *, regexp_extract(identifier, '^(P2|P|Q)\\s+(.+)$', 1) AS prefix, regexp_extract(identifier, '^(P2|P|Q)\\s+(.+)$', 2) AS body FROM {_REFS})"""
_BOUNDED = f"(SELECT *, try_cast(nullif(regexp_extract(body, '^(\\d+)[–-](\\d+)$', 1), '') AS BIGINT) AS low, try_cast(nullif(regexp_extract(body, '^(\\d+)[–-](\\d+)$', 2), '') AS BIGINT) AS high FROM {_PARSED})"


def _refs(spark, d):
    n = F.col("o_orderkey")
    of = lambda prefix, *rest: F.concat(F.lit(prefix), n.cast("string"), *rest)
    to = lambda k: (n + k).cast("string")
    told = (
        F.when(n % 6 == 0, of("P ")).when(n % 6 == 1, of("P ", F.lit("-"), to(3))).when(n % 6 == 2, of("P2 ", F.lit("–"), to(2)))
        .when(n % 6 == 3, of("P ", F.lit("-"), to(-1))).when(n % 6 == 4, of("Q 48.")).otherwise(of("T"))
    )
    return table(spark, d, "orders").filter("o_orderkey % 5 <> 4").select(n.alias("ref_id"), told.alias("identifier"))


def _segments(spark, d):
    n = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("n")).distinct()
    one = n.select(F.concat(F.lit("P "), F.col("n").cast("string")).alias("canonical_id"))
    return one.unionByName(n.filter("n % 3 = 0").select(F.concat(F.lit("P2 "), F.col("n").cast("string")).alias("canonical_id")))


@query(f"SELECT ref_id, nullif(prefix, '') AS prefix, nullif(body, '') AS body, low, high FROM {_BOUNDED}")
def collection_id_parse(spark, d):
    return _refs(spark, d).select("ref_id", constraints.parse_id(F.col("identifier"), PREFIXES).alias("p")).select("ref_id", "p.*")


@query(f"SELECT ref_id, prefix || ' ' || n AS wanted FROM (SELECT ref_id, prefix, unnest(range(low, high + 1)) AS n FROM {_BOUNDED} WHERE high >= low)")
def range_expansion(spark, d):
    parsed = _refs(spark, d).select("ref_id", constraints.parse_id(F.col("identifier"), PREFIXES).alias("p")).filter("p.high >= p.low")
    return parsed.select("ref_id", F.explode(F.sequence("p.low", "p.high")).alias("n"), "p.prefix").select("ref_id", F.concat("prefix", F.lit(" "), F.col("n").cast("string")).alias("wanted"))


_RESOLVED = f"""(SELECT ref_id, identifier, count(*) AS wanted, count(s.canonical_id) AS found, string_agg(s.canonical_id, ',' ORDER BY pos) AS segments, string_agg(wanted_id, ',' ORDER BY pos) FILTER (WHERE s.canonical_id IS NULL) AS missing,
 CASE WHEN count(s.canonical_id) = 0 THEN 'unresolved' WHEN count(s.canonical_id) = count(*) THEN 'resolved' ELSE 'partially_resolved' END AS status
FROM (SELECT ref_id, identifier, CASE WHEN low IS NULL OR high < low THEN identifier ELSE prefix || ' ' || n END AS wanted_id, n AS pos FROM (SELECT *, unnest(CASE WHEN low IS NULL OR high < low THEN [0::BIGINT] ELSE range(low, high + 1) END) AS n FROM {_BOUNDED} WHERE prefix <> ''))
LEFT JOIN {_SEGMENTS} s ON s.canonical_id = wanted_id GROUP BY ref_id, identifier)"""


def _resolved(spark, d):
    return constraints.resolve_ids(_refs(spark, d), _segments(spark, d), PREFIXES)


@query(f"SELECT ref_id, status, wanted, found, coalesce(segments, '') AS segments, coalesce(missing, '') AS missing FROM {_RESOLVED}")
def resolution_status(spark, d):
    return _resolved(spark, d).select("ref_id", "status", "wanted", "found", F.array_join("segments", ",").alias("segments"), F.array_join("missing", ",").alias("missing"))


@query(f"SELECT count(*) AS collection_witnesses, count(*) FILTER (WHERE status <> 'unresolved') AS resolved_witnesses, coalesce(sum(found) FILTER (WHERE status <> 'unresolved'), 0)::BIGINT AS resolved_segments, count(*) FILTER (WHERE status = 'unresolved') AS unresolved_witnesses FROM {_RESOLVED}")
def resolution_summary(spark, d):
    return constraints.resolution_summary(_resolved(spark, d))


@query(f"SELECT canonical_id, string_agg(ref_id, ',' ORDER BY ref_id) AS used_by FROM (SELECT ref_id, unnest(string_split(segments, ',')) AS canonical_id FROM {_RESOLVED} WHERE segments IS NOT NULL) GROUP BY canonical_id")
def used_by_groups(spark, d):
    made = constraints.used_by(_resolved(spark, d))
    return made.select("canonical_id", F.array_join(F.transform("used_by", lambda x: x.cast("string")), ",").alias("used_by"))


@query("SELECT o_orderpriority AS grp, n + 1 AS missing FROM (SELECT o_orderpriority, unnest(range(lo, hi)) AS n FROM (SELECT o_orderpriority, min(o_custkey) AS lo, max(o_custkey) - 1 AS hi FROM orders GROUP BY ALL)) WHERE (o_orderpriority, n + 1) NOT IN (SELECT (o_orderpriority, o_custkey) FROM orders)")
def missing_numbers_by_group(spark, d):
    return constraints.missing_numbers(table(spark, d, "orders"), "o_custkey", "o_orderpriority").withColumnRenamed("o_orderpriority", "grp")


@query("""SELECT l_shipmode_ AS container_id, count(*) AS segments, count(*) FILTER (WHERE kind = 'canonical') AS canonical, count(*) FILTER (WHERE kind = 'supplement') AS supplements, min_by(id, pos) AS first_id, max_by(id, pos) AS last_id
FROM (SELECT l_returnflag AS l_shipmode_, CASE WHEN l_linestatus = 'F' THEN 'canonical' ELSE 'supplement' END AS kind, l_orderkey || '.' || l_linenumber || '.' || l_partkey AS id, (l_orderkey * 100 + l_linenumber) * 1000000 + l_partkey AS pos FROM lineitem) GROUP BY ALL""")
def segment_manifest(spark, d):
    at = (F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    name = F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("container_id"), (F.col("l_linestatus") == "F").alias("is_canonical"), name.alias("id"), at.alias("at"))
    return rows.groupBy("container_id").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if("is_canonical").alias("canonical"), F.count_if(~F.col("is_canonical")).alias("supplements"), F.min_by("id", "at").alias("first_id"), F.max_by("id", "at").alias("last_id"),
    )
