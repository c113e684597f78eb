"""Review and promotion queries: two ledgers made of events and orders, with real digests.

An alignment is a customer; its one member names the customer's nation, and its units are the nation's regions' rows.
Reviews are orders, in order of their keys; their evidence was taken from what was there then, which for some has
changed since.  Promotions are orders of one priority.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_digest, json_without
from ..operators import ledger
from ..sources import table
from .base import query

CASE = "case"
# An alignment's claim and a unit's view as canonical JSON, and their digests, now and as some evidence has them.
_CLAIM = "'{\"alignment_id\":\"a' || c_custkey || '\",\"members\":[{\"language\":\"pli\",\"witness_id\":\"w' || c_nationkey || '\"}],\"segment\":\"' || c_mktsegment || '\"}'"
_VIEW = "'{\"meta\":{\"region\":' || n_regionkey || '},\"source_id\":\"n' || n_nationkey || '\",\"text_html\":\"' || n_name || '\"}'"
_ALIGNMENTS = f"(SELECT 'a' || c_custkey AS alignment_id, c_custkey, c_nationkey, 'sha256:' || sha256({_CLAIM}) AS claim_digest FROM customer WHERE c_custkey % 10 <> 9)"
_UNITS = f"(SELECT n_nationkey, 'sha256:' || sha256({_VIEW}) AS digest FROM nation WHERE n_nationkey <> 7)"
_REVIEWS = f"""(SELECT o.pos, o.review_id, 'a' || o.cust AS alignment_id, o.reviewer, o.decision, o.agreed, o.at, o.supersedes, a.alignment_id IS NOT NULL AS known, a.alignment_id IS NOT NULL AND u.digest IS NULL AS unresolved,
 CASE WHEN o.pos % 7 = 0 THEN 'sha256:' || sha256('old') WHEN o.pos % 31 = 0 THEN 'broken' ELSE coalesce(a.claim_digest, 'sha256:' || sha256('none')) END AS claim_digest, a.claim_digest AS now_claim, CASE WHEN o.pos % 11 = 0 THEN 'sha256:' || sha256('old') ELSE coalesce(u.digest, 'sha256:' || sha256('gone')) END AS unit_digest, u.digest AS now_unit, a.c_nationkey AS nation
 FROM (SELECT o_orderkey AS pos, 'r' || o_orderkey AS review_id, o_custkey AS cust, 'h' || (o_orderkey % 2) AS reviewer, CASE WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_orderstatus = 'O' THEN 'rejected' ELSE 'accepted' END AS decision, o_orderkey % 5 <> 3 AS agreed, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at,
  CASE WHEN o_orderkey % 13 = 5 THEN 'r0' ELSE lag('r' || o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) END AS supersedes FROM orders) o
 LEFT JOIN {_ALIGNMENTS} a ON a.c_custkey = o.cust LEFT JOIN {_UNITS} u ON u.n_nationkey = a.c_nationkey)"""


def _alignments(spark, d):
    members = F.array(F.struct(F.lit("pli").alias("language"), F.concat(F.lit("w"), F.col("c_nationkey").cast("string")).alias("witness_id"), F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("source_unit_ids")))
    name = F.concat(F.lit("a"), F.col("c_custkey").cast("string"))
    stored = F.to_json(F.struct(F.lit("model_reviewed").alias("status"), name.alias("alignment_id"), F.col("c_mktsegment").alias("segment"), F.array(F.struct(F.col("members")[0]["witness_id"].alias("witness_id"), F.lit("pli").alias("language"), F.array(F.lit("x")).alias("units"))).alias("members")))
    made = table(spark, d, "customer").filter("c_custkey % 10 <> 9").withColumn("members", members)
    return made.select(name.alias("alignment_id"), ledger.claim(stored).alias("claim"), "members")


def _units(spark, d):
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    view = F.to_json(F.struct(name.alias("source_id"), F.col("n_name").alias("text_html"), F.struct(F.col("n_regionkey").alias("region")).alias("meta")))
    return table(spark, d, "nation").filter("n_nationkey <> 7").select(F.lit("pli").alias("language"), name.alias("unit_id"), view.alias("view"))


def _sha(text: str):
    return F.concat(F.lit("sha256:"), F.sha2(F.lit(text), 256))


def _judged(spark, d):
    from pyspark.sql import Window

    alignments, units = _alignments(spark, d), _units(spark, d)
    expected = ledger.snapshots(alignments, units)
    k = F.col("o_orderkey")
    name = F.concat(F.lit("r"), k.cast("string"))
    before = F.lag(name).over(Window.partitionBy("o_custkey", k % 2).orderBy("o_orderkey"))
    answers = F.struct(*[F.when((k % 5 == 3) if a == "variant_notes" else F.lit(False), "revise").otherwise("agree").alias(a) for a in ledger.ASSESSMENTS])
    orders = table(spark, d, "orders").select(
        k.alias("pos"), F.lit(2).alias("review_schema_version"), name.alias("review_id"), F.lit(CASE).alias("case_study_id"), F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("alignment_id"),
        F.when(k % 13 == 5, "r0").otherwise(before).alias("supersedes_review_id"), F.struct(F.lit("human").alias("reviewer_type"), F.lit("Name").alias("name"), F.concat(F.lit("h"), (k % 2).cast("string")).alias("reviewer_id")).alias("reviewer"),
        F.when(F.col("o_orderstatus") == "O", "rejected").otherwise("accepted").alias("decision"), answers.alias("assessments"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("reviewed_at"), "o_custkey",
    )
    # evidence as it was recorded: that of now, but for some entries
    now = expected.select("alignment_id", F.col("expected.alignment_claim_digest").alias("claim_now"), F.col("expected.source_units")[0].alias("unit_now"))
    met = orders.join(now, "alignment_id", "left")
    pos = F.col("pos")
    claim = F.when(pos % 7 == 0, _sha("old")).when(pos % 31 == 0, "broken").otherwise(F.coalesce("claim_now", _sha("none")))
    unit = F.struct(F.lit("pli").alias("language"), F.coalesce("unit_now.witness_id", F.lit("w")).alias("witness_id"), F.coalesce("unit_now.source_unit_id", F.lit("n")).alias("source_unit_id"), F.when(pos % 11 == 0, _sha("old")).otherwise(F.coalesce("unit_now.digest", _sha("gone"))).alias("digest"))
    evidence = F.struct(F.lit(1).alias("evidence_version"), claim.alias("alignment_claim_digest"), F.array(unit).alias("source_units")).cast(ledger.EVIDENCE)
    reviews = met.withColumn("evidence", evidence).withColumn("record", F.to_json(F.struct("review_id", "decision"))).drop("claim_now", "unit_now", "o_custkey")
    return alignments, ledger.freshness(reviews, expected)


@query(f"SELECT alignment_id, claim_digest, sha256('[' || coalesce(digest, 'null') || ']') AS units FROM {_ALIGNMENTS} a LEFT JOIN {_UNITS} u ON u.n_nationkey = a.c_nationkey")
def evidence_digest(spark, d):
    made = ledger.snapshots(_alignments(spark, d), _units(spark, d))
    digests = F.transform("expected.source_units", lambda u: F.coalesce(u["digest"], F.lit("null")))
    return made.select("alignment_id", F.col("expected.alignment_claim_digest").alias("claim_digest"), F.sha2(F.concat(F.lit("["), F.array_join(digests, ","), F.lit("]")), 256).alias("units"))


@query("SELECT event_id, 'sha256:' || sha256('{\"event\":' || event_id || ',\"none\":null,\"props\":{\"k\":' || json_extract_string(props, '$.k') || '},\"type\":\"' || event_type || '\"}') AS digest, 'sha256:' || sha256('{\"event\":' || event_id || ',\"props\":{\"k\":' || json_extract_string(props, '$.k') || '}}') AS bare FROM events")
def canonical_json_digest(spark, d):
    text = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "props": '), "props", F.lit(', "none": null, "event": '), F.col("event_id").cast("string"), F.lit("}"))
    bare = json_without(text, F.lit("type,none"), F.lit(""), F.lit(""))
    return table(spark, d, "events").select("event_id", json_digest(text).alias("digest"), F.concat(F.lit("sha256:"), F.sha2(bare, 256)).alias("bare"))


_FRESH = "(known AND NOT unresolved AND claim_digest = now_claim AND unit_digest = now_unit)"
_REASONS = f"CASE WHEN NOT known OR {_FRESH} THEN '' WHEN unresolved THEN 'current_source_unit_unresolved' ELSE concat_ws(',', CASE WHEN claim_digest <> now_claim THEN 'alignment_claim_digest_changed' END, CASE WHEN unit_digest <> now_unit THEN 'source_unit_evidence_changed' END) END"


@query(f"SELECT review_id, coalesce({_FRESH}, false) AS fresh, {_REASONS} AS reasons FROM {_REVIEWS}")
def freshness(spark, d):
    return _judged(spark, d)[1].select("review_id", "fresh", F.array_join("reasons", ",").alias("reasons"))


_ELIGIBLE = f"(coalesce({_FRESH}, false) AND decision = 'accepted' AND agreed)"


@query(f"SELECT review_id, {_ELIGIBLE} AS eligible FROM {_REVIEWS}")
def eligibility(spark, d):
    return _judged(spark, d)[1].select("review_id", ledger.eligible(F.col("fresh")).alias("eligible"))


@query(f"""SELECT 'unknown alignment_id' AS rule, review_id AS subject FROM {_REVIEWS} WHERE NOT known UNION ALL SELECT 'claim digest is malformed', review_id FROM {_REVIEWS} WHERE claim_digest = 'broken'
UNION ALL SELECT 'accepted requires all to agree', review_id FROM {_REVIEWS} WHERE decision = 'accepted' AND NOT agreed UNION ALL SELECT 'stale evidence', review_id FROM {_REVIEWS} WHERE NOT coalesce({_FRESH}, false)""")
def review_violations(spark, d):
    return ledger.review_violations(_judged(spark, d)[1], CASE, require_fresh=True).select("rule", "subject")


_LATEST = "(SELECT *, lag(review_id) OVER (PARTITION BY reviewer, alignment_id ORDER BY pos) AS latest FROM (SELECT o_orderkey AS pos, 'r' || o_orderkey AS review_id, 'a' || o_custkey AS alignment_id, 'h' || (o_orderkey % 2) AS reviewer, CASE WHEN o_orderkey % 13 = 5 THEN 'r0' ELSE lag('r' || o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) END AS target FROM orders))"


@query(f"""WITH l AS {_LATEST}, t AS (SELECT l.*, z.pos AS z_pos, z.alignment_id AS z_alignment, z.reviewer AS z_reviewer FROM l LEFT JOIN l z ON z.review_id = l.target)
SELECT 'supersedes without an earlier review' AS rule, review_id AS subject FROM t WHERE latest IS NULL AND target IS NOT NULL UNION ALL SELECT 'revision must supersede the latest', review_id FROM t WHERE latest IS NOT NULL AND target IS DISTINCT FROM latest
UNION ALL SELECT 'supersedes unknown or later review', review_id FROM t WHERE target IS NOT NULL AND NOT coalesce(z_pos < pos, false) UNION ALL SELECT 'superseded review is of another alignment', review_id FROM t WHERE z_pos < pos AND z_alignment <> alignment_id
UNION ALL SELECT 'superseded review is of another reviewer', review_id FROM t WHERE z_pos < pos AND z_reviewer <> reviewer""")
def lineage_violations(spark, d):
    return ledger.lineage_violations(_judged(spark, d)[1]).select("rule", "subject")


@query("SELECT 'h' || (o_orderkey % 2) AS reviewer_id, 'a' || o_custkey AS alignment_id, 'r' || max(o_orderkey) AS review_id FROM orders GROUP BY ALL")
def latest_prior(spark, d):
    return ledger.latest_prior(_judged(spark, d)[1])


# Promotions: orders of one priority promote the review of their own key; some bind another record or lack a promoter.
_PROMOTIONS = f"""(SELECT p.*, r.review_id IS NOT NULL AS there, r.known AND r.claim_digest <> 'broken' AND NOT (r.decision = 'accepted' AND NOT r.agreed) AS sound, coalesce({_FRESH}, false) AS fresh, r.decision = 'accepted' AND r.agreed AS may_carry, r.review_id NOT IN (SELECT supersedes FROM {_REVIEWS} WHERE supersedes IS NOT NULL) AS is_active
 FROM (SELECT o_orderkey AS pos, 'p' || (o_orderkey - CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END) AS promotion_id, 'a' || o_custkey AS alignment_id, 'r' || o_orderkey AS review_id, o_orderkey % 17 <> 0 AS bound, o_orderkey % 19 <> 0 AS has_name FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2', '3')) p LEFT JOIN {_REVIEWS} r ON r.review_id = p.review_id)"""
_VALID = "(there AND sound AND may_carry AND bound AND has_name)"


def _promotions(spark, d):
    alignments, judged = _judged(spark, d)
    k = F.col("o_orderkey")
    own = table(spark, d, "orders").filter(F.left("o_orderpriority", F.lit(1)).isin("1", "2", "3")).select(
        k.alias("pos"), F.lit(1).alias("promotion_schema_version"), F.concat(F.lit("p"), (k - F.when(k % 50 == 1, 1).otherwise(0)).cast("string")).alias("promotion_id"), F.lit(CASE).alias("case_study_id"),
        F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("alignment_id"), F.concat(F.lit("r"), k.cast("string")).alias("review_id"), F.lit("established").alias("decision"),
        F.struct(F.lit("human").alias("actor_type"), F.when(k % 19 != 0, "Name").otherwise(" ").alias("name"), F.lit("id").alias("actor_id")).alias("promoter"), F.lit("2024-01-01T00:00:00+00:00").alias("promoted_at"), F.lit(ledger.POLICY).alias("policy_version"),
    )
    bound = judged.select("review_id", json_digest(F.col("record")).alias("r"), ledger.evidence_digest(F.col("evidence")).alias("evidence_digest"))
    made = own.join(bound, "review_id", "left").withColumn("review_digest", F.when(F.col("pos") % 17 == 0, _sha("other")).otherwise(F.col("r"))).drop("r")
    return alignments, judged, ledger.judged_promotions(made, judged, CASE)


@query(f"""WITH p AS MATERIALIZED {_PROMOTIONS}, r AS MATERIALIZED {_REVIEWS} SELECT 'promoter name is required' AS rule, promotion_id AS subject FROM p WHERE NOT has_name UNION ALL SELECT 'review_digest does not bind the review', promotion_id FROM p WHERE NOT bound
UNION ALL SELECT 'review may not carry a promotion', promotion_id FROM p WHERE NOT may_carry
UNION ALL SELECT 'referenced review: unknown alignment_id', promotion_id FROM p JOIN r USING (review_id) WHERE NOT r.known UNION ALL SELECT 'referenced review: claim digest is malformed', promotion_id FROM p JOIN r USING (review_id) WHERE r.claim_digest = 'broken'
UNION ALL SELECT 'referenced review: accepted requires all to agree', promotion_id FROM p JOIN r USING (review_id) WHERE r.decision = 'accepted' AND NOT r.agreed
UNION ALL SELECT 'duplicate promotion_id', promotion_id FROM p GROUP BY promotion_id HAVING count(*) > 1""")
def promotion_violations(spark, d):
    return ledger.promotion_violations(_promotions(spark, d)[2]).select("rule", "subject")


@query("SELECT rule, subject FROM (SELECT 'duplicate promotion' AS rule, user_id || '/' || json_extract_string(props, '$.k') AS subject, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL) WHERE n > 1")
def duplicate_promotion(spark, d):
    events = table(spark, d, "events").filter("event_type = 'purchase'")
    told = events.select(F.col("user_id").cast("string").alias("alignment_id"), F.get_json_object("props", "$.k").alias("review_id"), F.col("event_id").cast("string").alias("promotion_id"))
    return ledger.duplicate_promotions(told).select("rule", "subject")


_STATUS = f"""(WITH r AS MATERIALIZED (SELECT *, review_id NOT IN (SELECT supersedes FROM {_REVIEWS} WHERE supersedes IS NOT NULL) AS is_active, known AND claim_digest <> 'broken' AND NOT (decision = 'accepted' AND NOT agreed) AS sound, coalesce({_FRESH}, false) AS fresh FROM {_REVIEWS}), p AS MATERIALIZED {_PROMOTIONS},
rr AS (SELECT alignment_id, count(*) FILTER (WHERE is_active AND sound AND fresh AND decision = 'accepted') AS fresh_n, count(*) FILTER (WHERE is_active AND sound AND NOT fresh AND decision = 'accepted') AS stale_n, count(*) FILTER (WHERE NOT is_active) AS superseded_n FROM r GROUP BY ALL),
pp AS (SELECT alignment_id, count(*) AS valid_n, bool_or(fresh AND is_active) AS current FROM p WHERE {_VALID} GROUP BY ALL)
SELECT a.alignment_id, CASE WHEN current THEN 'established' WHEN fresh_n > 0 THEN 'promotion_required' WHEN valid_n > 0 OR stale_n > 0 THEN 'review_stale' ELSE 'model_reviewed' END AS derived_status, coalesce(fresh_n, 0) AS fresh_n, coalesce(stale_n, 0) AS stale_n, coalesce(superseded_n, 0) AS superseded_n, coalesce(valid_n, 0) AS valid_n
FROM {_ALIGNMENTS} a LEFT JOIN rr USING (alignment_id) LEFT JOIN pp USING (alignment_id))"""


@query(f"SELECT * FROM {_STATUS}")
def promotion_state(spark, d):
    alignments, judged, promotions = _promotions(spark, d)
    made = ledger.alignment_status(alignments, judged, promotions, CASE)
    names = {"fresh_n": "fresh_accepted_review_ids", "stale_n": "stale_accepted_review_ids", "superseded_n": "superseded_review_ids", "valid_n": "valid_promotion_ids"}
    return made.select("alignment_id", "derived_status", *[F.size(c).cast("long").alias(n) for n, c in names.items()])


@query(f"SELECT derived_status, count(*) AS n FROM {_STATUS} GROUP BY ALL")
def status_histogram(spark, d):
    alignments, judged, promotions = _promotions(spark, d)
    return ledger.alignment_status(alignments, judged, promotions, CASE).groupBy("derived_status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT * FROM (SELECT count(*) FILTER (WHERE coalesce({_FRESH}, false)) AS fresh, count(*) FILTER (WHERE NOT coalesce({_FRESH}, false)) AS stale, count(*) FILTER (WHERE decision = 'accepted') AS accepted FROM {_REVIEWS}), (SELECT count(*) FILTER (WHERE fresh AND is_active) AS current, count(*) FILTER (WHERE NOT (fresh AND is_active)) AS historical FROM {_PROMOTIONS} WHERE {_VALID})")
def review_counters(spark, d):
    _, judged, promotions = _promotions(spark, d)
    return ledger.counters(judged, promotions.filter(F.size("errors") == 0))


@query("SELECT 'wrong version' AS rule, n_name AS subject FROM nation WHERE n_nationkey % 4 <> 1 UNION ALL SELECT 'wrong case_study_id', n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'wrong policy_version', n_name FROM nation WHERE n_nationkey % 3 = 0")
def ledger_headers(spark, d):
    k = F.col("n_nationkey")
    headers = table(spark, d, "nation").select(F.col("n_name").alias("ledger_id"), (k % 4).alias("version"), F.col("n_regionkey").cast("string").alias("case_study_id"), F.when(k % 3 != 0, ledger.POLICY).alias("policy_version"))
    return ledger.header_violations(headers, 1, "2", ledger.POLICY).select("rule", "subject")
