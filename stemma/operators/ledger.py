"""Append-only review and promotion ledgers: evidence, freshness, lineage, eligibility and derived status.

``alignments`` are (alignment_id, claim JSON, members array<struct<language, witness_id, source_unit_ids>>), ``units``
(language, unit_id, view JSON), ``reviews`` rows of REVIEW and ``promotions`` rows of PROMOTION, both with ``pos``, the
order in which they were appended, and ``record``, the JSON as stored, which is what digests bind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blank, is_digest, json_digest, json_without, offset_aware
from .constraints import duplicates, rules, together, violation

ASSESSMENTS = ("source_units", "relation_type", "variant_notes", "editorial_handling")
ANSWERS, DECISIONS = ("agree", "revise", "uncertain"), ("accepted", "rejected", "needs_work")
# Fixed values of the ledgers: versions and policy.
REVIEW_VERSION, PROMOTION_VERSION, POLICY = 2, 1, "human-review-promotion-v1"
_UNIT = "struct<language:string,witness_id:string,source_unit_id:string,digest:string>"
EVIDENCE = f"struct<evidence_version:int,alignment_claim_digest:string,source_units:array<{_UNIT}>>"
REVIEW = (
    "pos long, review_schema_version int, review_id string, case_study_id string, alignment_id string, supersedes_review_id string, "
    "reviewer struct<reviewer_type:string,name:string,reviewer_id:string>, decision string, "
    f"assessments struct<{','.join(a + ':string' for a in ASSESSMENTS)}>, reviewed_at string, evidence {EVIDENCE}, record string"
)
PROMOTION = (
    "pos long, promotion_schema_version int, promotion_id string, case_study_id string, alignment_id string, review_id string, review_digest string, "
    "evidence_digest string, decision string, promoter struct<actor_type:string,name:string,actor_id:string>, promoted_at string, policy_version string"
)


def lineage(entries: DataFrame) -> DataFrame:
    """Adds ``supersedes``: the same reviewer's entry for the same subject before this one."""
    return entries.withColumn("supersedes", F.lag("pos").over(Window.partitionBy("reviewer", "subject").orderBy("pos")))


def active(entries: DataFrame) -> DataFrame:
    """Entries that no other supersedes."""
    linked = lineage(entries)
    gone = linked.filter(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("pos"))
    return linked.join(gone, "pos", "left_anti")


def latest_prior(reviews: DataFrame) -> DataFrame:
    """(reviewer_id, alignment_id, review_id) of each reviewer's last review of an alignment."""
    known = reviews.filter(~blank(F.col("reviewer.reviewer_id")) & ~blank(F.col("review_id")))
    return known.groupBy(F.col("reviewer.reviewer_id").alias("reviewer_id"), "alignment_id").agg(F.max_by("review_id", "pos").alias("review_id"))


def claim(record):
    """An alignment's claim: the record without its state, its members without their units, in canonical form."""
    return json_without(record, F.lit("status,review,existing_reviews"), F.lit("members"), F.lit("units"))


def source_view(unit_id, text_html, source, locator):
    """JSON of what a reviewer is shown of a unit, which digests bind: text, place and distinct addresses."""
    urls = F.array_distinct(F.filter(F.array(source["root_url"], source["html_url"], source["url"]), lambda u: u != ""))
    meta = F.struct(source["project"].alias("project"), source["revision"].alias("revision"), F.coalesce(F.nullif(source["path"], F.lit("")), source["root_path"]).alias("path"), locator["start_ref"].alias("start_ref"), locator["end_ref"].alias("end_ref"), urls.alias("urls"))
    return F.to_json(F.struct(unit_id.alias("source_id"), text_html.alias("text_html"), meta.alias("meta")), {"ignoreNullFields": "false"})


def snapshots(alignments: DataFrame, units: DataFrame) -> DataFrame:
    """(alignment_id, expected evidence, unresolved): digests of the claim and of every unit, members and units in order."""
    spread = alignments.select("alignment_id", F.posexplode("members").alias("i", "m")).select("alignment_id", "i", "m.language", "m.witness_id", F.posexplode("m.source_unit_ids").alias("j", "unit_id"))
    met = spread.join(units.select("language", "unit_id", json_digest(F.col("view")).alias("digest")), ["language", "unit_id"], "left")
    unit = F.struct("i", "j", F.struct("language", "witness_id", F.col("unit_id").alias("source_unit_id"), "digest").alias("u"))
    listed = met.groupBy("alignment_id").agg(F.transform(F.array_sort(F.collect_list(unit)), lambda x: x["u"]).alias("source_units"), F.count_if(F.col("digest").isNull()).alias("lacking"))
    whole = alignments.select("alignment_id", json_digest(F.col("claim")).alias("claim_digest")).join(listed, "alignment_id", "left")
    evidence = F.struct(F.lit(1).alias("evidence_version"), F.col("claim_digest").alias("alignment_claim_digest"), F.coalesce("source_units", F.array().cast(f"array<{_UNIT}>")).alias("source_units"))
    return whole.select("alignment_id", evidence.alias("expected"), (F.coalesce("lacking", F.lit(0)) > 0).alias("unresolved"))


def freshness(reviews: DataFrame, expected: DataFrame) -> DataFrame:
    """``reviews`` with ``fresh`` and ``reasons``; without evidence or without an alignment a review is not fresh, for no reason."""
    met = reviews.join(expected, "alignment_id", "left")
    judged = F.col("expected").isNotNull() & F.col("evidence").isNotNull()
    same = lambda field: F.col(f"evidence.{field}").eqNullSafe(F.col(f"expected.{field}"))
    fresh = judged & ~F.col("unresolved") & same("evidence_version") & same("alignment_claim_digest") & same("source_units")
    changed = F.array_compact(F.array(F.when(~same("alignment_claim_digest"), "alignment_claim_digest_changed"), F.when(~same("source_units"), "source_unit_evidence_changed")))
    none = F.array().cast("array<string>")
    reasons = F.when(~judged | fresh, none).when(F.col("unresolved"), F.array(F.lit("current_source_unit_unresolved"))).when(F.size(changed) > 0, changed).otherwise(F.array(F.lit("evidence_snapshot_changed")))
    return met.withColumns({"fresh": F.coalesce(fresh, F.lit(False)), "reasons": reasons, "known": F.col("expected").isNotNull()}).drop("expected", "unresolved")


def eligible(fresh):
    """Whether a review may carry a promotion."""
    agreed = [F.col(f"assessments.{a}").eqNullSafe(F.lit("agree")) for a in ASSESSMENTS]
    told = fresh & F.col("review_schema_version").eqNullSafe(F.lit(REVIEW_VERSION)) & F.col("decision").eqNullSafe(F.lit("accepted")) & F.col("reviewer.reviewer_type").eqNullSafe(F.lit("human"))
    for one in (*agreed, ~blank(F.col("reviewer.name")), ~blank(F.col("reviewer.reviewer_id"))):
        told = told & one
    return told


def _review_rules(case: str) -> dict:
    units = F.col("evidence.source_units")
    no_evidence = F.col("evidence").isNull()
    differs = lambda c, value: ~F.col(c).eqNullSafe(F.lit(value))
    out = {
        "wrong review_schema_version": differs("review_schema_version", REVIEW_VERSION), "wrong case_study_id": differs("case_study_id", case), "unknown alignment_id": ~F.col("known"),
        "reviewer_type must be human": differs("reviewer.reviewer_type", "human"), "reviewer name is required": blank(F.col("reviewer.name")), "reviewer_id is required": blank(F.col("reviewer.reviewer_id")),
        "invalid decision": F.col("decision").isNull() | ~F.col("decision").isin(*DECISIONS), "reviewed_at must have an offset": ~offset_aware(F.col("reviewed_at")), "evidence is required": no_evidence,
        "evidence_version must be 1": ~no_evidence & differs("evidence.evidence_version", 1), "claim digest is malformed": ~no_evidence & ~is_digest(F.col("evidence.alignment_claim_digest")),
        "source_units must be an array": ~no_evidence & units.isNull(), "unit digest is malformed": F.exists(units, lambda u: ~is_digest(u["digest"])),
        "unit field is required": F.exists(units, lambda u: blank(u["language"]) | blank(u["witness_id"]) | blank(u["source_unit_id"])),
    }
    answers = [F.col(f"assessments.{a}") for a in ASSESSMENTS]
    out |= {f"assessment {a} is invalid": x.isNull() | ~x.isin(*ANSWERS) for a, x in zip(ASSESSMENTS, answers, strict=True)}
    disagreed = F.lit(False)
    for x in answers:
        disagreed = disagreed | ~x.eqNullSafe(F.lit("agree"))
    return out | {"accepted requires all to agree": (F.col("decision") == "accepted") & disagreed}


def review_violations(judged: DataFrame, case: str, require_fresh: bool = False) -> DataFrame:
    """Rules of review records, of ``freshness`` rows; a stale but well-formed review is a violation only on request."""
    broken = _review_rules(case) | ({"stale evidence": ~F.col("fresh")} if require_fresh else {})
    return rules(judged, F.col("review_id"), broken)


def lineage_violations(reviews: DataFrame) -> DataFrame:
    """Repeated ids, and revisions that don't name the same reviewer's latest review of the alignment.

    Only the first record of an id counts; a record without reviewer or alignment has no latest one before it.
    """
    named = reviews.filter(~blank(F.col("review_id"))).withColumns({"reviewer_id": F.coalesce("reviewer.reviewer_id", F.lit("")), "alignment": F.coalesce("alignment_id", F.lit("")), "target": F.nullif(F.col("supersedes_review_id"), F.lit(""))})
    numbered = named.withColumn("copy", F.row_number().over(Window.partitionBy("review_id").orderBy("pos")))
    repeated = violation(numbered, "duplicate review_id", F.col("review_id"), F.col("copy") > 1)
    first = numbered.filter("copy = 1")
    whole = (F.col("reviewer_id") != "") & (F.col("alignment") != "")
    latest = F.lag("review_id").over(Window.partitionBy("reviewer_id", "alignment").orderBy("pos"))
    linked = first.withColumn("latest", F.when(whole, latest))
    targets = first.select(F.col("review_id").alias("target"), F.col("pos").alias("target_pos"), F.col("reviewer_id").alias("target_reviewer"), F.col("alignment").alias("target_alignment"))
    met = linked.join(targets, "target", "left")
    there = F.col("target").isNotNull() & F.coalesce(F.col("target_pos") < F.col("pos"), F.lit(False))
    return repeated.unionByName(rules(met, F.col("review_id"), {
        "supersedes without an earlier review": F.col("latest").isNull() & F.col("target").isNotNull(), "revision must supersede the latest": F.col("latest").isNotNull() & ~F.col("target").eqNullSafe(F.col("latest")),
        "supersedes unknown or later review": F.col("target").isNotNull() & ~there, "superseded review is of another alignment": there & (F.col("target_alignment") != F.col("alignment")),
        "superseded review is of another reviewer": there & (F.col("target_reviewer") != F.col("reviewer_id")),
    }))


def active_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with an id that no review names as superseded."""
    gone = reviews.filter(F.coalesce("supersedes_review_id", F.lit("")) != "").select(F.col("supersedes_review_id").alias("review_id"))
    return reviews.filter(F.coalesce("review_id", F.lit("")) != "").join(gone, "review_id", "left_anti")


def evidence_digest(evidence):
    """Digest of an evidence struct; nulls are kept as they are in the record."""
    return json_digest(F.to_json(evidence, {"ignoreNullFields": "false"}))


def judged_promotions(promotions: DataFrame, judged: DataFrame, case: str) -> DataFrame:
    """``promotions`` with ``errors`` (the rules broken), ``fresh`` and ``is_active`` of the review that each names."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.lit(f"referenced review: {r}")) for r, b in _review_rules(case).items()]))
    alive = active_reviews(judged).select("review_id", F.lit(True).alias("is_active"))
    reviewed = judged.withColumn("review_errors", broken).withColumn("may_carry", eligible(F.lit(True)))
    last = reviewed.groupBy("review_id").agg(F.max_by(F.struct("alignment_id", "record", "evidence", "fresh", "review_errors", "may_carry"), "pos").alias("r"))
    met = promotions.join(last.join(alive.distinct(), "review_id", "left"), "review_id", "left").join(judged.filter("known").select("alignment_id", F.lit(True).alias("known")).distinct(), "alignment_id", "left")
    differs = lambda c, value: ~F.col(c).eqNullSafe(F.lit(value))
    known = F.col("r").isNotNull()
    own = {
        "wrong promotion_schema_version": differs("promotion_schema_version", PROMOTION_VERSION), "unsupported policy_version": differs("policy_version", POLICY), "wrong case_study_id": differs("case_study_id", case),
        "decision must be established": differs("decision", "established"), "promoted_at must have an offset": ~offset_aware(F.col("promoted_at")), "promoter must be human": differs("promoter.actor_type", "human"),
        "promoter name is required": blank(F.col("promoter.name")), "actor_id is required": blank(F.col("promoter.actor_id")), "unknown review_id": ~known,
        "review is of another alignment": known & ~F.col("r.alignment_id").eqNullSafe(F.col("alignment_id")), "review_digest does not bind the review": known & ~F.col("review_digest").eqNullSafe(json_digest(F.col("r.record"))),
        "evidence_digest does not bind the evidence": known & ~F.col("evidence_digest").eqNullSafe(evidence_digest(F.col("r.evidence"))), "review may not carry a promotion": known & ~F.col("r.may_carry"),
    }
    errors = F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), r) for r, b in own.items()]))
    errors = F.concat(errors, F.coalesce("r.review_errors", F.array().cast("array<string>")))
    return met.withColumns({"errors": errors, "fresh": F.coalesce("r.fresh", F.lit(False)), "is_active": F.coalesce("is_active", F.lit(False))}).drop("r", "known")


def promotion_violations(judged: DataFrame) -> DataFrame:
    told = judged.select(F.explode("errors").alias("rule"), F.col("promotion_id").alias("subject"), F.lit(None).cast("string").alias("detail"))
    return told.unionByName(duplicate_promotions(judged))


def duplicate_promotions(promotions: DataFrame) -> DataFrame:
    """Violations of: one promotion for an alignment and review, unique ids."""
    twice = duplicates(promotions, "alignment_id", "review_id").select(F.lit("duplicate promotion").alias("rule"), F.concat_ws("/", "alignment_id", "review_id").alias("subject"), F.col("n").cast("string").alias("detail"))
    same = duplicates(promotions, "promotion_id").select(F.lit("duplicate promotion_id").alias("rule"), F.col("promotion_id").alias("subject"), F.col("n").cast("string").alias("detail"))
    return twice.unionByName(same)


def alignment_status(alignments: DataFrame, judged: DataFrame, promotions: DataFrame, case: str) -> DataFrame:
    """(alignment_id, derived_status and four id arrays in ledger order) of every alignment.

    established (a valid promotion whose review is fresh and active), else promotion_required (a fresh eligible review),
    else review_stale (a valid promotion, or an accepted review gone stale), else model_reviewed.  Invalid records and
    superseded reviews don't count.  ``judged`` are ``freshness`` rows, ``promotions`` ``judged_promotions`` rows.
    """
    valid = F.size(F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), 1) for b in _review_rules(case).values()]))) == 0
    alive = active_reviews(judged).select("review_id", F.lit(True).alias("is_active")).distinct()
    kinds = judged.filter(F.coalesce("review_id", F.lit("")) != "").join(alive, "review_id", "left").withColumn("valid", valid).withColumn("eligible", eligible(F.col("fresh")))
    counts = F.col("is_active") & F.col("valid")
    ordered = lambda keep, name: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", F.col(name).alias("x"))))), lambda s: s["x"])
    reviewed = kinds.groupBy("alignment_id").agg(
        ordered(counts & F.col("eligible"), "review_id").alias("fresh_accepted_review_ids"), ordered(counts & ~F.col("eligible") & (F.col("decision") == "accepted") & ~F.col("fresh"), "review_id").alias("stale_accepted_review_ids"),
        ordered(F.col("is_active").isNull(), "review_id").alias("superseded_review_ids"),
    )
    good = promotions.filter(F.size("errors") == 0)
    promoted = good.groupBy("alignment_id").agg(ordered(F.lit(True), "promotion_id").alias("valid_promotion_ids"), F.bool_or(F.col("fresh") & F.col("is_active")).alias("current"))
    lists = ("fresh_accepted_review_ids", "stale_accepted_review_ids", "superseded_review_ids", "valid_promotion_ids")
    met = alignments.select("alignment_id").join(reviewed, "alignment_id", "left").join(promoted, "alignment_id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})
    some = lambda c: F.size(c) > 0
    status = F.when(F.coalesce("current", F.lit(False)), "established").when(some("fresh_accepted_review_ids"), "promotion_required").when(some("valid_promotion_ids") | some("stale_accepted_review_ids"), "review_stale").otherwise("model_reviewed")
    return met.select("alignment_id", status.alias("derived_status"), *lists)


def header_violations(headers: DataFrame, version: int, case: str, policy: str | None = None) -> DataFrame:
    """Rules of ledger documents (ledger_id, version, case_study_id and policy_version)."""
    broken = {"wrong version": ~F.col("version").eqNullSafe(F.lit(version)), "wrong case_study_id": ~F.col("case_study_id").eqNullSafe(F.lit(case))}
    if policy is not None:
        broken["wrong policy_version"] = ~F.col("policy_version").eqNullSafe(F.lit(policy))
    return rules(headers, F.col("ledger_id"), broken)


def refuse(violations: DataFrame, what: str) -> None:
    """Raises with the first rules broken, if any is; what follows then doesn't happen."""
    told = violations.limit(5).collect()
    if told:
        raise ValueError(f"{what} refused: " + "; ".join(f"{r.subject}: {r.rule}" for r in told))


def record_reviews(ledger: DataFrame, new: DataFrame, expected: DataFrame, case: str) -> DataFrame:
    """The ledger with ``new`` reviews after it; nothing if any is malformed, stale or out of line.  Writing is the caller's step."""
    refuse(together(review_violations(freshness(new, expected), case, require_fresh=True), lineage_violations(ledger.unionByName(new))), "review")
    return ledger.unionByName(new)


def promote(judged: DataFrame, promotions: DataFrame, review_id: str, promoter: dict[str, str], promoted_at: str, case: str) -> DataFrame:
    """A row of PROMOTION for a review that is active, valid, fresh, eligible and not promoted yet; else an error."""
    one = judged.filter(F.col("review_id") == review_id)
    refuse(together(
        violation(one.agg(F.count(F.lit(1)).alias("n")), "unknown review_id", F.lit(review_id), F.col("n") == 0),
        violation(active_reviews(judged).filter(F.col("review_id") == review_id).agg(F.count(F.lit(1)).alias("n")), "review is superseded", F.lit(review_id), F.col("n") == 0),
        review_violations(one, case, require_fresh=True), violation(one, "review may not carry a promotion", F.col("review_id"), ~eligible(F.col("fresh"))),
        violation(promotions.filter(F.col("review_id") == review_id), "already promoted", F.col("review_id"), F.lit(True)),
    ), "promotion")
    name = F.concat(F.lit("promotion:"), F.left(F.sha2(F.concat_ws("\x1f", "alignment_id", "review_id", F.lit(promoted_at)), 256), F.lit(12)))
    actor = F.struct(F.lit("human").alias("actor_type"), F.lit(promoter.get("name")).alias("name"), F.lit(promoter.get("actor_id")).alias("actor_id"))
    at = promotions.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    return one.select(
        F.lit(at).cast("long").alias("pos"), F.lit(PROMOTION_VERSION).alias("promotion_schema_version"), name.alias("promotion_id"), "case_study_id", "alignment_id", "review_id", json_digest(F.col("record")).alias("review_digest"),
        evidence_digest(F.col("evidence")).alias("evidence_digest"), F.lit("established").alias("decision"), actor.alias("promoter"), F.lit(promoted_at).alias("promoted_at"), F.lit(POLICY).alias("policy_version"),
    )


def build_state(alignments: DataFrame, judged: DataFrame, promotions: DataFrame, case: str) -> DataFrame:
    """``alignment_status`` of ledgers without any error; a ledger with one is refused, staleness is none."""
    told = judged_promotions(promotions, judged, case)
    refuse(together(review_violations(judged, case), lineage_violations(judged), promotion_violations(told)), "state")
    return alignment_status(alignments, judged, told, case)


def counters(judged: DataFrame, promotions: DataFrame) -> DataFrame:
    """One row: fresh, stale and accepted reviews, current and historical promotions."""
    reviewed = judged.agg(F.count_if("fresh").alias("fresh"), F.count_if(~F.col("fresh")).alias("stale"), F.count_if(F.col("decision") == "accepted").alias("accepted"))
    now = F.col("fresh") & F.col("is_active")
    return reviewed.join(promotions.agg(F.count_if(now).alias("current"), F.count_if(~now).alias("historical")), F.lit(True))


def derived_status(entries: DataFrame) -> DataFrame:
    """One status for each subject of plain entries: established, promotion_required, review_stale or model_reviewed, in this order."""
    status = (
        F.when(F.max((F.col("is_active") & F.col("promoted")).cast("int")) == 1, "established")
        .when(F.max((F.col("is_active") & F.col("accepted")).cast("int")) == 1, "promotion_required")
        .when(F.max((F.col("promoted") | F.col("accepted")).cast("int")) == 1, "review_stale").otherwise("model_reviewed")
    )
    return entries.groupBy("subject").agg(status.alias("status"))
