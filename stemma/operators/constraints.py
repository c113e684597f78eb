"""Integrity rules as queries that return violations (rule, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blank

# Relation classes, languages and confidences that a crosswalk may use; editorial features.
RELATIONS = ("anchor", "full_textual_parallel", "partial_textual_parallel", "fragmentary_textual_parallel", "shared_passage", "doctrinal_parallel")
LANGUAGES = ("pli", "lzh", "san", "bhs", "pra", "gdh", "bo", "other")
CONFIDENCES = ("high", "medium", "low", "unknown")
FEATURES = ("supplied", "gap", "unclear")
STATUSES = ("machine_candidate", "reviewed", "established", "rejected")


def violation(df: DataFrame, rule: str, subject, broken: Column, detail=None) -> DataFrame:
    told = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.filter(F.coalesce(broken, F.lit(False))).select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), told.alias("detail"))


def rules(df: DataFrame, subject, broken: dict[str, Column]) -> DataFrame:
    """One pass over ``df``: a violation for each rule that a row breaks."""
    told = F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), rule) for rule, b in broken.items()]))
    return df.select(F.explode(told).alias("rule"), subject.cast("string").alias("subject"), F.lit(None).cast("string").alias("detail"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_references(df: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    return df.join(target.select(F.col(target_column).alias(column)), column, "left_anti")


def outside_enum(df: DataFrame, column: str, allowed) -> DataFrame:
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def wrong_owners(members: DataFrame, owners: DataFrame) -> DataFrame:
    """``members`` (unit_id, claimed, ...) whose unit exists and belongs to another witness, with that ``owner``."""
    met = members.join(owners.select("unit_id", "owner"), "unit_id")
    return met.filter(~F.col("claimed").eqNullSafe(F.col("owner")))


def witness_violations(witnesses: DataFrame, languages=LANGUAGES, required=("work_id", "canonical_id", "source_path")) -> DataFrame:
    """Repeated ids, languages outside the list, required fields that are null or empty."""
    repeated = duplicates(witnesses, "witness_id").select(F.lit("duplicate witness_id").alias("rule"), F.col("witness_id").cast("string").alias("subject"), F.col("n").cast("string").alias("detail"))
    per_row = {"unsupported language": F.col("language").isNull() | ~F.col("language").isin(*languages)}
    per_row |= {f"missing {c}": F.col(c).isNull() | (F.col(c).cast("string") == "") for c in required}
    return repeated.unionByName(rules(witnesses, F.col("witness_id"), per_row))


def segment_violations(segments: DataFrame, config: DataFrame) -> DataFrame:
    """Repeated ids and wrong counts for each container, segments without a line span or text or number.

    ``segments`` has container_id, canonical_id, record_kind, start_line, end_line, text_chars; ``config`` container_id and
    expected_segments, expected_canonical, expected_supplements, of which nulls expect nothing, but no supplements.
    """
    counts = segments.groupBy("container_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("canonical_id").alias("ids"), F.count("canonical_id").alias("named"),
        F.count_if(F.col("record_kind") == "canonical").alias("canonical"), F.count_if(F.col("record_kind") == "supplement").alias("supplements"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "ids", "named", "canonical", "supplements")}
    met = config.join(counts, "container_id", "left").withColumns(zero)
    per_container = {
        "duplicate canonical ids": F.col("ids") < F.col("named"), "wrong number of segments": F.col("n") != F.col("expected_segments"),
        "wrong number of canonical segments": F.col("canonical") != F.coalesce("expected_canonical", "expected_segments"), "wrong number of supplements": F.col("supplements") != F.coalesce("expected_supplements", F.lit(0)),
    }
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    per_segment = {"no number": F.col("canonical_id").isNull(), "missing line span": missing("start_line") | missing("end_line"), "empty text": F.coalesce("text_chars", F.lit(0)) <= 0}
    return rules(met, F.col("container_id"), per_container).unionByName(rules(segments, F.coalesce("canonical_id", "container_id"), per_segment))


def candidate_violations(rows: DataFrame, left: DataFrame, right: DataFrame, left_formula: str, right_formulas: list[str]) -> DataFrame:
    """Rules of pairwise alignments.

    ``rows``: alignment_id, left_ids, right_ids, status, assertion, relation_type, method_kind and
    review struct<status, reviewer_type, reviewer, decision>; ``left`` and ``right``: (unit_id, text).
    """
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    established = F.col("status") == "established"
    per_row = {f"{side}_ids must be a non-empty list": F.size(listed(f"{side}_ids")) == 0 for side in ("left", "right")}
    per_row |= {f"duplicate {side} unit": F.size(F.array_distinct(listed(f"{side}_ids"))) < F.size(listed(f"{side}_ids")) for side in ("left", "right")}
    per_row |= {
        "invalid status": F.col("status").isNull() | ~F.col("status").isin(*STATUSES), "established lacks reviewed status": established & ~F.col("review.status").eqNullSafe(F.lit("reviewed")),
        "established requires human reviewer": established & ~F.col("review.reviewer_type").eqNullSafe(F.lit("human")), "established requires accepted decision": established & ~F.col("review.decision").eqNullSafe(F.lit("accepted")),
        "established requires reviewer identity": established & (F.coalesce("review.reviewer", F.lit("")) == ""), "machine candidate must say not_established": (F.col("status") == "machine_candidate") & ~F.col("assertion").eqNullSafe(F.lit("not_established")),
        "structural ranking cannot be established": established & (F.col("method_kind") == "structural_ranking"),
    }
    parts = [rules(rows, F.col("alignment_id"), per_row)]
    shown = {"left": F.contains(F.lower("text"), F.lit(left_formula)), "right": reduce(Column.__or__, [F.contains("text", F.lit(f)) for f in right_formulas])}
    for side, units in (("left", left), ("right", right)):
        named = rows.select("alignment_id", "relation_type", F.explode(listed(f"{side}_ids")).alias("unit_id"))
        met = named.join(units.select("unit_id", shown[side].alias("shown"), F.lit(True).alias("there")), "unit_id", "left")
        parts.append(violation(met, f"unresolved {side} unit", F.col("alignment_id"), F.col("there").isNull(), F.col("unit_id")))
        evidence = met.filter("there AND relation_type = 'shared_formula'").groupBy("alignment_id").agg(F.bool_or("shown").alias("shown"))
        parts.append(violation(evidence, f"{side} formula evidence absent", F.col("alignment_id"), ~F.col("shown")))
    return together(*parts)


def multiwitness_violations(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Rules of alignments of several witnesses.

    ``rows``: alignment_id, status, relation_member_ids, review struct<status, reviewer_type, decision>,
    members array<struct<member_id, language, witness_id, coverage, source_unit_ids, editorial_features>>,
    variants array<struct<type, member_ids>>; ``units``: language, unit_id, owner, features array, text.
    A row of fewer than two members is told so and nothing else.
    """
    few = F.size(F.coalesce("members", F.array().cast(rows.schema["members"].dataType))) < 2
    whole = rows.filter(~few)
    ids, lost = F.col("members.member_id"), F.transform(F.filter("members", lambda m: m["coverage"] == "lost_text_marker"), lambda m: m["member_id"])
    related, variants = F.col("relation_member_ids"), F.coalesce("variants", F.array().cast(rows.schema["variants"].dataType))
    told_lost = F.flatten(F.transform(F.filter(variants, lambda v: v["type"] == "textual_loss"), lambda v: v["member_ids"]))
    model = F.col("status") == "model_reviewed"
    differs = lambda c, value: ~F.col(c).eqNullSafe(F.lit(value))
    scoped = F.size(F.coalesce(related, F.array().cast("array<string>"))) >= 2
    per_row = {
        "duplicate member_id": F.size(F.array_distinct(ids)) < F.size(ids), "fewer than two languages": F.size(F.array_distinct("members.language")) < 2, "relation scope must name two members": ~scoped,
        "duplicate relation member": scoped & (F.size(F.array_distinct(related)) < F.size(related)), "relation names unknown member": scoped & (F.size(F.array_except(related, ids)) > 0), "lost member in relation": scoped & (F.size(F.array_intersect(related, lost)) > 0),
        "variant names unknown member": F.size(F.array_except(F.flatten(F.transform(variants, lambda v: v["member_ids"])), ids)) > 0, "lost member without textual_loss variant": F.size(F.array_except(lost, told_lost)) > 0,
        "established must not be stored": F.col("status") == "established", "model_reviewed requires reviewed status": model & differs("review.status", "reviewed"),
        "model_reviewed requires model reviewer": model & differs("review.reviewer_type", "model"), "model_reviewed requires accepted decision": model & differs("review.decision", "accepted"),
    }
    member = whole.select("alignment_id", F.explode("members").alias("m")).select("alignment_id", "m.*")
    subject = F.concat_ws("/", "alignment_id", "member_id")
    known_languages = [r.language for r in units.select("language").distinct().limit(1000).collect()]
    good = member.filter(F.col("language").isin(*known_languages) & (F.size(F.coalesce("source_unit_ids", F.array().cast("array<string>"))) > 0))
    named = good.select("alignment_id", "member_id", "language", "witness_id", F.explode("source_unit_ids").alias("unit_id"))
    met = named.join(units.withColumn("there", F.lit(True)), ["language", "unit_id"], "left")
    of_units = met.groupBy("alignment_id", "member_id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce("features", F.array().cast("array<string>")))))).alias("actual"),
        F.count("there").alias("found"), F.bool_or(F.when(F.col("there"), F.contains(F.lower("text"), F.lit("lost")))).alias("says_lost"),
    )
    judged = good.join(of_units, ["alignment_id", "member_id"], "left")
    declared = F.col("editorial_features")
    marker = F.col("coverage") == "lost_text_marker"
    per_member = {
        "editorial_features must be an array": declared.isNull(), "duplicate editorial_features": F.size(F.array_distinct(declared)) < F.size(declared),
        "unsupported editorial_features": F.size(F.array_except(declared, F.array(*map(F.lit, FEATURES)))) > 0, "editorial_features differ from the source": F.sort_array(F.array_distinct(declared)) != F.col("actual"),
        "lost marker without resolved units": marker & (F.col("found") == 0), "lost marker source does not say lost": marker & (F.col("found") > 0) & ~F.coalesce("says_lost", F.lit(False)),
    }
    return together(
        violation(rows, "fewer than two members", F.col("alignment_id"), few), rules(whole, F.col("alignment_id"), per_row),
        violation(member, "unsupported language", subject, F.col("language").isNull() | ~F.col("language").isin(*known_languages), F.col("language")),
        violation(member, "source_unit_ids must be non-empty", subject, F.col("language").isin(*known_languages) & (F.size(F.coalesce("source_unit_ids", F.array().cast("array<string>"))) == 0)),
        violation(met, "unresolved source unit", subject, F.col("there").isNull(), F.col("unit_id")),
        violation(met, "unit belongs to another witness", subject, F.col("there") & ~F.col("witness_id").eqNullSafe(F.col("owner")), F.col("unit_id")),
        rules(judged, subject, per_member),
    )


def crosswalk_violations(crosswalks: DataFrame, edges: DataFrame, entries: DataFrame, expected: int, least: dict[str, int], needs_container: list[str]) -> DataFrame:
    """Rules of a curated crosswalk.

    ``crosswalks``: id, rank, anchor_id, cited array; ``edges``: id, list_name, language, relation_class, confidence,
    canonical_id, container_id, evidence_basis, cited array, the anchor with list_name 'anchor'; ``entries``: entry_id.
    ``least``: relation classes with their least number of edges in all.
    """
    whole = crosswalks.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("anchor_id").alias("anchors"), F.sort_array(F.collect_list("rank")).alias("ranks"))
    per_set = {
        "wrong number of records": F.col("n") != expected, "duplicate crosswalk id": F.col("ids") < F.col("n"), "duplicate anchor": F.col("anchors") < F.col("n"),
        "ranks must count from 1": F.col("ranks") != F.sequence(F.lit(1), F.lit(expected)).cast(whole.schema["ranks"].dataType),
    }
    of = lambda name: F.col("list_name") == name
    differs = lambda c, value: ~F.col(c).eqNullSafe(F.lit(value))
    confidence = F.coalesce("confidence", F.when(F.col("relation_class") == "anchor", "high"))
    unlisted = lambda c, allowed: F.col(c).isNull() | ~F.col(c).isin(*allowed)
    per_edge = {
        "anchor has the wrong language": of("anchor") & differs("language", "pli"), "anchor has the wrong relation": of("anchor") & differs("relation_class", "anchor"),
        "full parallel has the wrong language": of("chinese") & differs("language", "lzh"), "full parallel has the wrong relation": of("chinese") & differs("relation_class", "full_textual_parallel"),
        "collection id without container": of("chinese") & F.split_part("canonical_id", F.lit(" "), F.lit(1)).isin(*needs_container) & F.contains("canonical_id", F.lit(" ")) & (F.coalesce("container_id", F.lit("")) == ""),
        "unsupported language": unlisted("language", LANGUAGES), "unsupported relation": unlisted("relation_class", RELATIONS), "exact_parallel is forbidden": F.col("relation_class") == "exact_parallel",
        "invalid confidence": differs("relation_class", "anchor") & (confidence.isNull() | ~confidence.isin(*CONFIDENCES)), "bhs requires evidence": (F.col("language") == "bhs") & (F.coalesce("evidence_basis", F.lit("")) == ""),
    }
    lists = crosswalks.select("id").join(edges.groupBy("id").agg(F.count_if(of("chinese")).alias("full"), F.count_if(F.col("list_name").isin("sanskrit_bhs", "gandhari_prakrit")).alias("indic")), "id", "left")
    per_list = {"no full parallel": F.coalesce("full", F.lit(0)) == 0, "no other Indic witness": F.coalesce("indic", F.lit(0)) == 0}
    cited = crosswalks.select("id", F.explode("cited").alias("entry_id")).unionByName(edges.select("id", F.explode("cited").alias("entry_id")))
    loose = cited.join(entries, "entry_id", "left_anti")
    return together(
        rules(whole, F.lit("crosswalk"), per_set), rules(edges, F.col("id"), per_edge), rules(lists, F.col("id"), per_list),
        violation(loose, "unresolved bibliography id", F.col("id"), F.lit(True), F.col("entry_id")), too_few(edges, "relation_class", least),
    )


def too_few(df: DataFrame, column: str, least: dict[str, int]) -> DataFrame:
    """Classes with fewer rows than they must have, those without any too."""
    counted = df.groupBy().agg(*[F.count_if(F.col(column) == name).alias(name) for name in least])
    return together(*[violation(counted, "too few of a class", F.lit(name), F.col(f"`{name}`") < n, F.col(f"`{name}`")) for name, n in least.items()])


def positional_difference(base: DataFrame, current: DataFrame) -> DataFrame:
    """Positions at which ``current`` (pos, body) lacks or changes an entry of ``base``, null bodies included."""
    both = base.alias("b").join(current.withColumn("there", F.lit(True)).alias("c"), "pos", "left")
    rule = F.when(F.col("c.there").isNull(), "deleted").when(~F.col("b.body").eqNullSafe(F.col("c.body")), "rewritten")
    return both.select("pos", rule.alias("rule")).filter("rule IS NOT NULL")


def ledger_violations(base: DataFrame, current: DataFrame) -> DataFrame:
    """An append-only ledger (pos, id, body) against an earlier state: shorter, rewritten or deleted entries, repeated ids."""
    sizes = base.agg(F.count(F.lit(1)).alias("was")).join(current.agg(F.count(F.lit(1)).alias("now")), F.lit(True))
    changed = positional_difference(base, current).select("rule", F.col("pos").cast("string").alias("subject"), F.lit(None).cast("string").alias("detail"))
    repeated = duplicates(current, "id").select(F.lit("duplicate id").alias("rule"), F.col("id").cast("string").alias("subject"), F.col("n").cast("string").alias("detail"))
    return together(violation(sizes, "shorter than before", F.lit("ledger"), F.col("now") < F.col("was"), F.col("now")), changed, repeated)


def view_drift(rendered: DataFrame, committed: DataFrame) -> DataFrame:
    """Line numbers at which a generated view (line_no, line) and the committed one differ, or only one has a line."""
    met = rendered.select("line_no", F.col("line").alias("new")).join(committed.select("line_no", F.col("line").alias("old")), "line_no", "full")
    return met.filter(~F.col("new").eqNullSafe(F.col("old")))


def missing_numbers(df: DataFrame, column: str, *key: str) -> DataFrame:
    """Numbers between the least and the largest (of each key) that do not occur: gaps of the sorted numbers, exploded.

    Without a key the numbers are cut into ranges first, so that no task sorts them all; a gap across ranges is found
    from the ranges' ends.
    """
    from pyspark.sql import Window

    value = F.col(column).cast("long")
    distinct = df.filter(value.isNotNull()).select(*key, value.alias("number")).distinct()
    distinct = distinct.withColumn("range", F.floor(F.col("number") / 100_000))
    inside = distinct.withColumn("next", F.lead("number").over(Window.partitionBy(*key, "range").orderBy("number")))
    ends = distinct.groupBy(*key, "range").agg(F.min("number").alias("first"))
    ends = ends.withColumn("after", F.lead("first").over(Window.partitionBy(*(key or [F.lit(0)])).orderBy("range")))
    met = inside.join(ends.select(*key, "range", "after"), [*key, "range"]).withColumn("next", F.coalesce("next", "after"))
    return met.filter("next > number + 1").select(*key, F.explode(F.sequence(F.col("number") + 1, F.col("next") - 1)).alias("missing"))


def parse_id(identifier, prefixes: list[str]) -> Column:
    """struct<prefix, body, low, high> of a collection id; null prefix for other ids, null ends unless the body is a range."""
    alternatives = "|".join(sorted(prefixes, key=len, reverse=True))
    prefix, body = F.regexp_extract(identifier, rf"^({alternatives})\s+(.+)$", 1), F.regexp_extract(identifier, rf"^({alternatives})\s+(.+)$", 2)
    end = lambda i: F.nullif(F.regexp_extract(body, r"^(\d+)[–-](\d+)$", i), F.lit("")).cast("long")
    return F.struct(F.nullif(prefix, F.lit("")).alias("prefix"), F.nullif(body, F.lit("")).alias("body"), end(1).alias("low"), end(2).alias("high"))


def resolve_ids(references: DataFrame, segments: DataFrame, prefixes: list[str]) -> DataFrame:
    """(ref_id, identifier, status, wanted, found, segments, missing) of references to a collection.

    An id that is a segment's stands for it; else a range ``prefix a-b``, with either dash, stands for its numbers; any
    other id of the collection and a reversed range are unresolved.  Other identifiers are left out.  All wanted ids
    meet the segments in one equi-join.
    """
    told = references.withColumn("p", parse_id(F.col("identifier"), prefixes)).filter("p.prefix IS NOT NULL")
    there = segments.select(F.col("canonical_id").alias("wanted_id")).distinct().withColumn("there", F.lit(True))
    exact = told.join(there.select(F.col("wanted_id").alias("identifier"), "there"), "identifier", "left")
    ranged = F.transform(F.sequence("p.low", "p.high"), lambda n: F.concat("p.prefix", F.lit(" "), n.cast("string")))
    wanted = F.when(F.col("there"), F.array("identifier")).when(F.col("p.high") >= F.col("p.low"), ranged).otherwise(F.array("identifier"))
    spread = exact.select("ref_id", "identifier", F.posexplode(wanted).alias("at", "wanted_id"))
    met = spread.join(there, "wanted_id", "left")
    listed = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("at", "wanted_id")))), lambda x: x["wanted_id"])
    grouped = met.groupBy("ref_id", "identifier").agg(F.count(F.lit(1)).alias("wanted"), F.count("there").alias("found"), listed(F.col("there").isNotNull()).alias("segments"), listed(F.col("there").isNull()).alias("missing"))
    status = F.when(F.col("found") == 0, "unresolved").when(F.col("found") == F.col("wanted"), "resolved").otherwise("partially_resolved")
    return grouped.withColumn("status", status)


def resolution_summary(resolved: DataFrame) -> DataFrame:
    some = F.col("status") != "unresolved"
    return resolved.agg(
        F.count(F.lit(1)).alias("collection_witnesses"), F.count_if(some).alias("resolved_witnesses"),
        F.coalesce(F.sum(F.when(some, F.col("found"))), F.lit(0)).alias("resolved_segments"), F.count_if(~some).alias("unresolved_witnesses"),
    )


def used_by(resolved: DataFrame) -> DataFrame:
    """(canonical_id, used_by) of every resolved segment: the references to it, in order."""
    return resolved.select("ref_id", F.explode("segments").alias("canonical_id")).groupBy("canonical_id").agg(F.array_sort(F.collect_list("ref_id")).alias("used_by"))


def resolve_ranges(references: DataFrame, segments: DataFrame) -> DataFrame:
    """(ref_id, low, high) against (number): how many of the range there are, and a status.

    Ranges become rows by ``sequence`` and meet the segments in one equi-join; reversed ranges are unresolved.
    """
    wide = references.filter("high >= low").select("ref_id", F.explode(F.sequence("low", "high")).alias("number"))
    met = wide.join(segments.select("number").distinct().withColumn("there", F.lit(1)), "number", "left")
    counted = met.groupBy("ref_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("there").alias("found"))
    status = F.when(F.coalesce("found", F.lit(0)) == 0, "unresolved").when(F.col("found") == F.col("wanted"), "resolved").otherwise("partially_resolved")
    joined = references.select("ref_id").join(counted, "ref_id", "left")
    return joined.select("ref_id", F.coalesce("wanted", F.lit(0)).alias("wanted"), F.coalesce("found", F.lit(0)).alias("found"), status.alias("status"))


def key_differences(left: DataFrame, right: DataFrame, work: str = "work", first: int = 5) -> DataFrame:
    """Of two ordered lists (work, ordinal, key): works whose keys or order differ, with the first keys that either lacks."""
    met = left.select(work, "key", F.col("ordinal").alias("a")).join(right.select(work, "key", F.col("ordinal").alias("b")), [work, "key"], "full")
    some = lambda gone, order: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col(gone).isNull(), F.struct(F.col(order).alias("o"), "key")))), lambda x: x["key"]), 1, first)
    grouped = met.groupBy(work).agg(
        F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"), some("b", "a").alias("missing_right"), some("a", "b").alias("missing_left"),
        F.transform(F.array_sort(F.collect_list(F.struct("a", "key"))), lambda x: x["key"]).alias("in_a"), F.transform(F.array_sort(F.collect_list(F.struct("b", "key"))), lambda x: x["key"]).alias("in_b"),
    )
    differ = (F.col("only_left") > 0) | (F.col("only_right") > 0) | (F.col("in_a") != F.col("in_b"))
    return grouped.filter(differ).select(work, "only_left", "only_right", "missing_right", "missing_left")


def blank_fields(df: DataFrame, subject: str, *columns: str) -> DataFrame:
    return rules(df, F.col(subject), {f"{c} is required": blank(F.col(c)) for c in columns})
