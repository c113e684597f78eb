"""Alignment candidates within given pairs: formulas, nearest position, lexicon windows, top-k, evaluation.

Machine output is a candidate and never more: every row says ``machine_candidate`` and ``not_established``.
A lexicon is a short list of entries {id, left: forms, right: forms, weight} and becomes one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import collapse, first_matching, squeeze, stable_id


def centers(units: DataFrame, *key: str) -> DataFrame:
    """Adds ``size`` and ``center``: (characters before + half of its own) / all, a length being 1 at least."""
    order = Window.partitionBy(*key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    sized = units.withColumn("size", F.greatest(F.char_length("text"), F.lit(1)))
    return sized.withColumn("center", (F.sum("size").over(order) - F.col("size") / 2) / F.sum("size").over(Window.partitionBy(*key)))


def nearest(units: DataFrame, blocks: DataFrame, pair: list[str]) -> DataFrame:
    """For each unit (pair, unit_id, center) the block (pair, block_id, center, ordinal) of the nearest centre, the first of equals.

    Both sides are sorted together once; the candidates are the last block before a unit and the first one after it,
    so no unit meets all blocks of its pair.
    """
    block = F.struct(F.col("center").alias("center"), "block_id", F.col("ordinal").alias("ordinal"), F.col("size").alias("size"))
    left = units.select(*pair, "unit_id", "center", F.col("size").alias("unit_size"), F.lit(None).cast("struct<center:double,block_id:string,ordinal:int,size:int>").alias("block"))
    right = blocks.select(*pair, F.lit(None).cast("string").alias("unit_id"), "center", F.lit(None).cast("int").alias("unit_size"), block.cast("struct<center:double,block_id:string,ordinal:int,size:int>").alias("block"))
    order = Window.partitionBy(*pair).orderBy("center", F.col("block.ordinal").asc_nulls_last())
    both = left.unionByName(right).withColumns({
        "before": F.last("block", True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.first("block", True).over(order.rowsBetween(0, Window.unboundedFollowing)),
    }).filter("unit_id IS NOT NULL")
    delta = lambda side: F.abs(F.col(side)["center"] - F.col("center"))
    chosen = F.when(F.col("after").isNull() | (delta("before") <= delta("after")), F.col("before")).otherwise(F.col("after"))
    return both.withColumn("chosen", chosen).filter("chosen IS NOT NULL").select(*pair, "unit_id", F.col("chosen.block_id").alias("block_id"), F.col("center").alias("unit_center"), F.col("chosen.center").alias("block_center"), "unit_size", F.col("chosen.size").alias("block_size"))


def _candidate(name: str, kind: str, relation: str, scope: str) -> list[Column]:
    told = {"status": "machine_candidate", "assertion": "not_established", "relation_type": relation, "scope": scope, "method": name, "method_kind": kind, "review_status": "unreviewed"}
    return [F.lit(v).alias(k) for k, v in told.items()]


def monotonic_candidates(units: DataFrame, blocks: DataFrame, work: str = "work_id", witness: str = "witness_id") -> DataFrame:
    """One candidate for each unit: the block nearest in relative position, scored by position and relative length."""
    pair = [work, witness]
    totals = lambda df, name: df.groupBy(*pair).agg(F.sum("size").alias(name))
    u, b = centers(units, *pair), centers(blocks, *pair)
    met = nearest(u, b, pair).join(totals(u, "all_units"), pair).join(totals(b, "all_blocks"), pair)
    delta = F.abs(F.col("unit_center") - F.col("block_center"))
    p, c = F.col("unit_size") / F.col("all_units"), F.col("block_size") / F.col("all_blocks")
    ratio = F.least(p, c) / F.greatest(p, c)
    score = 0.8 * F.greatest(F.lit(0.0), 1 - delta) + 0.2 * ratio
    return met.select(
        stable_id("cand", F.col(work), F.col(witness), F.lit("monotonic_position_v1"), F.col("unit_id"), F.col("block_id")).alias("alignment_id"), *pair, "unit_id", F.array("block_id").alias("block_ids"),
        F.round(score, 6).alias("score"), F.round(delta, 6).alias("position_delta"), F.round(ratio, 6).alias("length_similarity"), *_candidate("monotonic_position_v1", "structural_ranking", "possible_parallel_passage", "source_unit"),
    )


def formula_candidates(units: DataFrame, blocks: DataFrame, left: str, right: list[str], work: str = "work_id", witness: str = "witness_id") -> DataFrame:
    """Units with the one formula, case aside, and blocks of the same pair with any of the others; both are filtered before they meet."""
    pair = [work, witness]
    opened = units.filter(F.contains(F.lower("text"), F.lit(left))).select(*pair, "unit_id")
    met = opened.join(blocks.select(*pair, "block_id", first_matching(F.col("text"), right).alias("formula")).filter("formula IS NOT NULL"), pair)
    return met.select(
        stable_id("cand", F.col(work), F.col(witness), F.lit("shared_formula_v1"), F.col("unit_id"), F.col("block_id")).alias("alignment_id"), *pair, "unit_id", F.array("block_id").alias("block_ids"),
        F.lit(1.0).alias("score"), "formula", *_candidate("shared_formula_v1", "lexical_rule", "shared_formula", "formula_within_source_units"),
    )


def lexicon_hits(text: Column, lexicon: list[dict], side: str, normal: bool = False) -> Column:
    """array<struct<id, form, weight>> of the entries of which a form is in the text, by the first such form, in the lexicon's order.

    ``left`` compares lower-cased words with single spaces between them, ``right`` all characters without white space;
    a ``normal`` text is in that form already.
    """
    form_of = (lambda t: t) if normal else (lambda t: collapse(F.lower(t))) if side == "left" else squeeze
    python = (lambda t: " ".join(t.lower().split())) if side == "left" else (lambda t: "".join(t.split()))
    told_of: list = []
    for entry in lexicon:
        forms = entry.get(side, [])
        if forms:
            told_of.append(lambda told, entry=entry, forms=forms: F.struct(F.lit(entry["id"]).alias("id"), F.coalesce(*[F.when(F.contains(told, F.lit(python(f))), f) for f in forms]).alias("form"), F.lit(float(entry.get("weight", 1.0))).alias("weight")))
    if not told_of:
        return F.array().cast("array<struct<id:string,form:string,weight:double>>")
    # bound to a name, as each mention of the normal form would make it anew
    every = F.transform(F.array(form_of(text)), lambda told: F.array(*[x(told) for x in told_of]))[0]
    return F.filter(every, lambda x: x["form"] != "")


def windows(blocks: DataFrame, key: str | list[str], widest: int, between: str = " ") -> DataFrame:
    """All runs of 1 to ``widest`` consecutive blocks: ordinal of the first, width, joined text; with ids and centres if there are."""
    key = [key] if isinstance(key, str) else key
    frame = Window.partitionBy(*key).orderBy("ordinal").rowsBetween(0, widest - 1)
    extra = [c for c in ("block_id", "center") if c in blocks.columns]
    held = blocks.withColumn("run", F.collect_list(F.struct("text", *extra)).over(frame))
    spread = held.withColumn("width", F.explode(F.sequence(F.lit(1), F.size("run")))).withColumn("run", F.slice("run", F.lit(1), F.col("width")))
    out = [F.array_join(F.col("run.text"), between).alias("window_text")]
    if "block_id" in extra:
        out.append(F.col("run.block_id").alias("block_ids"))
    if "center" in extra:
        out.append(((F.col("run")[0]["center"] + F.element_at("run", -1)["center"]) / 2).alias("window_center"))
    return spread.select(*key, "ordinal", "width", *out)


def top_k(scored: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def anchor_windows(units: DataFrame, blocks: DataFrame, lexicon: list[dict], k: int = 3, widest: int = 3, work: str = "work_id", witness: str = "witness_id") -> DataFrame:
    """The k best windows of blocks for each unit of a pair, by shared lexicon entries and position.

    Forms are looked for in the joined text of a window, so that they are found across the ends of blocks; a block loses
    its white space once, not in each window that holds it, and texts stay behind before units and windows meet.
    ``ordinal`` is a block's place among all blocks of its pair.
    """
    pair = [work, witness]
    known = centers(units, *pair).select(*pair, "unit_id", "center", lexicon_hits(F.col("text"), lexicon, "left").alias("left"))
    hits = lexicon_hits(F.col("window_text"), lexicon, "right", normal=True)
    made = windows(centers(blocks, *pair).withColumn("text", squeeze("text")), pair, widest, "").select(*pair, "ordinal", "width", "block_ids", "window_center", F.transform(hits, lambda y: y["id"]).alias("right"))
    shared = F.filter("left", lambda x: F.array_contains("right", x["id"]))
    met = known.join(made, pair).select(*pair, "unit_id", "ordinal", "width", "block_ids", shared.alias("anchors"), F.abs(F.col("center") - F.col("window_center")).alias("delta"))
    weight = F.aggregate("anchors", F.lit(0.0), lambda total, x: total + x["weight"])
    met = met.withColumn("weight", weight).withColumn("score", 0.72 * (1 - F.exp(-F.col("weight") / 5)) + 0.28 * F.greatest(F.lit(0.0), 1 - F.col("delta")))
    best = top_k(met, [*pair, "unit_id"], [F.desc("score"), F.round("delta", 6), "width", "ordinal"], k)
    parts = F.concat_ws("\x1f", F.col(work), F.col(witness), F.lit("lexicon_anchor_window_v1"), F.col("unit_id"), F.array_join("block_ids", "\x1f"))
    return best.select(
        F.concat(F.lit("cand:"), F.left(F.sha2(parts, 256), F.lit(20))).alias("alignment_id"), *pair, "unit_id", "block_ids", "rank", "width", F.round("score", 6).alias("score"), F.round("weight", 6).alias("lexical_weight"),
        F.round("delta", 6).alias("position_delta"), F.transform("anchors", lambda x: x["id"]).alias("anchors"), *_candidate("lexicon_anchor_window_v1", "lexical_rule", "possible_parallel_passage", "candidate_window"),
    )


def first_ranks(candidates: DataFrame, gold: DataFrame, work: str = "work_id", witness: str = "witness_id") -> DataFrame:
    """For each gold case (work, witness, unit_ids, block_ids, decision 'accepted') and unit the first rank that overlaps and that covers it."""
    pair = [work, witness]
    cases = gold.filter("decision = 'accepted'").select("gold_id", *pair, F.explode("unit_ids").alias("unit_id"), F.array_distinct("block_ids").alias("gold"))
    met = cases.join(candidates.select(*pair, "unit_id", "rank", "block_ids"), [*pair, "unit_id"], "left")
    overlap = F.min(F.when(F.arrays_overlap("gold", "block_ids"), F.col("rank")))
    cover = F.min(F.when(F.col("block_ids").isNotNull() & (F.size(F.array_except("gold", "block_ids")) == 0), F.col("rank")))
    return met.groupBy("gold_id", *pair, "unit_id").agg(overlap.alias("overlap_rank"), cover.alias("cover_rank"))


def retrieval_metrics(ranks: DataFrame, k: int = 3) -> DataFrame:
    """overlap@k, full cover@k and MRR over all cases, a miss counting as 0; null without cases."""
    cases = F.nullif(F.count(F.lit(1)), F.lit(0))
    share = lambda x: F.round(x / cases, 6)
    return ranks.agg(
        F.count(F.lit(1)).alias("cases"), share(F.count_if(F.col("overlap_rank") <= k)).alias("overlap_at_k"), share(F.count_if(F.col("cover_rank") <= k)).alias("full_cover_at_k"),
        share(F.sum(F.coalesce(1 / F.col("overlap_rank"), F.lit(0.0)))).alias("mrr"),
    )
