"""Operators on small tables whose results are known by hand."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from stemma import functions as T
from stemma import sources
from stemma.operators import align, catalog, constraints, ledger, markup, render, units


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_paragraph_machine(spark):
    rows = [("w", i + 1, k) for i, k in enumerate(["block", "open", "block", "close", "block", "open", "open", "heading", "close"])]
    got = units.leaf_states(spark.createDataFrame(rows, "work string, ordinal int, kind string")).orderBy("ordinal").collect()
    assert [r.unit_no for r in got] == [1, 2, 2, 2, 3, 4, 5, 6, 7]
    assert [r.error for r in got] == [None] * 6 + ["open while open", "heading while open", "close while closed"]


def test_ranges(spark):
    refs = spark.createDataFrame([("a", 1, 3), ("b", 2, 2), ("c", 5, 4), ("d", 8, 9)], "ref_id string, low long, high long")
    there = spark.createDataFrame([(1,), (2,), (2,)], "number long")
    got = {r.ref_id: (r.wanted, r.found, r.status) for r in constraints.resolve_ranges(refs, there).collect()}
    assert got == {"a": (3, 2, "partially_resolved"), "b": (1, 1, "resolved"), "c": (0, 0, "unresolved"), "d": (2, 0, "unresolved")}


def test_superseded_entries_are_not_active(spark):
    rows = [(1, "x", "s"), (2, "y", "s"), (3, "x", "s"), (4, "x", "t")]
    got = ledger.active(spark.createDataFrame(rows, "pos long, reviewer string, subject string")).collect()
    assert sorted(r.pos for r in got) == [2, 3, 4]


def test_text_functions(spark):
    lit = F.lit
    r = one(
        spark, T.padded("p", lit(12345)).alias("wide"), T.padded("p", lit(7)).alias("narrow"), T.collapse(lit(" a　\x85b\x1c c ")).alias("space"), T.slug(lit("--Ab c!")).alias("slug"), T.slug(lit("?!")).alias("none"),
        (T.stable_id("x", lit("a"), lit(None).cast("string")) == T.stable_id("x", lit("a"))).alias("null_part"), T.leading_int(lit("  12 ab")).alias("int"), T.leading_int(lit("ab 1")).alias("no_int"), T.after_number(lit(" 12 ")).alias("rest"),
        T.clean_markup(lit("<b>a &amp; b</b>  &#x41;")).alias("clean"), T.bracketed(lit("x <supplied>y\nz</supplied><gap/>")).alias("shown"), T.supplied_spans(lit("a <i>&lt;</i> <supplied>b</supplied> c")).alias("spans"),
        T.canonical_json(lit('{"b": 1.0, "a": [null, "é"]}')).alias("json"), T.script_safe(lit('"</b>"')).alias("script"), T.offset_aware(lit("2024-01-01T00:00:00")).alias("naive"), T.offset_aware(lit("2024-01-01T00:00:00+02:00")).alias("aware"),
        T.offset_aware(lit(None).cast("string")).alias("no_time"), T.first_matching(lit("cab"), ["b", "a"]).alias("first"),
    )
    assert (r.wide, r.narrow, r.space, r.slug, r.none, r.null_part) == ("p12345", "p0007", "a b c", "ab-c", "item", False)
    assert (r.int, r.no_int, r.rest, r.clean, r.shown) == (12, None, None, "a & b A", "x ⟦y z⟧")
    assert r.spans == 'a &lt; <span class="supplied" title="Editorially supplied in the upstream edition">b</span> c'
    assert (r.json, r.script, r.naive, r.aware, r.no_time, r.first) == ('{"a":[null,"é"],"b":1.0}', '"<\\/b>"', False, True, False, "b")
    with pytest.raises(Exception, match="unsupported work"):
        one(spark, T.work_slug(lit("MN 3"), "DN"))
    assert one(spark, T.work_slug(lit("DN 03"), "DN").alias("s")).s == "dn3"


def test_titles_and_overrides(spark):
    leaves = spark.createDataFrame([("a", 1, "a:1", "<b>first</b>"), ("a", 2, "a:0.1", "  title "), ("b", 1, "b:1", "x" * 200), ("c", 1, "c:0", " ")], "work string, ordinal int, key string, text string")
    works = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "work string, fallback string")
    assert {r.work: r.title for r in catalog.titles(leaves, works).collect()} == {"a": "title", "b": "x" * 160, "c": "C"}
    keyed = spark.createDataFrame([("w1", "k1"), ("w2", "k1"), ("w3", "k3")], "witness_key string, work_key string")
    told = spark.createDataFrame([("w1", "one"), ("k1", "two")], "key string, work_id string")
    assert {r.witness_key: r.work_id for r in catalog.with_overrides(keyed, told).collect()} == {"w1": "one", "w2": "two", "w3": "k3"}
    r = one(spark, T.classify_language(F.lit("san"), F.lit("a Buddhist Hybrid Sanskrit text")).alias("a"), T.classify_language(F.lit("pra"), F.lit("buddhist hybrid sanskrit")).alias("b"), T.classify_language(F.lit("san"), F.lit(""), F.lit("gdh")).alias("c"))
    assert tuple(r) == ("bhs", "pra", "gdh")


LEAVES = [  # template, text
    ("<h1>{}</h1>", "Head"), ("<p>{}", "one"), ("{}", " two "), ("{}</p>", "three"), ("<p>{}</p>", ""), ("{}", "loose"), ("<p>{}", "open"), ("<p>{}", "again"), ("<h2>{}</h2>", "Next"), ("{}</p>", "late"), ("<p>{}", "end"),
]


def test_unit_records_against_a_fold(spark):
    rows = [("w", i, f"w:{i}" if i != 6 else "w:0.6", text, template) for i, (template, text) in enumerate(LEAVES, 1)]
    leaves = units.classified(spark.createDataFrame([*rows, ("v", 1, "v:1", "x", None)], "work string, ordinal int, segment_id string, text string, template string"))
    got = {r.unit_id: (r.text, r.segment_ids) for r in units.unit_records(leaves).collect()}
    assert got == {
        "w#h0001": ("Head", ["w:1"]), "w#p0001": ("one two three", ["w:2", "w:3", "w:4"]), "w#m0001": ("loose", ["w:0.6"]), "w#p0003": ("open", ["w:7"]), "w#p0004": ("again", ["w:8"]),
        "w#h0002": ("Next", ["w:9"]), "w#b0001": ("late", ["w:10"]), "w#p0005": ("end", ["w:11"]), "v#b0001": ("x", ["v:1"]),
    }
    assert "w#p0002" in {r.unit_id for r in units.unit_records(leaves, keep_empty=True).collect()}
    assert sorted((r.work, r.ordinal, r.error) for r in units.unit_errors(leaves).collect() if r.ordinal) == [("w", 8, "open while open"), ("w", 9, "heading while open")]
    assert [r.work for r in units.unit_errors(leaves).filter("error = 'unterminated'").collect()] == ["w"]


XML = """<TEI xmlns="http://www.tei-c.org/ns/1.0" xmlns:cb="http://cb"><text><juan fun="open" n="1"/><cb:div type="pin"><cb:mulu type="品" n="1">7 Chapter</cb:mulu>
<lb ed="T" n="a1"/><cb:div type="other"><cb:mulu type="經" n="99">3 First</cb:mulu><head>H</head><p xml:id="p1">甲<lb ed="T" n="a2"/>
 <app><lem>乙</lem><rdg>x</rdg></app><note>no</note><g ref="#C1"/></p><p> </p><list><item><p>丙</p></item></list><choice><sic>s</sic><corr>丁</corr></choice></cb:div>
<cb:div><cb:mulu type="經" n="12">Untold</cb:mulu>bare<lb ed="R" n="z"/></cb:div></cb:div><lb ed="T" n="b1"/><cb:div><cb:mulu type="經">5 Extra</cb:mulu><lg>戊</lg></cb:div></text></TEI>"""


def test_xml_discourses_and_blocks(spark):
    files = spark.createDataFrame([("d/T01.xml", XML)], "path string, content string")
    config = spark.createDataFrame([("d/T01.xml", "EA", "T01", "chapter.item")], "path string, prefix string, container_id string, id_mode string")
    rows = markup.carried(markup.nodes(files)).cache()
    found = markup.segments(rows, config)
    got = {r.canonical_id: r for r in found.collect()}
    assert sorted(got) == ["EA 7.12", "EA 7.3", "T01 supplement 1"]
    first = got["EA 7.3"]
    assert (first.text, first.text_chars, first.title, first.head_text, first.start_ref, first.end_ref, first.ordinal) == ("甲 乙[gaiji:#C1]丙丁", 16, "First", "H", "T01_pa1", "T01_pa2", 1)
    assert first.hierarchy[0].text == "7 Chapter" and first.end_scroll == "1" and got["T01 supplement 1"].start_line == "b1"
    made = {r.block_id: (r.block_kind, r.text, r.start_line, r.end_line) for r in markup.blocks(rows, found).collect()}
    assert made == {
        "EA 7.3#b0001": ("p", "甲 乙[gaiji:#C1]", "a1", "a2"), "EA 7.3#b0003": ("list", "丙", "a2", "a2"), "EA 7.12#b0001": ("discourse_fallback", "bare", "a2", "a2"), "T01 supplement 1#b0001": ("lg", "戊", "b1", "b1"),
    }
    assert {r.canonical_id: r.coverage for r in markup.coverage(found, markup.blocks(rows, found)).collect()}["EA 7.3"] == round(15 / 16, 6)
    told = markup.segments(rows, config.withColumn("id_mode", F.lit("global")).withColumn("prefix", F.lit("SA")))
    assert sorted(r.canonical_id for r in told.collect()) == ["SA 12", "SA 3", "SA 5"]
    renamed = files.withColumn("content", F.replace("content", F.lit("cb:"), F.lit("q:"))).withColumn("content", F.replace("content", F.lit("xmlns:cb"), F.lit("xmlns:q")))
    again = markup.segments(markup.carried(markup.nodes(renamed)), config)
    assert markup.changed(found, again).count() == 0 and markup.extract(found, again, "EA 7.3").first().text == first.text
    other = markup.segments(markup.carried(markup.nodes(files.withColumn("content", F.replace("content", F.lit("丙"), F.lit("己"))))), config)
    assert [r.canonical_id for r in markup.changed(found, other).collect()] == ["EA 7.3"]
    with pytest.raises(Exception, match="fingerprint mismatch"):
        markup.extract(found, other, "EA 7.3").collect()
    broken = spark.createDataFrame([("x", "<a>"), ("y", None)], "path string, content string")
    assert markup.headers(broken).count() == 0
    with pytest.raises(Exception, match="malformed document"):
        markup.nodes(broken).collect()


def test_id_resolution(spark):
    refs = [(1, "SA 1"), (2, "SA 1-3"), (3, "SA 2–3"), (4, "SA 3-1"), (5, "SA2 9"), (6, "T 5"), (7, "EA 48.4"), (8, "SA 8-9")]
    there = spark.createDataFrame([("SA 1",), ("SA 2",), ("EA 48.4",), ("SA 3-1x",)], "canonical_id string")
    done = constraints.resolve_ids(spark.createDataFrame(refs, "ref_id int, identifier string"), there, ["SA2", "SA", "EA"])
    got = {r.ref_id: (r.status, r.segments, r.missing) for r in done.collect()}
    assert got == {
        1: ("resolved", ["SA 1"], []), 2: ("partially_resolved", ["SA 1", "SA 2"], ["SA 3"]), 3: ("partially_resolved", ["SA 2"], ["SA 3"]), 4: ("unresolved", [], ["SA 3-1"]),
        5: ("unresolved", [], ["SA2 9"]), 7: ("resolved", ["EA 48.4"], []), 8: ("unresolved", [], ["SA 8", "SA 9"]),
    }
    assert tuple(constraints.resolution_summary(done).first()) == (7, 4, 5, 3)
    assert {r.canonical_id: r.used_by for r in constraints.used_by(done).collect()}["SA 2"] == [2, 3]


def test_missing_numbers_across_ranges(spark):
    df = spark.createDataFrame([(1,), (4,), (99_998,), (100_003,), (None,)], "n long")
    got = sorted(r.missing for r in constraints.missing_numbers(df, "n").collect())
    assert got == [x for x in range(1, 100_004) if x not in (1, 4, 99_998, 100_003)]


def test_positional_difference_with_null_bodies(spark):
    base = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "pos long, body string")
    got = constraints.positional_difference(base, spark.createDataFrame([(2, "b"), (3, None)], "pos long, body string")).collect()
    assert sorted((r.pos, r.rule) for r in got) == [(1, "deleted"), (2, "rewritten")]


def test_candidates(spark):
    pair = "work_id string, witness_id string, "
    left = spark.createDataFrame([("w", "z", "u1", 1, "Evam me SUTAM"), ("w", "z", "u2", 2, "bhikkhu kings"), ("w", "y", "u3", 1, "none")], pair + "unit_id string, ordinal int, text string")
    right = spark.createDataFrame([("w", "z", "b1", 1, "x聞如"), ("w", "z", "b2", 2, "是 王"), ("w", "z", "b3", 3, "如是我聞"), ("w", "z", "b4", 4, "比丘")], pair + "block_id string, ordinal int, text string")
    made = align.formula_candidates(left, right, "evam me sutam", ["聞如是", "如是我聞"]).collect()
    assert [(r.unit_id, r.block_ids, r.formula, r.status) for r in made] == [("u1", ["b3"], "如是我聞", "machine_candidate")]
    lexicon = [{"id": "thus", "left": ["sutam"], "right": ["聞如是"], "weight": 3}, {"id": "king", "left": ["kings"], "right": ["王"]}, {"id": "empty", "left": [""], "right": ["比丘"]}]
    best = {(r.unit_id, r["rank"]): (r.block_ids, r.anchors) for r in align.anchor_windows(left, right, lexicon).collect()}
    assert best["u1", 1] == (["b1", "b2"], ["thus"]) and best["u2", 1][1] == ["king"] and "b2" in best["u2", 1][0]  # across the ends of blocks; an empty form is no hit
    gold = spark.createDataFrame([("g1", "w", "z", ["u1"], ["b1", "b2"], "accepted"), ("g2", "w", "z", ["u2"], ["b1", "b4"], "accepted"), ("g3", "w", "z", ["u2"], ["b1"], "rejected")], "gold_id string, " + pair + "unit_ids array<string>, block_ids array<string>, decision string")
    ranks = align.first_ranks(align.anchor_windows(left, right, lexicon), gold)
    got = {r.gold_id: (r.overlap_rank, r.cover_rank) for r in ranks.collect()}
    assert got["g1"] == (1, 1) and got["g2"][1] is None and "g3" not in got
    assert align.retrieval_metrics(ranks).first().cases == 2 and align.retrieval_metrics(ranks.limit(0)).first().mrr is None


def test_nearest_equals_brute_force(spark):
    dice = random.Random(4)
    left = [("w", f"z{p}", f"u{i}", i, "x" * dice.randint(0, 9)) for p in range(8) for i in range(dice.randint(1, 6))]
    right = [("w", f"z{p}", f"b{i}", i, "x" * dice.randint(0, 9)) for p in range(7) for i in range(dice.randint(1, 6))]

    def centred(rows):
        out = {}
        for p in {r[1] for r in rows}:
            own = [r for r in rows if r[1] == p]
            total, at = sum(max(1, len(r[4])) for r in own), 0
            for r in own:
                out.setdefault(p, []).append((r[2], (at + max(1, len(r[4])) / 2) / total))
                at += max(1, len(r[4]))
        return out

    a, b = centred(left), centred(right)
    expected = {(p, u): min(b[p], key=lambda x: abs(x[1] - c))[0] for p in a if p in b for u, c in a[p]}
    frames = [spark.createDataFrame(rows, f"work_id string, witness_id string, {k} string, ordinal int, text string") for rows, k in ((left, "unit_id"), (right, "block_id"))]
    assert {(r.witness_id, r.unit_id): r.block_ids[0] for r in align.monotonic_candidates(*frames).collect()} == expected


def digest(value):
    return "sha256:" + hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@pytest.fixture(scope="module")
def case(spark):
    claim = {"alignment_id": "a", "members": [{"language": "pli", "witness_id": "w"}], "scope": "é"}
    stored = {**claim, "status": "model_reviewed", "review": {"x": 1}, "members": [{**claim["members"][0], "units": [1]}]}
    view = {"source_id": "u", "text_html": "t", "meta": {"n": None}}
    alignments = spark.createDataFrame([("a", json.dumps(stored), [("pli", "w", ["u"])]), ("b", json.dumps({"alignment_id": "b"}), [("pli", "w", ["gone"])])], "alignment_id string, record string, members array<struct<language:string,witness_id:string,source_unit_ids:array<string>>>")
    alignments = alignments.withColumn("claim", ledger.claim(F.col("record")))
    expected = ledger.snapshots(alignments, spark.createDataFrame([("pli", "u", json.dumps(view))], "language string, unit_id string, view string"))
    evidence = (1, digest(claim), [("pli", "w", "u", digest(view))])
    return alignments, expected, evidence


def review(pos, name, evidence, alignment="a", supersedes=None, reviewer="h", decision="accepted", answer="agree", at="2024-01-01T00:00:00Z", kind="human"):
    return (pos, 2, name, "case", alignment, supersedes, (kind, "N", reviewer), decision, (answer,) * 4, at, evidence, json.dumps({"review_id": name}))


def test_reviews_and_promotions(spark, case):
    alignments, expected, evidence = case
    old = (1, digest("old"), evidence[2])
    make = lambda *rows: ledger.freshness(spark.createDataFrame(list(rows), ledger.REVIEW), expected)
    judged = make(review(1, "r1", evidence), review(2, "r2", old, reviewer="i"), review(3, "r3", (1, "short", []), reviewer="j"), review(4, "r4", evidence, "b", reviewer="k"), review(5, "r5", None, reviewer="l"), review(6, "r6", evidence, "none"))
    got = {r.review_id: (r.fresh, r.reasons) for r in judged.collect()}
    assert got == {
        "r1": (True, []), "r2": (False, ["alignment_claim_digest_changed"]), "r3": (False, ["alignment_claim_digest_changed", "source_unit_evidence_changed"]),
        "r4": (False, ["current_source_unit_unresolved"]), "r5": (False, []), "r6": (False, []),
    }
    told = {(r.subject, r.rule) for r in ledger.review_violations(judged, "case").collect()}
    assert told == {("r3", "claim digest is malformed"), ("r5", "evidence is required"), ("r6", "unknown alignment_id")}  # stale is no error, malformed is
    assert ("r2", "stale evidence") in {(r.subject, r.rule) for r in ledger.review_violations(judged, "case", require_fresh=True).collect()}

    empty = spark.createDataFrame([], ledger.PROMOTION)
    status = lambda j, p: {r.alignment_id: r.derived_status for r in ledger.build_state(alignments, j, p, "case").collect()}["a"]
    good = make(review(1, "r1", evidence))
    assert status(good, empty) == "promotion_required" and status(make(review(1, "r1", old)), empty) == "review_stale" and status(make(review(1, "r1", evidence, decision="rejected")), empty) == "model_reviewed"
    event = ledger.promote(good, empty, "r1", {"name": "P", "actor_id": "p"}, "2024-02-01T00:00:00+00:00", "case")
    assert status(good, event) == "established"
    after = make(review(1, "r1", evidence), review(2, "r2", evidence, supersedes="r1"))
    assert status(after, event) == "promotion_required"  # the promoted review is superseded, a newer fresh one stands
    assert status(make(review(1, "r1", evidence), review(2, "r2", evidence, supersedes="r1", decision="rejected")), event) == "review_stale"
    for wrong, reason in (((good, event, "r1"), "already promoted"), ((after, empty, "r1"), "superseded"), ((make(review(1, "r1", old)), empty, "r1"), "stale evidence"), ((good, empty, "r9"), "unknown review_id")):
        with pytest.raises(ValueError, match=reason):
            ledger.promote(*wrong, {"name": "P", "actor_id": "p"}, "2024-02-01T00:00:00+00:00", "case")
    bent = event.withColumn("review_digest", F.lit("sha256:" + "0" * 64))
    with pytest.raises(ValueError, match="review_digest"):
        ledger.build_state(alignments, good, bent, "case")
    current = spark.createDataFrame([review(1, "r1", evidence)], ledger.REVIEW)
    grown = ledger.record_reviews(current, spark.createDataFrame([review(2, "r2", evidence, supersedes="r1")], ledger.REVIEW), expected, "case")
    assert grown.count() == 2
    with pytest.raises(ValueError, match="revision must supersede"):
        ledger.record_reviews(current, spark.createDataFrame([review(2, "r2", evidence)], ledger.REVIEW), expected, "case")


def test_lineage_against_a_fold(spark):
    dice = random.Random(8)
    for _ in range(3):
        rows = [review(i, f"r{dice.randint(0, 12)}", None, dice.choice("ab"), dice.choice([None, "", *[f"r{x}" for x in range(12)]]), dice.choice(["h", "i", ""])) for i in range(25)]
        seen, latest, expected = {}, {}, []
        for r in rows:
            rid, alignment, target, who = r[2], r[4], r[5] or None, r[6][2]
            if rid in seen:
                expected.append((rid, "duplicate review_id"))
                continue
            last = latest.get((who, alignment)) if who else None
            if last is None and target:
                expected.append((rid, "supersedes without an earlier review"))
            if last is not None and target != last:
                expected.append((rid, "revision must supersede the latest"))
            if target and target not in seen:
                expected.append((rid, "supersedes unknown or later review"))
            elif target:
                expected += [(rid, "superseded review is of another alignment")] * (seen[target][0] != alignment) + [(rid, "superseded review is of another reviewer")] * (seen[target][1] != who)
            seen[rid] = (alignment, who)
            if who:
                latest[who, alignment] = rid
        got = ledger.lineage_violations(spark.createDataFrame(rows, ledger.REVIEW)).collect()
        assert sorted((r.subject, r.rule) for r in got) == sorted(expected)


def test_source_view_and_payload(spark):
    place = spark.createDataFrame([("u", "t", ("p", None, "", "root", "a", "", "a"), ("s", None))], "id string, html string, source struct<project:string,revision:string,path:string,root_path:string,root_url:string,html_url:string,url:string>, locator struct<start_ref:string,end_ref:string>")
    got = json.loads(place.select(ledger.source_view(F.col("id"), F.col("html"), F.col("source"), F.col("locator")).alias("v")).first().v)
    assert got == {"source_id": "u", "text_html": "t", "meta": {"project": "p", "revision": None, "path": "root", "start_ref": "s", "end_ref": None, "urls": ["a"]}}
    lines = render.table_lines(spark.createDataFrame([(1, "| a |")], "k int, line string"), ["k"], ["T"])
    drift = constraints.view_drift(lines, spark.createDataFrame([(1, "| T |"), (2, "|---|"), (3, "| b |"), (4, "x")], "line_no int, line string"))
    assert sorted(r.line_no for r in drift.collect()) == [3, 4]


def test_sources_and_sinks(spark, tmp_path):
    at = lambda name: f"{tmp_path}/{name}"
    (tmp_path / "roots" / "san" / "deep").mkdir(parents=True)
    (tmp_path / "roots" / "san" / "deep" / "x1_root-san-ms.json").write_text(json.dumps({"x:2": "b", "x:1": "a"}))
    (tmp_path / "roots" / "san" / "other.json").write_text("{}")
    got = sources.leaf_scan(spark, at("roots"), ["san", "pra"]).orderBy("ordinal").collect()
    assert [(r.canonical_id, r.language, r.ordinal, r.segment_id, r.text) for r in got] == [("x1", "san", 1, "x:2", "b"), ("x1", "san", 2, "x:1", "a")]
    (tmp_path / "rows").mkdir()
    (tmp_path / "rows" / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    assert sorted((r.id, r.file, r.line) for r in sources.jsonl_with_places(spark, at("rows"), "id string", "id").collect()) == [("1", "a.jsonl", 1), ("2", "a.jsonl", 3)]
    (tmp_path / "rows" / "b.jsonl").write_text('{"id": "2"}\n')
    with pytest.raises(Exception, match="duplicate id"):
        sources.jsonl_with_places(spark, at("rows"), "id string", "id").collect()
    assert sources.jsonl(spark, at("none.jsonl"), "id string", optional=True).count() == 0 and sources.jsonl(spark, at("rows/a.jsonl"), "id string").count() == 2
    for name, text in (("r1", '{"review_id": "a"}'), ("r2", '[{"review_id": "b"}, {"review_id": "c"}]'), ("r3", '{"reviews": [{"review_id": "d"}]}')):
        (tmp_path / f"{name}.in").write_text(text)
    assert sorted(r.review_id for r in sources.review_input(spark, at("*.in"), "review_id: string").collect()) == ["a", "b", "c", "d"]
    df = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "id int, name string, note string")
    sources.write_jsonl(df, at("out"), "id")
    assert [json.loads(r.value) for r in spark.read.text(at("out")).collect()] == [{"id": 1, "name": "a", "note": "x"}, {"id": 2, "name": "b"}]
    sources.write_csv(df, at("csv"), "id")
    assert [r.value for r in spark.read.text(at("csv")).collect()] == ["id,name,note", "1,a,x", "2,b,"]
    sources.write_json(sources.manifest(df, spark.createDataFrame([("bad", "s")], "rule string, subject string"), {"n": F.count(F.lit(1))}), at("manifest"))
    assert json.loads("".join(r.value for r in spark.read.text(at("manifest"), wholetext=True).collect())) == {"n": 2, "errors": ["s: bad"]}
    assert sources.append(df, at("ledger")).count() == 2 and not (tmp_path / "ledger").exists()
    sources.append(df, at("ledger"), write=True)
    assert spark.read.parquet(at("ledger")).count() == 2
    (tmp_path / "x.xml").write_text("<a/>")
    named = spark.createDataFrame([("x.xml", 1), ("gone.xml", 2)], "path string, n int")
    assert [(r.path, r.n) for r in sources.listed_files(spark, str(tmp_path), named).collect()] == [("x.xml", 1)]
    assert sources.json_document(spark, at("manifest"), "n int").first().n == 2 and list(sources.config(spark, a=(at("manifest"), "n int"))) == ["a"]


def test_compact_segments_and_provenance(spark):
    files = spark.createDataFrame([("d/T01.xml", XML)], "path string, content string")
    config = spark.createDataFrame([("d/T01.xml", "EA", "T01", "chapter.item")], "path string, prefix string, container_id string, id_mode string")
    found = markup.segments(markup.carried(markup.nodes(files)), config)
    places = spark.createDataFrame([("EA 7.3", "ea.jsonl", 4)], "canonical_id string, file string, line int")
    kept = markup.compact(found, places).collect()
    assert len(kept) == 1 and kept[0].segment.catalog.line == 4 and kept[0].segment.locator.start_ref == "T01_pa1"
    r = one(spark, T.source_record(F.lit("http://x/r.git"), F.lit("abc"), F.lit("p"), root=F.lit("a.json"), html=F.lit("b.json")).alias("s")).s
    assert (r.root_url, r.html_path, r.revision) == ("http://x/r/blob/abc/a.json", "b.json", "abc")


def test_ledger_stream(spark, tmp_path):
    from stemma.streaming import decision_counts

    at = f"{tmp_path}/in"
    rows = [("2024-01-01 00:10:00", "accepted"), ("2024-01-01 00:20:00", "accepted"), ("2024-01-01 01:10:00", "rejected")]
    spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.to_timestamp("ts")).write.parquet(at)
    stream = decision_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(at))
    query = stream.writeStream.format("memory").queryName("decisions").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.event_type, r.n) for r in spark.table("decisions").collect()) == [("accepted", 2), ("rejected", 1)]
