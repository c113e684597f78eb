"""What keeps queries in proportion to their input: how often a plan reads and parses, and that the quicker forms find the same."""

import random
import xml.etree.ElementTree as ET

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stemma.operators import align, markup, units
from stemma.plans import candidates, registry

DATA = "/root/testdata/sf0.001"
#: Walks over XML in the plan that a query returns.
WALKS = {
    "xml_fingerprint": 1,
    "fingerprint_check": 2,
    "xml_segments": 1,
    "xml_reading_text": 1,
    "point_extract": 1,
    "xml_coverage": 1,
    "xml_blocks": 1,
}
#: Queries whose returned plan must read documents no more: pairs are found once, before.
PAIRED = (
    "candidate_union",
    "nearest_position",
    "formula_candidates",
    "retrieval_ranks",
    "retrieval_metrics",
)


def plan(spark, name):
    return registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", WALKS)
def test_documents_are_parsed_once(spark, name):
    told = plan(spark, name)
    assert told.count("MapInArrow") == WALKS[name] and "Window" not in told


@pytest.mark.parametrize("name", PAIRED)
def test_pairs_are_found_once(spark, name):
    assert "documents.parquet" not in plan(spark, name)


def test_pairs_compare_no_document_with_every_item(spark):
    assert "NestedLoop" not in plan(spark, "alignment_pairs")


@pytest.mark.parametrize("name", ["alignment_pairs", "lexicon_hits"])
def test_pairs_cut_no_document_into_words(spark, name):
    """Words of documents times items that have them are no measure of the work: one pass finds all passages."""
    told = plan(spark, name)
    assert told.count("MapInArrow") == 1 and "split(text#" not in told.split("documents.parquet")[0].split("MapInArrow")[-1]


@pytest.mark.parametrize("side, normal", [("left", "lower("), ("right", "regexp_replace(")])
def test_texts_are_normalised_once_for_a_lexicon(spark, side, normal):
    """However many forms there are, by as many mentions in the optimized plan."""
    hits = align.lexicon_hits(F.col("text"), candidates.LEXICON, side)
    frame = spark.createDataFrame([("The  that her in",), (None,), ("",), ("nowhere",)], "text string").select(hits.alias("h"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count(normal) == 1
    assert [[(h.id, h.form, h.weight) for h in r.h] for r in frame.collect()] == {
        "left": [[("the", "the that", 1.0), ("her", "her in", 1.0)], [], [], [("on", "nowhere", 4.0), ("her", "her", 1.0)]],
        "right": [[("the", "th at", 1.0), ("none", "er", 3.0), ("her", "therin", 1.0)], [], [], [("none", "er", 3.0)]],
    }[side]


def test_passages_at_any_place(spark):
    """Passages across the ends of chunks and of texts, of items with one beginning, in many copies."""
    dice = random.Random(3)
    word = lambda: "".join(dice.choice("abcdeé") for _ in range(5))
    whole = " ".join(word() for _ in range(60_000))
    assert len(whole.encode()) > 2 * candidates._CHUNK
    starts = [*range(0, 200, 7), *(candidates._CHUNK * k * len(whole) // len(whole.encode()) + d for k in (1, 2) for d in range(-90, 90, 11)), len(whole) - 60]
    passages = [*(whole[i : i + 60] for i in starts), whole[:40] + "z" * 20, "z" * 60, whole[-30:] + whole[:30]]
    texts = [whole, whole[-30:], whole[:30], "z" * 500, None, "", whole[:59], *[whole[:100]] * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(i, p) for i, p in enumerate([*passages, *passages[:2]])], "item_id int, passage string")
    got = sorted((r.doc_id, r.item_id) for r in candidates._holding(docs, items).collect())
    assert got == sorted((d, i) for d, t in enumerate(texts) if t is not None for i, p in enumerate([*passages, *passages[:2]]) if p in t)


@pytest.mark.parametrize("most", [100_000, 3])
def test_passages_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(candidates, "_MOST", most)
    passages = ["a bb cc d", "nowordinside", "two words", "x  y", "xx    yy", "é ñandú ü e", "cc bb cc bb", "\tz z\nz z"]
    texts = [None, "", "a bb cc d", "a bb cc dd a bb cc d", "xa bb cc d", "bb a bb  cc d", "inowordinsidei", "two wordss two words", "x  y  x  y", "xx    yy", "xx   yy", "é ñandú ü ee é ñandú", "bb cc bb cc bb cc bb", "q\tz z\nz z q", "bb cc bb", "two words", "two words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(i, p) for i, p in enumerate(passages)], "item_id long, passage string")
    got = sorted((r.doc_id, r.item_id) for r in candidates._holding(docs.unionByName(docs.filter("doc_id = 2")), items).collect())
    expected = [(d, i) for d, t in [*enumerate(texts), (2, texts[2])] for i, p in enumerate(passages) if t is not None and p in t]
    assert got == sorted(expected)


def test_texts_are_looked_up_at_every_eighth_byte(monkeypatch):
    """Passages of 39 bytes or more hold such a window wherever they lie; shorter ones are looked for at every byte."""
    dice = random.Random(5)
    texts = ["".join(dice.choice("abcdé ") for _ in range(9_000)) for _ in range(2)]
    long = [x[at : at + n] for x in texts for n in (39, 40, 60) for at in [*range(70), len(x) - n]] + [texts[0][-30:] + texts[1][:30]]
    short = [texts[1][at : at + n] for n in (1, 5, 31, 33) for at in (0, 3, 8_000)]
    column, made = pa.array(["", *texts, None, texts[0][:60]], pa.large_string())[1:], []
    for name in ("_hashes", "_stepped"):
        if make := getattr(candidates, name, None):
            monkeypatch.setattr(candidates, name, lambda *args, make=make: made.append(make(*args)) or made[-1])
    for passages in (long, long + short):
        search = candidates._Search(list(enumerate(passages)))
        made.clear()
        got = list(search.met(column))
        assert sorted(got) == sorted((i, p.encode()) for i, x in enumerate(column.to_pylist()) if x for p in set(passages) if p in x)
        if passages is long:
            assert sum(map(len, made)) <= sum(len(x.encode()) for x in texts) // 8 + 8


@pytest.mark.parametrize("name", ["formula_candidates", "retrieval_metrics"])
def test_lines_are_read_to_their_first_character_only(spark, name):
    """To leave out those of white space, no line is made without it."""
    told = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in x and "regexp_replace" in x for x in told.splitlines()) and "RLIKE" in told


def test_lines_of_white_space(spark):
    kinds = ["", " ", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2028", "\u2029", "\u3000", " \u3000\x85\t", "\x1b", "\u200b", "\ufeff", "\x00", " x ", "\u3000é", "\x85.", "😀", "\u3000😀"]
    docs = spark.createDataFrame([(1, "\n".join(kinds)), (2, None), (3, "\n \n")], "doc_id long, text string")
    got = [(r.doc_id, r.ordinal, r.text) for r in units.text_blocks(docs).orderBy("doc_id", "ordinal").collect()]
    assert got == [(1, i, x) for i, x in enumerate(kinds, 1) if i > 15]


def test_blocks_lose_their_white_space_once(spark):
    """Not in each window that holds them."""
    told = registry.QUERIES["anchor_window_topk"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(array_join" not in told and told.count("[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+") == 2


#: Whether a query's walk makes running texts and digests.
MADE = {
    "xml_segments": (False, False),
    "xml_reading_text": (True, False),
    "xml_blocks": (True, False),
    "fingerprint_check": (False, True),
}


@pytest.mark.parametrize("name", MADE)
def test_walks_make_only_what_is_read(spark, monkeypatch, name):
    told, nodes = [], markup.nodes

    def seen(*args, **named):
        rows = nodes(*args, **named)
        told.append(rows.agg(F.count("reading"), F.count("fingerprint")).first())
        return rows

    monkeypatch.setattr(markup, "nodes", seen)
    assert registry.QUERIES[name](spark, DATA).count() > 0
    assert told and all(tuple(x > 0 for x in r) == MADE[name] for r in told)


@pytest.mark.parametrize("name", MADE)
def test_files_cut_only_the_lines_they_hold(spark, name):
    """Of a text only its first lines are cut."""
    assert "split(text#" not in registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def tree(dice, depth=0):
    """Random markup: chapters, discourses inside discourses, blocks inside blocks, marks of lines and scrolls."""
    kind = dice.choice(["div", "div", "div", "p", "lg", "note", "lb", "juan", "x"]) if depth < 6 else "lb"
    if kind == "lb":
        return f'<lb ed="{dice.choice("TTR")}" n="{dice.choice(["", "a", "b", "c"])}{dice.randint(0, 99)}"/>'
    if kind == "juan":
        return dice.choice([f'<juan fun="open" n="{dice.randint(1, 9)}"/>', '<juan fun="close" n="9"/>', '<juan fun="open"/>'])
    mulu = ""
    if kind == "div" and dice.random() < 0.8:
        mulu = f'<mulu type="{dice.choice(["經", "經", "品", "z"])}">{dice.choice(["", "1 ", "22 "])}t</mulu>'
    return f"<{kind}>{mulu}{dice.choice(['', ' ', 'w'])}{''.join(tree(dice, depth + 1) for _ in range(dice.randint(0, 4)))}</{kind}>{dice.choice(['', 'v'])}"


def expected(root):
    """Discourses by a plain recursion: (ordinal, first and last line and scroll, loose), and their outermost blocks."""
    found, at, ends = [], {"line": None, "scroll": None}, []

    def walk(node, chapters, around, blocked):
        name, mulu = node.tag, node.find("mulu") if node.tag == "div" else None
        if name == "lb" and node.get("ed") == "T" and node.get("n"):
            at["line"] = node.get("n")
        if name == "juan" and node.get("fun") == "open":
            at["scroll"] = node.get("n")
        own, block = None, None
        if mulu is not None and mulu.get("type") == "經":
            own = {"start": dict(at), "inner": [], "loose": not chapters or chapters[-1] is None, "text": markup.reading(node), "digest": markup.fingerprint(node)}
            found.append(own)
            around, blocked = [*around, own], {**blocked, id(own): False}
        elif mulu is not None and mulu.get("type") == "品":
            chapters = [*chapters, markup._number(mulu)]
        if name in markup.BLOCKS:
            block = [name, markup.reading(node), at["line"], None]
            for x in around:
                if not blocked[id(x)]:
                    x["inner"].append(block)
            blocked = dict.fromkeys(blocked, True)
        for c in node:
            walk(c, chapters, around, blocked)
        if block:
            block[3] = at["line"]
        if own:
            own["end"] = dict(at)
            ends.append(own)
            own["count"] = sum(x["loose"] for x in ends)

    walk(root, [], [], {})
    return [(i, x["start"]["line"], x["start"]["scroll"], x["end"]["line"], x["end"]["scroll"], x["count"], x["text"], x["digest"], [tuple(b) for b in x["inner"]]) for i, x in enumerate(found, 1)]


def test_walk_equals_a_plain_recursion(spark):
    dice = random.Random(7)
    texts = {f"d/{i}.xml": f"<TEI>{''.join(tree(dice) for _ in range(12))}</TEI>" for i in range(40)}
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    kept = ["path", "ordinal", "line", "scroll", "end_line", "end_scroll", "loose", "reading", "fingerprint"]
    want = {(p, x[0]): x[1:] for p, t in texts.items() for x in expected(ET.fromstring(t))}
    assert sum(len(x[-1]) > 1 for x in want.values()) > 20
    for detail in ("all", "blocks", "discourses"):
        rows = [r for r in markup.nodes(files, detail=detail).filter("ordinal IS NOT NULL").collect()]
        got = {(r.path, r.ordinal): tuple(r[c] for c in kept[2:]) + (([(b["tag"], b["reading"], b["line"], b["end_line"]) for b in r.inner],) if detail != "discourses" else (want[r.path, r.ordinal][-1],)) for r in rows}
        assert got == want, detail
