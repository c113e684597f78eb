"""XML documents as node rows, and what is read off them: discourses, blocks, headers, single extracts.

One Arrow walk parses each document once and emits rows in document order, of every element or of discourses alone.
What depends on that order alone is settled in the walk: the line and scroll marks that hold where an element starts and
ends, a discourse's place, and the blocks inside it, which come with its row.  So nothing is joined with itself or dealt
out by document afterwards; ids are a CASE over a row and its document's configuration.
"""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import after_number, collapse, license_text, names_subject, reference

# Fixed values of the document format: tags without running text, tags of blocks, preferred readings, kinds of marks.
NO_TEXT = {"mulu", "head", "jhead", "juan", "byline", "trailer", "note", "rdg", "anchor", "pb", "milestone"}
BLOCKS = ("p", "lg", "table", "list")
PREFERRED = ("corr", "reg", "orig", "sic")
DISCOURSE, CHAPTER, EDITION = "經", "品", "T"
_ID = "{http://www.w3.org/XML/1998/namespace}id"
NODES = (
    "path string, seq int, last int, tag string, attrs map<string,string>, ancestors array<int>, block_above int, "
    "hierarchy array<struct<div_type:string,mulu_type:string,number:bigint,text:string>>, "
    "mulu struct<type:string,number:bigint,text:string>, head string, reading string, fingerprint string, "
    "line string, scroll string, end_line string, end_scroll string, ordinal int, loose int"
)
#: Of a discourse: its outermost blocks in order.
INNER = "inner array<struct<tag:string,xml_id:string,reading:string,fingerprint:string,line:string,end_line:string>>"
#: A batch of rows ends at so many rows or characters of running text.
_ROWS, _CHARS = 2000, 4_000_000
HEADERS = "path string, xml_id string, title string, targets array<string>, header string, license_label string, license_target string"


@lru_cache(maxsize=4096)
def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _name(node: ET.Element) -> str:
    return _local(node.tag)


def _child(node: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in node if _name(c) == name), None)


def _words(node: ET.Element | None) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def _digits(text: str) -> int | None:
    head = text[: len(text) - len(text.lstrip("0123456789"))]
    return int(head) if head else None


def _number(mulu: ET.Element) -> int | None:
    """The visible number wins over the attribute."""
    seen, told = _digits(_words(mulu)), mulu.get("n") or ""
    return seen if seen is not None else int(told) if told.isdigit() else None


def reading(node: ET.Element, known: dict[ET.Element, str] | None = None) -> str:
    """The running text: the lemma of an apparatus, the preferred form of a choice, no notes, a line break for each line.

    ``known`` keeps the texts of blocks, so that those inside what was read are not read again.
    """
    name = _name(node)
    if name in NO_TEXT:
        return ""
    if known is not None and node in known:
        return known[node]
    if name in ("app", "choice"):
        forms = [_child(node, x) for x in (("lem",) if name == "app" else PREFERRED)]
        chosen = next((x for x in forms if x is not None), None)
        return reading(chosen, known) if chosen is not None else ""
    told = [(node.text or "").strip()]
    if name == "g" and not told[0]:
        return f"[gaiji:{node.get('ref', '?')}]"
    for c in node:
        told.append("\n" if _local(c.tag) == "lb" else reading(c, known))
        if c.tail:
            told.append(c.tail.strip())
    whole = "".join(told)
    if known is not None and name in BLOCKS:
        known[node] = whole
    return whole


def fingerprint(node: ET.Element) -> str:
    """SHA-256 of tags, sorted attributes, texts and tails, whatever the prefixes of name spaces."""
    out: list[str] = []

    def add(x: ET.Element) -> None:
        out.append("<" + str(x.tag))
        if x.attrib:
            out.extend([f"\0A{k}={v}" for k, v in sorted(x.attrib.items())])
        out.append("\0T" + (x.text or ""))
        for c in x:
            add(c)
            out.append("\0L" + (c.tail or ""))
        out.append(">")

    add(node)
    return hashlib.sha256("".join(out).encode()).hexdigest()


def _rows(path: str, root: ET.Element, every: bool = True, inner: bool = True, texts: bool = True, digests: bool = True) -> list[dict]:
    """Rows of every element or of discourses alone, with the blocks inside them or without, with or without running texts and digests."""
    out: list[dict] = []
    read: dict[ET.Element, str] = {}
    todo: list[tuple] = [(root, [], None, [], [])]
    opened: list[tuple[int, dict, list[dict]]] = []  # depth and row of elements whose last descendant isn't known yet, and what discourses know of them
    line = scroll = None
    seq, discourses, loose = -1, 0, 0

    def close(row: dict, known: list[dict]) -> None:
        nonlocal loose
        row |= {"last": seq, "end_line": line, "end_scroll": scroll}
        for block in known:
            block["end_line"] = line
        if row["ordinal"] is not None:
            chapters = [x for x in row["hierarchy"] if x["mulu_type"] == CHAPTER]
            loose += not chapters or chapters[-1]["number"] is None
            row["loose"] = loose

    while todo:
        node, above, block, hierarchy, around = todo.pop()
        while opened and opened[-1][0] >= len(above):
            close(*opened.pop()[1:])
        seq += 1
        name = _name(node)
        if name == "lb" and node.get("ed") == EDITION and node.get("n"):
            line = node.get("n")
        elif name == "juan" and node.get("fun") == "open":
            scroll = node.get("n")
        mulu = _child(node, "mulu") if name == "div" else None
        told = {"type": mulu.get("type"), "number": _number(mulu), "text": _words(mulu)} if mulu is not None else None
        discourse = told is not None and told["type"] == DISCOURSE
        # discourses in which no block is around this element
        owners = [x for x in around if block is None or block < x["seq"]] if inner and name in BLOCKS else []
        known: list[dict] = []
        if every or discourse or owners:
            shown = discourse or name in BLOCKS
            row = {
                "path": path, "seq": seq, "last": seq, "tag": name, "attrs": list(node.attrib.items()), "ancestors": above, "block_above": block, "hierarchy": hierarchy, "mulu": told,
                "head": _words(_child(node, "head")) or None if name == "div" else None, "reading": reading(node, read) if shown and texts else None, "fingerprint": fingerprint(node) if shown and digests else None,
                "line": line, "scroll": scroll, "ordinal": None, "loose": None, "inner": None,
            }
            if discourse:
                discourses += 1
                row |= {"ordinal": discourses, "inner": []}
            if owners:
                known = [{"tag": name, "xml_id": node.get(_ID), "reading": row["reading"], "fingerprint": row["fingerprint"], "line": line}]
                for x in owners:
                    x["inner"].append(known[0])
            if every or discourse:
                out.append(row)
            opened.append((len(above), row, known))
        if not len(node):
            continue
        inside = [*hierarchy, {"div_type": node.get("type"), "mulu_type": told["type"], "number": told["number"], "text": told["text"]}] if told and not discourse else hierarchy
        within = [*around, row] if discourse else around
        held = seq if name in BLOCKS else block
        deeper = [*above, seq]
        todo.extend([(c, deeper, held, inside, within) for c in reversed(node)])
    while opened:
        close(*opened.pop()[1:])
    return out


def _header(path: str, root: ET.Element) -> list[dict]:
    every = list(root.iter())
    title = next((t for s in every if _name(s) == "titleStmt" for t in s if _name(t) == "title"), None)
    header = " ".join(_words(x) for h in every if _name(h) == "teiHeader" for x in h.iter() if x is not h)
    given = next((x for s in every if _name(s) == "publicationStmt" for x in s.iter() if _name(x) == "licence"), None)
    return [{
        "path": path, "xml_id": root.get(_ID), "title": _words(title) or None, "targets": [x.get("target", "") for x in every if _name(x) == "ref"], "header": header,
        "license_label": _words(given) or None, "license_target": given.get("target") if given is not None else None,
    }]


def _parsed(files: DataFrame, schema: str, rows, malformed: str) -> DataFrame:
    """What ``rows`` makes of each parsed (path, content); malformed documents are an error or, if ``malformed`` is 'skip', no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):  # one document's text at a time
                try:
                    made = rows(path.as_py(), ET.fromstring(content.as_py()))
                except ET.ParseError as wrong:
                    if malformed == "skip":
                        continue
                    raise ValueError(f"malformed document {path}: {wrong}") from wrong
                for row in made:
                    held.append(row)
                    chars += len(row.get("reading") or row.get("header") or "")
                    if len(held) >= _ROWS or chars >= _CHARS:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, chars = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return files.select("path", "content").filter("content IS NOT NULL").mapInArrow(run, schema)


def nodes(files: DataFrame, malformed: str = "error", detail: str = "all", texts: bool = True, digests: bool = True) -> DataFrame:
    """A row for every element of every document (path, content); see NODES.

    Elements carry the line and the scroll that hold when they start and when they end, discourses their place in the
    document, how many without a numbered chapter have ended with them, and the blocks inside.  ``detail`` 'discourses'
    gives rows of discourses alone, without the blocks; 'blocks' those rows with them.  Who reads no running texts or no
    digests may leave them out (null) with ``texts`` or ``digests``.
    """
    if detail not in ("all", "discourses", "blocks"):
        raise ValueError(f"unknown detail: {detail}")
    schema = NODES if detail == "discourses" else f"{NODES}, {INNER}"
    return _parsed(files, schema, partial(_rows, every=detail == "all", inner=detail != "discourses", texts=texts, digests=digests), malformed)


def carried(rows: DataFrame) -> DataFrame:
    """``nodes`` with the line and the scroll that hold when an element starts and when it ends: the walk carries them, so as they are."""
    return rows


def segments(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Discourses of ``carried`` nodes with ids, titles, places and digests; ``config`` is (path, prefix, container_id, id_mode).

    An id is ``prefix n``, or in mode ``chapter.item`` ``prefix chapter.n`` by the nearest enclosing chapter; without
    a numbered chapter it is a supplement, counted as discourses end.  Without a number the id is null.
    """
    found = rows.filter((F.col("tag") == "div") & (F.col("mulu.type") == DISCOURSE)).join(config, "path")
    by_chapter = F.col("id_mode") == "chapter.item"
    chapter = F.try_element_at(F.filter("hierarchy", lambda x: x["mulu_type"] == CHAPTER), F.lit(-1))["number"]
    number = F.col("mulu.number")
    canonical = (
        F.when(number.isNull(), F.lit(None)).when(F.col("extra"), F.concat("container_id", F.lit(" supplement "), F.col("loose").cast("string")))
        .when(by_chapter, F.concat("prefix", F.lit(" "), chapter.cast("string"), F.lit("."), number.cast("string"))).otherwise(F.concat("prefix", F.lit(" "), number.cast("string")))
    )
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    plain = collapse(F.col("reading"))
    made = found.withColumn("extra", by_chapter & chapter.isNull())
    return made.select(
        "path", "seq", "last", "ordinal", canonical.alias("canonical_id"), F.when(F.col("extra"), "supplement").otherwise("canonical").alias("record_kind"), F.col("prefix").alias("collection"), "container_id",
        number.alias("number"), after_number(F.col("mulu.text")).alias("title"), F.col("mulu.text").alias("mulu_text"), F.col("head").alias("head_text"), "hierarchy",
        F.format_string(f"(//*[local-name()='div'][*[local-name()='mulu' and @type='{DISCOURSE}']])[%d]", F.col("ordinal")).alias("xpath"),
        F.col("line").alias("start_line"), "end_line", reference(stem, F.col("line")).alias("start_ref"), reference(stem, F.col("end_line")).alias("end_ref"), F.col("scroll").alias("start_scroll"), "end_scroll",
        F.col("fingerprint").alias("xml_sha256"), plain.alias("text"), F.sha2(plain, 256).alias("text_sha256"), F.char_length(plain).alias("text_chars"),
        *[c for c in ("inner",) if c in rows.columns],
    )


def compact(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """(canonical_id, segment): what a crosswalk keeps of a discourse, with its place (canonical_id, file, line) in the catalog."""
    place = F.struct("file", "line").alias("catalog")
    told = F.struct("canonical_id", "container_id", "title", "head_text", "hierarchy", F.struct("path", "ordinal", "xpath", "start_ref", "end_ref", "xml_sha256").alias("locator"), place)
    return found.drop("line").join(catalog.select("canonical_id", "file", "line"), "canonical_id").select("canonical_id", told.alias("segment"))


def _with_blocks(found: DataFrame) -> DataFrame:
    """``segments`` with ``held``: their outermost blocks, empty ones counted but left out; without any, the discourse itself, if it has text."""
    told = lambda kind, ordinal, text, line, end, digest, xml_id: F.struct(
        kind.alias("block_kind"), ordinal.alias("ordinal"), text.alias("text"), line.alias("start_line"), end.alias("end_line"), digest.alias("xml_sha256"), xml_id.alias("xml_id")
    )
    every = F.transform("inner", lambda x, i: told(x["tag"], i + 1, collapse(x["reading"]), x["line"], x["end_line"], x["fingerprint"], x["xml_id"]))
    bare = told(F.lit("discourse_fallback"), F.lit(1), F.col("text"), F.col("start_line"), F.col("end_line"), F.col("xml_sha256"), F.lit(None).cast("string"))
    told_of = found.withColumn("held", F.filter(every, lambda x: x["text"] != ""))
    return told_of.withColumn("held", F.when(F.size("held") > 0, F.col("held")).when(F.col("text") != "", F.array(bare)))


def blocks(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Outermost blocks of each discourse in order, empty ones counted but left out; without any, the discourse itself.

    A discourse of ``segments`` brings its blocks along; those of another origin get them from ``rows``.
    """
    if "inner" not in found.columns:
        found = found.join(rows.filter("inner IS NOT NULL").select("path", "seq", "inner"), ["path", "seq"])
    # the outer form, as the optimizer would make the array twice for the other
    made = _with_blocks(found).select("path", "seq", "canonical_id", "container_id", F.explode_outer("held").alias("b")).filter("b IS NOT NULL")
    own = " or ".join(f"local-name()='{b}'" for b in BLOCKS)
    place = F.when(F.col("b.block_kind") == "discourse_fallback", ".").otherwise(F.format_string(f"(.//*[{own}][not(ancestor::*[{own}])])[%d]", F.col("b.ordinal")))
    return made.select(
        "path", "seq", F.concat("canonical_id", F.lit("#b"), F.format_string("%04d", F.col("b.ordinal"))).alias("block_id"), "canonical_id", "container_id", "b.block_kind", "b.ordinal", "b.text",
        F.sha2("b.text", 256).alias("text_sha256"), "b.start_line", "b.end_line", "b.xml_sha256", "b.xml_id", place.alias("relative_xpath"),
    )


def coverage(found: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """(canonical_id, blocks, coverage): characters of a discourse's blocks by those of its text, at most 1, to six places.

    Blocks are ``made``, or those that the discourses bring along.
    """
    if made is None:
        lengths = _with_blocks(found).withColumn("lengths", F.transform("held", lambda x: F.char_length(x["text"])))
        told = lengths.withColumns({"blocks": F.size("lengths").cast("long"), "chars": F.aggregate("lengths", F.lit(0), lambda a, x: a + x)})
        told = told.withColumn("blocks", F.greatest("blocks", F.lit(0)))
    else:
        held = made.groupBy("path", "seq").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.char_length("text")).alias("chars"))
        told = found.join(held, ["path", "seq"], "left")
    share = F.round(F.least(F.lit(1.0), F.coalesce("chars", F.lit(0)) / F.greatest(F.col("text_chars"), F.lit(1))), 6)
    return told.select("canonical_id", F.coalesce("blocks", F.lit(0)).alias("blocks"), share.alias("coverage"))


def headers(files: DataFrame, malformed: str = "skip") -> DataFrame:
    """Title, license, references and header text of each document (path, content)."""
    return _parsed(files, HEADERS, _header, malformed)


def edition_witnesses(files: DataFrame, subject_mark: str, phrases: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """(path, witness_id, title, language_phrase, license) of the documents whose header names the subject."""
    told = headers(files).filter(names_subject(F.col("targets"), F.col("header"), subject_mark, phrases))
    name = F.coalesce("xml_id", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    return told.select("path", name.alias("witness_id"), F.coalesce("title", name).alias("title"), "header", license_text(F.col("license_label"), F.col("license_target")).alias("license"))


def extract(found: DataFrame, current: DataFrame, canonical_id: str) -> DataFrame:
    """One discourse by its id: its text from ``current`` segments, if the recorded place still has the recorded digest.

    A digest that differs is an error; so nothing is extracted from a document that has changed.
    """
    wanted = found.filter(F.col("canonical_id") == canonical_id).select("path", "ordinal", F.col("canonical_id"), F.col("xml_sha256").alias("recorded"))
    met = wanted.join(current.select("path", "ordinal", "xml_sha256", "text", "start_ref", "end_ref", "title"), ["path", "ordinal"], "left")
    same = F.assert_true(F.col("xml_sha256").eqNullSafe(F.col("recorded")), F.concat(F.lit("fingerprint mismatch: "), F.col("canonical_id")))
    return met.select("canonical_id", "title", "start_ref", "end_ref", "xml_sha256", "text", same.alias("checked"))


def changed(found: DataFrame, current: DataFrame) -> DataFrame:
    """(canonical_id, recorded, actual) of discourses whose recorded place holds another element now, or none."""
    met = found.select("canonical_id", "path", "ordinal", F.col("xml_sha256").alias("recorded")).join(current.select("path", "ordinal", F.col("xml_sha256").alias("actual")), ["path", "ordinal"], "left")
    return met.filter(~F.col("recorded").eqNullSafe(F.col("actual"))).select("canonical_id", "recorded", "actual")
