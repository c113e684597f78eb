"""Column functions of the text rules."""

from __future__ import annotations

import html as _html
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space by Unicode plus the four ASCII separators; Java's and RE2's own classes differ, this one is the same in both.
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
#: Any other character; it is looked for up to the first one only.
INK = r"[^\s\x1c-\x1f\x{85}\p{Z}]"
#: Offset-aware ISO-8601 times end like this.
OFFSET = r"(?:Z|[+-]\d\d:?\d\d)$"


def collapse(text) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def squeeze(text) -> Column:
    return F.regexp_replace(text, SPACE, "")


def blank(text) -> Column:
    """True for a null text and for one of white space only."""
    return F.coalesce(squeeze(text) == "", F.lit(True))


def strip_tags(text) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Character references, named and numeric, become characters; HTML's table of names has no SQL form."""
    return texts.map(lambda t: _html.unescape(t) if t is not None and "&" in t else t)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


@F.pandas_udf(StringType())
def html_text(texts: pd.Series) -> pd.Series:
    """The text of HTML as a parser reads it, references resolved once more, white space collapsed."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        parser = _Text()
        parser.feed(text)
        parser.close()
        return " ".join(_html.unescape("".join(parser.parts)).split())

    return texts.map(one)


def clean_markup(text) -> Column:
    """Tags go, references become characters, white space collapses."""
    return collapse(unescape(strip_tags(text)))


def stable_id(prefix: str, *parts) -> Column:
    """``prefix:`` and 20 hex digits of the SHA-256 of the parts, joined by the unit separator; a null part is empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.left(F.sha2(joined, 256), F.lit(20)))


def padded(prefix: str, number, width: int = 4) -> Column:
    """The prefix and the number, with zeros in front up to ``width`` digits; wider numbers keep all theirs."""
    return F.concat(F.lit(prefix), F.format_string(f"%0{width}d", number.cast("long")))


def leading_int(text) -> Column:
    """The number at the start of a text, white space aside; null without one."""
    return F.nullif(F.regexp_extract(text, r"^\s*([0-9]+)", 1), F.lit("")).try_cast("long")


def after_number(text) -> Column:
    """What follows the number at the start, trimmed; null if nothing does."""
    return F.nullif(F.trim(F.regexp_replace(text, r"^\s*[0-9]+", "")), F.lit(""))


def slug(text, fallback: str = "item") -> Column:
    """Lower-case letters and digits, all else one hyphen, none at the ends; ``fallback`` if nothing is left."""
    hyphened = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(hyphened, "^-+|-+$", ""), F.lit("")), F.lit(fallback))


def reference(stem, line) -> Column:
    """``stem_pLINE``; null without a line."""
    return F.concat(stem, F.lit("_p"), line)


def work_slug(work, prefix: str) -> Column:
    """``PREFIX n`` as ``prefixn``; any other name is an error."""
    number = F.regexp_extract(work, rf"^{prefix}\s+(\d+)$", 1)
    wrong = F.raise_error(F.concat(F.lit("unsupported work: "), work))
    return F.when(number == "", wrong.cast("string")).otherwise(F.concat(F.lit(prefix.lower()), number.cast("long").cast("string")))


def blob_url(repository, revision, path) -> Column:
    """Address of a pinned file; a missing revision is empty."""
    return F.concat(F.regexp_replace(repository, r"\.git$", ""), F.lit("/blob/"), F.coalesce(revision, F.lit("")), F.lit("/"), path)


def source_record(repository, revision, project, **paths) -> Column:
    """Provenance of a row: project, revision, and for each named path the path and its pinned address."""
    told = [c for name, path in paths.items() for c in (path.alias(f"{name}_path"), blob_url(repository, revision, path).alias(f"{name}_url"))]
    return F.struct(project.alias("project"), revision.alias("revision"), *told)


def classify_language(default, metadata, override=None, language: str = "san", phrase: str = "buddhist hybrid sanskrit", special: str = "bhs") -> Column:
    """An override wins; then the explicit phrase in metadata of the given language; else the default."""
    told = F.when((default == language) & F.contains(F.lower(metadata), F.lit(phrase)), special).otherwise(default)
    return told if override is None else F.coalesce(override, told)


def names_subject(targets, header, path_mark: str, phrases: list[str]) -> Column:
    """Whether any reference's target has the mark, or the header one of the phrases, case aside."""
    told = F.exists(targets, lambda t: F.contains(F.lower(t), F.lit(path_mark)))
    for phrase in phrases:
        told = told | F.contains(F.lower(header), F.lit(phrase))
    return F.coalesce(told, F.lit(False))


def license_text(label, target) -> Column:
    """``label (target)``, or the one there is, or null; empty texts count as missing."""
    label, target = F.nullif(label, F.lit("")), F.nullif(target, F.lit(""))
    return F.coalesce(F.concat(label, F.lit(" ("), target, F.lit(")")), target, label)


def leaf_kind(leaf_id, template) -> Column:
    """Kind of a leaf by its template, the first that fits in this order."""
    has = lambda pattern: template.rlike(pattern)
    return (
        F.when(has(r"(?i)<h[1-6]\b"), "heading").when(has(r"(?i)<p(?:\s|>)|</p>"), "paragraph_segment").when(F.contains(leaf_id, F.lit(":0.")), "metadata")
        .when(has("<li|</li>"), "list_segment").when(has("<blockquote|</blockquote>"), "blockquote_segment").otherwise("continuation_or_other")
    )


def leaf_marks(template) -> Column:
    """struct<heading, opens, closes> of a leaf's template."""
    return F.struct(template.rlike(r"(?i)<h[1-6]\b").alias("heading"), template.rlike(r"(?i)<p(?:\s|>)").alias("opens"), template.rlike("(?i)</p>").alias("closes"))


def editorial_flags(text) -> Column:
    """struct of three booleans; a supplied passage needs the plain tag, gaps and unclear ones may have attributes."""
    return F.struct(F.contains(text, F.lit("<supplied>")).alias("has_supplied"), F.contains(text, F.lit("<gap")).alias("has_gap"), F.contains(text, F.lit("<unclear")).alias("has_unclear"))


def editorial_features(flags) -> Column:
    """The names of the flags that are set, in order."""
    return F.array_compact(F.array(*[F.when(flags[f"has_{name}"], name) for name in ("supplied", "gap", "unclear")]))


def first_matching(text, forms: list[str]) -> Column:
    """The first of the forms, in their order, that the text contains; null if none is."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(form)), form) for form in forms])


def offset_aware(text) -> Column:
    """Whether a text is an ISO-8601 time with an offset."""
    told = F.trim(text)
    return F.coalesce(F.try_to_timestamp(told).isNotNull() & told.rlike(r"^\d{4}-\d\d-\d\d") & told.rlike(OFFSET), F.lit(False))


def utc_stamp(time) -> Column:
    """A time as text in UTC with the suffix Z; the session's zone must be UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def html_escape(text) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def markdown_cell(text) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def script_safe(text) -> Column:
    """JSON that may stand inside a script element."""
    return F.replace(text, F.lit("</"), F.lit("<\\/"))


def bracketed(text) -> Column:
    """Supplied passages in white square brackets, other tags removed, white space collapsed."""
    return collapse(strip_tags(F.regexp_replace(text, "(?s)<supplied>(.*?)</supplied>", "⟦$1⟧")))


_SUPPLIED = re.compile(r"<supplied>(.*?)</supplied>", re.S)
_TAG = re.compile(r"<[^>]+>")


@F.pandas_udf(StringType())
def supplied_spans(texts: pd.Series) -> pd.Series:
    """Plain text as HTML with supplied passages in spans; pieces are joined by a space."""

    def clean(piece: str) -> str:
        return _html.escape(_html.unescape(" ".join(_TAG.sub("", piece).split())))

    def one(text: str) -> str:
        pieces = _SUPPLIED.split(text or "")  # text, passage, text, ...
        out = [f'<span class="supplied" title="Editorially supplied in the upstream edition">{clean(x)}</span>' if i % 2 else clean(x) for i, x in enumerate(pieces)]
        return " ".join(x for x in out if x)

    return texts.map(one)


def canonical(value) -> str:
    """JSON with sorted keys, without spaces, all characters and nulls kept."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Any JSON text in its canonical form; Spark's own writer drops nulls and rewrites numbers."""
    return texts.map(lambda t: None if t is None else canonical(json.loads(t)))


@F.pandas_udf(StringType())
def json_without(texts: pd.Series, keys: pd.Series, inner: pd.Series, inner_keys: pd.Series) -> pd.Series:
    """A JSON object without some keys (comma-separated), the objects of its array ``inner`` without others, in canonical form."""

    def one(text, drop, array, drop_inside):
        value = {k: v for k, v in json.loads(text).items() if k not in drop.split(",")}
        if array:
            value[array] = [{k: v for k, v in x.items() if k not in drop_inside.split(",")} for x in value.get(array) or []]
        return canonical(value)

    return pd.Series([None if t is None else one(t, k, a, i) for t, k, a, i in zip(texts, keys, inner, inner_keys, strict=True)])


def json_digest(text) -> Column:
    """``sha256:`` and the digest of a JSON text's canonical form."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(text), 256))


def is_digest(text) -> Column:
    return F.coalesce(text.rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))

