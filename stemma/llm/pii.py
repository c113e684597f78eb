"""Personal data: candidate spans judged by boosted trees, with DataFrame functions only.

Generators propose spans of four kinds, some of them overlapping.  Those that pass their kind's base rule (BASE and its
check) are always redacted.  The others are judged: features of a span's format and of the text around it go into
gradient-boosted trees, one model for all kinds with the kind among the features, so that no kind is left without one.

Labels don't come from the base rule, which the trees would only repeat, but from evidence that real data shows and
chance rarely does, and that no feature tells: a card's check digit, an address's parts of at most 255, a word beside
a phone number or a mail address that names it, or a mail domain that a word list of endings knows.  Each candidate has a
chance rate, at which it would show that evidence if it were nothing: 1/10 for check digits, that of random numbers of
the same length for parts, and for words their rate beside candidates of the other kinds.  So among any candidates
(evidence - chance) / (1 - chance), summed up, estimates how many are real.

The trees are fitted on the driver from a bounded sample of candidates (``MAX_ROWS`` rows from ``MAX_DOCS`` documents,
half of the texts by a hash).  Thresholds are calibrated on the candidates of the other half of *all* documents, counted
by kind and score: a kind's threshold is the least score from which PRECISION of the candidates outside the base rule
are real by that estimate, with a prior of one that is not.  A kind for which no score reaches it adds nothing.

Positions come without a row-wise function: ``split`` gives the gaps between a pattern's matches, and lengths add up.
Patterns start where a run of their first characters starts, or where the last match ended (``\\G``), and quantifiers
are possessive, so that long runs cost linear time and no stack.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
#: Leftmost non-overlapping matches; checks follow below.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be meant for the same, more generously; several generators of a kind may overlap.
WIDE = {
    "email": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z]{2,24}+)+",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20(?:at|AT)\x20[A-Za-z0-9-]{1,63}+(?:\x20(?:dot|DOT)\x20[A-Za-z]{2,24}+)+",
    ),
    "ip": (r"(?<![0-9.])[0-9]{1,3}+(?:[.,:][0-9]{1,3}+){3}+(?![0-9])",),
    "card": (r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![0-9])",),
    "phone": (r"(?<![0-9+.])\+?\(?[0-9]{2,4}+\)?[\x20.-][0-9]{3}[\x20.-][0-9]{3,4}+(?![0-9.])", r"(?<![0-9+.])00[0-9]{1,3}+[\x20-]?[0-9]{2,4}+[\x20-]?[0-9]{5,8}+(?![0-9.])"),
}
#: What a text must have for a kind to be looked for at all: any match of the kind's BASE or WIDE has a match of this.
NEEDS = {"email": "@|at[\\])\\x20]|AT\\x20", "ip": "[0-9][.,:][0-9]", "card": "[0-9][\\x20.-]?[0-9]", "phone": "\\+[0-9]|[0-9][\\x20.)-]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
AROUND, MAX_ROWS, MAX_DOCS, PRECISION = 24, 20_000, 40_000, 0.95
ROUNDS, RATE, LEAST_LEAF = 24, 0.4, 10
#: Scores are counted in steps of one in so many.
STEP = 8
#: Words that name a kind; they are evidence, never a feature.  Mail endings that are too common for chance.
_CUES = {"email": r"mail|contact|write\b|reach", "phone": r"phone|\btel|call|\bfax|mobile|dial"}
_ENDINGS = r"(?i)(?:com|org|net|edu|gov|info)$"
FEATURES = ("kind", "length", "digits", "marks", "spaces", "first", "runs", "before", "after", "capital_before", "upper", "distinct")


def _passes(kind: str, match):
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _matches(text, kind: str, pattern: str):
    """array<struct<match, start, end>> of a pattern's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<match:string,start:int,end:int>>")
    pairs = F.arrays_zip(found.alias("match"), F.transform(gaps, lambda g: F.char_length(g)).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.char_length(x["match"]), F.lit(0))
        one = F.array(F.struct(x["match"].alias("match"), begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["match"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.when(text.rlike(NEEDS[kind]) & text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(empty)


def base_spans(text, kind: str):
    return F.filter(_matches(text, kind, BASE[kind]), lambda x: _passes(kind, x["match"]))


def _features(text, kind: str, x):
    match, last = x["match"], F.substring(text, x["start"], F.when(x["start"] > 0, 1).otherwise(0))
    after = F.substring(text, x["end"] + 1, F.lit(1))
    digits = F.regexp_replace(match, "[^0-9]", "")
    kind_of = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z]"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)
    before = F.substring(text, F.greatest(F.lit(1), x["start"] + 1 - AROUND), F.least(x["start"], F.lit(AROUND)))
    values = {
        "kind": F.lit(KINDS.index(kind)), "length": F.char_length(match), "digits": F.length(digits), "marks": F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")), "spaces": F.length(F.regexp_replace(match, r"[^\x20]", "")),
        "first": F.coalesce(F.try_to_number(F.left(digits, F.lit(1)), F.lit("9")).cast("int"), F.lit(-1)) if kind != "ip" else F.lit(-1), "runs": F.size(F.split(match, "[^0-9A-Za-z]+")), "before": kind_of(last), "after": kind_of(after),
        "capital_before": before.rlike(r"[A-Z][a-z]*[\s:]*$").cast("int"), "upper": (F.upper(before) == before).cast("int"), "distinct": F.size(F.array_distinct(F.split(digits, ""))),
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


def _evidence(text, kind: str, x):
    """struct<seen, chance>: whether the candidate shows its kind's evidence, and how often nothing would; null chance: the cues' rate elsewhere."""
    match = x["match"]
    if kind == "card":
        return F.struct(F.call_function("luhn_check", F.regexp_replace(match, "[^0-9]", "")).alias("seen"), F.lit(0.1).alias("chance"))
    if kind == "ip":
        parts = F.split(match, "[^0-9]")
        chance = F.aggregate(parts, F.lit(1.0), lambda p, part: p * F.when(F.length(part) < 3, 1.0).otherwise(156 / 900))  # 100 to 255 of 100 to 999
        return F.struct(F.forall(parts, lambda part: part.cast("int") <= 255).alias("seen"), chance.alias("chance"))
    named = _cue(text, kind, x)
    return F.struct((named | match.rlike(_ENDINGS) if kind == "email" else named).alias("seen"), F.lit(None).cast("double").alias("chance"))


def _cue(text, kind: str, x):
    """Whether a word before a span names the kind."""
    return F.lower(F.substring(text, F.greatest(F.lit(1), x["start"] + 1 - AROUND), F.least(x["start"], F.lit(AROUND)))).rlike(_CUES[kind])


def candidates(text, kind: str):
    """array<struct<start, end, match, base>>: base spans, and wide matches that meet none of them, which may overlap each other."""
    base = base_spans(text, kind)
    told = lambda flag: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), F.lit(flag).alias("base"))

    def with_wide(b):
        wide = F.array_distinct(F.flatten(F.array(*[_matches(text, kind, w) for w in WIDE[kind]])))
        apart = F.filter(wide, lambda w: ~F.exists(b, lambda x: (x["start"] < w["end"]) & (w["start"] < x["end"])))
        return F.concat(F.transform(b, told(True)), F.transform(apart, told(False)))

    return F.transform(F.array(base), with_wide)[0]  # base spans are found once


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple]]:
    """Gradient boosting of depth-2 trees for the logistic loss, labels from (1 - 0) to a little below 0: the start and (feature, cut, (f, cut, a, b), (f, cut, a, b))."""
    start = float(np.log((max(y.sum(), 0) + 1) / (max(len(y) - y.sum(), 0) + 1)))
    odds, trees = np.full(len(y), start), []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 19))) for j in range(x.shape[1])]

    def split(rows: np.ndarray, slope: np.ndarray, curve: np.ndarray):
        best = (0.0, 0, float("inf"))
        g, h = slope[rows].sum(), curve[rows].sum() + 1
        for j, options in enumerate(cuts):
            for c in options.tolist():
                left = x[rows, j] <= c
                n = int(left.sum())
                if LEAST_LEAF <= n <= len(rows) - LEAST_LEAF:
                    gl, hl = slope[rows][left].sum(), curve[rows][left].sum() + 1
                    gain = gl * gl / hl + (g - gl) ** 2 / (h - hl + 2) - g * g / h
                    if gain > best[0] + 1e-9:
                        best = (gain, j, c)
        return best[1:]

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-odds))
        slope, curve = y - p, p * (1 - p)
        rows = np.arange(len(y))
        j, c = split(rows, slope, curve)
        sides = []
        for part in (rows[x[:, j] <= c], rows[x[:, j] > c]):
            k, d = split(part, slope, curve) if len(part) else (0, float("inf"))
            values = []
            for leaf in (part[x[part, k] <= d], part[x[part, k] > d]):
                value = RATE * float(slope[leaf].sum() / (curve[leaf].sum() + 1)) if len(leaf) else 0.0
                odds[leaf] += value
                values.append(value)
            sides.append((k, d, *values))
        trees.append((j, c, *sides))
    return start, trees


def tree_score(model: tuple[float, list[tuple]], f):
    """The model as a column expression over a struct of features."""

    def below(j: int, cut: float):
        return F.lit(True) if cut == float("inf") else f[FEATURES[j]] <= cut

    total = F.lit(model[0])
    for j, c, *sides in model[1]:
        leaves = [F.when(below(k, d), F.lit(a)).otherwise(F.lit(b)) for k, d, a, b in sides]
        total = total + F.when(below(j, c), leaves[0]).otherwise(leaves[1])
    return total


def numpy_score(model: tuple[float, list[tuple]], x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), model[0])
    for j, c, left, right in model[1]:
        sides = [np.where(x[:, k] <= d, a, b) for k, d, a, b in (left, right)]
        total += np.where(x[:, j] <= c, sides[0], sides[1])
    return total


_ROW = "array<struct<kind:string,base:boolean,seen:boolean,chance:double,near_email:boolean,near_phone:boolean,f:struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">>>"


def _rows(text):
    """All candidates of a text with evidence and features."""
    return F.array_union(F.array().cast(_ROW), F.flatten(F.array(*[F.transform(candidates(text, k), _row(k)) for k in KINDS])))


def _row(kind: str):
    def row(x):
        told = _evidence(F.col("text"), kind, x)
        return F.struct(F.lit(kind).alias("kind"), x["base"].alias("base"), F.coalesce(told["seen"], F.lit(False)).alias("seen"), told["chance"].alias("chance"), _cue(F.col("text"), "email", x).alias("near_email"), _cue(F.col("text"), "phone", x).alias("near_phone"), _features(F.col("text"), kind, x).alias("f"))

    return row


def _real(seen: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Unbiased estimates, one by one, of whether candidates are real."""
    return (seen - chance) / (1 - np.minimum(chance, 0.999))


def fit(docs: DataFrame) -> tuple[tuple[float, list[tuple]], dict[str, float]]:
    """The trees, and the threshold of each kind that has one that holds; see the module's text."""
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    may = docs.filter(F.col("text").rlike("[0-9@]|(?i)at[\\])\\x20]")).select("text", place.alias("place"))
    n = may.count()
    some = may.filter((F.col("place") % 2 == 0) & (F.col("place") < int((1 << 20) * min(1.0, 2 * MAX_DOCS / max(n, 1)))))
    told = some.select("place", F.explode(_rows(F.col("text"))).alias("x")).groupBy("place", "x").count().orderBy("place", F.col("x").cast("string")).limit(MAX_ROWS).collect()
    if not told:
        return (0.0, []), {}
    seen = np.array([r.x.seen for r in told], float)
    # a cue's rate beside candidates of kinds that it doesn't name, with one hit and one miss added
    by_luck = {}
    for kind in _CUES:
        elsewhere = [r.x[f"near_{kind}"] for r in told if r.x.kind != kind]
        by_luck[kind] = min(0.5, (1 + sum(elsewhere)) / (2 + len(elsewhere)))
    chance = np.array([by_luck[r.x.kind] if r.x.chance is None else r.x.chance for r in told], float)
    model = boost(np.array([list(r.x.f) for r in told], float), _real(seen, chance))
    score = F.floor(tree_score(model, F.col("x.f")) * STEP)
    luck = F.coalesce("x.chance", *[F.when(F.col("x.kind") == k, c) for k, c in by_luck.items()])
    other = may.filter("place % 2 = 1").select(F.explode(_rows(F.col("text"))).alias("x")).filter("NOT x.base")
    counted = other.select(F.col("x.kind").alias("kind"), score.alias("score"), F.col("x.seen").cast("double").alias("seen"), luck.alias("chance")).groupBy("kind", "score")
    cells = counted.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("seen") - F.col("chance")) / (1 - F.least("chance", F.lit(0.999)))).alias("real")).collect()  # kinds times steps of scores
    return model, thresholds([(r.kind, r.score, r.n, r.real) for r in cells])


def thresholds(cells: list[tuple[str, int, int, float]]) -> dict[str, float]:
    """For each kind the least score from which PRECISION of the candidates are real, from (kind, step, number, real ones)."""
    out = {}
    for kind in KINDS:
        n = real = 0.0
        for _, step, more, of in sorted((c for c in cells if c[0] == kind), key=lambda c: -c[1]):
            n, real = n + more, real + of
            if real / (n + 1) >= PRECISION:
                out[kind] = step / STEP
    return out


def spans(docs: DataFrame, models: tuple) -> DataFrame:
    """``docs`` with a column ``found``: array<struct<start, kind_at, end, kind, base>> in order of start, then kind."""
    model, least = models
    columns = []
    for at, kind in enumerate(KINDS):
        if kind in least:
            found = _chosen(F.col("text"), kind, model, least[kind])
        else:
            found = F.transform(base_spans(F.col("text"), kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), F.lit(True).alias("base")))
        columns.append(F.transform(found, _span(at, kind)))
    digits = F.col("text").rlike("[0-9@]|(?i)at[\\])\\x20]")
    empty = F.array().cast("array<struct<start:int,kind_at:int,end:int,kind:string,base:boolean>>")
    return docs.withColumn("found", F.when(digits, F.array_sort(F.flatten(F.array(*columns)))).otherwise(empty))


def _chosen(text, kind: str, model, least: float):
    """Base spans and the candidates whose score suffices; of candidates that overlap the better one, or the first of equals."""
    scored = F.transform(candidates(text, kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), x["base"].alias("base"), tree_score(model, _features(text, kind, x)).alias("score")))
    good = lambda rows: F.filter(rows, lambda x: x["base"] | (x["score"] >= least))

    def best(rows):
        beaten = lambda x: F.exists(rows, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & ((y["score"] > x["score"]) | ((y["score"] == x["score"]) & ((y["start"] < x["start"]) | ((y["start"] == x["start"]) & (y["end"] > x["end"]))))))
        return F.filter(rows, lambda x: x["base"] | ~beaten(x))

    return F.transform(F.array(good(scored)), best)[0]


def _span(at: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(at).alias("kind_at"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["base"].alias("base"))


def redacted(text, found):
    """The text with every span replaced by its kind in brackets; spans that overlap are one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), new.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, rest)).otherwise(text)


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, found, rest), ``rest`` a struct of the other columns; see ``spans``.

    A null text is empty and has no spans.  Repeated rows are judged alike; an empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in (id_column, text_column)]
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("rest"))
    return spans(rows, fit(rows.select("text")))


def _told(found):
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document; a null text has none."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    base = F.filter("found", lambda x: x["base"])
    counts = [F.size(F.filter("found", _is_base(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("found")).alias("spans"))


def _is_base(kind: str):
    return lambda x: x["base"] & (x["kind"] == kind)


QUERIES = {"op7_pii": op7_pii}
ORACLE: dict[str, str] = {}
