"""Quality rules with risk-controlled thresholds.

Each document has some signals, larger meaning worse.  A signal has a fixed grid of cutoffs, from the most lenient
down.  On labelled documents a rule's false rejections are the good documents above it; it is certified if an exact
binomial test rejects "the rate of false rejections is over the rate allowed", that is if the Clopper-Pearson upper
bound is below that rate.  Within a path of ever stricter rules these are tested from the most lenient on until one
fails (fixed sequence), which needs no split of the error.  A stratum (the language) has two sorts of tests, which
share its error, DELTA / (strata + 1), in halves:

* one for each signal's grid at the rate ALPHA / signals, the half split again over the signals;
* a joint one at the rate ALPHA, along a path of cutoffs for all signals at once, which needs far fewer labels.  The
  path ends at the cutoffs that the labels of the *other* strata suggest, so that it does not depend on the labels that
  test it; where they suggest none, it is the grids' common index.

With probability 1 - DELTA no stratum therefore loses more than ALPHA of its good documents to thresholds of its own.
Of the certified rules of a path the one that sets apart most bad from good documents is used, the most lenient of
equals, and so of the two sorts.  A stratum whose labels certify neither takes the cutoffs that all strata pooled
certify by the same tests (the pool has a share of the error too), save those that more than ALPHA / signals of its own
good documents exceed; their bound holds over the pool, not for that stratum alone.  A stratum without good labels,
about which the pool says nothing, has no thresholds, nor has any if the pool too has too few labels.

Labels and grids are counted in one aggregation; a group of strata's counts is a few hundred numbers however many
documents there are.  Both read the labelled documents' places on the grids from a scratch table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

ALPHA, DELTA = 0.02, 0.05
SIGNALS = ("symbols", "marks", "capitals", "repeats", "repeated_lines", "long_words")
#: Name of the number of cutoffs that a document's worst signal exceeds, beside those of the signals.
JOINT = "joint"
#: Cutoffs of a signal, most lenient first: this many, each a fixed part of the one before it.
STEPS, RATIO = 48, 0.9
#: A signal's most lenient cutoff.
TOP = {"symbols": 8.0, "marks": 8.0, "capitals": 1.0, "repeats": 1.0, "repeated_lines": 1.0, "long_words": 60.0}
#: Strata whose thresholds are sent to all tasks; with more of them they are joined by a shuffle.
MOST_SENT = 10_000
_WIDTH = 5
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FEATURES = ", ".join([*[f"{c} long" for c in COUNTS], *[f"s_{s} double" for s in SIGNALS]])


def repeated_words(code: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text the words inside a window of five that the text has twice or more.  ``code`` numbers the words."""
    n = len(code)
    owner = np.repeat(np.arange(len(counts)), counts)
    covered = np.zeros(n + 1, np.int64)
    if n >= _WIDTH:
        inside = owner[: n - _WIDTH + 1] == owner[_WIDTH - 1 :]
        start = np.flatnonzero(inside)
        word = code.astype(np.uint64) + np.uint64(1)
        key = owner[start].astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
        for i in range(_WIDTH):
            key += word[start + i] * _MULTIPLIERS[i]
        order = np.argsort(key)
        equal = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(start), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        hit = start[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + _WIDTH, -1)
    return np.bincount(owner[np.cumsum(covered[:-1]) > 0], minlength=len(counts))


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    raw = [t.encode() for t in texts]
    split = [b.split() for b in raw]
    n_words = np.array([len(w) for w in split], np.int64)
    numbered = pc.dictionary_encode(pa.array([x for w in split for x in w], pa.large_binary())).indices.to_numpy(zero_copy_only=False)
    found = [[x for x in b.split(b"\n") if x.strip()] for b in raw]
    n_lines = np.array([len(x) for x in found], np.int64)
    out = {
        "n_words": n_words,
        "word_chars": np.array([len(t) - (len(b) - len(b.translate(None, b" \t\n\x0b\x0c\r"))) for t, b in zip(texts, raw, strict=True)], np.int64),
        "n_symbols": np.array([len(b) - len(b.translate(None, b"#*$%&|<>")) for b in raw], np.int64),
        "n_dup_lines": n_lines - np.array([len(set(x)) for x in found], np.int64),
        "n_repeat_words": repeated_words(numbered, n_words).astype(np.int64),
    }
    some = np.maximum(n_words, 1)
    capitals = np.array([len(b) - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for b in raw])
    marks = np.array([b.count(b"!") + b.count(b"?") for b in raw])
    return out | {
        "s_symbols": out["n_symbols"] / some, "s_marks": marks / some, "s_capitals": capitals / np.maximum(out["word_chars"], 1),
        "s_repeats": out["n_repeat_words"] / some, "s_repeated_lines": out["n_dup_lines"] / np.maximum(n_lines, 1),
        "s_long_words": out["word_chars"] / some,
    }


def features(rows: DataFrame, text_at: int) -> DataFrame:
    """The rows with the counts and signals of the text in column number ``text_at`` after their own columns."""
    fields = rows.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                found = measure(pc.fill_null(part.column(text_at), "").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, found.values())], [*part.schema.names, *found])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], _FEATURES]))


def grid(signal: str) -> list[float]:
    return [TOP[signal] * RATIO**i for i in range(STEPS)]


def _exceeded(signal: str):
    """How many cutoffs of its grid a signal exceeds."""
    value = F.col(f"s_{signal}")
    return F.size(F.filter(F.array(*map(F.lit, grid(signal))), lambda cutoff: value > cutoff))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed."""
    i = np.arange(k + 1)
    lg = math.lgamma
    logs = np.array([lg(n + 1) - lg(x + 1) - lg(n - x + 1) for x in i.tolist()]) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(logs).sum()))


def choose(good: np.ndarray, bad: np.ndarray, rate: float, error: float) -> int | None:
    """Index of the cutoff to use.  ``good[i]``, ``bad[i]``: documents that exceed i cutoffs of the grid exactly.

    A grid descends, so a document above the cutoff i is above all later ones: it exceeds those from i on.
    """
    n = int(good.sum())
    # a document that exceeds c cutoffs of a descending grid exceeds the last c, that is cutoffs STEPS - c and later
    above = lambda x: np.array([x[STEPS - i :].sum() for i in range(STEPS)])
    false, true = above(good), above(bad)
    best, most = None, 0
    for i in range(STEPS):
        if not n or false[i] > n * rate or binomial_tail(int(false[i]), n, rate) > error:
            break
        if true[i] - false[i] > most:
            best, most = i, int(true[i] - false[i])
    return best


def marginal(cells: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each signal, and JOINT, how many good and bad documents exceed 0, 1, ... cutoffs, from (signal, over, good, bad)."""
    out = {s: (np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)) for s in (*SIGNALS, JOINT)}
    for signal, of in cells.groupby("signal"):
        for counts, sort in zip(out[signal], ("good", "bad"), strict=True):
            np.add.at(counts, of["over"].to_numpy(), of[sort].to_numpy())
    return out


def separate(counts: dict, alpha: float, error: float) -> dict[str, int]:
    """Indices of the cutoffs that hold signal by signal; ``error`` is that of all signals."""
    found = {s: choose(*counts[s], alpha / len(SIGNALS), error / len(SIGNALS)) for s in SIGNALS}
    return {s: at for s, at in found.items() if at is not None}


def pooled(counts: dict, alpha: float, error: float) -> dict[str, int]:
    """Indices of the cutoffs certified on the pool: signal by signal, or if there are none, at a common index."""
    found = separate(counts, alpha, error / 2)
    common = None if found else choose(*counts[JOINT], alpha, error / 2)
    return found if common is None else dict.fromkeys(SIGNALS, common)


def calibrate(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, basis, cutoffs map<signal, double>) from (doc_id, text, lang) and (doc_id, quality).

    ``basis`` tells which labels certify the cutoffs: 'signals' or 'joint' those of the stratum, 'pool' those of all
    strata, 'none' none.  Of several labels for an id the worst counts; labels without an id or value are no labels.
    Rows without a language are a stratum of their own.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = features(docs.select("doc_id", F.col("lang").cast("string").alias("stratum"), F.col("text").cast("string").alias("text")), 2).drop("text", *COUNTS)
    over = [_exceeded(s).alias(s) for s in SIGNALS]
    labelled = materialise(rows.join(known, "doc_id").select(F.coalesce("stratum", F.lit("")).alias("stratum"), (F.col("quality") > 0).alias("is_good"), *over), "labelled")
    tally = [F.count_if("is_good").alias("good"), F.count_if(~F.col("is_good")).alias("bad")]
    places = {s: F.col(s) for s in SIGNALS} | {JOINT: F.greatest(*SIGNALS)}
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), at.alias("over")) for s, at in places.items()]))
    counted = labelled.select("stratum", "is_good", cells.alias("c")).groupBy("stratum", "c.signal", "c.over").agg(*tally)
    error = delta / (counted.select("stratum").distinct().count() + 1)
    total = marginal(counted.groupBy("signal", "over").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas())
    pool = pooled(total, alpha, error)

    def propose(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        own = marginal(cells)
        others = {s: (total[s][0] - own[s][0], total[s][1] - own[s][1]) for s in own}
        n = own[JOINT][0].sum()
        # a path only suggests, so its end needs no certificate: an error of 1 a signal asks for no more than the rate
        lent = {s: at for s, at in pool.items() if n and own[s][0][STEPS - at :].sum() <= n * alpha / len(SIGNALS)}
        path = separate(others, alpha, len(SIGNALS)) or dict.fromkeys(SIGNALS, STEPS - 1)
        return pd.DataFrame({"stratum": [key[0]], "own": [separate(own, alpha, error / 2)], "path": [path], "lent": [lent]})

    def reach(cutoffs: str):
        """How many rules a document exceeds of the path that ends at these cutoffs, each rule one index stricter."""
        each = [F.when(F.col(s) > 0, F.element_at(cutoffs, F.lit(s)) + F.col(s) - STEPS + 1) for s in SIGNALS]
        return F.coalesce(F.least(F.greatest(*each, F.lit(0)), F.lit(STEPS)), F.lit(0))

    def certify(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        own, path, lent = (dict(cells[c].iloc[0]) for c in ("own", "path", "lent"))
        good, bad = (np.bincount(cells["over"], cells[c], STEPS + 1).astype(np.int64) for c in ("good", "bad"))
        at = choose(good, bad, alpha, error / 2)
        rules = {"signals": (int((cells["bad"] - cells["good"])[cells["hit"]].sum()), own)} if own else {}
        if at is not None:
            shifted = {s: i - (STEPS - 1 - at) for s, i in path.items()}
            rules["joint"] = (int(bad[STEPS - at :].sum() - good[STEPS - at :].sum()), {s: i for s, i in shifted.items() if i >= 0})
        if not rules:
            rules["pool" if lent else "none"] = (0, lent)
        basis = max(rules, key=lambda name: rules[name][0])  # the first of equals
        return pd.DataFrame({"stratum": [key[0]], "basis": [basis], "cutoffs": [{s: grid(s)[i] for s, i in rules[basis][1].items()}]})

    ways = "map<string,int>"
    proposed = counted.groupBy("stratum").applyInPandas(propose, f"stratum string, own {ways}, path {ways}, lent {ways}")
    met = labelled.join(proposed, "stratum").select("stratum", "own", "path", "lent", "is_good", reach("path").alias("over"), (reach("own") > 0).alias("hit"))
    told = met.groupBy("stratum", "over", "hit").agg(*[F.first(c).alias(c) for c in ("own", "path", "lent")], *tally)
    return told.groupBy("stratum").applyInPandas(certify, "stratum string, basis string, cutoffs map<string,double>")


def judge(docs: DataFrame, cutoffs: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang") -> DataFrame:
    """(doc_id, text, the counts, base_failed, kept, rest), ``rest`` a struct of the other columns.

    A null text has no words and fails the base rules; so does an empty one.  A row of a stratum without any
    cutoffs is kept unless the base rules fail.  Repeated rows are judged alike; an empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in (id_column, text_column)]
    rows = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"), F.coalesce(F.col(f"`{stratum_column}`").cast("string"), F.lit("")).alias("stratum"),
        F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("rest"),
    )
    small = cutoffs.limit(MOST_SENT + 1).count() <= MOST_SENT
    cutoffs = cutoffs.select("stratum", "cutoffs")
    joined = features(rows, 1).join(F.broadcast(cutoffs) if small else cutoffs, "stratum", "left")
    over = F.lit(False)
    for s in SIGNALS:
        over = over | F.coalesce(F.col(f"s_{s}") > F.element_at("cutoffs", F.lit(s)), F.lit(False))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select("doc_id", "text", *COUNTS, failed.alias("base_failed"), (~failed & ~over).alias("kept"), "rest")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``judge`` with thresholds calibrated on the same table."""
    return judge(docs, materialise(calibrate(docs, labels), "cutoffs"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; see ``judge``."""
    judged = filter_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")


QUERIES = {"op8_quality": op8_quality}
ORACLE: dict[str, str] = {}
