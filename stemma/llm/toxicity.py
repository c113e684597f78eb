"""Toxicity by weak supervision.

Voters look at a text and fire or abstain: one for each word, or beginning of words, of a mined lexicon and one for each of a few patterns.
A generative model of the votes, a two-class mixture fitted by EM without labels, estimates how often each voter fires
on toxic and on other texts; voters whose votes still correlate once the class is accounted for are told as one, each
with a part of the weight.  Its posteriors are the labels of a logistic regression over hashed words and votes.

The lexicon is mined from the labels of a bounded sample (``MAX_ROWS`` labelled rows, never one whose crc32 of the id
is 2 modulo 4), the class balance comes from the same rows, and the rest needs no label.  A beginning of words may vote
when two words or more of a text have it.  The fitted model is a vector of 2 ** BITS weights and the lexicon; scoring is
one pass over all texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .shingles import words

MAX_ROWS, BITS, THRESHOLD = 12_000, 16, 0.3
#: Texts whose words are taken at once.
PART = 1000
#: A lexicon word's least number of toxic texts, least likelihood-ratio statistic, and how many times oftener it must
#: stand in toxic texts.  Chosen by threefold cross-validation within the learning rows of sf0.1 (README).
LEAST_SUPPORT, LEAST_EVIDENCE, LEAST_RATIO = 3, 18.0, 20
ROUNDS, RESIDUAL, EPOCHS = 40, 0.2, 120
#: Letters of the beginnings that count as words too, so that a lexicon holds inflected and compound words.
STEMS = (5, 7)
_EDGE = re.compile(r"^\W+|\W+$")
#: Voters that look at the form of a text: name and the least value at which they fire.
PATTERNS = (("capitals", 0.5), ("marks", 0.25), ("symbols", 0.25), ("short", 1.0))


def held_out(column):
    return F.crc32(column.cast("string").cast("binary")) % 4 == 2


def distinct_words(texts: pa.Array, plain: dict[str, int] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words without punctuation around them, their beginnings (``rude*``) and beginnings that two words or more of the text have (``rude**``);
    each text's distinct ones as indices; and the texts these belong to.

    Numbers go on from those in ``plain``, if it is given.
    """
    found, code, counts = words(texts)
    plain = {} if plain is None else plain
    bare = [_EDGE.sub("", w) for w in found.to_pylist()]
    number = lambda name: plain.setdefault(name, len(plain))
    of = np.array([[number(w[:k] + "*" * (len(w) > k)) for k in (len(w), *STEMS)] for w in bare], np.int64).reshape(-1, 1 + len(STEMS))
    if not len(code):
        return list(plain), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = max(1, len(plain))
    text = np.repeat(np.arange(len(counts)), counts)
    _, one = np.unique(text * size + of[code, 0], return_index=True)  # a word of a text once
    text, code = text[one], code[one]
    parts = [text * size + of[code, 0]]
    names = list(plain)
    for k in range(1, 1 + len(STEMS)):
        held, times = np.unique(text * size + of[code, k], return_counts=True)
        parts.append(held)
        held = held[times > 1]
        stems, at = np.unique(held % size, return_inverse=True)
        again = np.array([number(names[x] + "*") if names[x].endswith("*") else x for x in stems.tolist()], np.int64)
        parts.append(np.stack([held // size, again[at]]) if len(held) else np.zeros((2, 0), np.int64))
    size, wide = max(1, len(plain)), size
    pairs = np.unique(np.concatenate([x // wide * size + x % wide if x.ndim == 1 else x[0] * size + x[1] for x in parts]))
    return list(plain), pairs % size, pairs // size


def patterns(texts: list[str]) -> np.ndarray:
    """One row for each text: which pattern voters fire."""
    out = np.zeros((len(texts), len(PATTERNS)), bool)
    for i, text in enumerate(texts):
        raw = text.encode()
        n = max(1, len(raw.split()))
        letters = max(1, len(text) - text.count(" "))
        values = (
            (len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / letters, (raw.count(b"!") + raw.count(b"?")) / n,
            (len(raw) - len(raw.translate(None, b"#*$%&|<>"))) / n, float(n < 10),
        )
        out[i] = [v >= least for v, (_, least) in zip(values, PATTERNS, strict=True)]
    return out


def mine_lexicon(names: list[str], bad: np.ndarray, good: np.ndarray, n: int, m: int) -> list[str]:
    """Words that stand in toxic texts (``bad`` of n) LEAST_RATIO times as often as in others (``good`` of m), by a
    likelihood-ratio test, surest first."""
    scored = []
    for at in np.flatnonzero((bad >= LEAST_SUPPORT) & (bad * m > LEAST_RATIO * good * n)).tolist():
        k, g = int(bad[at]), int(good[at])
        share = (k + g) / (n + m)
        gain = sum(c * math.log(c / e) for c, e in ((k, n * share), (n - k, n - n * share), (g, m * share), (m - g, m - m * share)) if c and e)
        if names[at] and 2 * gain > LEAST_EVIDENCE:
            scored.append((gain, names[at]))
    return [w for _, w in sorted(scored, reverse=True)]


def first_of_kind(codes: np.ndarray, ends: np.ndarray, bands: int = 4, wide: int = 6) -> np.ndarray:
    """False for a text that shares a band of min-hashes of its words with an earlier one: copies prove nothing twice.

    ``codes`` holds all texts' word hashes, text after text, up to ``ends`` each.
    """
    odd = np.random.default_rng(1).integers(1, 1 << 62, bands * wide, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    met: set[tuple] = set()
    out = np.ones(len(ends), bool)
    for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)):
        if b - a >= 10:
            least = ((codes[a:b, None] + np.uint64(1)) * odd >> np.uint64(20)).min(axis=0)
            keys = [(k, *least[k * wide : (k + 1) * wide].tolist()) for k in range(bands)]
            out[i] = not any(k in met for k in keys)
            met.update(keys)
    return out


def label_model(votes: np.ndarray, balance: float) -> np.ndarray:
    """Posterior probability of the toxic class for every row of a boolean vote matrix.

    A voter that abstains says nothing by itself, as most speak for one language only; that all abstain counts once.
    """
    n, m = votes.shape
    v = np.concatenate([votes, ~votes.any(axis=1, keepdims=True)], axis=1).astype(float)
    start = v[:, : max(1, m - len(PATTERNS))].sum(axis=1)
    posterior = np.where(start > 0, 0.9, balance / 10)
    prior = min(max(balance, 1e-3), 0.5)

    def judge(fires: np.ndarray, weight: np.ndarray) -> np.ndarray:
        odds = math.log(prior / (1 - prior)) + v @ (weight * (np.log(fires[1]) - np.log(fires[0])))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    for _ in range(ROUNDS):
        fires = np.stack([((1 - posterior) @ v + 0.1) / ((1 - posterior).sum() + 0.2), (posterior @ v + 0.1) / (posterior.sum() + 0.2)])
        posterior = judge(fires, np.ones(m + 1))
    rest = v - np.outer(posterior, fires[1]) - np.outer(1 - posterior, fires[0])  # what the classes don't explain
    rest /= np.maximum(rest.std(axis=0), 1e-9)
    alike = np.abs(rest.T @ rest / n)
    np.fill_diagonal(alike, 0)
    alike[m] = alike[:, m] = 0
    return judge(fires, 1 / (1 + np.where(alike > RESIDUAL, alike, 0).sum(axis=1)))


class Model:
    """Weights of the linear classifier; index 0 .. 2**BITS - 1 are hashed words, then votes, then the constant."""

    def __init__(self, lexicon: list[str], weights: np.ndarray):
        self.lexicon, self.weights = {w: i for i, w in enumerate(lexicon)}, weights

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return feature_rows(texts, self.lexicon)

    def score(self, texts: pa.Array) -> np.ndarray:
        index, owner = self.rows(texts)
        odds = np.bincount(owner, self.weights[index], len(texts)) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def feature_rows(texts: pa.Array, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    found, word, owner = distinct_words(texts)
    base = 1 << BITS
    hashed = np.array([zlib.crc32(w.encode()) & (base - 1) for w in found], np.int64)
    vote = np.array([lexicon.get(w, -1) for w in found], np.int64)
    fires = patterns(texts.to_pylist())
    row, which = np.nonzero(fires)
    voted = np.flatnonzero(vote[word] >= 0) if len(word) else np.zeros(0, np.int64)
    index = np.concatenate([hashed[word] if len(word) else word, base + len(PATTERNS) + vote[word[voted]] if len(word) else word, base + which])
    return index, np.concatenate([owner, owner[voted], row])


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """A model from labelled texts, in an order that doesn't depend on their labels.

    Without a toxic text, or without any word that tells them apart, every text gets the share of toxic labels.
    """
    base = 1 << BITS
    share = float(toxic.mean()) if len(toxic) else 0.0
    constant = np.zeros(base + len(PATTERNS) + 1)
    constant[-1] = math.log(max(share, 1e-4) / max(1 - share, 1e-4))
    plain: dict[str, int] = {}
    parts = []
    for first in range(0, len(texts), PART):
        _, word, owner = distinct_words(pa.array(texts[first : first + PART], pa.string()), plain)
        parts.append((word.astype(np.int32), (owner + first).astype(np.int32)))
    if not parts:
        return Model([], constant)
    word, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    names = list(plain)
    codes = np.array([zlib.crc32(w.encode()) for w in names], np.uint64)
    own = first_of_kind(codes[word], np.searchsorted(owner, np.arange(len(texts)), "right"))
    bad, good = (np.bincount(word[(own & y)[owner]], minlength=len(names)) for y in (toxic, ~toxic))
    lexicon = mine_lexicon(names, bad, good, int((own & toxic).sum()), int((own & ~toxic).sum()))
    if not lexicon:
        return Model([], constant)
    column = np.full(len(names), -1)
    column[[plain[w] for w in lexicon]] = np.arange(len(lexicon))
    voted = np.flatnonzero(column[word] >= 0)
    votes = np.zeros((len(texts), len(lexicon)), bool)
    votes[owner[voted], column[word[voted]]] = True
    del word, owner, names, plain, codes, parts
    posterior = label_model(np.concatenate([votes, patterns(texts)], axis=1), share)
    model = Model(lexicon, np.zeros(base + len(PATTERNS) + len(lexicon) + 1))
    parts = []
    for first in range(0, len(texts), PART):
        index, row = model.rows(pa.array(texts[first : first + PART], pa.string()))
        parts.append((index.astype(np.int32), (row + first).astype(np.int32)))
    index, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    weights, squares = model.weights, np.full(len(model.weights), 1e-8)
    rate = np.full(len(weights), 0.0005)
    rate[base:] = 0.1  # votes and the constant are few and common, words many and rare
    for _ in range(EPOCHS):
        odds = np.bincount(row, weights[index], len(texts)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - posterior) / len(texts)
        slope = np.bincount(index, error[row], len(weights))
        slope[-1] = error.sum()
        slope += 1e-6 * weights
        squares = squares * 0.9 + slope * slope
        weights -= rate * slope / np.sqrt(squares)
    return model


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """At most about ``most`` labelled texts to learn from, chosen and ordered by a hash of the id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    few = known.filter(place < int((1 << 30) * min(1.0, most / max(n, 1))))
    known_texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = known_texts.join(F.broadcast(few), "doc_id").select("doc_id", "toxic", "text", place.alias("place"))
    got = sorted(rows.toLocalIterator(), key=lambda r: (r.place, r.doc_id, r.text))
    return [r.text for r in got], np.array([r.toxic > 0 for r in got], bool)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of every row.  A null or empty text is scored as a text without words; equal texts score alike;
    an empty table gives no rows; other columns are not read."""
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(pc.fill_null(part.column(1), "")))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """A score of every document; a null or empty text is scored as one without words, a row without an id is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(*sample(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE: dict[str, str] = {}
