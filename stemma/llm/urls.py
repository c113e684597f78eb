"""URL filter: rules first, then segmented host and path words in a naive Bayes model.

Host labels are often words written together.  A unigram model of the words of all pages splits each into the words of
the greatest joint probability (Viterbi).  The words of host and path are the tokens of a multinomial naive Bayes
model, whose labelled rows are the urls that a rule decides; it judges the urls that none does.

What a rule itself looks at (its host's labels, its path's words) is no token, else the model would only repeat the
rules and judge a url by its top-level domain.  For the same reason only top-level domains that have urls of both
verdicts teach: there blocked and allowed urls can be compared; elsewhere a site's name would only stand for its domain.
Nor do the rules' shares of verdicts count, as they say nothing of
other urls: a url is blocked if its tokens are likelier in blocked than in allowed ones, and allowed without evidence.

Words are counted over all pages.  The unigram model holds the most frequent, about ``VOCABULARY`` of them and all of
equal frequency or none (to a sixteenth of an octave): a bound of the model, as it goes to all tasks.  The cut is found
from a histogram, so no more than those words reach the driver.  The Bayes model is fitted on at most about
``MAX_ROWS`` distinct labelled urls, chosen by a hash, each with its number of pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, table
from .shingles import words

#: Host, path prefix and verdict of the rules (fixed values of the contract).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
VOCABULARY, MAX_ROWS = 100_000, 20_000
_WORD, _TAG, _SPLIT = re.compile(r"[a-z]+"), re.compile(r"<[^>]*>"), re.compile(r"[^a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for a null url and for one without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    at = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:at], rest[at:]
    end = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return host.translate(_LOWER), path[:end]


def rule_words(rules=RULES) -> frozenset[str]:
    """Host labels and path parts that a rule looks at."""
    hosts = {f"host:{w}" for host, _, _ in rules for w in _SPLIT.split(host)}
    return frozenset(hosts | {f"path:{w}" for _, path, _ in rules for w in _SPLIT.split(path.translate(_LOWER)) if w})


class RuleIndex:
    """Rules by host, so that a url costs one look-up for each of its host's suffixes."""

    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, as text, and its verdict."""
        best, suffix = None, host
        while suffix:
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start) and (best is None or len(suffix + start) > len(best[0])):
                    best = (suffix + start, verdict)
            _, _, suffix = suffix.partition(".")
        return best


class Segmenter:
    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        self.unknown = math.log(total) + 5.0
        self.known: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        """Words of the least total cost; of equals, that with the longer last word.  What is no word goes letter by letter."""
        if name not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            best, back = [0.0], [0]
            for end in range(1, len(name) + 1):
                options = [(best[start] + self.cost.get(name[start:end], self.unknown if end - start == 1 else math.inf), start) for start in range(max(0, end - self.longest), end)]
                cost, start = min(options)
                best.append(cost)
                back.append(start)
            parts, end = [], len(name)
            while end:
                parts.append(name[back[end] : end])
                end = back[end]
            self.known[name] = parts[::-1]
        return self.known[name]

    def tokens(self, host: str, path: str, unused: frozenset[str] = frozenset()) -> list[str]:
        """Words of the host's labels and the path's parts, but of those in ``unused``; digits count as alike."""
        hosts, parts = _SPLIT.split(host), _SPLIT.split(path.translate(_LOWER))
        out = [f"host:{w}" for label in hosts if f"host:{label}" not in unused for w in self.split(label)]
        return out + [f"path:{w}" for part in parts if f"path:{part}" not in unused for w in ([re.sub(r"\d", "0", part)] if any(map(str.isdigit, part)) else self.split(part))]


def comparable(rows: list) -> list:
    """The rows (host, verdict) of top-level domains that have both verdicts; all of them if none has."""
    verdicts: dict[str, set[str]] = {}
    for r in rows:
        verdicts.setdefault(r.host.rpartition(".")[2], set()).add(r.verdict)
    return [r for r in rows if len(verdicts[r.host.rpartition(".")[2]]) == 2] or rows


class NaiveBayes:
    """From (tokens, verdict, number of pages)."""

    def __init__(self, rows: list[tuple[list[str], str, int]]):
        counts = {"allow": Counter(), "block": Counter()}
        for tokens, verdict, n in rows:
            for t in tokens:
                counts[verdict][t] += n
        size = len(set(counts["allow"]) | set(counts["block"])) + 1
        totals = {v: sum(c.values()) + size for v, c in counts.items()}
        self.weight = {t: math.log((counts["block"][t] + 1) / totals["block"]) - math.log((counts["allow"][t] + 1) / totals["allow"]) for c in counts.values() for t in c}

    def odds(self, tokens: list[str]) -> float:
        """Log likelihood of the tokens in blocked against allowed urls; tokens never met say nothing."""
        return sum(self.weight.get(t, 0.0) for t in tokens)


def word_counts(pages: DataFrame, html_column: str = "html", most: int = VOCABULARY) -> dict[str, int]:
    """Words of letters only, over the texts of all pages; the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter[str] = Counter()
            for first in range(0, batch.num_rows, 500):
                texts = [_TAG.sub(" ", t or "") for t in batch.column(0).slice(first, 500).to_pylist()]
                found, code, _ = words(pa.array(texts, pa.string()))
                for i, n in Counter(code.tolist()).items():
                    for w in _WORD.findall(found[i].as_py()):
                        held[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    counted = pages.select(F.col(f"`{html_column}`").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    step = F.floor(F.log2(F.col("n")) * 16).cast("int")
    counted = materialise(counted.withColumn("step", step), "words")
    least, held = None, 0
    for r in sorted(counted.groupBy("step").count().collect(), key=lambda r: -r.step):  # sixteen steps an octave
        held += r["count"]
        if held > most and least is not None:
            break
        least = r.step
    out = {r.word: r.n for r in counted.filter(F.col("step") >= least).select("word", "n").collect()} if least is not None else {}
    discard(counted)
    return out


def judge(pages: DataFrame, rules=RULES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", most: int = MAX_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, odds) of every row.

    A null url, and one without ``://``, has an empty host and path, which no rule fits; without any token it is allowed.
    A host or path of any length is judged whole.  Equal urls are judged alike, an empty table gives no rows, other columns are not read.
    """
    unused = rule_words(rules)
    index, split = RuleIndex(rules), Segmenter(word_counts(pages, html_column))
    rows = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").cast("string").alias("url"))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = parse(url)
                rule = index.find(host, path)
                out.append((host, path, *(rule or (None, None))))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], ["page_id", "host", "path", "rule", "verdict"])

    kind = rows.schema["page_id"].dataType.simpleString()
    found = rows.mapInArrow(decided, f"page_id {kind}, host string, path string, rule string, verdict string")
    labelled = found.filter(F.col("rule").isNotNull()).groupBy("host", "path", "verdict").agg(F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30))
    labelled = materialise(labelled.withColumn("place", place), "labelled")
    few = labelled.filter(F.col("place") < int((1 << 30) * min(1.0, most / max(labelled.count(), 1))))
    model = NaiveBayes([(split.tokens(r.host, r.path, unused), r.verdict, r.n) for r in comparable(few.collect())])
    discard(labelled)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path, verdict = (batch.column(i).to_pylist() for i in (1, 2, 4))
            odds = [model.odds(split.tokens(h, p, unused)) for h, p in zip(host, path, strict=True)]
            verdict = [v or ("block" if o > 0 else "allow") for v, o in zip(verdict, odds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(odds, pa.float64())], [*batch.schema.names, "odds"])

    return found.mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string, odds double")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page; see ``judge``."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLE: dict[str, str] = {}
