"""The operators and the pipeline's stages against plain Python, and on awkward tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from types import SimpleNamespace as Row

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stemma.llm import bpe, fingerprints, jaccard_join, line_dedup, packing, pii, quality, sharding, toxicity, urls
from stemma.llm.common import discard, materialise, scratch

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(n, seed, most=60):
    dice = random.Random(seed)
    words = [f"{dice.choice('abcdefgh')}{i}" for i in range(200)]
    return [(i, " ".join(dice.choice(words) for _ in range(dice.randint(0, most)))) for i in range(n)]


# --- sharding


def test_interleaving_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 7)
    dice = random.Random(1)
    rows = [(i if i % 19 else None, f"t{i % 13}", dice.choice(["big"] * 6 + ["a", "b", None]), 9) for i in range(300)]
    docs = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, source string, key long")
    got = sharding.shard(docs, shards=7).collect()
    ranked = []
    for source in {r[2] for r in rows}:
        own = [r for r in [*rows, rows[5], rows[5]] if r[2] == source]
        name = lambda r: hashlib.md5((sharding.SEED + (f":{r[0]}" if r[0] is not None else "")).encode()).hexdigest()
        own.sort(key=lambda r: (name(r), r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
        ranked += [((2 * i + 1) / (2 * len(own)), "=" + source if source is not None else "", name(r), r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()), r) for i, r in enumerate(own)]
    ranked.sort(key=lambda x: x[:6])
    n = len(ranked)
    expected = collections.Counter()
    slots = collections.Counter()
    for at, x in enumerate(ranked):
        shard = at * 7 // n
        expected[x[6][0], x[6][2], shard, slots[shard]] += 1
        slots[shard] += 1
    assert collections.Counter((r.doc_id, r.source, r.shard, r.slot) for r in got) == expected
    shares = collections.Counter((r.shard, r.source) for r in got)
    for source, total in collections.Counter(r[2] for r in [*rows, rows[5], rows[5]]).items():  # every shard matches the mixture
        assert all(abs(shares[s, source] - total / 7) <= 2 for s in range(7))


# --- fingerprints


def test_fingerprints_equal_plain_python(spark):
    rows = rows_of(150, 3)
    texts = dict(rows)
    split = lambda t: {w for w in re.split(r"[^a-z0-9]+", t.lower()) if w}
    df = collections.Counter(w for t in texts.values() for w in split(t))
    low, high = max(2, fingerprints.LEAST_SHARE * 150), max(2, fingerprints.MOST_SHARE * 150)
    subset = lambda w: int(hashlib.md5((fingerprints.SEED + w).encode()).hexdigest()[:6], 16) % fingerprints.SUBSETS

    def made(text):
        own = [w for w in split(text) if low <= df[w] <= high] or list(split(text))
        held = [" ".join(sorted(w for w in own if subset(w) == k)) for k in range(fingerprints.SUBSETS)]
        return [hashlib.md5(h.encode()).hexdigest()[:8] if h else "-" for h in held]

    def like(a, b):
        either = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != ("-", "-")]
        return sum(x == y for x, y in either) / len(either) if either else 1.0

    docs = spark.createDataFrame([*rows, (None, "no id here")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.compare(docs).collect()}
    assert len(got) == 151 and got[None].near_next == 0.0
    df.update(split("no id here"))
    for i, t in rows:
        after, k = texts[(i + 1) % 150], len(t) // 2
        edited = t[: len(t) - k] + after[:k]
        assert got[i].fingerprint.split(".") == made(t) and got[i].edited_fingerprint.split(".") == made(edited)
        assert got[i].near_edited == pytest.approx(like(made(t), made(edited))) and got[i].near_next == pytest.approx(like(made(t), made(after)))


# --- urls


def test_segments_are_the_likeliest(spark):
    dice = random.Random(6)
    for _ in range(60):
        counts = {"".join(dice.choice("ab") for _ in range(dice.randint(1, 4))): dice.randint(1, 50) for _ in range(8)}
        split = urls.Segmenter(counts)
        name = "".join(dice.choice("abc") for _ in range(dice.randint(0, 8)))
        cost = lambda parts: sum(split.cost.get(p, split.unknown if len(p) == 1 else math.inf) for p in parts)  # noqa: B023, E731
        ways = [[name[a:b] for a, b in zip((0, *cut), (*cut, len(name)), strict=True)] for k in range(len(name)) for cut in itertools.combinations(range(1, len(name)), k)] or [[]]
        assert "".join(split.split(name)) == name and cost(split.split(name)) == pytest.approx(min(map(cost, ways)))


def test_bayes_weights():
    model = urls.NaiveBayes([(["a", "b", "b"], "block", 2), (["b", "c"], "allow", 3)])
    size = 4  # three tokens and one unknown
    odds = lambda x, y: math.log((x + 1) / (6 + size)) - math.log((y + 1) / (6 + size))
    assert model.odds(["a", "c", "z"]) == pytest.approx(odds(2, 0) + odds(0, 3)) and model.odds(["b"]) == pytest.approx(odds(4, 3)) and model.odds([]) == 0


def test_rules_do_not_teach_their_own_words(spark):
    unused = urls.rule_words()
    assert urls.Segmenter({"news": 3}).tokens("news.example.net", "/en/news/7", unused) == ["host:news", "path:news", "path:0"]
    rows = [Row(host="a.net", verdict="block"), Row(host="b.net", verdict="allow"), Row(host="c.com", verdict="block")]
    assert urls.comparable(rows) == rows[:2] and urls.comparable(rows[2:]) == rows[2:]


def test_urls_on_awkward_tables(spark):
    schema = "page_id long, url string, html string, host string, verdict string"
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0
    long = "http://" + "ab" * 5000 + ".example.org/" + "x/" * 5000
    rows = [(1, long, "<p>ab</p>", "x", "y"), (1, long, "<p>ab</p>", "x", "y"), (None, "http://a.net/", None, "x", "y"), (2, None, "", "x", "y"), (3, "no scheme", "q", "x", "y")]
    got = urls.judge(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id is None, r.page_id, r.rule, r.verdict) for r in got)[-1] == (True, None, "net/", "block")
    assert sum(r.page_id == 1 for r in got) == 2 and len({r.verdict for r in got if r.page_id == 1}) == 1
    assert {r.verdict for r in got if r.page_id in (2, 3)} == {"allow"}


def test_word_cut_is_whole(spark):
    pages = spark.createDataFrame([("aa " * 64 + "bb " * 32 + "cc dd ee",)], "html string")
    assert urls.word_counts(pages, most=2) == {"aa": 64, "bb": 32}
    assert urls.word_counts(pages, most=3) == {"aa": 64, "bb": 32}  # of equally frequent words all or none
    assert len(urls.word_counts(pages, most=5)) == 5


# --- personal data


def test_candidates_beyond_the_base_rule(spark):
    dice = random.Random(1)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(400):
        rows.append((i, [
            f"{word()} please write to {word()}.{word()}@{word()}.org {word()}", f"{word()} contact {word()} [at] {word()}.com {word()}",
            f"{word()} number {dice.randint(100, 999)}.{dice.randint(300, 999)}.{dice.randint(300, 999)}.{dice.randint(300, 999)} {word()}", f"{word()} order {dice.randint(10**15, 10**16 - 1)} {word()}",
        ][i % 4]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(x.kind, t[x.start : x.end]) for x in r.found if not x.base] for r, t in ((r, r.text) for r in pii.find(docs).collect())}
    # written-out mails, beside a word that names them; not order numbers and versions, whose check digits and parts are those of chance
    assert all(len(got[i]) == 1 and got[i][0][0] == "email" and " [at] " in got[i][0][1] for i in range(1, 400, 4))
    assert not any(got[i] for i in range(400) if i % 4 != 1)


def test_trees_as_sql_equal_numpy(spark):
    dice = np.random.default_rng(2)
    x = dice.integers(0, 9, (300, len(pii.FEATURES))).astype(float)
    model = pii.boost(x, (x[:, 1] + x[:, 3] > 8).astype(float))
    schema = ", ".join(f"{f} double" for f in pii.FEATURES)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], schema).select(F.struct(*pii.FEATURES).alias("f"))
    got = [r.s for r in frame.select(pii.tree_score(model, F.col("f")).alias("s")).collect()]
    assert sorted(got) == pytest.approx(sorted(pii.numpy_score(model, x)))
    assert ((pii.numpy_score(model, x) > 0) == (x[:, 1] + x[:, 3] > 8)).mean() > 0.9


def test_thresholds_are_calibrated():
    cells = [("card", 9, 40, 40.0), ("card", 8, 60, 57.0), ("card", 7, 100, 50.0), ("email", 3, 10, 9.9)]
    assert pii.thresholds(cells) == {"card": 8 / pii.STEP}  # 97 of 101, then 147 of 201; ten mails are too few
    assert pii.thresholds([]) == {}


def test_redaction_of_overlapping_spans(spark):
    found = "array<struct<start:int,kind_at:int,end:int,kind:string,base:boolean>>"
    rows = [("0123456789", [(2, 2, 5, "card", True), (3, 3, 7, "phone", True)]), ("0123456789", []), ("ab", [(0, 0, 2, "email", True)])]
    got = [r.t for r in spark.createDataFrame(rows, f"text string, found {found}").select(pii.redacted(F.col("text"), F.col("found")).alias("t")).collect()]
    assert got == ["01[CARD]789", "0123456789", "[EMAIL]"]


# --- toxicity


def test_repeated_beginnings(spark):
    import pyarrow as pa

    names, word, owner = toxicity.distinct_words(pa.array(["insulting insulter x", "insulting insulting", "", "other"]))
    of = {i: {names[w] for w, o in zip(word.tolist(), owner.tolist(), strict=True) if o == i} for i in range(4)}
    assert {"insulting", "insul*", "insul**", "insulti*", "x"} <= of[0] and "insul**" not in of[1] and not of[2] and of[3] == {"other"}


def test_toxicity_on_awkward_tables(spark):
    schema = "doc_id long, text string, score double, toxic int"
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b", 0.1, 1), (1, "a b", 0.1, 1), (None, None, 0.2, 0), (2, "", 0.3, 0), (3, "x " * 50_000, 0.4, 1)], schema)
    model = toxicity.fit(*toxicity.sample(docs, none))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1 and toxicity.score(docs.limit(0), model).count() == 0


# --- n-gram Jaccard join


def brute(rows, width=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(n, seed, words=60):
    """Copies of one text with a few words changed, some changed much more; and a second family that shares a passage."""
    dice = random.Random(seed)
    base = [f"w{dice.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = [*base[: words // 2], *[f"f{k}" for k in range(words // 2)]] if i % 5 == 4 else list(base)
        for _ in range(dice.choice([0, 1, 1, 2, 3, 4])):
            copy[dice.randrange(words)] = f"x{dice.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [8192, 12])
def test_groups_larger_than_a_block(spark, monkeypatch, block):
    whole = jaccard_join.joined_groups
    monkeypatch.setattr(jaccard_join, "joined_groups", lambda rows, exact: whole(rows, exact, block=block))
    monkeypatch.setattr(jaccard_join, "CENTRES", 2)
    rows = list(enumerate([*near_copies(90, 5), *near_copies(60, 6, 40), *[t for _, t in rows_of(30, 7)], "", None, "one two"]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_links_on_awkward_tables(spark):
    schema = "doc_id long, text string, node long, n long, component_id long"
    a, b = "one two three four five six", "one two three four five six seven"
    rows = [(1, a, 0, 0, 0), (1, b, 0, 0, 0), (2, b, 0, 0, 0), (2, b, 0, 0, 0), (None, a, 0, 0, 0), (3, None, 0, 0, 0), (4, "x " * 30_000, 0, 0, 0), (5, "alone", 0, 0, 0)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.link(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 2, None), (1, 2, 1), (1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 1, 4), (5, 1, 5)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 1, 3, 4, 5]


def test_finer_counts_bound_the_overlap():
    dice = np.random.default_rng(3)
    for n in (3, 100, 900, 5000):
        a = np.unique(dice.integers(0, 1 << 60, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], dice.integers(0, 1 << 60, n, dtype=np.uint64)]))
        x, y = jaccard_join.fine_counts(a), jaccard_join.fine_counts(b)
        groups = min(len(x), len(y))
        assert np.minimum(jaccard_join.folded(x, groups), jaccard_join.folded(y, groups)).sum() >= len(np.intersect1d(a, b)) and x.sum() == len(a)


# --- packing, shared tables


def test_packing_of_repeated_and_missing_ids(spark):
    import public_tokenizers as P

    rows = [(1, "a b c"), (1, "a b c"), (None, "d e"), (None, None), (2, "f " * 5000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, {"<|endoftext|>": 50256}).collect()
    lengths = collections.Counter()
    for r in got:
        lengths[r.doc_id] += r.length
    single = {r.doc_id: r.doc_tokens for r in got}
    assert lengths[1] == 2 * single[1] and lengths[2] == single[2] and sum(r.doc_id is None and r.start == 0 for r in got) == 2


def test_scratch_tables(spark):
    df = materialise(spark.range(3), "x")
    assert df.count() == 3
    discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.scratch_path).count()
    other = Row(conf=Row(get=lambda *_: None), sparkContext=Row(getConf=lambda: Row(get=lambda _: None), master="spark://host"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch(other, "x")


# --- the pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    dice = random.Random(12)
    prose = lambda n: " ".join(f"w{dice.randint(0, 400)}" for _ in range(n))
    line = "this line is found in several documents"
    texts = [prose(40) for _ in range(20)] + [f"{prose(20)}\n{line}\n{prose(20)}" for _ in range(4)]
    texts += ["mail me at a.b@c.org now " + prose(30), "too short", None, "again and again and again and again " * 20]
    texts += [texts[0] + " extra", texts[0], prose(2000)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, (None, prose(30), None, None, None)], COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_pipeline_against_plain_python(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    seen = spark.read.parquet(f"{folder}/documents.parquet")
    columns = seen.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        seen = materialise(stage(spark, seen, folder), name)
        steps[name] = {r.doc_id: r for r in seen.collect()}
        if name != "packing":
            assert seen.columns == columns

    def good(t):
        w = (t or "").split()
        runs = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(5)}
        return len(w) >= 10 and 100 * len(covered) <= 20 * len(w)

    kept = {i: t for i, t in docs.items() if good(t)}
    assert set(steps["quality_rules"]) == set(kept)
    owner = {}
    for i in sorted(kept, key=lambda i: (i is None, i)):
        for x in kept[i].split("\n"):
            owner.setdefault(x.strip().lower(), i)
    lines = {i: "\n".join(x for x in t.split("\n") if len(x.strip()) < 10 or owner[x.strip().lower()] == i) for i, t in kept.items()}
    assert {i: r.text for i, r in steps["line_dedup"].items()} == lines and all(r.n_chars == len(r.text) for r in steps["line_dedup"].values())
    linked = brute([(i, t) for i, t in lines.items() if i is not None])
    first = {i: lines[i] for i in lines if i is None or linked[i][1] == i}
    assert set(steps["near_duplicates"]) == set(first)
    clean = {i: re.sub(r"\S+@\S+", "[EMAIL]", t) for i, t in first.items()}
    assert {i: r.text for i, r in steps["personal_data"].items()} == clean
    packed = collections.Counter()
    for r in seen.collect():
        packed[r.doc_id] += r.length
        assert r.length <= 2048
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert packed == {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert corpus_pipeline.run(spark, folder).count() == seen.count()


def test_pipeline_stages_on_an_empty_table(spark, folder):
    empty = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)


def test_every_operator_is_there():
    from stemma.llm import registry

    assert sorted(q[:4].rstrip("_") for q in registry.QUERIES) == sorted(f"op{n}" for n in range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "personal_data", "packing"]
    assert all(m.QUERIES for m in (bpe, fingerprints, jaccard_join, line_dedup, packing, pii, quality, sharding, toxicity, urls))
