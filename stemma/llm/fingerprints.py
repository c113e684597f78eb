"""I-Match fingerprints, with DataFrame functions only.

Terms are runs of letters and digits, lower-cased.  The lexicon keeps those in a band of document frequency: at least
``LEAST_SHARE`` and at most ``MOST_SHARE`` of all documents.  A document of d distinct terms adds at most d to the sum
of frequencies, so the lexicon has at most d / LEAST_SHARE entries for the mean d, however many documents there are;
this is why it may go to all tasks.  The lexicon is divided at random into ``SUBSETS`` subsets.  A document's distinct
terms are sorted, and those of each subset are hashed; a fingerprint is the list of the hashes.  Two fingerprints are
alike in the share of subsets with equal hashes among those in which either document has a term.

A text without any term of the lexicon, as those of a rare language or script may be, is fingerprinted by all its own
terms, divided among the subsets in the same way; one without letters and digits by the text itself.  So two texts are
wholly alike only if they have the same terms, and a text of lexicon terms is not like one that has none.

The lexicon is a constant of the plan, an array of small maps found by the term's hash: a text meets it in its own
row, without a join, so that only texts are shuffled: once by their id, and the first part of each to the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions_for, table

#: Chosen by a sweep over half-edited texts (README): narrower bands and more subsets survive more edits.
LEAST_SHARE, MOST_SHARE, SUBSETS, SEED = 1 / 256, 1 / 32, 64, "stemma-i-match"
ROWS_PER_RANGE = 4000
_NONE = "-"


def terms(text):
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def subset_of(term):
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), term)), 1, 6), 16, 10).cast("int") % SUBSETS


def lexicon(texts: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(term, subset) of the terms inside the band, from the column ``text``; and the empty term, of no subset."""
    total = texts.count()
    counted = texts.select(F.explode(terms(F.col("text"))).alias("term")).filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    band = counted.filter((F.col("n") >= max(2, least * total)) & (F.col("n") <= max(2, most * total)))
    return band.select("term", subset_of(F.col("term")).alias("subset")).unionByName(texts.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).alias("subset")))


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of every distinct id: the next larger one, of the largest the smallest."""
    spark = ids.sparkSession
    ids = ids.filter(F.col("doc_id").isNotNull()).distinct()
    ranged = materialise(ids.repartitionByRange(partitions_for(spark, ids.count(), ROWS_PER_RANGE), "doc_id").select("doc_id", F.spark_partition_id().alias("part")), "ids")
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    after = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min("first").over(Window.partitionBy())).alias("after"))
    inside = ranged.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return inside.join(after, "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def constant(words: DataFrame, per_slot: int = 4):
    """The lexicon as a constant column: maps of term to subset, in slots by the term's hash."""
    rows = words.select("term", "subset", F.xxhash64("term").alias("at")).collect()  # mean terms of a document / LEAST_SHARE at most
    slots = max(1, len(rows) // per_slot)
    maps: list[list[str]] = [["'',-1"] for _ in range(slots)]
    for r in rows:
        if r.term:
            maps[r.at % slots].append(f"'{r.term}',{r.subset}")
    return F.expr("array(" + ",".join(f"map({','.join(m)})" for m in maps) + ")"), slots


def fingerprint_of(text, words):
    """The fingerprint of a text by a ``constant`` lexicon."""
    slot_maps, slots = words

    def subset(t):
        return F.try_element_at(F.get(slot_maps, F.pmod(F.xxhash64(t), F.lit(slots)).cast("int")), t)

    def hashes(ordered):
        def one(k):
            own = F.array_join(F.transform(F.filter(ordered, lambda x: x["subset"] == k), lambda x: x["term"]), " ")
            return F.when(own != "", F.substring(F.md5(own), 1, 8)).otherwise(_NONE)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one), ".")

    met = F.filter(F.transform(terms(text), lambda t: F.struct(t.alias("term"), subset(t).alias("subset"))), lambda x: x["subset"] >= 0)
    own = F.filter(F.when(F.size(F.array_remove(terms(text), "")) > 0, terms(text)).otherwise(F.array(F.trim(text))), lambda t: t.rlike(r"\S"))
    unmet = F.transform(own, lambda t: F.struct(t.alias("term"), subset_of(t).alias("subset")))
    met = F.transform(F.array(met), lambda m: F.when(F.size(m) > 0, m).otherwise(unmet))[0]
    # the array of one element makes Spark sort once a row, not once a subset
    return F.transform(F.array(F.array_sort(met)), hashes)[0]


def likeness(a, b):
    """Of two fingerprints, 0 to 1; two of blank texts are equal."""
    pairs = F.arrays_zip(F.split(a, r"\.").alias("a"), F.split(b, r"\.").alias("b"))
    either = F.size(F.filter(pairs, lambda x: (x["a"] != _NONE) | (x["b"] != _NONE)))
    equal = F.size(F.filter(pairs, lambda x: (x["a"] != _NONE) & (x["a"] == x["b"])))
    return F.when(either == 0, F.lit(1.0)).otherwise(equal / either)


def edited_documents(docs: DataFrame, words) -> DataFrame:
    """(doc_id, text, edited, next_fingerprint) of (doc_id, text): the end of each text becomes the start of the next's.

    Of rows that share an id, the one with the least MD5 of its text stands for the document; a row without an id has
    no next document, and its end is only cut off.
    """
    known = docs.filter(F.col("doc_id").isNotNull())
    need = F.floor(F.max(F.char_length("text")) / 2).cast("int")
    wanted = known.groupBy("doc_id").agg(need.alias("need")).join(next_ids(known.select("doc_id")), "doc_id").select(F.col("doc_id").alias("of"), "next_id", "need")
    one = F.struct(F.md5("text").alias("name"), F.left("text", "need").alias("head"), fingerprint_of(F.col("text"), words).alias("fingerprint"))
    heads = known.join(wanted, known.doc_id == wanted.next_id).select(F.col("of").alias("doc_id"), one.alias("x"))
    heads = heads.groupBy("doc_id").agg(F.min("x").alias("x"))
    # both joins shuffle the same columns by the same key, so that Spark shuffles the texts once
    rows = known.join(heads, "doc_id", "left").select("doc_id", "text", "x")
    unknown = docs.filter(F.col("doc_id").isNull())
    if not unknown.isEmpty():
        rows = rows.unionByName(unknown, allowMissingColumns=True)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.char_length("text") - half), F.coalesce(F.left("x.head", half), F.lit("")))
    return rows.select("doc_id", "text", edited.alias("edited"), F.col("x.fingerprint").alias("next_fingerprint"))


def compare(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text is blank; blank texts share one fingerprint, that without any hash, and equal
    texts have equal fingerprints always.  Repeated rows stay.  A single document is its own next one.  An empty table
    gives no rows; other columns are not read.
    """
    own = F.col(f"`{id_column}`")
    if id_column != "doc_id":  # an alias to the same name would keep Spark from seeing that two shuffles are one
        own = own.alias("doc_id")
    docs = docs.select(own, F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    words = constant(lexicon(docs))
    rows = edited_documents(docs, words).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.transform(F.array("text", "edited"), lambda t: fingerprint_of(t, words)).alias("made"), "next_fingerprint",
    ).withColumns({"fingerprint": F.col("made")[0], "edited_fingerprint": F.col("made")[1]})
    near_next = F.when(F.col("next_fingerprint").isNull(), F.lit(0.0)).otherwise(likeness(F.col("fingerprint"), F.col("next_fingerprint")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), near_next.alias("near_next"),
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its half-edited text, and their likeness; see ``compare``."""
    return compare(table(spark, sf_dir, "documents"))


QUERIES = {"op2_fingerprints": op2_fingerprints}
def _sql() -> str:
    """The operator in DuckDB's SQL, of the constants above; ids are distinct there."""
    words = lambda t: f"list_filter(list_distinct(string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}]+')), lambda t: t <> '')"
    subset = f"(('0x' || left(md5('{SEED}' || term), 6))::INTEGER % {SUBSETS})"
    made = (  # the hashes of the subsets, '-' for an empty one, joined by dots
        "SELECT id, which, string_agg(coalesce(h, '-'), '.' ORDER BY k) AS f FROM (SELECT t.id, t.which, s.k, h FROM (SELECT DISTINCT id, which FROM texts) t CROSS JOIN (SELECT unnest(range("
        + str(SUBSETS) + ")) AS k) s LEFT JOIN (SELECT id, which, subset AS k, left(md5(string_agg(term, ' ' ORDER BY term)), 8) AS h FROM used GROUP BY ALL) u ON u.id = t.id AND u.which = t.which AND u.k = s.k) GROUP BY ALL"
    )
    like = lambda a, b: (
        f"coalesce(list_sum(list_transform(list_zip(string_split({a}, '.'), string_split({b}, '.')), lambda x: CASE WHEN x[1] = x[2] AND x[1] <> '-' THEN 1 ELSE 0 END))"
        f" / nullif(list_sum(list_transform(list_zip(string_split({a}, '.'), string_split({b}, '.')), lambda x: CASE WHEN x[1] = '-' AND x[2] = '-' THEN 0 ELSE 1 END)), 0), 1.0)"
    )
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(id) OVER w, first_value(id) OVER w) AS next_id, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS MATERIALIZED (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n),
texts AS MATERIALIZED (SELECT id, 'own' AS which, text FROM e UNION ALL SELECT id, 'edited', edited FROM e),
terms AS MATERIALIZED (SELECT id, which, unnest({words('text')}) AS term FROM texts),
band AS MATERIALIZED (SELECT term FROM terms WHERE which = 'own' GROUP BY term HAVING count(*) BETWEEN greatest(2, {LEAST_SHARE} * (SELECT count(*) FROM d)) AND greatest(2, {MOST_SHARE} * (SELECT count(*) FROM d))),
met AS MATERIALIZED (SELECT id, which, term FROM terms SEMI JOIN band USING (term)),
bare AS (SELECT id, which, term FROM terms ANTI JOIN met USING (id, which) UNION ALL SELECT id, which, trim(text) FROM texts ANTI JOIN terms USING (id, which) WHERE regexp_matches(trim(text), '\\S')),
used AS MATERIALIZED (SELECT id, which, term, {subset} AS subset FROM (SELECT * FROM met UNION ALL SELECT * FROM bare)),
f AS MATERIALIZED ({made})
SELECT e.id AS doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint, {like('a.f', 'b.f')} AS near_edited, {like('a.f', 'c.f')} AS near_next
FROM e JOIN f a ON a.id = e.id AND a.which = 'own' JOIN f b ON b.id = e.id AND b.which = 'edited' JOIN f c ON c.id = e.next_id AND c.which = 'own'"""


ORACLE = {"op2_fingerprints": _sql()}
