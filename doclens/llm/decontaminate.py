"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

The index is a stored table of postings (term, doc_id, row, pos) of the terms that the test items use; its shards are
those of the documents, since no posting is moved to build it. Each text is split into words once, for the index. It
closes with a posting of the term END at the place after its last word, which gives its number of words, so that counts
need no second reading. Term frequencies come from the index. A phrase, here each window of ``width`` consecutive item
words, is looked up from its two rarest terms: every posting is shifted by its term's place in the item, which gives the
place where the item would begin in the document, and the two lists meet where these places agree. What is left is few;
there all words of the item are looked up at their places in the index, and the windows that are whole are hits.

Terms are 64-bit hashes of words, rows are told apart by a hash of doc_id and text. Only the item vocabulary, the items'
words and the rows with candidates are broadcast, each after its rows are counted; above the bound the same join
shuffles. A passage that many documents hold makes a row for each of them, never pairs of documents, and nothing is
collected beyond an item's places or the hits of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclens.llm.store import materialise

# What parts words, and which letters are lowered.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH = 8
END = 0  # the term of the place after the last word
SMALL_TERMS = 500_000  # rows of 8 to 24 bytes
SMALL_ITEMS = 50_000  # items, some 0.5 kB each
SMALL_ROWS = 2_000_000  # keys of 8 bytes


def lowered(word: Column) -> Column:
    """A-Z lowered and no other letter; the common way is the fast one where there is no other letter."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text, their letters as they are; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def term(word: Column) -> Column:
    return F.xxhash64(lowered(word))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _small(df: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= bound else df


def item_table(items: DataFrame) -> DataFrame:
    """item (a key for the row), item_id, terms of each distinct item that has an id and a word."""
    named = items.select("item_id", F.transform(words(F.col("text")), term).alias("terms"))
    named = named.where(F.col("item_id").isNotNull() & (F.size("terms") > 0)).distinct()
    return named.select(F.xxhash64("item_id", "terms").alias("item"), "item_id", "terms")


def build_postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The positional index of docs(doc_id, text) as a stored table term, doc_id, row, pos; of the given terms and END
    only, if terms are given. A null text has no words; rows with a null doc_id are indexed under null."""
    # columns of their own, so that they are made once a document and not once a word
    split = docs.select("doc_id", row_key().alias("row"), words(F.col("text")).alias("words"))
    split = split.select("doc_id", "row", F.array_append("words", F.lit("")).alias("words"))
    every = split.select("doc_id", "row", F.posexplode("words").alias("pos", "word"))
    every = every.select(F.when(F.col("word") == "", F.lit(END).cast("bigint")).otherwise(term(F.col("word"))).alias("term"), "doc_id", "row", "pos")
    if terms is not None:
        own = terms.select("term").union(terms.sparkSession.range(END, END + 1)).distinct()
        every = every.join(_small(own, SMALL_TERMS), "term", "left_semi")
    return materialise(every.select("term", "doc_id", "row", "pos"), "postings")


def rarest_terms(items: DataFrame, postings: DataFrame, width: int = WIDTH) -> DataFrame:
    """item, start, a, b: for each window of an item whose terms all occur, the places in the item of its rarest and
    its second rarest term (b = a in windows of one word). Ties go to the earlier place."""
    counts = postings.groupBy("term").agg(F.count("*").alias("n"))
    terms = items.select("item", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term")).join(counts, "term", "left")
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - width + 1), F.least(F.col("at"), F.greatest(F.lit(0), F.col("size") - width))))
    rank = F.row_number().over(Window.partitionBy("item", "start").orderBy("n", "at"))
    placed = terms.select("item", start.alias("start"), "at", "n").withColumn("rank", rank)
    chosen = placed.groupBy("item", "start").agg(
        F.max(F.when(F.col("rank") == 1, F.col("at"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("at"))).alias("b"), F.count("n").alias("known"), F.count("*").alias("all")
    )
    return chosen.where(F.col("known") == F.col("all")).select("item", "start", "a", F.coalesce("b", "a").alias("b"))


def alignments(items: DataFrame, postings: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, item, delta: item word i would be document word delta + i, and the two rarest terms of at least one
    window are there. Offset-adjusted intersection of the rarest lists."""
    windows = materialise(rarest_terms(items, postings, width), "windows")
    anchors = windows.select("item", F.explode(F.array("a", "b")).alias("at")).distinct()
    wanted = items.select("item", F.posexplode("terms").alias("at", "term")).join(anchors, ["item", "at"])
    shifted = postings.select("term", "row", "pos").join(_small(wanted, SMALL_TERMS), "term").select("row", "item", (F.col("pos") - F.col("at")).alias("delta"), "at")
    met = shifted.groupBy("row", "item", "delta").agg(F.collect_set("at").alias("met"))
    pairs = windows.groupBy("item").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))
    both = F.exists("pairs", lambda p: F.array_contains("met", p["a"]) & F.array_contains("met", p["b"]))
    return met.join(_small(pairs, SMALL_ITEMS), "item").where(both).select("row", "item", "delta")


def occurrences(items: DataFrame, postings: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, item, item_id, delta, starts: where windows of the item begin that occur so aligned, as places in the
    item; k: words of a window. All words are looked up at their places in the index."""
    aligned = materialise(alignments(items, postings, width), "alignments")
    wanted = aligned.join(_small(items.select("item", "terms"), SMALL_ITEMS), "item").select("row", "item", "delta", F.posexplode("terms").alias("at", "term"))
    wanted = wanted.withColumn("pos", F.col("delta") + F.col("at"))
    near = postings.join(_small(aligned.select("row").distinct(), SMALL_ROWS), "row", "left_semi").select("row", "pos", "term").distinct()
    got = wanted.join(near, ["row", "pos", "term"]).groupBy("row", "item", "delta").agg(F.collect_set("at").alias("got"))
    k = F.least(F.lit(width), F.size("terms"))
    whole = lambda s: F.forall(F.sequence(s, s + F.col("k") - 1), lambda i: F.array_contains("got", i))
    held = got.join(_small(items, SMALL_ITEMS), "item").withColumn("k", k)
    held = held.where(F.size("got") >= F.col("k")).withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("terms") - F.col("k")), whole))
    return held.where(F.size("starts") > 0).select("row", "item", "item_id", "delta", "starts", "k")


def contaminated_rows(items: DataFrame, postings: DataFrame, width: int = WIDTH) -> DataFrame:
    """found (the row's key), hits (sorted distinct places of words inside an occurring window), item_ids (sorted
    distinct ids, as strings): a stored table of the rows with any."""
    found = materialise(occurrences(items, postings, width), "occurrences")
    hit = found.select("row", F.explode("starts").alias("s"), "delta", "k").select("row", F.explode(F.sequence(F.col("delta") + F.col("s"), F.col("delta") + F.col("s") + F.col("k") - 1)).alias("pos"))
    hits = hit.groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("hits"))
    ids = found.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    return materialise(hits.join(ids, "row").withColumnRenamed("row", "found"), "contaminated")


def _index(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = materialise(item_table(items), "items")
    return own, build_postings(docs, own.select(F.explode("terms").alias("term")).distinct())


def _filled(rows: DataFrame) -> DataFrame:
    """Rows without any hit get empty arrays."""
    return rows.withColumns({"hits": F.coalesce("hits", F.expr("CAST(array() AS array<int>)")), "item_ids": F.coalesce("item_ids", F.expr("CAST(array() AS array<string>)"))})


def find_contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, the columns to keep, n_words, hits (sorted distinct places of the
    words inside an occurring window) and item_ids (sorted distinct ids, as strings, of items with one).

    An item shorter than width is one window; an item without words or without an id is none. A null text has no
    words. Rows with a null doc_id and repeated rows are each judged by their own text. An empty table of documents
    gives none; an empty table of items finds nothing. A kept column called as one of the results is not possible."""
    found = contaminated_rows(*_index(docs, items), width)
    rows = docs.select("doc_id", *keep, row_key().alias("__row"), F.size(words(F.col("text"))).alias("n_words"))
    rows = rows.join(_small(found, SMALL_ITEMS), F.col("__row") == F.col("found"), "left")
    return _filled(rows).select("doc_id", *keep, "n_words", "hits", "item_ids")


def proximity_matches(postings: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """item, doc_id, row, pos: all words of the item, in any order, within its number of words + slop places, one of
    them the item's rarest word at pos. phrases: item, terms (as of item_table). From the rarest term's postings
    outwards, by places cut into strips, so that a join sees neighbouring places only."""
    span = materialise(phrases.select("item", F.array_distinct("terms").alias("terms"), (F.size("terms") + slop).alias("span")), "phrases")
    counts = postings.groupBy("term").agg(F.count("*").alias("n"))
    terms = span.select("item", "span", F.size("terms").alias("size"), F.explode("terms").alias("term")).join(counts, "term")
    rare = terms.groupBy("item").agg(F.min_by("term", F.struct("n", "term")).alias("term"), F.first("span").alias("span"), F.first("size").alias("size"), F.count("*").alias("known"))
    rare = rare.where(F.col("known") == F.col("size")).drop("known")
    strip = lambda at: F.floor(at / F.col("span"))
    near = postings.join(rare, "term").select("item", "doc_id", "row", "pos", "span", "size", F.explode(F.array(*(strip(F.col("pos")) + i for i in (-1, 0, 1)))).alias("strip"))
    other = postings.join(terms.select("item", "span", "term"), "term").select("item", "row", "term", F.col("pos").alias("at"), strip(F.col("pos")).alias("strip"))
    within = near.join(other, ["item", "row", "strip"]).where(F.abs(F.col("at") - F.col("pos")) < F.col("span"))
    begin = F.explode(F.sequence(F.greatest(F.col("at"), F.col("pos")) - F.col("span") + 1, F.least(F.col("at"), F.col("pos")))).alias("begin")
    frames = within.select("item", "doc_id", "row", "pos", "size", "term", begin)
    full = frames.groupBy("item", "doc_id", "row", "pos", "begin").agg(F.count_distinct("term").alias("got"), F.first("size").alias("size")).where("got = size")
    return full.select("item", "doc_id", "row", "pos").distinct()


def contamination_digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of words, hit words and items of each document; contaminated from two items on. From the index alone."""
    own, postings = _index(docs, items)
    ends = postings.where(F.col("term") == END).select("doc_id", "row", F.col("pos").alias("n_words"))
    rows = _filled(ends.join(_small(contaminated_rows(own, postings), SMALL_ITEMS), F.col("row") == F.col("found"), "left"))
    n = F.size("item_ids")
    return rows.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.size("hits").cast("bigint").alias("n_hit"),
        n.cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n >= 2).alias("contaminated"),
    )


#: The same in DuckDB, by window strings instead of an index.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), q AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS k, array_to_string(w[s:s + least(8, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 6))) AS s FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT k FROM q
), g AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, lengths WHERE len(w) >= k)
), m AS (
  SELECT g.doc_id, g.s, g.k, q.item_id FROM g JOIN q ON g.phrase = q.phrase AND g.k = q.k
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(named.ids, '')) AS items_sha256, coalesce(named.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
