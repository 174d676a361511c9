"""Fuzzy line deduplication by MinHash. DataFrame functions only.

A line, lower-cased and trimmed, is the set of its shingles of ``SHINGLE`` characters. Each different line is taken
once: repeated lines fall together before any shingle is made. Its signature takes each shingle's hash once: the hash
picks one of ``BINS`` bins and the least hash of each bin is kept (one-permutation MinHash); an empty bin borrows from
the next ones. Bands are ``BANDS`` sets of ``ROWS`` bins; with as few rows as would do for small tables, unrelated lines
would share buckets in numbers that grow with the square of the corpus. A sample of the shingles, chosen by what they
hold (a shingle that follows a blank), is enough for a long line. Every line has a signature of its sample, if there is
any; lines of fewer than ``ALL_BELOW`` places, and longer ones whose sample fills fewer than ``FILLED`` bins (rulers,
repeated words, scripts without blanks), have one of all their shingles, too. So every line has a band, and two lines
of a similarity of 0.8 have a kind of signature in common, unless ``FILLED`` bins of one are filled by shingles that the
other lacks and nothing of that other is sampled.

Every pair that shares a bucket is compared, unless its lines are known to be joined already. First, every line is
compared with the bucket's first line and with the one before it, in an order of each band's own, which joins most
groups; then, in the buckets of more than three lines that still hold several groups, all pairs of different groups that
have not been compared before (of two or three lines, all pairs have been). Large buckets are cut into
blocks, and each pair of blocks is compared by a task's join. Each line has a bitmap of ``WORDS`` * 64 bits, each the
parity of its shingles whose hashes fall there: a shingle that only one of two lines has turns one bit, so bitmaps
differ in no more bits than the sets do in shingles, and pairs whose bitmaps differ in more than the threshold allows
are left out without loss; for the others the Jaccard similarity of the whole shingle sets, as 64-bit hashes, decides.
It is found from the pieces (words with what their shingles reach into) that only one line has, as a shingle that only
one has lies in one of them; whole sets are made where those pieces hold more than ``FEW`` shingles and leave it open.
What the lines share turns no bit, so that long lines are told apart as well as short ones. Linked lines are joined by distributed
union-find, and of each component the first occurrence by doc_id and place stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclens.llm.components import connected_components
from doclens.llm.store import materialise

SHINGLE = 8
THRESHOLD = 0.8
BINS, ROWS, BANDS = 32, 4, 16  # at 0.8 a pair shares a bucket with probability 0.996, at 0.3 with 0.12, at 0.02 with 3e-6
BORROW = (0, 5, 11, 18)  # the bin itself and those that an empty one borrows from, in turn
ALL_BELOW, FILLED = 100, 10  # places; bins
ARRAY = 100_000  # characters of a line whose shingles may all be in one array
WORDS = 16  # of 64 bits, in a bitmap
FEW = 256  # shingles that are looked for in the other line one by one
BLOCK = 256  # lines of a bucket that are compared at once
SMALL_KEYS, SMALL_ROWS = 2_000_000, 500_000  # of 8 bytes; of a document with its dropped places


def _small(df: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= bound else df


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, ix, norm, key of every line that isn't blank. row tells rows apart that share a doc_id."""
    # row is a column of its own, so that it is made once a document and not once a line; parts is none, as a filter on
    # its size would be put before it, which splits each text twice
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    every = texts.select("doc_id", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ix", "line")).where(F.trim("line") != "")
    return every.select("doc_id", "row", "ix", normal("line").alias("norm")).withColumn("key", F.xxhash64("norm"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """key, norm of each different line, repeated ones gone before the shuffle."""
    return lines.groupBy("key").agg(F.min("norm").alias("norm"))


def _units(norm: Column) -> Column:
    """Four bytes a code point, so that a shingle is a slice."""
    return F.encode(norm, "UTF-32")


def _shingle_count(units: Column) -> Column:
    """Places at which a shingle begins; a line shorter than one has one, all of it."""
    return F.greatest((F.length(units) / 4).cast("int") - (SHINGLE - 1), F.lit(1))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it. A select beside it would not do: filters are pushed
    through that, with the whole expression in each place."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _apart(c: str) -> Column:
    """A column as it is, by a lambda, which keeps its whole select out of whole-stage code: there many columns make one
    method, and one of more than 8000 bytes is never compiled by the JVM."""
    return _bound(F.col(c), lambda x: x).alias(c)


def _every(norm: Column) -> Column:
    """The hashes of all shingles of a line, repeats included."""
    hashes = lambda u: F.transform(F.sequence(F.lit(1), F.greatest(F.length(u) - (SHINGLE * 4 - 1), F.lit(1)), F.lit(4)), lambda at: F.xxhash64(F.substring(u, at, F.lit(SHINGLE * 4))))
    return _bound(_units(norm), hashes)


def _sampled(norm: Column) -> Column:
    """The same of the shingles that follow a blank; a match of the expression is one."""
    return F.transform(F.regexp_extract_all(norm, F.lit(f"(?s) (?=({'.' * SHINGLE}))"), F.lit(1)), lambda s: F.xxhash64(s))


def shingles(norm: Column) -> Column:
    """The hashes of the different shingles of a line."""
    return F.array_distinct(_every(norm))


def _bin(h: Column) -> Column:
    """By the first bits, so that sorted hashes lie bin by bin; from -BINS / 2."""
    return F.shiftright(h, 65 - BINS.bit_length()).cast("int")


def _bins(texts: DataFrame) -> DataFrame:
    """key, b1_0, b1_1, ... (the least hash of the sample in each bin), b0_0, ... (of all shingles), later; texts: key,
    norm. Where all shingles are called for and too many for an array, later is true and they are left out."""
    long = F.length("norm") >= ALL_BELOW + SHINGLE - 1
    # short lines, lines whose sample says little, and lines with nothing in it
    enough = long & (F.size(F.array_distinct("g1")) >= FILLED)
    # a select for each step: what one makes is stored once for the next
    each = texts.select("key", "norm", F.sort_array(_sampled(F.col("norm"))).alias("h1"))
    each = each.select("key", "norm", "h1", F.transform("h1", _bin).alias("g1"))
    each = each.select("key", "h1", "g1", (~enough & (F.length("norm") > ARRAY)).alias("later"), F.when(~enough & (F.length("norm") <= ARRAY), F.sort_array(_every(F.col("norm")))).alias("h0"))
    each = each.select("key", "h1", "g1", "later", "h0", F.transform("h0", _bin).alias("g0"))
    least = lambda k, b: F.get(f"h{k}", F.array_position(f"g{k}", F.lit(b - BINS // 2)).cast("int") - 1).alias(f"b{k}_{b}")
    return each.select(_apart("key"), "later", *(least(k, b) for k in (1, 0) for b in range(BINS)))


def _streamed_bins(texts: DataFrame) -> DataFrame:
    """The same of all shingles of a line, a row each, so that no array holds them."""
    each = texts.select("key", _units(F.col("norm")).alias("units"))
    each = each.select("key", "units", F.explode(F.sequence(F.lit(0), _shingle_count(F.col("units")) - 1)).alias("i"))
    each = each.select("key", F.xxhash64(F.substring("units", F.col("i") * 4 + 1, F.lit(SHINGLE * 4))).alias("h")).withColumn("bin", _bin(F.col("h")))
    least = (F.min(F.when(F.col("bin") == b - BINS // 2, F.col("h"))).alias(f"b0_{b}") for b in range(BINS))
    return each.groupBy("key").agg(*least)


def band_bins() -> list[list[int]]:
    """The bins of each band: the strides of a round over the bins give each bin to equally many bands, and two bands
    have one bin in common at most."""
    rounds = BANDS * ROWS // BINS
    per = BINS // ROWS
    return [[(b + 3 * k * r) % per + r * per for r in range(ROWS)] for k in range(rounds) for b in range(per)]


def _buckets(bins: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """key, buckets array<bigint>, and later if bins has it."""
    rest = [c for c in bins.columns if c == "later"]
    dense = bins.select(_apart("key"), *rest, *(F.coalesce(*(F.col(f"b{k}_{(b + o) % BINS}") for o in BORROW)).alias(f"d{k}_{b}") for k in kinds for b in range(BINS)))
    bands = []
    for k in kinds:
        for band, own in enumerate(band_bins()):
            # a band without any shingle says nothing
            some = F.coalesce(*(F.col(f"d{k}_{b}") for b in own)).isNotNull()
            bands.append(F.when(some, F.xxhash64(F.lit(band), F.lit(k), *(F.coalesce(f"d{k}_{b}", F.lit(-1)) for b in own))))
    return dense.select("key", *rest, F.array_compact(F.array(*bands)).alias("buckets"))


def signatures(lines: DataFrame) -> DataFrame:
    """key, buckets array<bigint> of each different line, of a long one in two rows; lines: key, norm."""
    each = materialise(_buckets(_bins(distinct_lines(lines)), (1, 0)), "line-signatures")
    later = each.where("later").select("key")
    if not later.isEmpty():
        rest = lines.select("key", "norm").where(F.length("norm") > ARRAY).join(_small(later, SMALL_KEYS), "key", "left_semi")
        each = each.drop("later").unionByName(materialise(_buckets(_streamed_bins(distinct_lines(rest)), (0,)), "line-signatures"))
    return each.select("key", "buckets")


def bitmaps(texts: DataFrame) -> DataFrame:
    """key, n (different shingles), w0, w1, ...: the parity of the shingles that fall on each bit; texts: key, norm."""
    each = texts.select("key", F.explode(shingles(F.col("norm"))).alias("h"))
    each = each.select("key", F.expr(f"CAST(shiftrightunsigned(h, 6) & {WORDS - 1} AS INT)").alias("word"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit"))
    words = (F.bit_xor(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in range(WORDS))
    return each.groupBy("key").agg(F.count("*").alias("n"), *words)


def _may_link(x: Column, y: Column, threshold: float) -> Column:
    """False only if the similarity is below threshold: sets that overlap by it differ in at most so many shingles."""
    differ = [F.bit_count(x[f"w{w}"].bitwiseXOR(y[f"w{w}"])) for w in range(WORDS)]
    return sum(differ[1:], differ[0]) <= (x["n"] + y["n"]) * ((1 - threshold) / (1 + threshold)) + 1e-6


def _pair(x: Column, y: Column) -> list[Column]:
    """a, b with the smaller key first, and the shingles of each."""
    ends = [F.struct(m["key"].alias("key"), m["n"].alias("n")) for m in (x, y)]
    a, b = F.least(*ends), F.greatest(*ends)
    return [a["key"].alias("a"), b["key"].alias("b"), a["n"].alias("a_n"), b["n"].alias("b_n")]


def first_pairs(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: each line of a bucket with the bucket's first and with its neighbour; members: bucket, m."""
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("m.key", "bucket"), "m.key")
    placed = members.select("m", F.first("m").over(order).alias("hub"), F.lag("m").over(order).alias("before"))
    pairs = placed.select("m", F.explode(F.array("hub", "before")).alias("o")).where(F.col("m.key") != F.col("o.key"))
    return pairs.where(_may_link(F.col("m"), F.col("o"), threshold)).select(*_pair(F.col("m"), F.col("o"))).distinct()


def other_pairs(members: DataFrame, marks: DataFrame, components: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: all pairs of a bucket that are in different components(key, component); members: bucket, key."""
    rooted = members.join(_small(components, SMALL_KEYS), "key", "left")
    rooted = materialise(rooted.select("bucket", "key", F.coalesce("component", "key").alias("root")), "line-rooted")
    mixed = rooted.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most AND n > 3")
    mixed = materialise(mixed.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "line-mixed")
    dealt = rooted.join(_small(mixed, SMALL_KEYS), "bucket").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.join(marks, "key").select("bucket", "root", "blocks", "block", F.struct(*marks.columns).alias("m"))
    side = lambda m, first, last: dealt.select("bucket", F.col("m").alias(m), F.col("root").alias(f"{m}_root"), F.explode(F.sequence(first, last)).alias("other"), "block")
    left = side("x", F.col("block"), F.col("blocks") - 1).withColumnsRenamed({"block": "i", "other": "j"})
    right = side("y", F.lit(0), F.col("block")).withColumnsRenamed({"block": "j", "other": "i"})
    apart = (F.col("x_root") != F.col("y_root")) & ((F.col("i") < F.col("j")) | (F.col("x.key") < F.col("y.key")))
    pairs = left.join(right, ["bucket", "i", "j"]).where(apart & _may_link(F.col("x"), F.col("y"), threshold))
    return pairs.select(*_pair(F.col("x"), F.col("y"))).distinct()


def _pieces(norm: Column) -> Column:
    """The words of a line, each with the blank and the characters after it that its shingles reach into: every shingle
    lies in a piece."""
    return F.regexp_extract_all(norm, F.lit(r"(?s)(?=([^ ]* ?.{0,%d}))[^ ]* ?" % (SHINGLE - 1)), F.lit(1))


def _linked(x: Column, y: Column, x_n: Column, y_n: Column, threshold: float) -> Column:
    """Whether the similarity of x and y, of x_n and y_n shingles, is threshold or more. Shingles that only one has lie
    in pieces that only it has, and their places bound the similarity from below; if that isn't enough, those of x are
    looked for in y one by one if they are few, or else the whole sets are made."""
    both = F.struct(shingles(x).alias("x"), shingles(y).alias("y"))
    similar = lambda common, union: common >= threshold * union - 1e-9
    whole = _bound(both, lambda s: _bound(F.size(F.array_intersect(s["x"], s["y"])), lambda n: similar(n, F.size(s["x"]) + F.size(s["y"]) - n)))
    only = lambda a, b: F.filter(F.array_except(a, b), lambda p: F.length(p) >= SHINGLE)
    places = lambda a: F.aggregate(a, F.lit(0), lambda n, p: n + F.length(p) - (SHINGLE - 1))
    slices = lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (SHINGLE - 1)), lambda i: F.substring(p, i, F.lit(SHINGLE)))
    missing = lambda a: F.size(F.filter(F.array_distinct(F.flatten(F.transform(a, slices))), lambda s: ~F.contains(y, s)))

    def judged(own: Column, most: Column) -> Column:
        surely = similar(F.greatest(x_n - most["x"], y_n - most["y"]), F.least(x_n + most["y"], y_n + most["x"]))
        return F.when(surely, True).when(most["x"] <= FEW, _bound(missing(own["x"]), lambda n: similar(x_n - n, y_n + n))).otherwise(whole)

    pieces = F.struct(_pieces(x).alias("x"), _pieces(y).alias("y"))
    own = _bound(pieces, lambda p: F.struct(only(p["x"], p["y"]).alias("x"), only(p["y"], p["x"]).alias("y")))
    apart = _bound(own, lambda o: _bound(F.struct(places(o["x"]).alias("x"), places(o["y"]).alias("y")), lambda most: judged(o, most)))
    return F.when((F.length(x) < SHINGLE) | (F.length(y) < SHINGLE), whole).otherwise(apart)


def verified_pairs(texts: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b of the pairs(a, b, a_n, b_n) whose shingle sets have a Jaccard similarity of threshold or more; texts: key, norm."""
    side = lambda k, x: texts.select(F.col("key").alias(k), F.col("norm").alias(x))
    sides = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return sides.where(_linked(F.col("x"), F.col("y"), F.col("a_n"), F.col("b_n"), threshold)).select("a", "b")


def links_between(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: links that join all lines that a chain of similar pairs joins, each pair in a common bucket."""
    each = signatures(lines).select("key", F.explode("buckets").alias("bucket"))
    together = each.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1")
    members = materialise(together.select("bucket", "key"), "line-members")
    wanted = materialise(members.select("key").distinct(), "line-keys")
    texts = materialise(distinct_lines(lines.select("key", "norm").join(_small(wanted, SMALL_KEYS), "key", "left_semi")), "line-texts")
    marks = materialise(bitmaps(texts), "line-bitmaps")
    marked = members.join(marks, "key").select("bucket", F.struct(*marks.columns).alias("m"))
    compared = materialise(first_pairs(marked, threshold), "line-pairs")
    links = materialise(verified_pairs(texts, compared, threshold), "line-links")
    components = connected_components(links, "line-groups").withColumnRenamed("id", "key")
    others = other_pairs(members, marks, components, threshold).join(compared, ["a", "b"], "left_anti")
    more = verified_pairs(texts, materialise(others, "line-pairs"), threshold)
    return links.unionByName(materialise(more, "line-links"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with their columns, text without the lines that repeat an earlier one, and n_lines and
    n_kept_lines: lines that are not blank, before and after.

    Earlier is the smaller doc_id, then the earlier line; a null doc_id comes first. Blank lines stay. A null text
    stays null and has no lines. Repeated rows (same doc_id and text) keep the same lines each; rows that share a
    doc_id only are documents of their own. A column of docs called n_lines or n_kept_lines is replaced. An empty
    table gives none. Lines are told apart by 64 bits of hash."""
    lines = _lines(docs)
    places = materialise(lines.select("doc_id", "row", "ix", "key"), "line-places")
    components = connected_components(links_between(lines, threshold), "lines").withColumnRenamed("id", "key")
    place = F.struct("doc_id", "row", "ix")
    # one row for each different line before groups meet, so that a line that fills a third of all places is one row
    keys = places.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(_small(components, SMALL_KEYS), "key", "left")
    keys = materialise(keys.select("key", "first", "n", F.coalesce("component", "key").alias("line")), "line-places")
    groups = keys.groupBy("line").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("line", "first")
    repeated = materialise(keys.select("key", "line").join(groups, "line").select("key", "first"), "line-repeated")
    dropped = places.join(_small(repeated, SMALL_KEYS), "key").where(~place.eqNullSafe(F.col("first"))).groupBy("row").agg(F.collect_set("ix").alias("dropped"))
    ix, of = (next(x for x in (c + "_" * n for n in range(len(docs.columns) + 1)) if x not in docs.columns) for c in ("dropped", "dropped_of"))
    dropped = materialise(dropped.select(F.col("row").alias(of), F.col("dropped").alias(ix)), "line-dropped")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_kept_lines")]
    own = F.xxhash64("doc_id", "text")
    out = docs.select(*columns).join(_small(dropped, SMALL_ROWS), own == F.col(of), "left")
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(ix, i)), "\n")
    return out.select(
        *(F.when(F.col(ix).isNotNull(), kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in columns),
        n.cast("bigint").alias("n_lines"),
        (n - F.coalesce(F.size(ix), F.lit(0))).cast("bigint").alias("n_kept_lines"),
    )
