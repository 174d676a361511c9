"""Secrets in text: patterned ones, and strings of high entropy. DataFrame functions only.

Patterned kinds (assign, access, hex) are found by regular expressions. Candidate strings for the entropy kinds are
runs of base64 or hex characters; over each slides a window of ``WINDOW`` characters whose Shannon entropy follows
from counts by character: when one character enters and one leaves, two counts change, and with them the sum of
c log2 c that the entropy needs. A class has its own threshold, since hex digits reach 4 bits at most. A span
runs from the first to the last of the windows over the threshold that overlap or touch. Patterned spans, and the words
(letters and digits) that hold something on the allow list, are cut out of a run first; each piece left is a candidate.
A candidate without digits needs letters of both cases.

Everything happens within a row, so nothing is shuffled and no group can be large. Positions are code points,
ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 24
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character, in a window of 24: random hex has 3.3 on average, random base64 4.2, prose without blanks 3.4.
THRESHOLDS = {"entropy_hex": 2.9, "entropy_base64": 3.9}
#: Strings that look random and are no secrets: UUIDs, placeholders, one repeated unit, alphabets and digit rows.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|dummy|changeme|x{6,}",
    r"^(.{1,8})\1+$",
    r"(?i)abcdefghijkl|0123456789",
)


def spans(text: Column, pattern: str, groups: tuple[int, ...] = (0,)) -> Column:
    """array<struct<start int, end int, g0 string, ...>> of the leftmost non-overlapping matches of a pattern that
    doesn't match the empty string; their places follow from the lengths of what lies between."""
    between = F.split(text, pattern, -1)
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    row = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), *(F.lit("").alias(f"g{g}") for g in groups))
    start = F.struct(F.lit(0).alias("at"), F.filter(F.array(row), lambda x: F.lit(False)).alias("out"))
    zipped = F.arrays_zip(F.slice(between, 1, F.size(found[0])).alias("b"), *(x.alias(f"m{g}") for g, x in zip(groups, found)))

    def add(acc, x):
        begin = acc["at"] + F.length(x["b"])
        end = begin + F.length(x[f"m{groups[0]}"])
        one = F.struct(begin.alias("start"), end.alias("end"), *(x[f"m{g}"].alias(f"g{g}") for g in groups))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(zipped, start, add, lambda acc: acc["out"])


def blanked(text: Column, cut: Column) -> Column:
    """text with blanks at the places of cut, array<struct<start, end>>."""
    ordered = F.array_sort(F.transform(cut, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc, c):
        kept = F.substr(text, acc["at"] + F.lit(1), F.greatest(c["start"] - acc["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(c["end"] - F.greatest(c["start"], acc["at"]), F.lit(0)))
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), F.concat(acc["out"], kept, blank).alias("out"))

    return F.aggregate(ordered, start, add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + F.lit(1), F.length(text))))


def entropy_extents(candidate: Column, threshold: Column) -> Column:
    """array<struct<first int, last int>>: the first and the last start of each group of windows of entropy at least
    threshold that overlap or touch."""
    xlog = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    place = lambda at: F.instr(F.lit(ALPHABET), F.substr(candidate, at + F.lit(1), F.lit(1))) - F.lit(1)
    count = lambda counts, i: F.get(counts, i).cast("double")
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0.0).alias("s"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
        F.filter(F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"))), lambda x: F.lit(False)).alias("done"),
    )

    def group(acc):
        return F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    def slide(acc, at):
        new, old = place(at), F.when(at >= WINDOW, place(at - F.lit(WINDOW))).otherwise(F.lit(-1))
        left = F.when(old >= 0, count(acc["counts"], old)).otherwise(F.lit(0.0))
        after = F.transform(acc["counts"], lambda c, i: c - F.when(i == old, 1).otherwise(0) + F.when(i == new, 1).otherwise(0))
        entered = count(acc["counts"], new) - F.when(old == new, 1.0).otherwise(0.0)
        s = acc["s"] + xlog(left - 1) - xlog(left) + xlog(entered + 1) - xlog(entered)
        begin = at - F.lit(WINDOW - 1)
        hit = (begin >= 0) & (F.log2(F.lit(float(WINDOW))) - s / WINDOW >= threshold)
        new_group = hit & (acc["first"] >= 0) & (begin - acc["last"] > WINDOW)
        return F.struct(
            after.alias("counts"),
            s.alias("s"),
            F.when(new_group | hit & (acc["first"] < 0), begin).otherwise(acc["first"]).alias("first"),
            F.when(hit, begin).otherwise(acc["last"]).alias("last"),
            F.when(new_group, F.concat(acc["done"], group(acc))).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.length(candidate) - 1), start, slide, lambda acc: F.when(acc["first"] >= 0, F.concat(acc["done"], group(acc))).otherwise(acc["done"]))


def find_secrets(docs: DataFrame, extra: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, and secrets array<struct<kind, start, end>> in order of start, then of KINDS, for every row of
    docs(doc_id, text).

    ``extra`` are the allow-list patterns for entropy candidates. A null or empty text has no secrets; rows with a
    null doc_id and repeated rows are treated like others; other columns are not read; an empty table gives none."""
    none = "CAST(array() AS array<struct<start:int,end:int,kind:string,rank:int>>)"

    bare = "CAST(array() AS array<struct<start:int,end:int>>)"

    def kind(found: Column, i: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(KINDS[i]).alias("kind"), F.lit(i).alias("rank")))

    text = F.col("text")
    # cheap tests first: no assignment without : or =, no key id without AKIA
    assign = F.when(text.rlike("[:=]") & text.rlike(ASSIGN), kind(F.filter(spans(text, ASSIGN, (0, 2)), lambda m: F.length(m["g2"]) >= 6), 0))
    access = F.when(text.contains("AKIA"), kind(spans(text, ACCESS), 1))
    hexed = F.when(text.rlike(HEX), kind(spans(text, HEX), 2))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.concat(*(F.coalesce(x, F.expr(none)) for x in (assign, access, hexed))).alias("base")
    )
    base = base.withColumn("rest", F.when(text.rlike(CANDIDATE), F.when(F.size("base") > 0, blanked(text, F.col("base"))).otherwise(text)))
    rest = F.col("rest")
    piece = lambda start, g0: F.struct(start.alias("start"), g0.alias("g0"))

    def pieces(m):
        """What the allow list leaves of a run."""
        run = m["g0"]
        words = (F.when(run.rlike(p), spans(run, rf"(?<![A-Za-z0-9])[A-Za-z0-9]*?(?:{p})[A-Za-z0-9]*")) for p in extra)
        cut = F.concat(*(F.coalesce(F.transform(x, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"))), F.expr(bare)) for x in words))
        left = F.transform(spans(blanked(run, cut), CANDIDATE), lambda x: piece(m["start"] + x["start"], x["g0"]))
        return F.when(run.rlike("|".join(f"(?:{p})" for p in extra)), left).otherwise(F.array(piece(m["start"], run)))

    runs = spans(rest, CANDIDATE)
    candidates = F.flatten(F.transform(runs, pieces)) if extra else F.transform(runs, lambda m: piece(m["start"], m["g0"]))
    candidates = F.filter(candidates, lambda m: m["g0"].rlike("[A-Za-z]") & (m["g0"].rlike("[0-9]") | m["g0"].rlike("[A-Z]") & m["g0"].rlike("[a-z]")))

    def entropic(m):
        hexes = m["g0"].rlike("^[0-9a-fA-F]+$")
        extents = entropy_extents(m["g0"], F.when(hexes, THRESHOLDS["entropy_hex"]).otherwise(THRESHOLDS["entropy_base64"]))
        rank = F.when(hexes, F.lit(3)).otherwise(F.lit(4))
        return F.transform(
            extents,
            lambda x: F.struct(
                (m["start"] + x["first"]).alias("start"),
                (m["start"] + x["last"] + F.lit(WINDOW)).alias("end"),
                F.element_at(F.array(*map(F.lit, KINDS)), rank + 1).alias("kind"),
                rank.alias("rank"),
            ),
        )

    new = F.when(rest.rlike(CANDIDATE), F.flatten(F.transform(candidates, entropic)))
    every = F.concat("base", F.coalesce(new, F.expr(none)))
    ordered = F.array_sort(F.transform(every, lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"])))
    return base.select("doc_id", F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("secrets"))


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts of the patterned kinds, the digest of their spans, and all spans as text."""
    written = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("secrets", lambda x: x["kind"].isin(*KINDS[:3]))
    return find_secrets(docs).select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
