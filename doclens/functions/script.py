"""Script and direction of a text. Column functions; a null text gives null counts and verdicts of an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens.functions import chars as C


def count_of(text: Column, members: str) -> Column:
    """How many characters are in the class."""
    return F.length(F.regexp_replace(text, f"[^{members}]", ""))


def rtl_ratio(text: Column) -> Column:
    """Share of right-to-left characters among letters; 0 without letters."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")
    return F.when(F.length(letters) == 0, F.lit(0.0)).otherwise(count_of(letters, C.RTL) / F.length(letters))


def detect_script(text: Column) -> Column:
    """he where Hebrew outweighs Arabic, else ar where there is any, else und."""
    hebrew, arabic = count_of(text, C.HEBREW), count_of(text, C.ARABIC)
    return F.when(hebrew > arabic, "he").when(arabic > 0, "ar").otherwise("und")


def detect_language(text: Column) -> Column:
    """struct<dir, lang>: rtl above the threshold, with the script as its language; else ltr and no language."""
    rtl = rtl_ratio(text) > C.RTL_THRESHOLD
    return F.struct(F.when(rtl, "rtl").otherwise("ltr").alias("dir"), F.when(rtl, detect_script(text)).alias("lang"))


def visual_order(text: Column) -> Column:
    """struct<reversed, judged, leading, trailing, mid_word, words> over words of two Hebrew characters or more:
    where their final forms stand."""
    kept = F.transform(F.split(F.coalesce(text, F.lit("")), f"[{C.SPACE}]+"), lambda w: F.regexp_replace(w, f"[^{C.HEBREW}]", ""))
    words = F.filter(kept, lambda w: F.length(w) >= 2)
    tally = lambda p: F.size(F.filter(words, lambda w: w.rlike(p)))
    n, leading, trailing = F.size(words), tally(f"^[{C.FINALS}]"), tally(f"[{C.FINALS}]$")
    judged = n >= C.MIN_WORDS
    return F.struct(
        (judged & (leading > trailing)).alias("reversed"),
        judged.alias("judged"),
        leading.alias("leading"),
        trailing.alias("trailing"),
        tally(f"^.+[{C.FINALS}].+$").alias("mid_word"),
        n.alias("words"),
    )


def scrambled_script(order: Column) -> Column:
    """struct<mid_word, words, rate> of a visual_order verdict where final forms inside words pass the rate, else null."""
    rate = order["mid_word"] / order["words"]
    return F.when(order["judged"] & (rate > C.SCRAMBLED_RATE), F.struct(order["mid_word"].alias("mid_word"), order["words"].alias("words"), rate.alias("rate")))
