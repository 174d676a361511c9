"""Text functions against their stated cases."""

from pyspark.sql import functions as F

from doclens.functions import script
from doclens.functions import text as T

R = "‏"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_marks(spark):
    md = "# כותרת\n- פריט 2024\n1. סעיף\n> ציטוט\n| א |\n<div>א\nLatin\n```\nעברית\n```"
    assert one(spark, T.mark_rtl_lines, md) == f"# {R}כותרת\n- {R}פריט 2024\n1. {R}סעיף\n> {R}ציטוט\n| א |\n<div>א\nLatin\n```\nעברית\n```"


def test_visual_order(spark):
    cases = {"שלום": (False, 1), "רושיג םכסה ךילהל": (True, 3), "אךב אלב אגב": (False, 3), "": (False, 0)}
    for text, (is_reversed, words) in cases.items():
        o = one(spark, script.visual_order, text)
        assert (o.reversed, o.words) == (is_reversed, words)
    assert one(spark, script.visual_order, "אךב אלב אגב").mid_word == 1
    assert one(spark, script.visual_order, "ךב ךג ךד").mid_word == 0
    assert one(spark, script.visual_order, None).words == 0


def test_scrambled(spark):
    bad = " ".join(["אבג"] * 40 + ["אםב"] * 2)
    assert one(spark, lambda c: script.scrambled_script(script.visual_order(c)), bad).mid_word == 2
    assert one(spark, lambda c: script.scrambled_script(script.visual_order(c)), " ".join(["אבג"] * 100 + ["אםב"])) is None


def test_headings(spark):
    assert one(spark, T.promote_headings, "**Title**\n\nbody\n\n**A sentence.**\n\nmore\n\n**Bye**") == "## Title\n\nbody\n\n**A sentence.**\n\nmore\n\n**Bye**"
    assert one(spark, T.promote_headings, "# Real\n\n**Title**\n\nbody") == "# Real\n\n**Title**\n\nbody"


def test_numbering(spark):
    assert one(spark, T.preserve_numbering, "1. a\n\n1. b\n2. c\n3. d") == "1\\. a\n\n1\\. b\n2\\. c\n3\\. d"
    for same in ("1. a\n2. b\n3. c", "72. a\n73. b", "5. a\ntext\n6. b", "```\n1. a\n1. b\n```"):
        assert one(spark, T.preserve_numbering, same) == same
    assert one(spark, T.preserve_numbering, "2. a\n4. b") == "2\\. a\n4\\. b"
    once = one(spark, T.preserve_numbering, "2. a\n4. b")
    assert one(spark, T.preserve_numbering, once) == once


def test_block_markers(spark):
    for text, want in {"# x": "\\# x", "> x": "\\> x", "- p 1 -": "\\- p 1 -", "- x": "- x", "1. x": "1. x"}.items():
        assert one(spark, T.escape_block_marker, text) == want


def test_front_matter(spark):
    df = spark.createDataFrame([('a"b: c\nsource: evil', 'x"y:z', "body")], "title string, source string, t string")
    made = df.select(T.add_rtl_support(F.col("t"), F.col("title"), F.col("source")).alias("md"))
    got = made.select(T.parse_front_matter(F.col("md")).alias("f")).first().f
    assert got.fields["title"] == 'a"b: c\nsource: evil' and got.fields["source"] == 'x"y:z' and set(got.fields) == {"title", "source", "dir"}
    assert got.body == "\nbody"


def test_sidecar(spark):
    assert one(spark, T.parse_sidecar, "text\f[OCR skipped on page(s) 2-3]\f") == "text"
    assert one(spark, T.parse_sidecar, "[OCR skipped on page(s) 1]") == "" and one(spark, T.parse_sidecar, "\f\f") == ""


def test_normalise(spark):
    assert one(spark, T.normalise, "é *a* b‏") == "éab"
    assert one(spark, T.digest, "a b") == one(spark, T.digest, "*a*\tb")
    assert one(spark, T.number_tokens, "in 2024, 1,300.50 and 7") == ["2024,", "1,300.50", "7"]
    assert one(spark, T.normalise, None) is None


def test_numbering_of_huge_numbers(spark):
    huge = "9223372036854775807. a\n9223372036854775808. b"
    assert one(spark, T.preserve_numbering, huge) == huge.replace(". ", "\\. ")
    assert one(spark, T.preserve_numbering, "9223372036854775807. a") == "9223372036854775807. a"
