"""Slides: parts, relationships, notes, pictures and sections.

zip_parts: doc_id, part, content; rels: doc_id, src_part, rel_id, rel_type, target_part; slides: doc_id, slide, part,
paragraphs, has_picture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions import chars as C
from doclens.functions.script import detect_language

SLIDE_PART = r"^ppt/slides/slide(\d+)\.xml$"
FURNITURE = r"sldNum|ftr|dt|sldImg"
# What sections are called, by language.
LABELS = {"en": ("Slide", "Speaker notes", "Text recognised in the picture", "*(no text on this slide)*"), "he": ("שקופית", "הערות דובר", "טקסט שזוהה בתמונה", "*(אין טקסט בשקופית זו)*")}


def unescape_xml(text: Column) -> Column:
    """Named entities; &amp; last, so that nothing is decoded twice."""
    out = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def paragraphs(xml: Column) -> Column:
    """array<string>: the text runs of each paragraph, joined as they are, white space shortened, empty ones dropped.
    Shapes that hold slide numbers, footers, dates or slide images are left out."""
    body = F.regexp_replace(xml, rf'(?s)<p:sp>(?:(?!</p:sp>).)*<p:ph\b[^>]*type="(?:{FURNITURE})"(?:(?!</p:sp>).)*</p:sp>', "")
    runs = lambda p: F.regexp_extract_all(p, F.lit(r"(?s)<a:t(?:\s[^>]*)?>(.*?)</a:t>"), F.lit(1))
    texts = F.transform(F.split(body, "</a:p>"), lambda p: F.trim(F.regexp_replace(unescape_xml(F.array_join(runs(p), "")), f"[{C.SPACE}]+", " ")))
    return F.filter(texts, lambda t: t != "")


def rels_path(part: Column) -> Column:
    return F.regexp_replace(part, r"^(.*/)?([^/]+)$", "$1_rels/$2.rels")


def resolve_target(src_part: Column, target: Column) -> Column:
    """A relationship's target as a part name: from the root if it begins with /, else from the source's folder."""
    joined = F.when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.concat(F.regexp_replace(src_part, r"[^/]+$", ""), target))
    none = F.expr("CAST(array() AS array<string>)")
    step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == ".") | (p == ""), acc).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(joined, "/"), none, step), "/")


def relationships(zip_parts: DataFrame) -> DataFrame:
    """rels of every part that has a relationship part."""
    xml = F.decode("content", "UTF-8")
    rows = zip_parts.where(F.col("part").rlike(r"(^|/)_rels/[^/]+\.rels$")).select(
        "doc_id", F.regexp_replace("part", r"_rels/([^/]+)\.rels$", "$1").alias("src_part"), F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<Relationship\s[^>]*>"), F.lit(0))).alias("tag")
    )
    get = lambda name: unescape_xml(F.regexp_extract("tag", rf'\s{name}="([^"]*)"', 1))
    return rows.select("doc_id", "src_part", get("Id").alias("rel_id"), F.regexp_extract(get("Type"), "([^/]+)$", 1).alias("rel_type"), resolve_target(F.col("src_part"), get("Target")).alias("target_part"))


def slide_table(zip_parts: DataFrame) -> DataFrame:
    """slides by number of their part."""
    xml = F.decode("content", "UTF-8")
    return zip_parts.where(F.col("part").rlike(SLIDE_PART)).select(
        "doc_id", F.regexp_extract("part", SLIDE_PART, 1).cast("int").alias("slide"), "part", paragraphs(xml).alias("paragraphs"), xml.contains("<p:pic").alias("has_picture")
    )


def notes(slides: DataFrame, rels: DataFrame, zip_parts: DataFrame) -> DataFrame:
    """doc_id, slide, notes: by relationship, never by file number. Slides without notes give no row."""
    to = rels.where("rel_type = 'notesSlide'").select("doc_id", F.col("src_part").alias("part"), "target_part")
    parts = zip_parts.select("doc_id", F.col("part").alias("target_part"), paragraphs(F.decode("content", "UTF-8")).alias("notes"))
    return slides.select("doc_id", "slide", "part").join(to, ["doc_id", "part"]).join(parts, ["doc_id", "target_part"]).where(F.size("notes") > 0).select("doc_id", "slide", "notes")


def pictures(zip_parts: DataFrame, rels: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """media(doc_id, slide, rel_id, part, pic_ix, content): images that a slide's pictures embed, in the order of the
    pictures; of the wanted slides (doc_id, slide) only. Their bytes are joined last."""
    xml = F.decode("content", "UTF-8")
    slide = F.regexp_extract("part", SLIDE_PART, 1).cast("int").alias("slide")
    own = zip_parts.where(F.col("part").rlike(SLIDE_PART)).select("doc_id", slide, F.col("part").alias("src_part"), xml.alias("xml"))
    if wanted is not None:
        own = own.join(wanted, ["doc_id", "slide"], "left_semi")
    embeds = F.flatten(F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<p:pic\b.*?</p:pic>"), F.lit(0)), lambda p: F.regexp_extract_all(p, F.lit(r'r:embed="([^"]+)"'), F.lit(1))))
    ids = own.select("doc_id", "slide", "src_part", F.posexplode(embeds).alias("pic_ix", "rel_id"))
    found = ids.join(rels.where("rel_type = 'image'"), ["doc_id", "src_part", "rel_id"])
    media = zip_parts.select("doc_id", F.col("part").alias("target_part"), "content")
    return found.join(media, ["doc_id", "target_part"]).select("doc_id", "slide", "rel_id", F.col("target_part").alias("part"), "pic_ix", "content")


def deck_labels(slides: DataFrame) -> DataFrame:
    """doc_id, labels: he for a deck that is Hebrew, else en. A deck in Arabic is not."""
    text = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slide", "paragraphs"))), lambda s: s["paragraphs"])), " ")
    return slides.groupBy("doc_id").agg(text.alias("t")).select("doc_id", F.when(detect_language(F.col("t"))["lang"] == "he", "he").otherwise("en").alias("labels"))


def sections(slides: DataFrame, note_rows: DataFrame, ocr_texts: DataFrame | None = None) -> DataFrame:
    """doc_id, slide, md: heading, then paragraphs, or recognised text, or a word that there is none; then the notes."""
    rows = slides.join(deck_labels(slides), "doc_id").join(note_rows, ["doc_id", "slide"], "left")
    if ocr_texts is None:
        rows = rows.withColumn("ocr", F.lit(None).cast("string"))
    else:
        rows = rows.join(ocr_texts.select("doc_id", F.col("page").alias("slide"), F.col("text").alias("ocr")), ["doc_id", "slide"], "left")
    label = lambda k: F.when(F.col("labels") == "he", LABELS["he"][k]).otherwise(LABELS["en"][k])
    n = F.col("slide").cast("string")
    head = F.concat(F.lit("## "), label(0), F.lit(" "), n)
    body = (
        F.when(F.size("paragraphs") > 0, F.array_join("paragraphs", "\n\n"))
        .when(F.coalesce("ocr", F.lit("")) != "", F.concat(F.lit("<!-- Slide "), n, F.lit(" OCR -->\n**"), label(2), F.lit(":**\n\n"), "ocr"))
        .otherwise(label(3))
    )
    said = F.when(F.col("notes").isNotNull(), F.concat(F.lit("<!-- Slide "), n, F.lit(" notes -->\n> **"), label(1), F.lit(":** "), F.array_join("notes", " ")))
    return rows.select("doc_id", "slide", F.concat_ws("\n\n", head, body, said).alias("md"))


def summaries(slides: DataFrame, note_rows: DataFrame, ocr_texts: DataFrame | None = None) -> DataFrame:
    """verify lines of a second reading: doc_id, page, line_ix, text; the slide's label first, then paragraphs or
    recognised text, then notes."""
    labels = deck_labels(slides).select("doc_id", F.when(F.col("labels") == "he", LABELS["he"][0]).otherwise(LABELS["en"][0]).alias("label"))
    rows = slides.join(labels, "doc_id").join(note_rows, ["doc_id", "slide"], "left")
    rows = rows.withColumn("ocr", F.lit(None).cast("string")) if ocr_texts is None else rows.join(ocr_texts.select("doc_id", F.col("page").alias("slide"), F.col("text").alias("ocr")), ["doc_id", "slide"], "left")
    content = F.when(F.size("paragraphs") > 0, F.col("paragraphs")).when(F.col("ocr").isNotNull(), F.array("ocr")).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(F.concat("label", F.lit(" "), F.col("slide").cast("string"))), content, F.coalesce("notes", F.array().cast("array<string>")))
    return rows.select("doc_id", F.col("slide").alias("page"), F.posexplode(every).alias("line_ix", "text"))


def documents(section_rows: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("slide", "md"))), lambda s: s["md"])
    return section_rows.groupBy("doc_id").agg(F.concat(F.array_join(ordered, "\n\n"), F.lit("\n")).alias("raw_md"))


