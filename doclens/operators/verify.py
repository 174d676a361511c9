"""Verification of an output against an independent reading of the pages.

Tables: lines(doc_id, page, line_ix, text), pages(doc_id, page, images, undecoded), outputs(doc_id, rendered).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclens.functions import chars as C
from doclens.functions import text as T
from doclens.functions.script import scrambled_script, visual_order
from doclens.operators.furniture import image_key, repeated_furniture, repeated_images

SHOWN = 8
MIN_SHARE = 0.1
MIN_PIXELS = 64


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{C.SPACE}]+|[{C.SPACE}]+$", "")


def keyed_lines(lines: DataFrame, compose: bool = True) -> DataFrame:
    """Lines that hold a letter or a digit, with bullets off: doc_id, page, line_ix, text, line (as drawn, trimmed), key."""
    own = F.regexp_replace("text", rf"^\s*[-*+\x{{2022}}]\s+", "")
    rows = lines.select("doc_id", "page", "line_ix", own.alias("text"), _trim(F.col("text")).alias("line"))
    return rows.withColumn("key", T.normalise(F.col("text"), compose)).where(F.col("key").rlike(r"[\p{L}\p{N}]"))


def page_furniture(lines: DataFrame) -> DataFrame:
    """doc_id, line: what the converter drops as furniture, by its own test, guard included."""
    sizes = lines.groupBy("doc_id", "page").agg(F.count("*").alias("size"))
    return repeated_furniture(lines.select("doc_id", "page", _trim(F.col("text")).alias("text")), sizes).withColumnRenamed("text", "line")


def flagged_lines(lines: DataFrame, compose: bool = True) -> DataFrame:
    """keyed_lines with is_furniture."""
    furniture = page_furniture(lines).withColumn("is_furniture", F.lit(True))
    return keyed_lines(lines, compose).join(furniture, ["doc_id", "line"], "left").withColumn("is_furniture", F.coalesce("is_furniture", F.lit(False)))


def settled_lines(flagged: DataFrame, outputs: DataFrame, compose: bool = True) -> DataFrame:
    """doc_id, page, line_ix, line, kind of the first of each different line of flagged_lines: null if the output holds
    it, furniture, reordered if the output has all the line's words, else missing.

    Lines that equal an output line are settled by an equi-join; only the others are looked for in the whole output,
    and only the words of those that are not there meet the output's words, again by an equi-join."""
    first = Window.partitionBy("doc_id", "key").orderBy("page", "line_ix")
    firsts = flagged.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")
    out_lines = outputs.select("doc_id", F.explode(F.split("rendered", "\n")).alias("l")).select("doc_id", T.normalise(F.col("l"), compose).alias("key")).where("key <> ''").distinct()
    firsts = firsts.join(out_lines.withColumn("equal", F.lit(True)), ["doc_id", "key"], "left")
    whole = outputs.select("doc_id", T.normalise(F.col("rendered"), compose).alias("haystack"))
    lost = firsts.where("equal IS NULL").join(whole, "doc_id", "left").where(~F.coalesce(F.contains("haystack", "key"), F.lit(False)))
    held = outputs.select("doc_id", F.explode(T.words(F.col("rendered"), compose)).alias("word")).distinct()
    wanted = lost.select("doc_id", "page", "line_ix", F.explode(T.words(F.col("text"), compose)).alias("word"))
    absent = wanted.join(held, ["doc_id", "word"], "left_anti").select("doc_id", "page", "line_ix").distinct().withColumn("absent", F.lit(True))
    kind = F.when(F.col("is_furniture"), "furniture").when(F.col("absent"), "missing").otherwise("reordered")
    found = lost.join(absent, ["doc_id", "page", "line_ix"], "left").select("doc_id", "page", "line_ix", kind.alias("kind"))
    return firsts.select("doc_id", "page", "line_ix", "line").join(found, ["doc_id", "page", "line_ix"], "left")


def classify_lines(lines: DataFrame, outputs: DataFrame, compose: bool = True) -> DataFrame:
    """doc_id, kind, page, line_ix, text of the first of each different line that the output doesn't hold."""
    settled = settled_lines(flagged_lines(lines, compose), outputs, compose)
    return settled.where("kind IS NOT NULL").select("doc_id", "kind", "page", "line_ix", F.col("line").alias("text"))


def number_counts(rows: DataFrame, text: str) -> DataFrame:
    """doc_id, value, n."""
    return rows.select("doc_id", F.explode(T.number_tokens(F.col(text))).alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def number_diff(kept: DataFrame, outputs: DataFrame) -> DataFrame:
    """doc_id, value, source_n, output_n of each number that occurs a different number of times on the two sides.
    kept: doc_id, text; outputs: doc_id, rendered."""
    before, after = number_counts(kept, "text").withColumnRenamed("n", "s"), number_counts(outputs, "rendered").withColumnRenamed("n", "o")
    both = before.join(after, ["doc_id", "value"], "full_outer")
    source, output = F.coalesce("s", F.lit(0)).cast("bigint"), F.coalesce("o", F.lit(0)).cast("bigint")
    return both.select("doc_id", "value", source.alias("source_n"), output.alias("output_n")).where("source_n <> output_n")


def kept_lines(lines: DataFrame, compose: bool = True) -> DataFrame:
    """Lines that aren't furniture, repeats included."""
    return flagged_lines(lines, compose).where("NOT is_furniture").select("doc_id", "page", "line_ix", "text")


def page_detail(lines: DataFrame, pages: DataFrame, compose: bool = True) -> DataFrame:
    """doc_id, page, lines, characters, digest, images, undecoded, picture, has_text of each page. A page of images
    without a line is a picture."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "text"))), lambda x: x["text"])
    joined = lines.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), texts.alias("texts"))
    rows = pages.join(joined, ["doc_id", "page"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    return rows.select(
        "doc_id",
        "page",
        F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines"),
        F.length(T.normalise(F.array_join("texts", ""), compose)).cast("bigint").alias("characters"),
        T.digest(F.array_join("texts", "\n"), compose).alias("digest"),
        "images",
        "undecoded",
        ((F.col("images") > 0) & F.col("lines").isNull()).alias("picture"),
        F.col("lines").isNotNull().alias("has_text"),
    )


def illustrations(images: DataFrame, details: DataFrame) -> DataFrame:
    """doc_id, page, width, height, share of large images on pages with text that aren't drawn alike on most pages and
    aren't known to have too few pixels for a word. images: doc_id, page, image_ix, width, height, x, y, share, px_w, px_h."""
    repeated = repeated_images(images, details.select("doc_id", "page"))
    text_pages = details.where("lines > 0 AND NOT picture").select("doc_id", "page")
    rows = images.withColumn("key", image_key()).join(text_pages, ["doc_id", "page"], "left_semi").join(repeated, ["doc_id", "key"], "left_anti")
    rows = rows.where((F.col("share") >= MIN_SHARE) & (F.col("px_w").isNull() | ((F.col("px_w") >= MIN_PIXELS) & (F.col("px_h") >= MIN_PIXELS))))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "page", "key").orderBy("image_ix"))).where("rank = 1")
    half_up = lambda c: F.floor(c + 0.5)
    return rows.select("doc_id", "page", "image_ix", half_up(F.col("width")).cast("bigint").alias("width"), half_up(F.col("height")).cast("bigint").alias("height"), (half_up(F.col("share") * 100) / 100).alias("share"))


def script_alarm(kept: DataFrame) -> DataFrame:
    """doc_id, scrambled: the alarm over the kept lines of each document, or null. Lines are counted one by one and
    added up, so no text is joined."""
    order = kept.select("doc_id", visual_order(F.col("text")).alias("o"))
    total = order.groupBy("doc_id").agg(F.sum("o.mid_word").cast("int").alias("mid_word"), F.sum("o.words").cast("int").alias("words"))
    whole = F.struct((F.col("words") >= C.MIN_WORDS).alias("judged"), F.col("mid_word").alias("mid_word"), F.col("words").alias("words"))
    return total.select("doc_id", scrambled_script(whole).alias("scrambled"))


def verdicts(lines: DataFrame, pages: DataFrame, outputs: DataFrame, compose: bool = True) -> DataFrame:
    """doc_id, pages, lines (different keyed ones), undecoded, missing, reordered, furniture, renumbered, passed."""
    flagged = flagged_lines(lines, compose)
    kinds = (F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "reordered", "furniture"))
    found = settled_lines(flagged, outputs, compose).groupBy("doc_id").agg(F.count("*").alias("lines"), *kinds)
    numbers = number_diff(flagged.where("NOT is_furniture").select("doc_id", "text"), outputs).groupBy("doc_id").agg(F.count("*").alias("renumbered"))
    docs = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("undecoded").cast("bigint").alias("undecoded"))
    rows = docs.join(found, "doc_id", "left").join(numbers, "doc_id", "left").fillna(0)
    return rows.withColumn("passed", (F.col("missing") == 0) & (F.col("renumbered") == 0) & (F.col("undecoded") == 0)).select(
        "doc_id", "pages", "lines", "undecoded", "missing", "reordered", "furniture", "renumbered", "passed"
    )


def report_json(verdict: DataFrame, details: DataFrame, findings: DataFrame, numbers: DataFrame, pictures: DataFrame, alarms: DataFrame, version: str, verified_at: str) -> DataFrame:
    """doc_id, report: the JSON report of schema 1, untruncated; fields without a value are null, never absent.
    findings: as classify_lines; numbers: as number_diff; pictures: as illustrations; alarms: as script_alarm."""
    page = F.struct("page", "lines", "characters", "digest", "images", "undecoded", "picture", F.col("has_text").alias("hasText"))
    per_page = details.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("page_list"))
    where = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("page", "line_ix", "text")))), lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text"))).alias(f"{k}_list")
    lost = findings.groupBy("doc_id").agg(*(where(k) for k in ("missing", "reordered", "furniture")))
    changed = numbers.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("value", F.col("source_n").alias("source"), F.col("output_n").alias("output")))).alias("renumbered_list"))
    drawn = pictures.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "width", "height", "share"))).alias("illustration_list"))
    rows = verdict
    for part in (per_page, lost, changed, drawn, alarms):
        rows = rows.join(part, "doc_id", "left")
    some = lambda c: F.coalesce(c, F.array())
    body = F.struct(
        F.lit(1).alias("schema"),
        F.lit("doclens").alias("tool"),
        F.lit(version).alias("version"),
        F.col("doc_id").alias("source"),
        F.lit(verified_at).alias("verifiedAt"),
        "passed",
        F.struct("pages", "lines", "undecoded").alias("totals"),
        F.transform(F.filter("page_list", lambda p: p["picture"]), lambda p: p["page"]).alias("pictureOnly"),
        some("illustration_list").alias("illustrations"),
        F.struct(F.col("scrambled.mid_word").alias("midWord"), F.col("scrambled.words").alias("words"), F.col("scrambled.rate").alias("rate")).alias("scrambledScript"),
        F.col("page_list").alias("pages"),
        F.struct(some("missing_list").alias("missing"), some("reordered_list").alias("reordered"), some("furniture_list").alias("furniture"), some("renumbered_list").alias("renumbered")).alias("findings"),
    )
    body = body.withField("scrambledScript", F.when(F.col("scrambled").isNotNull(), body["scrambledScript"]))
    return rows.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def shown(findings: DataFrame, order: list[str]) -> DataFrame:
    """The first SHOWN findings of each document and kind, and how many more there are."""
    own = Window.partitionBy("doc_id", "kind")
    rows = findings.withColumn("rank", F.row_number().over(own.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(own) - SHOWN, F.lit(0)))
    return rows.where(F.col("rank") <= SHOWN).drop("rank")


def prose_report(report: dict, name: str, from_page: bool = True) -> str:
    """A person's reading of one JSON report; lists are cut at SHOWN and say so."""
    out = [f"Verified {name}: {report['totals']['lines']} lines " + ("of page text." if from_page else "reached the output (the source has no pages to read back).")]
    found = report["findings"]

    def listed(title: str, rows: list, line) -> None:
        if rows:
            out.append(f"  {title.format(n=len(rows))}")
            out.extend(f"    {line(r)}" for r in rows[:SHOWN])
            if len(rows) > SHOWN:
                out.append(f"    ... and {len(rows) - SHOWN} more")

    listed("{n} repeated header or footer line(s) dropped:", found["furniture"], lambda r: r["text"])
    listed("{n} line(s) kept every word in another order:", found["reordered"], lambda r: f"p{r['page']}: {r['text']}")
    listed("MISSING: {n} line(s) of the page are not in the output:", found["missing"], lambda r: f"p{r['page']}: {r['text']}")
    listed("CHANGED: {n} number(s) occur a different number of times:", found["renumbered"], lambda r: f"{r['value']}: {r['source']} on the page, {r['output']} in the output")
    if report["totals"]["undecoded"]:
        out.append(f"  UNDECODED: {report['totals']['undecoded']} glyph(s) without a character.")
    listed("PICTURE ONLY: {n} page(s) have images and no text:", report["pictureOnly"], lambda p: f"p{p}")
    listed("IMAGE AMONG TEXT: {n} large image(s) beside text:", report["illustrations"], lambda i: f"p{i['page']}: {i['width']}x{i['height']}, {int(i['share'] * 100 + 0.5)}% of the page")
    if report["scrambledScript"]:
        s = report["scrambledScript"]
        out.append(f"  SCRIPT: {s['midWord']} of {s['words']} Hebrew words have a final letter inside.")
    if report["passed"] and report["totals"]["lines"]:
        out.append("  No text lost, no number changed.")
    return "\n".join(out)


def gates(docs: DataFrame, force: bool = False) -> DataFrame:
    """docs(doc_id, raw_md) with status, refusal and warning: 4 without text, 2 for text in visual order, 0 else; a
    right-to-left text too short to judge is a warning. force lets both pass."""
    order = visual_order(F.col("raw_md"))
    empty = F.regexp_replace(F.coalesce("raw_md", F.lit("")), f"[{C.SPACE}]", "") == ""
    from doclens.functions.script import rtl_ratio

    rtl = rtl_ratio(F.col("raw_md")) > C.RTL_THRESHOLD
    on = F.lit(not force)
    status = F.when(on & empty, 4).when(on & order["reversed"], 2).otherwise(0)
    refusal = F.when(on & empty, "no text").when(on & order["reversed"], "visual order")
    return docs.withColumns({"status": status, "refusal": refusal, "warning": F.when(rtl & ~order["judged"], "order not judged")})
