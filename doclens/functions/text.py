"""Text functions over Markdown and HTML. Column functions; null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from doclens.functions import chars as C
from doclens.functions.script import detect_language

NUMBER = r"\d[\d,]*(?:\.\d+)?"
FENCE = r"^\s*(```|~~~)"
OWN_MARKUP = r"^\s*<!--|^\s*</?div\b|^\s*---\s*$"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """NFC. Python sees the rows with combining marks or singletons only; text below U+0300 is in NFC already."""
    return F.when(text.rlike(r"[^\x{0000}-\x{02FF}]"), _nfc(F.when(text.rlike(r"[^\x{0000}-\x{02FF}]"), text))).otherwise(text)


def normalise(text: Column, compose: bool = True) -> Column:
    """What comparison sees: NFC without direction marks, markup and white space. compose=False skips NFC, which
    keeps the plan free of Python where the text is known to be composed."""
    t = nfc(text) if compose else text
    return F.regexp_replace(t, f"[{C.BIDI}{C.MARKUP}{C.SPACE}]", "")


def words(text: Column, compose: bool = True) -> Column:
    """Words: as normalise, but markup and white space separate."""
    t = F.regexp_replace(nfc(text) if compose else text, f"[{C.BIDI}]", "")
    return F.filter(F.split(t, f"[{C.MARKUP}{C.SPACE}]+"), lambda w: w != "")


def digest(text: Column, compose: bool = True) -> Column:
    """First 16 hex digits of the SHA-256 of the normalised text."""
    return F.substring(F.sha2(normalise(text, compose), 256), 1, 16)


def number_tokens(text: Column) -> Column:
    """Numbers as they are written; a trailing comma stays part of one."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def decode_entities(html: Column) -> Column:
    out = html
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def rendered_text(html: Column) -> Column:
    """Visible text: the main element if there is one, tags as blanks, entities decoded. List numbers are written in
    before, by render.materialise_list_numbers."""
    main = F.regexp_extract(html, r"(?s)<main>(.*)</main>", 1)
    return decode_entities(F.regexp_replace(F.when(html.rlike(r"(?s)<main>.*</main>"), main).otherwise(html), "<[^>]+>", " "))


def escape_html(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def unwrap_rtl_div(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r'(?s)^\s*<div dir="rtl"[^>]*>\s*(.*?)\s*</div>\s*$', "$1")


def escape_block_marker(text: Column) -> Column:
    """Text that Markdown would take for a list, heading or quote keeps its look: a mark that also closes the line is
    decoration, and # and > open nothing. A list item stays one."""
    dash = text.rlike(r"^(\s*)([-*+])(?=\s).*\2\s*$")
    return F.when(dash, F.regexp_replace(text, r"^(\s*)([-*+])(?=\s)", r"$1\\$2")).otherwise(F.regexp_replace(text, r"^(\s*)(#{1,6}|>)(?=\s|$)", r"$1\\$2"))


def _fenced(lines: Column) -> Column:
    """For each line, whether it is in a fenced block or bounds one."""
    start = F.expr("CAST(named_struct('open', false, 'out', array()) AS struct<open:boolean,out:array<boolean>>)")

    def step(acc, line):
        bound = line.rlike(FENCE)
        return F.struct((acc["open"] != bound).alias("open"), F.concat(acc["out"], F.array(acc["open"] | bound)).alias("out"))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def mark_rtl_lines(markdown: Column) -> Column:
    """A right-to-left mark after the Markdown marker of each line with a right-to-left letter, outside of fences,
    table rows and raw HTML."""
    lines = F.split(markdown, "\n")
    mark = r"^(\s*(?:[-*+]|\d+\\?[.)]|#{1,6}|>)\s+)?"
    marked = F.transform(
        F.arrays_zip(lines.alias("l"), _fenced(lines).alias("f")),
        lambda x: F.when(x["f"] | x["l"].rlike(r"^\s*[|<]") | ~x["l"].rlike(f"[{C.RTL_LETTER}]"), x["l"]).otherwise(
            F.concat(F.regexp_extract(x["l"], mark, 0), F.lit(C.RLM), F.substr(x["l"], F.length(F.regexp_extract(x["l"], mark, 0)) + 1))
        ),
    )
    return F.array_join(marked, "\n")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: what stands inside a lambda is otherwise computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def promote_headings(markdown: Column) -> Column:
    """Wholly bold blocks become headings where the text has none, if short, no sentence, and followed by a body."""
    bold = lambda b: F.trim(F.regexp_extract(F.regexp_replace(b, f"^[{C.SPACE}]+|[{C.SPACE}]+$", ""), r"^\*\*([^*]+)\*\*$", 1))

    def raised(blocks, block, i):
        text, after = bold(block), F.coalesce(F.get(blocks, i + 1), F.lit(""))
        title = (text != "") & (F.length(text) <= 80) & ~text.rlike("[.!?]$") & (F.trim(after) != "") & (bold(after) == "")
        return F.when(title, F.concat(F.lit("## "), text)).otherwise(block)

    promoted = let(F.split(markdown, r"\n{2,}"), lambda blocks: F.array_join(F.transform(blocks, lambda x, i: raised(blocks, x, i)), "\n\n"))
    return F.when(markdown.rlike(r"(?m)^#{1,6}\s"), markdown).otherwise(promoted)


def preserve_numbering(markdown: Column) -> Column:
    """Numbered runs that a renderer would renumber get their delimiters escaped. Blank lines don't end a run; other
    lines and fences do. A number beyond a bigint makes its run irregular, so it is escaped."""
    numbered = r"^(\s*)(\d+)([.)])(?=\s)"
    entry = "struct<at:int,run:int>"
    start = F.expr(f"CAST(named_struct('i', 0, 'run', 0, 'next', CAST(NULL AS bigint), 'empty', true, 'items', array(), 'odd', array()) AS struct<i:int,run:int,next:bigint,empty:boolean,items:array<{entry}>,odd:array<int>>)")

    def step(acc, x):
        hit = ~x["f"] & x["l"].rlike(numbered)
        ends = x["f"] | (~hit & (F.trim(x["l"]) != ""))
        n = F.regexp_extract(x["l"], numbered, 2).try_cast("bigint")
        odd = hit & (n.isNull() | (~acc["empty"] & ~acc["next"].eqNullSafe(n)))
        one = F.struct(acc["i"].alias("at"), acc["run"].alias("run"))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            (acc["run"] + ends.cast("int")).alias("run"),
            F.when(hit & acc["empty"], F.try_add(n, F.lit(1))).when(hit, F.try_add(acc["next"], F.lit(1))).otherwise(acc["next"]).alias("next"),
            (ends | (acc["empty"] & ~hit)).alias("empty"),
            F.when(hit, F.concat(acc["items"], F.array(one))).otherwise(acc["items"]).alias("items"),
            F.when(odd, F.concat(acc["odd"], F.array(acc["run"]))).otherwise(acc["odd"]).alias("odd"),
        )

    def escaped(zipped):
        return F.aggregate(zipped, start, step, lambda acc: F.transform(F.filter(acc["items"], lambda x: F.array_contains(acc["odd"], x["run"])), lambda x: x["at"]))

    def rewritten(lines, at):
        return F.array_join(F.transform(lines, lambda l, i: F.when(F.array_contains(at, i), F.regexp_replace(l, numbered, r"$1$2\\$3")).otherwise(l)), "\n")

    changed = let(F.split(markdown, "\n"), lambda lines: let(escaped(F.arrays_zip(lines.alias("l"), _fenced(lines).alias("f"))), lambda at: rewritten(lines, at)))
    return F.when(markdown.rlike(r"(?m)^\s*\d+[.)]\s"), changed).otherwise(markdown)


def json_string(value: Column) -> Column:
    """The value as a JSON string, which is also a quoted YAML one."""
    return F.regexp_extract(F.to_json(F.struct(value.cast("string").alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)


def yaml_field(key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{key}: "), json_string(value))


def ingest_fields(kind: Column, location: Column, extracted_at: Column) -> Column:
    return F.array(F.concat(F.lit("source_type: "), kind), yaml_field("source_location", location), F.concat(F.lit("extracted_at: "), extracted_at), F.lit("content_mode: verbatim"))


def add_rtl_support(markdown: Column, title: Column, source: Column, ingest: Column | None = None, notice: Column | None = None) -> Column:
    """Front matter (title and source where not empty, ingest fields, dir, lang) and the text, wrapped and marked where
    it runs from right to left."""
    verdict = detect_language(markdown)
    some = lambda key, v: F.when(v != "", yaml_field(key, v))
    fields = F.array(F.lit("---"), some("title", title), some("source", source))
    if ingest is not None:
        fields = F.concat(fields, ingest)
    fields = F.concat(fields, F.array(F.concat(F.lit("dir: "), verdict["dir"]), F.concat(F.lit("lang: "), verdict["lang"]), F.lit("---")))
    trimmed = F.regexp_replace(markdown, f"^[{C.SPACE}]+|[{C.SPACE}]+$", "")
    body = F.when(verdict["dir"] == "ltr", markdown).otherwise(
        F.concat(F.lit('<div dir="rtl" lang="'), F.coalesce(verdict["lang"], F.lit("he")), F.lit('">\n\n'), mark_rtl_lines(trimmed), F.lit("\n\n</div>"))
    )
    return F.concat(F.array_join(F.array_compact(fields), "\n"), F.lit("\n"), F.lit("") if notice is None else notice, F.lit("\n"), body)


def parse_front_matter(text: Column) -> Column:
    """struct<fields map<string,string>, body>: values in quotes are JSON strings; where one isn't, the quotes go."""
    pattern = r"(?s)^---\n(.*?)\n---\n?"
    head = F.regexp_extract(text, pattern, 1)
    lines = F.filter(F.split(head, "\n"), lambda l: l.rlike(r"^\w+:\s*.*$"))

    def entry(line):
        value = F.trim(F.regexp_extract(line, r"^\w+:\s*(.*)$", 1))
        decoded = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
        return F.struct(F.regexp_extract(line, r"^(\w+):", 1), F.when(value.startswith('"'), F.coalesce(decoded, F.regexp_replace(value, '^"|"$', ""))).otherwise(value))

    none = F.expr("CAST(map() AS map<string,string>)")
    last = F.aggregate(F.transform(lines, entry), none, lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["col1"]), F.create_map(e["col1"], e["col2"])))
    has = text.rlike(pattern)
    return F.struct(F.when(has, last).otherwise(none).alias("fields"), F.when(has, F.regexp_replace(text, pattern, "")).otherwise(text).alias("body"))


def parse_sidecar(text: Column) -> Column:
    """The transcript of an OCR run: pages at form feeds, trimmed; empty ones and notes of skipped pages go."""
    pages = F.transform(F.split(text, r"\x0C"), lambda p: F.regexp_replace(p, f"^[{C.SPACE}]+|[{C.SPACE}]+$", ""))
    return F.array_join(F.filter(pages, lambda p: (p != "") & ~p.rlike(r"^\[OCR skipped on page\(s\) [^\]]*\]$")), "\n\n")


def numeric_label(label: Column) -> Column:
    """The number of a list label such as 1. or 2 ), or null."""
    return F.when(label.rlike(r"^(\d+)\s*[.)]?$"), F.regexp_extract(label, r"^(\d+)", 1).try_cast("bigint"))
