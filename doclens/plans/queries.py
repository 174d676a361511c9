"""Queries over the driver's tables, each with the DuckDB SQL it must equal.

The tables have no pages, scripts or slides of their own, so each query derives its input from them by expressions that
both engines evaluate alike, and then applies an operator. The SQL says the same without the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions import chars as C
from doclens.functions import script, text as T
from doclens.operators import furniture, geometry, reconcile, slides, structure, verify
from doclens.options import parse_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HEBREW = "אבגדהוזחטיכלמנסעפצקרשתךםןף"
LATIN = "abcdefghijklmnopqrstuvwxyz"
_STRIP = f"[{C.BIDI}{C.MARKUP}{C.SPACE}]"
_SPACES = f"[{C.SPACE}]+"
_ENDS = f"^[{C.SPACE}]+|[{C.SPACE}]+$"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- scripts -----------------------------------------------------------------------------------------------------


def scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a third of the documents in Hebrew letters, a third in them back to front, a third as they are."""
    d = table(spark, sf_dir, "documents")
    hebrew = F.translate(F.lower("text"), LATIN, HEBREW)
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, hebrew).when(F.col("doc_id") % 3 == 1, F.reverse(hebrew)).otherwise(F.col("text")).alias("text"))


_SCRIPTED = f"""s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN h WHEN 1 THEN reverse(h) ELSE text END AS text
  FROM (SELECT doc_id, text, translate(lower(text), '{LATIN}', '{HEBREW}') AS h FROM documents))"""
_RATIO = f"CASE WHEN len(l) = 0 THEN 0.0 ELSE len(regexp_replace(l, '[^{C.RTL}]', '', 'g')) / len(l) END"


@query(f"""WITH {_SCRIPTED}, r AS (SELECT doc_id, text, regexp_replace(text, '[^\\p{{L}}]', '', 'g') AS l FROM s), v AS (
  SELECT doc_id, {_RATIO} AS ratio, len(regexp_replace(text, '[^{C.HEBREW}]', '', 'g')) AS h, len(regexp_replace(text, '[^{C.ARABIC}]', '', 'g')) AS a FROM r)
SELECT doc_id, CAST(floor(ratio * 10000 + 0.5) AS BIGINT) AS ratio_e4, CASE WHEN ratio > 0.3 THEN 'rtl' ELSE 'ltr' END AS dir,
  CASE WHEN ratio > 0.3 THEN CASE WHEN h > a THEN 'he' WHEN a > 0 THEN 'ar' ELSE 'und' END END AS lang FROM v""")
def script_language(spark, sf_dir):
    v = script.detect_language(F.col("text"))
    return scripted(spark, sf_dir).select("doc_id", F.floor(script.rtl_ratio(F.col("text")) * 10000 + 0.5).cast("bigint").alias("ratio_e4"), v["dir"].alias("dir"), v["lang"].alias("lang"))


_ORDER = f"""w AS (SELECT doc_id, regexp_replace(unnest(string_split_regex(text, '{_SPACES}')), '[^{C.HEBREW}]', '', 'g') AS w FROM s),
o AS (SELECT doc_id, count(*) AS words, count(*) FILTER (regexp_matches(w, '^[{C.FINALS}]')) AS final_first, count(*) FILTER (regexp_matches(w, '[{C.FINALS}]$')) AS final_last,
  count(*) FILTER (regexp_matches(w, '^.+[{C.FINALS}].+$')) AS mid_word FROM w WHERE len(w) >= 2 GROUP BY 1)"""


@query(f"""WITH {_SCRIPTED}, {_ORDER}
SELECT s.doc_id, coalesce(words, 0)::BIGINT AS words, coalesce(final_first, 0)::BIGINT AS final_first, coalesce(final_last, 0)::BIGINT AS final_last, coalesce(mid_word, 0)::BIGINT AS mid_word,
  coalesce(words, 0) >= 3 AS judged, coalesce(words >= 3 AND final_first > final_last, false) AS reversed,
  CASE WHEN words >= 3 AND mid_word / words > 0.03 THEN CAST(floor(mid_word / words * 10000 + 0.5) AS BIGINT) END AS scrambled_e4
FROM s LEFT JOIN o USING (doc_id)""")
def visual_order(spark, sf_dir):
    rows = scripted(spark, sf_dir).select("doc_id", script.visual_order(F.col("text")).alias("o"))
    alarm = script.scrambled_script(F.col("o"))
    n = lambda c, name: F.col(f"o.{c}").cast("bigint").alias(name)
    return rows.select("doc_id", n("words", "words"), n("leading", "final_first"), n("trailing", "final_last"), n("mid_word", "mid_word"), F.col("o.judged").alias("judged"), F.col("o.reversed").alias("reversed"), F.floor(alarm["rate"] * 10000 + 0.5).cast("bigint").alias("scrambled_e4"))


@query(f"""WITH {_SCRIPTED}, e AS (SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN ' ' || chr(10) ELSE text END AS text FROM s), {_ORDER.replace('FROM s)', 'FROM e)')},
r AS (SELECT doc_id, text, regexp_replace(text, '[^\\p{{L}}]', '', 'g') AS l FROM e)
SELECT r.doc_id, CAST(CASE WHEN regexp_replace(text, '[{C.SPACE}]', '', 'g') = '' THEN 4 WHEN words >= 3 AND final_first > final_last THEN 2 ELSE 0 END AS INTEGER) AS status,
  CASE WHEN regexp_replace(text, '[{C.SPACE}]', '', 'g') = '' THEN 'no text' WHEN words >= 3 AND final_first > final_last THEN 'visual order' END AS refusal,
  CASE WHEN {_RATIO} > 0.3 AND coalesce(words, 0) < 3 THEN 'order not judged' END AS warning
FROM r LEFT JOIN o USING (doc_id)""")
def conversion_gates(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 11 == 5, F.lit(" \n")).otherwise(F.col("text"))
    return verify.gates(scripted(spark, sf_dir).select("doc_id", raw.alias("raw_md"))).select("doc_id", "status", "refusal", "warning")


# -- text --------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, substr(sha256(n), 1, 16) AS digest, CAST(len(n) AS BIGINT) AS characters, CAST(len(list_filter(string_split_regex(
  regexp_replace(nfc_normalize(text), '[{C.BIDI}]', '', 'g'), '[{C.MARKUP}{C.SPACE}]+'), lambda x: x <> '')) AS BIGINT) AS words
FROM (SELECT doc_id, text, regexp_replace(nfc_normalize(text), '{_STRIP}', '', 'g') AS n FROM documents)""")
def text_digest(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.digest(t).alias("digest"), F.length(T.normalise(t)).cast("bigint").alias("characters"), F.size(T.words(t)).cast("bigint").alias("words"))


@query("""SELECT doc_id, value, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?')) AS value FROM documents) GROUP BY ALL""")
def number_counts(spark, sf_dir):
    return verify.number_counts(table(spark, sf_dir, "documents"), "text")


@query("""SELECT page_id, CAST(len(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256 FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(
  regexp_replace(html, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&') AS t FROM pages)""")
def rendered_text(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", T.rendered_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_sha256 FROM pages""")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.escape_html(F.col("html")), 256).alias("escaped_sha256"))


#: Lines of documents with a marker by their place, in the letters of scripted.
_MARKED = f"""{_SCRIPTED}, n AS (SELECT doc_id, i, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM s)),
m AS (SELECT doc_id, i, CASE i % 7 WHEN 0 THEN '# ' WHEN 1 THEN '- ' WHEN 2 THEN '1. ' WHEN 3 THEN '> ' WHEN 4 THEN '| ' WHEN 5 THEN '' ELSE '- ' END || l || CASE WHEN i % 7 = 6 THEN ' -' ELSE '' END AS l FROM n)"""


def marked(spark, sf_dir):
    rows = scripted(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    k = F.col("i") % 7
    mark = F.when(k == 0, "# ").when(k == 1, "- ").when(k == 2, "1. ").when(k == 3, "> ").when(k == 4, "| ").when(k == 5, "").otherwise("- ")
    return rows.select("doc_id", "i", F.concat(mark, "l", F.when(k == 6, " -").otherwise("")).alias("l"))


def _joined(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda x: x["l"]), "\n").alias("md"))


@query(f"""WITH {_MARKED} SELECT doc_id, sha256(string_agg(CASE WHEN regexp_matches(l, '^\\s*[|<]') OR NOT regexp_matches(l, '[{C.RTL_LETTER}]') THEN l
  ELSE regexp_replace(l, '^(\\s*(?:[-*+]|\\d+\\\\?[.)]|#{{1,6}}|>)\\s+)?', '\\1{C.RLM}') END, chr(10) ORDER BY i)) AS marked_sha256 FROM m GROUP BY 1""")
def mark_rtl_lines(spark, sf_dir):
    return _joined(marked(spark, sf_dir)).select("doc_id", F.sha2(T.mark_rtl_lines(F.col("md")), 256).alias("marked_sha256"))


@query(f"""WITH {_MARKED} SELECT doc_id, i::INTEGER AS i, CASE WHEN regexp_matches(l, '^\\s*-\\s.*-\\s*$') OR regexp_matches(l, '^\\s*\\*\\s.*\\*\\s*$') OR regexp_matches(l, '^\\s*\\+\\s.*\\+\\s*$')
  THEN regexp_replace(l, '^(\\s*)([-*+])(\\s)', '\\1\\\\\\2\\3') ELSE regexp_replace(l, '^(\\s*)(#{{1,6}}|>)(\\s|$)', '\\1\\\\\\2\\3') END AS escaped FROM m""")
def escape_block_markers(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", "i", T.escape_block_marker(F.col("l")).alias("escaped"))


@query("""WITH b AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN '**' || replace(left(l, 60), '*', '') || '**' ELSE l END AS l
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
g AS (SELECT *, regexp_matches(trim(l), '^\\*\\*[^*]+\\*\\*$') AS bold, trim(regexp_extract(trim(l), '^\\*\\*([^*]+)\\*\\*$', 1)) AS t FROM b),
n AS (SELECT *, coalesce(lead(trim(l)) OVER w, '') AS after, coalesce(lead(bold) OVER w, false) AS after_bold, bool_or(regexp_matches(l, '^#{1,6}\\s')) OVER (PARTITION BY doc_id) AS outlined FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, sha256(string_agg(CASE WHEN NOT outlined AND bold AND t <> '' AND len(t) <= 80 AND NOT regexp_matches(t, '[.!?]$') AND after <> '' AND NOT after_bold THEN '## ' || t ELSE l END, chr(10) || chr(10) ORDER BY i)) AS promoted_sha256,
  count(*) FILTER (NOT outlined AND bold AND t <> '' AND len(t) <= 80 AND NOT regexp_matches(t, '[.!?]$') AND after <> '' AND NOT after_bold)::BIGINT AS headings FROM n GROUP BY 1""")
def promote_headings(spark, sf_dir):
    lines = F.split("text", "\n")
    blocks = F.transform(lines, lambda l, i: F.when(i % 3 == 0, F.concat(F.lit("**"), F.replace(F.left(l, F.lit(60)), F.lit("*"), F.lit("")), F.lit("**"))).otherwise(l))
    out = table(spark, sf_dir, "documents").select("doc_id", T.promote_headings(F.array_join(blocks, "\n\n")).alias("md"))
    return out.select("doc_id", F.sha2("md", 256).alias("promoted_sha256"), F.size(F.filter(F.split("md", "\n\n"), lambda b: b.startswith("## "))).cast("bigint").alias("headings"))


@query("""WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_linenumber AS n, l_quantity AS q FROM lineitem),
r AS (SELECT *, sum(CASE WHEN q > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l), k AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, run, q > 40 ORDER BY i) AS base FROM r),
c AS (SELECT *, CASE WHEN q > 40 THEN false ELSE min(base) OVER p <> max(base) OVER p END AS escaped FROM k WINDOW p AS (PARTITION BY doc_id, run, q > 40))
SELECT doc_id, string_agg(CASE WHEN q > 40 THEN 'break' ELSE n || CASE WHEN escaped THEN '\\. item' ELSE '. item' END END, chr(10) ORDER BY i) AS md FROM c GROUP BY 1""")
def preserve_numbering(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    line = F.when(F.col("l_quantity") > 40, "break").otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit(". item")))
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("l"))))
    docs = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n").alias("md"))
    return docs.select("doc_id", T.preserve_numbering(F.col("md")).alias("md"))


@query("""SELECT doc_id, source || ' "' || lang || '": x' AS source, 'T ' || doc_id AS title, sha256('---' || chr(10) || 'title: "T ' || doc_id || '"' || chr(10) || 'source: "' || source || ' \\"' || lang || '\\": x"' || chr(10) || 'dir: ltr' || chr(10) || '---' || chr(10) || chr(10) || text) AS md_sha256 FROM documents""")
def front_matter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    source = F.concat("source", F.lit(' "'), "lang", F.lit('": x'))
    made = d.select("doc_id", T.add_rtl_support(F.col("text"), F.concat(F.lit("T "), F.col("doc_id").cast("string")), source).alias("md"))
    read = made.select("doc_id", "md", T.parse_front_matter(F.col("md"))["fields"].alias("f"))
    return read.select("doc_id", F.col("f")["source"].alias("source"), F.col("f")["title"].alias("title"), F.sha2("md", 256).alias("md_sha256"))


@query(f"""SELECT conv_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (t <> ''), '') AS transcript FROM (
  SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE regexp_replace(replace(text, chr(12), ''), '{_ENDS}', '', 'g') END AS t FROM conversations) GROUP BY 1""")
def ocr_sidecar(spark, sf_dir):
    page = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("[OCR skipped on page(s) "), F.col("turn").cast("string"), F.lit("]"))).otherwise(F.replace("text", F.lit("\f"), F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: x["p"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(T.parse_sidecar(F.array_join(ordered, "\f")).alias("transcript"))


# -- verification ------------------------------------------------------------------------------------------------

HEADER = "Confidential 2024"
_BINDER = "'d' || doc_id // 50"


def binder():
    """The document that a page is bound into; documents stay small at any scale."""
    return F.expr("concat('d', doc_id div 50)")


def page_texts(spark, sf_dir) -> DataFrame:
    """doc_id, page (a row of documents, fifty to a document), text: under a header that all pages share."""
    return table(spark, sf_dir, "documents").select(binder().alias("doc_id"), F.col("doc_id").alias("page"), F.concat(F.lit(HEADER + "\n"), "text").alias("text"))


def page_lines(spark, sf_dir) -> DataFrame:
    return page_texts(spark, sf_dir).select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_ix", "text"))


def page_outputs(spark, sf_dir) -> DataFrame:
    """doc_id, rendered: the pages without headers, with edits: some pages lose their digits 1, some their first line's
    order, some are lost."""
    d = table(spark, sf_dir, "documents").where("doc_id % 50 <> 7")
    text = F.when(F.col("doc_id") % 10 == 3, F.replace("text", F.lit("1"), F.lit("7"))).when(F.col("doc_id") % 10 == 4, F.array_join(F.reverse(F.split("text", " ")), " ")).otherwise(F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", text.alias("t")))), lambda x: x["t"])
    return d.groupBy(binder().alias("binder")).agg(F.array_join(ordered, "\n").alias("rendered")).withColumnRenamed("binder", "doc_id")


_PAGES = f"""lines AS (SELECT doc_id, page, unnest(range(len(ls))) AS line_ix, unnest(ls) AS text FROM (SELECT {_BINDER} AS doc_id, doc_id AS page, string_split('{HEADER}' || chr(10) || text, chr(10)) AS ls FROM documents)),
outputs AS (SELECT b AS doc_id, string_agg(CASE WHEN doc_id % 10 = 3 THEN replace(text, '1', '7') WHEN doc_id % 10 = 4 THEN array_to_string(list_reverse(string_split(text, ' ')), ' ') ELSE text END, chr(10) ORDER BY doc_id) AS rendered
  FROM (SELECT *, {_BINDER} AS b FROM documents) WHERE doc_id % 50 <> 7 GROUP BY 1),
cand AS (SELECT doc_id, page, line_ix, regexp_replace(text, '{_ENDS}', '', 'g') AS line, regexp_replace(text, '^\\s*[-*+\\x{{2022}}]\\s+', '') AS text FROM lines),
per AS (SELECT doc_id, page, line, count(*) AS n FROM cand GROUP BY ALL), sizes AS (SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS size FROM lines GROUP BY 1),
rep AS (SELECT per.doc_id, line, sum(n) AS total FROM per JOIN sizes USING (doc_id) GROUP BY per.doc_id, line, pages HAVING count(*) = pages AND max(n) <= 2),
fur AS (SELECT doc_id, line FROM rep WHERE doc_id IN (SELECT rep.doc_id FROM rep JOIN sizes USING (doc_id) WHERE pages >= 2 GROUP BY rep.doc_id, size HAVING sum(total) <= 0.5 * size)),
keyed AS (SELECT c.*, regexp_replace(nfc_normalize(text), '{_STRIP}', '', 'g') AS key, f.line IS NOT NULL AS is_furniture FROM cand c LEFT JOIN fur f USING (doc_id, line)),
flagged AS (SELECT * FROM keyed WHERE regexp_matches(key, '[\\p{{L}}\\p{{N}}]')), kept AS (SELECT * FROM flagged WHERE NOT is_furniture)"""
_NUMBERS = """src AS (SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?')) AS value FROM kept) GROUP BY ALL),
outn AS (SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(rendered, '\\d[\\d,]*(?:\\.\\d+)?')) AS value FROM outputs) GROUP BY ALL),
diff AS (SELECT doc_id, value, coalesce(src.n, 0)::BIGINT AS source_n, coalesce(outn.n, 0)::BIGINT AS output_n FROM src FULL OUTER JOIN outn USING (doc_id, value) WHERE coalesce(src.n, 0) <> coalesce(outn.n, 0))"""
_WORDS = lambda c: f"list_filter(string_split_regex(regexp_replace(nfc_normalize({c}), '[{C.BIDI}]', '', 'g'), '[{C.MARKUP}{C.SPACE}]+'), lambda x: x <> '')"
_FOUND = f"""firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY page, line_ix) AS r FROM flagged) WHERE r = 1),
hay AS (SELECT doc_id, regexp_replace(nfc_normalize(rendered), '{_STRIP}', '', 'g') AS haystack, {_WORDS('rendered')} AS held FROM outputs),
lost AS (SELECT f.doc_id, f.page, f.line_ix, f.line, f.text, f.is_furniture, f.key, hay.held FROM firsts f LEFT JOIN hay USING (doc_id) WHERE NOT coalesce(contains(haystack, key), false)),
wanted AS (SELECT DISTINCT l.doc_id, l.page, l.line_ix, unnest({_WORDS('l.text')}) AS w FROM lost l), have AS (SELECT DISTINCT doc_id, unnest(held) AS w FROM hay),
absent AS (SELECT DISTINCT doc_id, page, line_ix FROM wanted ANTI JOIN have USING (doc_id, w)),
found AS (SELECT l.doc_id, CASE WHEN is_furniture THEN 'furniture' WHEN a.page IS NULL THEN 'reordered' ELSE 'missing' END AS kind, l.page, l.line_ix::INTEGER AS line_ix, line AS text FROM lost l LEFT JOIN absent a USING (doc_id, page, line_ix))"""


@query(f"WITH {_PAGES}, {_NUMBERS} SELECT * FROM diff")
def number_tally_diff(spark, sf_dir):
    return verify.number_diff(verify.kept_lines(page_lines(spark, sf_dir)), page_outputs(spark, sf_dir))


@query(f"WITH {_PAGES} SELECT doc_id, line AS text FROM fur")
def repeated_furniture(spark, sf_dir):
    return verify.page_furniture(page_lines(spark, sf_dir)).withColumnRenamed("line", "text")


@query(f"WITH {_PAGES} SELECT l.doc_id, count(*)::BIGINT AS lines, sum(len(l.text))::BIGINT AS characters FROM lines l ANTI JOIN fur ON l.doc_id = fur.doc_id AND l.text = fur.line GROUP BY 1")
def drop_furniture(spark, sf_dir):
    lines = page_lines(spark, sf_dir)
    left = furniture.drop_furniture(lines, verify.page_furniture(lines).withColumnRenamed("line", "text"))
    return left.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).cast("bigint").alias("characters"))


@query(f"WITH {_PAGES}, {_FOUND} SELECT * FROM found")
def line_findings(spark, sf_dir):
    return verify.classify_lines(page_lines(spark, sf_dir), page_outputs(spark, sf_dir))


_DETAIL = f"""detail AS (SELECT doc_id, page, count(*)::BIGINT AS lines, len(regexp_replace(nfc_normalize(string_agg(text, '' ORDER BY line_ix)), '{_STRIP}', '', 'g'))::BIGINT AS characters,
  substr(sha256(regexp_replace(nfc_normalize(string_agg(text, chr(10) ORDER BY line_ix)), '{_STRIP}', '', 'g')), 1, 16) AS digest FROM lines GROUP BY ALL)"""


def page_rows(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(binder().alias("doc_id"), F.col("doc_id").alias("page"), (F.col("doc_id") % 17 == 0).cast("int").alias("images"), (F.col("doc_id") % 101 == 0).cast("int").alias("undecoded"))


@query(f"""WITH {_PAGES}, {_DETAIL}, p AS (SELECT {_BINDER} AS b, doc_id AS page FROM documents), q AS (SELECT p.b AS doc_id, p.page, d.* EXCLUDE (doc_id, page) FROM p LEFT JOIN detail d ON d.doc_id = p.b AND d.page = p.page AND p.page % 34 <> 0)
SELECT doc_id, page, coalesce(lines, 0)::BIGINT AS lines, coalesce(characters, 0)::BIGINT AS characters, coalesce(digest, substr(sha256(''), 1, 16)) AS digest, (page % 17 = 0)::INTEGER AS images, (page % 101 = 0)::INTEGER AS undecoded,
  lines IS NULL AS picture, lines IS NOT NULL AS has_text FROM q""")
def page_detail(spark, sf_dir):
    """Pages 0, 34, 68, ... hold an image and no line."""
    return verify.page_detail(page_lines(spark, sf_dir).where("page % 34 <> 0"), page_rows(spark, sf_dir))


@query(f"""WITH {_PAGES}, {_NUMBERS}, {_FOUND}, docs AS (SELECT {_BINDER} AS b, count(*) AS pages, count(*) FILTER (doc_id % 101 = 0) AS undecoded FROM documents GROUP BY 1),
k AS (SELECT doc_id, count(DISTINCT key) AS lines FROM flagged GROUP BY 1), f AS (SELECT doc_id, count(*) FILTER (kind = 'missing') AS missing, count(*) FILTER (kind = 'reordered') AS reordered, count(*) FILTER (kind = 'furniture') AS furniture FROM found GROUP BY 1),
n AS (SELECT doc_id, count(*) AS renumbered FROM diff GROUP BY 1)
SELECT doc_id, pages::BIGINT AS pages, coalesce(lines, 0)::BIGINT AS lines, undecoded::BIGINT AS undecoded, coalesce(missing, 0)::BIGINT AS missing, coalesce(reordered, 0)::BIGINT AS reordered, coalesce(furniture, 0)::BIGINT AS furniture,
  coalesce(renumbered, 0)::BIGINT AS renumbered, coalesce(missing, 0) = 0 AND coalesce(renumbered, 0) = 0 AND undecoded = 0 AS passed FROM (SELECT * RENAME (b AS doc_id) FROM docs) LEFT JOIN k USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN n USING (doc_id)""")
def verdicts(spark, sf_dir):
    return verify.verdicts(page_lines(spark, sf_dir), page_rows(spark, sf_dir), page_outputs(spark, sf_dir))


def reports(spark, sf_dir) -> DataFrame:
    """doc_id, report: the JSON report of each document."""
    lines, pages, outputs = page_lines(spark, sf_dir), page_rows(spark, sf_dir), page_outputs(spark, sf_dir)
    kept, details = verify.kept_lines(lines), verify.page_detail(lines, pages)
    images = table(spark, sf_dir, "documents").where("doc_id % 17 = 0").select(
        binder().alias("doc_id"), F.col("doc_id").alias("page"), F.lit(0).alias("image_ix"), F.lit(200.0).alias("width"), F.lit(100.0).alias("height"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.25).alias("share"), F.lit(None).cast("int").alias("px_w"), F.lit(None).cast("int").alias("px_h"),
    )
    return verify.report_json(verify.verdicts(lines, pages, outputs), details, verify.classify_lines(lines, outputs), verify.number_diff(kept, outputs), verify.illustrations(images, details), verify.script_alarm(kept), "0.1.0", "1970-01-01T00:00:00Z")


@query("""SELECT v.doc_id, 1 AS schema, passed, pages, lines, undecoded, missing, reordered, furniture, renumbered, coalesce(i.n, 0)::BIGINT AS illustrations, false AS scrambled
FROM (""" + ORACLE_SQL["verdicts"] + f""") v LEFT JOIN (SELECT {_BINDER} AS doc_id, count(*) AS n FROM documents WHERE doc_id % 17 = 0 GROUP BY 1) i USING (doc_id)""")
def report_json(spark, sf_dir):
    """Counts and lists of the JSON reports."""
    j = lambda path, kind: F.get_json_object("report", f"$.{path}").cast(kind)
    n = lambda path: F.coalesce(F.json_array_length(F.get_json_object("report", f"$.{path}")), F.lit(0)).cast("bigint").alias(path.split(".")[-1])
    return reports(spark, sf_dir).select(
        "doc_id", j("schema", "int").alias("schema"), j("passed", "boolean").alias("passed"), *(j(f"totals.{c}", "bigint").alias(c) for c in ("pages", "lines", "undecoded")),
        *(n(f"findings.{c}") for c in ("missing", "reordered", "furniture", "renumbered")), n("illustrations"), F.get_json_object("report", "$.scrambledScript.rate").isNotNull().alias("scrambled"),
    )


@query(f"""WITH {_PAGES}, {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY page, line_ix) AS rank, count(*) OVER (PARTITION BY doc_id, kind) AS n FROM found)
SELECT doc_id, kind, page, line_ix, text, greatest(n - 8, 0)::BIGINT AS more FROM r WHERE rank <= 8""")
def shown_findings(spark, sf_dir):
    found = verify.classify_lines(page_lines(spark, sf_dir), page_outputs(spark, sf_dir))
    return verify.shown(found, ["page", "line_ix"]).withColumn("more", F.col("more").cast("bigint"))


# -- images ------------------------------------------------------------------------------------------------------

_IMAGES = """images AS (SELECT p_brand AS doc_id, (p_partkey % 6)::INTEGER AS page, row_number() OVER (PARTITION BY p_brand, p_partkey % 6 ORDER BY p_partkey)::INTEGER AS image_ix, p_size * 10.0 AS width, (p_size % 7) * 30.0 AS height,
  (p_size % 3) * 10.0 AS x, (p_size % 5) * 20.0 AS y, p_size * 10.0 * (p_size % 7) * 30.0 / 484704.0 AS share, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_size * 4)::INTEGER END AS px_w, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_size * 3)::INTEGER END AS px_h FROM part),
keyed AS (SELECT *, concat_ws(',', floor(width + 0.5)::BIGINT, floor(height + 0.5)::BIGINT, floor(x + 0.5)::BIGINT, floor(y + 0.5)::BIGINT) || ',' || coalesce(px_w || 'x' || px_h, '?') AS key FROM images),
np AS (SELECT doc_id, count(DISTINCT page) AS pages FROM images GROUP BY 1),
rep AS (SELECT doc_id, key FROM keyed JOIN np USING (doc_id) GROUP BY doc_id, key, pages HAVING pages > 1 AND count(DISTINCT page) > pages / 2.0)"""


def _images(spark, sf_dir) -> DataFrame:
    from pyspark.sql.window import Window

    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    w, h = size * 10.0, (size % 7) * 30.0
    px = lambda k: F.when(F.col("p_partkey") % 4 != 0, (size * k).cast("int"))
    ix = F.row_number().over(Window.partitionBy("p_brand", F.col("p_partkey") % 6).orderBy("p_partkey"))
    return p.select(
        F.col("p_brand").alias("doc_id"), (F.col("p_partkey") % 6).cast("int").alias("page"), ix.alias("image_ix"), w.alias("width"), h.alias("height"),
        ((size % 3) * 10.0).alias("x"), ((size % 5) * 20.0).alias("y"), (w * h / 484704.0).alias("share"), px(4).alias("px_w"), px(3).alias("px_h"),
    )


@query(f"WITH {_IMAGES} SELECT doc_id, key FROM rep")
def repeated_images(spark, sf_dir):
    images = _images(spark, sf_dir)
    return furniture.repeated_images(images, images.select("doc_id", "page"))


@query(f"""WITH {_IMAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, key ORDER BY image_ix) AS n FROM keyed ANTI JOIN rep USING (doc_id, key) WHERE page <> 2 AND share >= 0.1 AND (px_w IS NULL OR px_w >= 64 AND px_h >= 64))
SELECT doc_id, page, image_ix, floor(width + 0.5)::BIGINT AS width, floor(height + 0.5)::BIGINT AS height, floor(share * 100 + 0.5) / 100 AS share FROM r WHERE n = 1""")
def illustrations(spark, sf_dir):
    images = _images(spark, sf_dir)
    details = images.select("doc_id", "page").distinct().withColumns({"lines": F.when(F.col("page") == 2, 0).otherwise(5), "picture": F.col("page") == 2})
    return verify.illustrations(images, details)


# -- reconciliation ----------------------------------------------------------------------------------------------

_REC = """before AS (SELECT source AS doc_id, doc_id AS page, md5(text) AS digest, doc_id % 17 = 0 AS picture FROM documents WHERE doc_id % 97 <> 5),
after AS (SELECT source AS doc_id, doc_id AS page, CASE WHEN doc_id % 10 = 3 THEN md5(text || 'x') ELSE md5(text) END AS digest, doc_id % 34 <> 0 AS has_text FROM documents WHERE doc_id % 89 <> 7),
st AS (SELECT doc_id, page, CASE WHEN a.digest IS NULL THEN 'the page is missing' WHEN b.digest IS NULL THEN 'the page was not there before' WHEN NOT picture AND a.digest <> b.digest THEN 'the text changed' END AS reason, picture, has_text FROM before b FULL OUTER JOIN after a USING (doc_id, page)),
rec AS (SELECT doc_id, page, CASE WHEN reason IS NOT NULL THEN 'unexpected' WHEN NOT picture THEN 'original' WHEN has_text THEN 'recovered' ELSE 'still_unreadable' END AS status, reason FROM st)"""


def _before_after(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    own = [F.col("source").alias("doc_id"), F.col("doc_id").alias("page")]
    before = d.where("doc_id % 97 <> 5").select(*own, F.md5("text").alias("digest"), (F.col("doc_id") % 17 == 0).alias("picture"))
    changed = F.when(F.col("doc_id") % 10 == 3, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text"))
    return before, d.where("doc_id % 89 <> 7").select(*own, changed.alias("digest"), (F.col("doc_id") % 34 != 0).alias("has_text"))


@query(f"WITH {_REC} SELECT * FROM rec")
def reconcile_pages(spark, sf_dir):
    return reconcile.reconcile_pages(*_before_after(spark, sf_dir))


@query(f"""WITH {_REC} SELECT doc_id, count(*) FILTER (coalesce(reason, '') <> 'the page was not there before')::BIGINT AS before_pages, count(*) FILTER (coalesce(reason, '') <> 'the page is missing')::BIGINT AS after_pages,
  count(*) FILTER (status = 'unexpected')::BIGINT AS unexpected, count(*) FILTER (status = 'recovered')::BIGINT AS recovered, count(*) FILTER (status = 'still_unreadable')::BIGINT AS still_unreadable,
  count(*) FILTER (coalesce(reason, '') NOT IN ('the page is missing', 'the page was not there before'))::BIGINT AS provenance,
  count(*) FILTER (coalesce(reason, '') <> 'the page was not there before') = count(*) FILTER (coalesce(reason, '') <> 'the page is missing') AND count(*) FILTER (status = 'unexpected') = 0 AS ok FROM rec GROUP BY 1""")
def reconcile_docs(spark, sf_dir):
    return reconcile.reconcile_docs(*_before_after(spark, sf_dir)).withColumn("provenance", F.size("provenance").cast("bigint"))


@query("""SELECT source AS doc_id, doc_id AS page, CASE WHEN doc_id % 17 = 0 THEN CASE WHEN doc_id % 34 = 0 THEN '' ELSE 'ocr ' || doc_id END ELSE text END AS text, doc_id % 17 = 0 AND doc_id % 34 <> 0 AS from_ocr FROM documents""")
def ocr_splice(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 17 != 0, F.col("text")).alias("text"))
    ocr = d.where("page % 17 = 0 AND page % 34 <> 0").select("doc_id", "page", F.concat(F.lit("ocr "), F.col("page").cast("string")).alias("text"))
    return reconcile.splice(d, ocr)


@query("""SELECT source AS doc_id, doc_id AS page FROM documents WHERE doc_id % 17 = 0""")
def ocr_candidates(spark, sf_dir):
    return reconcile.candidates(table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), (F.col("doc_id") % 17 == 0).alias("picture")))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 3 AND 3 OR o_orderkey BETWEEN 10 AND 40 OR o_orderkey BETWEEN 100 AND 160""")
def page_selection(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(parse_pages("3,10-40,100-160").condition("o_orderkey")).select("o_orderkey", "o_custkey")


@query("""WITH n AS (SELECT 'out' || doc_id % 200 || '.md' AS name, source FROM documents), e AS (SELECT DISTINCT 'out' || doc_id % 150 || '.md' AS name, 'src' || doc_id % 150 % 7 AS recorded FROM documents)
SELECT name, source, recorded FROM n JOIN e USING (name) WHERE source <> recorded""")
def foreign_overwrites(spark, sf_dir):
    from doclens.sources.sinks import foreign_overwrites as check

    d = table(spark, sf_dir, "documents")
    name = lambda k: F.concat(F.lit("out"), (F.col("doc_id") % k).cast("string"), F.lit(".md")).alias("name")
    return check(d.select(name(200), "source"), d.select(name(150), F.concat(F.lit("src"), (F.col("doc_id") % 150 % 7).cast("string")).alias("source")).distinct())


# -- geometry ----------------------------------------------------------------------------------------------------

#: Statement pages: an order is a page of eight documents, its items the fields of its lines, at fixed places.
_GLYPHS = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line FROM lineitem),
cellv AS (SELECT l_orderkey, line, k, CASE k WHEN 0 THEN 'Row ' || l_linenumber WHEN 1 THEN l_partkey::VARCHAR WHEN 2 THEN l_returnflag || l_linestatus ELSE l_quantity::INTEGER::VARCHAR END AS str,
  CASE k WHEN 0 THEN 72.0 WHEN 1 THEN 180.0 WHEN 2 THEN 300.0 ELSE 430.0 END AS x FROM li, (SELECT unnest(range(4)) AS k)),
items AS (SELECT (l_orderkey % 8)::VARCHAR AS doc_id, l_orderkey AS page, (line * 4 + k)::INTEGER AS item_ix, str, x, 720.0 - 14 * line AS y, 5.0 * len(str) AS width, CASE WHEN line % 5 = 1 THEN 16.0 ELSE 11.0 END AS font_size, k = 3 AS has_eol FROM cellv)"""


def glyphs(spark, sf_dir) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(order))
    fields = F.array(F.concat(F.lit("Row "), F.col("l_linenumber").cast("string")), F.col("l_partkey").cast("string"), F.concat("l_returnflag", "l_linestatus"), F.col("l_quantity").cast("int").cast("string"))
    rows = rows.select("l_orderkey", "line", F.posexplode(fields).alias("k", "str"))
    x = F.element_at(F.array(*map(F.lit, (72.0, 180.0, 300.0, 430.0))), F.col("k") + 1)
    return rows.select(
        (F.col("l_orderkey") % 8).cast("string").alias("doc_id"), F.col("l_orderkey").alias("page"), (F.col("line") * 4 + F.col("k")).cast("int").alias("item_ix"), "str", x.alias("x"),
        (720.0 - 14 * F.col("line")).alias("y"), (5.0 * F.length("str")).alias("width"), F.when(F.col("line") % 5 == 1, 16.0).otherwise(11.0).alias("font_size"), (F.col("k") == 3).alias("has_eol"),
    )


_LINES = f"""{_GLYPHS}, g AS (SELECT *, (item_ix // 4 - 1) AS line_ix FROM items), m AS (SELECT doc_id, page, line_ix, max(y) AS y, max(font_size) AS font_size, min(x) AS x_left, max(x + width) AS x_right, sum(len(str))::BIGINT AS n_chars, string_agg(str, ' ' ORDER BY item_ix) AS text FROM g GROUP BY ALL)"""


@query(f"WITH {_LINES} SELECT doc_id, page, line_ix::INTEGER AS line_ix, text FROM m")
def join_lines(spark, sf_dir):
    return geometry.join_lines(geometry.group_lines(glyphs(spark, sf_dir)))


@query(f"WITH {_LINES} SELECT doc_id, page, line_ix::INTEGER AS line_ix, y::DOUBLE AS y, font_size::DOUBLE AS font_size, x_left::DOUBLE AS x_left, x_right::DOUBLE AS x_right, n_chars FROM m")
def line_metrics(spark, sf_dir):
    return geometry.line_metrics(geometry.group_lines(glyphs(spark, sf_dir)))


@query(f"""WITH {_LINES}, bs AS (SELECT doc_id, page, font_size, sum(n_chars) AS n FROM m GROUP BY doc_id, page, font_size), f AS (SELECT doc_id, page, font_size, sum(n) OVER (PARTITION BY doc_id, page ORDER BY font_size) AS reached, sum(n) OVER (PARTITION BY doc_id, page) AS total FROM bs),
b AS (SELECT doc_id, page, min(font_size) AS body_size FROM f WHERE reached * 2 >= total GROUP BY ALL), w AS (SELECT doc_id, page, list(x_right - x_left ORDER BY x_right - x_left DESC) AS w FROM m GROUP BY ALL),
d AS (SELECT doc_id, page, list(g ORDER BY g) AS g FROM (SELECT doc_id, page, lag(y) OVER (PARTITION BY doc_id, page ORDER BY line_ix) - y AS g FROM m) WHERE g > 0 GROUP BY ALL)
SELECT doc_id, page, body_size::DOUBLE AS body_size, w[floor(len(w) * 0.1)::INTEGER + 1]::DOUBLE AS column_width, coalesce(g[len(g) // 2 + 1], 0)::DOUBLE AS median_gap FROM b JOIN w USING (doc_id, page) LEFT JOIN d USING (doc_id, page)""")
def page_statistics(spark, sf_dir):
    lines = geometry.line_metrics(geometry.group_lines(glyphs(spark, sf_dir)))
    return geometry.median_font(lines).join(geometry.column_width(lines), ["doc_id", "page"]).join(geometry.median_gap(lines), ["doc_id", "page"])


@query(f"""WITH {_LINES} SELECT doc_id, page, line_ix::INTEGER AS line_ix, (item_ix % 4)::BIGINT AS cell_ix, 1::BIGINT AS n_items, x::DOUBLE AS x_left, (x + width)::DOUBLE AS x_right, (x + x + width)::DOUBLE / 2 AS centre FROM g""")
def split_cells(spark, sf_dir):
    return geometry.split_cells(geometry.group_lines(glyphs(spark, sf_dir)))


@query(f"""WITH {_LINES}, bs AS (SELECT doc_id, page, font_size, sum(n_chars) AS n FROM m GROUP BY doc_id, page, font_size), f AS (SELECT doc_id, page, font_size, sum(n) OVER (PARTITION BY doc_id, page ORDER BY font_size) AS reached, sum(n) OVER (PARTITION BY doc_id, page) AS total FROM bs),
b AS (SELECT doc_id, page, min(font_size) AS body FROM f WHERE reached * 2 >= total GROUP BY ALL), l AS (SELECT m.*, font_size >= 1.3 * body AS large FROM m JOIN b USING (doc_id, page)),
n AS (SELECT *, coalesce(lag(large) OVER w, false) OR coalesce(lead(large) OVER w, false) AS near FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_ix))
SELECT doc_id, page, line_ix::INTEGER AS line_ix, text FROM n WHERE large AND NOT near AND len(text) BETWEEN 1 AND 80""")
def size_headings(spark, sf_dir):
    items = geometry.group_lines(glyphs(spark, sf_dir))
    return geometry.size_headings(geometry.line_metrics(items).join(geometry.join_lines(items), ["doc_id", "page", "line_ix"]))


@query(f"""WITH {_LINES}, t AS (SELECT doc_id, page, line_ix, string_agg(str, ' | ' ORDER BY item_ix) AS r, string_agg(str, ' ' ORDER BY item_ix) AS p FROM g GROUP BY ALL)
SELECT doc_id, page::INTEGER AS page, 0 AS block_ix, CASE WHEN count(*) > 1 THEN 'table' ELSE 'paragraph' END AS kind, CASE WHEN count(*) > 1 THEN max(CASE WHEN line_ix = 0 THEN '| ' || r || ' |' END) || chr(10) || '| --- | --- | --- | --- |' || chr(10)
  || string_agg('| ' || r || ' |', chr(10) ORDER BY line_ix) FILTER (line_ix > 0) ELSE max(p) END AS md FROM t GROUP BY doc_id, page""")
def page_blocks(spark, sf_dir):
    from doclens.operators.layout import page_blocks as blocks

    return blocks(glyphs(spark, sf_dir))


# -- structure ---------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT l_orderkey AS doc_id, (l_suppkey % 2)::BIGINT AS list_ix, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS entry_ix, CASE WHEN l_quantity > 30 THEN NULL ELSE l_linenumber END AS v FROM lineitem),
o AS (SELECT *, lag(v) OVER w AS p, row_number() OVER w AS r FROM e WINDOW w AS (PARTITION BY doc_id, list_ix ORDER BY entry_ix)),
f AS (SELECT *, CASE WHEN r > 1 AND (v IS NULL AND p IS NULL OR v = p + 1) THEN 0 ELSE 1 END AS opens FROM o)
SELECT doc_id, list_ix, entry_ix::INTEGER AS entry_ix, v::BIGINT AS value, (sum(opens) OVER (PARTITION BY doc_id, list_ix ORDER BY entry_ix) - 1)::BIGINT AS run_ix FROM f""")
def label_runs(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey", F.col("l_suppkey") % 2).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    label = F.when(F.col("l_quantity") > 30, "-").otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit(" .")))
    entries = rows.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 2).cast("bigint").alias("list_ix"), F.row_number().over(order).alias("entry_ix"), label.alias("label"))
    return structure.label_islands(entries).select("doc_id", "list_ix", "entry_ix", "value", "run_ix")


@query("""SELECT doc_id, floor(c * 10000 + 0.5)::BIGINT AS coverage_e4, c >= 0.6 AS use_tree FROM (SELECT source AS doc_id, coalesce(sum(len(text)) FILTER (doc_id % 5 < 3), 0) / sum(len(text)) AS c FROM documents GROUP BY 1)""")
def tree_coverage(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("text").alias("str"), (F.col("doc_id") % 5 < 3).alias("claimed"))
    return structure.coverage(items).select("doc_id", F.floor(F.col("coverage") * 10000 + 0.5).cast("bigint").alias("coverage_e4"), "use_tree")


@query("""WITH b AS (SELECT conv_id AS doc_id, (turn // 2)::INTEGER AS page, (turn % 2)::INTEGER AS block_ix, text AS md, turn % 6 IN (2, 3) AS continues FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_ix) = 1 AND continues AND coalesce(lag(page) OVER w = page - 1, false) AS tail FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY page, block_ix)),
g AS (SELECT *, sum((NOT tail)::INTEGER) OVER (PARTITION BY doc_id ORDER BY page, block_ix) AS grp FROM t)
SELECT doc_id, arg_min(page, page * 1000 + block_ix) AS page, arg_min(block_ix, page * 1000 + block_ix) AS block_ix, string_agg(md, ' ' ORDER BY page, block_ix) AS md FROM g GROUP BY doc_id, grp""")
def rejoin_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    return structure.rejoin_across_pages(c.select(F.col("conv_id").alias("doc_id"), F.floor(turn / 2).cast("int").alias("page"), (turn % 2).cast("int").alias("block_ix"), F.col("text").alias("md"), (turn % 6).isin(2, 3).alias("continues")))


# -- slides ------------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT conv_id AS doc_id, turn AS slide, text, (turn * 7 + 3) % 101 AS k FROM conversations)
SELECT doc_id::VARCHAR AS doc_id, slide::INTEGER AS slide, trim(regexp_replace('Note of ' || slide || ' & ' || len(text), '\\s+', ' ', 'g')) AS notes FROM n WHERE slide % 3 <> 1""")
def slide_notes(spark, sf_dir):
    """Notes by relationship: parts are numbered by another rule than slides."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("slide"), F.length("text").alias("n"))
    k = ((F.col("slide") * 7 + 3) % 101).cast("string")
    name = lambda a, b, z: F.concat(F.lit(a), b, F.lit(z))
    n = F.col("slide").cast("string")
    own = c.select("doc_id", name("ppt/slides/slide", n, ".xml").alias("part"), F.encode(F.lit("<p:sld/>"), "UTF-8").alias("content"))
    noted = c.where("slide % 3 <> 1")
    target = F.concat(F.lit('<Relationships><Relationship Id="r1" Type="x/notesSlide" Target="../notesSlides/notesSlide'), k, F.lit('.xml"/></Relationships>'))
    rels = noted.select("doc_id", name("ppt/slides/_rels/slide", n, ".xml.rels").alias("part"), F.encode(target, "UTF-8").alias("content"))
    body = F.concat(F.lit("<a:p><a:r><a:t>Note of "), n, F.lit("</a:t></a:r><a:r><a:t> &amp;  "), F.col("n").cast("string"), F.lit("</a:t></a:r></a:p>"))
    said = noted.select("doc_id", name("ppt/notesSlides/notesSlide", k, ".xml").alias("part"), F.encode(body, "UTF-8").alias("content"))
    parts = own.unionByName(rels).unionByName(said)
    return slides.notes(slides.slide_table(parts), slides.relationships(parts), parts).select("doc_id", "slide", F.array_join("notes", " ").alias("notes"))
