"""Markdown to HTML: the part of GitHub's Markdown that conversion itself writes. Raw HTML is escaped."""

from __future__ import annotations

import re
from html import escape
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SLIDE_COMMENT = re.compile(r"^<!-- Slide \d+ (?:notes|OCR) -->$")
_ITEM = re.compile(r"^(\s*)(?:([-*+])|(\d{1,9})([.)]))\s+(.*)$")
_INLINE = re.compile(
    r"\\(?P<char>[\\`*_{}\[\]()#+\-.!|>~])|`(?P<code>[^`]+)`|\*\*(?P<strong>\S(?:.*?\S)?)\*\*|\*(?P<em>\S(?:.*?\S)?)\*|~~(?P<gone>\S(?:.*?\S)?)~~"
    r"|(?P<image>!?)\[(?P<label>[^\[\]]*)\]\((?P<to>[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+\"(?P<title>[^\"]*)\")?\)"
    r"|<(?P<angle>(?:https?|mailto):[^\s<>]+)>|(?P<bare>https?://[^\s<>]*[^\s<>.,;:!?\"')*_~])"
)
_TAGS = {"strong": "strong", "em": "em", "gone": "del"}
_SAFE = re.compile(r"(?i)(?:https?:|mailto:|[^:]*$|[^:]*[/?#])")


def _link(to: str, body: str, title: str | None = None) -> str:
    """A link; of a target whose scheme could run something, the text only."""
    if not _SAFE.match(to):
        return body
    return f'<a href="{escape(to)}"' + (f' title="{escape(title)}"' if title else "") + f">{body}</a>"


def inline(text: str) -> str:
    """Escapes, code spans, strong, emphasis, strikethrough, links, images and addresses; everything else as text."""
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out.append(escape(text[at : m.start()], quote=True))
        at, kind = m.end(), m.lastgroup
        if m["char"] is not None:
            out.append(escape(m["char"]))
        elif m["code"] is not None:
            out.append(f"<code>{escape(m['code'])}</code>")
        elif kind in _TAGS:
            out.append(f"<{_TAGS[kind]}>{inline(m[kind])}</{_TAGS[kind]}>")
        elif m["to"] is not None and m["image"]:
            named = f' title="{escape(m["title"])}"' if m["title"] else ""
            out.append(f'<img src="{escape(m["to"])}" alt="{escape(m["label"])}"{named}>' if _SAFE.match(m["to"]) else escape(m["label"]))
        elif m["to"] is not None:
            out.append(_link(m["to"], inline(m["label"]), m["title"]))
        else:
            address = m["angle"] or m["bare"]
            out.append(_link(address, escape(address.removeprefix("mailto:"))))
    return "".join([*out, escape(text[at:], quote=True)])


def _item(text: str) -> str:
    """An item's text; [ ] and [x] before it are boxes."""
    if box := re.match(r"\[([ xX])\]\s+", text):
        return f'<input{"" if box[1] == " " else " checked=" + chr(34) * 2} disabled="" type="checkbox"> {inline(text[box.end():])}'
    return inline(text)


def _alignment(rule: str) -> list[str]:
    """The attribute of each column by the colons of the row below a table's head."""
    sides = {(True, False): "left", (True, True): "center", (False, True): "right"}
    return [f' align="{sides[s]}"' if (s := (c.startswith(":"), c.endswith(":"))) in sides else "" for c in _row(rule)]


def _row(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def _list(lines: list[str]) -> str:
    """Items by indentation; deeper ones are lists of their own inside the item."""
    first = _ITEM.match(lines[0])
    ordered, depth = first[3] is not None, len(first[1])
    items: list[tuple[str, list[str]]] = []
    for line in lines:
        m = _ITEM.match(line)
        if m and len(m[1]) <= depth:
            items.append((m[5], []))
        elif line.strip():
            items[-1][1].append(line)
    out = []
    for text, rest in items:
        nested = [k for k, r in enumerate(rest) if _ITEM.match(r)]
        body = " ".join([text, *(r.strip() for r in rest[: nested[0] if nested else len(rest)])])
        out.append(f"<li>{_item(body)}{_list(rest[nested[0]:]) if nested else ''}</li>")
    start = f' start="{int(first[3])}"' if ordered and int(first[3]) != 1 else ""
    tag = "ol" if ordered else "ul"
    return f"<{tag}{start}>\n" + "\n".join(out) + f"\n</{tag}>"


def markdown_to_html(markdown: str) -> str:
    lines = markdown.split("\n")
    out: list[str] = []
    k = 0
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
        elif m := re.match(r"^\s*(```|~~~)", line):
            end = next((j for j in range(k + 1, len(lines)) if lines[j].lstrip().startswith(m[1])), len(lines))
            out.append("<pre><code>" + escape("\n".join(lines[k + 1 : end])) + "\n</code></pre>")
            k = end + 1
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            k += 1
        elif re.match(r"^\s*([-*_])(?:\s*\1){2,}\s*$", line):
            out.append("<hr>")
            k += 1
        elif _SLIDE_COMMENT.match(line.strip()):
            out.append(line.strip())
            k += 1
        elif line.lstrip().startswith(">"):
            end = k
            while end < len(lines) and lines[end].lstrip().startswith(">"):
                end += 1
            out.append("<blockquote>\n" + markdown_to_html("\n".join(re.sub(r"^\s*>\s?", "", x) for x in lines[k:end])) + "\n</blockquote>")
            k = end
        elif "|" in line and k + 1 < len(lines) and re.match(r"^\s*\|?(?:\s*:?-+:?\s*\|)+(?:\s*:?-+:?\s*)?\|?\s*$", lines[k + 1]):
            end = k + 2
            while end < len(lines) and "|" in lines[end]:
                end += 1
            sides = _alignment(lines[k + 1])
            cells = lambda tag, x: "<tr>" + "".join(f"<{tag}{a}>{inline(c)}</{tag}>" for c, a in zip_longest(_row(x)[: len(sides)], sides, fillvalue="")) + "</tr>"
            body = "\n".join(cells("td", x) for x in lines[k + 2 : end])
            out.append(f'<div class="table-scroll"><table>\n<thead>{cells("th", line)}</thead>\n<tbody>\n{body}\n</tbody></table></div>')
            k = end
        elif m := _ITEM.match(line):
            ordered, end, last = m[3] is not None, k, k
            while end < len(lines):
                n = _ITEM.match(lines[end])
                if n and len(n[1]) <= len(m[1]) and (n[3] is not None) != ordered:
                    break
                if not n and lines[end].strip() and (not lines[end].startswith(" ") and not lines[end - 1].strip()):
                    break
                if lines[end].strip():
                    last = end
                end += 1
            out.append(_list([x for x in lines[k : last + 1] if x.strip()]))
            k = last + 1
        else:
            end = k
            while end < len(lines) and lines[end].strip() and not re.match(r"^(#{1,6}\s|\s*(```|~~~|>))", lines[end]):
                end += 1
            end = max(end, k + 1)
            out.append(f"<p>{inline(chr(10).join(x.strip() for x in lines[k:end]))}</p>")
            k = end
    return "\n".join(out)


def materialise_list_numbers(html: str) -> str:
    """Numbers of ordered lists written into their own items; items of lists inside count for those."""
    stack: list[int | None] = []

    def step(m: re.Match) -> str:
        tag = m[0].lower()
        if tag.startswith("<ol"):
            found = re.search(r'start="(\d+)"', m[0])
            stack.append(int(found[1]) if found else 1)
        elif tag.startswith("<ul"):
            stack.append(None)
        elif tag.startswith(("</ol", "</ul")):
            del stack[-1:]
        elif stack and stack[-1] is not None:
            stack[-1] += 1
            return f"{m[0]}{stack[-1] - 1}. "
        return m[0]

    return re.sub(r"<(?:/?[ou]l\b[^>]*|li\b[^>]*)>", step, html, flags=re.I)


def slide_notes_to_asides(html: Column, dir_: Column) -> Column:
    pattern = r"<!-- Slide (\d+) notes -->\s*<blockquote>([\s\S]*?)</blockquote>"
    ltr, rtl = (F.regexp_replace(html, pattern, f'<aside data-slide="$1" dir="{d}">$2</aside>') for d in ("ltr", "rtl"))
    return F.when(dir_ == "rtl", rtl).otherwise(ltr)


@F.pandas_udf(StringType())
def _render(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else markdown_to_html(t))


@F.pandas_udf(StringType())
def _numbered(s: pd.Series) -> pd.Series:
    return s.map(lambda t: materialise_list_numbers(t) if t and "<ol" in t else t)


def number_lists(html: Column) -> Column:
    """materialise_list_numbers; pages without an ordered list pass as they are."""
    return _numbered(html)


def document_css(dir_: str) -> str:
    start = "right" if dir_ == "rtl" else "left"
    return f"body{{margin:0;font:16px/1.6 sans-serif}}main{{max-width:48rem;margin:auto;padding:1rem}}table{{border-collapse:collapse}}th,td{{border:1px solid #999;padding:.3rem .6rem;text-align:{start}}}.table-scroll{{overflow-x:auto}}aside{{border-inline-start:3px solid #999;padding-inline-start:1rem}}"


def render_html(markdown: Column, title: Column | None = None) -> Column:
    """A page of its own: front matter gives direction, language, source and title."""
    from doclens.functions.text import escape_html, parse_front_matter, unwrap_rtl_div

    front = parse_front_matter(markdown)
    fields = front["fields"]
    dir_ = F.coalesce(fields["dir"], F.lit("ltr"))
    lang = F.coalesce(fields["lang"], F.when(dir_ == "rtl", "he").otherwise("en"))
    name = F.coalesce(title if title is not None else F.lit(None).cast("string"), fields["title"], F.lit("Document"))
    source = F.when(fields["source"].isNotNull(), F.concat(F.lit('<meta name="source" content="'), escape_html(fields["source"]), F.lit('">\n'))).otherwise("")
    body = slide_notes_to_asides(_render(unwrap_rtl_div(front["body"])), dir_)
    css = F.when(dir_ == "rtl", document_css("rtl")).otherwise(document_css("ltr"))
    return F.concat(
        F.lit('<!doctype html>\n<html dir="'), dir_, F.lit('" lang="'), lang, F.lit('">\n<head>\n<meta charset="utf-8">\n'), source, F.lit("<title>"), escape_html(name),
        F.lit("</title>\n<style>"), css, F.lit("</style>\n</head>\n<body>\n<main>"), body, F.lit("</main>\n</body>\n</html>\n"),
    )
