"""Main text of web pages by composite text density.

A page becomes a tree of elements (missing end tags implied, raw-text elements skipped to their end tag). Elements
that are never an article's text, by their tag, role, or words of their class and id, are cut off first. Every other
node then has C characters and T tags below it, LC of the characters and LT of the tags in links, and the composite
density

    C/T * log base ln(C/(C-LC)*LC + LCb/Cb*C + e) of (C/LC * T/LT)

with b the body. The node whose children's densities sum up highest is the text; the lowest density on its path to
the body is the threshold that a subtree beside that path must reach to belong to it as well. A heading beside the
path belongs to it too. Blocks of the chosen subtrees follow in page order.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

from pyspark.sql import DataFrame

# a quote opens a value after an equals sign only; one that is never closed is a character like others
_VALUE = r"\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<([/]?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:{_VALUE})|[^>])*+)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(rf"([^\s/>=\"'][^\s/>=]*)(?:\s*+=\s*+({_VALUE})?)?|=\s*+(?:{_VALUE})")
_ASKED = frozenset("class id role hidden aria-hidden style".split())
# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp svg math object select option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}}
HEADINGS = frozenset(("h1", "h2", "h3"))
#: Elements cut off, by tag, by role, and by whole words of class and id.
NOISE_TAGS = frozenset("nav footer aside form button dialog menu input".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay"
    " sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer foot copyright legal disclaimer comment comments commentlist"
    " respond reply replies disqus share sharing social follow subscribe subscription newsletter signup login register search related recommended recommendations trending popular tags tagcloud skip hidden".split()
)
_WORDS = re.compile(r"[a-z]+").findall


def _is_noise(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name not in _ASKED:
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in NOISE_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id") and not (in_article and tag in ("header", "h1", "h2")):
            # camelCase and hyphens count as word limits
            if NOISE_WORDS & set(_WORDS(value)):
                return True
    return False


class Tree:
    """Elements in page order: tags, parents, noise; and what stands in the page: (node, text) or (node, None) where
    a block begins or ends."""

    def __init__(self, html: str):
        self.tag, self.parent, self.noise = ["#root"], [0], [False]
        self.items: list[tuple[int, str | None]] = []
        open_: list[int] = [0]
        count: Counter[str] = Counter()  # of open elements, by tag

        def close(k: int) -> None:
            """Close the k-th open element and all in it."""
            if any(self.tag[x] not in INLINE for x in open_[k:]):
                self.items.append((open_[k], None))
            count.subtract(self.tag[x] for x in open_[k:])
            del open_[k:]

        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            stop = m.start() if m else end
            if stop > at:
                self._text(open_[-1], html[at:stop])
            if not m:
                break
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                if count[name] > 0:
                    close(next(k for k in range(len(open_) - 1, 0, -1) if self.tag[open_[k]] == name))
                continue
            if name in RAW:
                ended = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = ended.end() if ended else end if name in ("script", "style") else at
                if ended or name in ("script", "style"):
                    continue
            if name in CLOSES_P and count["p"] > 0:
                k = len(open_) - 1
                while k > 0 and self.tag[open_[k]] in INLINE:
                    k -= 1
                if k > 0 and self.tag[open_[k]] == "p":
                    close(k)
            if name in SAME:
                for k in range(len(open_) - 1, 0, -1):
                    if self.tag[open_[k]] in STOPS[name]:
                        break
                    if self.tag[open_[k]] in SAME[name]:
                        close(k)
                        break
            node = len(self.tag)
            up = open_[-1]
            self.tag.append(name)
            self.parent.append(up)
            self.noise.append(self.noise[up] or _is_noise(name, m[3], count["article"] + count["main"] > 0))
            if name == "br":
                self.items.append((node, " "))
            elif name not in INLINE:
                self.items.append((node, None))
            if name not in VOID and not m[3].endswith("/"):
                open_.append(node)
                count[name] += 1

    def _text(self, node: int, raw: str) -> None:
        if not self.noise[node]:
            self.items.append((node, unescape(raw) if "&" in raw else raw))


def _densities(tree: Tree) -> tuple[list[float], list[float], list[int]]:
    """Composite density, sum of the children's, and characters of each node."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        in_link[i] = tree.tag[i] == "a" or in_link[tree.parent[i]]
    for node, text in tree.items:
        if text:
            k = len("".join(text.split()))
            chars[node] += k
            if in_link[node]:
                link_chars[node] += k
    for i in range(n - 1, 0, -1):
        if not tree.noise[i]:
            p = tree.parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + in_link[i]
    body = tree.tag.index("body") if "body" in tree.tag else 0
    share = link_chars[body] / max(1, chars[body])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, t, lc, lt = chars[i], tags[i] or 1, link_chars[i], link_tags[i]
        if c and not tree.noise[i]:
            inner = log(c / max(1, c - lc) * lc + share * c + e)
            ratio = c / max(1, lc) * t / max(1, lt)
            density[i] = c / t * (log(ratio) / log(inner) if inner > 1.0001 else log(ratio) + 1) if ratio > 0 else 0.0
        if i:
            total[tree.parent[i]] += max(0.0, density[i])
    return density, total, chars


def extract(html: str | None) -> str:
    """The main text: blocks joined by a newline, white space within a block made one space. "" for a null, empty or
    textless page. Nothing else is dropped and no length is capped."""
    if not html:
        return ""
    tree = Tree(html)
    density, total, chars = _densities(tree)
    n = len(tree.tag)
    body = tree.tag.index("body") if "body" in tree.tag else 0
    best = max(range(n), key=lambda i: (total[i], -i))
    if not total[best]:
        best = body if chars[body] else 0
    path = {best}
    i, least = best, density[best]
    while i != body and i:
        i = tree.parent[i]
        path.add(i)
        least = min(least, density[i])
    # an article or main element on the path is the text as a whole
    whole = next((k for k in sorted(path) if tree.tag[k] in ("article", "main")), best)
    taken = [False] * n
    beside = {k for k in path if k < whole or k == whole}
    for k in range(n):
        p = tree.parent[k]
        if tree.noise[k] or tree.tag[k] == "head":
            continue
        taken[k] = k == whole or (k > 0 and taken[p]) or (k > 0 and p in beside and k not in path and chars[k] > 0 and (density[k] >= least and tree.tag[k] not in INLINE or tree.tag[k] in HEADINGS))
    blocks: list[str] = []
    parts: list[str] = []
    for node, text in tree.items:
        if text is None:
            if parts:
                blocks.append(" ".join("".join(parts).split()))
                parts = []
        elif taken[node]:
            parts.append(text)
    blocks.append(" ".join("".join(parts).split()))
    return "\n".join(b for b in blocks if b)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html). Rows are independent: nulls in page_id
    and url pass through, repeated rows give repeated results, an empty table none; other columns are not read."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
