"""Zip packages: their parts, and office formats as Markdown. Broken packages give an error row, not an exception."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from doclens.operators.layout import pipe_table

PARTS = "doc_id string, part string, content binary, error string"


def read_parts(files: DataFrame, pattern: str = ".*") -> DataFrame:
    """zip_parts(doc_id, part, content, error) of the parts whose names match; others are not unpacked."""
    import pyarrow as pa

    wanted = re.compile(pattern)

    def run(batches):
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                        rows = [(doc, n, z.read(n), None) for n in z.namelist() if wanted.match(n)]
                except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError, RuntimeError) as e:
                    rows = [(doc, None, None, f"{type(e).__name__}: {e}")]
                c = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.string(), pa.string(), pa.binary(), pa.string()))], names=["doc_id", "part", "content", "error"])

    return files.select("doc_id", "content").mapInArrow(run, PARTS)


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _texts(e: ElementTree.Element, *names: str) -> str:
    return "".join("\t" if _name(x) == "tab" else x.text or "" for x in e.iter() if _name(x) in (*names, "tab"))


def docx_to_markdown(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    out = []
    for e in body:
        if _name(e) == "tbl":
            rows = [[" ".join(_texts(c, "t").split()) for c in r if _name(c) == "tc"] for r in e.iter() if _name(r) == "tr"]
            width = max(map(len, rows), default=0)
            if width:
                out.append(pipe_table([r + [""] * (width - len(r)) for r in rows]))
        elif _name(e) == "p":
            style = next((v for x in e.iter() if _name(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            runs = []
            for r in (x for x in e.iter() if _name(x) == "r"):
                text = _texts(r, "t")
                bold = any(_name(x) == "b" and not any(v in ("0", "false") for v in x.attrib.values()) for x in r.iter())
                runs.append((bold, text))
            text = "".join(t for _, t in runs).strip()
            if text:
                level = re.fullmatch(r"Heading(\d)", style)
                whole = all(b or not t.strip() for b, t in runs)
                out.append(f"{'#' * int(level[1])} {text}" if level else f"**{text}**" if whole else text)
    return "\n\n".join(out) + "\n"


def odt_to_markdown(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    out = []
    for e in root.iter():
        if _name(e) in ("h", "p"):
            text = " ".join("".join(e.itertext()).split())
            level = next((int(v) for k, v in e.attrib.items() if k.endswith("outline-level")), 1)
            if text:
                out.append(f"{'#' * level} {text}" if _name(e) == "h" else text)
    return "\n\n".join(out) + "\n"


def xlsx_to_markdown(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_texts(s, "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", posixpath.basename(n))[0]))
        out = []
        for sheet in sheets:
            rows = []
            for r in (x for x in ElementTree.fromstring(z.read(sheet)).iter() if _name(x) == "row"):
                row: dict[int, str] = {}
                for c in (x for x in r if _name(x) == "c"):
                    letters = re.match(r"[A-Z]+", c.attrib.get("r", ""))
                    at = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters[0]))) - 1 if letters else len(row)
                    value = _texts(c, "v", "t")
                    row[at] = shared[int(value)] if c.attrib.get("t") == "s" and value else value
                rows.append([row.get(k, "") for k in range(max(row, default=-1) + 1)])
            width = max(map(len, rows), default=0)
            if width:
                out.append(pipe_table([r + [""] * (width - len(r)) for r in rows]))
    return "\n\n".join(out) + "\n"


def csv_to_markdown(data: bytes) -> str:
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig"))) if r]
    width = max(map(len, rows), default=0)
    return pipe_table([r + [""] * (width - len(r)) for r in rows]) + "\n" if width else ""


class _Blocks(HTMLParser):
    """Block texts of a chapter."""

    def __init__(self):
        super().__init__()
        self.out, self.now, self.level, self.skip = [], [], 0, 0

    def _flush(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.out.append(f"{'#' * self.level} {text}" if self.level else text)
        self.now, self.level = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        if tag in ("p", "div", "li", "blockquote", "section", "tr") or re.fullmatch("h[1-6]", tag):
            self._flush()
            self.level = int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head") and self.skip > 0
        if tag in ("p", "div", "li", "blockquote", "section", "tr") or re.fullmatch("h[1-6]", tag):
            self._flush()

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


def epub_to_markdown(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(x.attrib["full-path"] for x in container.iter() if _name(x) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        hrefs = {x.attrib["id"]: x.attrib["href"] for x in package.iter() if _name(x) == "item"}
        out = []
        for ref in (x.attrib["idref"] for x in package.iter() if _name(x) == "itemref"):
            parser = _Blocks()
            parser.feed(z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), hrefs[ref]))).decode("utf-8", "replace"))
            parser.close()
            parser._flush()
            out += parser.out
    return "\n\n".join(out) + "\n"


_RTF = re.compile(r"\\u(-?\d+)(?:\\'[0-9a-fA-F]{2}|[^\\{}])?|\\'([0-9a-fA-F]{2})|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")
_RTF_SKIP = ("fonttbl", "colortbl", "stylesheet", "info", "pict", "generator", "header", "footer")


def rtf_to_markdown(data: bytes) -> str:
    text, out, skip, stack, star = data.decode("latin-1"), [], False, [], False
    for m in _RTF.finditer(text):
        u, byte, word, _, symbol, brace, run = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif symbol == "*":
            star = True
            continue
        elif word in _RTF_SKIP or (word and star):
            skip = True
        elif not skip:
            if u:
                out.append(chr(int(u) % 65536))
            elif byte:
                out.append(bytes((int(byte, 16),)).decode("cp1252", "replace"))
            elif word in ("par", "line", "sect", "page"):
                out.append("\n\n")
            elif word == "tab":
                out.append("\t")
            elif symbol:
                out.append({"~": " ", "_": "-"}.get(symbol, symbol if symbol in "\\{}" else ""))
            elif run:
                out.append(run)
        star = False
    joined = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return "\n\n".join(t for t in (" ".join(p.split()) for p in joined.split("\n\n")) if t) + "\n"


READERS = {"docx": docx_to_markdown, "odt": odt_to_markdown, "xlsx": xlsx_to_markdown, "csv": csv_to_markdown, "epub": epub_to_markdown, "rtf": rtf_to_markdown}


def read_office(files: DataFrame) -> DataFrame:
    """doc_id, raw_md, error of office files. A damaged one has an error and no text."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for doc, ext, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                try:
                    out.append((doc, READERS[ext](data.as_py()), None))
                except Exception as e:  # any damage is the document's own
                    out.append((doc, None, f"{type(e).__name__}: {e}"))
            c = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in c], names=["doc_id", "raw_md", "error"])

    return files.where(files.ext.isin(*READERS)).select("doc_id", "ext", "content").mapInArrow(run, "doc_id string, raw_md string, error string")
