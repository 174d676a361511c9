"""A small PDF reader: pages as text items, marks, paint operations and structure trees.

Reads objects by scanning, so a broken cross-reference table doesn't matter; Flate and ASCIIHex streams, object streams,
simple fonts with or without ToUnicode, and composite fonts with ToUnicode. Widths come from the font where it has them,
else from an average. Encrypted files are refused. A page that cannot be read is an error of its own.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.operators.painted import IDENTITY, Matrix, product

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|\{|\}|/[^\s()<>\[\]{}/%]*|<[0-9A-Fa-f\s]*>|\(|[^\s()<>\[\]{}/%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
AVERAGE_WIDTH = 500.0


class Name(str):
    pass


@dataclass(frozen=True)
class Ref:
    n: int


@dataclass
class Stream:
    dict: dict
    raw: bytes

    def data(self) -> bytes:
        out = self.raw
        filters = self.dict.get("Filter") or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f in ("FlateDecode", "Fl"):
                out = zlib.decompressobj().decompress(out)
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", out.partition(b">")[0])
                out = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                raise ValueError(f"filter {f}")
        return out


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            m = re.compile(rb"[0-7]{1,3}").match(data, at)
            if m:
                out.append(int(m[0], 8) & 255)
                at = m.end()
            else:
                n = data[at : at + 1]
                at += 1
                if n not in (b"\r", b"\n"):
                    out += _ESCAPES.get(n, n)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


class Parser:
    """Objects and operators of a byte string, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self):
        while m := _TOKEN.search(self.data, self.at):
            self.at = m.end()
            t = m[0]
            if t.startswith(b"%"):
                continue
            if t == b"(":
                value, self.at = _string(self.data, self.at)
                return value
            if t.startswith(b"<") and t != b"<<":
                digits = re.sub(rb"\s", b"", t[1:-1])
                return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            if t.startswith(b"/"):
                return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), t[1:].decode("latin-1")))
            return t.decode("latin-1")
        return None

    def value(self, t=None):
        t = self.token() if t is None else t
        if isinstance(t, bytes | Name) or t is None:
            return t
        if t == "<<":
            out = {}
            while (k := self.token()) not in (">>", None):
                out[str(k)] = self.value()
            return out
        if t == "[":
            out = []
            while (k := self.token()) not in ("]", None):
                out.append(self.value(k))
            return out
        if re.fullmatch(r"[+-]?\d+", t):
            m = re.compile(rb"\s+(\d+)\s+R\b").match(self.data, self.at)
            if m and "R" in m[0].decode():
                self.at = m.end()
                return Ref(int(t))
            return int(t)
        if re.fullmatch(r"[+-]?(?:\d+\.\d*|\.\d+)", t):
            return float(t)
        return {"true": True, "false": False, "null": None}.get(t, Operator(t))


class Operator(str):
    pass


class Document:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF-") and b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF")
        self.objects: dict[int, object] = {}
        trailer: dict = {}
        for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", data):
            p = Parser(data, m.end())
            value = p.value()
            s = re.compile(rb"\s*stream\r?\n").match(data, p.at)
            if isinstance(value, dict) and s:
                length = value.get("Length")
                end = s.end() + length if isinstance(length, int) and data[s.end() + length :].lstrip().startswith(b"endstream") else data.find(b"endstream", s.end())
                if end < 0:
                    continue
                value = Stream(value, data[s.end() : end])
            self.objects[int(m[1])] = value
        for m in re.finditer(rb"\btrailer\b", data):
            t = Parser(data, m.end()).value()
            trailer |= t if isinstance(t, dict) else {}
        for o in [*self.objects.values()]:
            if isinstance(o, Stream) and o.dict.get("Type") == "XRef":
                trailer |= o.dict
            if isinstance(o, Stream) and o.dict.get("Type") == "ObjStm":
                self._unpack(o)
        if "Encrypt" in trailer:
            raise ValueError("encrypted")
        root = self.get(trailer.get("Root")) or next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        if not isinstance(root, dict) or not self.get(root.get("Pages")):
            raise ValueError("no pages")
        self.root = root
        self.pages = list(self._pages(self.get(root["Pages"]), {}, 0))

    def _unpack(self, stream: Stream) -> None:
        data, first = stream.data(), stream.dict.get("First", 0)
        head = Parser(data)
        for _ in range(stream.dict.get("N", 0)):
            n, at = head.value(), head.value()
            self.objects.setdefault(n, Parser(data, first + at).value())

    def get(self, o):
        for _ in range(32):
            if not isinstance(o, Ref):
                return o
            o = self.objects.get(o.n)
        return None

    def _pages(self, node: dict, held: dict, depth: int):
        held = held | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
        if depth < 64 and "Kids" in node:
            for kid in self.get(node["Kids"]) or []:
                if isinstance(k := self.get(kid), dict):
                    yield from self._pages(k | {"_n": kid.n if isinstance(kid, Ref) else None}, held, depth + 1)
        elif node.get("Type", "Page") == "Page":
            yield held | node


@dataclass
class Font:
    two_byte: bool = False
    unicode: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    default: float = AVERAGE_WIDTH
    mapped: bool = False

    def glyphs(self, data: bytes) -> list[tuple[str, float, bool]]:
        """(character, width of 1000, is a blank) of each code."""
        codes = [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2)] if self.two_byte else list(data)
        plain = not self.mapped and not self.two_byte
        return [(self.unicode.get(c, bytes((c,)).decode("cp1252", "replace") if plain else ""), self.widths.get(c, self.default), c == 32 and not self.two_byte) for c in codes]


def _to_unicode(data: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            lo, hi = int(a, 16), int(b, 16)
            if many:
                out |= {lo + k: text(h) for k, h in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", many))}
            elif hi - lo < 65536:
                first = text(c)
                out |= {lo + k: first[:-1] + chr(ord(first[-1]) + k) for k in range(hi - lo + 1)}
    return out


def load_font(doc: Document, spec: dict) -> Font:
    font = Font(two_byte=spec.get("Subtype") == "Type0")
    if isinstance(cmap := doc.get(spec.get("ToUnicode")), Stream):
        font.unicode, font.mapped = _to_unicode(cmap.data()), True
    widths, first = doc.get(spec.get("Widths")) or [], spec.get("FirstChar", 0)
    font.widths = {first + k: float(w) for k, w in enumerate(map(doc.get, widths)) if isinstance(w, int | float)}
    if font.two_byte and isinstance(below := doc.get((doc.get(spec.get("DescendantFonts")) or [None])[0]), dict):
        font.default = float(below.get("DW", 1000))
        w, k = doc.get(below.get("W")) or [], 0
        while k + 1 < len(w):
            if isinstance(w[k + 1], list):
                font.widths |= {w[k] + j: float(x) for j, x in enumerate(w[k + 1])}
                k += 2
            else:
                font.widths |= {c: float(w[k + 2]) for c in range(w[k], min(w[k + 1], w[k] + 65535) + 1)}
                k += 3
    return font


@dataclass
class PageContent:
    items: list[dict] = field(default_factory=list)
    ops: list[dict] = field(default_factory=list)
    glyphs: list[dict] = field(default_factory=list)


def read_page(doc: Document, page: dict) -> PageContent:
    out = PageContent()
    contents = doc.get(page.get("Contents"))
    streams = [doc.get(c) for c in contents] if isinstance(contents, list) else [contents]
    _run(doc, b"\n".join(s.data() for s in streams if isinstance(s, Stream)), doc.get(page.get("Resources")) or {}, IDENTITY, out, 0)
    for a, b in zip(out.items, out.items[1:]):
        a["has_eol"] = abs(a["y"] - b["y"]) >= 2
    if out.items:
        out.items[-1]["has_eol"] = True
    return out


def _run(doc: Document, data: bytes, resources: dict, ctm: Matrix, out: PageContent, depth: int) -> None:
    fonts = {k: load_font(doc, doc.get(v)) for k, v in (doc.get(resources.get("Font")) or {}).items() if isinstance(doc.get(v), dict)}
    xobjects = doc.get(resources.get("XObject")) or {}
    font, size, lead, char, word, scale, rise = Font(), 10.0, 0.0, 0.0, 0.0, 1.0, 0.0
    tm = tlm = IDENTITY
    saved, marks, args = [], [], []
    p = Parser(data)

    def show(data: bytes) -> None:
        nonlocal tm
        text, start = "", product(tm, ctm)
        for c, w, blank in font.glyphs(data):
            out.glyphs.append({"unicode": c})
            text += c
            tm = product((1, 0, 0, 1, (w / 1000 * size + char + (word if blank else 0)) * scale, 0), tm)
        end = product(tm, ctm)
        if text:
            height = abs(size) * (start[2] ** 2 + start[3] ** 2) ** 0.5
            mark = next((m for m in reversed(marks) if m is not None), None)
            out.items.append({"str": text, "x": start[4], "y": start[5] + rise, "width": abs(end[4] - start[4]), "font_size": height, "has_eol": False, "mc_id": mark})

    while (t := p.token()) is not None:
        v = p.value(t)
        if not isinstance(v, Operator):
            args.append(v)
            continue
        if v == "q":
            saved.append((ctm, font, size, lead, char, word, scale, rise))
            out.ops.append({"op": "save"})
        elif v == "Q":
            if saved:
                ctm, font, size, lead, char, word, scale, rise = saved.pop()
            out.ops.append({"op": "restore"})
        elif v == "cm" and len(args) >= 6:
            ctm = product(tuple(map(float, args[-6:])), ctm)
            out.ops.append({"op": "transform", "matrix": [float(x) for x in args[-6:]]})
        elif v == "BT":
            tm = tlm = IDENTITY
        elif v == "Tf" and len(args) >= 2:
            font, size = fonts.get(str(args[-2]), Font()), float(args[-1])
        elif v in ("Td", "TD") and len(args) >= 2:
            lead = -float(args[-1]) if v == "TD" else lead
            tm = tlm = product((1, 0, 0, 1, float(args[-2]), float(args[-1])), tlm)
        elif v == "Tm" and len(args) >= 6:
            tm = tlm = tuple(map(float, args[-6:]))
        elif v in ("T*", "'", '"'):
            if v == '"' and len(args) >= 3:
                word, char = float(args[-3]), float(args[-2])
            tm = tlm = product((1, 0, 0, 1, 0, -lead), tlm)
            if v != "T*" and args and isinstance(args[-1], bytes):
                show(args[-1])
        elif v == "Tj" and args and isinstance(args[-1], bytes):
            show(args[-1])
        elif v == "TJ" and args and isinstance(args[-1], list):
            for x in args[-1]:
                if isinstance(x, bytes):
                    show(x)
                elif isinstance(x, int | float):
                    tm = product((1, 0, 0, 1, -x / 1000 * size * scale, 0), tm)
        elif v in ("TL", "Tc", "Tw", "Tz", "Ts") and args:
            n = float(args[-1])
            lead, char, word, scale, rise = (n if v == "TL" else lead), (n if v == "Tc" else char), (n if v == "Tw" else word), (n / 100 if v == "Tz" else scale), (n if v == "Ts" else rise)
        elif v in ("BMC", "BDC"):
            held = args[-1] if args else None
            held = doc.get((doc.get(resources.get("Properties")) or {}).get(held)) if isinstance(held, Name) and v == "BDC" else held
            marks.append(str(held["MCID"]) if isinstance(held, dict) and "MCID" in held else None)
        elif v == "EMC":
            del marks[-1:]
        elif v == "Do" and args and isinstance(x := doc.get(xobjects.get(str(args[-1]))), Stream):
            if x.dict.get("Subtype") == "Image":
                out.ops.append({"op": "image", "px_w": doc.get(x.dict.get("Width")), "px_h": doc.get(x.dict.get("Height"))})
            elif x.dict.get("Subtype") == "Form" and depth < 16:
                m = doc.get(x.dict.get("Matrix"))
                m = [float(k) for k in m] if isinstance(m, list) and len(m) == 6 else None
                out.ops.append({"op": "form_begin", "matrix": m})
                _run(doc, x.data(), doc.get(x.dict.get("Resources")) or resources, product(tuple(m), ctm) if m else ctm, out, depth + 1)
                out.ops.append({"op": "form_end"})
        elif v == "BI":
            out.ops.append({"op": "image"})
            end = re.compile(rb"\sEI\b").search(data, p.at)
            p.at = end.end() if end else len(data)
        args = []


def structure(doc: Document, page_n: int | None, root: dict | None = None) -> dict | None:
    """The structure tree as it concerns one page, as roles, children and marked-content ids."""
    tree = doc.get(doc.root.get("StructTreeRoot"))
    if not isinstance(tree, dict):
        return None
    roles = doc.get(tree.get("RoleMap")) or {}

    def walk(o, page, depth):
        o = doc.get(o)
        if isinstance(o, int):
            return [{"id": str(o)}] if page == page_n else []
        if isinstance(o, list):
            return [x for k in o for x in walk(k, page, depth)]
        if not isinstance(o, dict) or depth > 64:
            return []
        here = o["Pg"].n if isinstance(o.get("Pg"), Ref) else page
        if o.get("Type") == "MCR":
            return [{"id": str(o.get("MCID"))}] if here == page_n else []
        kids = walk(o.get("K"), here, depth + 1)
        role = str(o.get("S", ""))
        return [{"role": str(roles.get(role, role)), "children": kids}] if kids else []

    kids = walk(tree.get("K"), None, 0)
    return {"role": "Root", "children": kids} if kids else None


ITEM = "struct<item_ix:int,str:string,x:double,y:double,width:double,font_size:double,has_eol:boolean,mc_id:string>"
OP = "struct<op_ix:int,op:string,matrix:array<double>,px_w:int,px_h:int>"
SCHEMA = f"doc_id string, page int, page_count int, width double, height double, tree string, items array<{ITEM}>, ops array<{OP}>, glyphs array<struct<unicode:string>>, error string"


def read_pdf(files: DataFrame, pages=None) -> DataFrame:
    """A row for each page of PDF files(doc_id, content); of the wanted ones only, if pages (options.Pages) is given: the
    others are not read. A file or page that cannot be read has an error."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                rows = []
                try:
                    doc = Document(bytes(content))
                    for n, page in enumerate(doc.pages, 1):
                        if pages is not None and not pages.has(n):
                            continue
                        box = [float(doc.get(v)) for v in doc.get(page.get("MediaBox")) or [0, 0, 612, 792]]
                        row = {"doc_id": doc_id, "page": n, "page_count": len(doc.pages), "width": abs(box[2] - box[0]), "height": abs(box[3] - box[1]), "tree": None, "items": [], "ops": [], "glyphs": [], "error": None}
                        try:
                            c = read_page(doc, page)
                            tree = structure(doc, page.get("_n"))
                            row |= {"tree": json.dumps(tree) if tree else None, "items": [{"item_ix": k} | i for k, i in enumerate(c.items)], "ops": [{"op_ix": k, "op": o["op"], "matrix": o.get("matrix"), "px_w": o.get("px_w"), "px_h": o.get("px_h")} for k, o in enumerate(c.ops)], "glyphs": c.glyphs}
                        except Exception as e:  # the page's own damage
                            row["error"] = f"{type(e).__name__}: {e}"
                        rows.append(row)
                except Exception as e:  # the file's own damage
                    rows = [{"doc_id": doc_id, "page": None, "page_count": None, "width": None, "height": None, "tree": None, "items": [], "ops": [], "glyphs": [], "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pd.DataFrame(rows).astype({c: "object" for c in ("page", "page_count")})

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, SCHEMA)


def glyph_items(pages: DataFrame) -> DataFrame:
    return pages.where("error IS NULL").select("doc_id", "page", F.explode("items").alias("i")).select("doc_id", "page", "i.*")


def draw_ops(pages: DataFrame) -> DataFrame:
    return pages.where("error IS NULL").select("doc_id", "page", F.explode("ops").alias("o")).select("doc_id", "page", "o.*")
