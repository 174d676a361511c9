"""Tagged documents: the structure tree rendered as blocks, what it leaves out, and how much it covers.

A node is {"role": ..., "children": [...]} or a leaf {"id": ...}; items are layout.Item by marked-content id. Rendering
walks a tree and so runs page by page; coverage, the choice of path and the joins across pages are relational.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclens.operators.layout import Item, escape_block_marker, join_items, join_line, pipe_table

MIN_COVERAGE = 0.6
HEADINGS = {"H1": 1, "H2": 2, "H3": 3, "H4": 4, "H5": 5, "H6": 6}
_NUMBER = re.compile(r"^(\d+)\s*[.)]?$")
_SELF_NUMBERED = re.compile(r"^\d+(?:\.\d+)*[.)]\s")


def attribute(stream: list[tuple[str, object]]) -> list[tuple[str | None, Item]]:
    """(id, item) from a stream of ("begin", id or None), ("end", None) and ("item", Item): each item belongs to the
    innermost open mark that has an id."""
    out, open_ = [], []
    for kind, value in stream:
        if kind == "begin":
            open_.append(value)
        elif kind == "end":
            del open_[-1:]
        else:
            out.append((next((i for i in reversed(open_) if i is not None), None), value))
    return out


def numeric_label(label: str) -> int | None:
    found = _NUMBER.match(label)
    return int(found[1]) if found else None


def label_runs(labels: list[str]) -> list[tuple[bool, list[int]]]:
    """(ordered, places) of runs: a numbered one goes on as long as the numbers count up by one."""
    runs: list[tuple[bool, list[int]]] = []
    for k, label in enumerate(labels):
        n = numeric_label(label)
        ordered = n is not None
        if runs and runs[-1][0] == ordered and (not ordered or n == numeric_label(labels[runs[-1][1][0]]) + len(runs[-1][1])):
            runs[-1][1].append(k)
        else:
            runs.append((ordered, [k]))
    return runs


class PageTree:
    """Renders one page. ``used`` holds the ids that have been rendered; a table that cannot be one claims none."""

    def __init__(self, items: dict[str, list[Item]]):
        self.items, self.used, self.blocks, self.continues = items, set(), [], False

    def text(self, node: dict, used: set[str]) -> str:
        found: list[Item] = []

        def collect(n: dict) -> None:
            if "id" in n:
                used.add(n["id"])
                found.extend(self.items.get(n["id"], []))
            for c in n.get("children") or []:
                collect(c)

        collect(node)
        return join_items(found)

    def table(self, node: dict) -> str | None:
        used, rows = set(), []

        def walk(n: dict) -> None:
            if n.get("role") == "TR":
                if row := [self.text(c, used) for c in n.get("children") or [] if c.get("role") in ("TD", "TH")]:
                    rows.append(row)
            else:
                for c in n.get("children") or []:
                    walk(c)

        walk(node)
        square = len(rows) >= 2 and len(rows[0]) >= 2 and all(len(r) == len(rows[0]) for r in rows)
        if not square or not all(rows[0]) or not any(any(r) for r in rows[1:]):
            return None
        self.used |= used
        return pipe_table(rows)

    def list(self, node: dict) -> list[str]:
        entries = []
        for li in (c for c in node.get("children") or [] if c.get("role") == "LI"):
            parts = li.get("children") or []
            label = " ".join(self.text(p, self.used) for p in parts if p.get("role") == "Lbl").strip()
            rest = [p for p in parts if p.get("role") != "Lbl"]
            body = " ".join(t for t in (self.text(p, self.used) for p in rest or [li]) if t).strip()
            mark = re.match(r"([.)])\s*", body) if label else None
            entries.append((label, body[mark.end() :] if mark else body, mark[1] if mark else ""))
        entries = [e for e in entries if e[0] or e[1]]
        out = []
        if entries and not entries[0][0] and any(e[0] for e in entries):
            out.append(entries.pop(0)[1])  # the tail of an item that began on the page before
            self.continues |= not self.blocks
        for ordered, places in label_runs([e[0] for e in entries]):
            run = [entries[k] for k in places]
            if ordered:
                first = numeric_label(run[0][0])
                out.append("\n".join(f"{first + k}. {e[1]}" for k, e in enumerate(run)))
            elif all(not label and _SELF_NUMBERED.match(body) for label, body, _ in run):
                out += [body for _, body, _ in run]
            else:
                out.append("\n".join("- " + " ".join(x for x in (label + mark, body) if x) for label, body, mark in run))
        return out

    def render(self, node: dict) -> None:
        role = node.get("role")
        if role == "Table" and (table := self.table(node)):
            self.blocks.append(table)
        elif role == "L":
            self.blocks += self.list(node)
        elif role in HEADINGS or role in ("P", "Caption"):
            if text := self.text(node, self.used):
                self.blocks.append(f"{'#' * HEADINGS[role]} {text}" if role in HEADINGS else escape_block_marker(text))
        else:
            for child in node.get("children") or []:
                self.render(child)

    def untagged(self, loose: list[tuple[str | None, Item]]) -> tuple[list[str], list[str], int]:
        """Lines above and below of what the tree claims, and the number of claimed characters."""
        claimed = [i for id_, i in loose if id_ in self.used]
        rest = sorted((i for id_, i in loose if id_ not in self.used and i.str.strip()), key=lambda i: -i.y)
        top = max((i.y for i in claimed), default=float("-inf"))
        lines: list[list[Item]] = []
        for i in rest:
            if lines and abs(lines[-1][0].y - i.y) < 2:
                lines[-1].append(i)
            else:
                lines.append([i])
        texts = [(x[0].y > top, escape_block_marker(t)) for x in lines if (t := join_line(x))]
        return [t for up, t in texts if up], [t for up, t in texts if not up], sum(len(i.str) for i in claimed)


TREE_BLOCKS = "doc_id string, page int, zone string, block_ix int, md string, continues boolean, claimed bigint, chars bigint"


def tree_blocks(pages: DataFrame) -> DataFrame:
    """Blocks by zone (above, tree, below) of pages(doc_id, page, tree string, items array<struct<mc_id, item_ix, str, x,
    y, width, font_size>>); tree is JSON or null. Each row also has the page's flags and counts; a page without blocks
    gives one row with a null md, so that its counts are not lost."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for doc, page, tree, entries in zip(*(batch.column(i).to_pylist() for i in range(4))):
                entries = sorted(entries or [], key=lambda e: e["item_ix"])
                own = [(e["mc_id"], Item(e["str"] or "", e["x"], e["y"], e["width"] or 0.0, e["font_size"] or 0.0)) for e in entries]
                chars = sum(len(i.str) for _, i in own)
                by_id: dict[str, list[Item]] = {}
                for id_, i in own:
                    if id_ is not None:
                        by_id.setdefault(id_, []).append(i)
                made = PageTree(by_id)
                above = below = []
                claimed = 0
                if tree:
                    made.render(json.loads(tree))
                    above, below, claimed = made.untagged(own)
                zones = [("above", above), ("tree", made.blocks), ("below", below)]
                rows = [(doc, page, zone, k, md, made.continues, claimed, chars) for zone, mds in zones for k, md in enumerate(mds)]
                out += rows or [(doc, page, "tree", 0, None, False, claimed, chars)]
            c = list(zip(*out)) or [()] * 8
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=[x.split()[0] for x in TREE_BLOCKS.split(", ")])

    rows = pages.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), "tree", "items")
    return rows.mapInArrow(run, TREE_BLOCKS)


def coverage(items: DataFrame) -> DataFrame:
    """doc_id, coverage, use_tree from items(doc_id, str, claimed): the share of characters that trees claim, and
    whether it is enough to trust them. 0 for a document without characters."""
    n = F.sum(F.length("str"))
    share = F.coalesce(F.sum(F.when(F.col("claimed"), F.length("str")).otherwise(0)) / F.when(n > 0, n), F.lit(0.0))
    return items.groupBy("doc_id").agg(share.alias("coverage")).withColumn("use_tree", F.col("coverage") >= MIN_COVERAGE)


def label_islands(entries: DataFrame) -> DataFrame:
    """entries(doc_id, list_ix, entry_ix, label) with value, ordered and run_ix: the runs of label_runs by windows."""
    from doclens.functions.text import numeric_label as number

    own = Window.partitionBy("doc_id", "list_ix").orderBy("entry_ix")
    rows = entries.withColumn("value", number(F.col("label"))).withColumn("ordered", F.col("value").isNotNull())
    goes_on = (F.lag("ordered").over(own) == F.col("ordered")) & (~F.col("ordered") | (F.col("value") == F.lag("value").over(own) + 1))
    rows = rows.withColumn("opens", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("run_ix", (F.sum("opens").over(own) - 1).cast("bigint")).drop("opens")


def rejoin_across_pages(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, page, block_ix, md, continues): the first block of a page that continues the one before is added
    to that page's last block. Pages follow each other by number; a page without blocks breaks the chain."""
    own = Window.partitionBy("doc_id").orderBy("page", "block_ix")
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block_ix")) == 1
    rows = blocks.withColumn("tail", first & F.col("continues") & (F.lag("page").over(own) == F.col("page") - 1))
    rows = rows.withColumn("group", F.sum((~F.coalesce("tail", F.lit(False))).cast("int")).over(own))
    ordered = F.array_sort(F.collect_list(F.struct("page", "block_ix", "md")))
    grouped = rows.groupBy("doc_id", "group").agg(ordered.alias("parts"))
    return grouped.select("doc_id", F.col("parts")[0]["page"].alias("page"), F.col("parts")[0]["block_ix"].alias("block_ix"), F.array_join(F.transform("parts", lambda p: p["md"]), " ").alias("md"))
