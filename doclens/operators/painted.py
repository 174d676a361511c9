"""What a page paints: images with their size on the page, and glyphs without a character."""

from __future__ import annotations

from math import hypot

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
IMAGES = "doc_id string, page int, image_ix int, width double, height double, x double, y double, share double, px_w int, px_h int"


def product(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    a, b, c, d, e, f = m
    return (a * n[0] + b * n[2], a * n[1] + b * n[3], c * n[0] + d * n[2], c * n[1] + d * n[3], e * n[0] + f * n[2] + n[4], e * n[1] + f * n[3] + n[5])


def painted(ops: list[dict], area: float) -> list[dict]:
    """Images of a list of {op, matrix, px_w, px_h}; op is save, restore, transform, form_begin, form_end or image. A
    matrix without six numbers changes nothing. A restore without a save starts anew."""
    now, saved, out = IDENTITY, [], []
    for o in ops:
        m = o.get("matrix")
        m = tuple(m) if m and len(m) == 6 and all(v is not None for v in m) else None
        if o["op"] in ("save", "form_begin"):
            saved.append(now)
        if o["op"] in ("transform", "form_begin") and m:
            now = product(m, now)
        elif o["op"] in ("restore", "form_end"):
            now = saved.pop() if saved else IDENTITY
        elif o["op"] == "image":
            w, h = hypot(now[0], now[1]), hypot(now[2], now[3])
            out.append({"width": w, "height": h, "x": now[4], "y": now[5], "share": w * h / area if area else 0.0, "px_w": o.get("px_w"), "px_h": o.get("px_h")})
    return out


def painted_images(draw_ops: DataFrame, pages: DataFrame) -> DataFrame:
    """images of draw_ops(doc_id, page, op_ix, op, matrix, px_w, px_h) and pages(doc_id, page, width, height)."""
    import pyarrow as pa

    ops = draw_ops.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("op_ix", "op", "matrix", "px_w", "px_h"))).alias("ops"))
    rows = ops.join(pages.select("doc_id", "page", F.abs(F.col("width") * F.col("height")).alias("area")), ["doc_id", "page"])

    def run(batches):
        names = [c.split()[0] for c in IMAGES.split(", ")]
        for batch in batches:
            out = []
            for doc, page, ops, area in zip(*(batch.column(i).to_pylist() for i in range(4))):
                out += [(doc, page, k, *i.values()) for k, i in enumerate(painted(ops, area or 0.0))]
            c = list(zip(*out)) or [()] * len(names)
            types = (pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 5, pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=names)

    return rows.select("doc_id", F.col("page").cast("int").alias("page"), "ops", "area").mapInArrow(run, IMAGES)


def undecoded(glyphs: Column) -> Column:
    """How many of array<struct<unicode>> have no character; null entries are spacing, not glyphs."""
    return F.size(F.filter(glyphs, lambda g: g.isNotNull() & (F.coalesce(g["unicode"], F.lit("")).isin("", "�"))))
