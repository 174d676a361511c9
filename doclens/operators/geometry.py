"""Lines, cells and order statistics of page items, by windows and aggregates.

glyph_items: doc_id, page, item_ix, str, x, y, width, font_size, has_eol. All windows are over one page, or one line.
What depends on what was decided before it on the page (baselines, reading order, tables, paragraphs) is in layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclens.functions import chars as C

PAGE = ("doc_id", "page")
LINE = ("doc_id", "page", "line_ix")
SPACE_GAP, CELL_GAP, DEFAULT_SIZE = 0.12, 0.6, 10.0
HEADING_RATIO, MAX_HEADING = 1.3, 80
GEOMETRY_RTL = r"\x{0590}-\x{06FF}\x{FB1D}-\x{FEFF}"


def _size(column: str = "font_size"):
    return F.when(F.coalesce(F.abs(F.col(column)), F.lit(0.0)) == 0, F.lit(DEFAULT_SIZE)).otherwise(F.abs(F.col(column)))


def group_lines(items: DataFrame) -> DataFrame:
    """items that hold text, with line_ix from 0: a line ends after an item with has_eol, be it empty or not."""
    before = Window.partitionBy(*PAGE).orderBy("item_ix").rowsBetween(Window.unboundedPreceding, -1)
    rows = items.withColumn("island", F.coalesce(F.sum(F.col("has_eol").cast("int")).over(before), F.lit(0))).where("str <> ''")
    return rows.withColumn("line_ix", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("island")) - 1).drop("island")


def _read_order(items: DataFrame) -> DataFrame:
    """items with place, their order in the line. A line with a right-to-left character reads from the largest x down,
    others as they come. In the former, a run of left-to-right items reads from the smallest x up: it lies between two
    right-to-left items and reaches from the first to the last item there that has a digit or a Latin letter."""
    line = Window.partitionBy(*LINE)
    is_rtl = F.col("str").rlike(f"[{GEOMETRY_RTL}]")
    rows = items.withColumn("turned", F.max(is_rtl.cast("int")).over(line) == 1)
    rows = rows.withColumn("place", F.row_number().over(line.orderBy(F.when(F.col("turned"), -F.col("x")).otherwise(F.col("item_ix").cast("double")), "item_ix")))
    rows = rows.withColumn("island", F.sum(is_rtl.cast("int")).over(line.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    between = Window.partitionBy(*LINE, "island")
    latin = F.when(F.col("turned") & ~is_rtl & F.col("str").rlike("[0-9A-Za-z]"), F.col("place"))
    rows = rows.withColumns({"first": F.min(latin).over(between), "last": F.max(latin).over(between)})
    rows = rows.withColumn("in_run", F.coalesce(F.col("place").between(F.col("first"), F.col("last")), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*LINE, "island", "in_run").orderBy("x", "place"))
    rows = rows.withColumn("place", F.when(F.col("in_run"), F.col("first") + rank - 1).otherwise(F.col("place")))
    return rows.drop("turned", "island", "first", "last", "in_run")


def join_lines(items: DataFrame) -> DataFrame:
    """doc_id, page, line_ix, text: items in reading order, a blank where facing edges are apart."""
    order = Window.partitionBy(*LINE).orderBy("place")
    px, pw = F.lag("x").over(order), F.coalesce(F.lag("width").over(order), F.lit(0.0))
    gap = F.when(F.col("x") > px, F.col("x") - (px + pw)).otherwise(px - (F.col("x") + F.coalesce("width", F.lit(0.0))))
    rows = _read_order(items).withColumn("piece", F.concat(F.when(gap > SPACE_GAP * _size(), " ").otherwise(""), "str"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"])
    text = F.trim(F.regexp_replace(F.array_join(pieces, ""), f"[{C.SPACE}]+", " "))
    return rows.groupBy(*LINE).agg(text.alias("text"))


def line_metrics(items: DataFrame) -> DataFrame:
    """doc_id, page, line_ix, y (of the first item), font_size (largest), x_left, x_right, n_chars."""
    return items.groupBy(*LINE).agg(
        F.min_by("y", "item_ix").alias("y"),
        F.max(_size()).alias("font_size"),
        F.min("x").alias("x_left"),
        F.max(F.col("x") + F.coalesce("width", F.lit(0.0))).alias("x_right"),
        F.sum(F.length("str")).cast("bigint").alias("n_chars"),
    )


def median_font(lines: DataFrame) -> DataFrame:
    """doc_id, page, body_size: the size at which half of the characters are reached, smallest sizes first."""
    by_size = lines.groupBy(*PAGE, "font_size").agg(F.sum(F.greatest("n_chars", F.lit(1))).alias("n"))
    reached = F.sum("n").over(Window.partitionBy(*PAGE).orderBy("font_size"))
    rows = by_size.withColumn("reached", reached).withColumn("total", F.sum("n").over(Window.partitionBy(*PAGE)))
    return rows.where(F.col("reached") * 2 >= F.col("total")).groupBy(*PAGE).agg(F.min("font_size").alias("body_size"))


def column_width(lines: DataFrame) -> DataFrame:
    """doc_id, page, column_width: the width that a tenth of the lines pass."""
    widths = F.sort_array(F.collect_list(F.when(F.col("x_right") > F.col("x_left"), F.col("x_right") - F.col("x_left"))), asc=False)
    return lines.groupBy(*PAGE).agg(widths.alias("w")).select(*PAGE, F.coalesce(F.get("w", F.floor(F.size("w") * 0.1).cast("int")), F.lit(0.0)).alias("column_width"))


def median_gap(lines: DataFrame) -> DataFrame:
    """doc_id, page, median_gap: the upper median of the drops from line to line, in the order of line_ix; 0 if none."""
    drop = F.lag("y").over(Window.partitionBy(*PAGE).orderBy("line_ix")) - F.col("y")
    gaps = F.sort_array(F.collect_list(F.when(F.col("drop") > 0, F.col("drop"))))
    return lines.withColumn("drop", drop).groupBy(*PAGE).agg(gaps.alias("g")).select(*PAGE, F.coalesce(F.get("g", F.floor(F.size("g") / 2).cast("int")), F.lit(0.0)).alias("median_gap"))


def split_cells(items: DataFrame, rtl: bool = False) -> DataFrame:
    """doc_id, page, line_ix, cell_ix, n_items, x_left, x_right, centre: cells begin after gaps of CELL_GAP font sizes;
    blank items bridge none."""
    own = items.where(F.trim("str") != "").withColumn("right", F.col("x") + F.coalesce("width", F.lit(0.0)))
    order = Window.partitionBy(*LINE).orderBy(F.desc("x") if rtl else F.asc("x"), "item_ix")
    gap = F.lag("x").over(order) - F.col("right") if rtl else F.col("x") - F.lag("right").over(order)
    own = own.withColumn("opens", F.coalesce((gap > CELL_GAP * _size()).cast("int"), F.lit(0)))
    own = own.withColumn("cell_ix", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = own.groupBy(*LINE, "cell_ix").agg(F.count("*").alias("n_items"), F.min("x").alias("x_left"), F.max("right").alias("x_right"))
    return cells.withColumn("centre", (F.col("x_left") + F.col("x_right")) / 2)


def size_headings(lines: DataFrame) -> DataFrame:
    """doc_id, page, line_ix, text of lines set large alone: HEADING_RATIO times the body size with no large line
    before or after, in the order of line_ix. lines: with text, font_size, n_chars."""
    order = Window.partitionBy(*PAGE).orderBy("line_ix")
    rows = lines.join(median_font(lines), list(PAGE)).withColumn("large", F.col("font_size") >= HEADING_RATIO * F.col("body_size"))
    near = F.coalesce(F.lag("large").over(order), F.lit(False)) | F.coalesce(F.lead("large").over(order), F.lit(False))
    rows = rows.withColumn("near", near)
    return rows.where("large AND NOT near AND body_size > 0").where((F.length("text") > 0) & (F.length("text") <= MAX_HEADING)).select(*LINE, "text")


def gutters(lines: DataFrame, step: int = 4, least: int = 2) -> DataFrame:
    """doc_id, page, gutter: the x that parts a page's lines most evenly, with at least ``least`` on each side and none
    across; the leftmost of equals. lines: x_left, x_right."""
    ends = lines.groupBy(*PAGE).agg(F.min("x_left").alias("lo"), F.max("x_right").alias("hi"), F.count("*").alias("n"), F.collect_list(F.struct("x_left", "x_right")).alias("spans"))
    tried = ends.select(*PAGE, "spans", F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / step).cast("int"))).alias("k"), "lo")
    x = F.col("lo") + F.col("k") * step
    count = lambda f: F.size(F.filter("spans", f))
    tried = tried.select(*PAGE, x.alias("x"), count(lambda s: s["x_right"] <= x).alias("l"), count(lambda s: s["x_left"] >= x).alias("r"), count(lambda s: (s["x_left"] < x) & (s["x_right"] > x)).alias("c"))
    good = tried.where(F.col("c") == 0).where((F.col("l") >= least) & (F.col("r") >= least))
    return good.groupBy(*PAGE).agg(F.max_by("x", F.struct(F.least("l", "r"), -F.col("x"))).alias("gutter"))
