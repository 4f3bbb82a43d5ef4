"""Order and grouping of regions, lines and tokens on a page."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import geometry
from recordloom.functions.text import _c, strip


def reading_order(y: Column | str, x: Column | str, bin_px: int = 24) -> list[Column]:
    """Rows of bin_px, then from left to right."""
    return [F.floor(_c(y) / bin_px) * bin_px, _c(x)]


def rounded_order(y: Column | str, x: Column | str, bin_px: int = 25) -> list[Column]:
    """Rows by the nearest multiple, halves to the even one."""
    return [F.bround(_c(y) / bin_px) * bin_px, _c(x)]


def column_order(y0, y1, x0, x1, width, height, columns: int = 3, header: float = 0.12) -> list[Column]:
    """The header first, then columns from left to right on wide pages, else from top to bottom."""
    wide = _c(width) > _c(height)
    top = _c(y1) <= header * _c(height)
    column = F.least(F.lit(columns - 1), F.floor((_c(x0) + _c(x1)) / 2 / (_c(width) / columns)))
    return [(~top).cast("int"), F.when(wide & ~top, column).otherwise(0), _c(y0), _c(x0)]


def line_windows(lines: DataFrame, document: str, order: list[str], text: str, sizes: tuple[int, ...] = (1, 2, 3), confidence: str | None = None, boxes: bool = False) -> DataFrame:
    """For each line and k the k lines from it on: joined text, union of boxes, mean confidence (missing or 0: 0.90), three places."""
    parts = []
    n = F.row_number().over(Window.partitionBy(document).orderBy(*order)).alias("line_no")
    numbered = lines.select("*", n)
    for k in sizes:
        frame = Window.partitionBy(document).orderBy("line_no").rowsBetween(0, k - 1)
        out = numbered.withColumn("window_size", F.lit(k)).withColumn("window_text", F.array_join(F.collect_list(strip(F.coalesce(text, F.lit("")))).over(frame), " "))
        if confidence:
            own = F.when(F.coalesce(confidence, F.lit(0.0)) == 0, 0.90).otherwise(F.col(confidence))
            out = out.withColumn("window_confidence", F.bround(F.avg(own).over(frame), 3))
        if boxes:
            out = out.withColumn("window_box", geometry.box(F.min("x_min").over(frame), F.min("y_min").over(frame), F.max("x_max").over(frame), F.max("y_max").over(frame)))
        parts.append(out.withColumn("_full", F.count(F.lit(1)).over(frame)).where(F.col("_full") == k).drop("_full"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def anchored_clusters(values: Column, tolerance: float) -> Column:
    """Row numbers of a sorted array: a value joins the row whose first value is within tolerance, else begins one."""
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, v: Column) -> Column:
        new = s["first"].isNull() | (F.abs(v - s["first"]) > tolerance)
        row = s["row"] + new.cast("int")
        return F.struct(F.when(new, v).otherwise(s["first"]).alias("first"), row.alias("row"), F.array_append(s["rows"], row).alias("rows"))

    return F.aggregate(F.transform(values, lambda v: v.cast("double")), start, step, lambda s: s["rows"])


def mean_clusters(values: Column, tolerance: float) -> Column:
    """As anchored_clusters, by the distance from the mean of the last row."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, v: Column) -> Column:
        new = (s["n"] == 0) | (F.abs(v - F.try_divide(s["sum"], s["n"])) > tolerance)
        row = s["row"] + new.cast("int")
        return F.struct(F.when(new, v).otherwise(s["sum"] + v).alias("sum"), F.when(new, 1).otherwise(s["n"] + 1).alias("n"), row.alias("row"), F.array_append(s["rows"], row).alias("rows"))

    return F.aggregate(F.transform(values, lambda v: v.cast("double")), start, step, lambda s: s["rows"])


def first_line_clusters(boxes: Column, share: float = 0.55, least: float = 10.0) -> Column:
    """Row numbers of boxes (struct(y, h), sorted by y): within max(least, share x smaller height) of the row's first box."""
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("h"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, b: Column) -> Column:
        new = s["y"].isNull() | (F.abs(b["y"] - s["y"]) > F.greatest(F.lit(least), share * F.least(b["h"], s["h"])))
        row = s["row"] + new.cast("int")
        keep = lambda n: F.when(new, b[n].cast("double")).otherwise(s[n]).alias(n)
        return F.struct(keep("y"), keep("h"), row.alias("row"), F.array_append(s["rows"], row).alias("rows"))

    return F.aggregate(boxes, start, step, lambda s: s["rows"])


def _by_page(rows: DataFrame, page: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A page's rows are few (what a person can see), so they are one pandas group."""
    return rows.groupBy(*page).applyInPandas(work, schema)


def line_clusters(boxes: DataFrame, page: list[str], share: float = 0.45, least: float = 12.0) -> DataFrame:
    """Boxes (x_min, y_min, x_max, y_max) by centre to the nearest of all lines so far whose mean centre is within max(least, share x mean height)."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y_min", "x_min"], kind="stable").reset_index(drop=True)
        lines: list[list] = []  # sum of centres, sum of heights, number
        out = []
        for r in pdf.itertuples():
            c, h = (r.y_min + r.y_max) / 2, r.y_max - r.y_min
            near = [(abs(c - s / n), i) for i, (s, t, n) in enumerate(lines) if abs(c - s / n) <= max(least, share * t / n)]
            if near:
                i = min(near)[1]
                lines[i] = [lines[i][0] + c, lines[i][1] + h, lines[i][2] + 1]
            else:
                i = len(lines)
                lines.append([c, h, 1])
            out.append(i)
        return pdf.assign(line=out)

    return _by_page(boxes, page, work, ", ".join([*fields, "line int"]))


def grid(cells: DataFrame, page: list[str], tolerance: float = 10.0) -> DataFrame:
    """Cells to rows by their tops and to columns by the nearest of all rows' refined left edges."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in cells.schema]

    def cut(values: list[float]) -> list[float]:
        groups: list[list[float]] = []
        for v in sorted(values):
            if groups and v - sum(groups[-1]) / len(groups[-1]) <= tolerance:
                groups[-1].append(v)
            else:
                groups.append([v])
        return [sum(g) / len(g) for g in groups]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = cut(pdf["y_min"].tolist()), cut(pdf["x_min"].tolist())
        near = lambda edges, v: min(range(len(edges)), key=lambda i: (abs(edges[i] - v), i))
        return pdf.assign(row_no=[near(rows, v) for v in pdf["y_min"]], column_no=[near(columns, v) for v in pdf["x_min"]])

    return _by_page(cells, page, work, ", ".join([*fields, "row_no int", "column_no int"]))


def spaced_text(words: DataFrame, line: list[str], gap: float = 0.22) -> DataFrame:
    """A line's words from left to right, with a blank where the gap is at least gap x the line's height."""
    order = Window.partitionBy(*line).orderBy("x_min", "x_max")
    high = F.max("y_max").over(Window.partitionBy(*line)) - F.min("y_min").over(Window.partitionBy(*line))
    blank = (F.col("x_min") - F.lag("x_max").over(order)) >= gap * high
    put = words.withColumn("_part", F.concat(F.when(blank, " ").otherwise(""), "text")).withColumn("_n", F.row_number().over(order))
    return put.groupBy(*line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_part"))), lambda x: x["_part"]), "").alias("text"))


def blocks(lines: DataFrame, page: list[str], gap: float = 30.0) -> DataFrame:
    """A new block where the distance from the line above is over gap."""
    order = Window.partitionBy(*page).orderBy("y_min", "x_min")
    new = F.coalesce((F.col("y_min") - F.lag("y_max").over(order) > gap).cast("int"), F.lit(0))
    return lines.withColumn("_new", new).withColumn("block", F.sum("_new").over(order)).drop("_new")


def islands(rows: DataFrame, key: str, order: list[str], value: Column | str, gap: Column | float) -> DataFrame:
    """W10 over any ordered value: island numbers from 0, a new one where the step is over gap."""
    w = Window.partitionBy(key).orderBy(*order)
    v = _c(value)
    new = F.coalesce((v - F.lag(v).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w).cast("long")).drop("_new")


def merged_boxes(boxes: Column, share: float = 0.6) -> Column:
    """Boxes (sorted by x_min) folded: one that overlaps the last by over share of the narrower, or lies in it, joins it."""

    def step(kept: Column, b: Column) -> Column:
        last = F.element_at(kept, -1)
        wide = F.least(last["x_max"] - last["x_min"], b["x_max"] - b["x_min"])
        over = F.least(last["x_max"], b["x_max"]) - F.greatest(last["x_min"], b["x_min"])
        joins = (F.size(kept) > 0) & ((over > share * wide) | ((b["x_min"] >= last["x_min"]) & (b["x_max"] <= last["x_max"])))
        both = geometry.box(F.least(last["x_min"], b["x_min"]), F.least(last["y_min"], b["y_min"]), F.greatest(last["x_max"], b["x_max"]), F.greatest(last["y_max"], b["y_max"]))
        return F.when(joins, F.array_append(F.slice(kept, 1, F.size(kept) - 1), both)).otherwise(F.array_append(kept, geometry.box(b["x_min"], b["y_min"], b["x_max"], b["y_max"])))

    empty = F.array().cast("array<struct<x_min:double,y_min:double,x_max:double,y_max:double>>")
    # element_at of an empty array is null under try semantics
    return F.aggregate(F.slice(boxes, 2, F.greatest(F.size(boxes) - 1, F.lit(0))), F.when(F.size(boxes) > 0, F.transform(F.slice(boxes, 1, 1), lambda b: geometry.box(b["x_min"], b["y_min"], b["x_max"], b["y_max"]))).otherwise(empty), step)


def cells_of_lines(lines: DataFrame, cells: DataFrame, page: list[str], threshold: float = 0.5) -> DataFrame:
    """Each cell's text: the lines that lie in it by threshold of their area, in line order."""
    a = lines.select(*page, "line_no", "text", F.col("box").alias("line_box"))
    pairs = cells.join(a, page).where(geometry.inside_share(F.col("line_box"), F.col("box")) >= threshold)
    texts = pairs.groupBy(*page, "cell_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    return cells.join(texts, [*page, "cell_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def word_boxes(text: Column | str, box: Column) -> Column:
    """Words of a line with boxes in proportion to their letters."""
    t = _c(text)
    n = F.greatest(F.length(t), F.lit(1))
    step = (box["x_max"] - box["x_min"]) / n
    parts = F.filter(F.split(t, " "), lambda w: w.isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,x_min:double,x_max:double>>").alias("out"))

    def add(s: Column, w: Column) -> Column:
        one = F.struct(w.alias("text"), (box["x_min"] + step * s["at"]).alias("x_min"), (box["x_min"] + step * (s["at"] + F.length(w))).alias("x_max"))
        return F.struct((s["at"] + F.length(w) + 1).alias("at"), F.when(w == "", s["out"]).otherwise(F.array_append(s["out"], one)).alias("out"))

    return F.aggregate(parts, start, add, lambda s: s["out"])


def markdown(headers: Column | str, rows: Column | str) -> Column:
    """A table as Markdown; short rows are filled up."""
    h = _c(headers)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    filled = F.transform(_c(rows), lambda r: line(F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.coalesce(F.get(r, i), F.lit("")))))
    return F.array_join(F.concat(F.array(line(h), line(F.transform(h, lambda _: F.lit("---")))), filled), "\n")


def table_size(cells: Column | str) -> Column:
    """struct(rows, columns) from cells with row and col; 0 without cells."""
    c = _c(cells)
    most = lambda f: F.coalesce(F.array_max(F.transform(c, lambda x: x[f])) + 1, F.lit(0))
    return F.struct(most("row").alias("rows"), most("col").alias("columns"))
